"""Exact deduplication against a persistent digest index, in DataFrame operations only.

The index is a table bucketed and sorted by digest. New rows are reduced to one row per digest (partial aggregation before
the shuffle), anti-joined with the index by sort-merge, and the digests that are new are appended. A digest is the SHA-256
of the text's UTF-8 bytes; a null text counts as empty. Texts are read and hashed once; all else works on (id, digest). Rows
find their group without a shuffle where a digest holds many of them (`join_groups`).

Cases: an empty table gives an empty result; very long texts are hashed whole; equal texts form one group whatever their other columns; the row with the
largest doc_id of a group stays (a null id is smaller than any other); rows that repeat both id and text are one document
and share its verdict; columns besides doc_id and text are ignored, so their names never clash. A digest that an earlier
batch stored keeps its first holder, so all rows of a later batch with that digest are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalloom.llm.common import free_names, join_groups, materialise
from signalloom.sources.shared import scratch_table, shared_path


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, digest) of every row; the text itself goes no further than this projection."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"))


class DigestIndex:
    """The persistent index: digest, keep_id, group_size, in `buckets` buckets sorted by digest at `location`.

    An index that is to last has a name and a location: later sessions that share the catalog open it by its name, and nothing of this library deletes
    it. Without a name it serves one run, lies in the shared folder and goes with it, catalog entry included."""

    def __init__(self, spark: SparkSession, name: str | None = None, location: str | None = None, buckets: int | None = None):
        if name and not location:
            raise ValueError("a named index needs a location of its own: the shared folder is cleared")
        self.spark = spark
        self.name = name or scratch_table(spark)
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        location = location or shared_path(spark, "digest_index")
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} (digest BINARY, keep_id BIGINT, group_size BIGINT) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{location}'"
        )

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def append(self, rows: DataFrame) -> None:
        """Store every digest of the (doc_id, digest) rows that the index lacks, with its largest doc_id and its number."""
        groups = rows.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        known = self.rows().select(F.col("digest").alias("__known")).hint("merge")
        # the second condition always holds; as it reads an aggregate, the planner cannot move the join below the aggregation
        fresh = groups.join(known, (F.col("digest") == F.col("__known")) & (F.col("group_size") > 0), "left_anti")
        dealt = fresh.select("digest", "keep_id", "group_size").repartition(self.buckets, "digest")
        dealt.write.insertInto(self.name)
        self.spark.catalog.refreshTable(self.name)

    def label(self, rows: DataFrame) -> DataFrame:
        """Each (doc_id, digest) row with the group that the index holds for its digest."""
        held = join_groups(rows, self.rows(), "digest")
        return held.select(
            "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
        )


def deduplicate(docs: DataFrame, index: DigestIndex | None = None) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256. The index gains what is new."""
    index = index or DigestIndex(docs.sparkSession)
    rows = materialise(digests(docs), "digests")
    index.append(rows)
    return index.label(rows)


def keep_distinct(docs: DataFrame) -> DataFrame:
    """The documents that stay, with all their columns; a repeat of one id and text stays once. The join is on digest and id
    together, so a large group of equal texts is spread by id."""
    index = DigestIndex(docs.sparkSession)
    rows = materialise(digests(docs), "digests")
    index.append(rows)
    own_digest, own_id, digest, keep = free_names(docs, "__digest", "__id", "__known", "__keep")
    keyed = docs.withColumns({own_digest: F.unhex(F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"), 256)), own_id: F.col("doc_id").cast("long")})
    held = index.rows().select(F.col("digest").alias(digest), F.col("keep_id").alias(keep))
    kept = keyed.join(held, (F.col(own_digest) == F.col(digest)) & F.col(own_id).eqNullSafe(F.col(keep)), "left_semi")
    repeats = rows.groupBy("doc_id", "digest").count().filter("count > 1").limit(1)
    kept = kept if repeats.isEmpty() else kept.dropDuplicates([own_id, own_digest])
    return kept.select(*docs.columns)
