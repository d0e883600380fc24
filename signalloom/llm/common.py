"""Helpers that every operator of this subpackage shares."""

from __future__ import annotations

import zlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from signalloom.sources.shared import materialise, shared_path  # noqa: F401 (the operators take them from here)

#: A word is a run of characters other than space and the controls 9 to 13, whatever the language.
WORD = r"[^\x20\x09-\x0D]+"
#: Buckets of a distributed running total: each task orders 1/4096 of a key's rows, however hot the key is.
TOTAL_BUCKETS = 4096


#: Small rows that one file of a written table may hold.
ROWS_A_FILE = 500_000


def files_for(rows: int) -> int:
    """Files for a table of at most `rows` small rows: few of them where a shuffle would leave many all but empty ones."""
    return max(1, -(-rows // ROWS_A_FILE))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of text that travel to a Python worker at once, whatever the lengths of the documents.
BATCH_BYTES = 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Hold Arrow batches to BATCH_BYTES, unless the session already asks for less. Spark's own limit is eight times as much."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key).lower()
    if not (now.removesuffix("b").isdigit() and 0 < int(now.removesuffix("b")) <= BATCH_BYTES):
        spark.conf.set(key, str(BATCH_BYTES))


def text_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, text) of documents, null text as empty, ready to be mapped in Arrow batches of bounded size."""
    bounded_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened where a column of `df` has them already: helper columns beside the caller's own."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name)
        out.append(name)
    return out


def text_bytes(column) -> list[bytes]:
    """UTF-8 bytes of an Arrow string column, null as empty."""
    import pyarrow as pa

    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id's decimal text modulo `folds`; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % F.lit(folds)


def fold_of(doc_id: int | None, folds: int) -> int:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % folds


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


#: A key is hot when it holds more than one in so many rows, so there are fewer hot keys than this, whatever the input.
HOT_SHARE = 4000


def hot_keys(rows: DataFrame, key: str) -> DataFrame:
    """The keys that hold more than 1 / HOT_SHARE of the rows, written down: fewer than HOT_SHARE rows, safe to broadcast."""
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
    total = rows.count()
    return materialise(counts.filter(F.col("__n") * HOT_SHARE > total).select(key), "hot")


def join_groups(rows: DataFrame, groups: DataFrame, key: str) -> DataFrame:
    """Inner join of rows with `groups`, one row per key. Rows of hot keys stay where they are and look their few groups up
    in a broadcast of bounded size; only the others are shuffled, and none of their keys holds many rows."""
    hot = hot_keys(rows, key)
    few = groups.join(F.broadcast(hot), key, "left_semi")
    many = rows.join(F.broadcast(hot), key, "left_anti").join(groups, key)
    return rows.join(F.broadcast(few), key).unionByName(many)


def running_total(df: DataFrame, keys: Sequence[str], bucket: str, order: Sequence[str], value: str, out: str) -> DataFrame:
    """Per key, the running total of `value` in the order (bucket, *order), both ends included.

    `bucket` is a long that never decreases along the wanted order. Totals for each (key, bucket) are pre-aggregated and
    their running sum travels as one extra row per bucket in the same shuffle as the data, so a task sorts one bucket only.
    """
    sums = df.groupBy(*keys, bucket).agg(F.sum(value).alias("__sum"))
    before = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    heads = sums.withColumn("__sum", F.coalesce(F.sum("__sum").over(before), F.lit(0)))
    rows = df.withColumn("__head", F.lit(1))
    head_rows = heads.select(
        *[F.col(c) if c in {*keys, bucket} else F.col("__sum").cast(t).alias(c) if c == value else F.lit(None).cast(t).alias(c) for c, t in df.dtypes],
        F.lit(0).alias("__head"),
    )
    within = Window.partitionBy(*keys, bucket).orderBy("__head", *order).rowsBetween(Window.unboundedPreceding, 0)
    total = rows.unionByName(head_rows).withColumn(out, F.sum(value).over(within))
    return total.filter("__head = 1").drop("__head")
