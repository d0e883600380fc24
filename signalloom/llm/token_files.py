"""Token files: Parquet with one row per document, its ids as a list column.

Layout. Rows are range-partitioned and sorted by doc_id, so file statistics, row-group statistics and page indexes all prune
by doc_id. Ids are dictionary encoded (a vocabulary fits one dictionary page); doc_id, offset and n_tokens are sorted or
smooth longs, which the version 2 writer delta-encodes. Row groups and pages have set sizes, so that a reader of a few
documents decodes a few pages, and a reader of metadata never touches the ids.

`offset` counts the ids of earlier documents in the same file part; the position in the whole corpus adds the totals of
earlier parts, of which there is one number per file.

Cases: very long texts are one row with all their ids; a null text is empty and has the end id only; a null doc_id sorts first; rows that repeat an id are ordered by text
and all kept; an empty table gives files without rows; columns besides doc_id and text are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from signalloom.llm.common import shared_path, text_rows
from signalloom.llm.tokenise import encoder, tokenizer_path, with_end

VOCABULARY = "word_bpe_49k.json"
END_ID = 2
SCHEMA = "doc_id long, part int, offset long, n_tokens long, tokens array<int>"
WRITER = {
    "compression": "zstd",
    "parquet.writer.version": "PARQUET_2_0",
    "parquet.enable.dictionary": "true",
    "parquet.dictionary.page.size": str(1 << 20),
    "parquet.block.size": str(32 << 20),
    "parquet.page.size": str(128 << 10),
    "parquet.page.row.count.limit": "1000",
    "parquet.columnindex.truncate.length": "64",
}


def _encode(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, offset, encode = TaskContext.get().partitionId(), 0, encoder(path).encode
        for batch in batches:
            for first, ids, counts in encode(batch.column(1)):
                ids, at = with_end(ids, counts, end_id)
                n = len(counts)
                lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids.view(np.int32)))
                columns = [batch.column(0).slice(first, n), pa.array(np.full(n, part, np.int32)), pa.array(offset + at[:-1]), pa.array(np.diff(at)), lists]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "part", "offset", "n_tokens", "tokens"])
                offset += int(at[-1])

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = END_ID) -> None:
    """Tokenise whole texts and write the token files to `path`."""
    rows = text_rows(docs)
    rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    rows.mapInArrow(_encode(tokenizer or tokenizer_path(VOCABULARY), end_id), SCHEMA).write.options(**WRITER).parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The files' rows; select fewer columns or filter by doc_id to read less."""
    return spark.read.schema(SCHEMA).parquet(path)


def with_start(spark: SparkSession, path: str) -> DataFrame:
    """The files' rows with `start`, the ids of all earlier documents. Reads two metadata columns to place the parts,
    of which there is one row per file: what is broadcast is bounded by the number of write tasks."""
    rows = read_tokens(spark, path)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy("part").agg(F.sum("n_tokens").alias("__n"))
    parts = parts.select("part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    return rows.join(F.broadcast(parts), "part").withColumn("start", F.col("offset") + F.col("__before")).drop("__before")


def _checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(3)
        values = lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
        at = lists.offsets.to_numpy()
        crc = [zlib.crc32(values[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def token_digest(docs: DataFrame, path: str | None = None, tokenizer: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Write the token files, read them back: doc_id, start, n_tokens, ids_crc32 of every document."""
    spark = docs.sparkSession
    path = path or shared_path(spark, "tokens")
    write_tokens(docs, path, tokenizer, end_id)
    rows = with_start(spark, path).select("doc_id", "start", "n_tokens", "tokens")
    return rows.mapInArrow(_checksums, "doc_id long, start long, n_tokens long, ids_crc32 long")
