"""Reading and writing frames. Everything stays lazy; nothing is collected."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def read_parquet(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "overwrite") -> None:
    df.write.mode(mode).partitionBy(*partition_by).parquet(path) if partition_by else df.write.mode(mode).parquet(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str, header: bool = True) -> DataFrame:
    """The schema is given, so the files are read once."""
    return spark.read.csv(path, schema=schema, header=header)


#: Bytes of input files for each partition of a deal.
PART_BYTES = 1 << 20


def partitions_for(df: DataFrame) -> int:
    """Partitions among which to deal what is drawn from `df`, so that one is as large whatever the input: by the bytes of the files that
    it reads, and no fewer than the cores. Adaptive execution leaves a number that is asked for as it is."""
    spark = df.sparkSession
    hadoop, path = spark._jsc.hadoopConfiguration(), spark._jvm.org.apache.hadoop.fs.Path
    files = set(df.inputFiles())
    total = 0
    for folder in {f.rpartition("/")[0] for f in files}:
        at = path(spark._jvm.java.net.URI(folder))
        total += sum(x.getLen() for x in at.getFileSystem(hadoop).listStatus(at) if x.getPath().toUri().toString().rpartition("/")[2] in {f.rpartition("/")[2] for f in files if f.rpartition("/")[0] == folder})
    return max(spark.sparkContext.defaultParallelism, -(-total // PART_BYTES))


def write_csv(df: DataFrame, path: str, header: bool = True, mode: str = "overwrite") -> None:
    df.write.mode(mode).csv(path, header=header)


def from_columns(spark: SparkSession, columns: dict[str, Sequence], schema: T.StructType | str | None = None) -> DataFrame:
    """A small frame from a dict of equally long columns."""
    rows = list(zip(*columns.values(), strict=True))
    return spark.createDataFrame(rows, schema or list(columns))


def from_rows(spark: SparkSession, rows: Sequence[dict], schema: T.StructType | str) -> DataFrame:
    """A small frame from row dicts; the schema is explicit, so empty input and all-null columns keep their types."""
    return spark.createDataFrame(list(rows), schema)


def content_key(df: DataFrame, *parts: str) -> str:
    """A name for what `df` computes: its schema, its canonical plan (in which names of expressions and their order do not
    count), and path, length and time of change of every file that it reads; `parts` are the caller's own. A plan with Python functions is
    known by those very function objects, so it is a new one in each session."""
    spark = df.sparkSession
    said = hashlib.sha256("\x00".join([str(df.semanticHash()), df.schema.json(), *parts]).encode())
    hadoop, path = spark._jsc.hadoopConfiguration(), spark._jvm.org.apache.hadoop.fs.Path
    files = sorted(df.inputFiles())
    for folder in sorted({f.rpartition("/")[0] for f in files}):
        at = path(spark._jvm.java.net.URI(folder))
        for found in sorted(f"{x.getPath()} {x.getLen()} {x.getModificationTime()}" for x in at.getFileSystem(hadoop).listStatus(at) if x.isFile()):
            said.update(found.encode())
    for f in files:  # which of a folder's files are read
        said.update(f.encode())
    return said.hexdigest()[:32]


def cache_result(df: DataFrame, path: str, key: str = "") -> DataFrame:
    """Result cache: computed and written once below `path`, then read while plan and input files stay what they were. A changed
    file, parameter or `key` computes anew; what is no longer asked for stays until `clear_cache`."""
    spark = df.sparkSession
    target = f"{path.rstrip('/')}/{content_key(df, key)}"
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(f"{target}/_SUCCESS")
    if not jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path):
        df.write.mode("overwrite").parquet(target)
    return spark.read.schema(df.schema).parquet(target)


def cache_info(spark: SparkSession, path: str) -> dict[str, float]:
    """Megabytes and number of files below a cache folder, by the file system of the path."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return {"size_mb": 0.0, "files": 0}
    summary = fs.getContentSummary(at)
    return {"size_mb": summary.getLength() / 1e6, "files": int(summary.getFileCount())}


def clear_cache(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def describe(df: DataFrame) -> DataFrame:
    """count, mean, stddev, min, quartiles and max of every column, as strings."""
    return df.summary()
