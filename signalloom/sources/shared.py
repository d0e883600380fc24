"""Tables written on the way: in the folder that driver and executors share, so that lost executors cost no recomputation."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The application's folder in the one that driver and executors share. A session in one process (local master) may go without: then it is a folder
    below the warehouse. On a cluster a machine's own folder would lose what others write, so that is refused."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = f"{spark.conf.get('spark.sql.warehouse.dir')}/checkpoints"
    return f"{named.rstrip('/')}/signalloom/{spark.sparkContext.applicationId}"


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Write `df` once to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def scratch_table(spark: SparkSession) -> str:
    """A free name for a catalog table whose files lie in the shared folder: `clear_shared` drops it with them."""
    return f"{_scratch_prefix(spark)}{uuid.uuid4().hex}"


def _scratch_prefix(spark: SparkSession) -> str:
    return "signalloom_" + "".join(c if c.isalnum() else "_" for c in spark.sparkContext.applicationId.lower()) + "_"


def clear_shared(spark: SparkSession) -> None:
    """Remove every table that this application wrote on the way. Call it when no result that reads one is needed any more. Other
    applications' tables, and those at a location that the caller chose, stay."""
    for row in spark.sql(f"SHOW TABLES LIKE '{_scratch_prefix(spark)}*'").collect():
        spark.sql(f"DROP TABLE IF EXISTS `{row['namespace']}`.`{row['tableName']}`")
    at = spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
