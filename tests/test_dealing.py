"""Rows are dealt among as many partitions as the input's bytes ask for, and what is made of them stays where it was dealt."""

from signalloom import queries
from signalloom.sources import io


def plan(spark, sf_dir, name):
    return queries.queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()


def test_partitions_grow_with_the_files_read(spark, tmp_path, monkeypatch):
    spark.range(100000).repartition(5).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    size = sum(f.stat().st_size for f in (tmp_path / "t").glob("*.parquet"))
    assert io.partitions_for(df) == io.partitions_for(spark.range(3)) == spark.sparkContext.defaultParallelism
    monkeypatch.setattr(io, "PART_BYTES", 1000)
    assert io.partitions_for(df.filter("id > 3")) == -(-size // 1000)


def test_rows_of_funds_are_not_shuffled(spark, sf_dir):
    shown = plan(spark, sf_dir, "etf_sentiment")
    below = shown.split("REPARTITION_BY_NUM")[0]
    assert below.count("Exchange hashpartitioning") == 1 and "hashpartitioning(document_id" in below
