"""Streams with keyed state answer as the batch operators do, whatever the order of rows, and go on after a restart."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from signalloom.operators import filings
from signalloom.operators.ewma import irregular_ewma
from signalloom.streaming import stateful

FAR = dt.date(2040, 1, 1)  # a row that moves the watermark past everything else


def day(n):
    return dt.date(2020, 1, 1) + dt.timedelta(days=n)


def run(spark, base, build, schema):
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    query = build(stream).writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{base}/out")


def feed(spark, rows, schema, base, pieces):
    """The rows as files of their own, one for each micro-batch."""
    for k in range(pieces):
        spark.createDataFrame(rows[k::pieces], schema).coalesce(1).write.mode("append").parquet(f"{base}/in")


FILINGS = "qid long, date date, document_id string, length double"


def some_filings(seed):
    rng = random.Random(seed)
    rows = [(q, day(rng.randrange(700)), f"d{k}", float(rng.randrange(4)) if rng.random() < 0.9 else None) for q in (1, 2, None) for k in range(12)]
    return rows + [rows[0], (1, None, "no date", 1.0)]


def changes(df):
    return sorted(map(str, df.filter("qid is null or qid < 90").select("qid", "date", "signal", "n_filings_in_window").collect()))


def test_filing_changes_over_shuffled_batches_and_a_restart(spark, tmp_path):
    rows = some_filings(1)
    random.Random(2).shuffle(rows)
    base = str(tmp_path)
    build = lambda s: stateful.stream_filing_delta(s, 180, "800 days")
    feed(spark, rows[:20], FILINGS, base, 3)
    run(spark, base, build, spark.createDataFrame([], FILINGS).schema)
    feed(spark, [*rows[20:]], FILINGS, base, 2)  # the stream was stopped and goes on from its checkpoint
    run(spark, base, build, spark.createDataFrame([], FILINGS).schema)
    feed(spark, [(99, FAR, "z", 1.0)], FILINGS, base, 1)
    got = run(spark, base, build, spark.createDataFrame([], FILINGS).schema)
    want = filings.filing_delta_closed(spark.createDataFrame(rows, FILINGS).filter("date is not null"), 180)
    assert changes(got) == changes(want) and len(changes(want)) > 20


def test_late_filings_are_dropped(spark, tmp_path):
    base = str(tmp_path)
    build = lambda s: stateful.stream_filing_delta(s, 180, "10 days")
    first, late, last = [(1, day(0), "a", 1.0), (1, day(100), "b", 3.0)], [(1, day(50), "late", 9.0), (1, day(95), "in time", 2.0)], [(99, FAR, "z", 1.0)]
    for rows in (first, late, last):
        feed(spark, rows, FILINGS, base, 1)
        got = run(spark, base, build, spark.createDataFrame([], FILINGS).schema)
    want = filings.filing_delta_closed(spark.createDataFrame([*first, late[1]], FILINGS), 180)
    assert changes(got) == changes(want)


@pytest.mark.parametrize("pieces", [1, 4])
def test_irregular_average_over_shuffled_batches(spark, tmp_path, pieces):
    rng = random.Random(pieces)
    rows = [(k, day(rng.randrange(400)), rng.choice([None, rng.gauss(0, 1)])) for k in ("a", "b") for _ in range(60)]
    schema = "name string, date date, value double"
    rng.shuffle(rows)
    feed(spark, [*rows, ("far", FAR, 1.0)] if pieces == 1 else rows, schema, str(tmp_path), pieces)
    build = lambda s: stateful.stream_irregular_ewma(s, "name", "date", "value", 5, "ewma", "500 days")
    got = run(spark, str(tmp_path), build, spark.createDataFrame([], schema).schema)
    if pieces > 1:
        feed(spark, [("far", FAR, 1.0)], schema, str(tmp_path), 1)
        got = run(spark, str(tmp_path), build, spark.createDataFrame([], schema).schema)
    want = irregular_ewma(spark.createDataFrame(rows, schema), "name", "date", "value", 5, "ewma", tie=["value"])
    key = lambda df: sorted((r.name, r.date, r.value is not None, round(r.value or 0, 9), None if r.ewma is None else round(r.ewma, 9)) for r in df.filter(F.col("name") != "far").select("name", "date", "value", "ewma").collect())
    assert str(key(got)) == str(key(want)) and got.filter("name = 'far'").count() == 0
