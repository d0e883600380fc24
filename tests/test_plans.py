"""What the physical plans must and must not hold."""

import datetime as dt
import re

import pytest

from signalloom import adapters, queries
from signalloom.operators import intervals
from signalloom.operators.asof import asof_backward


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_asof_is_one_shuffle_and_no_join(spark):
    left = spark.createDataFrame([("a", dt.date(2024, 1, 1))], "k string, date date")
    right = spark.createDataFrame([("a", dt.date(2024, 1, 1), 1.0)], "k string, at date, x double")
    text = plan(asof_backward(left, right, ["k"], "date", "at", ["x"]))
    assert len(re.findall(r"Exchange hashpartitioning", text)) == 1 and "Join" not in text


def test_sliding_windows_spread_no_rows_over_days(spark, sf_dir):
    pit = intervals.pit_join(adapters.frame(spark, sf_dir, "sentiment"), intervals.intervals_explicit(adapters.frame(spark, sf_dir, "snapshots")))
    spread = re.findall(r"Generate explode\((\w+)", plan(intervals.sliding_sector(pit)))
    assert set(spread) <= {"array", "sequence"} and "Expand" not in plan(intervals.sliding_sector(pit))


def test_scans_read_only_what_is_used(spark, sf_dir):
    text = adapters.frame(spark, sf_dir, "sections")._jdf.queryExecution().toString()
    schema = text.split("ReadSchema: ")[1].splitlines()[0]
    assert "o_totalprice" not in schema and "o_orderpriority" in schema


@pytest.mark.parametrize("name", sorted(queries.REGISTRY))
def test_no_row_by_row_python_and_no_large_cross_product(spark, sf_dir, name):
    text = plan(queries.queries()[name](spark, sf_dir))
    assert "BatchEvalPython" not in text and "CartesianProduct" not in text


#: Scans and shuffles of the final plan, at most; what is written on the way counts once, as a scan.
MOST = {"bootstrap": (2, 4), "car": (2, 4), "tilt_test": (4, 8), "semantic_entropy": (12, 30), "rebalance": (3, 6)}


@pytest.mark.parametrize("name", MOST)
def test_scans_and_exchanges(spark, sf_dir, name):
    text = plan(queries.queries()[name](spark, sf_dir))
    scans, shuffles = len(re.findall(r"FileScan", text)), len(re.findall(r"Exchange (?:hash|range|Round|Single)", text))
    assert scans <= MOST[name][0] and shuffles <= MOST[name][1], (scans, shuffles)


def test_no_token_carries_the_array_of_its_text(spark, sf_dir):
    text = plan(queries.queries()["lexicon_score"](spark, sf_dir))
    generated = [line for line in text.splitlines() if "Generate" in line]
    assert generated and all("__lem" not in line and "__tok" not in line.split("], ")[-1] for line in generated)
