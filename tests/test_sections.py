"""Rolling distinct sections against a loop over every day."""

import calendar
import datetime as dt
import random

import pytest

from signalloom.operators import filings


def months_before(t, months):
    k = t.year * 12 + t.month - 1 - months
    year, month = divmod(k, 12)
    return dt.date(year, month + 1, min(t.day, calendar.monthrange(year, month + 1)[1]))


def facts(seed):
    rng = random.Random(seed)
    ends = [dt.date(2023, 8, 31), dt.date(2023, 8, 30), dt.date(2024, 2, 29), dt.date(2024, 2, 28), dt.date(2023, 9, 30), dt.date(2023, 12, 31)]
    rows = [(rng.randint(1, 3), dt.date(2023, 7, 1) + dt.timedelta(days=rng.randrange(500)), rng.choice("abcd")) for _ in range(40)]
    return rows + [(k % 3 + 1, d, "end") for k, d in enumerate(ends)] + [rows[0], (1, dt.date(2023, 8, 1), None), (4, dt.date(2024, 3, 1), "a")]


def weekdays(first, last):
    days = (first + dt.timedelta(days=i) for i in range((last - first).days + 1))
    return [d for d in days if d.weekday() < 5]


SCHEMA = "id int, date date, section string"


@pytest.mark.parametrize("seed", [1, 2])
def test_months(spark, seed):
    rows = [r for r in facts(seed) if r[2]]
    got = {(r.id, r.date): (r.sections, r.unique_count) for r in filings.rolling_sections_months(spark.createDataFrame(facts(seed), SCHEMA), 6).collect()}
    days = weekdays(min(r[1] for r in rows), max(r[1] for r in rows))
    assert got.keys() == {(i, d) for i in {r[0] for r in rows} for d in days}
    for (i, t), (sections, n) in got.items():
        want = sorted({s for k, d, s in rows if k == i and months_before(t, 6) <= d <= t})
        assert (sections, n) == (want, len(want)), (i, t)


@pytest.mark.parametrize("days", [0, 1, 30, 180])
def test_days(spark, days):
    rows = [r for r in facts(3) if r[2]]
    df = spark.createDataFrame(facts(3), SCHEMA)

    def window(i, t):
        inside = [s for k, d, s in rows if k == i and t - dt.timedelta(days=days) <= d <= t]
        return sorted(set(inside)), len(inside), len(set(inside))

    got = {(r.id, r.date): (r.sections, r.total_count, r.unique_count) for r in filings.rolling_sections_distinct(df, days).collect()}
    assert got == {(i, d): window(i, d) for i, d, _ in rows}
    grid = weekdays(min(r[1] for r in rows), max(r[1] for r in rows))
    got = {(r.id, r.date): (r.sections, r.total_count, r.unique_count) for r in filings.rolling_sections_grid(df, days).collect()}
    assert got == {(i, d): window(i, d) for i in {r[0] for r in rows} for d in grid if window(i, d)[1]}


def test_no_set_stands_in_a_frame(spark):
    df = spark.createDataFrame(facts(1), SCHEMA)
    for out in (filings.rolling_sections_distinct(df), filings.rolling_sections_grid(df), filings.rolling_sections_months(df)):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert not [line for line in plan.split("\n") if "Window" in line and "collect_" in line]
    assert filings.rolling_sections_distinct(df.limit(0)).count() == 0
