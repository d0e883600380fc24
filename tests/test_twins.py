"""Every registered query that SQL can express gives exactly its DuckDB twin's rows."""

import datetime
import math

import pytest

from signalloom import queries as base

TWINS = sorted(base.oracle_sql())


def plain(value):
    if isinstance(value, float):
        return "NaN" if math.isnan(value) else round(value, 9) + 0.0
    if isinstance(value, datetime.datetime):
        return value.date() if value.time() == datetime.time() else value
    return value


def rows_of(rows, order):
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.mark.parametrize("name", TWINS)
def test_twin(spark, sf_dir, duck, name):
    df = base.queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    mine = rows_of(df.select(*columns).collect(), range(len(columns)))
    got = duck.execute(base.oracle_sql()[name])
    there = [d[0] for d in got.description]
    assert sorted(there) == columns
    theirs = rows_of(got.fetchall(), [there.index(c) for c in columns])
    assert mine
    assert mine == theirs


@pytest.mark.parametrize("name", sorted(set(base.queries()) - set(TWINS)))
def test_runs_without_twin(spark, sf_dir, name):
    assert base.queries()[name](spark, sf_dir).limit(1).count() == 1


def test_entry(spark, sf_dir):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
