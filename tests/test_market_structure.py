"""Dispersion, divergence, breadth and precision on small panels with known answers."""

import datetime as dt

import pytest

from signalloom.operators import filings, market_structure

A, B = dt.date(2024, 1, 1), dt.date(2024, 1, 11)


@pytest.fixture(scope="module")
def panel(spark):
    rows = [("x", 1, A, 1.0), ("x", 2, A, 3.0), ("y", 3, A, -1.0), ("y", 4, A, 1.0), ("z", 5, A, 0.0), ("z", 6, A, None), ("x", 1, B, 4.0), ("y", 3, B, None)]
    return spark.createDataFrame(rows, "sector string, qid int, date date, value double")


def test_dispersion(panel):
    got = {r.date: r for r in market_structure.dispersion_structure(panel).collect()}
    assert got[A].within == pytest.approx(2**0.5) and got[A].cross == pytest.approx(((2 - 2 / 3) ** 2 / 2 + (2 / 3) ** 2) ** 0.5) and got[A].n_sectors == 3
    assert (got[B].within, got[B].cross, got[B].ratio, got[B].n_sectors) == (None, None, None, 1)


def test_divergence(panel):
    got = {(r.sector, r.date): r for r in market_structure.momentum_divergence(panel, 30).collect()}
    assert got["x", A].momentum is None and got["x", B].momentum == 2.0
    assert got["x", B].index_momentum == pytest.approx(4 - 0.8) and got["x", B].divergence == pytest.approx(-1.2)
    assert market_structure.momentum_divergence(panel, 5).filter("momentum is not null").count() == 0


def test_breadth(panel):
    got = {r.date: r for r in market_structure.breadth_weighted_index(panel).collect()}
    assert got[A].index_signal == pytest.approx(2 * 1.0 + 0 * 0.5) and got[A].normalised == pytest.approx(2 / 1.5)


def test_precision(spark):
    rows = [("x", A, "1,000.5 of 20 things"), ("x", A, None), ("y", A, "none 3"), ("z", A, ""), ("w", A, "a 1")]
    got = {r.sector: r for r in market_structure.precision_ranking(spark.createDataFrame(rows, "sector string, date date, t string"), "t").collect()}
    assert [(got[s].n_numbers, got[s].n_words, got[s].precision_rank) for s in "xywz"] == [(2, 4, 2.0), (1, 2, 2.0), (1, 2, 2.0), (0, 0, None)]


def test_delay_against_earlier_days(spark):
    rows = [(1, dt.date(2024, 1, 5), dt.date(2024, 1, 1)), (1, dt.date(2024, 1, 5), dt.date(2023, 12, 28)), (1, dt.date(2024, 4, 7), dt.date(2024, 4, 1)), (2, dt.date(2024, 1, 1), None)]
    got = [(r.delay, r.relative_delay) for r in filings.filing_delay(spark.createDataFrame(rows, "qid int, date date, period_end date")).orderBy("qid", "date", "delay").collect()]
    assert got == [(4, None), (8, None), (6, 1.0), (None, None)]
