"""Interval join, sliding order statistics, pattern densities and the bootstrap against plain loops."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from signalloom.functions.order_statistics import BASE, rolling_quantile
from signalloom.operators import calendars, event_study, intervals, pattern_density, semantic, signals

DAY0 = dt.date(2020, 1, 1)


def after(n):
    return None if n is None else DAY0 + dt.timedelta(days=n)


@pytest.mark.parametrize("bin_days", [1, 7, 400])
def test_overlap_join_equals_the_plain_loop(spark, bin_days):
    rng = random.Random(bin_days)
    span = lambda: (lambda a: (a, a + rng.randint(-3, 60)))(rng.randrange(500))
    left = [(k, rng.choice([1, 2, None]), *span()) for k in range(120)] + [(900, 1, None, 5), (901, 1, 5, None), (902, 2, -4000, 9000)]
    right = [(k, rng.choice([1, 2, None]), *span()) for k in range(120)] + [(900, 1, None, 5), (901, 2, 10, 40_000)]
    frame = lambda rows, n: spark.createDataFrame([(i, k, after(a), after(b)) for i, k, a, b in rows], f"{n} int, key int, {n}a date, {n}b date")
    got = intervals.overlap_join(frame(left, "x"), frame(right, "y"), ["key"], ("xa", "xb"), ("ya", "yb"), bin_days)
    want = [(i, j) for i, k, a, b in left for j, m, c, d in right if None not in (a, b, c, d, k) and k == m and a <= b and c <= d and a <= d and c <= b]
    assert sorted((r.x, r.y) for r in got.select("x", "y").collect()) == sorted(want)
    assert intervals.overlap_join(frame(left, "x").limit(0), frame(right, "y"), ["key"], ("xa", "xb"), ("ya", "yb")).count() == 0


def test_pit_join_looks_at_few_pairs(spark, sf_dir):
    from signalloom import adapters

    held = intervals.intervals_explicit(adapters.frame(spark, sf_dir, "snapshots")).select("sectorId", F.col("qid").alias("id"), "startDate", "endDate", "weight")
    seen = adapters.frame(spark, sf_dir, "sentiment")
    found = intervals.pit_join(seen, intervals.intervals_explicit(adapters.frame(spark, sf_dir, "snapshots"))).count()
    looked_at = intervals.binned_pairs(seen, held, ["id"], ("date", "date"), ("startDate", "endDate"), 30).count()
    assert found <= looked_at <= 2 * found


@pytest.mark.parametrize(("n", "q", "days"), [(1, 0.5, 3), (15, 0.5, 30), (BASE + 1, 0.25, 400), (300, 0.9, 20), (300, 0.0, 50)])
def test_rolling_quantile_equals_sorting(spark, n, q, days):
    rng = random.Random(n)
    rows = [(k % 3 if k % 7 else None, after(rng.randrange(120)), rng.choice([None, math.nan, *(x / 2 for x in range(40))]), k) for k in range(3 * n)]
    df = spark.createDataFrame(rows, "key int, date date, value double, row int").repartition(4)
    got = {r.row: r.at for r in rolling_quantile(df, ["key"], "date", "value", days, q, "at").collect()}
    assert len(got) == len(rows)
    for key, date, _, row in rows:
        own = sorted(v for k, d, v, _ in rows if k == key and v is not None and not math.isnan(v) and date - dt.timedelta(days=days) < d <= date)
        assert got[row] == (own[math.floor((len(own) - 1) * q + 0.5)] if own else None)


def test_rolling_quantile_holds_no_window(spark):
    df = spark.createDataFrame([(1, DAY0, 2.0)], "qid int, date date, value double")
    plan = signals.longterm_percentile(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "collect_set" not in plan


def test_pattern_counts_equal_plain_counting(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("aab b\né") for _ in range(rng.randint(0, 80))) for _ in range(200)] + [None, "", " \n", "aaaa", "x" * 50_000 + "ab" * 30_000]
    groups = {"one": ["a", "aa", "ab"], "two": ["aba", "b b", "é", "aa"], "none": []}
    df = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)], "id int, text string, n_words string").drop("n_words")
    got = {r.id: r for r in pattern_density.pattern_density(df, "text", groups, ["id"]).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        if t is None:
            assert (r.one_count, r.two_count, r.none_count, r.n_words, r.one_density) == (None,) * 5
            continue
        want = {g: sum(t.count(p) for p in ps) for g, ps in groups.items()}
        assert (r.one_count, r.two_count, r.none_count) == (want["one"], want["two"], 0)
        words = len(t.split())
        assert r.n_words == words and r.one_density == (want["one"] / words if words else None)


def test_whole_words_only():
    machine = pattern_density.automaton({"g": ["will", "may be"]})
    assert pattern_density.count_patterns(machine, "will willing will. may be, may bee", 2, whole_words=True) == [2, 1]
    with pytest.raises(ValueError, match="empty"):
        pattern_density.automaton({"g": [""]})


def test_history_ratio_and_orientation(spark):
    rows = [("A", after(0), 0.2, 4, 2), ("A", after(100), 0.4, 3, 0), ("A", after(900), 0.8, 1, 4), ("A", after(2000), 0.1, 0, 1), ("B", after(5), 0.3, 1, 1)]
    df = spark.createDataFrame(rows, "e string, date date, d double, future long, past long")
    got = {(r.e, r.date): r.ratio for r in pattern_density.against_history(df, "e", "date", "d", "ratio").collect()}
    assert got == {("A", after(0)): None, ("A", after(100)): 2.0, ("A", after(900)): None, ("A", after(2000)): None, ("B", after(5)): None} | {("A", after(900)): None}
    assert {r.orientation for r in pattern_density.temporal_orientation(df, "future", "past").collect()} == {2.0, None, 0.25, 0.0, 1.0}


def legs(spark, parts):
    rng = np.random.default_rng(5)
    rows = [("Q5", float(x), f"h{k}") for k, x in enumerate(rng.normal(1, 1, 300))] + [("Q1", float(x), f"l{k}") for k, x in enumerate(rng.normal(0, 1, 120))]
    return rows, spark.createDataFrame(rows, "quantile string, x double, event string").repartition(parts)


def test_places_are_a_numbering(spark):
    _, df = legs(spark, 5)
    got = event_study.numbered_events(df).collect()
    for leg, n in (("Q5", 300), ("Q1", 120)):
        assert sorted(r.place for r in got if r.quantile == leg) == list(range(1, n + 1)) and {r.size for r in got if r.quantile == leg} == {n}


def test_every_draw_has_the_size_of_its_leg(spark):
    rows, df = legs(spark, 3)
    got = event_study.resampled(df, 200).collect()
    assert len(got) == 400 and all(r.n == (300 if r.quantile == "Q5" else 120) for r in got)
    other = {(r.quantile, r.draw): r["mean"] for r in event_study.resampled(legs(spark, 11)[1], 200).collect()}
    assert all(abs(other[r.quantile, r.draw] - r["mean"]) < 1e-12 for r in got)
    # the draws scatter as means of n independent draws do
    for leg in ("Q5", "Q1"):
        x = np.asarray([v for q, v, _ in rows if q == leg])
        means = np.asarray([r["mean"] for r in got if r.quantile == leg])
        assert abs(means.mean() - x.mean()) < 4 * x.std() / math.sqrt(len(x) * 200)
        assert 0.8 < means.std() / (x.std() / math.sqrt(len(x))) < 1.2


@pytest.mark.parametrize("part", [1, 3, 7])
def test_components_by_parts_equal_those_of_one_task(spark, part, monkeypatch):
    rng = random.Random(9)
    words = ["alpha", "été", "gamma", "delta9", "omega", "zeta", "kappa", "übung", "x_y"]
    rows = [(f"q{rng.randint(0, 40)}", after(rng.randint(0, 30)), " ".join(rng.choice(words[: 2 + k % 8]) for _ in range(5))) for k in range(160)]
    rows += [("alone", after(200), "alpha beta"), ("two", after(400), "same words"), ("three", after(400), "other text"), ("empty", after(5), "")]
    sentences = spark.createDataFrame(rows, "qid string, date date, sentence string")
    dates = calendars.daily_calendar(sentences).filter("date <= '2020-01-20' or date = '2020-07-19' or date = '2021-02-04'")
    run = lambda **more: {(r.date, r.qid): r for r in semantic.rolling_components(sentences, dates, max_features=15, lookback_days=20, **more).collect()}
    monkeypatch.setattr(semantic, "PART_SUMS", 4)
    whole, parts = run(), run(part_entities=part)
    assert whole.keys() == parts.keys() and {r.status for r in whole.values()} == {"success", "insufficient_data", "pca_failed"}
    for at, r in whole.items():
        o = parts[at]
        assert (r.status, r.n_qids) == (o.status, o.n_qids)
        for a, b in ((r.pc_1, o.pc_1), (r.pc_2, o.pc_2)):
            assert (a is None) == (b is None) and (a is None or abs(a - b) < 1e-7), (at, r, o)


def test_words_are_letters_digits_and_underscores_of_any_script(spark):
    df = spark.createDataFrame([(1, "Élan 3D x a1_b, über-Maß; 日本 the")], "k int, t string")
    got = {r.term for r in semantic.terms(df, "t", ["k"]).collect()}
    assert {"élan", "3d", "a1_b", "über", "maß", "日本", "élan 3d"} <= got and "x" not in got and "the" not in got
