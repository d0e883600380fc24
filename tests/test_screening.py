"""Correlation matrix and feature screening against numpy and a plain greedy loop."""

import math

import numpy as np
from pyspark.sql import functions as F

from signalloom.operators import screening


def panel(spark, seed=0, n=400):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 6))
    x[:, 1] = x[:, 0] * 0.95 + x[:, 1] * 0.1
    x[:, 2] = np.round(x[:, 2])  # many ties
    x[:, 3] = 1e9 + x[:, 3] * 1e-3  # a large level, little variation
    x[:, 4] = 7.25
    y = x[:, 0] + x[:, 2] + rng.normal(size=n)
    rows = []
    for k in range(n):
        own = [None if rng.random() < 0.1 else float(v) for v in x[k]]
        if k % 50 == 3:
            own[0], own[5] = math.nan, math.inf
        rows.append((k % 7, None if k % 11 == 0 else float(y[k]), *own))
    return rows, spark.createDataFrame(rows, "period int, y double, a double, b double, `c d` double, e double, f double, g double").repartition(5)


NAMES = ["a", "b", "c d", "e", "f", "g"]


def numbers(rows, k):
    return np.asarray([math.nan if r[k + 2] is None or math.isinf(r[k + 2]) else r[k + 2] for r in rows])


def test_matrix_is_pairwise_complete(spark):
    rows, df = panel(spark)
    got = {(r.feature, r.other): r for r in screening.correlation_matrix(df, NAMES).collect()}
    assert len(got) == 15
    for i in range(6):
        for j in range(i + 1, 6):
            a, b = numbers(rows, i), numbers(rows, j)
            both = ~np.isnan(a) & ~np.isnan(b)
            r = got[NAMES[i], NAMES[j]]
            assert r.n == both.sum()
            if 4 in (i, j):
                assert r.correlation is None
            else:
                assert abs(r.correlation - np.corrcoef(a[both], b[both])[0, 1]) < 1e-5


def test_matrix_of_few_rows(spark):
    _, df = panel(spark)
    empty = screening.correlation_matrix(df.limit(0), NAMES).collect()
    assert all(r.n == 0 and r.correlation is None for r in empty)
    one = screening.correlation_matrix(df.filter("a is not null").limit(1), ["a", "b"]).collect()
    assert [r.correlation for r in one] == [None]


def average_ranks(v):
    return np.asarray([(v < x).sum() + ((v == x).sum() + 1) / 2 for x in v])


def test_screening_is_the_greedy_choice(spark):
    rows, df = panel(spark, 1)
    got = {r.feature: r for r in screening.screen_features(df, NAMES, "y", "period", 0.02, 0.80).collect()}
    ics = {}
    for k, name in enumerate(NAMES):
        per = []
        for p in range(7):
            own = [(r[k + 2], r[1]) for r in rows if r[0] == p and r[1] is not None and r[k + 2] is not None and not math.isnan(r[k + 2])]
            x, y = (average_ranks(np.asarray(v)) for v in zip(*own, strict=True))
            if x.min() < x.max() and y.min() < y.max():
                per.append(np.corrcoef(x, y)[0, 1])
        ics[name] = np.mean(per) if per else None
        assert got[name].n_periods == len(per)
        assert got[name].ic is None if ics[name] is None else abs(got[name].ic - ics[name]) < 1e-9
    matrix = {frozenset((r.feature, r.other)): r.correlation for r in screening.correlation_matrix(df, NAMES).collect()}
    kept = []
    for name in sorted((n for n in NAMES if ics[n] is not None and abs(ics[n]) > 0.02), key=lambda n: (-abs(ics[n]), n)):
        if all((matrix[frozenset((name, k))] or 0) < 0.8 and (matrix[frozenset((name, k))] or 0) > -0.8 for k in kept):
            kept.append(name)
    assert {n for n in NAMES if got[n].kept} == set(kept)
    assert "a" in kept and "b" not in kept and not got["f"].informative


def test_equal_features_keep_the_first_name(spark):
    _, df = panel(spark, 2)
    twins = df.select("period", "y", F.col("a").alias("z"), F.col("a").alias("k"))
    got = {r.feature: r.kept for r in screening.screen_features(twins, ["z", "k"], "y", "period").collect()}
    assert got == {"k": True, "z": False}
