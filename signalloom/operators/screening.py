"""Correlation of features and the screening of a feature set: enough information, little redundancy."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from signalloom.functions.columns import correlation, safe_div

#: A variation below this part of the sum of squares is rounding: the feature counts as constant.
CONSTANT = 1e-13
MOMENTS = ("n", "sx", "sy", "sxx", "syy", "sxy")


def _pair_moments(shift: np.ndarray):
    """Sums over the rows of a task where both features of a pair are there, for all pairs at once."""
    size = len(shift)
    i, j = np.triu_indices(size, 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(MOMENTS), size, size))
        for batch in batches:
            x = np.stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns], axis=1) - shift
            there = np.isfinite(x)
            x, m = np.where(there, x, 0.0), there.astype(float)
            sums, squares = x.T @ m, (x * x).T @ m
            total += np.stack([m.T @ m, sums, sums.T, squares, squares.T, x.T @ x])
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), *(pa.array(total[k][i, j]) for k in range(len(MOMENTS)))], names=["i", "j", *MOMENTS])

    return run


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """feature, other, n, correlation of every pair of columns (feature before other by name) over the rows where both are
    numbers; null, NaN and infinite count as missing. Null where a feature is constant over those rows.

    One pass over the rows: each task adds up matrices of the moments of all pairs, and only these meet. A pass before it
    finds the means, around which the moments are taken so that large levels do not swamp the variation."""
    columns = sorted(columns)
    numbers = df.select(*[F.col(f"`{c}`").cast("double").alias(f"c{k}") for k, c in enumerate(columns)])
    finite = lambda c: F.when(~F.isnan(c) & (F.abs(c) < float("inf")), F.col(c))
    shift = np.asarray([x or 0.0 for x in numbers.agg(*[F.avg(finite(c)) for c in numbers.columns]).first()])
    schema = "i int, j int, " + ", ".join(f"{m} double" for m in MOMENTS)
    pairs = numbers.mapInArrow(_pair_moments(shift), schema).groupBy("i", "j").agg(*[F.sum(m).alias(m) for m in MOMENTS])
    names, level = F.array(*map(F.lit, columns)), F.array(*[F.lit(float(x * x)) for x in shift])

    def variation(s: str, ss: str, at: str):
        own = F.col(ss) - safe_div(F.col(s) * F.col(s), F.col("n"))
        return F.when(own > CONSTANT * (F.col(ss) + CONSTANT * F.col("n") * level[F.col(at)]), own)

    together = F.col("sxy") - safe_div(F.col("sx") * F.col("sy"), F.col("n"))
    rho = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), together / F.sqrt(variation("sx", "sxx", "i") * variation("sy", "syy", "j"))))
    known = variation("sx", "sxx", "i").isNotNull() & variation("sy", "syy", "j").isNotNull()
    return pairs.select(names[F.col("i")].alias("feature"), names[F.col("j")].alias("other"), F.col("n").cast("long").alias("n"), F.when(known, rho).alias("correlation"))


def information_coefficients(df: DataFrame, columns: Sequence[str], target: str, period: str) -> DataFrame:
    """feature, ic, n_periods: the mean over periods of the rank correlation between feature and target among the period's rows
    where both are there. Periods in which one of them is constant have none."""
    stacked = df.filter(F.col(target).isNotNull()).select(
        F.col(period).alias("__p"), F.col(target).alias("__y"), F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"`{c}`").cast("double").alias("x")) for c in columns])).alias("__f")
    )
    rows = stacked.select("__p", "__y", "__f.feature", "__f.x").filter("x is not null and not isnan(x)")
    rank = lambda c: F.rank().over(Window.partitionBy("__p", "feature").orderBy(c)) + (F.count(F.lit(1)).over(Window.partitionBy("__p", "feature", c)) - 1) / 2
    ranked = rows.withColumns({"__rx": rank("x"), "__ry": rank("__y")})
    each = ranked.groupBy("__p", "feature").agg(correlation(F.col("__rx"), F.col("__ry")).alias("ic"))
    return each.groupBy("feature").agg(F.avg("ic").alias("ic"), F.count("ic").alias("n_periods"))


def select_features(ics: DataFrame, pairs: DataFrame, min_ic: float = 0.02, max_correlation: float = 0.80) -> DataFrame:
    """feature, ic, n_periods, informative, kept: features whose |ic| exceeds `min_ic`, taken by falling |ic| (ties by name), a
    feature being left out when one kept before it correlates with it by `max_correlation` or more.

    The choice is a fold over one row whose length is the number of features; features are columns, so it is small."""
    close = pairs.filter(F.abs("correlation") >= max_correlation)
    arcs = close.select("feature", "other").unionByName(close.select(F.col("other").alias("feature"), F.col("feature").alias("other")))
    partners = arcs.groupBy("feature").agg(F.collect_list("other").alias("partners"))
    rows = ics.join(partners, "feature", "left").withColumn("informative", F.coalesce(F.abs("ic") > min_ic, F.lit(False)))
    entry = F.struct((-F.abs("ic")).alias("order"), "feature", F.coalesce("partners", F.array().cast("array<string>")).alias("partners"))
    queue = rows.filter("informative").agg(F.array_sort(F.collect_list(entry)).alias("queue"))
    chosen = queue.select(F.aggregate("queue", F.array().cast("array<string>"), lambda kept, x: F.when(F.arrays_overlap(kept, x["partners"]), kept).otherwise(F.array_append(kept, x["feature"]))).alias("chosen"))
    return rows.crossJoin(F.broadcast(chosen)).select("feature", "ic", "n_periods", "informative", F.array_contains("chosen", F.col("feature")).alias("kept"))


def screen_features(df: DataFrame, columns: Sequence[str], target: str, period: str, min_ic: float = 0.02, max_correlation: float = 0.80) -> DataFrame:
    """The features worth keeping: see `select_features`."""
    return select_features(information_coefficients(df, columns, target, period), correlation_matrix(df, columns), min_ic, max_correlation)
