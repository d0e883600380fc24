"""Irregularly spaced exponential averages in closed form."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from signalloom.functions.columns import fill_forward, safe_div

#: exp of this and of its negative are far inside the range of doubles.
BLOCK_EXPONENT = 500.0


def irregular_ewma(df: DataFrame, key: str, date: str, value: str, halflife_days: float, out: str, tie: Sequence[str] = ()) -> DataFrame:
    """D-30: e = a v + (1 - a) e', a = 1 - exp(-lambda dt), lambda = ln 2 / half-life, begun with the first value.

    1 - a telescopes, so e_n = exp(-lambda t_n) * sum of c_k v_k exp(lambda t_k) with c_1 = 1 and c_k = 1 - exp(-lambda dt_k):
    a running sum instead of a loop. So that exponents stay below BLOCK_EXPONENT however long the series, days are cut into
    blocks of BLOCK_EXPONENT / lambda, each with its own origin and its own running sum; the sum of the block before comes in
    with weight exp(-BLOCK_EXPONENT), and what lies further back weighs less than that (1e-217) and is left out. Nulls carry
    the last value; a second observation of a day has dt = 0 and weighs nothing.
    """
    rate = math.log(2) / halflife_days
    width = max(1, int(BLOCK_EXPONENT / rate))
    order = [F.col(date), *[F.col(c) for c in tie]]
    by_key = Window.partitionBy(key)
    there = F.col(value).isNotNull()
    t = F.datediff(F.col(date), F.min(F.when(there, F.col(date))).over(by_key))
    rows = df.withColumn("__t", t).withColumn("__b", F.floor(F.col("__t") / F.lit(width)))
    in_order = Window.partitionBy(key).orderBy(*order)
    last = F.last(F.when(there, F.col("__t")), ignorenulls=True).over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    weight = F.when(last.isNull(), F.lit(1.0)).otherwise(1 - F.exp(-rate * (F.col("__t") - last)))
    rows = rows.withColumn("__x", F.when(there, weight * F.col(value) * F.exp(rate * (F.col("__t") - F.col("__b") * width))))
    own = F.sum("__x").over(Window.partitionBy(key, "__b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    before = F.sum("__x").over(Window.partitionBy(key).orderBy("__b").rangeBetween(-1, -1))
    total = own + F.coalesce(before, F.lit(0.0)) * math.exp(-rate * width)
    rows = rows.withColumn("__e", F.when(there, total * F.exp(-rate * (F.col("__t") - F.col("__b") * width))))
    return rows.withColumn(out, fill_forward("__e", in_order)).drop("__t", "__b", "__x", "__e")


def ewma_at(df: DataFrame, key: str, date: str, value: str, halflife_days: float) -> DataFrame:
    """One row per key: the average after its last observation."""
    smooth = irregular_ewma(df, key, date, value, halflife_days, "ewma")
    return smooth.groupBy(key).agg(F.max_by("ewma", date).alias("ewma"), safe_div(F.count(value), F.count(F.lit(1))).alias("observed"))
