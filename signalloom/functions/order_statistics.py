"""Order statistics of sliding windows, by running counts over value ranks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from signalloom.functions.columns import day

#: Ranks are found digit by digit in this base.
BASE = 16


def rolling_quantile(df: DataFrame, keys: Sequence[str], date: str, value: str, days: int, q: float, out: str) -> DataFrame:
    """`df` with the q-quantile (nearest: the value at floor((n - 1) q + 0.5)) of the values of (t - days, t], null without any.

    Values get ranks within their key. The wanted rank is found from its highest digit down: a value that enters the window
    counts +1 on its day and -1 `days` later, so that a running sum over these moves gives, for each digit, how many values
    of the window begin with the digits found so far and this one. A row never holds its window; a pass is linear in the
    rows, and there are as many passes as the largest key's number of rows has digits (which a first aggregation finds)."""
    names = {c.lower() for c in df.columns}
    own, rank, left, prefix, digit, move, when = (next(n for n in (f"__{x}" + "_" * k for k in range(99)) if n not in names) for x in ("own", "rank", "left", "prefix", "digit", "move", "when"))
    there = F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))
    # rows of one value and day change places without effect
    by_value = Window.partitionBy(*keys).orderBy(F.col(value), F.col(date))
    facts = df.filter(there).select(*keys, day(date).alias(when), F.col(value).alias("__value"), (F.row_number().over(by_value) - 1).cast("long").alias(rank))
    size = df.filter(there).groupBy(*keys).count().agg(F.max("count")).first()[0] or 1
    passes = 1
    while BASE**passes < size:
        passes += 1
    moves = facts.select(*keys, rank, F.explode(F.array(F.struct(F.col(when).alias(when), F.lit(1).alias(move)), F.struct((F.col(when) + days).alias(when), F.lit(-1).alias(move)))).alias("__m"))
    moves = moves.select(*keys, rank, f"__m.{when}", f"__m.{move}")
    asked = df.select(*keys, F.struct(*df.columns).alias(own), day(date).alias(when), F.lit(0).cast("long").alias(prefix), F.lit(None).cast("long").alias(left))
    for k in range(passes):
        below = BASE ** (passes - 1 - k)
        entered = moves.select(*keys, when, F.floor(F.col(rank) / (below * BASE)).cast("long").alias(prefix), (F.floor(F.col(rank) / below) % BASE).cast("int").alias(digit), move)
        both = entered.unionByName(asked, allowMissingColumns=True)
        so_far = Window.partitionBy(*keys, prefix).orderBy(when).rangeBetween(Window.unboundedPreceding, 0)
        counts = F.array(*[F.coalesce(F.sum(F.when(F.col(digit) == d, F.col(move))).over(so_far), F.lit(0)).cast("long") for d in range(BASE)])
        both = both.withColumn("__counts", counts).filter(F.col(own).isNotNull())
        total = F.aggregate("__counts", F.lit(0).cast("long"), lambda a, x: a + x)
        wanted = F.when(total > 0, F.floor((total - 1) * F.lit(float(q)) + 0.5).cast("long")) if k == 0 else F.col(left)
        # the digit at which the counts pass the wanted place, and the place within it
        start = F.struct(wanted.alias("left"), F.lit(None).cast("int").alias("digit"))
        step = lambda a, c, i: F.when(a["digit"].isNotNull() | a["left"].isNull(), a).when(a["left"] < c, F.struct(a["left"].alias("left"), i.alias("digit"))).otherwise(F.struct((a["left"] - c).alias("left"), a["digit"].alias("digit")))
        indexed = F.arrays_zip(F.col("__counts").alias("c"), F.sequence(F.lit(0), F.lit(BASE - 1)).alias("i"))
        found = F.aggregate(indexed, start, lambda a, x: step(a, x["c"], x["i"]))
        asked = both.withColumn("__found", found).select(*keys, own, when, (F.col(prefix) * BASE + F.col("__found.digit")).alias(prefix), F.col("__found.left").alias(left))
    values = facts.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(keys)], rank, F.col("__value").alias(out))
    same = F.col(prefix) == F.col(rank)
    for i, c in enumerate(keys):
        same &= F.col(c).eqNullSafe(F.col(f"__k{i}"))
    return asked.join(values, same, "left").select(f"{own}.*", out)
