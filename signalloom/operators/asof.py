"""As-of joins without inequality joins: one union, one shuffle, one sorted pass."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof_backward(left: DataFrame, right: DataFrame, keys: Sequence[str], left_on: str, right_on: str, payload: Sequence[str], tie: Sequence[str] = ()) -> DataFrame:
    """Each left row with the payload of the latest right row of its keys whose `right_on` is not after `left_on`.

    Both sides share one stream ordered by time, right rows first; the payload travels as a struct, so a right row with null
    values still counts as a match. Among right rows of one moment the last in `tie` order wins.
    """
    names = list(left.columns)
    mine = left.select(*names, F.col(left_on).alias("__at"), F.lit(2).alias("__side"))
    order_types = [(c, right.schema[c].dataType) for c in tie]
    for c, kind in order_types:
        mine = mine.withColumn(f"__tie_{c}", F.lit(None).cast(kind))
    record = F.struct(*[F.col(c).alias(c) for c in payload])
    theirs = right.select(
        *[F.col(c) if c in keys else F.lit(None).cast(left.schema[c].dataType).alias(c) for c in names],
        F.col(right_on).cast(left.schema[left_on].dataType).alias("__at"), F.lit(1).alias("__side"), *[F.col(c).alias(f"__tie_{c}") for c in tie], record.alias("__record"),
    )
    mine = mine.withColumn("__record", F.lit(None).cast(theirs.schema["__record"].dataType))
    window = Window.partitionBy(*keys).orderBy("__at", "__side", *[f"__tie_{c}" for c in tie]).rowsBetween(Window.unboundedPreceding, 0)
    found = mine.unionByName(theirs).withColumn("__found", F.last("__record", ignorenulls=True).over(window)).filter("__side = 2")
    return found.select(*names, *[F.col("__found")[c].alias(c) for c in payload])


def asof_dates(left: DataFrame, right: DataFrame, left_on: str, right_on: str, out: str) -> DataFrame:
    """Unkeyed as-of on distinct dates: `out` is the latest right date not after the left date. Both sides are reduced to
    their distinct dates before they meet, so the single ordered pass is over days, not rows."""
    days = left.select(F.col(left_on).alias("__d")).distinct().withColumn("__r", F.lit(None).cast("date"))
    marks = right.select(F.col(right_on).cast("date").alias("__d")).distinct().withColumn("__r", F.col("__d"))
    every = days.unionByName(marks).groupBy("__d").agg(F.max("__r").alias("__r"))
    window = Window.orderBy("__d").rowsBetween(Window.unboundedPreceding, 0)
    looked = every.select(F.col("__d"), F.last("__r", ignorenulls=True).over(window).alias(out))
    return left.join(looked, F.col(left_on) == F.col("__d"), "left").drop("__d")
