"""From signals to weights, shares and trades."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from signalloom.functions.columns import at_least, at_most, average_rank, safe_div, zscore

CAP = 0.30
THRESHOLD = 0.02
NAV = 1_000_000.0


def signal_to_weight(signals: DataFrame, method: str = "zscore", top_n: int = 5, cap: float = CAP) -> DataFrame:
    """D-26: weights of a day from its signals; capped once and normalised once more, so a weight can pass the cap."""
    by_date = Window.partitionBy("date")
    if method == "topn":
        raw = F.when(F.dense_rank().over(by_date.orderBy(F.col("signal_value").desc_nulls_last())) <= top_n, F.lit(1.0)).otherwise(F.lit(0.0))
    elif method == "zscore":
        raw = at_least(zscore("signal_value", ["date"]), 0.0)
    else:
        raw = 1 / average_rank("signal_value", ["date"], descending=True)
    rows = signals.withColumn("raw_weight", raw)
    rows = rows.withColumn("weight", at_most(safe_div(F.col("raw_weight"), F.sum("raw_weight").over(by_date)), cap))
    return rows.withColumn("weight", safe_div(F.col("weight"), F.sum("weight").over(by_date))).select("sector_id", "date", "signal_value", "weight")


def rebalance_buffer(target: DataFrame, previous: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """D-27: one step: keep the previous weight unless the target is further away than the threshold; normalise."""
    joined = target.join(previous.select("sector_id", F.col("weight").alias("__prev")), "sector_id", "left")
    kept = F.coalesce(F.col("__prev"), F.lit(0.0))
    new = F.when(F.abs(F.col("weight") - kept) > threshold, F.col("weight")).otherwise(kept)
    return joined.withColumn("weight", new).withColumn("weight", safe_div(F.col("weight"), F.sum("weight").over(Window.partitionBy("date")))).drop("__prev")


def rebalance_path(weights: DataFrame, threshold: float = THRESHOLD, portfolio: str | None = None) -> DataFrame:
    """D-29: the buffer applied day after day, each day starting from the weights of the day before, for each `portfolio` if
    that column is named.

    The normaliser couples all sectors of a day, so the days of a portfolio are a true recurrence: one task walks them in
    order and holds the weights of one day, whatever the number of days."""
    keys = [portfolio] if portfolio else []
    rows = weights.filter("weight is not null").select(*keys, "date", "sector_id", "weight")
    kind = dict(rows.dtypes)
    rows = rows.repartition(*keys) if keys else rows.repartition(1)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, today = None, {}, {}

        def close() -> list:
            new = {s: w if abs(w - held.get(s, 0.0)) > threshold else held.get(s, 0.0) for s, w in today.items()}
            total = math.fsum(new.values())
            return [(*at, s, w / total if total else None) for s, w in new.items()]

        for batch in batches:
            out: list = []
            for *place, sector, weight in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if place != at:
                    if at is not None:
                        out += (rows_of_day := close())
                        held = {r[-2]: r[-1] or 0.0 for r in rows_of_day} if place[:-1] == at[:-1] else {}
                    at, today = place, {}
                today[sector] = weight
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True) if out else [()] * len(batch.schema), batch.schema, strict=True)], schema=batch.schema)
            schema = batch.schema
        if at is not None:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*close(), strict=True), schema, strict=True)], schema=schema)

    columns = [*keys, "date", "sector_id", "weight"]
    return rows.sortWithinPartitions(*columns[:-1]).mapInArrow(walk, ", ".join(f"{c} {kind[c]}" for c in columns))


def weights_to_shares(weights: DataFrame, prices: DataFrame, nav: float = NAV) -> DataFrame:
    """D-28: whole shares that the weight buys at the close."""
    rows = weights.join(prices.select("sector_id", "date", "close"), ["sector_id", "date"], "left")
    rows = rows.withColumn("shares", F.floor(safe_div(F.col("weight") * nav, F.col("close"))))
    return rows.withColumn("notional", F.col("shares") * F.col("close"))


def trades(shares: DataFrame, liquidate: bool = False) -> DataFrame:
    """D-28: changes of position from each day to the next. Positions that leave the universe are left alone, or sold on the
    next day with `liquidate`."""
    dates = shares.select("date").distinct().withColumn("__next", F.lead("date").over(Window.orderBy("date")))
    held = shares.join(dates, "date").select(F.col("sector_id"), F.col("__next").alias("date"), F.coalesce("shares", F.lit(0)).alias("__before")).filter("date is not null")
    rows = shares.select("sector_id", "date", F.coalesce("shares", F.lit(0)).alias("shares")).join(held, ["sector_id", "date"], "full" if liquidate else "left")
    rows = rows.withColumn("trade_shares", F.coalesce("shares", F.lit(0)) - F.coalesce("__before", F.lit(0)))
    side = F.when(F.col("trade_shares") > 0, "BUY").when(F.col("trade_shares") < 0, "SELL").otherwise("HOLD")
    return rows.withColumn("side", side).filter("trade_shares != 0").select("sector_id", "date", "trade_shares", "side")
