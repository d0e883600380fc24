"""Backtests: PnL, risk metrics, cross-sectional positions, information coefficients."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from signalloom.functions.columns import at_least, average_rank, bucket_by_edges, correlation, last_rows, quantile_edges, safe_div, zscore

YEAR = 252


def weighted_pnl(signals: DataFrame, returns: DataFrame) -> DataFrame:
    """D-02: value times return per sector and day."""
    return signals.join(returns, ["date", "sector"]).select("date", "sector", (F.col("value") * F.col("total_return")).alias("weighted_return"))


def portfolio_daily(weighted: DataFrame) -> DataFrame:
    return weighted.groupBy("date").agg(F.sum("weighted_return").alias("portfolio_return"))


def cumulative_pnl(df: DataFrame, value: str, out: str, keys: Sequence[str] = (), date: str = "date") -> DataFrame:
    """Growth of 1: running product of 1 + return."""
    growth = F.product(1 + F.col(value)).over(Window.partitionBy(*keys).orderBy(date).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn(out, growth)


def strategy_metrics(daily: DataFrame, value: str = "portfolio_return") -> DataFrame:
    """D-03: Sharpe, maximum drawdown, annual volatility and total return in one row. `daily` has a row per day."""
    growth = cumulative_pnl(daily, value, "__cum")
    peak = growth.withColumn("__peak", F.max("__cum").over(Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)))
    std = F.stddev_samp(value)
    return peak.agg(
        F.when(std == 0, F.lit(0.0)).otherwise(safe_div(F.avg(value), std) * math.sqrt(YEAR)).alias("sharpe"),
        F.min(safe_div(F.col("__cum") - F.col("__peak"), F.col("__peak"))).alias("max_drawdown"),
        (std * math.sqrt(YEAR)).alias("ann_vol"), (F.max_by("__cum", "date") - 1).alias("total_return"),
    )


def rolling_sharpe(daily: DataFrame, value: str = "portfolio_return", rows: int = 60) -> DataFrame:
    """D-04: null until `rows` observations are there."""
    window = Window.orderBy("date")
    ratio = safe_div(last_rows(F.col(value), window, rows), last_rows(F.col(value), window, rows, F.stddev_samp)) * math.sqrt(YEAR)
    return daily.withColumn("rolling_sharpe", ratio)


def sector_sharpe(weighted: DataFrame) -> DataFrame:
    """D-05: mean, sample deviation and Sharpe per sector, best first."""
    table = weighted.groupBy("sector").agg(F.avg("weighted_return").alias("mean"), F.stddev_samp("weighted_return").alias("std"))
    return table.withColumn("sharpe", safe_div(F.col("mean"), F.col("std")) * math.sqrt(YEAR)).orderBy(F.col("sharpe").desc_nulls_last())


def prepare_signal(signal: DataFrame, min_coverage: float = 0.1, n_quantiles: int = 5, lag: int = 1, holding: int = 5, entity: str = "factset_entity_id", value: str = "etf_sentiment") -> DataFrame:
    """D-20: cross-sectional z-score and quantile bucket per day, both lagged per entity; a rebalance flag every `holding` days."""
    rows = signal.filter(F.col("coverage") > min_coverage).withColumn("signal_z", zscore(value, ["date"], 1e-8))
    # repeated edges are dropped first, as a cut of duplicates would: bucket numbers then close up
    rows = rows.withColumn("bucket", bucket_by_edges(F.col("signal_z"), F.array_distinct(quantile_edges("signal_z", ["date"], n_quantiles))))
    w = Window.partitionBy(entity).orderBy("date")
    rows = rows.withColumns({"signal_lag": F.lag("signal_z", lag).over(w), "bucket_lag": F.lag("bucket", lag).over(w), "is_rebalance_day": F.dense_rank().over(w) % holding == 0})
    return rows.select(entity, "date", value, "signal_z", "bucket", "signal_lag", "bucket_lag", "is_rebalance_day")


def build_positions(prepared: DataFrame, n_quantiles: int = 5, long_short: bool = True) -> DataFrame:
    """D-21: top bucket long and bottom short, or positive z long only; weights of a day sum to 1 in absolute value."""
    b = F.col("bucket_lag")
    raw = F.when(b == n_quantiles - 1, 1.0).when(b == 0, -1.0).otherwise(0.0) if long_short else at_least(F.col("signal_lag"), 0.0)
    rows = prepared.withColumn("raw_position", raw)
    return rows.withColumn("weight", F.coalesce(safe_div(F.col("raw_position"), F.sum(F.abs("raw_position")).over(Window.partitionBy("date"))), F.lit(0.0)))


def net_returns(positions: DataFrame, returns: DataFrame, cost: float = 0.001, entity: str = "factset_entity_id") -> DataFrame:
    """D-22: gross return, cost of turnover and net return per day."""
    rows = positions.join(returns, [entity, "date"])
    w = Window.partitionBy(entity).orderBy("date")
    rows = rows.withColumn("__turn", F.coalesce(F.abs(F.col("weight") - F.lag("weight").over(w)), F.lit(0.0)))
    daily = rows.groupBy("date").agg(F.sum(F.col("weight") * F.col("ret")).alias("gross_return"), F.sum(F.col("__turn") * cost).alias("cost"))
    return daily.withColumn("net_return", F.col("gross_return") - F.col("cost"))


def information_coefficient(prepared: DataFrame, returns: DataFrame, entity: str = "factset_entity_id") -> DataFrame:
    """D-23: Pearson and rank correlation of the lagged signal with the day's returns."""
    rows = prepared.join(returns, [entity, "date"]).filter("signal_lag is not null and ret is not null")
    rows = rows.withColumns({"__rs": average_rank("signal_lag", ["date"]), "__rr": average_rank("ret", ["date"])})
    return rows.groupBy("date").agg(correlation(F.col("signal_lag"), F.col("ret")).alias("ic"), correlation(F.col("__rs"), F.col("__rr")).alias("rank_ic"))


def quantile_returns(prepared: DataFrame, returns: DataFrame, entity: str = "factset_entity_id") -> DataFrame:
    """D-24: mean return per day and bucket; rows without a bucket are a group of their own."""
    return prepared.join(returns, [entity, "date"]).groupBy("date", "bucket_lag").agg(F.avg("ret").alias("mean_ret"))


def performance_stats(daily: DataFrame, ic: DataFrame, cost: float = 0.001) -> DataFrame:
    """D-25: one row; deviations are those of the population."""
    growth = cumulative_pnl(daily, "net_return", "__cum")
    peak = growth.withColumn("__peak", F.max("__cum").over(Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)))
    std = F.stddev_pop("net_return")
    one = peak.agg(
        (F.avg("net_return") * YEAR).alias("ann_return"), (std * math.sqrt(YEAR)).alias("ann_vol"), (F.avg("net_return") / (std + 1e-10) * math.sqrt(YEAR)).alias("sharpe"),
        F.min(safe_div(F.col("__cum") - F.col("__peak"), F.col("__peak"))).alias("max_drawdown"), (F.avg("cost") / cost * YEAR).alias("ann_turnover"), (F.avg("cost") * YEAR).alias("ann_cost"),
    )
    two = ic.agg(
        F.avg("ic").alias("mean_ic"), F.avg("rank_ic").alias("mean_rank_ic"), (F.avg("ic") / (F.stddev_pop("ic") + 1e-10)).alias("icir"),
        F.avg((F.col("ic") > 0).cast("double")).alias("ic_positive"),
    )
    return one.crossJoin(two)  # one row each
