"""Membership snapshots as validity intervals, point-in-time joins, and sector signals over sliding windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from signalloom.functions.columns import day, fill_forward, safe_div
from signalloom.operators.ewma import irregular_ewma
from signalloom.sources.shared import materialise

OPEN_END = "2099-12-31"


def intervals_observed(snapshots: DataFrame, gap_days: int = 60, tolerance: float = 1e-6) -> DataFrame:
    """D-10: runs of unchanged positive weight; an interval ends at its last observed date. A change of weight beyond the
    tolerance or a gap of more than `gap_days` starts a new run."""
    w = Window.partitionBy("sectorId", "qid").orderBy("date", "weight")
    rows = snapshots.filter("weight is not null and weight > 0").withColumns({"__w": F.lag("weight").over(w), "__d": F.lag("date").over(w)})
    starts = F.col("__d").isNull() | (F.abs(F.col("weight") - F.col("__w")) > tolerance) | (F.datediff("date", "__d") > gap_days)
    rows = rows.withColumn("segment_id", F.sum(starts.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("sectorId", "qid", "segment_id", "weight").agg(F.min("date").alias("startDate"), F.max("date").alias("endDate"), F.count(F.lit(1)).alias("n_dates"))


def intervals_explicit(snapshots: DataFrame) -> DataFrame:
    """D-12: runs of exactly equal weight; an interval ends the day before the next one starts, the last is open."""
    w = Window.partitionBy("sectorId", "qid").orderBy("date", "weight")
    rows = snapshots.withColumn("__w", F.lag("weight").over(w))
    starts = F.col("__w").isNull() | (F.col("weight") != F.col("__w"))
    rows = rows.withColumn("segment_id", F.sum(starts.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = rows.groupBy("sectorId", "qid", "segment_id", "weight").agg(F.min("date").alias("startDate"))
    nxt = F.lead("startDate").over(Window.partitionBy("sectorId", "qid").orderBy("startDate", "segment_id"))
    return runs.withColumn("endDate", F.coalesce(F.date_sub(nxt, 1), F.lit(OPEN_END).cast("date")))


def interval_overlaps(intervals: DataFrame) -> DataFrame:
    """D-11: intervals that reach into the next one of their entity."""
    nxt = F.lead("startDate").over(Window.partitionBy("sectorId", "qid").orderBy("startDate", "endDate", "segment_id"))
    return intervals.withColumn("next_start", nxt).filter("next_start is not null and endDate >= next_start")


def binned_pairs(left: DataFrame, right: DataFrame, on: Sequence[str], left_span: tuple[str, str], right_span: tuple[str, str], bin_days: int) -> DataFrame:
    """The pairs of a key that share a time bin, each once: what `overlap_join` looks at. Bins are `bin_days` days long; a row
    stands in every bin that its span touches, and a pair counts only in the first bin that both touch. Spans are cut to the
    days on which the other side has anything, so that open ends cost no bins. A hot key is dealt by its bins."""
    days = lambda df, span, a, b: df.agg(F.min(day(span[0])).alias(a), F.max(day(span[1])).alias(b))
    bounds = days(left, left_span, "__la", "__lb").crossJoin(days(right, right_span, "__ra", "__rb"))  # one row
    bounds = F.broadcast(bounds.select(F.greatest("__la", "__ra").alias("__from"), F.least("__lb", "__rb").alias("__to")))

    def binned(df: DataFrame, span: tuple[str, str], first: str) -> DataFrame:
        low, high = F.greatest(day(span[0]), F.col("__from")), F.least(day(span[1]), F.col("__to"))
        there = df.crossJoin(bounds).filter((F.col(span[0]) <= F.col(span[1])) & (low <= high))
        there = there.withColumns({first: F.floor(low / bin_days), "__last": F.floor(high / bin_days)})
        return there.withColumn("__bin", F.explode(F.sequence(first, "__last"))).drop("__last", "__from", "__to")

    met = binned(left, left_span, "__fl").join(binned(right, right_span, "__fr"), [*on, "__bin"])
    return met.filter(F.col("__bin") == F.greatest("__fl", "__fr")).drop("__bin", "__fl", "__fr")


def overlap_join(left: DataFrame, right: DataFrame, on: Sequence[str], left_span: tuple[str, str], right_span: tuple[str, str], bin_days: int = 30) -> DataFrame:
    """Interval join: the pairs of a key whose spans (first and last date, both included) share a day. The sides' other columns
    have different names. Bins as long as the shorter spans keep what is looked at near what is found. Rows with a null bound
    or a span that ends before it begins join with nothing."""
    pairs = binned_pairs(left, right, on, left_span, right_span, bin_days)
    return pairs.filter((F.col(left_span[0]) <= F.col(right_span[1])) & (F.col(right_span[0]) <= F.col(left_span[1])))


def pit_join(sentiment: DataFrame, intervals: DataFrame, bin_days: int = 30) -> DataFrame:
    """D-13: each observation with the weights valid on its day."""
    held = intervals.select("sectorId", F.col("qid").alias("id"), "startDate", "endDate", "weight")
    joined = overlap_join(sentiment, held, ["id"], ("date", "date"), ("startDate", "endDate"), bin_days)
    return joined.select("sectorId", "id", "documentid", "date", "sentiment", "weight", (F.col("sentiment") * F.col("weight")).alias("weighted_sentiment"))


def sliding_sector(pit: DataFrame, days: int = 30, mode: str = "forward", guard: bool = True) -> DataFrame:
    """D-14, D-18: per sector and day, statistics of the observations in a window of `days` days.

    forward: the window begins on the day (as the reference computes it, looking ahead); trailing: it ends on the day. Windows
    begin at the sector's first date. `guard` leaves the sentiment null unless the weights sum above 0.

    No row is spread over its windows: observations are summed per sector and day, and frames run over those sums. Companies
    are counted by a sweep: an observation makes its company present from where the one before it stops to do so, so each
    adds one arrival and one departure, and a running sum of these is the distinct count.
    """
    x = F.col("sentiment")
    # written once: sums, spans and bounds are all taken from it, and the joins behind `pit` would run for each
    own = pit.groupBy("sectorId", "id", "date").agg(
        F.sum("weighted_sentiment").alias("ws"), F.sum("weight").alias("w"), F.max("weight").alias("top"), F.count(x).alias("n"), F.sum(x).alias("s"), F.sum(x * x).alias("q")
    )
    own = materialise(own, "sector_days")
    daily = own.groupBy("sectorId", "date").agg(*[F.sum(c).alias(c) for c in ("ws", "w", "n", "s", "q")], F.max("top").alias("top"))
    before = F.lag("date").over(Window.partitionBy("sectorId", "id").orderBy("date"))
    spans = own.select("sectorId", "id", "date").withColumn("__p", before)
    if mode == "forward":
        arrive, leave, first, last = F.greatest(F.date_sub("date", days - 1), F.date_add("__p", 1)), F.date_add("date", 1), 0, days - 1
    else:
        arrive, leave, first, last = F.greatest(F.col("date"), F.date_add("__p", days)), F.date_add("date", days), 1 - days, 0
    moves = spans.select("sectorId", F.explode(F.array(F.struct(arrive.alias("date"), F.lit(1).alias("d")), F.struct(leave.alias("date"), F.lit(-1).alias("d")))).alias("m"))
    moves = moves.groupBy("sectorId", F.col("m.date").alias("date")).agg(F.sum("m.d").alias("d"))
    bounds = own.groupBy("sectorId").agg(F.min("date").alias("a"), F.date_add(F.max("date"), 0 if mode == "forward" else days - 1).alias("b"))
    grid = bounds.select("sectorId", F.explode(F.sequence("a", "b", F.expr("interval 1 day"))).alias("date"), F.lit(True).alias("g"))
    keys = ["sectorId", "date"]
    rows = grid.join(daily, keys, "full").join(moves, keys, "full")
    ordered = Window.partitionBy("sectorId").orderBy(day("date"))
    frame, so_far = ordered.rangeBetween(first, last), ordered.rangeBetween(Window.unboundedPreceding, 0)
    total = {c: F.sum(c).over(frame) for c in ("ws", "w", "n", "s", "q")}
    rows = rows.select(*keys, "g", *[v.alias(f"t_{c}") for c, v in total.items()], F.max("top").over(frame).alias("max_single_weight"), F.sum("d").over(so_far).alias("n_companies"))
    ratio, n = safe_div(F.col("t_ws"), F.col("t_w")), F.col("t_n")
    spread = F.sqrt(F.greatest(safe_div(F.col("t_q") - safe_div(F.col("t_s") * F.col("t_s"), n), n - 1), F.lit(0.0)))
    return rows.filter("g and n_companies > 0").select(
        *keys, (F.when(F.col("t_w") > 0, ratio) if guard else ratio).alias("sector_sentiment"), F.col("t_w").alias("weight_coverage"), "n_companies",
        n.alias("n_docs"), F.when(n > 1, spread).alias("sentiment_std"), "max_single_weight",
    )


def signal_quality(min_companies: int = 3):
    """D-15: between 0 and 1 from the number of companies, the weight covered and the largest single weight."""
    enough = F.least(F.col("n_companies") / F.lit(2.0 * min_companies), F.lit(1.0))
    covered = F.least(F.col("weight_coverage") / F.lit(0.5), F.lit(1.0))
    return enough * 0.4 + covered * 0.3 + (1 - F.col("max_single_weight")) * 0.3


def gated_signal(sector: DataFrame, min_companies: int = 3, min_coverage: float = 0.2, halflife_days: float = 7.0) -> DataFrame:
    """D-16: the sentiment where enough companies and weight stand behind it, smoothed by time and held until the next one."""
    valid = (F.col("n_companies") >= min_companies) & (F.col("weight_coverage") >= min_coverage) & F.col("sentiment_std").isNotNull()
    gated = sector.withColumns({"quality": signal_quality(min_companies), "raw_signal": F.when(valid, F.col("sector_sentiment"))})
    smooth = irregular_ewma(gated, "sectorId", "date", "raw_signal", halflife_days, "smoothed_signal")
    return smooth.withColumn("final_signal", fill_forward("smoothed_signal", Window.partitionBy("sectorId").orderBy("date")))


def signal_statistics(gated: DataFrame, low_coverage: float = 0.3, concentrated: float = 0.3) -> DataFrame:
    """D-17: one report row per sector."""
    w = Window.partitionBy("sectorId").orderBy("date")
    rows = gated.withColumn("__step", F.abs(F.col("final_signal") - F.lag("final_signal").over(w)))
    n, valid = F.count(F.lit(1)), F.count("raw_signal")
    return rows.groupBy("sectorId").agg(
        n.alias("n_dates"), valid.alias("n_valid"), F.avg("quality").alias("avg_quality"), F.avg("n_companies").alias("avg_companies"),
        F.avg("weight_coverage").alias("avg_weight_coverage"), F.stddev_samp("final_signal").alias("volatility"), F.avg("__step").alias("turnover"),
        F.count_if(F.col("weight_coverage") < low_coverage).alias("low_coverage_days"), F.count_if(F.col("max_single_weight") > concentrated).alias("concentrated_days"),
        safe_div(valid, n).alias("coverage_pct"),
    )


def pit_sector_daily(sentiment: DataFrame, snapshots: DataFrame, days: int = 30) -> DataFrame:
    """D-18: weights joined on equal dates, then forward windows without the guard."""
    held = snapshots.select("sectorId", F.col("qid").alias("id"), "date", "weight")
    pit = sentiment.join(held, ["id", "date"]).withColumn("weighted_sentiment", F.col("sentiment") * F.col("weight"))
    return sliding_sector(pit, days, "forward", guard=False)
