"""Event studies: spaced events, panels in event time, cumulative abnormal returns, tilt tests."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from signalloom.functions.columns import bucket_by_edges, quantile_edges, safe_div
from signalloom.operators.calendars import first_after, trading_index
from signalloom.sources.shared import materialise

PRE, SHORT, LONG, QUANTILES, GAP, DRAWS, SEED = 20, 5, 60, 5, 30, 500, 42


def min_gap_filter(events: DataFrame, gap_days: int = GAP, date: str = "data_date") -> DataFrame:
    """D-59: keep an entity's first event, and every later one at least `gap_days` after the last that was kept.

    A fold over each entity's sorted days; an entity has some hundred events."""
    days = events.select("qid", date).distinct().groupBy("qid").agg(F.array_sort(F.collect_list(date)).alias("__days"))
    kept = F.aggregate(
        "__days", F.array().cast("array<date>"),
        lambda acc, d: F.when((F.size(acc) == 0) | (F.datediff(d, F.try_element_at(acc, F.lit(-1))) >= gap_days), F.concat(acc, F.array(d))).otherwise(acc),
    )
    spaced = days.select("qid", F.explode(kept).alias(date))
    first = events.withColumn("__n", F.row_number().over(Window.partitionBy("qid", date).orderBy("date", "value"))).filter("__n = 1").drop("__n")
    return first.join(spaced, ["qid", date])


def event_panel(events: DataFrame, returns: DataFrame, market: DataFrame, pre: int = PRE, post: int = LONG, gap_days: int = GAP, return_type: str = "market_adj") -> DataFrame:
    """D-60: returns around each event; day 0 is the first trading day strictly after data_date. Days off the calendar are
    dropped, missing returns stay null; the abnormal return is the return less the market's where that is known."""
    calendar = trading_index(returns)
    placed = first_after(min_gap_filter(events, gap_days), "data_date", calendar, "__zero").filter("__zero is not null")
    days = placed.withColumn("event_day", F.explode(F.sequence(F.lit(-pre), F.lit(post)))).withColumn("td_idx", F.col("__zero") + F.col("event_day"))
    dated = days.drop("date").join(calendar, "td_idx").join(returns.select("qid", "date", "ret"), ["qid", "date"], "left").join(market.select("date", "mkt_ret"), "date", "left")
    abnormal = F.col("ret") - F.coalesce(F.col("mkt_ret"), F.lit(0.0)) if return_type == "market_adj" else F.col("ret")
    return dated.select("qid", "data_date", "value", "event_day", "date", "ret", abnormal.alias("ar"))


def assign_quantiles(panel: DataFrame, n: int = QUANTILES) -> DataFrame:
    """D-61: bucket of the event's value among the events of its data_date; repeated edges make the whole date Q_NA."""
    events = panel.select("qid", "data_date", "value").distinct()
    edged = events.withColumn("__edges", quantile_edges("value", ["data_date"], n))
    bucket = bucket_by_edges(F.col("value"), F.col("__edges"))
    clean = (F.size(F.array_distinct("__edges")) == n + 1) & bucket.isNotNull()
    named = edged.select("qid", "data_date", F.when(clean, F.concat(F.lit("Q"), (bucket + 1).cast("string"))).otherwise(F.lit("Q_NA")).alias("quantile"))
    return panel.join(named, ["qid", "data_date"])


def car(panel: DataFrame) -> DataFrame:
    """D-62: mean abnormal return, its cumulative sum and standard error per quantile and event day."""
    rows = panel.groupBy("quantile", "event_day").agg(F.avg("ar").alias("mean_ar"), F.stddev_samp("ar").alias("std_ar"), F.count("ar").alias("n"))
    w = Window.partitionBy("quantile").orderBy("event_day").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumns({"car": F.sum("mean_ar").over(w), "se": safe_div(F.col("std_ar"), F.sqrt(F.col("n").cast("double")))})


def car_spread(curves: DataFrame, high: str = "Q5", low: str = "Q1") -> DataFrame:
    """D-65: difference of the extreme quantiles' curves on their common days."""
    top = curves.filter(F.col("quantile") == high).select("event_day", F.col("car").alias("__h"))
    bottom = curves.filter(F.col("quantile") == low).select("event_day", F.col("car").alias("__l"))
    return top.join(bottom, "event_day").select("event_day", (F.col("__h") - F.col("__l")).alias("spread"))


def car_band(curves: DataFrame) -> DataFrame:
    """D-65: 95% band in percent from the running sum of standard errors."""
    w = Window.partitionBy("quantile").orderBy("event_day").rowsBetween(Window.unboundedPreceding, 0)
    width = F.sum("se").over(w) * 1.96 * 100
    return curves.select("quantile", "event_day", (F.col("car") * 100).alias("car_pct"), (F.col("car") * 100 - width).alias("lower"), (F.col("car") * 100 + width).alias("upper"))


def event_tilts(panel: DataFrame, short: int = SHORT, long: int = LONG) -> DataFrame:
    """Sum of abnormal returns of each event over [1, short] and [1, long]."""
    inside = lambda b: F.coalesce(F.sum(F.when(F.col("event_day").between(1, b), F.col("ar"))), F.lit(0.0))
    return panel.groupBy("qid", "data_date", "quantile").agg(inside(short).alias("tilt_short"), inside(long).alias("tilt_long"))


def tilt_by_quantile(tilts: DataFrame) -> DataFrame:
    """D-63: mean, deviation and number per quantile and horizon."""
    long = tilts.select("quantile", F.expr("stack(2, 'short', tilt_short, 'long', tilt_long) as (horizon, tilt)"))
    return long.groupBy("quantile", "horizon").agg(F.avg("tilt").alias("mean"), F.stddev_samp("tilt").alias("std"), F.count("tilt").alias("n"))


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction (Lentz)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c, d, f = 1e-300, 1.0, 0.0, 1.0
    for i in range(400):
        m = i // 2
        if i == 0:
            term = 1.0
        elif i % 2 == 0:
            term = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            term = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + term * d if abs(1 + term * d) > tiny else tiny)
        c = 1 + term / c if abs(1 + term / c) > tiny else tiny
        f *= c * d
        if abs(1 - c * d) < 1e-14:
            break
    return front * (f - 1)


def t_p_value(t: float | None, df: float | None) -> float | None:
    """Two-sided p-value of Student's t."""
    return None if t is None or df is None or df <= 0 else incomplete_beta(df / 2, 0.5, df / (df + t * t))


def stars(p):
    """D-64."""
    return F.when(p < 0.01, "***").when(p < 0.05, "**").when(p < 0.10, "*").otherwise("")


def tilt_test(table: DataFrame, high: str = "Q5", low: str = "Q1") -> DataFrame:
    """D-63: pooled two-sample t-test of the extreme quantiles, one row per horizon; both need more than one event."""
    side = lambda q, p: table.filter((F.col("quantile") == q) & (F.col("n") > 1)).select("horizon", *[F.col(c).alias(p + c) for c in ("mean", "std", "n")])
    rows = side(high, "h_").join(side(low, "l_"), "horizon")
    df = F.col("h_n") + F.col("l_n") - 2
    pooled = safe_div((F.col("h_n") - 1) * F.col("h_std") ** 2 + (F.col("l_n") - 1) * F.col("l_std") ** 2, df)
    t = safe_div(F.col("h_mean") - F.col("l_mean"), F.sqrt(pooled * (1 / F.col("h_n") + 1 / F.col("l_n"))))
    rows = rows.select("horizon", (F.col("h_mean") - F.col("l_mean")).alias("spread"), t.alias("t_stat"), df.alias("df"))

    def p_values(batches):
        for pdf in batches:
            yield pdf.assign(p_value=[t_p_value(None if a != a else a, b) for a, b in zip(pdf.t_stat, pdf.df, strict=True)])

    return rows.mapInPandas(p_values, "horizon string, spread double, t_stat double, df long, p_value double").withColumn("stars", stars(F.col("p_value")))


#: A unit number is drawn from so many hexadecimal digits of a hash.
UNIT_DIGITS = 13
#: Events are numbered within buckets of their hash's first digits.
BUCKET_DIGITS = 3


def numbered_events(legs: DataFrame) -> DataFrame:
    """`legs` (quantile, x, event) with each event's place from 1 in its leg, in order of hash, and the leg's size. Places are
    counted within buckets of the hash, before which come the sizes of the buckets before: no task orders a whole leg."""
    rows = legs.withColumn("h", F.md5(F.col("event").cast("binary"))).withColumn("bucket", F.substring("h", 1, BUCKET_DIGITS))
    sizes = rows.groupBy("quantile", "bucket").count()
    leg = Window.partitionBy("quantile")  # a row for each bucket
    before = F.coalesce(F.sum("count").over(leg.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("quantile", "bucket", before.alias("before"), F.sum("count").over(leg).alias("size"))
    nth = F.row_number().over(Window.partitionBy("quantile", "bucket").orderBy("h", "event"))
    return rows.withColumn("nth", nth).join(sizes, ["quantile", "bucket"]).select("quantile", "x", "event", (F.col("before") + F.col("nth")).alias("place"), "size")


def resampled(legs: DataFrame, draws: int = DRAWS) -> DataFrame:
    """quantile, draw, n, mean: in every draw a leg of n events is n events drawn from it with replacement. Each event
    draws one, by a hash of its name and the draw, so the result depends on nothing but the events and their names."""
    numbered = materialise(numbered_events(legs), "numbered_events")  # read for the draws and for the values
    slots = numbered.select("quantile", "event", "size", F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("draw"))
    unit = F.conv(F.substring(F.md5(F.concat_ws(":", "event", "draw").cast("binary")), 1, UNIT_DIGITS), 16, 10).cast("double") / F.lit(16.0**UNIT_DIGITS)
    chosen = slots.select("quantile", "draw", (F.floor(unit * F.col("size")) + 1).alias("place"))
    values = numbered.select("quantile", "place", "x")
    return chosen.join(values, ["quantile", "place"]).groupBy("quantile", "draw").agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("mean"))


def bootstrap_spread(tilts: DataFrame, value: str = "tilt_long", high: str = "Q5", low: str = "Q1", draws: int = DRAWS, seed: int = SEED) -> DataFrame:
    """D-63: 5% and 95% points of the mean spread over draws in which each leg is resampled to its own size."""
    event = F.concat_ws(":", F.lit(str(seed)), "qid", "data_date")
    legs = tilts.filter(F.col("quantile").isin(high, low) & F.col(value).isNotNull()).select("quantile", F.col(value).alias("x"), event.alias("event"))
    side = lambda q: F.max(F.when(F.col("quantile") == q, F.col("mean")))
    means = resampled(legs, draws).groupBy("draw").agg((side(high) - side(low)).alias("s"))
    return means.agg(F.percentile("s", F.lit(0.05)).alias("ci_low"), F.percentile("s", F.lit(0.95)).alias("ci_high"), F.count("s").alias("draws"))
