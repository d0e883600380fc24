"""Filing changes, daily differences and rolling collections of sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signalloom.functions.columns import day, over_days, safe_div
from signalloom.operators.asof import asof_backward
from signalloom.operators.calendars import weekdays
from signalloom.operators.intervals import overlap_join

#: Length of the time bins in which days meet the stretches that hold them.
SECTION_BIN_DAYS = 90


def _event_stream(filings: DataFrame, leave_after: int, frame_days: int, keep_repeats: bool) -> DataFrame:
    """(qid, date, recent): at every filing date and `leave_after` days later, the filings of the last `frame_days` days in
    order of date and document. Filings carry a record, departures none."""
    record = F.struct("date", "document_id", "length")
    enter = filings.select("qid", "date", record.alias("record"))
    leave = filings.select("qid", F.date_add("date", leave_after).alias("date"), F.lit(None).cast(enter.schema["record"].dataType).alias("record"))
    frame = Window.partitionBy("qid").orderBy(day("date")).rangeBetween(-frame_days, 0)
    rows = enter.unionByName(leave).withColumn("recent", F.array_sort(F.collect_list("record").over(frame)))
    return rows.select("qid", "date", "recent") if keep_repeats else rows.groupBy("qid", "date").agg(F.first("recent").alias("recent"))


def _change(recent: str = "recent"):
    return F.try_element_at(recent, F.lit(-1))["length"] - F.try_element_at(recent, F.lit(-2))["length"]


def filing_delta_halfopen(filings: DataFrame, lookback_days: int = 180) -> DataFrame:
    """D-31: latest less second latest length among the filings of (t - lookback, t], at filing dates and when they leave the
    window; a row stays where the signal is new, changed, became null or stayed null."""
    rows = _event_stream(filings, lookback_days, lookback_days - 1, True).withColumn("signal", _change())
    # rows of one day are alike, so their order among themselves does not matter
    w = Window.partitionBy("qid").orderBy("date")
    prev = F.lag("signal").over(w)
    keep = prev.isNull() | (F.col("signal") != prev) | (F.col("signal").isNull() != prev.isNull())
    return rows.withColumn("__keep", keep).filter("__keep").select("qid", "date", "signal")


def filing_delta_closed(filings: DataFrame, lookback_days: int = 180) -> DataFrame:
    """D-32: the same over [t - lookback, t], one row per change, the state before the first filing being null."""
    rows = _event_stream(filings, lookback_days + 1, lookback_days, False).withColumns({"signal": _change(), "n_filings_in_window": F.size("recent")})
    prev = F.lag("signal").over(Window.partitionBy("qid").orderBy("date"))
    return rows.withColumn("__new", ~F.col("signal").eqNullSafe(prev)).filter("__new").select("qid", "date", "signal", "n_filings_in_window")


def signal_asof(queries: DataFrame, events: DataFrame) -> DataFrame:
    """D-33: the signal in force on each query date; an event with a null signal is in force, too."""
    return asof_backward(queries, events, ["qid"], "date", "date", ["signal"], tie=["signal"])


def daily_differences(records: DataFrame, start: str | None = None, end: str | None = None, lookback_days: int = 180) -> DataFrame:
    """D-34: for every entity and day, the latest record, its difference to the one before and to the mean of all earlier
    records not older than `lookback_days` before the day. Days run from the data's first to its last date unless given."""
    w = Window.partitionBy("qid").orderBy("date", "length")
    up_to = w.rowsBetween(Window.unboundedPreceding, 0)
    numbered = records.select(
        "qid", F.col("date").alias("rec_date"), "length", F.row_number().over(w).alias("nth"), F.sum("length").over(up_to).alias("total"), F.lag("length").over(w).alias("before"), F.lag("date").over(w).alias("before_date")
    )
    bounds = records.agg(F.coalesce(F.lit(start).cast("date"), F.min("date")).alias("__a"), F.coalesce(F.lit(end).cast("date"), F.max("date")).alias("__b"))  # one row
    # answers change only where a record comes, or leaves the look-back; days are spread from these points last, so no shuffle holds the grid
    leaves = lambda date: F.date_add(date, lookback_days + 1)
    record, prefix = F.struct("length", "nth", "total", "before", "before_date"), F.struct("nth", "total")
    point = lambda at, nth, now, old: F.struct(at.alias("at"), nth.alias("__nth"), now.alias("now"), old.alias("old"))
    first, none = F.lit(None).cast("date"), F.lit(None)
    points = F.array(point(F.col("rec_date"), F.col("nth"), record, none), point(leaves("rec_date"), F.col("nth"), none, prefix), F.when(F.col("nth") == 1, point(first, F.lit(0), none, none)))
    moves = numbered.select("qid", F.inline(F.filter(points, lambda x: x.isNotNull())))
    in_time = Window.partitionBy("qid").orderBy("at", "__nth")
    so_far = in_time.rowsBetween(Window.unboundedPreceding, 0)
    held = moves.select(
        "qid", "at", F.lead("at").over(in_time).alias("next"), F.lead("__nth").over(in_time).isNull().alias("__last"), F.last("now", ignorenulls=True).over(so_far).alias("now"), F.last("old", ignorenulls=True).over(so_far).alias("old")
    )
    held = held.filter(F.col("__last") | ~F.col("next").eqNullSafe(F.col("at"))).crossJoin(F.broadcast(bounds))
    since, until = F.greatest("at", "__a"), F.least(F.date_sub("next", 1), F.col("__b"))
    held = held.withColumns({"__from": since, "__to": until}).filter("__from <= __to")
    length = F.col("now.length")
    # what lies too far back is a prefix: the mean of the records between is a difference of two running sums
    n = F.col("now.nth") - 1 - F.coalesce("old.nth", F.lit(0))
    mean = F.when(n > 0, safe_div(F.col("now.total") - length - F.coalesce("old.total", F.lit(0.0)), n))
    previous = F.when(leaves("now.before_date") > F.col("__from"), F.col("now.before"))
    rows = held.select("qid", "__from", "__to", length.alias("length"), (length - previous).alias("diff_vs_previous"), (length - mean).alias("diff_vs_avg_previous"))
    return rows.select("qid", F.explode(F.sequence("__from", "__to", F.expr("interval 1 day"))).alias("date"), "length", "diff_vs_previous", "diff_vs_avg_previous")


def rolling_sections_list(sections: DataFrame, days: int = 180) -> DataFrame:
    """D-35a: per row, the sections of [t - days, t] with repeats, in order of date."""
    frame = over_days(["id"], "date", days, "both")
    rows = sections.withColumn("__all", F.array_sort(F.collect_list(F.struct("date", "section")).over(frame)))
    return rows.select("id", "date", "section", F.col("__all.section").alias("sections"))


def _stretches(facts: DataFrame, last: Column) -> DataFrame:
    """(id, date, sections, total_count): what a window holds from `date` on until the next row of its id. A fact stands in the
    windows of its day to `last`.

    The days on which a section is there merge into stretches; a set is built only where one of these begins or ends, from the
    stretches that hold that day; the number of facts is a running sum of what enters and leaves."""
    spans = facts.select("id", "section", F.col("date").alias("from"), last.alias("to"))
    own = Window.partitionBy("id", "section").orderBy("from")
    begins = F.coalesce(F.col("from") > F.date_add(F.max("to").over(own.rowsBetween(Window.unboundedPreceding, -1)), 1), F.lit(True))
    islands = spans.distinct().withColumn("island", F.sum(begins.cast("int")).over(own.rowsBetween(Window.unboundedPreceding, 0)))
    stretches = islands.groupBy("id", "section", "island").agg(F.min("from").alias("from"), F.max("to").alias("to")).drop("island")
    moves = F.array(F.struct(F.col("from").alias("at"), F.lit(1).alias("n")), F.struct(F.date_add("to", 1).alias("at"), F.lit(-1).alias("n")))
    points = spans.select("id", F.inline(moves)).groupBy("id", "at").agg(F.sum("n").alias("n"))
    points = points.withColumn("total_count", F.sum("n").over(Window.partitionBy("id").orderBy("at").rowsBetween(Window.unboundedPreceding, 0))).drop("n")
    held = overlap_join(points.select("id", "at"), stretches, ["id"], ("at", "at"), ("from", "to"), SECTION_BIN_DAYS)
    sets = held.groupBy("id", "at").agg(F.array_sort(F.collect_set("section")).alias("sections"))
    none = F.array().cast("array<string>")
    return points.join(sets, ["id", "at"], "left").select("id", F.col("at").alias("since"), F.coalesce("sections", none).alias("sections"), "total_count")


def _on_days(days: DataFrame, facts: DataFrame, last: Column) -> DataFrame:
    """The (id, date) rows of `days` with the sections of their window, in order, their number, and the number of facts."""
    found = asof_backward(days, _stretches(facts, last), ["id"], "date", "since", ["sections", "total_count"])
    none = F.array().cast("array<string>")
    found = found.select("id", "date", F.coalesce("sections", none).alias("sections"), F.coalesce("total_count", F.lit(0)).cast("long").alias("total_count"))
    return found.withColumn("unique_count", F.size("sections"))


def rolling_sections_distinct(sections: DataFrame, days: int = 180) -> DataFrame:
    """D-35b, c and D-37: per (id, date), the distinct sections of the window in order, their number, and the number of rows."""
    facts = sections.filter("section is not null")
    return _on_days(facts.select("id", "date").distinct(), facts, F.date_add("date", days))


def _spread(facts: DataFrame, last: Column, empty: bool, per_entity: bool = False) -> DataFrame:
    """`_on_days` on the business days from the first to the last date of all facts, or of each id: stretches are cut to these dates and
    spread over their days in place, so no shuffle holds a row per day. Days without facts stay if `empty`."""
    w = Window.partitionBy("id").orderBy("since")
    rows = _stretches(facts, last).filter("since is not null")
    rows = rows.select("id", "since", F.date_sub(F.lead("since").over(w), 1).alias("until"), "sections", "total_count", F.row_number().over(w).alias("__nth"))
    if not empty:
        rows = rows.filter("total_count > 0")
    bounds = facts.groupBy(*(["id"] if per_entity else [])).agg(F.min("date").alias("__a"), F.max("date").alias("__b"))
    if per_entity:
        bounds = bounds.withColumnRenamed("id", "__id")
        rows = rows.join(bounds, F.col("id").eqNullSafe(F.col("__id")))
    else:
        rows = rows.crossJoin(F.broadcast(bounds))  # one row
    span = lambda a, b, sections, n: F.struct(a.alias("from"), b.alias("to"), sections.alias("sections"), n.cast("long").alias("total_count"))
    own = span(F.greatest("since", "__a"), F.least("until", "__b"), F.col("sections"), F.col("total_count"))
    if empty:  # the days before an id's first
        before = span(F.col("__a"), F.least(F.date_sub("since", 1), F.col("__b")), F.array().cast("array<string>"), F.lit(0))
        rows = rows.select("id", F.inline(F.when(F.col("__nth") == 1, F.array(before, own)).otherwise(F.array(own))))
    else:
        rows = rows.select("id", own.alias("own")).select("id", "own.*")
    days = rows.filter("`from` <= `to`").select("id", F.explode(F.sequence("from", "to", F.expr("interval 1 day"))).alias("date"), "sections", "total_count")
    return weekdays(days).withColumn("unique_count", F.size("sections"))


def rolling_sections_grid(sections: DataFrame, days: int = 180, per_entity: bool = False) -> DataFrame:
    """D-36: the same on business days, between the global or each entity's first and last date; days without any are left out."""
    facts = sections.filter("section is not null").select("id", "date", "section")
    return _spread(facts, F.date_add("date", days), False, per_entity)


def rolling_sections_months(sections: DataFrame, months: int = 6) -> DataFrame:
    """D-38: calendar months instead of days, on the business days of the whole calendar, empty lists kept.

    The windows that hold a day end with the last day that is no more than so many months later: the same day of the month, or
    where the day ends its month, the end of that month."""
    facts = sections.filter("section is not null").select("id", "date", "section")
    later = F.add_months("date", months)
    last = F.when(F.col("date") == F.last_day("date"), F.last_day(later)).otherwise(later)
    return _spread(facts, last, True).drop("total_count")


def window_labels(rows: DataFrame, window_days: int = 90, key: str = "qid", date: str = "date") -> DataFrame:
    """J12: each row once for every later filing date of its entity at most `window_days` ahead (`window_date`, historical), or
    once without one (current). Later dates come from a frame over the entity's distinct dates, not from a join with itself."""
    days = rows.select(key, date).distinct()
    ahead = Window.partitionBy(key).orderBy(day(date)).rangeBetween(1, window_days)
    later = days.withColumn("__later", F.collect_list(date).over(ahead)).select(key, date, F.explode_outer("__later").alias("window_date"))
    label = F.when(F.col("window_date").isNotNull(), "historical").otherwise("current")
    return rows.join(later, [key, date]).withColumn("data_type", label)


def filing_delay(filings: DataFrame, period_end: str = "period_end", filed: str = "date") -> DataFrame:
    """Days from the end of the period to the filing, against the entity's own average over the filings of earlier days."""
    w = Window.partitionBy("qid").orderBy(day(filed)).rangeBetween(Window.unboundedPreceding, -1)
    rows = filings.withColumn("delay", F.datediff(filed, period_end))
    return rows.withColumn("relative_delay", safe_div(F.col("delay"), F.avg("delay").over(w)))
