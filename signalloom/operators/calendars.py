"""Calendars, entity grids and panels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from signalloom.functions.columns import fill_backward, fill_forward


def daily_calendar(df: DataFrame, date: str = "date", keys: Sequence[str] = ()) -> DataFrame:
    """Every day from the first to the last date (of each key, if keys are given)."""
    bounds = df.groupBy(*keys).agg(F.min(date).alias("__a"), F.max(date).alias("__b"))
    return bounds.filter("__a is not null").select(*keys, F.explode(F.sequence("__a", "__b", F.expr("interval 1 day"))).alias(date))


def weekdays(calendar: DataFrame, date: str = "date") -> DataFrame:
    """Monday to Friday."""
    return calendar.filter(F.weekday(date) <= 4)


def date_range(spark, start: str, end: str, date: str = "date") -> DataFrame:
    return spark.sql(f"SELECT explode(sequence(DATE'{start}', DATE'{end}', INTERVAL 1 DAY)) AS {date}")


def signal_dates(spark, start: str, end: str, frequency: str = "weekly", exchange_days: DataFrame | None = None, date: str = "date") -> DataFrame:
    """Trading days of an exchange calendar if one is given, else weekdays; weekly keeps the last such day of each week
    (Friday on the plain calendar)."""
    days = exchange_days.select(date).filter(F.col(date).between(start, end)).distinct() if exchange_days is not None else weekdays(date_range(spark, start, end, date), date)
    if frequency == "daily":
        return days
    if exchange_days is None:
        return days.filter(F.weekday(date) == 4)
    return days.groupBy(F.date_trunc("week", date)).agg(F.max(date).alias(date)).select(date)


def entity_grid(entities: DataFrame, keys: Sequence[str], calendar: DataFrame) -> DataFrame:
    """Every entity on every day. The calendar is the small side: a row per day."""
    return entities.select(*keys).distinct().crossJoin(F.broadcast(calendar))


def fill_panel(df: DataFrame, keys: Sequence[str], date: str, values: Sequence[str], strategy: str = "forward") -> DataFrame:
    """Entity x date panel over the dates that occur, gaps filled forward, backward, with zero, or left null."""
    dates = df.select(date).distinct()
    grid = entity_grid(df, keys, dates)
    panel = grid.join(df, [*keys, date], "left")
    window = Window.partitionBy(*keys).orderBy(date)
    if strategy == "forward":
        return panel.withColumns({v: fill_forward(v, window) for v in values})
    if strategy == "backward":
        return panel.withColumns({v: fill_backward(v, window) for v in values})
    if strategy == "zero":
        return panel.fillna(0.0, subset=list(values))
    return panel


def trading_index(returns: DataFrame, date: str = "date") -> DataFrame:
    """Sorted distinct dates with their 0-based position. The ordered pass is over days only."""
    return returns.select(date).distinct().withColumn("td_idx", F.row_number().over(Window.orderBy(date)) - 1)


def first_after(dates: DataFrame, date: str, calendar: DataFrame, out: str = "td_idx") -> DataFrame:
    """`dates` with the calendar position of the first trading day strictly after each. One ordered pass over distinct days."""
    marks = dates.select(F.col(date).alias("__d")).distinct().select("__d", F.lit(0).alias("__side"), F.lit(None).cast("int").alias("__i"))
    days = calendar.select(F.col("date").alias("__d"), F.lit(-1).alias("__side"), F.col("td_idx").cast("int").alias("__i"))
    window = Window.orderBy(F.col("__d").desc(), F.col("__side").desc()).rowsBetween(Window.unboundedPreceding, 0)
    looked = days.unionByName(marks).withColumn(out, F.last("__i", ignorenulls=True).over(window)).filter("__side = 0")
    return dates.join(looked.select("__d", out), F.col(date) == F.col("__d"), "left").drop("__d")


def nth_trading_day(dates: DataFrame, date: str, calendar: DataFrame, offset: int, out: str = "nth_date") -> DataFrame:
    """The trading day at `offset` positions after each date (1 is the first one after it); null off the calendar."""
    placed = first_after(dates, date, calendar, "__first").withColumn("__want", F.col("__first") + (offset - 1))
    named = calendar.select(F.col("td_idx").alias("__want"), F.col("date").alias(out))
    return placed.join(named, "__want", "left").drop("__first", "__want")
