"""How sectors stand to one another and to the market: dispersion, divergence, breadth, precision of their texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from signalloom.functions.columns import average_rank, over_days, safe_div

#: A number: digits, with points or commas between digits.
NUMBER = r"[0-9]+([.,][0-9]+)*"
WORD = r"[^ \t\n\x0B\f\r]+"


def sector_days(df: DataFrame, sector: str = "sector", date: str = "date", value: str = "value") -> DataFrame:
    """(sector, date): mean, sample deviation, number and breadth (share above 0) of the entities' values."""
    x = F.col(value)
    return df.filter(x.isNotNull()).groupBy(sector, date).agg(
        F.avg(x).alias("signal"), F.stddev_samp(x).alias("spread"), F.count(x).alias("n"), safe_div(F.count_if(x > 0).cast("double"), F.count(x)).alias("breadth")
    )


def dispersion_structure(df: DataFrame, sector: str = "sector", date: str = "date", value: str = "value") -> DataFrame:
    """date, within, cross, ratio, n_sectors: the mean deviation inside sectors beside the deviation of the sectors' means.
    Sectors with one value have no deviation and count for the means only."""
    rows = sector_days(df, sector, date, value).groupBy(date).agg(F.avg("spread").alias("within"), F.stddev_samp("signal").alias("cross"), F.count(F.lit(1)).alias("n_sectors"))
    return rows.withColumn("ratio", safe_div(F.col("within"), F.col("cross")))


def momentum_divergence(df: DataFrame, days: int = 30, sector: str = "sector", date: str = "date", value: str = "value") -> DataFrame:
    """sector, date, momentum, index_momentum, divergence: a sector's signal less its mean over the `days` days before, against
    the same of the index of all entities."""
    own = sector_days(df, sector, date, value).select(sector, date, "signal")
    own = own.withColumn("momentum", F.col("signal") - F.avg("signal").over(over_days([sector], date, days, "left")))
    index = df.filter(F.col(value).isNotNull()).groupBy(date).agg(F.avg(value).alias("__index"))
    past = F.avg("__index").over(Window.orderBy(F.datediff(date, F.lit("1970-01-01").cast("date"))).rangeBetween(-days, -1))  # a row per day
    index = index.withColumn("index_momentum", F.col("__index") - past).drop("__index")
    return own.join(F.broadcast(index), date).select(sector, date, "momentum", "index_momentum", (F.col("momentum") - F.col("index_momentum")).alias("divergence"))


def breadth_weighted_index(df: DataFrame, sector: str = "sector", date: str = "date", value: str = "value") -> DataFrame:
    """date, index_signal, normalised: the sum of the sectors' signals times their breadth, and that by the sum of breadths."""
    rows = sector_days(df, sector, date, value).groupBy(date).agg(F.sum(F.col("signal") * F.col("breadth")).alias("index_signal"), F.sum("breadth").alias("__b"))
    return rows.select(date, "index_signal", safe_div(F.col("index_signal"), F.col("__b")).alias("normalised"))


def precision_ranking(df: DataFrame, text: str, sector: str = "sector", date: str = "date") -> DataFrame:
    """sector, date, n_numbers, n_words, density, precision_rank: numbers by words in a sector's texts of a day, and its rank
    among the sectors of the day, the most precise first. Texts without words leave the density null and the rank with it."""
    body = F.col(text)
    rows = df.groupBy(sector, date).agg(F.coalesce(F.sum(F.regexp_count(body, F.lit(NUMBER))), F.lit(0)).alias("n_numbers"), F.coalesce(F.sum(F.regexp_count(body, F.lit(WORD))), F.lit(0)).alias("n_words"))
    rows = rows.withColumn("density", safe_div(F.col("n_numbers").cast("double"), F.col("n_words")))
    return rows.withColumn("precision_rank", average_rank("density", [date], descending=True))
