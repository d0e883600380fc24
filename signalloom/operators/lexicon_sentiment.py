"""Lexicon sentiment of texts, and the review signal built from it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from signalloom.functions.columns import fill_forward, zscore
from signalloom.operators.ewma import irregular_ewma

#: Words that turn the polarity of what stands before them, phrases that hedge, parts of speech that count.
NEGATION_WORDS = ("ない", "なかった", "なく", "なければ", "ず", "ぬ", "ません", "ませんでした", "まい", "ざる")
HEDGE_PATTERNS = ("かもしれない", "ような気がする", "と思われる", "一概には言えない", "人によっては", "場合もある", "かもしれません", "でしょうか", "わからない", "とも言える", "かどうか")
TARGET_POS = ("名詞", "動詞", "形容詞", "副詞", "形容動詞")
#: Lexicons up to this many words are broadcast; larger ones are joined by word.
BROADCAST_WORDS = 500_000


def tokens_by_words(text):
    """Tokens of a text without a morphological analyser: runs of word characters, with no part of speech."""
    return F.transform(F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}_]+", -1), lambda w: w != ""), lambda w: F.struct(w.alias("lemma"), F.lit(None).cast("string").alias("pos")))


def score_texts(df: DataFrame, lexicon: DataFrame, text: str, key: str, tokens=None, negation: Sequence[str] = NEGATION_WORDS, hedges: Sequence[str] = HEDGE_PATTERNS, window: int = 3, prefix: str = "") -> DataFrame:
    """D-53: sentiment_score, matched_words, total_words, coverage, negation_count, hedge_score of each row.

    `tokens` is an array<struct<lemma, pos>> column (from any tokeniser); by default words. Tokens with a part of speech
    outside the counting ones are not scored; tokens without any are. A scored token is negated when one of the `window` next
    tokens is a negation. `key` identifies rows. Blank texts get nulls and zeros."""
    tokens = tokens_by_words(F.col(text)) if tokens is None else tokens
    rows = df.select(F.col(key), F.col(text).alias("__text"), F.when(F.trim(F.col(text)) != "", tokens).alias("__tok"))
    # whether a negation follows is an array beside the tokens, made by shifting: no token carries the text's array with it
    turns = F.transform("__tok", lambda t: F.coalesce(t["lemma"].isin(*negation), F.lit(False)))
    shifted = lambda k: F.slice(turns, k + 1, F.greatest(F.size("__tok"), F.lit(0)))
    ahead = shifted(1)
    for k in range(2, window + 1):
        ahead = F.zip_with(ahead, shifted(k), lambda a, b: a | F.coalesce(b, F.lit(False)))
    flagged = F.zip_with("__tok", ahead, lambda t, n: F.struct(t["lemma"].alias("word"), t["pos"].alias("pos"), F.coalesce(n, F.lit(False)).alias("__neg")))
    each = rows.select(key, F.inline(flagged))
    each = each.filter(F.col("pos").isNull() | F.col("pos").isin(*TARGET_POS)).drop("pos")
    small = lexicon.limit(BROADCAST_WORDS + 1).count() <= BROADCAST_WORDS
    found = each.join(F.broadcast(lexicon) if small else lexicon, "word", "left")
    polarity = F.when(F.col("__neg"), -F.col("score")).otherwise(F.col("score"))
    summed = found.groupBy(key).agg(
        F.avg(polarity).alias("__mean"), F.count("score").alias("__matched"), F.count(F.lit(1)).alias("__total"), F.count_if(F.col("__neg") & F.col("score").isNotNull()).alias("__negated")
    )
    length = F.char_length("__text")
    count = sum(((length - F.char_length(F.replace(F.col("__text"), F.lit(p), F.lit("")))) / len(p) for p in hedges), F.lit(0.0))
    blank = F.col("__tok").isNull()
    hedge = F.when(blank, F.lit(0.0)).otherwise(F.round(count / F.greatest(length / F.lit(50.0), F.lit(1.0)), 4))
    total, matched = F.coalesce("__total", F.lit(0)), F.coalesce("__matched", F.lit(0))
    scored = rows.withColumn("__hedge", hedge).select(key, "__hedge").join(summed, key, "left")
    out = {
        "sentiment_score": F.round(F.round("__mean", 10), 4), "matched_words": matched, "total_words": total,
        "coverage": F.when(matched > 0, F.round(matched / F.greatest(total, F.lit(1)), 4)), "negation_count": F.coalesce("__negated", F.lit(0)), "hedge_score": F.col("__hedge"),
    }
    return scored.select(key, *[c.alias(f"{prefix}{n}") for n, c in out.items()])


def score_columns(df: DataFrame, lexicon: DataFrame, columns: Sequence[str], key: str, **options) -> DataFrame:
    """Scores of several text columns, as {column}_{measure}."""
    out = df
    for c in columns:
        out = out.join(score_texts(df, lexicon, c, key, prefix=f"{c}_", **options), key)
    return out


def filter_low_quality(df: DataFrame, columns: Sequence[str], min_coverage: float = 0.05, min_matched: int = 2) -> DataFrame:
    """D-54: scores of thin evidence become null; rows stay."""
    poor = lambda c: F.col(f"{c}_coverage").isNull() | (F.col(f"{c}_coverage") < min_coverage) | (F.col(f"{c}_matched_words") < min_matched)
    return df.withColumns({f"{c}_sentiment_score": F.when(~poor(c), F.col(f"{c}_sentiment_score")) for c in columns})


def review_ewma(df: DataFrame, columns: Sequence[str], halflife_days: float = 180, company: str = "company_id", date: str = "review_date", tie: str = "review_id") -> DataFrame:
    """D-30: averages of each score per company and the running number of reviews, scored or not."""
    rows = df.withColumn("n_cumulative", F.row_number().over(Window.partitionBy(company).orderBy(date, tie)))
    for c in columns:
        rows = irregular_ewma(rows, company, date, f"{c}_sentiment_score", halflife_days, f"{c}_sentiment_score_ewma", [tie])
    return rows.select(company, date, tie, "n_cumulative", *[f"{c}_sentiment_score_ewma" for c in columns])


def expand_to_grid(ewma: DataFrame, dates: DataFrame, columns: Sequence[str], min_reviews: int = 5, max_stale_days: int = 180, match: str = "exact", company: str = "company_id", date: str = "review_date") -> DataFrame:
    """D-56: every company on every signal date: the last values, null when older than `max_stale_days`, once a company has
    `min_reviews` reviews.

    exact: only reviews dated on a signal date count (as the reference joins); asof: all reviews up to the date count. Of
    several reviews of a day the last one counts."""
    values = ["n_cumulative", *[f"{c}_sentiment_score_ewma" for c in columns]]
    last = ewma.groupBy(company, F.col(date).alias("signal_date")).agg(F.max_by(F.struct(*values), "n_cumulative").alias("__v"))
    grid = ewma.select(company).distinct().crossJoin(F.broadcast(dates.select(F.col(dates.columns[0]).alias("signal_date"))))
    if match == "exact":
        rows = grid.join(last, [company, "signal_date"], "left").withColumn("__grid", F.lit(True))
    else:
        on_grid = grid.withColumn("__grid", F.lit(True))
        rows = last.join(on_grid, [company, "signal_date"], "full")
    window = Window.partitionBy(company).orderBy("signal_date")
    seen = F.when(F.col("__v").isNotNull(), F.struct(F.col("signal_date").alias("at"), F.col("__v").alias("v")))
    rows = rows.withColumn("__last", fill_forward(seen, window)).filter("__grid")
    fresh = F.datediff("signal_date", "__last.at") <= max_stale_days
    gated = rows.filter(F.col("__last.v.n_cumulative") >= min_reviews)
    # values are held one by one: a null average is carried on by the average itself
    return gated.select(company, "signal_date", F.col("__last.v.n_cumulative").alias("n_cumulative"), *[F.when(fresh, F.col(f"__last.v.{v}")).alias(v) for v in values[1:]])


def sector_zscore(df: DataFrame, columns: Sequence[str], sector: str = "sector", date: str = "signal_date") -> DataFrame:
    """D-57: z-score (epsilon 1e-8) of each average within sector and date; a frame without sectors is returned as it is."""
    if sector not in df.columns:
        return df
    return df.withColumns({f"{c}_sentiment_score_ewma_z": zscore(f"{c}_sentiment_score_ewma", [sector, date], 1e-8) for c in columns})
