"""Text features of filings: cleaning, entropies, document and filing statistics, temporal and composite factors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from signalloom.functions.columns import average_rank, entropy_of, over_days, safe_div, zscore

CONJUNCTIONS = r"\b(and|or|but|because|therefore|however)\b"


def preprocess(sentences: DataFrame, text: str = "sentence_text", extended: bool = False) -> DataFrame:
    """D-40, D-41: clean text with word and character counts; extended adds unique words, punctuation and conjunctions."""
    lowered = F.regexp_replace(F.lower(F.col(text)), r"[^a-zA-Z\s]", " ")
    rows = sentences.withColumn("clean_text", F.trim(F.regexp_replace(lowered, r"\s+", " ")))
    words = F.split("clean_text", " ", -1)
    rows = rows.withColumns({"word_count": F.size(words), "char_count": F.char_length(text if extended else "clean_text")})
    if extended:
        rows = rows.withColumns(
            {"unique_word_count": F.size(F.array_distinct(words)), "punctuation_count": F.regexp_count(F.col(text), F.lit("[,;:]")), "conjunction_count": F.regexp_count(F.col(text), F.lit(CONJUNCTIONS))}
        )
    return rows


def words_of(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rows.select(*keys, F.explode(F.split("clean_text", " ", -1)).alias("word")).filter("word != ''")


def word_entropy(rows: DataFrame, keys: Sequence[str] = ("qid", "filing_date")) -> DataFrame:
    """D-42: entropy of the word distribution; counts are partial sums, so no word list is gathered."""
    counts = words_of(rows, keys).groupBy(*keys, "word").agg(F.count(F.lit(1)).alias("n"))
    return entropy_of(counts, keys, "n", "word_entropy")


def length_entropy(rows: DataFrame, keys: Sequence[str] = ("qid", "filing_date")) -> DataFrame:
    """D-42: entropy of sentence lengths in buckets of ten words."""
    counts = rows.groupBy(*keys, F.floor(F.col("word_count") / 10).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    totals = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("total_sentences"))
    return entropy_of(counts, keys, "n", "length_entropy").join(totals, list(keys))


def frequency_entropy(rows: DataFrame, keys: Sequence[str] = ("qid", "filing_date")) -> DataFrame:
    """D-42: entropy of sentences per document."""
    counts = rows.groupBy(*keys, "document_id").agg(F.count(F.lit(1)).alias("n"))
    return entropy_of(counts, keys, "n", "filing_freq_entropy").join(counts.groupBy(*keys).agg(F.count(F.lit(1)).alias("num_documents")), list(keys))


def approximate_word_entropy(rows: DataFrame, buckets: int = 10_000, keys: Sequence[str] = ("qid", "filing_date")) -> DataFrame:
    """D-47: the same with words folded into hash buckets, which bounds the groups per key."""
    bucket = F.conv(F.substring(F.md5(F.col("word").cast("binary")), 25, 8), 16, 10).cast("long") % buckets
    counts = words_of(rows, keys).groupBy(*keys, bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    return entropy_of(counts, keys, "n", "approx_word_entropy")


def document_features(rows: DataFrame, keys: Sequence[str] = ("qid", "document_id", "filing_date")) -> DataFrame:
    """D-45."""
    n = F.count(F.lit(1))
    return rows.groupBy(*keys).agg(
        n.alias("sentence_count"), F.sum("word_count").alias("total_words"), F.sum("char_count").alias("total_chars"), F.sum("unique_word_count").alias("total_unique_words"),
        F.sum("punctuation_count").alias("total_punctuation"), F.sum("conjunction_count").alias("total_conjunctions"), F.avg("word_count").alias("avg_sentence_length"),
        F.stddev_samp("word_count").alias("std_sentence_length"), F.min("word_count").alias("min_sentence_length"), F.max("word_count").alias("max_sentence_length"),
        safe_div(F.sum("unique_word_count"), F.sum("word_count")).alias("vocabulary_diversity"), safe_div(F.sum("punctuation_count"), n).alias("punctuation_per_sentence"),
        safe_div(F.sum("conjunction_count"), n).alias("conjunctions_per_sentence"),
    )


def filing_features(docs: DataFrame, keys: Sequence[str] = ("qid", "filing_date")) -> DataFrame:
    """D-46: filing statistics and the entropy (bits) of its documents' sizes, in one aggregation."""
    n = F.col("sentence_count")
    total = F.sum(n)
    entropy = F.when(F.count(F.lit(1)) > 1, F.log2(total.cast("double")) - safe_div(F.sum(n * F.log2(n.cast("double"))), total)).otherwise(F.lit(0.0))
    return docs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("document_count"), total.alias("filing_total_sentences"), F.sum("total_words").alias("filing_total_words"), F.sum("total_chars").alias("filing_total_chars"),
        entropy.alias("document_size_entropy"), F.avg("vocabulary_diversity").alias("avg_vocabulary_diversity"), F.stddev_samp("vocabulary_diversity").alias("std_vocabulary_diversity"),
        F.avg("punctuation_per_sentence").alias("filing_punctuation_complexity"), F.avg("conjunctions_per_sentence").alias("filing_conjunction_complexity"),
        F.avg("avg_sentence_length").alias("filing_avg_sentence_length"), F.avg("std_sentence_length").alias("filing_std_sentence_length"),
    )


def temporal_features(filings: DataFrame, window_days: int = 90) -> DataFrame:
    """D-48: rolling mean and deviation, change rates, cross-sectional ranks and momenta. Ranks run over all entities of a day."""
    frame, w = over_days(["qid"], "filing_date", window_days), Window.partitionBy("qid").orderBy("filing_date")
    change = lambda c: safe_div(F.col(c), F.lag(c).over(w)) - 1
    step = lambda c: F.col(c) - F.lag(c).over(w)
    return filings.withColumns(
        {
            "entropy_rolling_mean": F.avg("document_size_entropy").over(frame), "entropy_rolling_std": F.stddev_samp("document_size_entropy").over(frame),
            "diversity_rolling_mean": F.avg("avg_vocabulary_diversity").over(frame), "entropy_change_rate": change("document_size_entropy"), "diversity_change_rate": change("avg_vocabulary_diversity"),
            "entropy_cross_rank": average_rank("document_size_entropy", ["filing_date"]), "diversity_cross_rank": average_rank("avg_vocabulary_diversity", ["filing_date"]),
            "entropy_momentum": step("document_size_entropy"), "diversity_momentum": step("avg_vocabulary_diversity"),
        }
    )


ROBUST = ("information_complexity", "information_change_intensity", "information_anomaly", "information_density", "information_momentum", "relative_complexity_position", "information_volatility")


def robust_composites(rows: DataFrame) -> DataFrame:
    """D-49: the seven composite factors."""
    c = F.col
    top = F.max("entropy_cross_rank").over(Window.partitionBy("filing_date"))
    return rows.withColumns(
        {
            "information_complexity": c("document_size_entropy") * 0.3 + c("avg_vocabulary_diversity") * 0.4 + c("filing_punctuation_complexity") * 0.3,
            "information_change_intensity": F.abs("entropy_change_rate") * 0.5 + F.abs("diversity_change_rate") * 0.5,
            "information_anomaly": F.abs(c("document_size_entropy") - c("entropy_rolling_mean")) / (c("entropy_rolling_std") + 1e-10),
            "information_density": c("filing_total_words") / (c("document_count") + 1),
            "information_momentum": c("entropy_momentum") * 0.5 + c("diversity_momentum") * 0.5,
            "relative_complexity_position": safe_div(c("entropy_cross_rank"), top),
            "information_volatility": c("entropy_rolling_std"),
        }
    )


def robust_normalisation(rows: DataFrame, columns: Sequence[str] = ROBUST, date: str = "filing_date") -> DataFrame:
    """D-50: percentile rank and (x - median) / (MAD + 1e-10) of each column within the day."""
    over = Window.partitionBy(date)
    rows = rows.withColumns({f"__m_{c}": F.median(c).over(over) for c in columns})
    rows = rows.withColumns({f"__d_{c}": F.median(F.abs(F.col(c) - F.col(f"__m_{c}"))).over(over) for c in columns})
    out = {f"{c}_rank": safe_div(average_rank(c, [date]), F.count(c).over(over)) for c in columns}
    out |= {f"{c}_robust_zscore": (F.col(c) - F.col(f"__m_{c}")) / (F.col(f"__d_{c}") + 1e-10) for c in columns}
    return rows.withColumns(out).drop(*[f"__{k}_{c}" for k in "md" for c in columns])


def merge_entropies(word: DataFrame, length: DataFrame, frequency: DataFrame, semantic: DataFrame, keys: Sequence[str] = ("qid", "filing_date")) -> DataFrame:
    """D-44: the four entropies side by side, missing ones 0."""
    merged = word
    for other in (length, frequency, semantic):
        merged = merged.join(other, list(keys), "full")
    return merged.fillna(0.0).fillna(0)


def entropy_factors(merged: DataFrame, window_days: int = 90) -> DataFrame:
    """D-44: rolling statistics and composites."""
    frame, w, c = over_days(["qid"], "filing_date", window_days), Window.partitionBy("qid").orderBy("filing_date"), F.col
    change = lambda x: safe_div(c(x), F.lag(x).over(w)) - 1
    rolled = merged.withColumns(
        {
            "word_entropy_rolling_mean": F.avg("word_entropy").over(frame), "word_entropy_rolling_std": F.stddev_samp("word_entropy").over(frame),
            "length_entropy_rolling_mean": F.avg("length_entropy").over(frame), "word_entropy_change": change("word_entropy"), "length_entropy_change": change("length_entropy"),
        }
    )
    return rolled.withColumns(
        {
            "composite_entropy": c("word_entropy") * 0.4 + c("length_entropy") * 0.3 + c("semantic_entropy") * 0.3,
            "info_change_intensity": F.abs("word_entropy_change") * 0.5 + F.abs("length_entropy_change") * 0.5,
            "info_complexity": c("word_entropy") + c("filing_freq_entropy"),
            "word_entropy_anomaly": F.abs(c("word_entropy") - c("word_entropy_rolling_mean")) / (c("word_entropy_rolling_std") + 1e-10),
            "info_density": c("word_entropy") / (c("num_documents") + 1),
            "info_volatility": c("word_entropy_rolling_std"),
            "info_trend": c("word_entropy") - c("word_entropy_rolling_mean"),
        }
    )


FACTORS = ("word_entropy", "length_entropy", "filing_freq_entropy", "semantic_entropy", "composite_entropy", "info_change_intensity", "info_complexity", "info_density", "info_volatility", "info_trend")


def normalise_factors(rows: DataFrame, columns: Sequence[str] = FACTORS, date: str = "filing_date") -> DataFrame:
    """D-44: average rank and z-score (epsilon 1e-10) of each factor within the day."""
    out = {f"{c}_rank": average_rank(c, [date]) for c in columns}
    return rows.withColumns(out | {f"{c}_zscore": zscore(c, [date], 1e-10) for c in columns})
