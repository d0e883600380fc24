"""Whole studies as lazy compositions of the operators."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame

from signalloom.operators import backtest, event_study, intervals, lexicon_sentiment, semantic, text_features
from signalloom.sources.shared import materialise


@dataclass(frozen=True)
class BacktestConfig:
    signal_lag: int = 1
    holding_period: int = 5
    long_short: bool = True
    n_quantiles: int = 5
    min_coverage: float = 0.1
    cost: float = 0.001


def run_backtest(signal: DataFrame, returns: DataFrame, config: BacktestConfig = BacktestConfig()) -> dict[str, DataFrame]:
    prepared = backtest.prepare_signal(signal, config.min_coverage, config.n_quantiles, config.signal_lag, config.holding_period)
    positions = backtest.build_positions(prepared, config.n_quantiles, config.long_short)
    daily = backtest.net_returns(positions, returns, config.cost)
    ic = backtest.information_coefficient(prepared, returns)
    return {"positions": positions, "returns": daily, "ic": ic, "quantiles": backtest.quantile_returns(prepared, returns), "stats": backtest.performance_stats(daily, ic, config.cost)}


def run_event_study(events: DataFrame, returns: DataFrame, market: DataFrame, pre: int = event_study.PRE, short: int = event_study.SHORT, long: int = event_study.LONG, n: int = event_study.QUANTILES, gap_days: int = event_study.GAP) -> dict[str, DataFrame]:
    """The panel is written once; every frame of the study is derived from it."""
    panel = materialise(event_study.assign_quantiles(materialise(event_study.event_panel(events, returns, market, pre, long, gap_days), "panel"), n), "quantiles")
    curves, tilts = event_study.car(panel), event_study.event_tilts(panel, short, long)
    table = event_study.tilt_by_quantile(tilts)
    return {
        "panel": panel, "car": curves, "spread": event_study.car_spread(curves, f"Q{n}"), "band": event_study.car_band(curves), "tilts": tilts, "tilt_table": table,
        "test": event_study.tilt_test(table, f"Q{n}"), "bootstrap": event_study.bootstrap_spread(tilts, "tilt_long", f"Q{n}"),
    }


def sector_signal(sentiment: DataFrame, snapshots: DataFrame, lookback_days: int = 30, min_companies: int = 3, min_coverage: float = 0.2, halflife_days: float = 7.0, gap_days: int = 60, end: str = "observed", mode: str = "forward") -> DataFrame:
    held = intervals.intervals_observed(snapshots, gap_days) if end == "observed" else intervals.intervals_explicit(snapshots)
    sliding = intervals.sliding_sector(intervals.pit_join(sentiment, held), lookback_days, mode)
    return intervals.gated_signal(sliding, min_companies, min_coverage, halflife_days)


def entropy_engine(sentences: DataFrame, window_days: int = 90) -> DataFrame:
    """Word, length, frequency and semantic entropy, merged, rolled, combined and normalised."""
    rows = text_features.preprocess(sentences)
    merged = text_features.merge_entropies(text_features.word_entropy(rows), text_features.length_entropy(rows), text_features.frequency_entropy(rows), semantic.semantic_entropy(rows))
    return text_features.normalise_factors(text_features.entropy_factors(merged, window_days))


def scalable_entropy_engine(sentences: DataFrame, window_days: int = 90, buckets: int = 10_000) -> DataFrame:
    """The chunked engine as one plan: partitions are the chunks, and ranks run over all entities."""
    rows = text_features.preprocess(sentences, extended=True)
    filings = text_features.filing_features(text_features.document_features(rows))
    filings = filings.join(text_features.approximate_word_entropy(rows, buckets), ["qid", "filing_date"], "left").fillna(0.0)
    return text_features.robust_normalisation(text_features.robust_composites(text_features.temporal_features(filings, window_days)))


def review_pipeline(reviews: DataFrame, lexicon: DataFrame, dates: DataFrame, columns: Sequence[str] = ("wlb", "long_term_development", "reason_to_quit"), key: str = "review_id", match: str = "exact", **scoring) -> DataFrame:
    scored = lexicon_sentiment.filter_low_quality(lexicon_sentiment.score_columns(reviews, lexicon, columns, key, **scoring), columns)
    ewma = lexicon_sentiment.review_ewma(scored, columns, tie=key)
    return lexicon_sentiment.sector_zscore(lexicon_sentiment.expand_to_grid(ewma, dates, columns, match=match), columns)
