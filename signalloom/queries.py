"""The registered queries of the reference's operators, each with its DuckDB twin where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from signalloom import oracles as Q
from signalloom.adapters import cte, frame
from signalloom.operators import backtest, calendars, event_study, execution, filings, intervals, lexicon_sentiment, market_structure, pattern_density, screening, semantic, signals, text_features
from signalloom.operators.ewma import irregular_ewma
from signalloom.plans import pipelines
from signalloom.sources import lexicons
from signalloom.streaming import stateful


@dataclass(frozen=True)
class Query:
    run: Callable[[Callable[[str], DataFrame]], DataFrame]
    relations: Sequence[str]
    body: str | None
    digits: int = 6


#: Added before rounding: results of data with two decimals often lie halfway, where the last bit of a sum would decide.
NUDGE = 2.0**-30


def rounded(df: DataFrame, digits: int) -> DataFrame:
    """Doubles rounded, so that results do not depend on the order in which a sum was added up; -0 becomes 0."""
    return df.select(*[(F.round(F.col(f"`{c}`") + F.lit(NUDGE), digits) + F.lit(0.0)).alias(c) if t in ("double", "float") else F.col(f"`{c}`") for c, t in df.dtypes])


REGISTRY: dict[str, Query] = {}


def query(name: str, relations: Sequence[str] | str, body: str | None, digits: int = 6):
    def register(run):
        REGISTRY[name] = Query(run, [relations] if isinstance(relations, str) else relations, body, digits)
        return run

    return register


PNL, SECTOR, PIT, XS, EVENT = ["signals", "sector_returns"], ["reports", "sector_info"], ["snapshots", "sentiment"], ["etf_signal", "etf_returns"], ["event_signals", "stock_returns", "market_returns"]


# --- signals, PnL and metrics


@query("rolling_live_signal", "uncertainty", Q.ROLLING_LIVE)
def _(r):
    return signals.rolling_live_signal(r("uncertainty"), "value", 7)


def _weighted(r):
    return backtest.weighted_pnl(r("signals"), r("sector_returns"))


query("weighted_pnl", PNL, Q.WEIGHTED_PNL)(_weighted)
query("cum_pnl", PNL, Q.CUM_PNL)(lambda r: backtest.cumulative_pnl(_weighted(r), "weighted_return", "cum", ["sector"]))
query("strategy_metrics", PNL, Q.STRATEGY_METRICS)(lambda r: backtest.strategy_metrics(backtest.portfolio_daily(_weighted(r))))
query("rolling_sharpe", PNL, Q.ROLLING_SHARPE)(lambda r: backtest.rolling_sharpe(backtest.portfolio_daily(_weighted(r))))
query("sector_sharpe", PNL, Q.SECTOR_SHARPE)(lambda r: backtest.sector_sharpe(_weighted(r)))


def _sector(r):
    return signals.sector_sentiment_asof(r("reports"), r("sector_info"))


query("sector_sentiment_asof", SECTOR, Q.SECTOR_SENTIMENT_Q)(lambda r: _sector(r).withColumn("qids", F.array_join("qids_list", ",")).drop("qids_list"))
for _how in ("median", "sum"):  # weights known 200 days late, so that some are missing

    @query(f"sector_sentiment_{_how}", SECTOR, Q.SECTOR_LATE[_how])
    def _(r, how=_how):
        late = r("sector_info").withColumn("date", F.date_add("date", 200))
        return signals.sector_sentiment_asof(r("reports"), late, how, 0.1).withColumn("qids", F.array_join("qids_list", ",")).drop("qids_list")


for _name, _how in (("ffill", "forward"), ("bfill", "backward"), ("zero", "zero"), ("null", "null")):
    query(f"sector_panel_{_name}", SECTOR, Q.PANELS[_name])(lambda r, how=_how: calendars.fill_panel(_sector(r).select("sector", "date", "sector_sentiment"), ["sector"], "date", ["sector_sentiment"], how))


def _filled(r):
    return calendars.fill_panel(_sector(r).select("sector", "date", "sector_sentiment"), ["sector"], "date", ["sector_sentiment"], "forward")


query("signal_features", SECTOR, Q.SIGNAL_FEATURES)(lambda r: signals.signal_features(_filled(r), "sector_sentiment"))
query("sector_pivot", SECTOR, Q.SECTOR_PIVOT)(lambda r: signals.wide_pivot(_sector(r), "sector_sentiment", Q.SEGMENTS))

# --- intervals and sliding sector signals

query("intervals_observed", "snapshots", Q.INTERVALS_OBSERVED)(lambda r: intervals.intervals_observed(r("snapshots"), 120))
query("intervals_explicit", "snapshots", Q.INTERVALS_EXPLICIT)(lambda r: intervals.intervals_explicit(r("snapshots")))


@query("interval_overlaps", "snapshots", Q.INTERVAL_OVERLAPS)
def _(r):
    stretched = intervals.intervals_observed(r("snapshots"), 120).withColumn("endDate", F.date_add("endDate", 120))
    return intervals.interval_overlaps(stretched).select("sectorId", "qid", "segment_id", "startDate", "endDate", "next_start")


def _pit(r):
    return intervals.pit_join(r("sentiment"), intervals.intervals_explicit(r("snapshots")))


def _sliding(r, mode="forward"):
    return intervals.sliding_sector(_pit(r), 30, mode)


def _gated(r):
    return intervals.gated_signal(_sliding(r), 3, 0.02)


query("pit_join", PIT, Q.PIT_JOIN)(_pit)
query("sliding_sector_forward", PIT, Q.SLIDING_FORWARD)(_sliding)
query("sliding_sector_trailing", PIT, Q.SLIDING_TRAILING)(lambda r: _sliding(r, "trailing"))
query("sector_signal_daily", PIT, Q.SECTOR_DAILY)(lambda r: intervals.pit_sector_daily(r("sentiment"), r("snapshots")))
query("gated_signal", PIT, Q.GATED_SIGNAL)(lambda r: _gated(r).select("sectorId", "date", "quality", "raw_signal", "final_signal"))
query("signal_stats", PIT, Q.SIGNAL_STATS)(lambda r: intervals.signal_statistics(_gated(r)))
query("etf_sentiment", ["holdings", "doc_sentiment"], Q.ETF_SENTIMENT)(lambda r: signals.etf_sentiment(r("holdings"), r("doc_sentiment")))
query("etf_sentiment_cross", ["holdings", "doc_sentiment"], Q.ETF_CROSS)(lambda r: signals.etf_sentiment(r("holdings"), r("doc_sentiment"), by_document=False))

# --- cross-sectional backtest


def _prepared(r):
    return backtest.prepare_signal(r("etf_signal"))


def _net(r):
    return backtest.net_returns(backtest.build_positions(_prepared(r)), r("etf_returns"))


query("xs_zscore_quantile", "etf_signal", Q.XS_QUANTILE)(_prepared)
query("positions", "etf_signal", Q.POSITIONS_Q)(lambda r: backtest.build_positions(_prepared(r)).select("factset_entity_id", "date", "signal_lag", "bucket_lag", "raw_position", "weight"))
query("positions_long_only", "etf_signal", Q.LONG_ONLY_Q)(lambda r: backtest.build_positions(_prepared(r), long_short=False).select("factset_entity_id", "date", "weight"))
query("net_returns", XS, Q.NET_RETURNS)(_net)
query("ic", XS, Q.IC_Q)(lambda r: backtest.information_coefficient(_prepared(r), r("etf_returns")))
query("quantile_returns", XS, Q.QUANTILE_RETURNS)(lambda r: backtest.quantile_returns(_prepared(r), r("etf_returns")))
query("perf_stats", XS, Q.PERF_STATS)(lambda r: pipelines.run_backtest(r("etf_signal"), r("etf_returns"))["stats"])

# --- execution

for _name in Q.WEIGHTS:
    query(f"weights_{_name}", "trade_signals", Q.WEIGHTS[_name])(lambda r, m=_name: execution.signal_to_weight(r("trade_signals"), m))
query("rebalance", "trade_signals", Q.REBALANCE)(lambda r: execution.rebalance_path(execution.signal_to_weight(r("trade_signals"), "rank_linear")))


@query("rebalance_portfolios", "sector_panel", Q.REBALANCE_PORTFOLIOS)
def _(r):
    """A portfolio of nations for each market segment; portfolios are walked side by side."""
    raw = F.col("value") + 2
    weight = raw / F.sum(raw).over(Window.partitionBy("sector", "date"))
    weights = r("sector_panel").filter("value is not null").select(F.col("sector").alias("portfolio"), F.col("qid").cast("string").alias("sector_id"), "date", weight.alias("weight"))
    return execution.rebalance_path(weights, portfolio="portfolio")


@query("rebalance_step", "trade_signals", Q.REBALANCE_STEP)
def _(r):
    target = execution.signal_to_weight(r("trade_signals"), "rank_linear")
    return execution.rebalance_buffer(target, target.join(target.agg(F.min("date").alias("date")), "date", "left_semi"))


def _shares(r):
    return execution.weights_to_shares(execution.signal_to_weight(r("trade_signals")), r("prices"))


query("shares", ["trade_signals", "prices"], Q.SHARES_Q, 2)(lambda r: _shares(r).select("sector_id", "date", "shares", "notional"))
query("trades", ["trade_signals", "prices"], Q.TRADES)(lambda r: execution.trades(_shares(r)))

# --- filings, differences, sections

query("irregular_ewma", "uncertainty", Q.EWMA)(lambda r: irregular_ewma(r("uncertainty"), "qid", "date", "value", 5, "ewma"))
query("filing_delta_halfopen", "filings", Q.DELTA_HALFOPEN, 2)(lambda r: filings.filing_delta_halfopen(r("filings")))
query("filing_delta_closed", "filings", Q.DELTA_CLOSED, 2)(lambda r: filings.filing_delta_closed(r("filings")))

query("stream_irregular_ewma", "uncertainty", Q.STREAM_EWMA)(lambda r: stateful.replay(r("uncertainty"), lambda s: stateful.stream_irregular_ewma(s, "qid", "date", "value", 5, "ewma", "5 days"), "ewma_stream"))
query("stream_filing_delta", "filings", Q.STREAM_DELTA, 2)(lambda r: stateful.replay(r("filings"), stateful.stream_filing_delta, "delta_stream"))


@query("signal_asof_lookup", ["filings", "reports"], Q.ASOF_LOOKUP, 2)
def _(r):
    return filings.signal_asof(r("reports").select("qid", "date").distinct(), filings.filing_delta_halfopen(r("filings")))


query("daily_differences", "filings", Q.ALL_DIFFERENCES, 2)(lambda r: filings.daily_differences(r("filings")))
_joined = lambda df: df.withColumn("sections", F.array_join("sections", "|"))
query("rolling_sections_list", "sections", Q.SECTION_LIST)(lambda r: _joined(filings.rolling_sections_list(r("sections"))))
query("rolling_sections_distinct", "sections", Q.SECTION_DISTINCT)(lambda r: _joined(filings.rolling_sections_distinct(r("sections"))))
query("rolling_sections_grid", "sections", Q.SECTION_GRID)(lambda r: _joined(filings.rolling_sections_grid(r("sections"))))
query("rolling_sections_own_grid", "sections", Q.SECTION_GRID_OWN)(lambda r: _joined(filings.rolling_sections_grid(r("sections"), per_entity=True)))
query("window_labels", "filings", Q.WINDOW_LABELS, 2)(lambda r: filings.window_labels(r("filings")))


@query("signal_dates_exchange", "filings", Q.EXCHANGE_WEEKS)
def _(r):
    days = r("filings").select("date")
    return calendars.signal_dates(days.sparkSession, "1995-01-01", "2001-12-31", exchange_days=days)


query("rolling_sections_months", "sections", Q.SECTION_MONTHS)(lambda r: _joined(filings.rolling_sections_months(r("sections"))))
query("longterm_percentile", "panel_values", Q.LONGTERM)(lambda r: signals.longterm_percentile(r("panel_values").drop("weight")))
query("cross_section_summary", "panel_values", Q.CROSS_SECTION, 4)(lambda r: signals.cross_section_summary(r("panel_values"), ["date"]))
query("momentum", "panel_values", Q.MOMENTUM, 4)(lambda r: signals.momentum(r("panel_values").drop("weight"), days=120))

query("dispersion_structure", "sector_panel", Q.DISPERSION)(lambda r: market_structure.dispersion_structure(r("sector_panel")))
query("momentum_divergence", "sector_panel", Q.DIVERGENCE)(lambda r: market_structure.momentum_divergence(r("sector_panel"), 90))
query("breadth_index", "sector_panel", Q.BREADTH_INDEX)(lambda r: market_structure.breadth_weighted_index(r("sector_panel")))
query("precision_ranking", "reviews", Q.PRECISION)(lambda r: market_structure.precision_ranking(r("reviews").withColumnRenamed("review_date", "date"), "wlb"))
query("filing_delay", "delays", Q.FILING_DELAY)(lambda r: filings.filing_delay(r("delays")))

# --- text features


def _clean(r, extended=False):
    return text_features.preprocess(r("sentences"), extended=extended)


@query("text_preprocess", "sentences", Q.PREPROCESS)
def _(r):
    return _clean(r, True).select("qid", "document_id", "sentence_id", "clean_text", "word_count", "char_count", "unique_word_count", "punctuation_count", "conjunction_count")


def _filing(r):
    return text_features.filing_features(text_features.document_features(_clean(r, True)))


def _composites(r):
    return text_features.robust_composites(text_features.temporal_features(_filing(r)))


TEMPORAL = ("entropy_rolling_mean", "entropy_rolling_std", "diversity_rolling_mean", "entropy_change_rate", "diversity_change_rate", "entropy_cross_rank", "diversity_cross_rank", "entropy_momentum", "diversity_momentum")
query("word_entropy", "sentences", Q.WORD_ENTROPY)(lambda r: text_features.word_entropy(_clean(r)))
query("length_entropy", "sentences", Q.LENGTH_ENTROPY)(lambda r: text_features.length_entropy(_clean(r)))
query("frequency_entropy", "sentences", Q.FREQUENCY_ENTROPY)(lambda r: text_features.frequency_entropy(_clean(r)))
query("approx_word_entropy", "sentences", Q.APPROX_ENTROPY)(lambda r: text_features.approximate_word_entropy(_clean(r)))
query("doc_features", "sentences", Q.DOC_FEATURES)(lambda r: text_features.document_features(_clean(r, True)))
query("filing_features", "sentences", Q.FILING_FEATURES)(_filing)
query("temporal_features", "sentences", Q.TEMPORAL_Q, 5)(lambda r: text_features.temporal_features(_filing(r)).select("qid", "filing_date", *TEMPORAL))
query("composites", "sentences", Q.COMPOSITES_Q, 4)(lambda r: _composites(r).select("qid", "filing_date", *Q.SEVEN))


@query("robust_norm", "sentences", Q.ROBUST_NORM, 4)
def _(r):
    rows = text_features.robust_normalisation(_composites(r), Q.NORM_COLS)
    return rows.select("qid", "filing_date", *[f"{c}_{x}" for c in Q.NORM_COLS for x in ("rank", "robust_zscore")])


def _factors(r):
    """The composite factors, rounded: ranks and correlations of a factor that is constant but for rounding would be noise."""
    rows = _composites(r)
    ahead = F.lead("avg_vocabulary_diversity").over(Window.partitionBy("qid").orderBy("filing_date")) - F.col("avg_vocabulary_diversity")
    return rows.select("qid", F.trunc("filing_date", "month").alias("month"), ahead.alias("y"), *[(F.round(F.col(c) + NUDGE, 6) + 0.0).alias(c) for c in Q.SEVEN])


query("correlation_matrix", "sentences", Q.CORRELATIONS)(lambda r: screening.correlation_matrix(_factors(r), Q.SEVEN))


query("feature_screening", "sentences", Q.SCREENING)(lambda r: screening.screen_features(_factors(r), Q.SEVEN, "y", "month"))
query("semantic_entropy", "sentences", Q.SEMANTIC)(lambda r: semantic.semantic_entropy(_clean(r)))
query("entropy_engine", "sentences", Q.ENTROPY_ENGINE, 4)(lambda r: pipelines.entropy_engine(r("sentences")))
query("scalable_entropy_engine", "sentences", Q.SCALABLE_ENGINE, 4)(lambda r: pipelines.scalable_entropy_engine(r("sentences")))


@query("rolling_pca", "sentences", None)
def _(r):
    rows = r("sentences").select("qid", F.col("filing_date").alias("date"), F.col("sentence_text").alias("sentence"))
    return semantic.rolling_components(rows, calendars.daily_calendar(rows))


# --- event study


def _panel(r):
    return event_study.event_panel(r("event_signals"), r("stock_returns"), r("market_returns"), gap_days=45)


def _study(r):
    return pipelines.run_event_study(r("event_signals"), r("stock_returns"), r("market_returns"), gap_days=45)


query("min_gap_filter", EVENT, Q.MIN_GAP)(lambda r: event_study.min_gap_filter(r("event_signals"), 45).select("qid", "date", "value", "data_date"))
query("event_panel", EVENT, Q.EVENT_PANEL)(_panel)
query("event_quantiles", EVENT, Q.EVENT_QUANTILES)(lambda r: _study(r)["panel"].select("qid", "data_date", "quantile").distinct())
query("car", EVENT, Q.CAR)(lambda r: _study(r)["car"])
query("car_spread", EVENT, Q.CAR_SPREAD)(lambda r: _study(r)["spread"])
query("car_band", EVENT, Q.CAR_BAND)(lambda r: _study(r)["band"])
query("tilt_summary", EVENT, Q.TILT_SUMMARY)(lambda r: _study(r)["tilt_table"])
query("tilt_test", EVENT, Q.TILT_TEST)(lambda r: _study(r)["test"].drop("p_value", "stars"))
query("tilt_significance", EVENT, Q.TILT_SIGNIFICANCE)(lambda r: _study(r)["test"])
query("bootstrap", EVENT, Q.BOOTSTRAP)(lambda r: _study(r)["bootstrap"])

# --- lexicons and reviews


def _lexicon(r):
    return lexicons.domain_lexicon(r("reviews").sparkSession, Q.LEX)


def _scored(r):
    return lexicon_sentiment.score_columns(r("reviews"), _lexicon(r), ["wlb"], "review_id", negation=Q.NEGATIONS, hedges=Q.HEDGES)


def _kept(r):
    return lexicon_sentiment.filter_low_quality(_scored(r), ["wlb"])


def _ewma(r):
    return lexicon_sentiment.review_ewma(_kept(r), ["wlb"])


def _grid(r, match):
    dates = calendars.signal_dates(r("reviews").sparkSession, "2020-01-01", "2022-06-30")
    return lexicon_sentiment.expand_to_grid(_ewma(r), dates, ["wlb"], match=match)


query("lexicon_score", "reviews", Q.LEXICON_SCORE, 4)(lambda r: _scored(r).drop("company_id", "sector", "review_date", "wlb"))
query("quality_filter", "reviews", Q.QUALITY_FILTER, 4)(lambda r: _kept(r).select("review_id", "wlb_sentiment_score"))
query("review_ewma", "reviews", Q.REVIEW_EWMA)(_ewma)
query("signal_grid_exact", "reviews", Q.SIGNAL_GRID["exact"])(lambda r: _grid(r, "exact"))
query("signal_grid_asof", "reviews", Q.SIGNAL_GRID["asof"])(lambda r: _grid(r, "asof"))


def _densities(r, *keep):
    return pattern_density.pattern_density(r("reviews"), "wlb", Q.PATTERNS, keep)


query("pattern_density", "reviews", Q.PATTERN_DENSITY)(lambda r: _densities(r, "review_id"))


@query("policy_signals", "reviews", Q.POLICY_SIGNALS)
def _(r):
    rows = pattern_density.temporal_orientation(_densities(r, "review_id", "company_id", "review_date"), "future_count", "past_count")
    for value, out in (("policy_density", "policy_ratio"), ("orientation", "orientation_ratio")):
        rows = pattern_density.against_history(rows, "company_id", "review_date", value, out)
    rows = pattern_density.density_rank(rows, "review_date", "policy_density", "policy_rank")
    return rows.select("review_id", "company_id", "review_date", "policy_density", "orientation", "policy_ratio", "orientation_ratio", "policy_rank")


@query("review_pipeline", "review_texts", Q.REVIEW_PIPELINE)
def _(r):
    reviews = r("review_texts")
    dates = calendars.signal_dates(reviews.sparkSession, "2020-01-01", "2022-06-30")
    lexicon = lexicons.domain_lexicon(reviews.sparkSession, Q.LEX)
    return pipelines.review_pipeline(reviews, lexicon, dates, Q.REVIEW_COLUMNS, negation=Q.NEGATIONS, hedges=Q.HEDGES)


@query("sector_zscore", "reviews", Q.SECTOR_Z, 4)
def _(r):
    rows = _kept(r).withColumnRenamed("wlb_sentiment_score", "wlb_sentiment_score_ewma").withColumnRenamed("review_date", "signal_date")
    return lexicon_sentiment.sector_zscore(rows, ["wlb"]).select("review_id", "sector", F.col("wlb_sentiment_score_ewma_z").alias("z"))


def _tables(r, name):
    return r(f"table:{name}")


@query("lexicon_merge", [], Q.LEXICON_MERGE)
def _(r):
    one = _tables(r, "region").select(F.col("r_name").alias("word"), F.lit(0.5).alias("score"))
    two = _tables(r, "nation").select(F.col("n_name").alias("word"), F.lit(-0.5).alias("score"))
    three = _tables(r, "customer").select(F.col("c_mktsegment").alias("word"), F.lit(0.1).alias("score")).distinct()
    extra = three.sparkSession.createDataFrame([("ASIA", -1.0), ("CHINA", 1.0)], "word string, score double")
    return lexicons.merge_lexicons([one, two, three.unionByName(extra)])


@query("lexicon_fold", [], Q.LEXICON_FOLD)
def _(r):
    rows = _tables(r, "orders").select(F.col("o_orderpriority").alias("word"), F.col("o_orderkey").alias("position"), F.round(F.col("o_totalprice") / 1000, 3).alias("score"))
    return lexicons.fold_duplicates(rows)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(q: Query):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            def relation(name: str) -> DataFrame:
                return spark.read.parquet(f"{sf_dir}/{name[6:]}.parquet") if name.startswith("table:") else frame(spark, sf_dir, name)

            return rounded(q.run(relation), q.digits)

        return run

    return {name: bind(q) for name, q in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    """Twins whose doubles are rounded like the queries'."""
    return {name: _rounded_sql(q, Q.DOUBLES.get(name, "")) for name, q in REGISTRY.items() if q.body is not None}


def _rounded_sql(q: Query, doubles: str) -> str:
    head = cte(*q.relations) if q.relations else "WITH RECURSIVE unused AS (SELECT 1)"
    body = f"{head}{q.body}"
    if not doubles:
        return body
    return f"SELECT * REPLACE ({', '.join(f'round({c} + {NUDGE!r}::DOUBLE, {q.digits}) + 0.0::DOUBLE AS {c}' for c in doubles.split())}) FROM ({body}) result"
