"""Worked examples with known results."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from signalloom import adapters, queries
from signalloom.functions import columns as C
from signalloom.operators import backtest, calendars, event_study, execution, filings, intervals, lexicon_sentiment, semantic, signals
from signalloom.operators.asof import asof_backward
from signalloom.operators.ewma import irregular_ewma
from signalloom.sources import io, lexicons
from signalloom.streaming.sliding import stream_sector_signal


def d(text):
    return dt.date.fromisoformat(text)


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


HALF = [("doc1", 100, "2023-01-01"), ("doc2", 120, "2023-03-01"), ("doc3", 110, "2023-05-01"), ("doc4", 130, "2023-07-01"), ("doc5", 125, "2023-09-01")]


def halfopen(spark):
    rows = [("A", a, float(b), d(c)) for a, b, c in HALF]
    return filings.filing_delta_halfopen(frame(spark, rows, "qid string, document_id string, length double, date date"))


def test_halfopen_events(spark):
    got = {(r.date.isoformat(), r.signal) for r in halfopen(spark).collect()}
    assert got == {("2023-01-01", None), ("2023-03-01", 20), ("2023-05-01", -10), ("2023-07-01", 20), ("2023-09-01", -5), ("2023-12-28", None), ("2024-02-28", None)}


def test_asof_lookup(spark):
    want = {"2023-01-15": None, "2023-03-15": 20, "2023-05-15": -10, "2023-07-15": 20, "2023-08-01": 20, "2023-09-01": -5, "2023-09-15": -5, "2023-10-01": -5, "2024-01-01": None, "2024-03-01": None}
    queries = frame(spark, [("A", d(x)) for x in want], "qid string, date date")
    assert {r.date.isoformat(): r.signal for r in filings.signal_asof(queries, halfopen(spark)).collect()} == want


def test_closed_events(spark):
    rows = [("A", "d1", 100.0, d("2023-01-01")), ("A", "d2", 120.0, d("2023-04-01")), ("A", "d3", 110.0, d("2023-10-01"))]
    got = filings.filing_delta_closed(frame(spark, rows, "qid string, document_id string, length double, date date")).orderBy("date").collect()
    assert [(r.date.isoformat(), r.signal, r.n_filings_in_window) for r in got] == [("2023-04-01", 20, 2), ("2023-07-01", None, 1)]


def test_daily_differences(spark):
    rows = [(1, "2024-01-01", 2), (1, "2024-07-01", 5), (1, "2024-08-06", 3), (1, "2024-09-15", 6), (2, "2024-02-01", 10), (2, "2024-06-15", 15), (2, "2024-10-01", 12)]
    records = frame(spark, [(q, d(x), float(n)) for q, x, n in rows], "qid long, date date, length double")
    out = filings.daily_differences(records, "2024-08-01", "2024-10-15")
    assert out.count() == 152
    got = {(r.qid, r.date.isoformat()): (r.length, r.diff_vs_previous, r.diff_vs_avg_previous) for r in out.collect()}
    assert got[1, "2024-08-10"] == (3, -2, -2)
    assert got[1, "2024-09-11"] == (3, -2, -2)
    assert got[1, "2024-09-15"] == (6, 3, 2)
    assert got[1, "2024-10-01"] == (6, 3, 2)
    assert got[2, "2024-10-01"] == (12, -3, -3)


def test_daily_differences_cover_every_day_of_the_data(spark, sf_dir, duck):
    records = frame(spark, [(1, d("2024-01-01"), 2.0), (2, d("2024-01-03"), 5.0), (1, d("2024-12-31"), 3.0)], "qid long, date date, length double")
    got = filings.daily_differences(records).collect()
    assert len(got) == 2 * 366 and (min(r.date for r in got), max(r.date for r in got)) == (d("2024-01-01"), d("2024-12-31"))
    # the registered query: all days, and on the days that the SQL has, the SQL's rows
    query = queries.queries()["daily_differences"](spark, sf_dir).select("qid", "date", "length", "diff_vs_previous", "diff_vs_avg_previous")
    first, last, entities = duck.execute("SELECT min(o_orderdate)::DATE, max(o_orderdate)::DATE, count(DISTINCT o_custkey) FROM orders").fetchone()
    assert query.count() == entities * ((last - first).days + 1)
    sql = queries._rounded_sql(queries.Query(None, ["filings"], queries.Q.DAILY_DIFFERENCES, 2), queries.Q.DOUBLES["daily_differences"])
    plain = lambda rows: sorted((str(tuple(r)) for r in rows))
    theirs = plain(duck.execute(f"SELECT qid, date, length, diff_vs_previous, diff_vs_avg_previous FROM ({sql})").fetchall())
    assert theirs and plain(query.filter("date between '1997-01-01' and '1997-03-31'").collect()) == theirs


def test_etf_sentiment_uses_all_snapshots_and_falls_back_to_the_first(spark, sf_dir, duck):
    held = frame(spark, [("E", 1, 2.0, d("2024-04-01")), ("E", 2, 6.0, d("2024-04-01")), ("E", 1, 5.0, d("2024-07-01"))], "factset_entity_id string, qid long, shares double, report_date date")
    docs = frame(spark, [(1, d("2024-01-05"), 7, 1.0, 1), (2, d("2024-01-05"), 7, 0.0, 1), (1, d("2024-08-01"), 8, 0.5, 1)], "qid long, date date, document_id long, sentiment double, numOfSentences int")
    got = {r.document_id: (r.etf_sentiment, r.covered_shares) for r in signals.etf_sentiment(held, docs).collect()}
    assert got == {7: (0.25, 8.0), 8: (0.5, 5.0)}  # document 7 is older than every snapshot
    quarters = {r[0] for r in adapters.frame(spark, sf_dir, "holdings").select("report_date").distinct().collect()}
    assert quarters == {r[0] for r in duck.execute("SELECT DISTINCT date_trunc('quarter', o_orderdate)::DATE FROM orders").fetchall()}


def test_sector_intervals_and_pit(spark):
    snapshots = [(1, "A", "2024-01-01", 0.4), (1, "B", "2024-01-01", 0.4), (1, "C", "2024-01-01", 0.2), (1, "A", "2024-02-01", 0.3), (1, "B", "2024-02-01", 0.3), (1, "C", "2024-02-01", 0.2), (1, "D", "2024-02-01", 0.2), (2, "C", "2024-01-01", 0.6), (2, "D", "2024-01-01", 0.4), (2, "A", "2024-01-01", 0.0)]
    held = intervals.intervals_observed(frame(spark, [(a, b, d(c), w) for a, b, c, w in snapshots], "sectorId long, qid string, date date, weight double"))
    got = {(r.sectorId, r.qid, r.startDate.isoformat(), r.endDate.isoformat(), r.weight) for r in held.collect()}
    assert (1, "C", "2024-01-01", "2024-02-01", 0.2) in got and (1, "A", "2024-01-01", "2024-01-01", 0.4) in got and len(got) == 8
    sentiment = frame(spark, [("C", "doc6", d("2024-01-20"), 0.2), ("A", "doc1", d("2024-01-20"), 0.5)], "id string, documentid string, date date, sentiment double")
    assert [(r.sectorId, r.id, r.documentid, r.weight) for r in intervals.pit_join(sentiment, held).collect()] == [(1, "C", "doc6", 0.2)]
    assert intervals.interval_overlaps(held).count() == 0


def test_explicit_ends_join_up(spark):
    rows = [(1, "A", d("2024-01-01"), 0.4), (1, "A", d("2024-02-01"), 0.3), (1, "A", d("2024-03-01"), 0.3)]
    got = intervals.intervals_explicit(frame(spark, rows, "sectorId long, qid string, date date, weight double")).orderBy("startDate").collect()
    assert [(r.startDate.isoformat(), r.endDate.isoformat()) for r in got] == [("2024-01-01", "2024-01-31"), ("2024-02-01", "2099-12-31")]


@pytest.mark.parametrize("halflife, years", [(30, 2), (1, 40), (5, 40), (7, 40), (180, 40)])
def test_ewma_equals_the_loop(spark, halflife, years):
    rng = random.Random(halflife)
    rows, day, i = [], dt.date(1985, 1, 1), 0
    while day < dt.date(1985 + years, 1, 1):
        rows.append(("a", day, i, None if rng.random() < 0.3 else rng.uniform(-1, 1)))
        day, i = day + dt.timedelta(days=rng.choice([0, 1, 3, 20, 60, 900 if years > 2 else 20])), i + 1
    got = [r.e for r in irregular_ewma(frame(spark, rows, "k string, date date, i int, v double"), "k", "date", "v", halflife, "e", ["i"]).orderBy("i").collect()]
    assert not any(e is not None and math.isnan(e) for e in got)
    state, last, rate = None, None, math.log(2) / halflife
    for (_, at, _, v), mine in zip(rows, got, strict=True):
        if v is not None:
            if state is None:
                state = v
            else:
                a = 1 - math.exp(-rate * (at - last).days)
                state = a * v + (1 - a) * state
            last = at
        assert (mine is None) == (state is None)
        assert state is None or abs(mine - state) < 1e-12


def test_asof_keeps_null_payloads_and_early_rows(spark):
    left = frame(spark, [("a", d("2024-01-01")), ("a", d("2024-01-05")), ("b", d("2024-01-05"))], "k string, date date")
    right = frame(spark, [("a", d("2024-01-02"), 1.0), ("a", d("2024-01-04"), None)], "k string, at date, x double")
    assert {(r.k, r.date.day): r.x for r in asof_backward(left, right, ["k"], "date", "at", ["x"]).collect()} == {("a", 1): None, ("a", 5): None, ("b", 5): None}
    right = right.filter("x is not null")
    assert {(r.k, r.date.day): r.x for r in asof_backward(left, right, ["k"], "date", "at", ["x"]).collect()}[("a", 5)] == 1.0


def test_weights_sum_to_one_and_cap(spark):
    rows = [(str(i), d("2024-01-01"), float(i)) for i in range(10)]
    df = frame(spark, rows, "sector_id string, date date, signal_value double")
    for method in ("topn", "zscore", "rank_linear"):
        total = execution.signal_to_weight(df, method).agg(F.sum("weight")).first()[0]
        assert abs(total - 1) < 1e-12


def test_rebalance_path_equals_steps(spark):
    rng = random.Random(4)
    rows = [(s, dt.date(2024, 1, 1) + dt.timedelta(days=i), rng.uniform(-1, 1)) for i in range(12) for s in "abcde"]
    weights = execution.signal_to_weight(frame(spark, rows, "sector_id string, date date, signal_value double"), "rank_linear")
    path = {(r.date, r.sector_id): r.weight for r in execution.rebalance_path(weights).collect()}
    target = {(r.date, r.sector_id): r.weight for r in weights.collect()}
    prev = {}
    for day in sorted({k[0] for k in target}):
        new = {s: target[day, s] if abs(target[day, s] - prev.get(s, 0)) > 0.02 else prev.get(s, 0) for s in "abcde"}
        prev = {s: v / sum(new.values()) for s, v in new.items()}
        assert all(abs(prev[s] - path[day, s]) < 1e-9 for s in prev)


def test_trades_with_and_without_liquidation(spark):
    rows = [("a", d("2024-01-01"), 5), ("b", d("2024-01-01"), 3), ("a", d("2024-01-02"), 7)]
    shares = frame(spark, rows, "sector_id string, date date, shares long")
    kept = {(r.sector_id, r.date.day): (r.trade_shares, r.side) for r in execution.trades(shares).collect()}
    assert kept == {("a", 1): (5, "BUY"), ("b", 1): (3, "BUY"), ("a", 2): (2, "BUY")}
    assert execution.trades(shares, liquidate=True).filter("sector_id = 'b' and side = 'SELL'").count() == 1


def test_min_gap_is_greedy(spark):
    days = [0, 10, 20, 35, 64, 65, 100]
    rows = [("a", d("2024-01-01"), float(i), dt.date(2024, 1, 1) + dt.timedelta(days=x)) for i, x in enumerate(days)]
    kept = event_study.min_gap_filter(frame(spark, rows, "qid string, date date, value double, data_date date"), 30)
    assert sorted((r.data_date - dt.date(2024, 1, 1)).days for r in kept.collect()) == [0, 35, 65, 100]


def test_duplicate_edges_give_no_quantile(spark):
    rows = [(str(i), d("2024-01-01"), 1.0) for i in range(5)] + [(str(i), d("2024-02-01"), float(i)) for i in range(5)]
    out = event_study.assign_quantiles(frame(spark, rows, "qid string, data_date date, value double"))
    assert {(r.data_date.month, r.quantile) for r in out.collect()} == {(1, "Q_NA"), *((2, f"Q{i}") for i in range(1, 6))}


def test_p_values():
    assert abs(event_study.t_p_value(2.0, 10) - 0.07338803477074037) < 1e-9
    assert abs(event_study.t_p_value(0.0, 5) - 1) < 1e-12
    assert event_study.t_p_value(None, 5) is None


def test_nth_trading_day(spark):
    calendar = calendars.trading_index(frame(spark, [(d("2024-01-02"),), (d("2024-01-03"),), (d("2024-01-05"),)], "date date"))
    got = calendars.nth_trading_day(frame(spark, [(d("2024-01-02"),), (d("2024-01-05"),)], "q date"), "q", calendar, 2)
    assert {r.q.day: r.nth_date and r.nth_date.day for r in got.collect()} == {2: 5, 5: None}


def test_average_rank_and_constant_correlation(spark):
    df = frame(spark, [("x", 1.0, 1.0), ("x", 1.0, 2.0), ("x", 3.0, 3.0), ("x", None, 4.0), ("y", 2.0, 2.0), ("y", 2.0, 5.0)], "k string, v double, w double")
    ranks = [r[0] for r in df.filter("k = 'x'").select(C.average_rank("v", ["k"]).alias("r")).collect()]
    assert sorted(ranks, key=lambda x: (x is None, x)) == [1.5, 1.5, 3.0, None]
    got = {r.k: r.c for r in df.groupBy("k").agg(C.correlation(F.col("v"), F.col("w")).alias("c")).collect()}
    assert got["y"] is None and abs(got["x"] - np.corrcoef([1, 1, 3], [1, 2, 3])[0, 1]) < 1e-12


def test_live_signal_has_only_weekdays(spark):
    rows = [("a", d("2024-01-01"), 1.0), ("a", d("2024-01-09"), 3.0)]
    out = signals.rolling_live_signal(frame(spark, rows, "qid string, date date, x double"), "x", 3).orderBy("date").collect()
    assert len(out) == 7 and all(r.date.weekday() < 5 for r in out)
    assert [r.rolling_count for r in out] == [1, 1, 1, 0, 0, 0, 1] and out[3].rolling_sum is None and out[3].rolling_mean is None


def test_strategy_metrics(spark):
    daily = frame(spark, [(d("2024-01-01"), 0.1), (d("2024-01-02"), -0.5), (d("2024-01-03"), 0.2)], "date date, portfolio_return double")
    r = backtest.strategy_metrics(daily).first()
    x = np.array([0.1, -0.5, 0.2])
    assert abs(r.sharpe - x.mean() / x.std(ddof=1) * math.sqrt(252)) < 1e-12
    assert abs(r.max_drawdown + 0.5) < 1e-12 and abs(r.total_return - (1.1 * 0.5 * 1.2 - 1)) < 1e-12


def test_semantic_entropy_equals_dense_vectors(spark):
    texts = ["alpha beta gamma", "alpha beta delta delta", "", "omega psi", "alpha beta gamma"]
    rows = [("q", dt.date(2024, 1, 1) + dt.timedelta(days=i), t) for i, t in enumerate(texts)]
    got = [r.semantic_entropy for r in semantic.semantic_entropy(frame(spark, rows, "qid string, filing_date date, clean_text string")).orderBy("filing_date").collect()]
    terms = [[*(w := t.split()), *map(" ".join, zip(w, w[1:], strict=False))] for t in texts]
    vocabulary = sorted({x for t in terms for x in t})
    n = sum(map(bool, terms))
    idf = np.array([math.log((1 + n) / (1 + sum(v in t for t in terms))) + 1 for v in vocabulary])
    vectors = [np.array([t.count(v) for v in vocabulary]) * idf for t in terms]
    for i, mine in enumerate(got):
        js = []
        for j in range(max(0, i - 5), i):
            if terms[i] and terms[j]:
                p, q = vectors[i] / vectors[i].sum(), vectors[j] / vectors[j].sum()
                m = (p + q) / 2
                kl = lambda a, m=m: sum(x * math.log(x / y) for x, y in zip(a, m, strict=True) if x > 0)
                js.append(math.sqrt(max(0, (kl(p) + kl(q)) / 2)))
        assert abs(mine - (np.mean(js) if js else 0)) < 1e-7


def test_components_have_falling_variance():
    x = np.random.default_rng(1).normal(size=(8, 20))
    got = semantic.principal(x, 3)
    assert np.all(np.diff(got.var(0)) <= 1e-9) and np.allclose(got.mean(0), 0)
    _, s, _ = np.linalg.svd(x - x.mean(0))
    assert np.allclose(np.linalg.norm(got, axis=0), s[:3])


def test_lexicon_files(spark, tmp_path):
    (tmp_path / "colon.dic").write_bytes("良い:よい:形容詞:0.9\n悪い:わるい:形容詞:-0.8\n良い:いい:形容詞:0.5\n良い:x:形容詞:0.1\n短い\n".encode("cp932"))
    got = {r.word: r.score for r in lexicons.colon_lexicon(spark, str(tmp_path / "colon.dic")).collect()}
    assert got == pytest.approx({"良い": ((0.9 + 0.5) / 2 + 0.1) / 2, "悪い": -0.8})
    (tmp_path / "a").write_text("良い\tn\n普通\te\n成長\tn\n")
    (tmp_path / "b").write_text("良い\tp\n変\t?\n")
    tab = lexicons.tab_lexicons(spark, [str(tmp_path / "a"), str(tmp_path / "b")])
    assert {r.word: r.score for r in tab.collect()} == {"良い": 1.0, "普通": 0.0, "変": 0.0, "成長": -1.0}
    merged = {r.word: r.score for r in lexicons.load_merged(spark, lexicons.colon_lexicon(spark, str(tmp_path / "colon.dic")), tab, "tohoku").collect()}
    assert merged["良い"] == 1.0 and merged["悪い"] == -0.8 and merged["成長"] == 0.6
    (tmp_path / "c").write_text("# note\n良い\tp\t0.3\n悪い\tn\tzz\n")
    assert {r.word: r.score for r in lexicons.scored_lexicon(spark, str(tmp_path / "c")).collect()} == {"良い": 0.3, "悪い": -1.0}


def test_review_scores_negate_and_blank(spark):
    lexicon = lexicons.domain_lexicon(spark, {"good": 1.0, "bad": -0.5})
    rows = frame(spark, [(1, "good day not"), (2, "good one two three not"), (3, "  "), (4, None), (5, "nothing here"), (6, "bad bad good")], "id long, t string")
    got = {r.id: r for r in lexicon_sentiment.score_texts(rows, lexicon, "t", "id", negation=("not",), hedges=("here",)).collect()}
    assert got[1].sentiment_score == -1.0 and got[1].negation_count == 1
    assert got[2].sentiment_score == 1.0 and got[2].negation_count == 0
    assert got[3].sentiment_score is None and got[4].matched_words == 0 and got[4].hedge_score == 0
    assert got[5].coverage is None and got[5].total_words == 2 and got[5].hedge_score == 1.0
    assert got[6].sentiment_score == 0.0 and got[6].coverage == 1.0


def test_result_cache_and_csv(spark, tmp_path):
    df = io.from_columns(spark, {"a": [1, 2], "b": ["x", None]}, "a long, b string")
    root = f"file://{tmp_path}/cache"
    assert io.cache_result(df, root, "k1").count() == 2
    assert io.cache_result(df.limit(0), root, "k1").count() == 0
    assert io.cache_info(spark, root)["files"] > 0
    io.clear_cache(spark, root)
    assert io.cache_info(spark, root)["files"] == 0
    io.write_csv(df, f"{tmp_path}/csv")
    assert io.read_csv(spark, f"{tmp_path}/csv", "a long, b string").orderBy("a").collect() == df.orderBy("a").collect()


def test_result_cache_follows_plan_and_files(spark, tmp_path):
    data, root = f"{tmp_path}/data", f"file://{tmp_path}/cache"
    spark.range(10).coalesce(1).write.parquet(data)
    asked = lambda limit: io.cache_result(spark.read.parquet(data).filter(F.col("id") < limit), root)
    files = lambda: io.cache_info(spark, root)["files"]
    assert asked(5).count() == 5
    once = files()
    assert asked(5).count() == 5 and files() == once  # an equal plan built anew reads
    assert asked(6).count() == 6 and files() > once  # a changed parameter
    twice = files()
    spark.range(3).coalesce(1).write.mode("append").parquet(data)  # a changed input
    assert asked(5).count() == 8 and files() > twice
    assert io.cache_result(spark.read.parquet(data).filter(F.col("id") < 5), root, "other").count() == 8


def test_streaming_windows(spark, tmp_path):
    schema = "ts timestamp, sectorId string, sentiment double, weight double, weighted_sentiment double"
    frame(spark, [(dt.datetime(2024, 1, 10), "s", 0.5, 2.0, 1.0)], schema).write.parquet(f"{tmp_path}/in")
    out = stream_sector_signal(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), window="3 days")
    run = out.writeStream.format("memory").queryName("sliding").outputMode("complete").option("checkpointLocation", f"{tmp_path}/cp").start()
    run.processAllAvailable()
    run.stop()
    assert {(r.sector_sentiment, r.n_docs) for r in spark.table("sliding").collect()} == {(0.5, 1)} and spark.table("sliding").count() == 3


def test_rolling_pca_answers_every_day(spark, sf_dir):
    sentences = adapters.frame(spark, sf_dir, "sentences").select("qid", F.col("filing_date").alias("date"), F.col("sentence_text").alias("sentence"))
    first, last = sentences.agg(F.min("date"), F.max("date")).first()
    got = queries.queries()["rolling_pca"](spark, sf_dir).collect()
    assert {r.date for r in got} == {first + dt.timedelta(days=i) for i in range((last - first).days + 1)}


def test_window_sums_shared_between_days_equal_each_window_alone(spark):
    rng = random.Random(3)
    rows = [(f"q{rng.randint(0, 4)}", d("2024-01-01") + dt.timedelta(days=rng.randint(0, 60)), " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "omega", "zeta", "kappa"]) for _ in range(6))) for _ in range(40)]
    sentences = frame(spark, rows, "qid string, date date, sentence string")
    got = {(r.date, r.qid): r for r in semantic.rolling_components(sentences, calendars.daily_calendar(sentences), max_features=12, lookback_days=20).collect()}
    for back in (0, 5, 20, 21, 33, 45):
        t = max(r[1] for r in rows) - dt.timedelta(days=back)
        inside = [r for r in rows if t - dt.timedelta(days=20) <= r[1] <= t]
        names = sorted({r[0] for r in inside})
        assert sorted(q for at, q in got if at == t) == names and names
        counts = {}  # (qid, term) -> n, over the texts of each day, as one text has
        for q, _, text in inside:
            words = text.split()
            for term in [*words, *(f"{a} {b}" for a, b in zip(words, words[1:]))]:
                counts[q, term] = counts.get((q, term), 0) + 1
        df = {w: sum((q, w) in counts for q in names) for _, w in counts}
        kept = [w for w in df if 2 <= df[w] <= 0.95 * len(names)]
        kept = sorted(kept, key=lambda w: (-sum(counts.get((q, w), 0) for q in names), w))[:12]
        x = np.asarray([[counts.get((q, w), 0) * (math.log((1 + len(names)) / (1 + df[w])) + 1) for w in kept] for q in names]).reshape(len(names), -1)
        if len(names) < 2 or not kept:
            continue
        norm = np.linalg.norm(x, axis=1, keepdims=True)
        want = semantic.principal(x / np.where(norm > 0, norm, 1), 2)
        mine = [[getattr(got[t, q], f"pc_{i}") for i in (1, 2)] for q in names]
        assert np.allclose(np.asarray(mine, dtype=float), want, atol=1e-9, equal_nan=True)
