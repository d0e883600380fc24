"""DuckDB twins of the registered queries, as bodies after a WITH clause of their relations."""

import math
import re

from signalloom.operators.semantic import STOP_WORDS

ROLLING_LIVE = """, cal AS (SELECT unnest(generate_series((SELECT min(date) FROM uncertainty), (SELECT max(date) FROM uncertainty), INTERVAL 1 DAY))::DATE AS date),
u AS (SELECT qid, date, value, false AS g FROM uncertainty UNION ALL
      SELECT q.qid, c.date, NULL, true FROM (SELECT DISTINCT qid FROM uncertainty) q CROSS JOIN cal c WHERE isodow(c.date) <= 5),
r AS (SELECT *, sum(value) OVER w AS s, count(value) OVER w AS n FROM u WINDOW w AS (PARTITION BY qid ORDER BY date RANGE BETWEEN INTERVAL 6 DAYS PRECEDING AND CURRENT ROW))
SELECT qid, date, s AS rolling_sum, n AS rolling_count, s / nullif(n, 0) AS rolling_mean FROM r WHERE g"""

WEIGHTED = ", wp AS (SELECT s.date, s.sector, value * total_return AS weighted_return FROM signals s JOIN sector_returns r ON s.date = r.date AND s.sector = r.sector)"
DAILY = WEIGHTED + ", d AS (SELECT date, sum(weighted_return) AS portfolio_return FROM wp GROUP BY date)"
WEIGHTED_PNL = WEIGHTED + " SELECT date, sector, weighted_return FROM wp"
CUM_PNL = WEIGHTED + ", c AS (SELECT date, sector, weighted_return, product(1 + weighted_return) OVER (PARTITION BY sector ORDER BY date) AS cum FROM wp) SELECT * FROM c"
GROWTH = DAILY + """, g AS (SELECT *, product(1 + portfolio_return) OVER (ORDER BY date) AS cum FROM d),
k AS (SELECT *, max(cum) OVER (ORDER BY date) AS peak FROM g)"""
STRATEGY_METRICS = GROWTH + """ SELECT CASE WHEN stddev_samp(portfolio_return) = 0 THEN 0 ELSE avg(portfolio_return) / stddev_samp(portfolio_return) * sqrt(252) END AS sharpe,
 min((cum - peak) / peak) AS max_drawdown, stddev_samp(portfolio_return) * sqrt(252) AS ann_vol, arg_max(cum, date) - 1 AS total_return FROM k"""
ROLLING_SHARPE = DAILY + """ SELECT date, portfolio_return, CASE WHEN count(*) OVER w = 60 THEN avg(portfolio_return) OVER w / nullif(stddev_samp(portfolio_return) OVER w, 0) * sqrt(252) END AS rolling_sharpe
 FROM d WINDOW w AS (ORDER BY date ROWS 59 PRECEDING)"""
SECTOR_SHARPE = WEIGHTED + " SELECT sector, avg(weighted_return) AS mean, stddev_samp(weighted_return) AS std, avg(weighted_return) / nullif(stddev_samp(weighted_return), 0) * sqrt(252) AS sharpe FROM wp GROUP BY sector"

SECTOR_SENTIMENT = """, e AS (SELECT qid, date, avg(s) AS sentiment FROM (SELECT qid, date, document_id, avg(sentiment) AS s FROM reports GROUP BY ALL) GROUP BY ALL),
k AS (SELECT e.*, i.weight, i.sector FROM e ASOF JOIN sector_info i ON e.qid = i.qid AND e.date >= i.date),
ss AS (SELECT date, sector, sum(sentiment * weight) / nullif(sum(weight), 0) AS sector_sentiment, sum(weight) AS total_weight, count(DISTINCT qid) AS n_qids, list_sort(list(qid)) AS qids_list FROM k GROUP BY date, sector)"""
SECTOR_LATE = {
    how: SECTOR_SENTIMENT.replace("avg(sentiment) AS s", f"{how}(sentiment) AS s").replace("ASOF JOIN sector_info i", "ASOF LEFT JOIN (SELECT * REPLACE (date + 200 AS date) FROM sector_info) i").replace("i.weight, i.sector", "coalesce(i.weight, 0.1) AS weight, coalesce(i.sector, 'Unknown') AS sector")
    + " SELECT date, sector, sector_sentiment, total_weight, n_qids, array_to_string(qids_list, ',') AS qids FROM ss"
    for how in ("median", "sum")
}
SECTOR_SENTIMENT_Q = SECTOR_SENTIMENT + " SELECT date, sector, sector_sentiment, total_weight, n_qids, array_to_string(qids_list, ',') AS qids FROM ss"
PANEL = SECTOR_SENTIMENT + """, grid AS (SELECT s.sector, d.date FROM (SELECT DISTINCT sector FROM ss) s CROSS JOIN (SELECT DISTINCT date FROM ss) d),
p AS (SELECT g.sector, g.date, ss.sector_sentiment AS v FROM grid g LEFT JOIN ss USING (sector, date))"""
PANELS = {
    "ffill": PANEL + " SELECT sector, date, last_value(v IGNORE NULLS) OVER (PARTITION BY sector ORDER BY date ROWS UNBOUNDED PRECEDING) AS sector_sentiment FROM p",
    "bfill": PANEL + " SELECT sector, date, first_value(v IGNORE NULLS) OVER (PARTITION BY sector ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS sector_sentiment FROM p",
    "zero": PANEL + " SELECT sector, date, coalesce(v, 0) AS sector_sentiment FROM p",
    "null": PANEL + " SELECT sector, date, v AS sector_sentiment FROM p",
}
FILLED = PANEL + ", f AS (SELECT sector, date, last_value(v IGNORE NULLS) OVER (PARTITION BY sector ORDER BY date ROWS UNBOUNDED PRECEDING) AS x FROM p)"


def _full(n: int, how: str) -> str:
    return f"CASE WHEN count(x) OVER r{n} = {n} THEN {how}(x) OVER r{n} END"


SIGNAL_FEATURES = FILLED + f""" SELECT sector, date, x AS sector_sentiment, {_full(5, 'avg')} AS sector_sentiment_ma5, {_full(20, 'avg')} AS sector_sentiment_ma20,
 x - lag(x, 1) OVER w AS sector_sentiment_diff1, x - lag(x, 5) OVER w AS sector_sentiment_diff5, (x - {_full(20, 'avg')}) / nullif({_full(20, 'stddev_samp')}, 0) AS sector_sentiment_zscore20
 FROM f WINDOW w AS (PARTITION BY sector ORDER BY date), r5 AS (PARTITION BY sector ORDER BY date ROWS 4 PRECEDING), r20 AS (PARTITION BY sector ORDER BY date ROWS 19 PRECEDING)"""
SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
SECTOR_PIVOT = SECTOR_SENTIMENT + " SELECT date, " + ", ".join(f"max(sector_sentiment) FILTER (sector = '{s}') AS \"{s}\"" for s in SEGMENTS) + " FROM ss GROUP BY date"

OBSERVED = """, o1 AS (SELECT *, lag(weight) OVER w AS pw, lag(date) OVER w AS pd FROM snapshots WHERE weight > 0 WINDOW w AS (PARTITION BY sectorId, qid ORDER BY date, weight)),
o2 AS (SELECT *, sum(CASE WHEN pd IS NULL OR abs(weight - pw) > 1e-6 OR date - pd > {gap} THEN 1 ELSE 0 END) OVER (PARTITION BY sectorId, qid ORDER BY date, weight ROWS UNBOUNDED PRECEDING) AS segment_id FROM o1),
io AS (SELECT sectorId, qid, segment_id, weight, min(date) AS startDate, max(date) AS endDate, count(*) AS n_dates FROM o2 GROUP BY ALL)"""
EXPLICIT = """, e1 AS (SELECT *, lag(weight) OVER w AS pw FROM snapshots WINDOW w AS (PARTITION BY sectorId, qid ORDER BY date, weight)),
e2 AS (SELECT *, sum(CASE WHEN pw IS NULL OR weight != pw THEN 1 ELSE 0 END) OVER (PARTITION BY sectorId, qid ORDER BY date, weight ROWS UNBOUNDED PRECEDING) AS segment_id FROM e1),
e3 AS (SELECT sectorId, qid, segment_id, weight, min(date) AS startDate FROM e2 GROUP BY ALL),
ie AS (SELECT *, coalesce(lead(startDate) OVER (PARTITION BY sectorId, qid ORDER BY startDate, segment_id) - 1, DATE '2099-12-31') AS endDate FROM e3)"""
INTERVALS_OBSERVED = OBSERVED.format(gap=120) + " SELECT sectorId, qid, segment_id, weight, startDate, endDate, n_dates FROM io"
INTERVALS_EXPLICIT = EXPLICIT + " SELECT sectorId, qid, segment_id, weight, startDate, endDate FROM ie"
INTERVAL_OVERLAPS = OBSERVED.format(gap=120) + """ , mixed AS (SELECT sectorId, qid, segment_id, startDate, endDate + 120 AS endDate FROM io),
n AS (SELECT *, lead(startDate) OVER (PARTITION BY sectorId, qid ORDER BY startDate, endDate, segment_id) AS next_start FROM mixed)
SELECT sectorId, qid, segment_id, startDate, endDate, next_start FROM n WHERE next_start IS NOT NULL AND endDate >= next_start"""
PIT = EXPLICIT + """, pit AS (SELECT i.sectorId, s.id, s.documentid, s.date, s.sentiment, i.weight, s.sentiment * i.weight AS weighted_sentiment
 FROM sentiment s JOIN ie i ON s.id = i.qid AND s.date BETWEEN i.startDate AND i.endDate)"""
PIT_JOIN = PIT + " SELECT sectorId, id, documentid, date, sentiment, weight, weighted_sentiment FROM pit"


def _sliding(sign: str, guard: bool, source: str = "pit") -> str:
    ratio = "sum(weighted_sentiment) / nullif(sum(weight), 0)"
    return f""", firsts AS (SELECT sectorId, min(date) AS first FROM {source} GROUP BY sectorId),
spread AS (SELECT p.*, p.date {sign} k.k AS d FROM {source} p JOIN firsts USING (sectorId) CROSS JOIN (SELECT unnest(range(30))::INT AS k) k WHERE p.date {sign} k.k >= first),
sl AS (SELECT sectorId, d AS date, {f'CASE WHEN sum(weight) > 0 THEN {ratio} END' if guard else ratio} AS sector_sentiment, sum(weight) AS weight_coverage, count(DISTINCT id) AS n_companies,
 count(sentiment) AS n_docs, stddev_samp(sentiment) AS sentiment_std, max(weight) AS max_single_weight FROM spread GROUP BY sectorId, d)"""


SL_COLS = "sectorId, date, sector_sentiment, weight_coverage, n_companies, n_docs, sentiment_std, max_single_weight"
SLIDING_FORWARD = PIT + _sliding("-", True) + f" SELECT {SL_COLS} FROM sl"
SLIDING_TRAILING = PIT + _sliding("+", True) + f" SELECT {SL_COLS} FROM sl"
SECTOR_DAILY = """, pit AS (SELECT h.sectorId, s.id, s.date, s.sentiment, h.weight, s.sentiment * h.weight AS weighted_sentiment
 FROM sentiment s JOIN snapshots h ON s.id = h.qid AND s.date = h.date)""" + _sliding("-", False) + f" SELECT {SL_COLS} FROM sl"
GATED = PIT + _sliding("-", True) + """, gt AS (SELECT *, least(n_companies / 6.0::DOUBLE, 1) * 0.4 + least(weight_coverage / 0.5::DOUBLE, 1) * 0.3 + (1 - max_single_weight) * 0.3 AS quality,
 CASE WHEN n_companies >= 3 AND weight_coverage >= 0.02 AND sentiment_std IS NOT NULL THEN sector_sentiment END AS raw_signal FROM sl),
o AS (SELECT *, (date - min(date) OVER (PARTITION BY sectorId))::DOUBLE AS t, row_number() OVER (PARTITION BY sectorId ORDER BY date) AS k FROM gt WHERE raw_signal IS NOT NULL),
ew AS (SELECT sectorId, date, k, t, raw_signal AS e FROM o WHERE k = 1 UNION ALL
 SELECT o.sectorId, o.date, o.k, o.t, (1 - exp(-ln(2) / 7 * (o.t - ew.t))) * o.raw_signal + exp(-ln(2) / 7 * (o.t - ew.t)) * ew.e FROM ew JOIN o ON o.sectorId = ew.sectorId AND o.k = ew.k + 1),
gs AS (SELECT gt.*, last_value(ew.e IGNORE NULLS) OVER (PARTITION BY gt.sectorId ORDER BY gt.date ROWS UNBOUNDED PRECEDING) AS final_signal FROM gt LEFT JOIN ew ON gt.sectorId = ew.sectorId AND gt.date = ew.date)"""
GATED_SIGNAL = GATED + " SELECT sectorId, date, quality, raw_signal, final_signal FROM gs"
SIGNAL_STATS = GATED + """, st AS (SELECT *, abs(final_signal - lag(final_signal) OVER (PARTITION BY sectorId ORDER BY date)) AS step FROM gs)
SELECT sectorId, count(*) AS n_dates, count(raw_signal) AS n_valid, avg(quality) AS avg_quality, avg(n_companies) AS avg_companies, avg(weight_coverage) AS avg_weight_coverage,
 stddev_samp(final_signal) AS volatility, avg(step) AS turnover, count(*) FILTER (weight_coverage < 0.3) AS low_coverage_days, count(*) FILTER (max_single_weight > 0.3) AS concentrated_days,
 count(raw_signal) / count(*) AS coverage_pct FROM st GROUP BY sectorId"""

ETF = """, m AS (SELECT d.*, coalesce((SELECT max(report_date) FROM holdings h WHERE h.report_date <= d.date), (SELECT min(report_date) FROM holdings)) AS snapshot FROM
 (SELECT DISTINCT date FROM doc_sentiment) d),
sc AS (SELECT qid, document_id, date, snapshot, sum(sentiment * numOfSentences) / nullif(sum(numOfSentences), 0) AS s FROM doc_sentiment JOIN m USING (date) GROUP BY ALL)
SELECT factset_entity_id, {group} sum(s * shares) / nullif(sum(shares), 0) AS etf_sentiment, sum(shares) AS covered_shares
FROM sc JOIN holdings h ON sc.qid = h.qid AND sc.snapshot = h.report_date GROUP BY ALL"""
ETF_SENTIMENT = ETF.format(group="document_id, date,")
ETF_CROSS = ETF.format(group="date,")

PREPARED = """, q0 AS (SELECT *, (etf_sentiment - avg(etf_sentiment) OVER d) / (stddev_samp(etf_sentiment) OVER d + 1e-8) AS signal_z FROM etf_signal WHERE coverage > 0.1 WINDOW d AS (PARTITION BY date)),
ed AS (SELECT date, quantile_cont(signal_z, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]) AS e FROM q0 GROUP BY date),
ed2 AS (SELECT date, list_sort(list_distinct(e)) AS e FROM ed),
q1 AS (SELECT q0.*, CASE WHEN signal_z IS NOT NULL THEN len(list_filter(e[2:len(e) - 1], lambda x: x < signal_z)) END AS bucket FROM q0 JOIN ed2 USING (date)),
pr AS (SELECT factset_entity_id, date, etf_sentiment, signal_z, bucket, lag(signal_z) OVER w AS signal_lag, lag(bucket) OVER w AS bucket_lag, dense_rank() OVER w % 5 = 0 AS is_rebalance_day
 FROM q1 WINDOW w AS (PARTITION BY factset_entity_id ORDER BY date))"""
XS_QUANTILE = PREPARED + " SELECT * FROM pr"
POSITIONS = PREPARED + """, po0 AS (SELECT *, CASE WHEN bucket_lag = 4 THEN 1.0 WHEN bucket_lag = 0 THEN -1.0 ELSE 0.0 END AS raw_position FROM pr),
po AS (SELECT *, coalesce(raw_position / nullif(sum(abs(raw_position)) OVER (PARTITION BY date), 0), 0) AS weight FROM po0)"""
POSITIONS_Q = POSITIONS + " SELECT factset_entity_id, date, signal_lag, bucket_lag, raw_position, weight FROM po"
LONG_ONLY_Q = PREPARED + """, po0 AS (SELECT *, CASE WHEN signal_lag IS NOT NULL THEN greatest(signal_lag, 0) END AS raw_position FROM pr)
SELECT factset_entity_id, date, coalesce(raw_position / nullif(sum(abs(raw_position)) OVER (PARTITION BY date), 0), 0) AS weight FROM po0"""
NET = POSITIONS + """, nr0 AS (SELECT p.*, r.ret, coalesce(abs(weight - lag(weight) OVER (PARTITION BY p.factset_entity_id ORDER BY p.date)), 0) AS turn FROM po p JOIN etf_returns r ON p.factset_entity_id = r.factset_entity_id AND p.date = r.date),
nr AS (SELECT date, sum(weight * ret) AS gross_return, sum(turn * 0.001) AS cost, sum(weight * ret) - sum(turn * 0.001) AS net_return FROM nr0 GROUP BY date)"""
NET_RETURNS = NET + " SELECT * FROM nr"
IC = PREPARED + """, j AS (SELECT p.date, signal_lag, ret, rank() OVER (PARTITION BY p.date ORDER BY signal_lag) + (count(*) OVER (PARTITION BY p.date, signal_lag) - 1) / 2.0::DOUBLE AS rs,
 rank() OVER (PARTITION BY p.date ORDER BY ret) + (count(*) OVER (PARTITION BY p.date, ret) - 1) / 2.0::DOUBLE AS rr
 FROM pr p JOIN etf_returns r ON p.factset_entity_id = r.factset_entity_id AND p.date = r.date WHERE signal_lag IS NOT NULL AND ret IS NOT NULL),
ic AS (SELECT date, CASE WHEN min(signal_lag) < max(signal_lag) AND min(ret) < max(ret) THEN corr(signal_lag, ret) END AS ic, CASE WHEN min(rs) < max(rs) AND min(rr) < max(rr) THEN corr(rs, rr) END AS rank_ic FROM j GROUP BY date)"""
IC_Q = IC + " SELECT date, ic, rank_ic FROM ic"
QUANTILE_RETURNS = PREPARED + " SELECT p.date, bucket_lag, avg(ret) AS mean_ret FROM pr p JOIN etf_returns r ON p.factset_entity_id = r.factset_entity_id AND p.date = r.date GROUP BY p.date, bucket_lag"
PERF_STATS = IC + NET[len(PREPARED):] + """, g AS (SELECT *, product(1 + net_return) OVER (ORDER BY date) AS cum FROM nr), k AS (SELECT *, max(cum) OVER (ORDER BY date) AS peak FROM g),
one AS (SELECT avg(net_return) * 252 AS ann_return, stddev_pop(net_return) * sqrt(252) AS ann_vol, avg(net_return) / (stddev_pop(net_return) + 1e-10) * sqrt(252) AS sharpe, min((cum - peak) / peak) AS max_drawdown,
 avg(cost) / 0.001::DOUBLE * 252 AS ann_turnover, avg(cost) * 252 AS ann_cost FROM k),
two AS (SELECT avg(ic) AS mean_ic, avg(rank_ic) AS mean_rank_ic, avg(ic) / (stddev_pop(ic) + 1e-10) AS icir, avg(CASE WHEN ic > 0 THEN 1.0 WHEN ic IS NOT NULL THEN 0.0 END) AS ic_positive FROM ic)
SELECT * FROM one CROSS JOIN two"""

RAW_WEIGHTS = {
    "topn": "CASE WHEN dense_rank() OVER (PARTITION BY date ORDER BY signal_value DESC NULLS LAST) <= 5 THEN 1.0 ELSE 0.0 END",
    "zscore": "greatest((signal_value - avg(signal_value) OVER (PARTITION BY date)) / nullif(stddev_samp(signal_value) OVER (PARTITION BY date), 0), 0)",
    "rank_linear": "1 / (rank() OVER (PARTITION BY date ORDER BY signal_value DESC NULLS LAST) + (count(*) OVER (PARTITION BY date, signal_value) - 1) / 2.0::DOUBLE)",
}


def weights(method: str) -> str:
    raw = RAW_WEIGHTS[method]
    if method == "zscore":
        raw = f"CASE WHEN stddev_samp(signal_value) OVER (PARTITION BY date) != 0 THEN {raw} END"
    return f""", w0 AS (SELECT *, {raw} AS rw FROM trade_signals),
w1 AS (SELECT *, rw / nullif(sum(rw) OVER (PARTITION BY date), 0) AS w FROM w0),
w2 AS (SELECT *, CASE WHEN w IS NOT NULL THEN least(w, 0.30) END AS c FROM w1),
wt AS (SELECT sector_id, date, signal_value, c / nullif(sum(c) OVER (PARTITION BY date), 0) AS weight FROM w2)"""


WEIGHTS = {m: weights(m) + " SELECT * FROM wt" for m in RAW_WEIGHTS}
REBALANCE = weights("rank_linear") + """, days AS (SELECT date, row_number() OVER (ORDER BY date) AS k, map_from_entries(list((sector_id, weight) ORDER BY sector_id)) AS w FROM wt WHERE weight IS NOT NULL GROUP BY date),
path AS (SELECT 0::BIGINT AS k, NULL::DATE AS date, MAP {}::MAP(VARCHAR, DOUBLE) AS w UNION ALL
 SELECT d.k, d.date, (SELECT map_from_entries(list((x.key, x.v / nullif(x.t, 0)) ORDER BY x.key)) FROM
   (SELECT y.key, y.v, sum(y.v) OVER () AS t FROM (SELECT e.key AS key, CASE WHEN abs(e.value - coalesce(p.w[e.key], 0)) > 0.02 THEN e.value ELSE coalesce(p.w[e.key], 0) END AS v
     FROM (SELECT unnest(map_entries(d.w)) AS e)) y) x) FROM path p JOIN days d ON d.k = p.k + 1)
SELECT date, e.key AS sector_id, e.value AS weight FROM (SELECT date, unnest(map_entries(w)) AS e FROM path WHERE date IS NOT NULL)"""
REBALANCE_PORTFOLIOS = """, wt AS (SELECT sector AS portfolio, qid::VARCHAR AS sector_id, date, (value + 2) / sum(value + 2) OVER (PARTITION BY sector, date) AS weight FROM sector_panel WHERE value IS NOT NULL),
days AS (SELECT portfolio, date, row_number() OVER (PARTITION BY portfolio ORDER BY date) AS k, map_from_entries(list((sector_id, weight) ORDER BY sector_id)) AS w FROM wt GROUP BY portfolio, date),
path AS (SELECT DISTINCT portfolio, 0::BIGINT AS k, NULL::DATE AS date, MAP {}::MAP(VARCHAR, DOUBLE) AS w FROM days UNION ALL
 SELECT d.portfolio, d.k, d.date, (SELECT map_from_entries(list((x.key, x.v / nullif(x.t, 0)) ORDER BY x.key)) FROM
   (SELECT y.key, y.v, sum(y.v) OVER () AS t FROM (SELECT e.key AS key, CASE WHEN abs(e.value - coalesce(p.w[e.key], 0)) > 0.02 THEN e.value ELSE coalesce(p.w[e.key], 0) END AS v
     FROM (SELECT unnest(map_entries(d.w)) AS e)) y) x) FROM path p JOIN days d ON d.portfolio = p.portfolio AND d.k = p.k + 1)
SELECT portfolio, date, e.key AS sector_id, e.value AS weight FROM (SELECT portfolio, date, unnest(map_entries(w)) AS e FROM path WHERE date IS NOT NULL)"""
REBALANCE_STEP = weights("rank_linear") + """, pw AS (SELECT sector_id, weight AS p FROM wt WHERE date = (SELECT min(date) FROM wt)),
st AS (SELECT t.sector_id, date, signal_value, CASE WHEN abs(weight - coalesce(p, 0)) > 0.02 THEN weight ELSE coalesce(p, 0) END AS v FROM wt t LEFT JOIN pw USING (sector_id))
SELECT sector_id, date, signal_value, v / nullif(sum(v) OVER (PARTITION BY date), 0) AS weight FROM st"""
SHARES = weights("zscore") + """, sh AS (SELECT t.sector_id, t.date, floor(weight * 1000000.0 / nullif(close, 0))::BIGINT AS shares, close FROM wt t LEFT JOIN prices p ON t.sector_id = p.sector_id AND t.date = p.date)"""
SHARES_Q = SHARES + " SELECT sector_id, date, shares, shares * close AS notional FROM sh"
TRADES = SHARES + """, nx AS (SELECT date, lead(date) OVER (ORDER BY date) AS next FROM (SELECT DISTINCT date FROM sh)),
hd AS (SELECT sector_id, next AS date, coalesce(shares, 0) AS before FROM sh JOIN nx USING (date) WHERE next IS NOT NULL),
tr AS (SELECT s.sector_id, s.date, coalesce(s.shares, 0) - coalesce(h.before, 0) AS trade_shares FROM sh s LEFT JOIN hd h ON s.sector_id = h.sector_id AND s.date = h.date)
SELECT sector_id, date, trade_shares, CASE WHEN trade_shares > 0 THEN 'BUY' ELSE 'SELL' END AS side FROM tr WHERE trade_shares != 0"""

EWMA = """, o AS (SELECT *, (date - min(date) OVER (PARTITION BY qid))::DOUBLE AS t, row_number() OVER (PARTITION BY qid ORDER BY date) AS k FROM uncertainty),
ew AS (SELECT qid, date, k, t, value, value AS e FROM o WHERE k = 1 UNION ALL
 SELECT o.qid, o.date, o.k, o.t, o.value, (1 - exp(-ln(2) / 5 * (o.t - ew.t))) * o.value + exp(-ln(2) / 5 * (o.t - ew.t)) * ew.e FROM ew JOIN o ON o.qid = ew.qid AND o.k = ew.k + 1)
SELECT qid, date, value, e AS ewma FROM ew"""

HALFOPEN = """, ev AS (SELECT qid, date, true AS f FROM filings UNION ALL SELECT qid, date + 180, false FROM filings),
st AS (SELECT e.qid, e.date, (SELECT list(f.length ORDER BY f.date, f.document_id) FROM filings f WHERE f.qid = e.qid AND f.date <= e.date AND f.date > e.date - 180) AS l FROM ev e),
sg AS (SELECT qid, date, CASE WHEN len(l) >= 2 THEN l[-1] - l[-2] END AS signal FROM st),
lg AS (SELECT *, lag(signal) OVER (PARTITION BY qid ORDER BY date) AS p FROM sg)"""
HALFOPEN_E = HALFOPEN + ", he AS (SELECT qid, date, signal FROM lg WHERE p IS NULL OR signal != p OR (signal IS NULL) != (p IS NULL))"
DELTA_HALFOPEN = HALFOPEN_E + " SELECT * FROM he"
DELTA_CLOSED = """, ev AS (SELECT qid, date FROM filings UNION SELECT qid, date + 181 FROM filings),
st AS (SELECT e.qid, e.date, (SELECT list(f.length ORDER BY f.date, f.document_id) FROM filings f WHERE f.qid = e.qid AND f.date <= e.date AND f.date >= e.date - 180) AS l FROM ev e),
sg AS (SELECT qid, date, CASE WHEN len(l) >= 2 THEN l[-1] - l[-2] END AS signal, coalesce(len(l), 0) AS n_filings_in_window FROM st),
lg AS (SELECT *, lag(signal) OVER (PARTITION BY qid ORDER BY date) AS p FROM sg)
SELECT qid, date, signal, n_filings_in_window FROM lg WHERE signal IS DISTINCT FROM p"""
#: The streams leave the days within their lateness of the last row open.
STREAM_EWMA = EWMA + " WHERE date < (SELECT max(date) FROM uncertainty) - 5"
STREAM_DELTA = DELTA_CLOSED.replace(" WHERE signal IS DISTINCT", " WHERE date < (SELECT max(date) FROM filings) - 30 AND signal IS DISTINCT")
ASOF_LOOKUP = HALFOPEN_E + """, hd AS (SELECT qid, date, arg_max(coalesce(signal, 'Infinity'::DOUBLE), coalesce(signal, '-Infinity'::DOUBLE)) AS s FROM he GROUP BY qid, date),
qs AS (SELECT DISTINCT o_custkey AS qid, CAST(l_shipdate AS DATE) AS date FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT q.qid, q.date, CASE WHEN isinf(h.s) THEN NULL ELSE h.s END AS signal FROM qs q ASOF LEFT JOIN hd h ON q.qid = h.qid AND q.date >= h.date"""
DAILY_DIFFERENCES = """, cal AS (SELECT unnest(generate_series(DATE '1997-01-01', DATE '1997-03-31', INTERVAL 1 DAY))::DATE AS date),
nm AS (SELECT qid, date, length, row_number() OVER (PARTITION BY qid ORDER BY date, length) AS nth FROM filings),
cur AS (SELECT q.qid, c.date, (SELECT max(nth) FROM nm WHERE nm.qid = q.qid AND nm.date <= c.date) AS nth FROM (SELECT DISTINCT qid FROM filings) q CROSS JOIN cal c)
SELECT c.qid, c.date, any_value(n.length) AS length, any_value(n.length) - arg_max(h.length, h.nth) AS diff_vs_previous, any_value(n.length) - avg(h.length) AS diff_vs_avg_previous
FROM cur c LEFT JOIN nm n ON c.qid = n.qid AND c.nth = n.nth LEFT JOIN nm h ON h.qid = c.qid AND h.nth < c.nth AND h.date >= c.date - 180 GROUP BY c.qid, c.date"""

ALL_DIFFERENCES = """, nm AS (SELECT qid, date, length, row_number() OVER w AS nth, sum(length) OVER w AS total, lag(length) OVER w AS before, lag(date) OVER w AS before_date FROM filings
 WINDOW w AS (PARTITION BY qid ORDER BY date, length ROWS UNBOUNDED PRECEDING)),
nd AS (SELECT qid, date, max(nth) AS nth, arg_max(length, nth) AS length, arg_max(total, nth) AS total, arg_max(before, nth) AS before, arg_max(before_date, nth) AS before_date FROM nm GROUP BY qid, date),
gr AS (SELECT q.qid, c.date, c.date - 181 AS edge FROM (SELECT DISTINCT qid FROM filings) q CROSS JOIN (SELECT unnest(generate_series((SELECT min(date) FROM filings), (SELECT max(date) FROM filings), INTERVAL 1 DAY))::DATE AS date) c),
cu AS (SELECT g.qid, g.date, g.edge, n.nth, n.length, n.total, n.before, n.before_date FROM gr g ASOF LEFT JOIN nd n ON g.qid = n.qid AND g.date >= n.date)
SELECT c.qid, c.date, c.length, c.length - CASE WHEN c.before_date > c.edge THEN c.before END AS diff_vs_previous,
 c.length - CASE WHEN c.nth - 1 - coalesce(o.nth, 0) > 0 THEN (c.total - c.length - coalesce(o.total, 0)) / (c.nth - 1 - coalesce(o.nth, 0)) END AS diff_vs_avg_previous
FROM cu c ASOF LEFT JOIN nd o ON c.qid = o.qid AND c.edge >= o.date"""
SECTION_LIST = """ SELECT id, date, section, array_to_string(list_transform(list_sort(list({'d': date, 's': section}) OVER w), lambda x: x.s), '|') AS sections
FROM sections WINDOW w AS (PARTITION BY id ORDER BY date RANGE BETWEEN INTERVAL 180 DAYS PRECEDING AND CURRENT ROW)"""
SECTION_DISTINCT = """ SELECT DISTINCT id, date, array_to_string(list_sort(list_distinct(list(section) OVER w)), '|') AS sections, count(section) OVER w AS total_count, len(list_distinct(list(section) OVER w)) AS unique_count
FROM sections WINDOW w AS (PARTITION BY id ORDER BY date RANGE BETWEEN INTERVAL 180 DAYS PRECEDING AND CURRENT ROW)"""
SECTION_GRID = """, b AS (SELECT min(date) AS a, max(date) AS z FROM sections), cal AS (SELECT d::DATE AS date FROM (SELECT unnest(generate_series(a, z, INTERVAL 1 DAY)) AS d FROM b) WHERE isodow(d) <= 5),
u AS (SELECT id, date, section, false AS g FROM sections UNION ALL SELECT q.id, c.date, NULL, true FROM (SELECT DISTINCT id FROM sections) q CROSS JOIN cal c),
r AS (SELECT id, date, g, count(section) OVER w AS n, list(section) OVER w AS l FROM u WINDOW w AS (PARTITION BY id ORDER BY date RANGE BETWEEN INTERVAL 180 DAYS PRECEDING AND CURRENT ROW))
SELECT id, date, array_to_string(list_sort(list_distinct(l)), '|') AS sections, n AS total_count, len(list_distinct(l)) AS unique_count FROM r WHERE g AND n > 0"""
SECTION_GRID_OWN = SECTION_GRID.replace("SELECT min(date) AS a, max(date) AS z FROM sections", "SELECT id, min(date) AS a, max(date) AS z FROM sections GROUP BY id").replace("SELECT d::DATE AS date FROM (SELECT unnest(generate_series(a, z, INTERVAL 1 DAY)) AS d FROM b)", "SELECT id, d::DATE AS date FROM (SELECT id, unnest(generate_series(a, z, INTERVAL 1 DAY)) AS d FROM b)").replace(
    "SELECT q.id, c.date, NULL, true FROM (SELECT DISTINCT id FROM sections) q CROSS JOIN cal c", "SELECT id, date, NULL, true FROM cal"
)
WINDOW_LABELS = """ SELECT f.qid, f.document_id, f.date, f.length, d.date AS window_date, CASE WHEN d.date IS NULL THEN 'current' ELSE 'historical' END AS data_type
FROM filings f LEFT JOIN (SELECT DISTINCT qid, date FROM filings) d ON f.qid = d.qid AND d.date > f.date AND d.date - f.date <= 90"""
EXCHANGE_WEEKS = " SELECT max(date) AS date FROM filings WHERE date BETWEEN DATE '1995-01-01' AND DATE '2001-12-31' GROUP BY date_trunc('week', date)"
SECTION_MONTHS = """, b AS (SELECT min(date) AS a, max(date) AS z FROM sections), cal AS (SELECT d::DATE AS date FROM (SELECT unnest(generate_series(a, z, INTERVAL 1 DAY)) AS d FROM b) WHERE isodow(d) <= 5),
grid AS (SELECT q.id, c.date FROM (SELECT DISTINCT id FROM sections) q CROSS JOIN cal c)
SELECT g.id, g.date, coalesce(array_to_string(list_sort(list_distinct(list(s.section))), '|'), '') AS sections, count(DISTINCT s.section) AS unique_count
FROM grid g LEFT JOIN sections s ON s.id = g.id AND s.date <= g.date AND s.date >= (g.date - INTERVAL 6 MONTHS)::DATE GROUP BY g.id, g.date"""
LONGTERM = """, a AS (SELECT *, avg(value) OVER (PARTITION BY qid ORDER BY date RANGE BETWEEN INTERVAL 365 DAYS PRECEDING AND INTERVAL 1 DAY PRECEDING) AS long_ma FROM panel_values),
r AS (SELECT *, CASE WHEN long_ma IS NOT NULL THEN rank() OVER (PARTITION BY date ORDER BY long_ma NULLS LAST) + (count(*) OVER (PARTITION BY date, long_ma) - 1) / 2.0::DOUBLE END AS rk FROM a),
p AS (SELECT *, rk / nullif(max(rk) OVER (PARTITION BY date), 0) AS percentile FROM r),
s AS (SELECT *, list_sort(list_filter(list(percentile) OVER (PARTITION BY qid ORDER BY date RANGE BETWEEN INTERVAL 729 DAYS PRECEDING AND CURRENT ROW), lambda x: x IS NOT NULL)) AS seen FROM p)
SELECT qid, date, value, long_ma, percentile, seen[(floor((len(seen) - 1) * 0.5 + 0.5))::INT + 1] AS rolling_median,
 CASE WHEN percentile <= 0.2 THEN 1 WHEN percentile <= 0.4 THEN 2 WHEN percentile <= 0.6 THEN 3 WHEN percentile <= 0.8 THEN 4 ELSE 5 END AS quintile,
 (long_ma - avg(long_ma) OVER (PARTITION BY date)) / nullif(stddev_samp(long_ma) OVER (PARTITION BY date), 0) AS z, value - long_ma AS residual FROM s"""
CROSS_SECTION = """, s AS (SELECT *, weight / nullif(sum(weight) OVER (PARTITION BY date), 0) AS sh FROM panel_values)
SELECT date, sum(sh * value) AS index_value, stddev_samp(value) AS dispersion, max(value) - min(value) AS spread, sum(sh * sh) AS hhi, count(*) FILTER (value > 0) / count(*) AS breadth, count(value) / count(*) AS coverage FROM s GROUP BY date"""
MOMENTUM = " SELECT qid, date, value, value - avg(value) OVER (PARTITION BY qid ORDER BY date RANGE BETWEEN INTERVAL 120 DAYS PRECEDING AND INTERVAL 1 DAY PRECEDING) AS momentum FROM panel_values"

SECTOR_DAYS = """, sd AS (SELECT sector, date, avg(value) AS signal, stddev_samp(value) AS spread, count(*) FILTER (value > 0) / count(value)::DOUBLE AS breadth FROM sector_panel WHERE value IS NOT NULL GROUP BY ALL)"""
DISPERSION = SECTOR_DAYS + " SELECT date, avg(spread) AS within, stddev_samp(signal) AS cross, count(*) AS n_sectors, avg(spread) / nullif(stddev_samp(signal), 0) AS ratio FROM sd GROUP BY date".replace(" AS cross", ' AS "cross"')
DIVERGENCE = SECTOR_DAYS + """, ix AS (SELECT date, v - avg(v) OVER (ORDER BY date RANGE BETWEEN INTERVAL 90 DAYS PRECEDING AND INTERVAL 1 DAY PRECEDING) AS index_momentum FROM (SELECT date, avg(value) AS v FROM sector_panel GROUP BY date)),
mo AS (SELECT sector, date, signal - avg(signal) OVER (PARTITION BY sector ORDER BY date RANGE BETWEEN INTERVAL 90 DAYS PRECEDING AND INTERVAL 1 DAY PRECEDING) AS momentum FROM sd)
SELECT sector, date, momentum, index_momentum, momentum - index_momentum AS divergence FROM mo JOIN ix USING (date)"""
BREADTH_INDEX = SECTOR_DAYS + " SELECT date, sum(signal * breadth) AS index_signal, sum(signal * breadth) / nullif(sum(breadth), 0) AS normalised FROM sd GROUP BY date"
PRECISION = r""", pn AS (SELECT sector, review_date AS date, sum(len(regexp_extract_all(wlb, '[0-9]+([.,][0-9]+)*')))::BIGINT AS n_numbers, sum(len(regexp_extract_all(wlb, '[^ \t\n\x0B\f\r]+')))::BIGINT AS n_words FROM reviews GROUP BY ALL),
pd AS (SELECT *, n_numbers / nullif(n_words, 0)::DOUBLE AS density FROM pn)
SELECT *, CASE WHEN density IS NOT NULL THEN rank() OVER (PARTITION BY date ORDER BY density DESC NULLS LAST) + (count(*) OVER (PARTITION BY date, density) - 1) / 2.0::DOUBLE END AS precision_rank FROM pd"""
FILING_DELAY = """, dl AS (SELECT qid, document_id, date, period_end, (date - period_end)::INTEGER AS delay FROM delays)
SELECT *, delay / nullif(avg(delay) OVER (PARTITION BY qid ORDER BY date RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 DAY PRECEDING), 0) AS relative_delay FROM dl"""
CLEAN = r""", pp AS (SELECT *, trim(regexp_replace(regexp_replace(lower(sentence_text), '[^a-zA-Z\s]', ' ', 'g'), '\s+', ' ', 'g')) AS clean_text FROM sentences),
pw AS (SELECT *, len(string_split(clean_text, ' ')) AS word_count FROM pp),
wd AS (SELECT qid, filing_date, unnest(string_split(clean_text, ' ')) AS word FROM pp)"""
PREPROCESS = CLEAN + r""" SELECT qid, document_id, sentence_id, clean_text, word_count, length(sentence_text) AS char_count, len(list_distinct(string_split(clean_text, ' '))) AS unique_word_count,
 len(regexp_extract_all(sentence_text, '[,;:]')) AS punctuation_count, len(regexp_extract_all(sentence_text, '\b(and|or|but|because|therefore|however)\b')) AS conjunction_count FROM pw"""
ENTROPY = "-sum(n / t * log2(n / t))"


def _entropy(source: str, bucket: str, out: str, extra: str = "") -> str:
    return f""", ec AS (SELECT qid, filing_date, {bucket} AS b, count(*)::DOUBLE AS n FROM {source} GROUP BY ALL), et AS (SELECT *, sum(n) OVER (PARTITION BY qid, filing_date) AS t FROM ec)
SELECT qid, filing_date, {ENTROPY} + 0.0 AS {out}{extra} FROM et GROUP BY qid, filing_date"""


WORD_ENTROPY = CLEAN + _entropy("(SELECT * FROM wd WHERE word != '')", "word", "word_entropy")
LENGTH_ENTROPY = CLEAN + _entropy("pw", "word_count // 10", "length_entropy", ", sum(n)::BIGINT AS total_sentences")
FREQUENCY_ENTROPY = CLEAN + _entropy("pw", "document_id", "filing_freq_entropy", ", count(*) AS num_documents")
APPROX_ENTROPY = CLEAN + _entropy("(SELECT * FROM wd WHERE word != '')", "('0x' || substr(md5(word), 25, 8))::BIGINT % 10000", "approx_word_entropy")
DOC = CLEAN + r""", px AS (SELECT *, length(sentence_text) AS cc, len(list_distinct(string_split(clean_text, ' '))) AS uw, len(regexp_extract_all(sentence_text, '[,;:]')) AS pu,
 len(regexp_extract_all(sentence_text, '\b(and|or|but|because|therefore|however)\b')) AS co FROM pw),
df AS (SELECT qid, document_id, filing_date, count(*) AS sentence_count, sum(word_count)::BIGINT AS total_words, sum(cc)::BIGINT AS total_chars, sum(uw)::BIGINT AS total_unique_words, sum(pu)::BIGINT AS total_punctuation,
 sum(co)::BIGINT AS total_conjunctions, avg(word_count) AS avg_sentence_length, stddev_samp(word_count) AS std_sentence_length, min(word_count) AS min_sentence_length, max(word_count) AS max_sentence_length,
 sum(uw) / nullif(sum(word_count), 0) AS vocabulary_diversity, sum(pu) / count(*) AS punctuation_per_sentence, sum(co) / count(*) AS conjunctions_per_sentence FROM px GROUP BY ALL)"""
DOC_FEATURES = DOC + " SELECT * FROM df"
FILING = DOC + """, dt AS (SELECT *, sum(sentence_count) OVER (PARTITION BY qid, filing_date)::DOUBLE AS t FROM df),
ff AS (SELECT qid, filing_date, count(*) AS document_count, sum(sentence_count)::BIGINT AS filing_total_sentences, sum(total_words)::BIGINT AS filing_total_words, sum(total_chars)::BIGINT AS filing_total_chars,
 -sum(sentence_count / t * log2(sentence_count / t)) + 0.0 AS document_size_entropy, avg(vocabulary_diversity) AS avg_vocabulary_diversity, stddev_samp(vocabulary_diversity) AS std_vocabulary_diversity,
 avg(punctuation_per_sentence) AS filing_punctuation_complexity, avg(conjunctions_per_sentence) AS filing_conjunction_complexity, avg(avg_sentence_length) AS filing_avg_sentence_length, avg(std_sentence_length) AS filing_std_sentence_length
 FROM dt GROUP BY qid, filing_date)"""
FILING_FEATURES = FILING + " SELECT * FROM ff"


def _rank(c: str, d: str = "filing_date") -> str:
    return f"CASE WHEN {c} IS NOT NULL THEN rank() OVER (PARTITION BY {d} ORDER BY {c} NULLS LAST) + (count(*) OVER (PARTITION BY {d}, {c}) - 1) / 2.0::DOUBLE END"


TEMPORAL = FILING + f""", tf AS (SELECT *, avg(document_size_entropy) OVER r AS entropy_rolling_mean, stddev_samp(document_size_entropy) OVER r AS entropy_rolling_std, avg(avg_vocabulary_diversity) OVER r AS diversity_rolling_mean,
 document_size_entropy / nullif(lag(document_size_entropy) OVER w, 0) - 1 AS entropy_change_rate, avg_vocabulary_diversity / nullif(lag(avg_vocabulary_diversity) OVER w, 0) - 1 AS diversity_change_rate,
 {_rank('document_size_entropy')} AS entropy_cross_rank, {_rank('avg_vocabulary_diversity')} AS diversity_cross_rank,
 document_size_entropy - lag(document_size_entropy) OVER w AS entropy_momentum, avg_vocabulary_diversity - lag(avg_vocabulary_diversity) OVER w AS diversity_momentum
 FROM ff WINDOW w AS (PARTITION BY qid ORDER BY filing_date), r AS (PARTITION BY qid ORDER BY filing_date RANGE BETWEEN INTERVAL 89 DAYS PRECEDING AND CURRENT ROW))"""
TEMPORAL_Q = TEMPORAL + " SELECT qid, filing_date, entropy_rolling_mean, entropy_rolling_std, diversity_rolling_mean, entropy_change_rate, diversity_change_rate, entropy_cross_rank, diversity_cross_rank, entropy_momentum, diversity_momentum FROM tf"
COMPOSITES = TEMPORAL + """, cp AS (SELECT *, document_size_entropy * 0.3 + avg_vocabulary_diversity * 0.4 + filing_punctuation_complexity * 0.3 AS information_complexity,
 abs(entropy_change_rate) * 0.5 + abs(diversity_change_rate) * 0.5 AS information_change_intensity, abs(document_size_entropy - entropy_rolling_mean) / (entropy_rolling_std + 1e-10) AS information_anomaly,
 filing_total_words / (document_count + 1) AS information_density, entropy_momentum * 0.5 + diversity_momentum * 0.5 AS information_momentum,
 entropy_cross_rank / nullif(max(entropy_cross_rank) OVER (PARTITION BY filing_date), 0) AS relative_complexity_position, entropy_rolling_std AS information_volatility FROM tf)"""
SEVEN = ("information_complexity", "information_change_intensity", "information_anomaly", "information_density", "information_momentum", "relative_complexity_position", "information_volatility")
COMPOSITES_Q = COMPOSITES + " SELECT qid, filing_date, " + ", ".join(SEVEN) + " FROM cp"
_UNPIVOTED = COMPOSITES + ", fx AS (SELECT qid, filing_date, date_trunc('month', filing_date)::DATE AS month, lead(avg_vocabulary_diversity) OVER (PARTITION BY qid ORDER BY filing_date) - avg_vocabulary_diversity AS y, " + ", ".join(f"round({c} + {2.0**-30!r}::DOUBLE, 6) + 0.0::DOUBLE AS {c}" for c in SEVEN) + """ FROM cp),
lo AS (UNPIVOT fx ON """ + ", ".join(SEVEN) + """ INTO NAME f VALUE x), fs AS (SELECT unnest(""" + str(list(SEVEN)) + """) AS f),
cm AS (SELECT a.f AS feature, b.f AS other, count(*) AS n, CASE WHEN min(a.x) < max(a.x) AND min(b.x) < max(b.x) THEN corr(a.x, b.x) END AS correlation
 FROM lo a JOIN lo b ON a.qid = b.qid AND a.filing_date = b.filing_date AND a.f < b.f GROUP BY ALL),
co AS (SELECT a.f AS feature, b.f AS other, coalesce(n, 0) AS n, correlation FROM fs a JOIN fs b ON a.f < b.f LEFT JOIN cm ON feature = a.f AND other = b.f)"""
CORRELATIONS = _UNPIVOTED + " SELECT * FROM co"
SCREENING = _UNPIVOTED + """, rk AS (SELECT month, f, rank() OVER (PARTITION BY month, f ORDER BY x) + (count(*) OVER (PARTITION BY month, f, x) - 1) / 2.0::DOUBLE AS rx,
 rank() OVER (PARTITION BY month, f ORDER BY y) + (count(*) OVER (PARTITION BY month, f, y) - 1) / 2.0::DOUBLE AS ry FROM lo WHERE y IS NOT NULL),
ic AS (SELECT f AS feature, avg(v) AS ic, count(v) AS n_periods FROM (SELECT month, f, CASE WHEN min(rx) < max(rx) AND min(ry) < max(ry) THEN corr(rx, ry) END AS v FROM rk GROUP BY ALL) GROUP BY f),
pa AS (SELECT f, list(o) AS o FROM (SELECT feature AS f, other AS o FROM co WHERE abs(correlation) >= 0.8 UNION ALL SELECT other, feature FROM co WHERE abs(correlation) >= 0.8) GROUP BY f),
qu AS (SELECT feature, coalesce(o, []) AS o, row_number() OVER (ORDER BY abs(ic) DESC, feature) AS k FROM ic LEFT JOIN pa ON f = feature WHERE abs(ic) > 0.02),
pk AS (SELECT 0::BIGINT AS k, []::VARCHAR[] AS kept UNION ALL SELECT qu.k, CASE WHEN list_has_any(kept, o) THEN kept ELSE list_append(kept, feature) END FROM pk JOIN qu ON qu.k = pk.k + 1)
SELECT feature, ic, n_periods, coalesce(abs(ic) > 0.02, false) AS informative, list_contains((SELECT arg_max(kept, k) FROM pk), feature) AS kept FROM ic"""
NORM_COLS = ("information_complexity", "information_density", "relative_complexity_position")
ROBUST_NORM = COMPOSITES + ", md AS (SELECT *, " + ", ".join(f"median({c}) OVER (PARTITION BY filing_date) AS m_{c}" for c in NORM_COLS) + " FROM cp), ma AS (SELECT *, " + ", ".join(
    f"median(abs({c} - m_{c})) OVER (PARTITION BY filing_date) AS d_{c}" for c in NORM_COLS
) + " FROM md) SELECT qid, filing_date, " + ", ".join(f"({_rank(c)}) / nullif(count({c}) OVER (PARTITION BY filing_date), 0) AS {c}_rank, ({c} - m_{c}) / (d_{c} + 1e-10) AS {c}_robust_zscore" for c in NORM_COLS) + " FROM ma"

STOPS = "[" + ", ".join(f"'{w}'" for w in STOP_WORDS) + "]"
SEMANTIC = CLEAN + f""", tw AS (SELECT qid, filing_date, list_filter(string_split(regexp_replace(lower(clean_text), '[^a-z]+', ' ', 'g'), ' '), lambda w: length(w) >= 2 AND NOT list_contains({STOPS}, w)) AS w FROM pp),
tt AS (SELECT qid, filing_date, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM tw),
tc AS (SELECT qid, filing_date, term, count(*) AS tf FROM tt GROUP BY ALL),
nd AS (SELECT qid, count(*) AS n FROM (SELECT DISTINCT qid, filing_date FROM tc) GROUP BY qid),
vc AS (SELECT qid, term, count(*) AS df, row_number() OVER (PARTITION BY qid ORDER BY sum(tf) DESC, term) AS top FROM tc GROUP BY qid, term),
wv AS (SELECT tc.qid, tc.filing_date, tc.term, tc.tf * (ln((1 + nd.n) / (1 + vc.df)::DOUBLE) + 1) AS x FROM tc JOIN vc ON tc.qid = vc.qid AND tc.term = vc.term AND vc.top <= 1000 JOIN nd ON tc.qid = nd.qid),
fl AS (SELECT qid, filing_date, row_number() OVER (PARTITION BY qid ORDER BY filing_date) AS i FROM (SELECT DISTINCT qid, filing_date FROM pp)),
ve AS (SELECT w.qid, f.i, w.term, w.x / sum(w.x) OVER (PARTITION BY w.qid, w.filing_date) AS p FROM wv w JOIN fl f ON w.qid = f.qid AND w.filing_date = f.filing_date),
lv AS (SELECT DISTINCT qid, i FROM ve), pr AS (SELECT a.qid, a.i, b.i AS j FROM lv a JOIN lv b ON a.qid = b.qid AND b.i < a.i AND b.i >= a.i - 5),
un AS (SELECT pr.qid, pr.i, pr.j, v.term, v.p AS p, 0::DOUBLE AS q FROM pr JOIN ve v ON v.qid = pr.qid AND v.i = pr.i UNION ALL SELECT pr.qid, pr.i, pr.j, v.term, 0, v.p FROM pr JOIN ve v ON v.qid = pr.qid AND v.i = pr.j),
gt AS (SELECT qid, i, j, term, sum(p) AS p, sum(q) AS q FROM un GROUP BY ALL),
js AS (SELECT qid, i, j, sqrt(greatest(sum(CASE WHEN p > 0 THEN p / 2 * ln(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q / 2 * ln(2 * q / (p + q)) ELSE 0 END), 0)) AS d FROM gt GROUP BY ALL)
SELECT fl.qid, fl.filing_date, coalesce(avg(js.d), 0) AS semantic_entropy FROM fl LEFT JOIN js ON fl.qid = js.qid AND fl.i = js.i GROUP BY fl.qid, fl.filing_date"""


def _part(source: str, bucket: str, out: str, extra: str = "") -> str:
    return f"""(SELECT qid, filing_date, {ENTROPY} + 0.0 AS {out}{extra} FROM (SELECT *, sum(n) OVER (PARTITION BY qid, filing_date) AS t FROM
 (SELECT qid, filing_date, {bucket} AS b, count(*)::DOUBLE AS n FROM {source} GROUP BY ALL)) GROUP BY qid, filing_date)"""


FACTORS = ("word_entropy", "length_entropy", "filing_freq_entropy", "semantic_entropy", "composite_entropy", "info_change_intensity", "info_complexity", "info_density", "info_volatility", "info_trend")
WORDS = "(SELECT * FROM wd WHERE word != '')"
_SEM_CTES, _SEM_BODY = SEMANTIC.split("\nSELECT fl.qid", 1)
ENTROPY_ENGINE = _SEM_CTES + f""", se AS (SELECT fl.qid{_SEM_BODY}), we AS {_part(WORDS, "word", "word_entropy")}, le AS {_part("pw", "word_count // 10", "length_entropy", ", sum(n)::BIGINT AS total_sentences")},
fe AS {_part("pw", "document_id", "filing_freq_entropy", ", count(*) AS num_documents")},
mg AS (SELECT qid, filing_date, coalesce(word_entropy, 0) AS word_entropy, coalesce(length_entropy, 0) AS length_entropy, coalesce(total_sentences, 0) AS total_sentences, coalesce(filing_freq_entropy, 0) AS filing_freq_entropy,
 coalesce(num_documents, 0) AS num_documents, coalesce(semantic_entropy, 0) AS semantic_entropy FROM we FULL JOIN le USING (qid, filing_date) FULL JOIN fe USING (qid, filing_date) FULL JOIN se USING (qid, filing_date)),
er AS (SELECT *, avg(word_entropy) OVER r AS word_entropy_rolling_mean, stddev_samp(word_entropy) OVER r AS word_entropy_rolling_std, avg(length_entropy) OVER r AS length_entropy_rolling_mean,
 word_entropy / nullif(lag(word_entropy) OVER w, 0) - 1 AS word_entropy_change, length_entropy / nullif(lag(length_entropy) OVER w, 0) - 1 AS length_entropy_change FROM mg
 WINDOW w AS (PARTITION BY qid ORDER BY filing_date), r AS (PARTITION BY qid ORDER BY filing_date RANGE BETWEEN INTERVAL 89 DAYS PRECEDING AND CURRENT ROW)),
en AS (SELECT *, word_entropy * 0.4 + length_entropy * 0.3 + semantic_entropy * 0.3 AS composite_entropy, abs(word_entropy_change) * 0.5 + abs(length_entropy_change) * 0.5 AS info_change_intensity,
 word_entropy + filing_freq_entropy AS info_complexity, abs(word_entropy - word_entropy_rolling_mean) / (word_entropy_rolling_std + 1e-10) AS word_entropy_anomaly, word_entropy / (num_documents + 1) AS info_density,
 word_entropy_rolling_std AS info_volatility, word_entropy - word_entropy_rolling_mean AS info_trend FROM er)
SELECT *, """ + ", ".join(f"{_rank(c)} AS {c}_rank, ({c} - avg({c}) OVER (PARTITION BY filing_date)) / (stddev_samp({c}) OVER (PARTITION BY filing_date) + 1e-10) AS {c}_zscore" for c in FACTORS) + " FROM en"
_SCALED = COMPOSITES.replace("\nff AS (", "\nff0 AS (").replace(", tf AS (", f""", ae AS {_part(WORDS, "('0x' || substr(md5(word), 25, 8))::BIGINT % 10000", "approx_word_entropy")},
ff AS (SELECT f.* REPLACE (coalesce(std_vocabulary_diversity, 0) AS std_vocabulary_diversity, coalesce(filing_std_sentence_length, 0) AS filing_std_sentence_length, coalesce(avg_vocabulary_diversity, 0) AS avg_vocabulary_diversity),
 coalesce(approx_word_entropy, 0) AS approx_word_entropy FROM ff0 f LEFT JOIN ae USING (qid, filing_date)), tf AS (""")
SCALABLE_ENGINE = _SCALED + ", md AS (SELECT *, " + ", ".join(f"median({c}) OVER (PARTITION BY filing_date) AS m_{c}" for c in SEVEN) + " FROM cp), ma AS (SELECT *, " + ", ".join(
    f"median(abs({c} - m_{c})) OVER (PARTITION BY filing_date) AS d_{c}" for c in SEVEN
) + " FROM md) SELECT * EXCLUDE (" + ", ".join(f"{k}_{c}" for c in SEVEN for k in "md") + "), " + ", ".join(
    f"({_rank(c)}) / nullif(count({c}) OVER (PARTITION BY filing_date), 0) AS {c}_rank, ({c} - m_{c}) / (d_{c} + 1e-10) AS {c}_robust_zscore" for c in SEVEN
) + " FROM ma"

EVENTS = """, dd AS (SELECT qid, data_date, list_sort(list(DISTINCT data_date)) AS x FROM event_signals GROUP BY qid, data_date),
ds AS (SELECT qid, data_date, row_number() OVER (PARTITION BY qid ORDER BY data_date) AS k FROM (SELECT DISTINCT qid, data_date FROM event_signals)),
gp AS (SELECT qid, data_date, k, data_date AS kept FROM ds WHERE k = 1 UNION ALL
 SELECT ds.qid, ds.data_date, ds.k, CASE WHEN ds.data_date - gp.kept >= 45 THEN ds.data_date ELSE gp.kept END FROM gp JOIN ds ON ds.qid = gp.qid AND ds.k = gp.k + 1),
f1 AS (SELECT *, row_number() OVER (PARTITION BY qid, data_date ORDER BY date, value) AS n FROM event_signals),
mg AS (SELECT f.qid, f.date, f.value, f.data_date FROM f1 f JOIN gp ON f.qid = gp.qid AND f.data_date = gp.data_date AND gp.kept = gp.data_date WHERE f.n = 1)"""
MIN_GAP = EVENTS + " SELECT qid, date, value, data_date FROM mg"
EPANEL = EVENTS + """, tc AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i FROM (SELECT DISTINCT date FROM stock_returns)),
z AS (SELECT m.qid, m.data_date, m.value, (SELECT min(i) FROM tc WHERE tc.date > m.data_date) AS zero FROM mg m),
ep AS (SELECT z.qid, z.data_date, z.value, k.k AS event_day, tc.date, r.ret, r.ret - coalesce(k2.mkt_ret, 0) AS ar FROM z CROSS JOIN (SELECT unnest(range(-20, 61))::INT AS k) k
 JOIN tc ON tc.i = z.zero + k.k LEFT JOIN stock_returns r ON r.qid = z.qid AND r.date = tc.date LEFT JOIN market_returns k2 ON k2.date = tc.date)"""
EVENT_PANEL = EPANEL + " SELECT * FROM ep"
EQ = EPANEL + """, ev AS (SELECT DISTINCT qid, data_date, value FROM ep), ee AS (SELECT data_date, quantile_cont(value, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]) AS e FROM ev GROUP BY data_date),
qn AS (SELECT qid, data_date, CASE WHEN len(list_distinct(e)) = 6 THEN 'Q' || (len(list_filter(e[2:5], lambda x: x < value)) + 1)::VARCHAR ELSE 'Q_NA' END AS quantile FROM ev JOIN ee USING (data_date)),
pq AS (SELECT ep.*, qn.quantile FROM ep JOIN qn USING (qid, data_date))"""
EVENT_QUANTILES = EQ + " SELECT qid, data_date, quantile FROM qn"
CARS = EQ + """, c0 AS (SELECT quantile, event_day, avg(ar) AS mean_ar, stddev_samp(ar) AS std_ar, count(ar) AS n FROM pq GROUP BY ALL),
cr AS (SELECT *, sum(mean_ar) OVER (PARTITION BY quantile ORDER BY event_day) AS car, std_ar / nullif(sqrt(n), 0) AS se FROM c0)"""
CAR = CARS + " SELECT * FROM cr"
CAR_SPREAD = CARS + " SELECT a.event_day, a.car - b.car AS spread FROM cr a JOIN cr b ON a.event_day = b.event_day AND a.quantile = 'Q5' AND b.quantile = 'Q1'"
CAR_BAND = CARS + """ SELECT quantile, event_day, car * 100 AS car_pct, car * 100 - sum(se) OVER w * 1.96 * 100 AS lower, car * 100 + sum(se) OVER w * 1.96 * 100 AS upper
FROM cr WINDOW w AS (PARTITION BY quantile ORDER BY event_day)"""
TILTS = EQ + """, tl AS (SELECT qid, data_date, quantile, coalesce(sum(ar) FILTER (event_day BETWEEN 1 AND 5), 0) AS tilt_short, coalesce(sum(ar) FILTER (event_day BETWEEN 1 AND 60), 0) AS tilt_long FROM pq GROUP BY ALL),
lt AS (SELECT quantile, 'short' AS horizon, tilt_short AS tilt FROM tl UNION ALL SELECT quantile, 'long', tilt_long FROM tl),
tt AS (SELECT quantile, horizon, avg(tilt) AS mean, stddev_samp(tilt) AS std, count(tilt) AS n FROM lt GROUP BY ALL)"""
TILT_SUMMARY = TILTS + " SELECT * FROM tt"
TILT_TEST = TILTS + """ SELECT h.horizon, h.mean - l.mean AS spread, (h.mean - l.mean) / sqrt(((h.n - 1) * h.std * h.std + (l.n - 1) * l.std * l.std) / (h.n + l.n - 2) * (1.0 / h.n + 1.0 / l.n)) AS t_stat, h.n + l.n - 2 AS df
FROM tt h JOIN tt l ON h.horizon = l.horizon AND h.quantile = 'Q5' AND l.quantile = 'Q1'"""

# the p-value by Simpson's rule on the density of Student's t
TILT_SIGNIFICANCE = TILTS + ", tw AS (" + TILT_TEST[len(TILTS) :] + """), pv AS (SELECT *, greatest(0, 1 - 2 * abs(t_stat) / 2000 / 3 * exp(lgamma((df + 1) / 2.0::DOUBLE) - lgamma(df / 2.0::DOUBLE)) / sqrt(df * pi()) *
 list_sum(list_transform(range(0, 2001), lambda i: (CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * pow(1 + pow(abs(t_stat) * i / 2000, 2) / df, -(df + 1) / 2.0::DOUBLE)))) AS p_value FROM tw)
SELECT *, CASE WHEN p_value < 0.01 THEN '***' WHEN p_value < 0.05 THEN '**' WHEN p_value < 0.10 THEN '*' ELSE '' END AS stars FROM pv"""
BOOTSTRAP = TILTS + """, lg AS (SELECT quantile, tilt_long AS x, concat_ws(':', '42', qid::VARCHAR, data_date::VARCHAR) AS event FROM tl WHERE quantile IN ('Q1', 'Q5')),
nb AS (SELECT *, row_number() OVER (PARTITION BY quantile ORDER BY md5(event), event) AS place, count(*) OVER (PARTITION BY quantile) AS size FROM lg),
un AS (SELECT quantile, draw, floor(('0x' || substr(md5(event || ':' || draw), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE * size)::BIGINT + 1 AS place FROM nb CROSS JOIN (SELECT unnest(range(1, 501)) AS draw)),
mn AS (SELECT draw, avg(x) FILTER (quantile = 'Q5') - avg(x) FILTER (quantile = 'Q1') AS s FROM un JOIN nb USING (quantile, place) GROUP BY draw)
SELECT quantile_cont(s, 0.05) AS ci_low, quantile_cont(s, 0.95) AS ci_high, count(s) AS draws FROM mn"""

LEX = {"the": 0.2, "of": -0.1, "thing": 0.6, "that": -0.3, "stupid": -1.0, "worthless": -0.9, "der": 0.1, "die": -0.2, "und": 0.3, "de": 0.1, "la": -0.1, "que": 0.4, "les": 0.5, "con": -0.4, "end": -0.6}
NEGATIONS = ("a", "in", "ist", "un", "el")
HEDGES = ("thth", "een", "ou")
_POL = ", ".join(f"('{w}', {s}::DOUBLE)" for w, s in LEX.items())
_NEG = "[" + ", ".join(f"'{w}'" for w in NEGATIONS) + "]"
_HEDGE = " + ".join(f"(length(wlb) - length(replace(wlb, '{p}', ''))) / {len(p)}::DOUBLE" for p in HEDGES)
SCORES = rf""", lx(word, score) AS (VALUES {_POL}),
tk AS (SELECT *, list_filter(regexp_split_to_array(lower(wlb), '[^\p{{L}}\p{{N}}_]+'), lambda w: w != '') AS tok FROM reviews),
ps AS (SELECT review_id, unnest(tok) AS word, generate_subscripts(tok, 1) AS i, tok FROM tk),
hit AS (SELECT p.review_id, l.score, list_has_any(p.tok[p.i + 1:p.i + 3], {_NEG}) AS neg FROM ps p LEFT JOIN lx l ON p.word = l.word),
sm AS (SELECT review_id, avg(CASE WHEN neg THEN -score ELSE score END) AS m, count(score) AS matched, count(*) AS total, count(*) FILTER (neg AND score IS NOT NULL) AS negated FROM hit GROUP BY review_id),
sr AS (SELECT t.*, round(round(m, 10), 4) AS wlb_sentiment_score, coalesce(matched, 0) AS wlb_matched_words, coalesce(total, 0) AS wlb_total_words, CASE WHEN matched > 0 THEN round(matched / greatest(total, 1), 4) END AS wlb_coverage,
 coalesce(negated, 0) AS wlb_negation_count, CASE WHEN trim(wlb) = '' OR wlb IS NULL THEN 0 ELSE round(({_HEDGE}) / greatest(length(wlb) / 50.0::DOUBLE, 1), 4) END AS wlb_hedge_score FROM tk t LEFT JOIN sm USING (review_id))"""
LEXICON_SCORE = SCORES + " SELECT review_id, wlb_sentiment_score, wlb_matched_words, wlb_total_words, wlb_coverage, wlb_negation_count, wlb_hedge_score FROM sr"
QUALITY = SCORES + ", qf AS (SELECT * REPLACE (CASE WHEN wlb_coverage IS NULL OR wlb_coverage < 0.05 OR wlb_matched_words < 2 THEN NULL ELSE wlb_sentiment_score END AS wlb_sentiment_score) FROM sr)"
QUALITY_FILTER = QUALITY + " SELECT review_id, wlb_sentiment_score FROM qf"
REVIEW = QUALITY + """, nn AS (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY review_date, review_id) AS n_cumulative FROM qf),
o AS (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY review_date, review_id) AS k FROM nn WHERE wlb_sentiment_score IS NOT NULL),
ew AS (SELECT company_id, review_date, review_id, k, wlb_sentiment_score AS e FROM o WHERE k = 1 UNION ALL
 SELECT o.company_id, o.review_date, o.review_id, o.k, (1 - exp(-ln(2) / 180 * (o.review_date - ew.review_date))) * o.wlb_sentiment_score + exp(-ln(2) / 180 * (o.review_date - ew.review_date)) * ew.e
 FROM ew JOIN o ON o.company_id = ew.company_id AND o.k = ew.k + 1),
rw AS (SELECT n.company_id, n.review_date, n.review_id, n.n_cumulative, last_value(ew.e IGNORE NULLS) OVER (PARTITION BY n.company_id ORDER BY n.review_date, n.review_id ROWS UNBOUNDED PRECEDING) AS e
 FROM nn n LEFT JOIN ew ON n.review_id = ew.review_id)"""
REVIEW_EWMA = REVIEW + " SELECT company_id, review_date, review_id, n_cumulative, e AS wlb_sentiment_score_ewma FROM rw"
GRID = REVIEW + """, fr AS (SELECT d::DATE AS signal_date FROM (SELECT unnest(generate_series(DATE '2020-01-01', DATE '2022-06-30', INTERVAL 1 DAY)) AS d) WHERE isodow(d) = 5),
lv AS (SELECT company_id, review_date, max(n_cumulative) AS n_cumulative, arg_max({'e': e}, n_cumulative).e AS e FROM rw GROUP BY company_id, review_date),
gr AS (SELECT c.company_id, fr.signal_date, {pick} AS at FROM (SELECT DISTINCT company_id FROM rw) c CROSS JOIN fr),
sg AS (SELECT g.company_id, g.signal_date, l.n_cumulative, CASE WHEN g.signal_date - g.at <= 180 THEN l.e END AS e FROM gr g JOIN lv l ON l.company_id = g.company_id AND l.review_date = g.at WHERE l.n_cumulative >= 5)
SELECT company_id, signal_date, n_cumulative, e AS wlb_sentiment_score_ewma FROM sg"""
SIGNAL_GRID = {
    "exact": GRID.replace("{pick}", "(SELECT max(review_date) FROM lv WHERE lv.company_id = c.company_id AND review_date <= fr.signal_date AND review_date IN (SELECT signal_date FROM fr))"),
    "asof": GRID.replace("{pick}", "(SELECT max(review_date) FROM lv WHERE lv.company_id = c.company_id AND review_date <= fr.signal_date)"),
}
PATTERNS = {"policy": ("tion", "the th", "der", "que"), "hedge": HEDGES, "future": ("en ", "ará"), "past": ("ed", "ado", "st")}


def _count(p: str) -> str:
    return f"(length(wlb) - length(replace(wlb, '{p}', ''))) // {len(p)}"


DENSITIES = ", pd AS (SELECT review_id, company_id, review_date, len(regexp_extract_all(wlb, '[^ \\t\\n\\x0B\\f\\r]+'))::BIGINT AS n_words, " + ", ".join("(" + " + ".join(map(_count, ps)) + f")::BIGINT AS {g}_count" for g, ps in PATTERNS.items()) + """ FROM reviews),
de AS (SELECT *, """ + ", ".join(f"{g}_count / nullif(n_words, 0)::DOUBLE AS {g}_density" for g in PATTERNS) + ", future_count / nullif(past_count, 0)::DOUBLE AS orientation FROM pd)"
PATTERN_DENSITY = DENSITIES + " SELECT review_id, n_words, " + ", ".join(f"{g}_count, {g}_density" for g in PATTERNS) + " FROM de"
POLICY_SIGNALS = DENSITIES + """, rt AS (SELECT review_id, company_id, review_date, policy_density, orientation, policy_density / nullif(avg(policy_density) OVER h, 0) AS policy_ratio, orientation / nullif(avg(orientation) OVER h, 0) AS orientation_ratio FROM de
 WINDOW h AS (PARTITION BY company_id ORDER BY review_date RANGE BETWEEN INTERVAL 730 DAYS PRECEDING AND INTERVAL 1 DAY PRECEDING))
SELECT *, CASE WHEN policy_density IS NOT NULL THEN rank() OVER (PARTITION BY review_date ORDER BY policy_density NULLS LAST) + (count(*) OVER (PARTITION BY review_date, policy_density) - 1) / 2.0::DOUBLE END AS policy_rank FROM rt"""
REVIEW_COLUMNS = ("wlb", "long_term_development", "reason_to_quit")


def _review_of(column: str) -> str:
    """The chain from texts to averages for one text column, its parts named after the column."""
    chain = re.sub(r"\b(tk|ps|hit|sm|sr|qf|nn|o|ew|rw)\b", rf"\1_{column}", REVIEW.replace("FROM reviews", "FROM review_texts"))
    chain = chain.replace("wlb", column)
    return chain if column == REVIEW_COLUMNS[0] else ", " + chain[chain.index(f"tk_{column}") :]


REVIEW_PIPELINE = "".join(map(_review_of, REVIEW_COLUMNS)) + """, rw AS (SELECT a.company_id, a.review_date, a.n_cumulative, a.e AS e0, b.e AS e1, c.e AS e2
 FROM rw_wlb a JOIN rw_long_term_development b USING (review_id) JOIN rw_reason_to_quit c USING (review_id)),
fr AS (SELECT d::DATE AS signal_date FROM (SELECT unnest(generate_series(DATE '2020-01-01', DATE '2022-06-30', INTERVAL 1 DAY)) AS d) WHERE isodow(d) = 5),
lv AS (SELECT company_id, review_date, max(n_cumulative) AS n_cumulative, arg_max({'e0': e0, 'e1': e1, 'e2': e2}, n_cumulative) AS e FROM rw GROUP BY company_id, review_date),
gr AS (SELECT c.company_id, fr.signal_date, (SELECT max(review_date) FROM lv WHERE lv.company_id = c.company_id AND review_date <= fr.signal_date AND review_date IN (SELECT signal_date FROM fr)) AS at
 FROM (SELECT DISTINCT company_id FROM rw) c CROSS JOIN fr)
SELECT g.company_id, g.signal_date, l.n_cumulative, CASE WHEN g.signal_date - g.at <= 180 THEN l.e.e0 END AS wlb_sentiment_score_ewma, CASE WHEN g.signal_date - g.at <= 180 THEN l.e.e1 END AS long_term_development_sentiment_score_ewma,
 CASE WHEN g.signal_date - g.at <= 180 THEN l.e.e2 END AS reason_to_quit_sentiment_score_ewma FROM gr g JOIN lv l ON l.company_id = g.company_id AND l.review_date = g.at WHERE l.n_cumulative >= 5"""
SECTOR_Z = QUALITY + """ SELECT review_id, sector, (wlb_sentiment_score - avg(wlb_sentiment_score) OVER w) / (stddev_samp(wlb_sentiment_score) OVER w + 1e-8) AS z FROM qf WINDOW w AS (PARTITION BY sector, review_date)"""
LEXICON_MERGE = """, ordered AS (SELECT r_name AS word, 0.5::DOUBLE AS score, 0 AS p FROM region UNION ALL SELECT n_name, -0.5::DOUBLE, 1 FROM nation UNION ALL SELECT DISTINCT c_mktsegment, 0.1::DOUBLE, 2 FROM customer
 UNION ALL SELECT 'ASIA', -1.0::DOUBLE, 2 UNION ALL SELECT 'CHINA', 1.0::DOUBLE, 2)
SELECT word, arg_min(score, p) AS score FROM ordered GROUP BY word"""
LEXICON_FOLD = """, o AS (SELECT o_orderpriority AS word, round(o_totalprice / 1000, 3) AS s, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS k FROM orders),
f AS (SELECT word, k, s AS m FROM o WHERE k = 1 UNION ALL SELECT o.word, o.k, (f.m + o.s) / 2 FROM f JOIN o ON o.word = f.word AND o.k = f.k + 1)
SELECT word, arg_max(m, k) AS score FROM f GROUP BY word"""

#: The columns of each query that hold doubles, which twins round.
DOUBLES = {
    "correlation_matrix": "correlation",
    "dispersion_structure": "within \"cross\" ratio",
    "momentum_divergence": "momentum index_momentum divergence",
    "breadth_index": "index_signal normalised",
    "precision_ranking": "density precision_rank",
    "filing_delay": "relative_delay",
    "rebalance_portfolios": "weight",
    "pattern_density": "policy_density hedge_density future_density past_density",
    "policy_signals": "policy_density orientation policy_ratio orientation_ratio policy_rank",
    "feature_screening": "ic",
    "entropy_engine": "word_entropy length_entropy filing_freq_entropy semantic_entropy word_entropy_rolling_mean word_entropy_rolling_std length_entropy_rolling_mean word_entropy_change length_entropy_change composite_entropy info_change_intensity info_complexity word_entropy_anomaly info_density info_volatility info_trend word_entropy_rank length_entropy_rank filing_freq_entropy_rank semantic_entropy_rank composite_entropy_rank info_change_intensity_rank info_complexity_rank info_density_rank info_volatility_rank info_trend_rank word_entropy_zscore length_entropy_zscore filing_freq_entropy_zscore semantic_entropy_zscore composite_entropy_zscore info_change_intensity_zscore info_complexity_zscore info_density_zscore info_volatility_zscore info_trend_zscore",
    "scalable_entropy_engine": "document_size_entropy avg_vocabulary_diversity std_vocabulary_diversity filing_punctuation_complexity filing_conjunction_complexity filing_avg_sentence_length filing_std_sentence_length approx_word_entropy entropy_rolling_mean entropy_rolling_std diversity_rolling_mean entropy_change_rate diversity_change_rate entropy_cross_rank diversity_cross_rank entropy_momentum diversity_momentum information_complexity information_change_intensity information_anomaly information_density information_momentum relative_complexity_position information_volatility information_complexity_rank information_change_intensity_rank information_anomaly_rank information_density_rank information_momentum_rank relative_complexity_position_rank information_volatility_rank information_complexity_robust_zscore information_change_intensity_robust_zscore information_anomaly_robust_zscore information_density_robust_zscore information_momentum_robust_zscore relative_complexity_position_robust_zscore information_volatility_robust_zscore",
    "semantic_entropy": "semantic_entropy",
    "rolling_live_signal": "rolling_sum rolling_mean",
    "weighted_pnl": "weighted_return",
    "cum_pnl": "weighted_return cum",
    "strategy_metrics": "sharpe max_drawdown ann_vol total_return",
    "rolling_sharpe": "portfolio_return rolling_sharpe",
    "sector_sharpe": "mean std sharpe",
    "sector_sentiment_asof": "sector_sentiment total_weight",
    "sector_panel_ffill": "sector_sentiment",
    "sector_panel_bfill": "sector_sentiment",
    "sector_panel_zero": "sector_sentiment",
    "sector_panel_null": "sector_sentiment",
    "signal_features": "sector_sentiment sector_sentiment_ma5 sector_sentiment_ma20 sector_sentiment_diff1 sector_sentiment_diff5 sector_sentiment_zscore20",
    "sector_pivot": "AUTOMOBILE BUILDING FURNITURE HOUSEHOLD MACHINERY",
    "intervals_observed": "weight",
    "intervals_explicit": "weight",
    "pit_join": "sentiment weight weighted_sentiment",
    "sliding_sector_forward": "sector_sentiment weight_coverage sentiment_std max_single_weight",
    "sliding_sector_trailing": "sector_sentiment weight_coverage sentiment_std max_single_weight",
    "sector_signal_daily": "sector_sentiment weight_coverage sentiment_std max_single_weight",
    "gated_signal": "quality raw_signal final_signal",
    "signal_stats": "avg_quality avg_companies avg_weight_coverage volatility turnover coverage_pct",
    "etf_sentiment": "etf_sentiment covered_shares",
    "etf_sentiment_cross": "etf_sentiment covered_shares",
    "xs_zscore_quantile": "etf_sentiment signal_z signal_lag",
    "positions": "signal_lag raw_position weight",
    "positions_long_only": "weight",
    "net_returns": "gross_return cost net_return",
    "ic": "ic rank_ic",
    "quantile_returns": "mean_ret",
    "perf_stats": "ann_return ann_vol sharpe max_drawdown ann_turnover ann_cost mean_ic mean_rank_ic icir ic_positive",
    "weights_topn": "signal_value weight",
    "weights_zscore": "signal_value weight",
    "weights_rank_linear": "signal_value weight",
    "rebalance": "weight",
    "shares": "notional",
    "irregular_ewma": "value ewma",
    "stream_irregular_ewma": "value ewma",
    "stream_filing_delta": "signal",
    "filing_delta_halfopen": "signal",
    "filing_delta_closed": "signal",
    "signal_asof_lookup": "signal",
    "daily_differences": "length diff_vs_previous diff_vs_avg_previous",
    "longterm_percentile": "value long_ma percentile rolling_median z residual",
    "cross_section_summary": "index_value dispersion spread hhi breadth coverage",
    "momentum": "value momentum",
    "word_entropy": "word_entropy",
    "length_entropy": "length_entropy",
    "frequency_entropy": "filing_freq_entropy",
    "approx_word_entropy": "approx_word_entropy",
    "doc_features": "avg_sentence_length std_sentence_length vocabulary_diversity punctuation_per_sentence conjunctions_per_sentence",
    "filing_features": "document_size_entropy avg_vocabulary_diversity std_vocabulary_diversity filing_punctuation_complexity filing_conjunction_complexity filing_avg_sentence_length filing_std_sentence_length",
    "temporal_features": "entropy_rolling_mean entropy_rolling_std diversity_rolling_mean entropy_change_rate diversity_change_rate entropy_cross_rank diversity_cross_rank entropy_momentum diversity_momentum",
    "composites": "information_complexity information_change_intensity information_anomaly information_density information_momentum relative_complexity_position information_volatility",
    "robust_norm": "information_complexity_rank information_complexity_robust_zscore information_density_rank information_density_robust_zscore relative_complexity_position_rank relative_complexity_position_robust_zscore",
    "min_gap_filter": "value",
    "event_panel": "value ret ar",
    "car": "mean_ar std_ar car se",
    "car_spread": "spread",
    "car_band": "car_pct lower upper",
    "tilt_summary": "mean std",
    "tilt_test": "spread t_stat",
    "lexicon_score": "wlb_sentiment_score wlb_coverage wlb_hedge_score",
    "quality_filter": "wlb_sentiment_score",
    "review_ewma": "wlb_sentiment_score_ewma",
    "signal_grid_exact": "wlb_sentiment_score_ewma",
    "signal_grid_asof": "wlb_sentiment_score_ewma",
    "sector_zscore": "z",
    "review_pipeline": "wlb_sentiment_score_ewma long_term_development_sentiment_score_ewma reason_to_quit_sentiment_score_ewma",
    "rebalance_step": "signal_value weight",
    "sector_sentiment_median": "sector_sentiment total_weight",
    "sector_sentiment_sum": "sector_sentiment total_weight",
    "window_labels": "length",
    "tilt_significance": "spread t_stat p_value",
    "bootstrap": "ci_low ci_high",
    "lexicon_merge": "score",
    "lexicon_fold": "score",
}
