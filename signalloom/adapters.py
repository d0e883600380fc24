"""The relations that the operators work on, drawn from the test tables by SQL that Spark and DuckDB both run.

Rounded columns get a small addend first, so that values halfway between two roundings fall alike in both. Table names stand in braces; `frame` binds them to Parquet files, `cte` to views of the same names.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

RELATIONS: dict[str, str] = {
    "uncertainty": "SELECT user_id AS qid, CAST(ts AS DATE) AS date, avg(value) AS value FROM {events} GROUP BY user_id, CAST(ts AS DATE)",
    "signals": """SELECT c_mktsegment AS sector, CAST(o_orderdate AS DATE) AS date, avg(o_totalprice) / 200000.0 - 0.75 AS value
        FROM {orders} JOIN {customer} ON o_custkey = c_custkey GROUP BY c_mktsegment, CAST(o_orderdate AS DATE)""",
    "sector_returns": """SELECT c_mktsegment AS sector, CAST(l_shipdate AS DATE) AS date, (avg(l_discount) - 0.05) / 10.0 AS total_return
        FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {customer} ON o_custkey = c_custkey GROUP BY c_mktsegment, CAST(l_shipdate AS DATE)""",
    "filings": "SELECT o_custkey AS qid, o_orderkey AS document_id, CAST(o_orderdate AS DATE) AS date, o_totalprice AS length FROM {orders}",
    "snapshots": """SELECT sectorId, qid, date, round(v / sum(v) OVER (PARTITION BY sectorId, date), 3) AS weight FROM
        (SELECT c_mktsegment AS sectorId, o_custkey AS qid, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS date, sum(o_totalprice) AS v
         FROM {orders} JOIN {customer} ON o_custkey = c_custkey GROUP BY c_mktsegment, o_custkey, CAST(date_trunc('quarter', o_orderdate) AS DATE)) m""",
    "sentiment": """SELECT o_custkey AS id, l_orderkey * 10 + l_linenumber AS documentid, CAST(l_shipdate AS DATE) AS date, (l_discount - 0.05) * 20.0 AS sentiment
        FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey""",
    "reports": """SELECT o_custkey AS qid, CAST(l_shipdate AS DATE) AS date, l_orderkey AS document_id, (l_discount - 0.05) * 20.0 AS sentiment
        FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey""",
    "sector_info": """SELECT o_custkey AS qid, CAST(o_orderdate AS DATE) AS date, round(sum(o_totalprice) / 100000.0 + 0.0000001, 3) AS weight, max(c_mktsegment) AS sector
        FROM {orders} JOIN {customer} ON o_custkey = c_custkey GROUP BY o_custkey, CAST(o_orderdate AS DATE)""",
    "holdings": """SELECT c_mktsegment AS factset_entity_id, c_nationkey AS qid, round(sum(o_totalprice) + 0.001, 0) AS shares, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS report_date
        FROM {orders} JOIN {customer} ON o_custkey = c_custkey
        GROUP BY c_mktsegment, c_nationkey, CAST(date_trunc('quarter', o_orderdate) AS DATE)""",
    "doc_sentiment": """SELECT c_nationkey AS qid, CAST(l_shipdate AS DATE) AS date, l_orderkey AS document_id, (l_discount - 0.05) * 20.0 AS sentiment, l_linenumber AS numOfSentences
        FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {customer} ON o_custkey = c_custkey""",
    "etf_signal": """SELECT user_id AS factset_entity_id, CAST(ts AS DATE) AS date, round(avg(value) + 0.0000001, 4) AS etf_sentiment, CAST(count(*) AS DOUBLE) / 10 AS coverage
        FROM {events} GROUP BY user_id, CAST(ts AS DATE)""",
    "etf_returns": """SELECT user_id AS factset_entity_id, CAST(ts AS DATE) AS date, round((max(value) - min(value)) / 10000.0 - 0.002 + 0.0000000001, 6) AS ret
        FROM {events} GROUP BY user_id, CAST(ts AS DATE)""",
    "sections": "SELECT o_custkey AS id, CAST(o_orderdate AS DATE) AS date, o_orderpriority AS section FROM {orders}",
    "trade_signals": """SELECT CAST(c_nationkey AS VARCHAR(10)) AS sector_id, CAST(date_trunc('month', o_orderdate) AS DATE) AS date, round(avg(o_totalprice) / 100000.0 + 0.000000001, 6) AS signal_value
        FROM {orders} JOIN {customer} ON o_custkey = c_custkey GROUP BY c_nationkey, CAST(date_trunc('month', o_orderdate) AS DATE)""",
    "prices": """SELECT CAST(c_nationkey AS VARCHAR(10)) AS sector_id, CAST(date_trunc('month', o_orderdate) AS DATE) AS date, round(max(o_totalprice) / 1000.0 + 0.00001, 2) AS close
        FROM {orders} JOIN {customer} ON o_custkey = c_custkey GROUP BY c_nationkey, CAST(date_trunc('month', o_orderdate) AS DATE)""",
    "stock_returns": """SELECT s_nationkey AS qid, CAST(l_shipdate AS DATE) AS date, round((avg(l_discount) - 0.05) / 5.0 + 0.00000000001, 8) AS ret
        FROM {lineitem} JOIN {supplier} ON l_suppkey = s_suppkey GROUP BY s_nationkey, CAST(l_shipdate AS DATE)""",
    "market_returns": "SELECT CAST(l_shipdate AS DATE) AS date, round((avg(l_discount) - 0.05) / 5.0 + 0.00000000001, 8) AS mkt_ret FROM {lineitem} GROUP BY CAST(l_shipdate AS DATE)",
    "event_signals": """SELECT c_nationkey AS qid, CAST(o_orderdate AS DATE) AS date, max(o_totalprice) AS value, CAST(date_trunc('month', o_orderdate) AS DATE) AS data_date
        FROM {orders} JOIN {customer} ON o_custkey = c_custkey GROUP BY c_nationkey, CAST(o_orderdate AS DATE), CAST(date_trunc('month', o_orderdate) AS DATE)""",
    "sector_panel": """SELECT c_mktsegment AS sector, c_nationkey AS qid, CAST(date_trunc('month', o_orderdate) AS DATE) AS date, round(avg(o_totalprice) / 100000.0 - 1.5 + 0.000000001, 6) AS value
        FROM {orders} JOIN {customer} ON o_custkey = c_custkey GROUP BY c_mktsegment, c_nationkey, CAST(date_trunc('month', o_orderdate) AS DATE)""",
    "delays": """SELECT o_custkey AS qid, o_orderkey AS document_id, CAST(o_orderdate AS DATE) AS date, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS period_end FROM {orders}""",
    "panel_values": """SELECT c_nationkey AS qid, CAST(date_trunc('month', o_orderdate) AS DATE) AS date, round(avg(o_totalprice) + 0.0001, 2) AS value, round(sum(o_totalprice) + 0.0001, 2) AS weight
        FROM {orders} JOIN {customer} ON o_custkey = c_custkey GROUP BY c_nationkey, CAST(date_trunc('month', o_orderdate) AS DATE)""",
    "review_texts": """SELECT doc_id AS review_id, source AS company_id, lang AS sector, DATE '2020-01-01' + CAST(doc_id * 13 % 700 AS INT) AS review_date, text AS wlb,
        split_part(text, chr(10), 1) AS long_term_development, split_part(text, chr(10), 2) AS reason_to_quit FROM {documents}""",
    "reviews": """SELECT doc_id AS review_id, source AS company_id, lang AS sector, DATE '2020-01-01' + CAST(doc_id * 13 % 700 AS INT) AS review_date, text AS wlb FROM {documents}""",
}
#: Documents cut at newlines; the two dialects unnest differently.
SENTENCES = {
    "spark": """SELECT source AS qid, doc_id AS document_id, DATE '2023-01-01' + CAST(doc_id * 37 % 540 AS INT) AS filing_date, s.pos AS sentence_id, s.line AS sentence_text
        FROM {documents} LATERAL VIEW posexplode(split(text, '\\n', -1)) s AS pos, line""",
    "duckdb": """SELECT source AS qid, doc_id AS document_id, DATE '2023-01-01' + CAST(doc_id * 37 % 540 AS INT) AS filing_date, pos - 1 AS sentence_id, line AS sentence_text
        FROM (SELECT *, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents)""",
}
TABLE = re.compile(r"\{(\w+)\}")


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = SENTENCES["spark"] if name == "sentences" else RELATIONS[name].replace("VARCHAR(10)", "STRING")
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in set(TABLE.findall(sql))}
    return spark.sql(sql, **tables)


def cte(*names: str) -> str:
    """WITH clause that defines the relations for DuckDB."""
    parts = [f"{n} AS MATERIALIZED ({TABLE.sub(lambda m: m[1], SENTENCES['duckdb'] if n == 'sentences' else RELATIONS[n])})" for n in names]
    return "WITH RECURSIVE " + ",\n".join(parts)
