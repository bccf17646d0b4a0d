"""Views over the given tables that stand for the event pipeline's tables (FIXTURES.md).

One text per view serves Spark and DuckDB; MINUTES, SERIES and DIV are spelt
for each. A view names the views and tables it reads in braces.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from lexmere.session import table

VIEWS = {
    "v_document": """
SELECT doc_id AS id, text AS text_content, source AS source_id, 'doc-' || doc_id || '.txt' AS filename, 'text/plain' AS mime_type,
  CASE WHEN doc_id % 10 = 0 THEN 'failed' WHEN doc_id % 10 = 1 THEN 'pending' ELSE 'processed' END AS status,
  'p' || (doc_id % 6) AS provider_id, 'model-' || (doc_id % 6) AS model,
  CASE WHEN doc_id % 4 = 0 THEN 'instruct' ELSE 'thinking' END AS llm_mode, TIMESTAMP_NTZ '2024-01-01 00:00:00' + MINUTES(doc_id) AS created_at
FROM {documents}""",
    "v_provider": """
SELECT DISTINCT 'p' || k AS id, 'Provider ' || (7 - k) AS name, 'model-' || k AS model, 'http://host-' || k || '/v1' AS base_url,
  CASE WHEN k = 0 THEN '' WHEN k = 1 THEN 'abc' ELSE 'sk-' || (k * 1234567) END AS api_key, k = 0 AS is_default,
  CASE WHEN k % 2 = 0 THEN 0.5 + k / 10 END AS instruct_temperature, CASE WHEN k % 2 = 0 THEN 0.8 END AS instruct_top_p, CASE WHEN k % 2 = 0 THEN 20 + k END AS instruct_top_k,
  TIMESTAMP_NTZ '2024-01-01 00:00:00' + MINUTES(10 - k) AS created_at
FROM (SELECT doc_id % 6 AS k FROM {documents}) WHERE k < 5""",
    "v_color": "SELECT id AS provider_id, CAST(substr(id, 2) AS INT) AS color_index FROM {v_provider} WHERE id <> 'p4'",
    "v_event": """
SELECT event_id AS id, user_id % 200 AS document_id, event_id % 3 AS chunk_index, CASE WHEN event_id % 13 = 0 THEN '' ELSE event_type || ' ' || event_id END AS title,
  props AS description, CASE WHEN event_id % 17 = 0 THEN NULL ELSE ts END AS time_start, ts + MINUTES(event_id % 90) AS time_end,
  CASE WHEN event_id % 3 = 0 THEN 'day' WHEN event_id % 3 = 1 THEN 'month' ELSE 'year' END AS time_precision, CAST(event_id % 11 AS DOUBLE) / 10 AS extraction_confidence,
  'p' || (user_id % 200 % 6) AS provider_id, 'model-' || (user_id % 200 % 6) || CASE WHEN user_id % 200 % 4 = 0 THEN ' [I]' ELSE '' END AS model, ts AS created_at
FROM {events}""",
    "v_location": """
SELECT e.event_id * 10 AS id, e.event_id, n.n_name AS name, 'country' AS location_type,
  CASE WHEN k % 5 = 4 THEN NULL ELSE CAST(k * 7 % 180 - 90 AS DOUBLE) END AS lat, CASE WHEN k % 5 = 4 THEN NULL ELSE CAST(k * 13 % 360 - 180 AS DOUBLE) END AS lon
FROM (SELECT event_id, event_id % 25 AS k FROM {events} WHERE event_id % 3 = 0) e JOIN {nation} n ON n.n_nationkey = e.k""",
    "v_gazetteer": "SELECT n_name AS name, CAST(n_nationkey AS DOUBLE) + 0.5 AS lat, CAST(n_nationkey AS DOUBLE) * 2 AS lon FROM {nation} WHERE n_nationkey % 2 = 0",
    "v_participant": """
SELECT event_id * 10 + i AS id, event_id, 'person ' || ((event_id + i) % 97) AS name,
  CASE WHEN (event_id + i) % 3 = 0 THEN 'subject' WHEN (event_id + i) % 3 = 1 THEN 'object' ELSE 'witness' END AS role, CAST((event_id + i) % 5 AS DOUBLE) / 4 AS confidence
FROM (SELECT event_id, SERIES(1, event_id % 4) AS i FROM {events} WHERE event_id % 4 > 0)""",
    "v_ref": """
SELECT event_id AS id, event_id, document_id, chunk_index, kind AS reference_type,
  CASE WHEN event_id % 11 = 0 THEN 'no such text ' || event_id WHEN event_id % 5 = 0 THEN translate(q, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') ELSE q END AS verbatim_text, pos AS span_start, pos + 12 AS span_end
FROM (
  SELECT e.event_id, e.user_id % 200 AS document_id, e.event_id * 37 % 100 DIV 500 AS chunk_index, e.event_id * 37 % 100 AS pos, substr(d.text, CAST(1 + e.event_id * 37 % 100 AS INT), 12) AS q,
    CASE WHEN e.event_id % 5 = 0 THEN 'location' WHEN e.event_id % 5 = 1 THEN 'participant' WHEN e.event_id % 5 = 2 THEN 'time' WHEN e.event_id % 5 = 3 THEN 'description' ELSE 'bogus' END AS kind
  FROM {events} e JOIN {documents} d ON d.doc_id = e.user_id % 200)""",
    "v_quote": """
SELECT event_id AS id, event_id, document_id, chunk_index, kind AS reference_type,
  CASE WHEN event_id % 11 = 0 THEN 'no such text ' || event_id WHEN event_id % 5 = 0 THEN translate(q, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') ELSE q END AS verbatim_text, pos + 1 AS span_start, pos + 21 AS span_end
FROM (
  SELECT event_id, document_id, pos DIV 500 AS chunk_index, pos, substr(text, CAST(1 + pos AS INT), 20) AS q, CASE WHEN event_id % 2 = 0 THEN 'location' ELSE 'participant' END AS kind
  FROM (SELECT e.event_id, d.doc_id AS document_id, d.text, e.event_id * 7919 % greatest(length(d.text) - 20, 1) AS pos FROM {events} e JOIN {documents} d ON d.doc_id = e.user_id % 200))""",
    "v_history": """
SELECT id, document_id, chunk_index, title, description, CASE WHEN time_start IS NULL THEN NULL ELSE TIMESTAMP_NTZ '2022-11-03 00:00:00' + MINUTES((k + CASE WHEN k > 5 THEN 1 ELSE 0 END) * 43830 + id * 7717 % 30000) END AS time_start, time_precision, provider_id, model
FROM (SELECT *, id * 31 % 14 AS k FROM {v_event})""",
    "v_chunk": """
SELECT document_id, i AS chunk_index, substr(text, CAST(i * 500 + 1 AS INT), 500) AS text, i * 500 AS offset_start, least(n, i * 500 + 500) AS offset_end,
  1 + i * 500 DIV 1500 AS page_start, 1 + greatest(least(n, i * 500 + 500) - 1, 0) DIV 1500 AS page_end
FROM (SELECT doc_id AS document_id, text, length(text) AS n, SERIES(0, greatest(length(text) - 1, 0) DIV 500) AS i FROM {documents})""",
    "v_page_text": """
SELECT document_id, i AS page_no, substr(text, CAST(i * 1500 + 1 AS INT), 1500) AS text
FROM (SELECT doc_id AS document_id, text, SERIES(0, greatest(length(text) - 1, 0) DIV 1500) AS i FROM {documents})""",
    "v_usage": """
SELECT conv_id AS document_id, turn AS chunk_index, 'extract' AS step_name, 'model-' || (conv_id % 6) AS model, length(text) DIV 4 + 1 AS prompt_tokens, length(text) DIV 8 + 1 AS completion_tokens,
  length(text) DIV 4 + length(text) DIV 8 + 2 AS total_tokens, CASE WHEN turn % 2 = 0 THEN length(text) DIV 16 END AS cached_tokens,
  CASE WHEN conv_id % 3 > 0 THEN CAST(length(text) AS DOUBLE) / 4096 END AS cost, CAST(length(text) AS BIGINT) AS duration_ms, turn AS arrival
FROM {conversations} WHERE role = 'assistant' OR turn % 2 = 0""",
    "v_log": """
SELECT conv_id AS document_id, role AS step_name, CASE WHEN turn % 4 = 0 THEN 'info' WHEN turn % 4 = 1 THEN 'warning' WHEN turn % 4 = 2 THEN 'error' ELSE 'fatal' END AS severity,
  length(text) AS size, turn AS arrival
FROM {conversations}""",
    "v_entity": """
SELECT n_nationkey AS id, n_name AS name, 'place' AS entity_type FROM {nation}
UNION ALL SELECT 100 + k AS id, 'Person ' || k AS name, 'person' AS entity_type FROM (SELECT DISTINCT event_id % 97 AS k FROM {events})""",
    "v_mention": """
SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN lower(n_name) WHEN o_orderkey % 5 = 1 THEN 'the ' || n_name || ' court' WHEN o_orderkey % 5 = 2 THEN 'person ' || (o_orderkey % 120)
  WHEN o_orderkey % 5 = 3 THEN 'nobody ' || o_orderkey ELSE n_name END AS verbatim_text
FROM {orders} o JOIN {nation} n ON n.n_nationkey = o.o_orderkey % 25""",
}

_USED = re.compile(r"\{(\w+)\}")


def _spelt(text: str, spark: bool) -> str:
    if spark:
        text = re.sub(r"MINUTES\(", "make_dt_interval(0, 0, ", text)
        return re.sub(r"SERIES\(", "explode(sequence(", text).replace("explode(sequence(0, greatest(length(text) - 1, 0) DIV 500)", "explode(sequence(0, greatest(length(text) - 1, 0) DIV 500))").replace("DIV 1500) AS i", "DIV 1500)) AS i").replace("event_id % 4) AS i", "event_id % 4)) AS i")
    text = text.replace("TIMESTAMP_NTZ", "TIMESTAMP").replace(" DIV ", " // ").replace("MINUTES(", "to_minutes(")
    return re.sub(r"SERIES\((.*?)\) AS i", r"unnest(range(\1 + 1)) AS i", text)


class Views:
    """The tables and views of one folder as DataFrames: `views.v_event`."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name not in VIEWS:
            return table(self.spark, self.sf_dir, name)
        text = _spelt(VIEWS[name], True)
        found = self.spark.sql(text, **{n: getattr(self, n) for n in dict.fromkeys(_USED.findall(text))})
        setattr(self, name, found)
        return found


def with_views(sql: str) -> str:
    """A DuckDB query over views, with those it names put before it."""
    needed: list[str] = []

    def need(text: str) -> None:
        for n in dict.fromkeys(re.findall(r"\bv_\w+", text)):
            if n in VIEWS and n not in needed:
                need(VIEWS[n])
                needed.append(n)

    need(sql)
    parts = [f"{n} AS ({_USED.sub(r'\1', _spelt(VIEWS[n], False)).strip()})" for n in needed]
    sql = sql.strip()
    if not parts:
        return sql
    if sql[:15].upper() == "WITH RECURSIVE ":
        return "WITH RECURSIVE " + ",\n".join(parts) + ",\n" + sql[15:]
    if sql[:5].upper() == "WITH ":
        return "WITH " + ",\n".join(parts) + ",\n" + sql[5:]
    return "WITH " + ",\n".join(parts) + "\n" + sql
