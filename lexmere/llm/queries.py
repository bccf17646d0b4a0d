"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmere.session import table


def op1_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexmere.llm import ann

    vectors = table(spark, sf_dir, "embeddings")
    found = ann.nearest(vectors, vectors.where("vec_id % 100 = 0"))
    return found.withColumnRenamed("id", "vec_id")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from lexmere.llm import bpe

    found = bpe.token_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return found.withColumnRenamed("id", "doc_id")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexmere.llm import simhash

    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexmere.llm import decontaminate

    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("doc").alias("doc_id"), "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
i AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
wi AS (
  SELECT DISTINCT item_id, w[s + 1:s + 10] AS win
  FROM (SELECT item_id, w, unnest(range(0, greatest(len(w) - 10, 0) + 1)) AS s FROM i WHERE len(w) > 0)),
ks AS (SELECT DISTINCT len(win) AS k FROM wi),
dw AS (
  SELECT doc_id, s, k, w[s + 1:s + k] AS win
  FROM (SELECT doc_id, w, k, unnest(range(0, len(w) - k + 1)) AS s FROM d, ks WHERE len(w) >= k)),
m AS (SELECT doc_id, s, k, item_id FROM dw JOIN wi USING (win)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + k)) AS p FROM m) GROUP BY doc_id),
it AS (
  SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit ON d.doc_id = hit.doc_id LEFT JOIN it ON d.doc_id = it.doc_id
"""


SITES = {"com/": "allow", "example.com/en/": "block", "www.example.com/en/": "allow", "net/es/": "block", "net/fr/": "block"}


def op5_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexmere.llm import urlfilter

    judged = urlfilter.judge(table(spark, sf_dir, "pages"), SITES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


OP5_SQL = r"""
WITH r(rule, verdict) AS (VALUES ('com/', 'allow'), ('example.com/en/', 'block'), ('www.example.com/en/', 'allow'), ('net/es/', 'block'), ('net/fr/', 'block')),
rest AS (SELECT page_id, url, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS s FROM pages),
p AS (
  SELECT page_id, url, translate(regexp_extract(s, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(substr(s, length(regexp_extract(s, '^[^/?#]*')) + 1), '^[^?#]*') AS path
  FROM rest),
f AS (
  SELECT p.*, (SELECT max_by(struct_pack(rule := rule, verdict := verdict), length(rule)) FROM r
    WHERE (host = split_part(rule, '/', 1) OR ends_with(host, '.' || split_part(rule, '/', 1)))
      AND starts_with(path, substr(rule, instr(rule, '/')))) AS m
  FROM p)
SELECT page_id, host, path, m.rule AS rule,
  coalesce(m.verdict, CASE WHEN regexp_matches(lower(host || path),
    '(^|[^a-z0-9])(casino|free[^a-z0-9]bets|cheap[^a-z0-9]pills|spam[^a-z0-9]farm|ads[^a-z0-9]track|adult[^a-z0-9]x)([^a-z0-9]|$)')
    THEN 'block' ELSE 'allow' END) AS verdict
FROM f
"""


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexmere.llm import chat

    extra = spark.range(2).selectExpr("-1L conv_id", "id turn", "if(id = 0, 'user', 'assistant') role", "'</s>[INST] ok [/INST]' text")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.format_conversations(turns).withColumnRenamed("conv", "conv_id")


OP6_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
o AS (
  SELECT *, lag(role) OVER w AS before, row_number() OVER w AS k, count(*) OVER (PARTITION BY conv_id) AS n,
    length(text) * 2 - length(translate(text, '[<', '')) AS shown
  FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(3 + sum(shown + CASE role WHEN 'system' THEN 13 WHEN 'user' THEN 15 WHEN 'assistant' THEN 11
    ELSE 23 + length(role) * 2 - length(translate(role, '[<', '')) END) AS BIGINT) AS formatted_chars,
  bool_and(CASE WHEN before IS NULL THEN role IN ('system', 'user') WHEN before = 'system' THEN role = 'user'
    WHEN before = 'user' THEN role = 'assistant' WHEN before = 'assistant' THEN role = 'user' ELSE false END) AS in_order,
  max_by(role, k) = 'assistant' AS complete
FROM o GROUP BY conv_id
"""


def _classified(found: DataFrame, least: float) -> DataFrame:
    from lexmere.llm.labelled import held_out

    return found.select(F.col("id").alias("doc_id"), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexmere.llm import quality

    docs = table(spark, sf_dir, "documents")
    return _classified(quality.scores(docs, quality.fit(docs, table(spark, sf_dir, "labels"))), 0.7)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexmere.llm import toxicity

    docs = table(spark, sf_dir, "documents")
    return _classified(toxicity.scores(docs, toxicity.fit(docs, table(spark, sf_dir, "labels"))), 0.3)


def op9_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexmere.llm import passages

    return passages.duplicate_passages(table(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from lexmere.llm import tokencount

    found = tokencount.section_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return found.withColumnRenamed("id", "doc_id")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexmere.llm import codes

    rows, books = codes.compressed(table(spark, sf_dir, "embeddings"))
    found = codes.with_label_errors(rows).withColumn("codebooks_sha256", F.lit(codes.digest(books)))
    return found.select(F.col("id").alias("vec_id"), "code", "error", "label_error", "codebooks_sha256")


def _op11_sql(rounds: int = 6) -> str:
    met = "SELECT x.vec_id, x.p, any_value(x.e) AS e, min(16 * list_sum([(y[1] - y[2]) * (y[1] - y[2]) FOR y IN list_zip(x.e, b.e)]) + b.i) AS m FROM parts x JOIN b{0} b USING (p) GROUP BY x.vec_id, x.p"
    mean = "SELECT p, i, list(q ORDER BY j) AS e FROM (SELECT p, m % 16 AS i, j, CAST(floor(sum(e[j + 1]) / count(*)) AS BIGINT) AS q FROM a{0}, (SELECT unnest(range(len(e))) AS j FROM b0 WHERE p = 0 AND i = 0) GROUP BY ALL) GROUP BY p, i"
    steps = "".join(f"a{r} AS MATERIALIZED ({met.format(r)}),\nb{r + 1} AS MATERIALIZED (SELECT b.p, b.i, coalesce(n.e, b.e) AS e FROM b{r} b LEFT JOIN ({mean.format(r)}) n ON n.p = b.p AND n.i = b.i),\n" for r in range(rounds))
    return f"""
WITH v AS (
  SELECT vec_id, [CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS c
  FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (SELECT vec_id, p, c[p * (len(c) // 8) + 1:(p + 1) * (len(c) // 8)] AS e FROM v, range(8) t(p)),
b0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS i, e FROM parts QUALIFY row_number() OVER (PARTITION BY p ORDER BY vec_id) <= 16),
{steps}a{rounds} AS MATERIALIZED ({met.format(rounds)}),
r AS (SELECT vec_id, string_agg(printf('%02x', m % 16), '' ORDER BY p) AS code, CAST(sum(m // 16) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id)
SELECT r.vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(array_to_string(e, ','), ',' ORDER BY p, i)) FROM b{rounds}) AS codebooks_sha256
FROM r JOIN embeddings USING (vec_id)
"""


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexmere.llm import negatives

    changed = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label").cast("long"))
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", changed.alias("label"))
    return negatives.hard_negatives(vectors, vectors.where("vec_id % 100 = 0"))


OP12_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS c
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, a.label AS own, b.vec_id, b.label, CAST(list_sum([x[1] * x[2] FOR x IN list_zip(a.c, b.c)]) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, own, vec_id AS positive_id, score AS positive_score FROM s WHERE label = own QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INT) AS rank, s.vec_id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE s.label <> p.own AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) QUALIFY row_number() OVER w <= 10
"""


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import uuid

    import public_tokenizers

    from lexmere.llm import tokenfiles
    from lexmere.session import shared_dir

    where = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    tokenfiles.write(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), where)
    return tokenfiles.digests(spark, where).withColumnRenamed("id", "doc_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {"op4_decontamination": OP4_SQL, "op5_urls": OP5_SQL, "op6_chat": OP6_SQL, "op11_vector_codes": _op11_sql(), "op12_hard_negatives": OP12_SQL}
