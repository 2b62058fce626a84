"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomix.llm import chat, decontamination, exact_dedup, html_extraction, licenses, line_dedup, near_dedup, pieces, secrets, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold 13-word windows of benchmark items."""
    found = decontamination.find_contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", decontamination.n_hit().alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256")).withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def held_out(doc_id: str):
    """The fold whose labels are never learnt from."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all documents."""
    docs = _table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.train(docs, _table(spark, sf_dir, "labels"), held_out=held_out), keep=["doc_id"])
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", F.when(F.col("score") >= toxicity.THRESHOLD, 1).otherwise(0).alias("predicted"))


def op3_chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every dialogue from the perspective of each participant."""
    return chat.rotate(_table(spark, sf_dir, "conversations"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without recurring lines."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.drop_recurring_lines(docs, min_tokens=line_dedup.EVERY_LINE, counts=True)


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents whose 5-word shingle sets have a similarity of 0.85 or more."""
    return near_dedup.near_groups(_table(spark, sf_dir, "documents"))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    return html_extraction.with_length(html_extraction.extract_pages(_table(spark, sf_dir, "pages")))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets by pattern and by randomness."""
    found = secrets.find_secrets(_table(spark, sf_dir, "documents"))
    counts = [secrets.n_kind("base", k).alias(f"n_{k}") for k in secrets.KINDS[:3]]
    return found.select("doc_id", *counts, F.sha2(secrets.span_string("base"), 256).alias("base_sha256"), secrets.span_string("spans").alias("spans"))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Piece ids of all documents."""
    encoded = pieces.encode_pieces(_table(spark, sf_dir, "documents"), keep=["doc_id"])
    return encoded.select("doc_id", "ids", F.size("ids").cast("long").alias("n_ids"), "round_trip")


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts."""
    return exact_dedup.exact_groups(_table(spark, sf_dir, "documents"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License notices in all documents."""
    found = licenses.find_licenses(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.size("licenses").cast("long").alias("n_licenses"), licenses.license_string("licenses").alias("licenses"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_toxicity": op2_toxicity,
    "op3_chat_rotation": op3_chat_rotation,
    "op4_line_dedup": op4_line_dedup,
    "op5_near_dedup": op5_near_dedup,
    "op6_html_extraction": op6_html_extraction,
    "op7_secrets": op7_secrets,
    "op8_sentencepiece": op8_sentencepiece,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_licenses": op10_licenses,
}

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE_SQL: dict[str, str] = {
    "op1_decontamination": rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
g AS (SELECT DISTINCT item_id, least(13, len(w)) AS size, array_to_string(w[p : p + least(13, len(w)) - 1], ' ') AS words
      FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS p FROM i WHERE len(w) > 0)),
s AS (SELECT DISTINCT size FROM g),
p AS (SELECT r, w, unnest(range(1, len(w) + 1)) AS p FROM d),
k AS (SELECT r, p, size, array_to_string(w[p : p + size - 1], ' ') AS words FROM p, s WHERE p + size - 1 <= len(w)),
h AS (SELECT k.r, k.p, k.size, g.item_id FROM k JOIN g ON k.size = g.size AND k.words = g.words),
n AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + size)) AS q FROM h) GROUP BY r),
t AS (SELECT r, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS items FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS x FROM h) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN n USING (r) LEFT JOIN t USING (r)
""",
    "op3_chat_rotation": r"""
WITH r AS (SELECT conv_id, turn, coalesce(nullif(trim(replace(translate(role, chr(10) || chr(11) || chr(12) || chr(13) || chr(133) || chr(8232) || chr(8233), '       '), '<|', '< |')), ''), 'unknown') AS role,
      replace(coalesce(text, ''), '<|', '< |') AS words FROM conversations),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, words) - 1 AS pos FROM r),
s AS (SELECT DISTINCT conv_id, role AS speaker FROM r WHERE role <> 'system'),
v AS (SELECT o.conv_id, speaker, CAST(floor(pos / 256) AS BIGINT) AS segment, pos, role = speaker AS mine,
      '<|im_start|>' || CASE WHEN role = speaker THEN 'assistant' WHEN role = 'system' THEN 'system' ELSE 'user name=' || role END || chr(10) AS head, words || '<|im_end|>' || chr(10) AS body
      FROM o JOIN s ON o.conv_id IS NOT DISTINCT FROM s.conv_id),
p AS (SELECT *, sum(length(head) + length(body)) OVER (PARTITION BY conv_id, speaker, segment ORDER BY pos) AS stop FROM v)
SELECT conv_id, speaker, segment, count(*) AS n_turns, count(*) FILTER (WHERE mine) AS n_target, string_agg(head || body, '' ORDER BY pos) AS text,
       coalesce(string_agg(CAST(CAST(stop - length(body) AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(stop - 1 AS BIGINT) AS VARCHAR), ',' ORDER BY pos) FILTER (WHERE mine), '') AS mask
FROM p GROUP BY conv_id, speaker, segment
""",
    "op5_near_dedup": r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT r, doc_id, array_to_string(w[p : p + 4], ' ') AS words FROM (SELECT r, doc_id, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS p FROM d WHERE len(w) > 0)),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
b AS (SELECT a.r AS x, b.r AS y, a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s a JOIN s b ON a.words = b.words AND a.r < b.r GROUP BY ALL),
k AS (SELECT u, v FROM b JOIN n nx ON nx.r = x JOIN n ny ON ny.r = y WHERE 100 * c >= 85 * (nx.n + ny.n - c)),
e AS (SELECT u, v FROM k UNION SELECT v, u FROM k),
m AS (SELECT doc_id, doc_id AS c FROM d UNION SELECT e.v, m.c FROM m JOIN e ON e.u = m.doc_id),
g AS (SELECT doc_id, min(c) AS component_id FROM m GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM d LEFT JOIN n USING (r) JOIN g USING (doc_id)
""",
    "op9_exact_dedup": r"""
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = min(doc_id) OVER g AS kept, text_sha256
FROM t WINDOW g AS (PARTITION BY text_sha256)
""",
}
