"""Registered queries of the training-data operators, each over its whole table with production parameters.

``QUERIES`` maps a name to ``(spark, sf_dir) -> DataFrame``; ``SQL`` holds the DuckDB twin where SQL can say it.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import (bpe, brown, conversation_repair, exact_dedup, hard_negatives, language_id, licenses, ngram_join,
                          packing, prefix_forest, substring_rlz, suffix_dedup, url_filter)
from tidemark.llm.common import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return deco


@register("op1_packing")
def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id",
                         "offset")


@register("op9_byte_bpe")
def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = bpe.round_trip(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"),
                          public_tokenizers.PATTERN)
    return done.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))


@register("op4_exact_dedup", """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""")
def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(read_table(spark, sf_dir, "documents"))


_HOST = r"translate(regexp_extract(regexp_extract({u}, '(?s)^.*?://(.*)$', 1), '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PATH = r"regexp_extract(regexp_extract({u}, '(?s)^.*?://[^/?#]*(.*)$', 1), '^[^?#]*', 0)"


def _op6_sql() -> str:
    q = lambda s: "'" + s.replace("'", "''") + "'"
    rules = ", ".join(f"({q(v)}, {q(h)}, {q(p)})" for v, h, p in url_filter.RULES)
    links = " UNION ".join(f"SELECT url AS a, regexp_extract(html, {q(p)}, 1) AS b FROM pages"
                           for p in (url_filter.CANONICAL, url_filter.CANONICAL_REV, url_filter.REFRESH))
    return f"""
WITH RECURSIVE rules(v, h, p) AS (VALUES {rules}),
edges AS (SELECT a, b FROM ({links} UNION SELECT url, split_part(url, '#', 1) FROM pages)
          WHERE a IS NOT NULL AND b LIKE '%://%' AND a <> b),
both_ways AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
reach(a, b) AS (SELECT a, a FROM both_ways UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON r.b = e.a),
urls AS (SELECT DISTINCT url AS u FROM pages WHERE url IS NOT NULL UNION SELECT a FROM both_ways),
hp AS (SELECT u, {_HOST.format(u='u')} AS host, {_PATH.format(u='u')} AS path FROM urls),
best AS (SELECT u, v, h || p AS rule FROM hp JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
         QUALIFY row_number() OVER (PARTITION BY u ORDER BY length(h || p) DESC) = 1),
spread AS (SELECT r.a AS u, bool_or(v = 'block') AS blocked, bool_or(v = 'allow') AS allowed, min(r.b) AS component
           FROM reach r LEFT JOIN best ON best.u = r.b GROUP BY 1)
SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, rule, component,
       coalesce(v, CASE WHEN coalesce(blocked, false) AND NOT coalesce(allowed, false) THEN 'block' ELSE 'allow' END) AS verdict
FROM pages LEFT JOIN hp ON hp.u = pages.url LEFT JOIN best ON best.u = pages.url LEFT JOIN spread ON spread.u = pages.url"""


@register("op6_url_filter", _op6_sql())
def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(read_table(spark, sf_dir, "pages"))


@register("op10_license_scan", licenses.sql())
def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read_table(spark, sf_dir, "documents"))


@register("op5_language_id")
def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    pieces = public_tokenizers.path("piece_bpe_32k.model")
    model = language_id.fit(docs.where(language_id.fold(F.col("doc_id")) != 0), pieces)
    held = docs.select("doc_id", "text", F.coalesce(language_id.fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"))
    return language_id.predict(held, model, pieces, keep=("held_out",))


@register("op3_ngram_join")
def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(read_table(spark, sf_dir, "documents"))


@register("op8_suffix_dedup")
def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = suffix_dedup.remove_repeats(read_table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@register("op2_brown_classes")
def op2_brown_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return brown.class_scores(docs.withColumn("held_out", language_id.fold(F.col("doc_id")) == 1))


@register("op7_prefix_forest")
def op7_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_forest.search(read_table(spark, sf_dir, "embeddings"))


@register("op11_hard_negatives", """
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label END AS label,
         [floor(256 * x::DOUBLE) FOR x IN embedding] AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
scored AS MATERIALIZED (
  SELECT a.rid, a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same, list_dot_product(a.v, r.v)::BIGINT AS score
  FROM kept a JOIN kept r ON a.rid <> r.rid WHERE a.vec_id % 100 = 0),
positives AS (
  SELECT rid, anchor_id, vec_id AS positive_id, score AS positive_score,
         row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id) AS nth
  FROM scored WHERE same QUALIFY nth <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY rid, nth ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM positives p JOIN scored USING (rid)
WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score QUALIFY rank <= 5""")
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.col("label").cast("long").alias("label"))
    turned = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(rows.withColumn("label", turned))


@register("op12_conversation_repair")
def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return conversation_repair.repair(conversation_repair.damage(rows))


@register("op13_substring_dedup", r"""
WITH words AS (SELECT doc_id, CASE WHEN text IS NULL THEN [] ELSE regexp_extract_all(text, '[^\x20\x09-\x0D]+') END AS w FROM documents),
windows AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS t
            FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM words)),
again AS (SELECT doc_id, i FROM windows JOIN (SELECT t, min(doc_id) AS least FROM windows GROUP BY t) USING (t) WHERE doc_id > least),
gone AS (SELECT DISTINCT doc_id, i + k AS i FROM again, range(13) r(k)),
lists AS (SELECT doc_id, list(i) AS g FROM gone GROUP BY doc_id)
SELECT words.doc_id, len(w)::BIGINT AS n_words, coalesce(len(g), 0)::BIGINT AS n_removed,
       sha256(coalesce(array_to_string(CASE WHEN g IS NULL THEN w ELSE [x FOR x, j IN w IF NOT list_contains(g, j)] END, ' '), '')) AS kept_sha256
FROM words LEFT JOIN lists USING (doc_id)""")
def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = substring_rlz.remove_earlier(read_table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
