"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tasklens.llm import common, contamination, fingerprint, htmltext, neardup, packing, quality, secrets, tokenfile, toxicity, urlrules

Query = Callable[[SparkSession, str], DataFrame]


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(common.documents(spark, sf_dir), percent=85)


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(common.documents(spark, sf_dir))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = tokenfile.write_blocks(common.documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return tokenfile.read_blocks(blocks)


def op4_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = toxicity.toxicity_scores(docs, model)
    return scored.select("doc_id", common.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "windows")


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(common.documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op7_url_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlrules.judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(common.documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), end_id=0)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = quality.quality_scores(docs, model)
    return scored.select("doc_id", common.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op10_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.leaks(common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_near_duplicates, op2_fingerprints, op3_token_files, op4_main_text, op5_toxicity, op6_secrets, op7_url_decisions, op8_packing, op9_quality, op10_contamination)}

_FOLD = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "list_filter(string_split_regex(" + _FOLD.format("coalesce(text, '')") + ", '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"
_SHINGLES = "list_distinct(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' ')))"

SQL: dict[str, str] = {
    "op7_url_decisions": r"""
WITH RECURSIVE parts AS (
  SELECT page_id, html, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM (SELECT *, CASE WHEN contains(coalesce(url, ''), '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages)
), links AS (
  SELECT host || path AS src, host, unnest(list_concat(
    list_transform(list_filter(regexp_extract_all(html, '(?i)(<link\b[^>]*>)', 1), lambda t: regexp_matches(t, '(?i)\brel\s*=\s*["'']?canonical["''\s/>]')), lambda t: regexp_extract(t, '(?i)\bhref\s*=\s*["'']?([^"''\s>]+)', 1)),
    list_transform(regexp_extract_all(html, '(?i)(<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*>)', 1), lambda t: regexp_extract(t, '(?i)\burl\s*=\s*["'']?([^"''\s>]+)', 1)))) AS target
  FROM parts WHERE html IS NOT NULL AND host <> ''
), ends AS (
  SELECT src, CASE WHEN contains(target, '://') THEN substr(target, strpos(target, '://') + 3) WHEN target[1] = '/' THEN host || target END AS rest FROM links
), edges AS (
  SELECT src, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS dst
  FROM ends WHERE rest IS NOT NULL AND rest[1] NOT IN ('/', '?', '#')
), both_ways AS (SELECT src AS a, dst AS b FROM edges UNION SELECT dst, src FROM edges),
reach AS (SELECT a, b FROM both_ways UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON r.b = e.a),
rules(kind, h, p) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
nodes AS (
  SELECT DISTINCT b, CASE WHEN contains(b, '/') THEN split_part(b, '/', 1) ELSE b END AS host, CASE WHEN contains(b, '/') THEN substr(b, strpos(b, '/')) ELSE '' END AS path FROM reach
), node_rule AS (
  SELECT b, arg_max(kind, length(h) + length(p)) AS kind FROM nodes JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY b
), class AS (SELECT r.a, min(n.kind) AS kind FROM reach r JOIN node_rule n ON r.b = n.b GROUP BY r.a),
own AS (
  SELECT page_id, host, path, (SELECT arg_max(h || p, length(h) + length(p)) FROM rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)) AS rule,
    (SELECT arg_max(kind, length(h) + length(p)) FROM rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)) AS kind FROM parts
)
SELECT page_id, host, path, rule, coalesce(own.kind, class.kind, 'allow') AS verdict FROM own LEFT JOIN class ON host <> '' AND class.a = host || path""",
    "op10_contamination": f"""
WITH items AS (SELECT item_id, w, least(len(w), 5) AS k FROM (SELECT item_id, {_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
item_shingles AS (SELECT item_id, k, unnest({_SHINGLES}) AS s FROM items),
sizes AS (SELECT item_id, count(*) AS n_item FROM item_shingles GROUP BY item_id),
docs AS (SELECT doc_id, w, k FROM (SELECT doc_id, {_WORDS} AS w FROM documents), (SELECT DISTINCT k FROM items)),
doc_shingles AS (SELECT DISTINCT doc_id, k, s FROM (SELECT doc_id, k, unnest({_SHINGLES}) AS s FROM docs WHERE len(w) >= k)),
met AS (SELECT doc_id, item_id, count(*) AS shared FROM doc_shingles JOIN item_shingles USING (k, s) GROUP BY ALL)
SELECT doc_id, item_id, shared, n_item FROM met JOIN sizes USING (item_id) WHERE 100 * shared >= 80 * n_item""",
}
