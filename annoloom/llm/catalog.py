"""Queries of the training-data operators over the driver's tables, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from annoloom.llm import bpe, fingerprint, html_consensus, minhash, mixing, pii, quality, secrets, toxicity, url_filter
from annoloom.llm.common import load

#: The rules of the url query: action, host, path.
URL_RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
VOCABULARY = "byte_bpe_50k.json"


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.report(load(spark, sf_dir, "documents"))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(load(spark, sf_dir, "documents"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(load(spark, sf_dir, "pages"), URL_RULES)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.report(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op5_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.report(load(spark, sf_dir, "documents"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(load(spark, sf_dir, "documents"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.report(load(spark, sf_dir, "documents"), vocabulary_path())


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(load(spark, sf_dir, "documents"))


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(load(spark, sf_dir, "documents"))


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_consensus.report(load(spark, sf_dir, "pages"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_mixing, op2_secrets, op3_url_filter, op4_toxicity, op5_fingerprint, op6_pii, op7_bpe, op8_quality, op9_minhash, op10_html)
    return {f.__name__: f for f in own}


def _url_sql() -> str:
    rules = ", ".join(f"('{a}', '{h}', '{p}')" for a, h, p in URL_RULES)
    return rf"""
WITH parts AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), split AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM parts
), rules(action, rule_host, rule_path) AS (VALUES {rules}
), fits AS (
  SELECT page_id, rule_host || rule_path AS rule, action,
         length(rule_host) - length(replace(rule_host, '.', '')) AS dots, length(rule_path) AS path_length
  FROM split JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
), best AS (
  SELECT page_id, max(struct_pack(dots := dots, path_length := path_length, rule := rule, action := action)) AS won FROM fits GROUP BY page_id
)
SELECT s.page_id, s.host, s.path, b.won.rule AS rule, coalesce(b.won.action, 'allow') AS verdict
FROM split s LEFT JOIN best b ON s.page_id = b.page_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_url_filter": _url_sql()}
