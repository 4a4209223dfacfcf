"""The queries of this subpackage, by name, and DuckDB's SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fertility, merge_dropout, mixing, nearest, secret_scan, simhash, token_counts, token_files, url_filter, warc

#: The rules of the URL query.
RULES = [url_filter.Rule(*r) for r in (("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block"))]

#: The URL query's list: canonical URLs of hosts with one of these labels, so it grows with the pages.
LISTED_LABELS = ["casino-win", "free-bets", "spam-farm", "cheap-pills", "adult-x", "ads-track"]
#: The mixture: which sources make a domain, and the target weights of domains and languages; sources weigh by their tokens.
MIX = mixing.Tree(
    domains={name: tuple(f"src{i}" for i in range(at, at + 5)) for name, at in (("web", 0), ("books", 5), ("code", 10), ("news", 15))},
    weights={
        ("web",): 0.40, ("books",): 0.25, ("code",): 0.20, ("news",): 0.15, ("other",): 0.05,
        **{(domain, lang): w for domain in ("web", "books", "code", "news") for lang, w in (("en", 0.55), ("de", 0.2), ("fr", 0.15), ("es", 0.1))},
    },
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_rp_forest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digests(secret_scan.find_secrets(table(spark, sf_dir, "documents")))


def op3_tokeniser_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fertility.quality(table(spark, sf_dir, "documents"))


def op4_merge_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge_dropout.round_trips(table(spark, sf_dir, "documents"))


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = mixing.choices(table(spark, sf_dir, "documents"), tree=MIX)
    return chosen.select("doc_id", F.col("mix_domain").alias("domain"), F.col("mix_lang").alias("lang"), F.col("mix_source").alias("source"), F.col("mix_tokens").alias("n_tokens"), F.col("mix_copies").alias("copies"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


def op7_simhash_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return url_filter.judge(pages, RULES, url_filter.urls_of_hosts(pages, LISTED_LABELS))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = warc.write_archives(table(spark, sf_dir, "pages"))
    return warc.read_archives(archives, digest_only=True).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.read_token_files(token_files.write_token_files(table(spark, sf_dir, "documents")), digest_only=True)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        op1_rp_forest_neighbours, op2_secret_scan, op3_tokeniser_fertility, op4_merge_dropout, op5_source_mixing,
        op6_token_counts, op7_simhash_pivots, op8_url_filter, op9_warc, op10_token_files,
    )
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    return {"op8_url_filter": OP8, "op9_warc": OP9}


OP8 = r"""
WITH parsed AS (
  SELECT page_id,
    translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages
), named AS (
  SELECT *, CASE WHEN host = '' THEN '' ELSE host || regexp_replace(path, '/+$', '') END AS canonical FROM parsed
), listed AS (
  SELECT DISTINCT canonical FROM named WHERE regexp_matches(host, '(^|[.])(casino-win|free-bets|spam-farm|cheap-pills|adult-x|ads-track)([.]|$)')
), ruled AS (
  SELECT *, CASE
    WHEN ('.' || host) LIKE '%.example.com' AND starts_with(path, '/en/7') THEN 'example.com/en/7'
    WHEN ('.' || host) LIKE '%.example.net' AND starts_with(path, '/de/8') THEN 'example.net/de/8'
    WHEN ('.' || host) LIKE '%.com' AND starts_with(path, '/en/') THEN 'com/en/'
    WHEN ('.' || host) LIKE '%.net' AND starts_with(path, '/de/') THEN 'net/de/'
    WHEN ('.' || host) LIKE '%.org' AND starts_with(path, '/es/') THEN 'org/es/' END AS rule
  FROM named
)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('com/en/', 'example.net/de/8', 'org/es/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
       WHEN canonical IN (SELECT canonical FROM listed) THEN 'block' ELSE 'allow' END AS verdict,
  canonical
FROM ruled
"""

OP9 = """
WITH payloads AS (
  SELECT page_id, coalesce(html, '') AS body, strlen(coalesce(html, '')) AS payload_bytes FROM pages
), firsts AS (
  SELECT *, min(page_id) OVER (PARTITION BY body) AS first_id FROM payloads
)
SELECT page_id, payload_bytes, sha256(body) AS payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id > first_id THEN first_id END AS refers_to
FROM firsts
"""
