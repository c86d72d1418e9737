"""Queries op1 to op13 with production parameters over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import cut, documents
from .decontaminate import contaminated
from .divergence import audit_sources
from .exact_dedup import exact_dedup
from .html_extract import extract_pages
from .language_id import identify
from .licenses import scan_licenses
from .lm_score import score
from .packing import pack
from .runs import run_digests
from .shards import shard
from .simhash import near_dedup
from .token_counts import count_tokens, flat_blocks, name_counts
from .url_filters import HOST_WORDS, judge_urls


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(documents(spark, sf_dir)).select("doc_id", "fingerprint", "component_id")


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(documents(spark, sf_dir))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(documents(spark, sf_dir))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(documents(spark, sf_dir))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = cut(flat_blocks(documents(spark, sf_dir)), "flat-tokens")
    return name_counts(blocks, count_tokens(blocks))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(documents(spark, sf_dir))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_digests(documents(spark, sf_dir))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_sources(documents(spark, sf_dir))


def op13_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_packing, op2_html_extraction, op3_simhash, op4_lm_scoring, op5_sharding, op6_decontamination, op7_license_scan, op8_exact_dedup, op9_token_counts, op10_language_id, op11_periodic_runs, op12_source_divergence, op13_url_filters)}


def oracle_sql() -> dict[str, str]:
    return {
        "op8_exact_dedup": """
            WITH n AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents)
            SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, text_sha256
            FROM n WINDOW w AS (PARTITION BY text_sha256)""",
        "op12_source_divergence": r"""
            WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
            w AS (SELECT lang, source, id, unnest(terms) AS term FROM d),
            k AS (SELECT lang, term FROM w GROUP BY ALL HAVING count(DISTINCT id) >= 3),
            n AS (SELECT lang, source, term, count(*) AS n FROM w GROUP BY ALL),
            c AS (SELECT g.lang, g.source, k.term, coalesce(n.n, 0)::HUGEINT AS n FROM (SELECT DISTINCT lang, source FROM d) g JOIN k USING (lang) LEFT JOIN n ON n.lang = g.lang AND n.source = g.source AND n.term = k.term),
            p AS (SELECT lang, source, term, n, 1 + 1000000000 * (n + 1) // (sum(n) OVER w + count(*) OVER w) AS p FROM c WINDOW w AS (PARTITION BY lang, source)),
            l AS (SELECT lang, term, sum(n) AS n FROM c GROUP BY ALL),
            q AS (SELECT lang, term, 1 + 1000000000 * (n + 1) // (sum(n) OVER w + count(*) OVER w) AS q FROM l WINDOW w AS (PARTITION BY lang)),
            s AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
            g AS (SELECT DISTINCT lang, source FROM d),
            f AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
                  UNION ALL SELECT p.lang, p.source, 'term', p.term, ((p.p - q.q) * (p.p - q.q) // q.q)::BIGINT FROM p JOIN q USING (lang, term) WHERE p.n > 0 AND p.p > q.q),
            r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item COLLATE "binary")::INT AS rank FROM f)
            SELECT * FROM r WHERE part = 'pair' OR rank <= 200""",
        "op13_url_filters": rf"""
            WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
            h AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
            b AS (SELECT *, string_split(host, '.') AS labels, list_max(list_filter(range(1, len(string_split(host, '.'))), lambda i: list_has_any(string_split_regex(string_split(host, '.')[i], '[^a-z]+'), {list(HOST_WORDS)}))) AS bad FROM h),
            r AS (SELECT page_id, host, path, array_to_string(labels[bad:], '.') AS key, '.' || host AS dotted,
                         CASE WHEN '.' || host LIKE '%.example.org' AND starts_with(path, '/en/1') THEN 'example.org/en/1' WHEN '.' || host LIKE '%.example.org' AND starts_with(path, '/es/') THEN 'example.org/es/'
                              WHEN '.' || host LIKE '%.com' AND starts_with(path, '/fr/') THEN 'com/fr/' WHEN '.' || host LIKE '%.com' AND starts_with(path, '/de/') THEN 'com/de/'
                              WHEN '.' || host LIKE '%.org' AND starts_with(path, '/') THEN 'org/' END AS rule, bad FROM b)
            SELECT page_id, host, path, rule, CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL OR bad IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict, CASE WHEN bad IS NOT NULL THEN key END AS blocked_key FROM r""",
    }
