"""Facts, classifications and graphs read from the driver's tables.

Each view is one SQL text that Spark and DuckDB both accept; {array}, {compact} and
{string} stand for what the two write differently.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

_SPARK = {"array": "array", "compact": "array_compact", "split": "split"}
_DUCK = {"array": "list_value", "compact": "_compact", "split": "string_split"}

VIEWS: dict[str, str] = {
    "p_facts": """
SELECT o_orderkey AS fact_id, o_orderkey AS ord, o_custkey % 7 AS investigation_id,
  md5(CAST(o_custkey AS STRING) || '|' || o_orderpriority) AS content_hash,
  o_orderpriority || ' claim of ' || CAST(o_custkey AS STRING) AS claim_text,
  CASE o_orderstatus WHEN 'F' THEN 'statement' WHEN 'O' THEN 'denial' ELSE 'prediction' END AS assertion_type,
  CASE o_orderkey % 3 WHEN 0 THEN 'event' WHEN 1 THEN 'state' ELSE 'relationship' END AS claim_type,
  CAST(CAST(o_orderdate AS DATE) AS STRING) AS stored_at,
  CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 5 = 1 THEN substring(CAST(CAST(o_orderdate AS DATE) AS STRING), 1, 7) ELSE CAST(CAST(o_orderdate AS DATE) AS STRING) END AS temporal_value,
  CASE WHEN o_orderkey % 5 = 1 THEN 'month' ELSE 'day' END AS temporal_precision,
  CASE WHEN o_orderkey % 2 = 0 THEN 'explicit' ELSE 'inferred' END AS temporal_kind,
  CASE WHEN o_orderkey % 17 = 0 THEN '' WHEN o_orderkey % 19 = 0 THEN NULL ELSE 'src-' || CAST(o_custkey % 40 AS STRING) END AS source_id,
  CASE o_orderkey % 6 WHEN 0 THEN 'wire_service' WHEN 1 THEN 'official_statement' WHEN 2 THEN 'news_outlet' WHEN 3 THEN 'social_media' WHEN 4 THEN 'academic' END AS source_type,
  CASE o_orderkey % 4 WHEN 0 THEN 'primary' WHEN 1 THEN 'secondary' ELSE 'tertiary' END AS source_classification,
  CAST(o_orderkey % 4 AS INT) AS hop_count,
  CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE CAST(o_orderkey % 100 AS DOUBLE) / 100 END AS extraction_confidence,
  CAST(o_orderkey % 90 AS DOUBLE) / 100 AS claim_clarity,
  CAST(o_totalprice AS DOUBLE) AS low_value, CAST(o_totalprice AS DOUBLE) + o_orderkey % 50 AS high_value
FROM orders""",
    "p_class": """
SELECT o_orderkey AS fact_id, o_custkey % 7 AS investigation_id,
  CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'critical' ELSE 'less_critical' END AS impact_tier,
  {compact}({array}(CASE WHEN o_orderkey % 3 = 0 THEN 'phantom' END, CASE WHEN o_orderkey % 5 = 0 THEN 'fog' END, CASE WHEN o_orderkey % 2 = 0 THEN 'noise' END)) AS dubious_flags,
  CAST(o_totalprice AS DOUBLE) AS priority_score, CAST(o_orderkey % 101 AS DOUBLE) / 100 AS credibility_score
FROM orders WHERE o_orderkey % 11 <> 0""",
    "p_ver": """
SELECT o_orderkey AS fact_id, o_custkey % 7 AS investigation_id,
  CASE o_orderstatus WHEN 'F' THEN CASE WHEN o_orderkey % 8 = 1 THEN 'refuted' ELSE 'confirmed' END WHEN 'O' THEN 'pending' ELSE 'unverifiable' END AS status,
  CAST(o_orderkey % 100 AS DOUBLE) / 100 AS original_confidence, CAST(o_orderkey % 7 AS DOUBLE) / 10 AS confidence_boost,
  o_orderkey % 3 = 0 AS requires_human_review, o_orderkey % 6 = 0 AS human_review_completed,
  CASE WHEN o_orderkey % 8 = 1 THEN o_orderkey + 32 END AS related_fact_id
FROM orders WHERE o_orderkey % 4 <> 0""",
    "p_mentions": """
SELECT l_orderkey AS fact_id, o_custkey % 7 AS investigation_id, (l_orderkey * 10 + l_linenumber) * 10000000 + l_partkey AS ord, p_name AS canonical,
  CASE WHEN l_linenumber % 3 = 0 THEN '' ELSE upper(p_name) END AS name,
  CASE p_size % 4 WHEN 0 THEN 'PERSON' WHEN 1 THEN 'ORGANIZATION' WHEN 2 THEN 'LOCATION' ELSE 'EVENT' END AS entity_type
FROM lineitem JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey""",
    "p_evidence": """
SELECT l_orderkey AS fact_id, (l_orderkey * 10 + l_linenumber) * 10000000 + l_partkey AS ord, 'http://site' || CAST(l_suppkey AS STRING) || '.org/' || CAST(l_partkey AS STRING) AS source_url,
  'site' || CAST(l_suppkey AS STRING) || '.org' AS source_domain, CAST(l_discount AS DOUBLE) * 10 AS authority_score,
  CAST(l_quantity AS DOUBLE) / 50 AS relevance_score, l_returnflag <> 'R' AS supports_claim,
  CASE l_suppkey % 5 WHEN 0 THEN 'wire_service' WHEN 1 THEN 'official_statement' WHEN 2 THEN 'news_outlet' ELSE 'social_media' END AS source_type
FROM lineitem""",
    "p_articles": """
SELECT doc_id AS ord, 'http://' || source || '.example.com/' || CAST(doc_id % 700 AS STRING) || CASE WHEN doc_id % 3 = 0 THEN '?utm_source=x' WHEN doc_id % 5 = 0 THEN '#top' ELSE '' END AS url,
  CASE WHEN doc_id % 50 = 0 THEN '' ELSE source END AS source_name, lang AS investigation_id, text AS content, 'Title ' || CAST(doc_id AS STRING) AS title,
  CAST(doc_id % 10 AS DOUBLE) / 10 AS authority_score, CASE doc_id % 3 WHEN 0 THEN 'news' WHEN 1 THEN 'blog' END AS source_kind,
  CASE WHEN doc_id % 9 = 0 THEN NULL ELSE '2024-0' || CAST(doc_id % 9 + 1 AS STRING) || '-1' || CAST(doc_id % 10 AS STRING) || 'T0' || CAST(doc_id % 10 AS STRING) || ':00:00' END AS stored_at
FROM documents""",
    "p_events": """
SELECT event_id, user_id AS investigation_id, event_type, CAST(value AS DOUBLE) AS value, CAST(epoch_us(ts) AS BIGINT) AS ts_us
FROM events""",
    "p_reports": """
SELECT o_custkey AS investigation_id, o_orderkey AS version, md5(o_orderstatus || o_orderpriority) AS content_hash,
  CAST(CAST(o_orderdate AS DATE) AS STRING) AS generated_at, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderpriority END AS confidence_level
FROM orders""",
    "p_tasks": """
SELECT o_orderkey AS task_id, CAST(o_totalprice AS DOUBLE) AS priority, CAST(CAST(o_orderdate AS DATE) AS STRING) AS created_at,
  CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'pending' ELSE 'failed' END AS status, CAST(o_orderkey % 4 AS INT) AS retry_count,
  CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'crawl' WHEN 2 THEN 'verify' ELSE 'graph' END AS required_capability, 'src-' || CAST(o_custkey % 30 AS STRING) AS source_type
FROM orders""",
    "p_edges": """
SELECT 'Fact:' || CAST(l_orderkey AS STRING) AS src, 'Entity:' || CAST(l_partkey AS STRING) AS dst, 'MENTIONS' AS type, 1.0E0 AS weight, l_orderkey * 10 + l_linenumber AS ord FROM lineitem
UNION ALL SELECT 'Fact:' || CAST(l_orderkey AS STRING), 'Source:' || CAST(l_suppkey AS STRING), 'SOURCED_FROM', CAST(l_discount AS DOUBLE) * 10, l_orderkey * 10 + l_linenumber FROM lineitem
UNION ALL SELECT 'Fact:' || CAST(o_orderkey AS STRING), 'Investigation:' || CAST(o_custkey % 7 AS STRING), 'PART_OF', 1.0E0, o_orderkey FROM orders""",
    "p_pairs": """
SELECT 'Fact:' || CAST(o_orderkey AS STRING) AS src, 'Fact:' || CAST(o_orderkey + o_custkey % 9 + 1 AS STRING) AS dst,
  CASE WHEN o_orderkey % 2 = 0 THEN 'CORROBORATES' ELSE 'CONTRADICTS' END AS type, CAST(o_orderkey % 10 AS DOUBLE) / 10 AS weight, o_custkey % 7 AS investigation_id
FROM orders WHERE o_orderkey % 3 = 0""",
    "p_pages": """
SELECT page_id, url, html FROM pages""",
}
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _used(sql: str, names) -> list[str]:
    return [n for n in names if re.search(rf"\b{n}\b", sql)]


def _duck(sql: str) -> str:
    return re.sub(r"_compact\((list_value\((?:[^()]|\([^()]*\))*\))\)", r"list_filter(\1, lambda x: x IS NOT NULL)", sql.format(**_DUCK)) if "{" in sql else sql


def duck_sql(body: str) -> str:
    """body with the views that it names, for DuckDB."""
    used = _used(body, VIEWS)
    heads = [f"{n} AS ({_duck(VIEWS[n])})" for n in used]
    if not heads:
        return body
    stripped = body.lstrip()
    if stripped[:14].upper() == "WITH RECURSIVE":
        return f"WITH RECURSIVE {', '.join(heads)}, {stripped[14:]}"
    if stripped[:5].upper() == "WITH ":
        return f"WITH {', '.join(heads)}, {stripped[5:]}"
    return f"WITH {', '.join(heads)} {body}"


class Views:
    """The views over one directory, as DataFrames: views.p_facts and so on, views.table(name)."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def view(self, name: str) -> DataFrame:
        sql = VIEWS[name].format(**_SPARK).replace("epoch_us(ts)", "unix_micros(CAST(ts AS TIMESTAMP))")
        used = _used(sql, TABLES)
        for table in used:
            sql = re.sub(rf"\b(FROM|JOIN) {table}\b", rf"\1 {{{table}}}", sql)
        return self.spark.sql(sql, **{t: self.table(t) for t in used})

    def __getattr__(self, name: str) -> DataFrame:
        if name in VIEWS:
            return self.view(name)
        raise AttributeError(name)

    @cached_property
    def facts(self) -> DataFrame:
        return self.view("p_facts")


REGISTRY: dict[str, tuple] = {}


def query(name: str, sql: str | None):
    """Registers a function of Views as a query, with its DuckDB SQL."""

    def keep(fn):
        REGISTRY[name] = (fn, None if sql is None else duck_sql(sql))
        return fn

    return keep
