"""All registered queries by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveworks.operators import stores as S
from sieveworks.plans import extras, graphs, relational, rules  # noqa: F401
from sieveworks.plans.proxies import REGISTRY, Views


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: (lambda spark, sf_dir, fn=fn: fn(Views(spark, sf_dir))) for name, (fn, _) in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in REGISTRY.items() if sql}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = Views(spark, sf_dir)
    rows = S.enriched(v.p_facts, v.p_class, v.p_ver)
    return rows.groupBy("investigation_id", "impact_tier", "status").agg(F.count("*").alias("n")).orderBy("investigation_id", "impact_tier", "status")
