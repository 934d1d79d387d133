"""Export of one investigation as flat tables, and as one JSON document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveworks.operators import relations as R
from sieveworks.operators.stores import blank_as, of_tenant

VERSION = "1.0"


def flat_facts(facts: DataFrame) -> DataFrame:
    """Facts as flat rows; nested parts also as JSON text."""
    provenance = [c for c in ("source_id", "source_type", "source_classification", "hop_count") if c in facts.columns]
    out = facts.withColumn("provenance_json", F.to_json(F.struct(*provenance)))
    return out.withColumns({c: blank_as(c, "") for c in ("source_id", "temporal_value")})


def flat_classes(cls: DataFrame) -> DataFrame:
    return cls.withColumns({"impact_tier": F.coalesce("impact_tier", F.lit("less_critical")), "flags": F.to_json("dubious_flags")}).drop("dubious_flags")


def flat_verifications(ver: DataFrame) -> DataFrame:
    return ver.withColumns({c: F.col(c).cast("int") for c in ("requires_human_review", "human_review_completed")})


def tables(facts: DataFrame, cls: DataFrame, ver: DataFrame, mentions: DataFrame, investigation_id) -> dict[str, DataFrame]:
    mine = [of_tenant(t, investigation_id) for t in (facts, cls, ver, mentions)]
    return {"facts": flat_facts(mine[0]), "classifications": flat_classes(mine[1]), "verification_results": flat_verifications(mine[2]), "sources": R.export_sources(mine[0]), "entities": R.export_entities(mine[3])}


def write_tables(out: dict[str, DataFrame], path: str) -> None:
    for name, rows in out.items():
        rows.write.mode("overwrite").parquet(f"{path}/{name}")


def write_archive(facts: DataFrame, cls: DataFrame, ver: DataFrame, path: str, investigation_id) -> None:
    """One JSON line per row, marked with its table; no task or driver holds the whole archive."""
    head = facts.sparkSession.createDataFrame([("archive", VERSION)], "kind string, value string").select(F.to_json(F.struct("*")).alias("value"))
    parts = [of_tenant(t, investigation_id).select(F.to_json(F.struct(F.lit(n).alias("kind"), F.struct("*").alias("row"))).alias("value")) for n, t in (("fact", facts), ("classification", cls), ("verification", ver))]
    for part in parts:
        head = head.unionByName(part)
    head.write.mode("overwrite").text(path)


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Rows of an archive as (kind, row JSON); raises ValueError for another version or no header."""
    rows = spark.read.text(path)
    kind = F.get_json_object("value", "$.kind")
    versions = [r.v for r in rows.where(kind == "archive").select(F.get_json_object("value", "$.value").alias("v")).take(2)]
    if versions != [VERSION]:
        raise ValueError(f"archive versions {versions}, expected {VERSION}")
    return rows.where(kind != "archive").select(kind.alias("kind"), F.get_json_object("value", "$.row").alias("row"))
