"""Scans, filters, pages and statistics over stores that are scoped by investigation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def blank_as(column: Column | str, default) -> Column:
    """Null or empty takes the default."""
    c = F.col(column) if isinstance(column, str) else column
    return F.coalesce(F.nullif(c, F.lit("")), default if isinstance(default, Column) else F.lit(default))


def of_tenant(rows: DataFrame, investigation_id) -> DataFrame:
    return rows.where(F.col("investigation_id") == investigation_id)


def scan(rows: DataFrame, investigation_id, limit: int | None = None, offset: int = 0, order: str = "ord") -> DataFrame:
    """A page of one tenant's rows in insertion order; no or zero limit returns the rest."""
    out = of_tenant(rows, investigation_id).orderBy(order).offset(offset)
    return out.limit(limit) if limit else out


def total(rows: DataFrame, investigation_id) -> DataFrame:
    return of_tenant(rows, investigation_id).agg(F.count("*").alias("total"))


def lookup(rows: DataFrame, **keys) -> DataFrame:
    for name, value in keys.items():
        rows = rows.where(F.col(name) == value)
    return rows


def by_hash(facts: DataFrame, content_hash: str, investigation_id=None) -> DataFrame:
    out = facts.where(F.col("content_hash") == content_hash)
    return out if investigation_id is None else of_tenant(out, investigation_id)


def exists(rows: DataFrame) -> DataFrame:
    return rows.agg((F.count("*") > 0).alias("found"))


def known(rows: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """The keys that occur in rows: the batch form of an existence test."""
    return keys.join(rows.select(on).distinct(), on, "left_semi")


def noise_only() -> Column:
    return F.expr("size(dubious_flags) = 1 AND dubious_flags[0] = 'noise'")


def with_flag(cls: DataFrame, flag: str) -> DataFrame:
    return cls.where(F.array_contains("dubious_flags", flag))


def dubious(cls: DataFrame, exclude_noise: bool = True) -> DataFrame:
    out = cls.where(F.size("dubious_flags") > 0)
    return out.where(~noise_only()) if exclude_noise else out


def critical_dubious(cls: DataFrame) -> DataFrame:
    return dubious(cls).where(F.col("impact_tier") == "critical")


def verified(cls: DataFrame) -> DataFrame:
    return cls.where(F.size("dubious_flags") == 0)


def pending_review(ver: DataFrame) -> DataFrame:
    return ver.where(F.col("requires_human_review") & ~F.col("human_review_completed"))


def confident(facts: DataFrame, least: float) -> DataFrame:
    return facts.where(F.coalesce("extraction_confidence", F.lit(1.0)) >= least)


#: What a dashboard counts as doubtful, and what the graph takes in.
DOUBTFUL = ("pending", "in_progress", "unverifiable")
INGESTIBLE = ("confirmed", "superseded", "unverifiable")


def status_filter(rows: DataFrame, tier: str | None = None, status: str | None = None) -> DataFrame:
    """Filters joined facts; "all" disables a filter and "dubious" stands for three states."""
    if tier and tier != "all":
        rows = rows.where(F.col("impact_tier") == tier)
    if status and status != "all":
        rows = rows.where(F.col("status").isin(*DOUBTFUL) if status == "dubious" else F.col("status") == status)
    return rows


def enriched(facts: DataFrame, cls: DataFrame, ver: DataFrame, defaults: bool = True) -> DataFrame:
    """Facts with their classification and verification; unmatched ones get defaults or stay null."""
    out = facts.join(cls.select("fact_id", "impact_tier", "dubious_flags", "credibility_score", "priority_score"), "fact_id", "left").join(ver.select("fact_id", "status"), "fact_id", "left")
    return out.fillna({"impact_tier": "unknown", "status": "pending"}) if defaults else out


def page(rows: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    return rows.orderBy(*order).offset((number - 1) * size).limit(size)


def fact_statistics(facts: DataFrame) -> DataFrame:
    """Of each tenant: facts, distinct hashes, facts that share theirs with another, distinct sources and the facts of each."""
    alike = facts.groupBy("investigation_id", blank_as("content_hash", "").alias("h")).agg(F.count("*").alias("n"))
    some = (F.col("n") > 1) & (F.col("h") != "")
    totals = alike.groupBy("investigation_id").agg(F.sum("n").alias("total"), F.count_if(F.col("h") != "").alias("hashes"), F.coalesce(F.sum(F.when(some, F.col("n"))), F.lit(0)).alias("with_variants"))
    each = source_counts(facts, "source_id", "").where("source <> ''").groupBy("investigation_id")
    sources = each.agg(F.count("*").alias("sources"), F.map_from_entries(F.collect_list(F.struct("source", "n"))).alias("by_source"))
    return totals.join(sources, "investigation_id", "left").withColumn("sources", F.coalesce("sources", F.lit(0)))


def source_counts(rows: DataFrame, column: str, default: str) -> DataFrame:
    return rows.groupBy("investigation_id", blank_as(column, default).alias("source")).agg(F.count("*").alias("n"))


def classification_statistics(cls: DataFrame) -> DataFrame:
    some = F.size("dubious_flags") > 0
    critical = F.col("impact_tier") == "critical"
    return cls.groupBy("investigation_id").agg(
        F.count("*").alias("total"), F.count_if(critical).alias("critical"), F.count_if(~critical).alias("less_critical"), F.count_if(some).alias("dubious"),
        F.count_if(~some).alias("verified"), F.count_if(critical & some).alias("critical_dubious"), F.avg("credibility_score").alias("average_credibility"),
    )


def flag_counts(cls: DataFrame) -> DataFrame:
    return cls.select("investigation_id", F.explode("dubious_flags").alias("flag")).groupBy("investigation_id", "flag").agg(F.count("*").alias("n"))


def verification_statistics(ver: DataFrame) -> DataFrame:
    return ver.groupBy("investigation_id", F.coalesce("status", F.lit("unknown")).alias("status")).agg(F.count("*").alias("n"), F.count_if(F.col("requires_human_review") & ~F.col("human_review_completed")).alias("pending_review"))


def latest(rows: DataFrame, key: str = "investigation_id", version: str = "version") -> DataFrame:
    """The newest version of each key; one aggregation, no sort."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != key]), version).alias("r")).select(key, "r.*")


def first_per(rows: DataFrame, keys: list, order: list) -> DataFrame:
    """The first row of each key in the given order, by aggregation, so that partial results shrink before the shuffle."""
    names = [f"_k{i}" for i in range(len(keys))]
    keyed = rows.select("*", *(k.alias(n) if isinstance(k, Column) else F.col(k).alias(n) for k, n in zip(keys, names, strict=True)))
    return keyed.groupBy(*names).agg(F.min_by(F.struct(*rows.columns), F.struct(*order)).alias("r")).select("r.*")


def priority_queue(cls: DataFrame, limit: int) -> DataFrame:
    return cls.where(~noise_only()).orderBy(F.desc("priority_score"), "fact_id").limit(limit)


def numbered_changes(reports: DataFrame) -> DataFrame:
    """Drops reports that repeat the one before; the rest get versions 1, 2, 3 by key."""
    w = W.partitionBy("investigation_id").orderBy("version")
    changed = reports.withColumn("before", F.lag("content_hash").over(w)).where("before IS NULL OR before <> content_hash").drop("before")
    return changed.withColumn("number", F.row_number().over(w).cast("long"))
