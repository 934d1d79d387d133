"""Scores as Columns; the time "now" is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sieveworks.functions import constants as C


def recency(at_us: Column, now_us: Column, hours: int = 72) -> Column:
    """1 now, falling to 0 after so many hours; 0.5 without a time."""
    age = (now_us - at_us).cast("double") / F.lit(float(hours * 3_600_000_000))
    return F.coalesce(F.greatest(F.lit(0.0), 1 - age), F.lit(0.5))


def table(values: dict, key: Column, default) -> Column:
    """A lookup of fixed values; no join, and folded into the stage's generated code."""
    out = None
    for k, v in values.items():
        out = (F if out is None else out).when(key == k, F.lit(v))
    return out.otherwise(default if isinstance(default, Column) else F.lit(default))


def any_in(text: Column, words) -> Column:
    out = F.lit(False)
    for word in words:
        out = out | F.contains(text, F.lit(word))
    return out


def base_credibility(domain: Column, source_type: Column) -> Column:
    """Known domain, else the first domain suffix in order, else the source type."""
    suffix = None
    for k, v in C.DOMAIN_SUFFIX_DEFAULTS.items():
        suffix = (F if suffix is None else suffix).when(F.endswith(domain, F.lit(k)), F.lit(v))
    return F.coalesce(table(C.SOURCE_BASELINES, domain, F.lit(None)), suffix, table(C.SOURCE_TYPE_DEFAULTS, source_type, 0.3))


def proximity(hops: Column) -> Column:
    return F.pow(F.lit(C.PROXIMITY_DECAY), F.greatest(F.coalesce(hops, F.lit(1)), F.lit(0)).cast("double"))


def precision(entities: Column, temporal: Column, quoted: Column, documented: Column) -> Column:
    w = C.PRECISION_WEIGHTS
    parts = (F.least(F.lit(1.0), 0.3 + entities * 0.233) * w["entity_count"], table(C.TEMPORAL_FACTORS, temporal, 0.3) * w["temporal_precision"], F.when(quoted, 1.0).otherwise(0.5) * w["has_quote"], F.when(documented, 1.0).otherwise(0.5) * w["has_document"])
    return F.least(F.lit(1.0), parts[0] + parts[1] + parts[2] + parts[3])


def flags(hops: Column, has_primary: Column, clarity: Column, vague: Column, contradictions: Column, credibility: Column, noise_below: float = 0.15) -> Column:
    """Doubts about a fact in fixed order: phantom, fog, anomaly, noise."""
    return F.array_compact(
        F.array(
            F.when((hops > 2) & ~has_primary, F.lit("phantom")),
            F.when((F.coalesce(clarity, F.lit(1.0)) < 0.5) | vague, F.lit("fog")),
            F.when(contradictions > 0, F.lit("anomaly")),
            F.when(credibility < noise_below, F.lit("noise")),
        )
    )


def fixability(dubious_flags: Column, credibility: Column) -> Column:
    best = F.array_max(F.transform(dubious_flags, lambda f: table(C.FIXABILITY, f, 0.5)))
    noise_only = (F.size(dubious_flags) == 1) & F.array_contains(dubious_flags, "noise")
    return F.when((F.size(dubious_flags) == 0) | noise_only, 0.0).otherwise(F.least(F.lit(1.0), best + credibility * 0.2))


def priority(tier: Column, dubious_flags: Column, credibility: Column) -> Column:
    impact = F.when(tier == "critical", 1.0).otherwise(0.5)
    noise_only = (F.size(dubious_flags) == 1) & F.array_contains(dubious_flags, "noise")
    return impact * F.when((F.size(dubious_flags) == 0) | noise_only, 0.0).otherwise(0.3 + 0.7 * credibility)


def entity_significance(name: Column, kind: Column) -> Column:
    low = F.lower(name)
    return F.when(any_in(low, C.WORLD_LEADERS), 1.0).when(any_in(low, C.SENIOR_TITLES), 0.8).when(any_in(low, C.MAJOR_ORGANIZATIONS), 0.4).when(any_in(low, C.MILITARY_ENTITIES), 0.8).otherwise(table(C.ENTITY_TYPE_SCORES, F.upper(kind), 0.3))


def event_significance(claim: Column, claim_type: Column) -> Column:
    low = F.lower(claim)
    return F.when(any_in(low, C.MILITARY_EVENTS), 1.0).when(any_in(low, C.TREATY_EVENTS), 0.9).when(any_in(low, C.MAJOR_EVENTS), 0.6).when(any_in(low, C.MEETING_EVENTS), 0.7).otherwise(table(C.CLAIM_TYPE_SCORES, claim_type, 0.3))


def impact(entity: Column, claim: Column, claim_type: Column, boost: Column | float = 0.0) -> Column:
    """Half the entity's significance (0.8 at least where the claim names power) and half the event's."""
    named = F.lit(False)
    for pattern in C.CRITICAL_PATTERNS:
        named = named | F.rlike(claim, F.lit("(?i)" + pattern))
    who = F.when(named, F.greatest(entity, F.lit(0.8))).otherwise(entity)
    return F.least(F.lit(1.0), 0.5 * who + 0.5 * event_significance(claim, claim_type) + boost)


def echo(root: Column, total: Column, alpha: float = C.ECHO_ALPHA) -> Column:
    """Bonus of repeated reports: grows with the logarithm of what others add to the root."""
    return alpha * F.log10(1 + F.greatest(F.lit(0.0), total - root))


def corroboration(roots: Column, score: Column) -> Column:
    return F.when(roots <= 1, 0.3).otherwise(F.least(F.lit(1.0), 0.3 + 0.175 * (roots - 1)) * F.least(F.lit(1.0), score + 0.2))


def edge_weight(evidence: Column, authority: Column, days: Column, base: float = 0.5) -> Column:
    raw = base + 0.3 * authority + F.least(F.lit(0.2), 0.05 * F.log1p(evidence)) - F.least(F.lit(0.2), days / 365 * 0.2)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw))
