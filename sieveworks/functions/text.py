"""Text, URL and hash functions as Columns."""

from __future__ import annotations

import functools

from pyspark.sql import Column
from pyspark.sql import functions as F

from sieveworks.functions import constants as C
from sieveworks.functions.scores import any_in


def authority_of(url: Column) -> Column:
    """Host with port, folded, without a leading www."""
    return F.regexp_replace(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)), r"^www\.", "")


def normalised_url(url: Column) -> Column:
    """Host folded, tracking parameters dropped, the rest sorted by key; no fragment, default port or closing slash."""
    plain = F.regexp_replace(url, "#.*$", "")
    head = F.regexp_replace(plain, r"\?.*$", "")
    scheme = F.lower(F.regexp_extract(head, "^([^:]+)://", 1))
    host = F.regexp_replace(F.lower(F.regexp_extract(head, "^[^:]+://([^/]*)", 1)), F.lit(r"(?:(?<=.):80|:443)$"), F.lit(""))
    path = F.regexp_replace(F.regexp_extract(head, "^[^:]+://[^/]*(/.*)?$", 1), "/+$", "")
    query = F.regexp_extract(plain, r"\?(.*)$", 1)
    kept = F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.lower(F.split(p, "=")[0]).isin(*C.TRACKING_PARAMS))
    ordered = F.array_join(F.array_sort(kept), "&")
    full = F.concat(scheme, F.lit("://"), host, path, F.when(ordered != "", F.concat(F.lit("?"), ordered)).otherwise(""))
    return F.when(F.contains(url, F.lit("://")), full).otherwise(url)


def category(domain: Column) -> Column:
    return (
        F.when(any_in(domain, (".gov", ".mil")), "official").when(any_in(domain, (".edu", ".ac.")), "academic").when(any_in(domain, C.NEWS_DOMAINS), "news")
        .when(any_in(domain, (".org",)), "organization").when(any_in(domain, C.SOCIAL_DOMAINS), "social").otherwise("unknown")
    )


def source_type(domain: Column) -> Column:
    official = F.endswith(domain, F.lit(".gov")) | F.endswith(domain, F.lit(".mil")) | F.endswith(domain, F.lit(".edu"))
    return F.when(domain.isin(*C.WIRE_DOMAINS), "wire_service").when(domain.isin(*C.SOCIAL_DOMAINS, "telegram.org"), "social_media").when(official, "official_statement").otherwise("news_outlet")


def vague(text: Column) -> Column:
    """The first vague phrase in the order of the list, or null."""
    return F.coalesce(*(F.nullif(F.regexp_extract(F.coalesce(text, F.lit("")), "(?i)" + p, 0), F.lit("")) for p in C.VAGUE_ATTRIBUTION))


def supports(snippet: Column) -> Column:
    """False where any cue of denial occurs; nothing supports by default."""
    return ~F.rlike(F.coalesce(snippet, F.lit("")), F.lit("(?i)" + "|".join(C.NEGATION_CUES)))


def relevance(snippet: Column, terms: Column) -> Column:
    hits = F.size(F.filter(terms, lambda t: F.contains(F.lower(snippet), t)))
    return F.when(F.coalesce(snippet, F.lit("")) == "", 0.3).when(F.size(terms) == 0, 0.5).otherwise(F.least(F.lit(1.0), 0.3 + hits / F.size(terms) * 0.7))


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def truncated(text: Column, most: int) -> Column:
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.substring(text, 1, most - 3), F.lit("...")))


def untagged(html: Column) -> Column:
    return F.trim(F.regexp_replace(html, "<[^>]+>", ""))


def cosine(a: Column, b: Column) -> Column:
    """0 where lengths differ or a vector has no length; sums in DOUBLE."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, p: s + p)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) != F.size(b)) | (norm == 0), 0.0).otherwise(dot(a, b) / norm)


def repaired_json(text: Column) -> Column:
    """Takes the array out of a model's answer: thoughts and fences off, commas mended."""
    body = F.regexp_replace(F.regexp_replace(text, "(?s)<think>.*?</think>", ""), "```(?:json)?", "")
    array = F.regexp_extract(body, r"(?s)(\[.*\])", 1)
    return F.regexp_replace(F.regexp_replace(array, r"\}\s*\{", "},{"), r",\s*([\]}])", "$1")


def challenged(html: Column) -> Column:
    """A challenge page: short, with two of the signs in its first 5,000 letters."""
    head = F.substring(html, 1, 5000)
    signs = [F.rlike(head, F.lit(f"(?i){sign}")).cast("int") for sign in C.CHALLENGE_SIGNS]
    return (F.length(html) <= 50_000) & (functools.reduce(Column.__add__, signs) >= 2)


def instant(text: Column) -> Column:
    """The moment that a date in one of DATE_FORMS names, UTC where it has no zone; null for any other text."""
    plain = F.regexp_replace(F.trim(text), "^[A-Za-z]{3,9}, +(?=[0-9])", "")
    zoned = F.regexp_extract(plain, "([+-][0-9]{2}:?[0-9]{2}|Z|[A-Z]{3})$", 1) != ""
    found = F.coalesce(*(F.try_to_timestamp(plain, F.lit(form)) for form in C.DATE_FORMS))
    return F.when(zoned, found).otherwise(F.from_utc_timestamp(found, F.current_timezone()))
