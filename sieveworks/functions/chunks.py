"""Language guess as a Column; text chunks and rule-based extraction over batches of Arrow rows."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Frequent words by language.
COMMON = {"en": {"the", "of", "and", "that", "is"}, "de": {"der", "die", "und", "ist", "ein"}, "fr": {"le", "les", "et", "des", "une"}, "es": {"el", "los", "que", "una", "las"}}


def _parts(text: str, size: int) -> Iterator[tuple[str, str] | None]:
    """Paragraphs, sentences of long paragraphs and slices of long sentences, each with what follows it; None ends a chunk."""
    for paragraph in text.split("\n\n"):
        if len(paragraph) <= size:
            yield paragraph, "\n\n"
            continue
        yield None
        for sentence in re.split(r"(?<=[.!?])\s+", paragraph):
            if len(sentence) <= size:
                yield sentence, " "
                continue
            for i in range(0, len(sentence), size):
                yield None
                yield sentence[i : i + size], ""
            yield None


def pieces(text: str, size: int) -> list[str]:
    """Chunks of up to size letters: paragraphs as long as they fit, else sentences one space apart, else slices. A short text stays as it is, a blank one has none."""
    if len(text) <= size:
        return [text] if text.strip() else []
    out = [""]
    for part in _parts(text, size):
        if part is None or len(out[-1]) + len(part[0]) + len(part[1]) > size:
            out.append("")
        if part:
            out[-1] += part[0] + part[1]
    return [p.strip() for p in out if p.strip()]


def chunked(rows: DataFrame, key: str, text: str, size: int) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [(k, i, p) for k, t in zip(pdf[key], pdf[text], strict=True) for i, p in enumerate(pieces(t or "", size))]
            yield pd.DataFrame(found, columns=["key", "number", "chunk"])

    return rows.select(key, text).mapInPandas(run, "key long, number int, chunk string")


def language(text: Column) -> Column:
    """By frequent words in the first 500 letters; English among equals and without evidence."""
    words = F.split(F.lower(F.substring(F.coalesce(text, F.lit("")), 1, 500)), r"[^\p{L}\p{N}_]+")
    hits = lambda known: F.size(F.filter(words, lambda w: w.isin(*sorted(known))))
    score = {lang: hits(known) for lang, known in COMMON.items()}
    most = F.greatest(*score.values())
    return F.coalesce(*(F.when(n == most, lang) for lang, n in score.items()))


def detected(rows: DataFrame, key: str, text: str) -> DataFrame:
    return rows.select(F.col(key).alias("key"), language(F.col(text)).alias("language"))


def sentences(text: str) -> list[dict]:
    """The default extractor: each sentence with a capitalised name inside is a claim."""
    return [{"claim": s.strip(), "confidence": 0.8} for s in re.split(r"(?<=[.!?])\s+", text) if re.search(r"\s[A-Z]\w+", s)]


def extracted(rows: DataFrame, key: str, text: str, extractor: Callable[[str], list[dict]] = sentences, least: int = 50, size: int = 40_000) -> DataFrame:
    """Claims of texts of at least so many letters, chunk by chunk, by an extractor that can be replaced."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for k, t in zip(pdf[key], pdf[text], strict=True):
                claims = [c for p in pieces(t, size) for c in extractor(p)] if t and len(t) >= least else []
                out += [(k, i, c["claim"], float(c["confidence"])) for i, c in enumerate(claims)]
            yield pd.DataFrame(out, columns=["key", "number", "claim", "confidence"])

    return rows.select(key, text).mapInPandas(run, "key long, number int, claim string, confidence double")
