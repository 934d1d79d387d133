"""Feeds, paged services and web pages as sources; fetching is injected."""

from __future__ import annotations

import html
import re
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

ENTRY = "feed string, number int, title string, link string, published string, summary string, author string, source string, tags array<string>, content string, id string"


def entries(feed: str, text: str) -> tuple[list[tuple], bool]:
    """Entries of an RSS or Atom text, and whether it is malformed; a malformed one has none."""
    try:
        root = ET.fromstring(text)
    except ET.ParseError:
        return [], True
    plain = lambda tag: tag.rpartition("}")[2]
    said = lambda e: (e.text or "").strip()
    items = [e for e in root.iter() if plain(e.tag) in ("item", "entry")]
    source = next((said(c) for e in [root, *root] if plain(e.tag) in ("channel", "feed") for c in e if plain(c.tag) == "title"), "")
    out = []
    for item in items:
        first: dict[str, str] = {}
        for c in item:
            first[plain(c.tag)] = first.get(plain(c.tag)) or said(c)
        links = [c for c in item if plain(c.tag) == "link"]
        link = first.get("link") or next((c.get("href") for c in links if c.get("rel") in ("alternate", None) and c.get("href")), "")
        author = next((said(n) or said(c) for c in item if plain(c.tag) in ("author", "creator") for n in [*(n for n in c if plain(n.tag) == "name"), c]), "")
        tags = [t for c in item if plain(c.tag) == "category" for t in [c.get("term") or said(c)] if t]
        title = first.get("title") or "No title"
        published = first.get("pubDate") or first.get("published") or first.get("updated")
        out.append((feed, len(out), title, link, published, first.get("summary") or first.get("description") or "", author, source, tags, first.get("encoded") or first.get("content") or "", first.get("guid") or first.get("id") or link or title))
    return out, False


def parsed(feeds: DataFrame) -> DataFrame:
    """Entries of landed feeds (feed, text); a malformed one has none, see reported."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [e for f, t in zip(pdf["feed"], pdf["text"], strict=True) for e in entries(f, t or "")[0]]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in ENTRY.split(", ")])

    return feeds.select("feed", "text").mapInPandas(run, ENTRY)


def reported(feeds: DataFrame) -> DataFrame:
    """(feed, found, malformed) of every landed feed."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(f, len(e), bad) for f, t in zip(pdf["feed"], pdf["text"], strict=True) for e, bad in [entries(f, t or "")]]
            yield pd.DataFrame(rows, columns=["feed", "found", "malformed"])

    return feeds.select("feed", "text").mapInPandas(run, "feed string, found long, malformed boolean")


def polled(rows: DataFrame, most: int = 20) -> DataFrame:
    """The first entries of each feed."""
    return rows.withColumn("_r", F.row_number().over(W.partitionBy("feed").orderBy("number"))).where(F.col("_r") <= most).drop("_r")


def paged(spark: SparkSession, name: str, schema: str, fetch: Callable[[int], list[tuple]], pages: int) -> DataFrame:
    """A paged service as a data source: one partition for each page; an empty page has no rows."""

    class Reader(DataSourceReader):
        def partitions(self):
            return [InputPartition(i) for i in range(1, pages + 1)]

        def read(self, partition):
            yield from fetch(partition.value)

    class Source(DataSource):
        @classmethod
        def name(cls):
            return name

        def schema(self):
            return schema

        def reader(self, schema):
            return Reader()

    spark.dataSource.register(Source)
    return spark.read.format(name).load()


def page_text(raw: str) -> str:
    """Text of a page without scripts, styles and tags."""
    body = re.sub(r"(?is)<(script|style)\b.*?</\1\s*>", " ", raw)
    return re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]+>", " ", body))).strip()


def page_texts(pages: DataFrame, least: int = 200) -> DataFrame:
    """(page_id, title, text): pages with less text are dropped; without a title the last part of the URL stands in."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for i, url, raw in zip(pdf["page_id"], pdf["url"], pdf["html"], strict=True):
                text = page_text(raw or "")
                if len(text) >= least:
                    title = re.search(r"(?is)<title[^>]*>(.*?)</title>", raw)
                    rows.append((i, html.unescape(title[1]).strip() if title else (url or "").rstrip("/").rpartition("/")[2], text))
            yield pd.DataFrame(rows, columns=["page_id", "title", "text"])

    return pages.select("page_id", "url", "html").mapInPandas(run, "page_id long, title string, text string")
