"""Benchmark decontamination by a prefix-filtered set join.

Each benchmark item gives windows of consecutive words. A document contains a window
only if it contains every shingle of it, so joining one necessary shingle per window,
the rarest over all documents, loses nothing (the prefix of an exact containment has
length one). Candidates pass bounds on length and position and are then verified word
by word. The benchmark is a stated query set: it goes to the executors in blocks of
bounded size, and every block meets all documents. Of blocks after the first only what
they find is stored, by the place of the row, so documents are never rewritten.
"""

from __future__ import annotations

import itertools
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveworks.llm import scratch
from sieveworks.llm import textkit as tk

WINDOW = 13
SHINGLE = 4
#: Bytes of item texts that are sent to every executor at once.
BLOCK_BYTES = 4 << 20
#: Rows with matches whose spans are sent to every executor at most; more are joined by a shuffle.
BROADCAST_ROWS = 100_000
_WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def item_words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").translate(tk.ASCII_LOWER))


def _hash_words(words: list[str]) -> np.ndarray:
    parts = [w.encode("utf-8", "surrogatepass") for w in words]
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
    return tk.Words(np.frombuffer(b"".join(parts), np.uint8), offsets, tk.ALNUM_WORDS).hashes()


class Lookup:
    """Finds which of many hashes are in a sorted table: a bitmap first, then a search."""

    def __init__(self, values: np.ndarray) -> None:
        self.values = np.unique(values)
        self.bits = max(16, min(24, int(len(self.values)).bit_length() + 5))
        self.bitmap = np.zeros(1 << self.bits, dtype=bool)
        self.bitmap[(self.values >> np.uint64(64 - self.bits)).astype(np.int64)] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in hashes that are in the table, and their index there."""
        at = np.flatnonzero(self.bitmap[(hashes >> np.uint64(64 - self.bits)).astype(np.int64)])
        where = np.searchsorted(self.values, hashes[at])
        where[where == len(self.values)] = 0
        good = self.values[where] == hashes[at] if len(self.values) else np.zeros(0, bool)
        return at[good], where[good]


class Block:
    """Windows of some items, and after rank() the one shingle of each that is joined."""

    def __init__(self, items: list[tuple[str, str]], window: int, shingle: int) -> None:
        self.windows: list[tuple[str, tuple[str, ...]]] = []  # item, words
        self.shingles: list[list[int]] = []  # of each window in order
        self.sizes: list[int] = []  # words in a shingle of the window
        every: dict[int, list[int]] = defaultdict(list)
        for item, text in items:
            words = item_words(text)
            if not words:
                continue
            length, k = min(window, len(words)), min(shingle, len(words), window)
            hashes = tk.grams(_hash_words(words), k).tolist()
            for i in range(len(words) - length + 1):
                self.windows.append((item, tuple(words[i : i + length])))
                self.shingles.append(hashes[i : i + length - k + 1])
                self.sizes.append(k)
            every[k] += hashes
        self.lookups = {k: Lookup(np.array(v, dtype=np.uint64)) for k, v in every.items()}
        self.joined: dict[int, tuple[Lookup, list[list[tuple[int, int]]]]] = {}

    def rank(self, counts: dict[tuple[int, int], int]) -> None:
        """counts: by shingle size and hash, over all documents."""
        chosen: dict[int, dict[int, list[tuple[int, int]]]] = defaultdict(lambda: defaultdict(list))
        for w, (hashes, k) in enumerate(zip(self.shingles, self.sizes, strict=True)):
            rarest = min(range(len(hashes)), key=lambda i: (counts.get((k, hashes[i]), 0), hashes[i], i))
            if counts.get((k, hashes[rarest]), 0):  # else no document can hold the window
                chosen[k][hashes[rarest]].append((w, rarest))
        for k, found in chosen.items():
            lookup = Lookup(np.array(list(found), dtype=np.uint64))
            self.joined[k] = lookup, [found[int(v)] for v in lookup.values]
        self.shingles, self.lookups = [], {}

    def match(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, list[list[tuple[int, int]]], list[set[str]]]:
        """Of each text: number of words, word spans of verified windows, items."""
        words = tk.Words(tk.FOLD[data], offsets, tk.ALNUM_WORDS)
        spans: list[list[tuple[int, int]]] = [[] for _ in range(len(offsets) - 1)]
        items: list[set[str]] = [set() for _ in range(len(offsets) - 1)]
        hashes = words.hashes() if self.joined else None
        folded = words.data
        for k, (lookup, lists) in self.joined.items():
            at, which = lookup.find(tk.grams(hashes, k))
            text_of = np.searchsorted(words.first, at, "right") - 1
            for pos, entry, d in zip(at.tolist(), which.tolist(), text_of.tolist(), strict=True):
                low, high = int(words.first[d]), int(words.first[d + 1])
                for w, shift in lists[entry]:
                    item, wanted = self.windows[w]
                    start = pos - shift
                    if start < low or start + len(wanted) > high:
                        continue
                    if all(folded[words.starts[start + j] : words.ends[start + j]].tobytes() == x for j, x in enumerate(self.encoded(w))):
                        spans[d].append((start - low, start - low + len(wanted)))
                        items[d].add(item)
        return words.counts, spans, items

    def encoded(self, w: int) -> list[bytes]:
        if not hasattr(self, "_bytes"):
            self._bytes: dict[int, list[bytes]] = {}
        if w not in self._bytes:
            self._bytes[w] = [x.encode("utf-8", "surrogatepass") for x in self.windows[w][1]]
        return self._bytes[w]


def _counted(block):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {k: np.zeros(len(v.values), dtype=np.int64) for k, v in block.value.lookups.items()}
        for batch in batches:
            data, offsets = tk.buffers(batch.column(0))
            for _, _, part, at in tk.chunks(data, offsets):
                words = tk.Words(tk.FOLD[part], at, tk.ALNUM_WORDS)
                hashes = words.hashes()
                for k, lookup in block.value.lookups.items():
                    _, which = lookup.find(tk.grams(hashes, k))
                    np.add.at(totals[k], which, 1)
        for k, total in totals.items():
            full = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(full), k), pa.int32()), pa.array(block.value.lookups[k].values[full].view(np.int64)), pa.array(total[full])], ["k", "shingle", "n"])

    return run


_RESULT = "struct<n_words:bigint,spans:array<struct<start:bigint,stop:bigint>>,items:array<string>>"


def _matcher(block):
    @F.arrow_udf(_RESULT)
    def match(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        span = pa.struct([("start", pa.int64()), ("stop", pa.int64())])
        for column in texts:
            data, offsets = tk.buffers(column)
            n: list[int] = []
            spans: list[list[dict]] = []
            items: list[list[str]] = []
            for _, _, part, at in tk.chunks(data, offsets):
                counts, s, i = block.value.match(part, at)
                n += counts.tolist()
                spans += [[{"start": a, "stop": b} for a, b in sorted(set(x))] for x in s]
                items += [sorted(x) for x in i]
            yield pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(spans, pa.list_(span)), pa.array(items, pa.list_(pa.string()))], ["n_words", "spans", "items"])

    return match


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[str, str]]]:
    block, size = [], 0
    for item, text in benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("string")).where("item_id is not null and text is not null").toLocalIterator():
        if block and size + len(text) > BLOCK_BYTES:
            yield block
            block, size = [], 0
        block.append((item, text))
        size += len(text)
    yield block


def _ranked(text: DataFrame, items: list[tuple[str, str]], window: int, shingle: int) -> Block:
    block = Block(items, window, shingle)
    found = text.mapInArrow(_counted(scratch.Shared(text.sparkSession, block)), "k int, shingle long, n long") if block.windows else None
    # as many rows as the block has distinct shingles at most
    counts = {(r.k, r.shingle & (2**64 - 1)): r.n for r in found.groupBy("k", "shingle").agg(F.sum("n").alias("n")).collect()} if found is not None else {}
    block.rank(counts)
    return block


def matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """docs with a column _found: n_words, word spans of verified windows, item ids (as strings).

    Null or empty texts have no words; items without an id or words give no windows;
    an item_id that repeats is one item. Only doc text is read, so docs may have any
    other columns; one named _found gives way, and _row is reserved.
    """
    spark = docs.sparkSession
    docs = docs.drop("_found")
    text = docs.select(F.col("text").cast("string"))
    blocks = _blocks(benchmark)
    matcher = lambda items: _matcher(scratch.Shared(spark, _ranked(text, items, window, shingle)))(F.col("text").cast("string"))
    first, second = next(blocks), next(blocks, None)
    if second is None:
        return docs.withColumn("_found", matcher(first))
    rows = scratch.placed(docs)
    thin = rows.select("_row", "text")
    more = None
    for items in itertools.chain([second], blocks):
        found = scratch.table(thin.select("_row", matcher(items).alias("f")).where("size(f.spans) > 0").select("_row", "f.spans", "f.items"))
        more = found if more is None else more.union(found)
    # of each row as many rows as there are blocks at most
    more = scratch.table(more.groupBy("_row").agg(F.flatten(F.collect_list("spans")).alias("_spans"), F.flatten(F.collect_list("items")).alias("_items")))
    out = rows.withColumn("_found", matcher(first)).join(F.broadcast(more) if more.count() <= BROADCAST_ROWS else more, "_row", "left")
    both = lambda name: F.array_distinct(F.when(F.col(f"_{name}").isNull(), F.col(f"_found.{name}")).otherwise(F.concat(f"_found.{name}", f"_{name}"))).alias(name)
    whole = F.struct(F.col("_found.n_words").alias("n_words"), both("spans"), both("items"))
    return out.withColumn("_found", whole).select(*docs.columns, "_found")


def n_hit(found: Column) -> Column:
    """Words inside any of the spans: merges them in order of their start."""
    step = lambda s, x: F.struct((s["n"] + F.greatest(F.lit(0), x["stop"] - F.greatest(s["end"], x["start"]))).alias("n"), F.greatest(s["end"], x["stop"]).alias("end"))
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))
    return F.aggregate(F.array_sort(found["spans"]), zero, step, lambda s: s["n"])


def contaminated(found: Column) -> Column:
    return (n_hit(found) > 0) & (20 * n_hit(found) >= found["n_words"])
