"""MinHash near-dedup through an inverted join of signature coordinates.

A document's set holds its distinct shingles. Documents with equal sets form one
class, and only the smallest document of a class is compared. Each class posts the
pairs (coordinate, value) of its signature, rarest first; two classes that agree in
MATCHES coordinates share one of the first ``shared - MATCHES + 1`` pairs of either,
so the rest is skipped and only counted for pairs that meet. Pairs above the match
threshold are confirmed on their full sets.

A pair that agrees often enough is next held against a finer sketch, one bit from each
of 512 further coordinates, so that few pairs below the similarity reach confirmation.

Copies of one text in great numbers stay linear: see linking.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveworks.llm import graph, linking, scratch
from sieveworks.llm import textkit as tk

SHINGLE = 5
SIMILARITY = 0.75
COORDINATES = 64
#: Of 64 coordinates, a pair at similarity 0.75 agrees in 48 on average and in 29 or fewer once in 2.6 million.
MATCHES = 30
#: One-bit coordinates of the sketch; two sets at similarity 0.75 differ in 64 of them on average, in more than 104 once in 4.3 million.
BITS = 512
DIFFER = 104
#: Identifiers sent to every executor at most; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000

_rng = np.random.default_rng(20_240_601)
_XOR = _rng.integers(0, 2**63, COORDINATES, dtype=np.uint64)
_ODD = _rng.integers(0, 2**63, COORDINATES, dtype=np.uint64) | np.uint64(1)
_BIT_XOR = _rng.integers(0, 2**63, BITS, dtype=np.uint64)
_BIT_ODD = _rng.integers(0, 2**63, BITS, dtype=np.uint64) | np.uint64(1)
_SETS = _rng.integers(0, 2**63, 2, dtype=np.uint64) | np.uint64(1)


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of each text in order, repeats included, and where each text's begin."""
    words = tk.Words(tk.FOLD[data], offsets, tk.BLANK_WORDS)
    hashes, counts = words.hashes(), words.counts
    runs = tk.grams(hashes, k)
    sizes = np.where(counts >= k, counts - k + 1, (counts > 0).astype(np.int64))
    first = np.concatenate([[0], np.cumsum(sizes)])
    which = np.repeat(np.arange(len(counts)), sizes)
    at = np.arange(first[-1]) - first[which] + words.first[which]
    out = np.zeros(first[-1], dtype=np.uint64)
    long = counts[which] >= k
    out[long] = runs[at[long]]
    for d in np.flatnonzero((counts > 0) & (counts < k)):
        out[first[d]] = tk.grams(hashes[words.first[d] : words.first[d + 1]], int(counts[d]))[0]
    return out, first


def distinct_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> list[np.ndarray]:
    out, first = shingle_hashes(data, offsets, k)
    return [np.unique(out[first[i] : first[i + 1]]) for i in range(len(first) - 1)]


def _signed(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = tk.buffers(batch.column(1))
            for low, high, part, at in tk.chunks(data, offsets):
                sets = distinct_sets(part, at, k)
                sizes = np.array([len(s) for s in sets], dtype=np.int64)
                full = np.flatnonzero(sizes)
                prints = np.zeros((2, len(sets)), dtype=np.uint64)
                least = np.zeros((len(full), COORDINATES), dtype=np.uint32)
                if len(full):
                    every = np.concatenate([sets[i] for i in full])
                    begin = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
                    for j in range(2):
                        prints[j, full] = np.add.reduceat(tk.mix(every * _SETS[j]), begin)
                    for c in range(COORDINATES):
                        least[:, c] = np.minimum.reduceat(((every ^ _XOR[c]) * _ODD[c]) >> np.uint64(32), begin)
                where = np.concatenate([[0], np.cumsum(sizes > 0)]).astype(np.int32) * COORDINATES
                sig = pa.ListArray.from_arrays(pa.array(where, pa.int32()), pa.array(least.reshape(-1).view(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), pa.array(sizes), pa.array(prints[0].view(np.int64)), pa.array(prints[1].view(np.int64)), sig], ["doc_id", "n_shingles", "fp1", "fp2", "sig"])

    return run


def signatures(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, a 128-bit print of the set, its MinHash signature (empty for an empty set)."""
    thin = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return thin.mapInArrow(_signed(k), "doc_id long, n_shingles long, fp1 long, fp2 long, sig array<int>")


def _sketched(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = tk.buffers(batch.column(1))
            for low, high, part, at in tk.chunks(data, offsets, 1 << 18):
                # a repeated id may bring a text without words
                sets = [s if len(s) else np.zeros(1, np.uint64) for s in distinct_sets(part, at, k)]
                every = np.concatenate(sets)
                begin = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
                bits = np.empty((len(sets), BITS), dtype=bool)
                for c in range(BITS):
                    bits[:, c] = (np.minimum.reduceat(((every ^ _BIT_XOR[c]) * _BIT_ODD[c]) >> np.uint64(32), begin) & np.uint64(1)).astype(bool)
                words = np.packbits(bits, axis=1).view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * words.shape[1], pa.int32()), pa.array(words.reshape(-1)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), batch.column(1).slice(low, high - low), lists], ["node", "text", "sketch"])

    return run


def _set(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode(), np.uint8)
    return distinct_sets(data, np.array([0, len(data)]), SHINGLE)[0]


class Alike:
    """Whether two full sets are similar enough."""

    def __init__(self, similarity: float) -> None:
        self.percent = round(100 * similarity)

    def __call__(self, x: np.ndarray, y: np.ndarray) -> bool:
        union = len(np.union1d(x, y))
        return union > 0 and 100 * (len(x) + len(y) - union) >= self.percent * union


def only(docs: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of docs whose key is in ids: few ids are broadcast, more are joined by a shuffle."""
    ids = ids.select(F.col(ids.columns[0]).alias(key))
    return docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, key, "left_semi")


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, matches: int = MATCHES) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept.

    component_id is the smallest doc_id reachable over links. Empty or null texts have
    no shingles and are linked with nothing. Rows that repeat a doc_id are one node. A
    null doc_id takes the component of its copies (null without any) and is not kept.
    Only doc_id and text are read, so other columns may have any name.
    """
    base = scratch.table(signatures(docs))
    same = ["n_shingles", "fp1", "fp2"]
    classes = scratch.table(base.where("n_shingles > 0").groupBy(*same).agg(F.min("doc_id").alias("rep"), F.first("sig").alias("sig")).where("rep is not null"))

    tokens = classes.select("rep", F.posexplode("sig").alias("c", "v")).select("rep", F.expr("shiftleft(bigint(c), 32) | (bigint(v) & 4294967295L)").alias("token"))
    common = tokens.groupBy("token").count().where("count > 1")
    lists = tokens.join(common, "token").groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("count", "token"))).alias("t"))
    posted = scratch.table(lists.where(F.size("t") >= matches).select("rep", F.col("t.token").alias("tokens"), F.expr(f"slice(t.token, 1, size(t) - {matches - 1})").alias("prefix")))
    texts = only(docs.select(F.col("doc_id").cast("long").alias("rep"), F.col("text").cast("string").alias("text")), posted.select("rep"), "rep")
    texts = scratch.table(texts.groupBy("rep").agg(F.first("text").alias("text")).mapInArrow(_sketched(SHINGLE), "node long, text string, sketch array<long>"))
    facts = scratch.table(posted.select(F.col("rep").alias("node"), F.col("prefix").alias("tokens"), F.col("tokens").alias("all")).join(texts.select("node", "sketch"), "node"))
    links = linking.linked(facts, BITS // 64, DIFFER, lambda nodes: texts.select("node", "text"), _set, Alike(similarity), F.size(F.array_intersect("all_a", "all_b")) >= matches)
    final = graph.components(links)
    member = classes.drop("sig").join(final.withColumnRenamed("node", "rep"), "rep", "left").select(*same, F.coalesce("component", "rep").alias("component_id"))
    out = base.drop("sig").join(member, same, "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))
