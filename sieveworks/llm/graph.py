"""Connected components by alternating large and small stars, contracted within each task first."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveworks.llm import scratch


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _lowest(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


#: Edges that a task contracts together at most.
TOGETHER = 1 << 20


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (u, v) that join what the given ones join, by runs of bounded size: of each tree a star around its smallest node."""

    def star(ends: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        u, v = (np.concatenate(x) for x in zip(*ends, strict=True))
        names, at = np.unique(np.concatenate([u, v]), return_inverse=True)
        a, b = at[: len(u)], at[len(u) :]
        root = np.arange(len(names))
        while True:
            # hook the larger root of each edge below the smaller one, then shorten all paths
            x, y = root[a], root[b]
            if (x == y).all():
                break
            np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
            while not np.array_equal(up := root[root], root):
                root = up
        far = np.flatnonzero(root != np.arange(len(names)))
        return pa.RecordBatch.from_arrays([pa.array(names[far]), pa.array(names[root[far]])], ["u", "v"])

    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0
    for batch in batches:
        held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        size += batch.num_rows
        if size >= TOGETHER:
            yield star(held)
            held, size = [], 0
    if size:
        yield star(held)


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of each linked node, component being the smallest node reachable.

    Tasks contract the links that they hold, so that few rounds remain. Each round moves a
    constant number of rows per link and is stored in the shared folder; a node with very many links is an aggregation key and the side of a join
    that adaptive execution splits, never a list. Null ends and self-links are ignored.
    """
    edges = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    edges = scratch.table(edges.mapInArrow(_contracted, "u long, v long").distinct())
    before = _state(edges)
    while before[0]:
        sym = _both(edges)
        low = _lowest(sym).select("u", F.least("u", "m").alias("m"))
        large = sym.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.union(edges.join(low, "u").select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        low = _lowest(large)
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        edges = scratch.table(small.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        after = _state(edges)
        if after == before:
            break
        before = after
    return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
