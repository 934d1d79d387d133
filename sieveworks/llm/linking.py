"""Links between similar nodes that share tokens, in time linear in a group of copies."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Generator, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveworks.llm import graph, scratch

BLOCK = 1024
#: Rows that are resolved together, about.
ROWS = 512
#: Pairs that a block asks about at once, at most.
TOGETHER = 256


def _sided(facts: DataFrame, side: str, node: str) -> DataFrame:
    return facts.select(F.col("node").alias(node), *(F.col(c).alias(f"{c}_{side}") for c in facts.columns if c != "node"))


def _apart(words: int) -> Column:
    """Bits in which two sketches differ; a sketch that begins with 0 is unknown."""
    bits = sum((F.bit_count(F.col("sketch_a")[i].bitwiseXOR(F.col("sketch_b")[i])) for i in range(words)), F.lit(0))
    return F.when((F.col("sketch_a")[0] == 0) | (F.col("sketch_b")[0] == 0), 0).otherwise(bits)


def _confirmed(prepare: Callable[[str], Any], alike: Callable[[Any, Any], bool]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)
            pairs = ((prepare(x), prepare(y)) for x, y in texts)
            kept = batch.filter(pa.array(alike.many(list(pairs)) if hasattr(alike, "many") else [alike(x, y) for x, y in pairs], pa.bool_()))
            yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1)], ["a", "b"])

    return run


def _resolved(prepare: Callable[[str], Any], alike: Callable[[Any, Any], bool], differ: int):
    """Of each block, links that join its components as all links would: the closest pairs first."""

    many = getattr(alike, "many", None)

    def block(rows: pa.Table, token: int, split: bool, out: list[tuple[int, int]]) -> Generator[list[tuple[Any, Any]], list[bool], None]:
        """Gives pairs to be compared, is sent whether they are alike, and puts links into out."""
        n = rows.num_rows
        nodes, component, own = (rows.column(c).to_numpy() for c in ("node", "component", "own"))
        sketch = rows.column("sketch").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(n, -1)
        known = sketch[:, 0] != 0
        texts = rows.column("text")
        # tokens that come before this one: a pair that shares one of them has met there
        before = [frozenset(t[: t.index(token)]) for t in rows.column("tokens").to_pylist()]
        parent = {c: c for c in component.tolist()}

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        away: list[np.ndarray] = []
        left: list[np.ndarray] = []
        right: list[np.ndarray] = []
        for i in range(n - 1):
            bits = np.bitwise_count(sketch[i + 1 :] ^ sketch[i]).sum(axis=1, dtype=np.uint16) * (known[i + 1 :] & known[i])
            meet = (bits <= differ) & (component[i + 1 :] != component[i]) & (nodes[i + 1 :] != nodes[i])
            if split:
                meet &= own[i + 1 :] != own[i]
            j = np.flatnonzero(meet)
            away.append(bits[j])
            left.append(np.full(len(j), i, np.int32))
            right.append((j + i + 1).astype(np.int32))
        order = np.argsort(np.concatenate(away), kind="stable") if away else np.zeros(0, np.int64)
        a, b = (np.concatenate(x)[order] if away else np.zeros(0, np.int32) for x in (left, right))
        ready: dict[int, Any] = {}
        k, size = 0, TOGETHER // 16 if many else 1
        while k < len(order):
            asked: list[tuple[int, int]] = []
            while k < len(order) and len(asked) < size:
                i, j = int(a[k]), int(b[k])
                k += 1
                if root(int(component[i])) == root(int(component[j])) or not before[i].isdisjoint(before[j]):
                    continue
                for m in (i, j):
                    if m not in ready:
                        ready[m] = prepare(texts[m].as_py())
                asked.append((i, j))
            if not asked:
                return
            found = yield [(ready[i], ready[j]) for i, j in asked]
            # what an earlier pair of these has joined was asked in vain, so after links fewer are asked
            size = min(2 * size, TOGETHER) if many and not any(found) else 1 if not many else TOGETHER // 16
            for i, j in (x for x, is_ in zip(asked, found, strict=True) if is_):
                p, q = root(int(component[i])), root(int(component[j]))
                if p != q:
                    parent[max(p, q)] = min(p, q)
                    out.append((int(nodes[i]), int(nodes[j])))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("token", "ascending"), ("p", "ascending"), ("q", "ascending"), ("node", "ascending")])
        keys = [table.column(c).to_numpy() for c in ("token", "p", "q")]
        edges = np.flatnonzero(np.any([np.append(True, k[1:] != k[:-1]) for k in keys], axis=0)).tolist()
        ends = [*edges[1:], table.num_rows]
        out: list[tuple[int, int]] = []
        while edges:
            # blocks of some rows ask together
            n = max(1, int(np.searchsorted(ends, edges[0] + 8 * ROWS, "right"))) if many else 1
            open_ = [(block(table.slice(low, high - low), int(keys[0][low]), bool(keys[1][low] != keys[2][low]), out), None) for low, high in zip(edges[:n], ends[:n], strict=True)]
            edges, ends = edges[n:], ends[n:]
            while open_:
                asking = []
                for pairs, found in open_:
                    try:
                        asking.append((pairs, pairs.send(found)))
                    except StopIteration:
                        pass
                asked = [x for _, wanted in asking for x in wanted]
                found = iter(many(asked) if many else [alike(x, y) for x, y in asked])
                open_ = [(pairs, list(itertools.islice(found, len(wanted)))) for pairs, wanted in asking]
        return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})

    return run


def linked(facts: DataFrame, words: int, differ: int, texts_of: Callable[[DataFrame], DataFrame], prepare: Callable[[str], Any], alike: Callable[[Any, Any], bool], agree: Column | None = None, posts: DataFrame | None = None) -> DataFrame:
    """Pairs (a, b) that are alike and connect what all such pairs would connect.

    facts: node, tokens (an array in an order common to all nodes), sketch (an array of
    words longs) and what agree reads, with _a and _b behind the names. Candidates share
    a token, differ in at most differ bits and agree; alike() decides on whole texts,
    which texts_of() gives as (node, text).

    First all nodes with a token meet one of them, drawn anew for each token or the lead in
    posts, a stored table (token, node, lead, n) of all tokens of n nodes, two or more; a token of two nodes is done with that. Of the others, nodes of different components meet, in
    blocks of bounded size: of the token's largest component only blocks beside the rest
    of its nodes, so that a large component with a few strays takes time linear in it. Of
    a block come the links that join components, never all pairs.
    """
    close = _apart(words) <= differ
    close = close if agree is None else close & agree
    if posts is None:
        # both sides have the same exchange, so posts are dealt by token once
        posts = facts.select("node", F.explode("tokens").alias("token")).where("token IS NOT NULL").repartition("token")
        leads = posts.groupBy("token").agg(F.min_by("node", F.xxhash64("node", "token")).alias("lead"), F.count("*").alias("n")).where("n > 1")
        posts = scratch.table(posts.join(leads.hint("shuffle_hash"), "token").select("token", "node", "lead", "n"))
    near = posts.where("node <> lead").select(F.least("node", "lead").alias("a"), F.greatest("node", "lead").alias("b")).distinct()
    near = scratch.table(near.join(_sided(facts, "a", "a"), "a").join(_sided(facts, "b", "b"), "b").where(close).select("a", "b"))
    texts = texts_of(near.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    both = near.join(texts.select(F.col("node").alias("a"), F.col("text").alias("x")), "a").join(texts.select(F.col("node").alias("b"), F.col("text").alias("y")), "b")
    links = scratch.table(both.select("a", "b", "x", "y").mapInArrow(_confirmed(prepare, alike), "a long, b long"))

    found = graph.components(links)
    many = posts.where("n > 2").select("token", "node").distinct()
    placed = scratch.table(many.join(found, "node", "left").select("token", "node", F.coalesce("component", "node").alias("component")))
    sizes = placed.groupBy("token", "component").agg(F.count("*").alias("size"))
    mixed = sizes.groupBy("token").agg(F.max(F.struct("size", "component")).alias("big"), F.sum("size").alias("n")).where("n > big.size")
    mixed = mixed.select("token", F.col("big.component").alias("big"), F.ceil((F.col("n") - F.col("big.size")) / BLOCK).alias("small_parts"), F.ceil(F.col("big.size") / BLOCK).alias("big_parts"))
    listed = placed.join(mixed, "token").withColumn("rest", F.col("component") != F.col("big"))
    # parts of the rest count up from 0, those of the largest component down from -1
    own = F.when(F.col("rest"), F.pmod(F.xxhash64("node"), "small_parts")).otherwise(-1 - F.pmod(F.xxhash64("node"), "big_parts"))
    other = F.when(F.col("rest"), F.expr("sequence(-big_parts, small_parts - 1)")).otherwise(F.expr("sequence(0L, small_parts - 1)"))
    blocks = listed.withColumn("own", own).withColumn("other", F.explode(other)).withColumns({"p": F.least("own", "other"), "q": F.greatest("own", "other")})
    blocks = blocks.select("token", "p", "q", "node", "own", "component").join(facts.select("node", "tokens", *(c for c in facts.columns if c not in ("node", "tokens"))), "node")
    rest = ["component", *(c for c in facts.columns if c != "node")]
    x, y = (blocks.select("token", "p", "q", *(F.col(c).alias(f"{c}_{side}") for c in ("node", "own", *rest))) for side in "ab")
    once = F.array_intersect("tokens_a", "tokens_b")[0] == F.col("x.token")
    same = [F.col(f"x.{c}") == F.col(f"y.{c}") for c in ("token", "p", "q")]
    meets = (F.col("component_a") != F.col("component_b")) & ((F.col("x.p") == F.col("x.q")) | (F.col("own_a") != F.col("own_b"))) & close & once
    open_ = x.alias("x").join(y.alias("y"), [*same, meets], "left_semi")
    open_ = scratch.table(open_.select("token", "p", "q", *(F.col(f"{c}_a").alias(c) for c in ("node", "own", "component", "tokens", "sketch"))))
    parts = max(1, open_.count() // ROWS)
    texts = texts_of(open_.select("node").distinct())
    dealt = open_.join(texts, "node").withColumn("part", F.pmod(F.xxhash64("token", "p", "q"), F.lit(parts)))
    more = dealt.groupBy("part").applyInArrow(_resolved(prepare, alike, differ), "a long, b long")
    return scratch.table(links.union(more))
