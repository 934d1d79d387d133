"""Nearest vectors and token search."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sieveworks.functions.text import cosine

#: Queries that meet all rows at once at most.
BLOCK = 4096
#: Queries whose products with a batch are held at a time.
STRIP = 256
#: Products of rounded lengths differ from the sums in order by far less than this.
SLACK = 1e-9


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-300)


def _exact(x: np.ndarray, to: np.ndarray, q: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Cosine of x[to] and q[at] by sums in the order of the dimensions, as SQL forms them; 0 where one has no length."""
    dot, xx, qq = np.zeros(len(to)), np.zeros(len(x)), np.zeros(len(q))
    for a, b in zip(x.T, q.T, strict=True):
        dot += a[to] * b[at]
        xx += a * a
        qq += b * b
    norm = np.sqrt(xx[to] * qq[at])
    return np.clip(np.divide(dot, norm, out=np.zeros(len(to)), where=norm > 0), -1, 1)


def _best(rows: pd.DataFrame, k: int) -> pd.DataFrame:
    return rows.sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True]).groupby("query_id", sort=False).head(k)


def nearest(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score) of the k most similar vectors of each stated query, in blocks of queries.

    Vectors meet a block by matrix products; what is within SLACK of the k-th is scored
    again by sums in order, so that ties end by vec_id. A task returns k rows a query at
    most. Vectors of other lengths, or none, score 0 or null and are compared as columns.
    """
    spark = vectors.sparkSession
    vectors, queries = vectors.where("vec_id IS NOT NULL"), queries.where("vec_id IS NOT NULL")
    size = vectors.select(F.max(F.size("embedding"))).first()[0] or 0
    whole = (F.size("embedding") == size) & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) > 1e100) | ((x != 0) & (F.abs(x) < 1e-100)))
    good = F.coalesce(whole, F.lit(False))
    odd_q, odd_v = queries.where(~good), vectors.where(~good)
    ids = queries.where(good).select("vec_id", "embedding").orderBy("vec_id")
    out = None
    total = ids.count()
    shape = "query_id long, vec_id long, score double"
    for low in range(0, total, BLOCK):
        part = ids.offset(low).limit(BLOCK).toPandas()
        names = part["vec_id"].to_numpy()
        sent = spark.sparkContext.broadcast((names, np.stack([np.asarray(v, dtype=float) for v in part["embedding"]])))

        def meet(batches, sent=sent):
            names, q = sent.value
            unit = _unit(q)
            cuts = range(0, len(names), STRIP)
            held: list[pd.DataFrame | None] = [None for _ in cuts]
            floors = np.full(len(names), -np.inf)
            for batch in batches:
                if not batch.num_rows:
                    continue
                ids = batch.column(0).to_numpy()
                x = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(ids), -1)
                other = _unit(x).T
                for n, cut in enumerate(cuts):
                    own, floor = names[cut : cut + STRIP], floors[cut : cut + STRIP]
                    near = unit[cut : cut + STRIP] @ other
                    if held[n] is None and len(ids) > k + 1:
                        # one place more, as the query itself may be among the rows
                        floor = np.partition(near, len(ids) - k - 1, axis=1)[:, len(ids) - k - 1]
                    at, to = np.nonzero(near >= floor[:, None] - SLACK)
                    apart = own[at] != ids[to]
                    at, to = at[apart], to[apart]
                    if not len(at):
                        continue
                    found = pd.DataFrame({"query_id": own[at], "vec_id": ids[to], "score": _exact(x, to, q[cut : cut + STRIP], at)})
                    held[n] = _best(found if held[n] is None else pd.concat([held[n], found]), k)
                    last = held[n].groupby("query_id")["score"].agg(["size", "min"])
                    floors[cut : cut + STRIP] = last["min"].where(last["size"] >= k, -np.inf).reindex(own).fillna(-np.inf)
            for rows in held:
                if rows is not None:
                    yield pa.RecordBatch.from_pandas(rows[["query_id", "vec_id", "score"]], preserve_index=False)

        found = vectors.where(good).select(F.col("vec_id").cast("long"), "embedding").mapInArrow(meet, shape)
        out = found if out is None else out.union(found)
    both = lambda v, q: v.join(q.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("_q")), F.col("vec_id") != F.col("query_id"))
    if not odd_v.isEmpty() or not odd_q.isEmpty():
        rest = both(odd_v, queries).union(both(vectors.where(good), odd_q)).select("query_id", "vec_id", cosine(F.col("embedding"), F.col("_q")).alias("score"))
        out = rest if out is None else out.union(rest)
    if out is None:
        return both(vectors, queries.where("false")).select("query_id", "vec_id", F.lit(0.0).alias("score"))
    order = [F.desc("score"), F.col("vec_id")]
    return out.withColumn("_r", F.row_number().over(W.partitionBy("query_id").orderBy(*order))).where(F.col("_r") <= k).drop("_r")


def tokens(text: str = "text"):
    return F.array_distinct(F.filter(F.split(F.lower(text), "[^\\p{L}\\p{N}]+"), lambda w: w != ""))


def matching(rows: DataFrame, words: list[str], text: str = "text") -> DataFrame:
    """Rows that hold all words."""
    return rows.where(F.size(F.array_intersect(tokens(text), F.array(*map(F.lit, words)))) == len(set(words)))


def leaders(vectors: DataFrame, group: str, least: float = 0.3) -> DataFrame:
    """(vec_id, leader): in order of ids, each vector joins the first earlier leader that is similar enough.

    The rule is sequential, so a group is one task; groups must be of bounded size.
    """

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vec_id")
        x = np.array(pdf["embedding"].tolist(), dtype=float)
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        leads: list[int] = []
        out = []
        for i, row in enumerate(x):
            near = np.flatnonzero(x[leads] @ row >= least) if leads else []
            if len(near):
                out.append(leads[near[0]])
            else:
                leads.append(i)
                out.append(i)
        ids = pdf["vec_id"].to_numpy()
        return pd.DataFrame({"vec_id": ids, "leader": ids[out]})

    return vectors.groupBy(group).applyInPandas(one, "vec_id long, leader long")
