"""Quality rules: decision lists learned by sequential covering over text statistics.

The list is an ordered set of rules, each a conjunction of thresholds on statistics of a
text, and is emitted as one Spark conditional expression. A rule is grown on two thirds
of the labelled rows by information gain and pruned on the rest; it is kept while it is
precise enough there, and the rows that it covers leave the pool.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveworks.llm import scratch
from sieveworks.llm import textkit as tk

#: Labelled rows that the list is learned from at most, half of them of low quality.
TRAIN_ROWS = 20_000
#: A rule must be right this often on the rows kept for pruning.
PRECISION = 0.95
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_chars", "n_upper", "n_digits", "n_marks", "n_one_char", "n_distinct")
#: What rules may test: each by its name as an expression over COUNTS.
STATISTICS = {
    "n_words": "double(n_words)",
    "word_length": "word_chars / greatest(n_words, 1)",
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "upper_share": "n_upper / greatest(n_chars, 1)",
    "digit_share": "n_digits / greatest(n_chars, 1)",
    "mark_share": "n_marks / greatest(n_chars, 1)",
    "one_char_share": "n_one_char / greatest(n_words, 1)",
    "distinct_share": "n_distinct / greatest(n_words, 1)",
    "words_per_line": "n_words / greatest(n_lines, 1)",
}

_SYMBOLS, _MARKS = np.zeros(256, bool), np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True
_MARKS[list(b".,;:!?'\"()[]{}-")] = True


def _per(flags: np.ndarray, edges: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags)])
    return np.diff(total[edges])


def counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of COUNTS for each text."""
    n = len(offsets) - 1
    words = tk.Words(data, offsets, tk.BLANK_WORDS)
    hashes, size = words.hashes(), words.counts
    points = tk.code_points(data)
    chars = points[words.ends] - points[words.starts]
    total = np.concatenate([[0], np.cumsum(chars)])
    out = {"n_words": size, "word_chars": np.diff(total[words.first]), "n_symbols": _per(_SYMBOLS[data], offsets), "n_chars": np.diff(points[offsets])}
    out |= {"n_upper": _per((data >= 65) & (data < 91), offsets), "n_digits": _per((data >= 48) & (data < 58), offsets), "n_marks": _per(_MARKS[data], offsets), "n_one_char": _per(chars == 1, words.first)}
    runs = tk.grams(hashes, 3)
    repeat, distinct, dup, full = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    lines = tk.Words(data, offsets, _NOT_NEWLINE)
    line_hash = lines.hashes()
    worded = np.diff(np.searchsorted(words.starts, np.stack([lines.starts, lines.ends], axis=1)), axis=1)[:, 0] > 0
    for d in range(n):
        low, high = int(words.first[d]), int(words.first[d + 1])
        if high > low:
            distinct[d] = len(np.unique(hashes[low:high]))
        if high - low > 3:
            mine = runs[low : high - 2]
            order = np.argsort(mine, kind="stable")
            same = mine[order][1:] == mine[order][:-1]
            if same.any():
                twice = np.zeros(len(mine) + 3, np.int64)
                at = order[np.append(same, False) | np.append(False, same)]
                twice[at] += 1
                np.subtract.at(twice, at + 3, 1)
                repeat[d] = int((np.cumsum(twice)[: high - low] > 0).sum())
        a, b = int(lines.first[d]), int(lines.first[d + 1])
        mine = line_hash[a:b][worded[a:b]]
        full[d] = len(mine)
        dup[d] = len(mine) - len(np.unique(mine)) if len(mine) > 1 else 0
    out |= {"n_repeat_words": repeat, "n_distinct": distinct, "n_dup_lines": dup, "n_lines": full}
    return np.stack([out[name] for name in COUNTS], axis=1)


_NOT_NEWLINE = tk._table([(0x0A, 0x0A)])
_STRUCT = "struct<" + ",".join(f"{c}:bigint" for c in COUNTS) + ">"


def measured(docs: DataFrame, name: str = "_counts") -> DataFrame:
    """docs with a struct of COUNTS of the whole text; null counts as empty. Other columns may have any name."""

    @F.arrow_udf(_STRUCT)
    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in texts:
            data, offsets = tk.buffers(column)
            rows = [counts(part, at) for _, _, part, at in tk.chunks(data, offsets)]
            whole = np.vstack(rows) if rows else np.zeros((0, len(COUNTS)), np.int64)
            yield pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(whole[:, i])) for i in range(len(COUNTS))], list(COUNTS))

    return docs.withColumn(name, run(F.col("text").cast("string")))


@dataclass(frozen=True)
class Test:
    statistic: str
    above: bool
    threshold: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.statistic] > self.threshold if self.above else x[self.statistic] <= self.threshold

    def __str__(self) -> str:
        return f"{self.statistic} {'>' if self.above else '<='} {self.threshold:.6g}"


Rule = tuple[Test, ...]


def covers(rule: Rule, x: dict[str, np.ndarray], n: int) -> np.ndarray:
    out = np.ones(n, bool)
    for test in rule:
        out &= test.holds(x)
    return out


def _part(x: dict[str, np.ndarray], rows: np.ndarray) -> dict[str, np.ndarray]:
    return {k: v[rows] for k, v in x.items()}


def _grow(x: dict[str, np.ndarray], low: np.ndarray, good: float) -> Rule:
    """Adds the test of highest gain until no row of good quality is covered; each of those counts as `good` rows."""
    rule: list[Test] = []
    rows = np.arange(len(low))
    while True:
        p, n = int(low[rows].sum()), good * int((~low[rows]).sum())
        if not p or not n:
            break
        best, gain = None, 1e-9
        base = math.log2(p / (p + n))
        for name, values in x.items():
            v, y = values[rows], low[rows]
            for threshold in np.unique(np.quantile(v, np.linspace(0, 1, 65))):
                over = v > threshold
                for above, inside in ((True, over), (False, ~over)):
                    a, b = int((inside & y).sum()), good * int((inside & ~y).sum())
                    if a and (g := a * (math.log2(a / (a + b)) - base)) > gain:
                        best, gain = Test(name, above, float(threshold)), g
        if best is None:
            break
        rule.append(best)
        rows = rows[best.holds(_part(x, rows))]
    return tuple(rule)


def _worth(rule: Rule, x: dict[str, np.ndarray], low: np.ndarray, good: float) -> tuple[float, int]:
    inside = covers(rule, x, len(low))
    p, n = int((inside & low).sum()), good * int((inside & ~low).sum())
    return ((p - n) / (p + n) if p + n else -1.0), p


def _halfway(rule: Rule, x: dict[str, np.ndarray], low: np.ndarray) -> Rule:
    """Moves each threshold half the way to the rows that the rule rejects, away from good ones."""
    inside = covers(rule, x, len(low)) & low
    return tuple(Test(t.statistic, t.above, float(t.threshold + np.quantile(x[t.statistic][inside], 0.02 if t.above else 0.98)) / 2) for t in rule) if inside.any() else rule


def learn(x: dict[str, np.ndarray], low: np.ndarray, seed: int = 5, precision: float = PRECISION, good: float = 1.0) -> list[Rule]:
    """Rules that reject; low marks rows of low quality. The list is empty without evidence.

    A row of good quality stands for `good` times as many rows as one of low quality.
    """
    order = np.random.default_rng(seed).permutation(len(low))
    grow, prune = order[: 2 * len(order) // 3], order[2 * len(order) // 3 :]
    rules: list[Rule] = []
    least = max(3, int(0.01 * low.sum()))
    while low[grow].sum() >= least:
        rule = _grow(_part(x, grow), low[grow], good)
        if not rule:
            break
        px, py = _part(x, prune), low[prune]
        rule = max((rule[:i] for i in range(len(rule), 0, -1)), key=lambda r: _worth(r, px, py, good))
        rule = _halfway(rule, _part(x, grow), low[grow])
        worth, hits = _worth(rule, px, py, good)
        inside = covers(rule, _part(x, grow), len(grow))
        right, wrong = (inside & low[grow]).sum(), good * (inside & ~low[grow]).sum()
        if worth < 2 * precision - 1 or hits < 2 or right < precision * (right + wrong) or right < least:
            break
        rules.append(rule)
        grow = grow[~inside]
        prune = prune[~covers(rule, px, len(prune))]
    return rules


def expression(rules: list[Rule], counts_column: str = "_counts") -> Column:
    """The list as one conditional: the number of the first rule that holds (from 1), else 0."""
    names = {name: _over(sql, counts_column) for name, sql in STATISTICS.items()}
    out = None
    for i, rule in enumerate(rules, 1):
        test = " AND ".join(f"({names[t.statistic]}) {'>' if t.above else '<='} {t.threshold!r}D" for t in rule)
        out = (F if out is None else out).when(F.expr(test), F.lit(i))
    return F.lit(0) if out is None else out.otherwise(F.lit(0))


def _over(sql: str, column: str) -> str:
    for name in sorted(COUNTS, key=len, reverse=True):
        sql = sql.replace(name, f"{column}.{name}")
    return sql


def standing(size: int, sampled: int) -> float:
    """How many rows of a class of this size each of the sampled ones, at most so many, stands for."""
    return max(1.0, size / max(sampled, 1))


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> list[Rule]:
    """Learns the list from at most rows labelled documents, in which the classes weigh as in all labels."""
    ids = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("int").alias("quality"))
    sizes = ids.agg(F.count_if(F.col("quality") == 0).alias("low"), F.count_if(F.col("quality") != 0).alias("good")).first()
    halves = [ids.where(c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows // 2) for c in ("quality = 0", "quality <> 0")]
    # rows ids at most
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(halves[0].union(halves[1])), "doc_id")
    stats = measured(texts).select("doc_id", "quality", *(F.expr(_over(sql, "_counts")).alias(name) for name, sql in STATISTICS.items()))
    got = scratch.table(stats).dropDuplicates(["doc_id"]).orderBy("doc_id").toPandas()
    return learn({name: got[name].to_numpy(float) for name in STATISTICS}, (got["quality"] == 0).to_numpy(), good=standing(sizes.good, rows // 2) / standing(sizes.low, rows // 2))


def base_failed(column: str = "_counts") -> Column:
    c = lambda name: F.col(f"{column}.{name}")
    return (c("n_words") < 50) | (100 * c("n_repeat_words") > 50 * c("n_words"))
