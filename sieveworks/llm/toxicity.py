"""Toxicity: Levenshtein automata on a lexicon trie, and context windows around its hits.

The lexicon (terms, and stems that stand for all words beginning so) is learned from a
bounded sample of labelled rows, on top of a short seed. Misspelled terms are found by
one automaton that is the union of the Levenshtein automata of all terms intersected
with the trie of the lexicon; its states are sets of (trie node, edits), made on demand.
Around each hit a window of words tells quotation from abuse. A logistic regression on
the hits of a text, fitted on the same sample, gives the score.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveworks.llm import quality, scratch
from sieveworks.llm import textkit as tk

#: Labelled rows that the lexicon and the regression are fitted on at most, half of them toxic.
TRAIN_ROWS = 20_000
REJECT = 0.7
WINDOW = 6
SEED = ("idiot", "moron", "stupid", "loser", "scum", "trash", "clown", "pathetic", "worthless", "disgusting", "imbecile", "bastard", "asshole", "bitch", "retard", "dumbass")
REPORTING = frozenset("said says called calls quote quoted wrote writes reported reports told term word phrase insult insults slur slurs example cited".split())
ADDRESSING = frozenset("you your youre yourself ur u du dich dein ihr tu toi vous vos tus usted ustedes".split())
_QUOTES = "\"'«»“”‘’„‹›"

_LETTERS = tk._table([(0x00, 0x23), (0x25, 0x29), (0x2B, 0x2F), (0x3A, 0x3F), (0x5B, 0x60), (0x7B, 0x7F)])  # digits, @, $ and * stand for letters
FEATURES = ("any", "log hits", "log near hits", "log open hits", "log quoted hits", "addressed", "hits per word", "kinds")


def _written(word: str, at: int) -> set[bytes]:
    """word in either case of the two letters from at on, A-Z folded."""
    two = range(at % len(word), min(len(word), at % len(word) + 2))
    forms = {word}
    for i in two:
        forms |= {w[:i] + w[i].upper() + w[i + 1 :] for w in forms if len(w) == len(word)}
    return {w.translate(tk.ASCII_LOWER).encode() for w in forms}


class Lexicon:
    """Terms and stems in one trie, and the automaton that runs words through it."""

    def __init__(self, terms: list[str], stems: list[str], near: list[str]) -> None:
        self.terms, self.stems, self.near = list(terms), list(stems), set(near)
        self.next: list[dict[str, int]] = [{}]
        self.ends: list[str | None] = [None]
        self.stem: list[str | None] = [None]
        self.fuzzy: list[bool] = [False]  # below the node there is a term that may be misspelled
        for word, is_stem in [*((t, False) for t in terms), *((s, True) for s in stems)]:
            at = 0
            for ch in word:
                if ch not in self.next[at]:
                    self.next[at][ch] = len(self.next)
                    self.next.append({})
                    self.ends.append(None)
                    self.stem.append(None)
                    self.fuzzy.append(False)
                at = self.next[at][ch]
                self.fuzzy[at] |= word in self.near and not is_stem
            (self.stem if is_stem else self.ends)[at] = word
        self.fuzzy[0] = bool(self.near)
        self.head = np.zeros(1 << 16, dtype=bool)
        self.tail = np.zeros(1 << 16, dtype=np.uint64)
        for word in [*terms, *stems]:
            for raw in _written(word, 0):
                self.head[raw[0] | raw[1] << 8] = True
            for raw in _written(word, -2) if word in self.near else ():
                # one letter of up to four bytes more, less or in place of another; all long words share the last bit
                sizes = range(max(0, len(raw) - 4), len(raw) + 5)
                self.tail[raw[-2] | raw[-1] << 8] |= np.uint64(sum({1 << min(n, 63) for n in sizes}))
        # a state is (node, edits), or (node, letter) halfway through two transposed letters
        self.moves: dict[tuple[frozenset, str], frozenset] = {}
        self.known: dict[str, tuple[str, bool] | None] = {}

    def __getstate__(self) -> dict:
        return {**self.__dict__, "moves": {}, "known": {}}

    def closure(self, states: set[tuple]) -> frozenset:
        """Adds the states after a letter of the term that the word lacks."""
        more = set(states)
        for node, edits in states:
            if not edits and self.fuzzy[node]:
                more |= {(to, 1) for to in self.next[node].values() if self.fuzzy[to]}
        return frozenset(more)

    def step(self, states: frozenset, ch: str) -> frozenset:
        found = self.moves.get((states, ch))
        if found is None:
            new: set[tuple] = set()
            for node, edits in states:
                if isinstance(edits, str):
                    if ch == edits:
                        new.add((node, 1))
                    continue
                to = self.next[node].get(ch)
                if to is not None and (not edits or self.fuzzy[to]):
                    new.add((to, edits))
                if not edits and self.fuzzy[node]:
                    new.add((node, 1))  # a letter too much
                    new |= {(x, 1) for c, x in self.next[node].items() if c != ch and self.fuzzy[x]}
                    new |= {(self.next[x][ch], c) for c, x in self.next[node].items() if c != ch and ch in self.next[x] and self.fuzzy[self.next[x][ch]]}
            found = self.closure(new)
            if len(self.moves) < 200_000:
                self.moves[states, ch] = found
        return found

    def match(self, word: str) -> tuple[str, bool] | None:
        """The term or stem that word is, and whether it is misspelled; exact ones first."""
        if word in self.known:
            return self.known[word]
        states, stem = self.closure({(0, 0)}), None
        for ch in word:
            states = self.step(states, ch)
            if not states:
                break
            if stem is None:
                stem = next((self.stem[n] for n, e in states if e == 0 and self.stem[n]), None)
        ends = sorted((e, self.ends[n]) for n, e in states if e in (0, 1) and self.ends[n] and (not e or self.ends[n] in self.near)) if states else []
        out = (ends[0][1], False) if ends and not ends[0][0] else (stem, False) if stem else (ends[0][1], True) if ends else None
        if len(self.known) < 500_000:
            self.known[word] = out
        return out


def hits(data: np.ndarray, offsets: np.ndarray, lexicon: Lexicon) -> tuple[tk.Words, list[tuple[int, int, str, bool]]]:
    """Words of some texts, and (text, word, term, misspelled) of each hit.

    A word within one edit of a term (a letter more, less or in place of another, or two
    neighbours transposed) keeps the term's first or last two bytes in some case, so others
    never reach the automaton.
    """
    words = tk.Words(tk.FOLD[data], offsets, _LETTERS)
    low, size = words.data, words.ends - words.starts
    long = np.flatnonzero(size >= 3)
    s, e = words.starts[long], words.ends[long]
    head = low[s].astype(np.int64) | low[s + 1].astype(np.int64) << 8
    tail = low[e - 2].astype(np.int64) | low[e - 1].astype(np.int64) << 8
    some = lexicon.head[head] | ((lexicon.tail[tail] >> np.minimum(size[long], 63).astype(np.uint64)) & np.uint64(1)).astype(bool)
    out = []
    for w in long[some].tolist():
        word = low[words.starts[w] : words.ends[w]].tobytes().decode("utf-8", "replace").lower()
        if (found := lexicon.match(word)) is not None:
            out.append((int(np.searchsorted(words.first, w, "right")) - 1, w, *found))
    return words, out


def quoted_share(words: tk.Words, text: int, w: int) -> tuple[float, bool]:
    """How much the window around word w speaks for quotation (0 to 1), and whether it addresses someone."""
    low, high = max(int(words.first[text]), w - WINDOW), min(int(words.first[text + 1]), w + WINDOW + 1)
    near = [words.data[words.starts[i] : words.ends[i]].tobytes().decode("utf-8", "replace") for i in range(low, high) if i != w]
    before = words.data[words.starts[low] : words.starts[w]].tobytes().decode("utf-8", "replace")
    after = words.data[words.ends[w] : words.ends[high - 1]].tobytes().decode("utf-8", "replace") if high - 1 >= w else ""
    marks = lambda s: len(re.findall(rf"(?<!\w)[{_QUOTES}]|[{_QUOTES}](?!\w)", s))
    score = 0.6 * (marks(before) % 2 == 1 and marks(after) > 0) + 0.5 * any(x in REPORTING for x in near)
    addressed = any(x in ADDRESSING for x in near)
    return min(1.0, score) * (0.5 if addressed else 1.0), addressed


def text_features(data: np.ndarray, offsets: np.ndarray, lexicon: Lexicon) -> np.ndarray:
    words, found = hits(data, offsets, lexicon)
    out = np.zeros((len(offsets) - 1, len(FEATURES)))
    kinds: dict[int, set[str]] = {}
    for text, w, term, misspelled in found:
        quoted, addressed = quoted_share(words, text, w)
        row = out[text]
        row[1] += not misspelled
        row[2] += misspelled
        row[3] += 1 - quoted
        row[4] += quoted
        row[5] += addressed
        kinds.setdefault(text, set()).add(term)
    total = out[:, 1] + out[:, 2]
    out[:, 0] = total > 0
    out[:, 6] = np.minimum(1, 20 * total / np.maximum(1, words.counts))
    out[:, 7] = np.log1p([len(kinds.get(i, ())) for i in range(len(out))])
    out[:, 1:6] = np.log1p(out[:, 1:6])
    return out


class Model:
    def __init__(self, lexicon: Lexicon, weights: np.ndarray) -> None:
        self.lexicon, self.weights = lexicon, weights

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        z = text_features(data, offsets, self.lexicon) @ self.weights[:-1] + self.weights[-1]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def regress(x: np.ndarray, y: np.ndarray, prior: float = 1.0, weights: np.ndarray | None = None) -> np.ndarray:
    """Logistic regression by Newton steps on weighted rows; the bias comes last and has no prior."""
    x = np.hstack([x, np.ones((len(x), 1))])
    much = np.ones(len(x)) if weights is None else weights
    w, keep = np.zeros(x.shape[1]), np.append(np.full(x.shape[1] - 1, prior), 1e-6)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (much * p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(keep), x.T @ (much * (y - p)) - keep * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def chosen_terms(counts: list[tuple[str, int, int]], toxic: int, clean: int) -> tuple[list[str], list[str]]:
    """Terms and stems (marked by a final *) whose texts are toxic beyond chance.

    counts: feature, toxic texts, other texts. A stem gives way to the word that makes up
    nearly all of it, and to a longer stem of the same texts.
    """
    def evidence(a: int, b: int) -> float:
        p = (a + b) / (toxic + clean)
        q1, q0 = (a + 0.5) / (toxic + 1), (b + 0.5) / (clean + 1)
        return 2 * (a * math.log(max(q1, 1e-9) / p) + b * math.log(max(q0, 1e-9) / p)) if p else 0

    good = {t: (a, b) for t, a, b in counts if a >= max(3, 0.01 * toxic) and (b + 0.5) / (clean + 1) < 0.02 * (a + 0.5) / (toxic + 1) + 0.5 / (clean + 1) and evidence(a, b) > 12}
    words = {t for t in good if not t.endswith("*")}
    stems = []
    for t in sorted((t for t in good if t.endswith("*")), key=lambda t: (-good[t][0], -len(t))):
        stem, (a, _) = t[:-1], good[t]
        if any(w.startswith(stem) and good[w][0] >= 0.9 * a for w in words):
            continue
        if any(u.startswith(stem) and len(u) > len(t) and good[u][0] >= 0.99 * a for u in good if u.endswith("*")):
            continue
        if any(stem.startswith(s) for s in stems):
            continue
        if a >= max(4, 0.03 * toxic):
            stems.append(stem)
    terms = [w for w in words if not any(w.startswith(s) for s in stems)]
    return sorted(terms, key=lambda w: (-good[w][0], w)), stems


def fold(doc_id: Column | str) -> Column:
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % 3


def _sample(docs: DataFrame, labels: DataFrame, rows: int) -> tuple[DataFrame, float, float]:
    """The labelled texts, and how many rows each toxic one and each other one stands for."""
    ids = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic")).where(fold("doc_id") != 1)
    sizes = ids.agg(F.count_if(F.col("toxic") == 1).alias("toxic"), F.count_if(F.col("toxic") != 1).alias("clean")).first()
    halves = [ids.where(c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows // 2) for c in ("toxic = 1", "toxic <> 1")]
    # rows ids at most
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    sample = scratch.table(texts.join(F.broadcast(halves[0].union(halves[1])), "doc_id").dropDuplicates(["doc_id"]))
    return sample, quality.standing(sizes.toxic, rows // 2), quality.standing(sizes.clean, rows // 2)


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        seen, toxic = [], []
        for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            found = set()
            for word in re.findall(r"[^\W\d_]+", text.lower()):
                if len(word) >= 3:
                    found.add(word)
                    found |= {word[:k] + "*" for k in range(4, min(8, len(word)))}
            seen += found
            toxic += [label] * len(found)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.string()), pa.array(toxic, pa.int32())], ["term", "toxic"])


def _featured(shared: scratch.Shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = tk.buffers(batch.column(0))
            x = text_features(data, offsets, shared.value)
            yield pa.RecordBatch.from_arrays([pa.array(x.tolist(), pa.list_(pa.float64())), batch.column(1)], ["x", "toxic"])

    return run


def _near_counts(shared: scratch.Shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = tk.buffers(batch.column(0))
            found = {(text, term) for text, _, term, misspelled in hits(data, offsets, shared.value)[1] if misspelled}
            labels = batch.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([t for _, t in found], pa.string()), pa.array([labels[d] for d, _ in found], pa.int32())], ["term", "toxic"])

    return run


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """Learns lexicon and weights from at most rows labelled documents outside the held-out fold, in which the classes weigh as in all labels."""
    spark = docs.sparkSession
    sample, per_toxic, per_clean = _sample(docs, labels, rows)
    ratio = per_clean / per_toxic
    sizes = {r.toxic: r.n for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    toxic, clean = sizes.get(1, 0), sum(n for t, n in sizes.items() if t != 1)
    part = sample.select("text", F.col("toxic").cast("int")).repartition(16)
    counted = part.mapInArrow(_listed, "term string, toxic int").groupBy("term").agg(F.count_if(F.col("toxic") == 1).alias("a"), F.count_if(F.col("toxic") != 1).alias("b"))
    # bounded by the sample: a term is in a hundredth of its toxic texts
    likely = counted.where((F.col("a") >= max(3, 0.01 * toxic)) & (F.col("b") * 20 * ratio <= F.col("a") + 20 * ratio)).orderBy(F.desc("a"), "b", "term")
    terms, stems = chosen_terms([(r.term, r.a, r.b) for r in likely.collect()], toxic, clean) if toxic else ([], [])
    terms = list(dict.fromkeys([*terms, *(w for w in SEED if not any(w.startswith(s) for s in stems))]))
    near = [t for t in terms if len(t) >= 5]
    trial = scratch.Shared(spark, Lexicon(terms, stems, near))
    for r in part.mapInArrow(_near_counts(trial), "term string, toxic int").groupBy("term").agg(F.count_if(F.col("toxic") == 1).alias("a"), F.count_if(F.col("toxic") != 1).alias("b")).collect():
        if r.b > max(1, 0.001 * clean) or r.b > 0.1 * r.a / ratio + 1:
            near.remove(r.term)  # its misspellings are words of the language
    lexicon = Lexicon(terms, stems, near)
    got = part.mapInArrow(_featured(scratch.Shared(spark, lexicon)), "x array<double>, toxic int").collect()
    base = np.array([[1, 0.7, 0, 0.7, 0, 0, 0.3, 0.7], [0] * 8, [1, 0, 0.7, 0.7, 0, 0, 0.3, 0.7], [1, 0.7, 0, 0, 0.7, 0, 0.2, 0.7]], dtype=float)
    x = np.vstack([np.array([r.x for r in got]).reshape(-1, len(FEATURES)), base])
    y = np.array([int(r.toxic == 1) for r in got] + [1, 0, 1, 0])
    # as many as there are rows in all, so that the prior counts the same
    much = np.where(y[:-4] == 1, per_toxic, per_clean)
    much = np.append(much * (len(much) / max(much.sum(), 1)), np.ones(4))
    return Model(lexicon, regress(x, y, weights=much))


def score(docs: DataFrame, model: Model, name: str = "_score") -> DataFrame:
    """docs with the score of their text, 0 to 1; null and empty texts have no hits.

    Only the text is read, so docs may have any other columns; repeated rows get equal scores.
    """
    shared = scratch.Shared(docs.sparkSession, model)

    @F.arrow_udf("double")
    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in texts:
            data, offsets = tk.buffers(column)
            parts = [shared.value.scores(part, at) for _, _, part, at in tk.chunks(data, offsets)]
            yield pa.array(np.concatenate(parts) if parts else np.zeros(0))

    return docs.withColumn(name, run(F.col("text").cast("string")))
