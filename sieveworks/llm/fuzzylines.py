"""Fuzzy line dedup: SimHash of quarter lines, joined on pigeonhole blocks, edit similarity, connected groups.

Lines are compared in a normal form (letters A-Z folded, digits as 0, runs of other ASCII
signs as one blank). A form of seven words or more is cut into four blocks of equal
numbers of words, two from its start and two from its end, and each block has a SimHash
of its own. Two forms whose edits lie in two of the blocks agree in the other two, so
they meet in one of six pairs of blocks. SimHash blocks cannot find edits that are spread
over all four; forms of SPREAD words or more therefore also meet in bands of minimum
hashes of neighbouring words. Forms of eight words or fewer meet without one of their
words, and in their halves; tiny ones by exact pieces. Candidates are held apart by the
SimHash of the whole line, pairs are verified by edit distance, and of each connected
group the first occurrence stays.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sieveworks.llm import graph, linking, scratch
from sieveworks.llm import textkit as tk
from sieveworks.llm.minhash import only

#: Of the 128 bits of the lines' SimHashes; lines that agree in two quarters differ in 32, in more than 52 once in three million.
DIFFER = 52
SIMILARITY = 0.75
#: Forms of fewer letters meet by exact pieces; those of MEETING letters and more meet as longer ones do, too.
TINY, MEETING = 16, 12
#: Words up to which forms meet without one of them, and from which they have quarters and bands.
FEW, QUARTERS, SPREAD = 8, 7, 16
BITS = 32
BANDS, IN_BAND = 6, 4
#: Numbers in a table about pairs that are compared side by side, at most if there are many.
ABREAST = 1 << 21
#: Tokens that a task holds before it posts them, and those of a part that are looked at together.
POSTED, FOLDED = 1 << 20, 1 << 21
_SEEDS = tk.mix(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)
_K = np.uint64(0xD6E8FEB86659FD93)
_SIGNS, _LANES = np.uint64(0x8080808080808080), np.uint64(0x00FF00FF00FF00FF)
_NOT_NEWLINE = tk._table([(0x0A, 0x0A)])
_NORMAL = tk.FOLD.copy()
_NORMAL[49:58] = 48
LAST = 2**63 - 1


def _steps(last: int, factor: float) -> np.ndarray:
    """0, 1, 2 and on in steps that grow by the factor."""
    out = [0]
    while out[-1] < last:
        out.append(max(out[-1] + 1, int(out[-1] * factor)))
    return np.array(out)


_WORD_STEPS, _BYTE_STEPS = _steps(1 << 40, 1.2), _steps(1 << 40, 1.25)


def _line_starts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start of each line, index of each text's first line, number of the line in its text."""
    marks = np.flatnonzero(data == 10) + 1
    owner = np.searchsorted(offsets, marks - 1, "right") - 1
    starts = np.concatenate([offsets[:-1], marks])
    texts = np.concatenate([np.arange(len(offsets) - 1), owner])
    order = np.lexsort((starts, texts))
    starts, texts = starts[order], texts[order]
    first = np.searchsorted(texts, np.arange(len(offsets)))
    return starts, first, np.arange(len(starts)) - first[texts]


class Lines:
    """The lines with words of some texts: text, number in it, words, letters of the normal form, its hash in two halves."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        starts, first, number = _line_starts(data, offsets)
        words = self.words = tk.Words(_NORMAL[data], offsets, tk.ALNUM_WORDS)
        text = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
        # of lines that start at one byte, all but the last are empty
        of_word = np.searchsorted(starts, words.starts, "right") - 1
        self.begin = np.flatnonzero(np.append(True, np.diff(of_word) > 0)) if len(of_word) else np.zeros(0, np.int64)
        line = of_word[self.begin]
        self.text, self.number = text[line], number[line]
        self.count = np.diff(np.append(self.begin, len(of_word)))
        self.hashes = words.hashes()
        self.high, self.low = (tk.runs_hashes(self.hashes, self.begin, self.count, seed) for seed in (1, 2))
        self.raw = data

    @functools.cached_property
    def letters(self) -> np.ndarray:
        points = tk.code_points(self.raw)
        total = np.concatenate([[0], np.cumsum(points[self.words.ends] - points[self.words.starts])])
        return total[self.begin + self.count] - total[self.begin] + self.count - 1

    def form(self, i: int) -> str:
        a, b = int(self.begin[i]), int(self.begin[i] + self.count[i])
        return b" ".join(self.words.data[x:y].tobytes() for x, y in zip(self.words.starts[a:b], self.words.ends[a:b], strict=True)).decode("utf-8", "replace")

    def forms(self) -> pa.Array:
        """The normal forms of all lines."""
        if not len(self.begin):
            return pa.array([], pa.string())
        starts, size = self.words.starts, self.words.ends - self.words.starts
        # a blank behind each word but a line's last
        wide = size + 1
        wide[self.begin + self.count - 1] -= 1
        before, skipped = np.cumsum(wide) - wide, np.cumsum(size) - size
        letter = np.arange(size.sum())
        raw = np.full(wide.sum(), 32, np.uint8)
        raw[np.repeat(before - skipped, size) + letter] = self.words.data[np.repeat(starts - skipped, size) + letter]
        offsets = np.append(before[self.begin], len(raw))
        out = pa.LargeStringArray.from_buffers(len(self.begin), pa.py_buffer(offsets), pa.py_buffer(raw))
        try:
            out.validate(full=True)
        except pa.ArrowInvalid:
            return pa.array([self.form(i) for i in range(len(self.begin))], pa.string())
        return out.cast(pa.string())

    def simhashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """SimHash of each run of words: a bit is the sign of a sum of numbers drawn for the words."""
        out = np.zeros(len(starts), np.uint64)
        size = ends - starts
        wide = np.flatnonzero(size > 256)
        total, one_by_one = np.zeros(len(self.hashes) + 1, np.uint64), np.zeros(len(self.hashes) + 1, np.int32)
        even = (size << 7).astype(np.uint64)
        for i in range(0, BITS, 8):
            x = self.hashes * _SEEDS[i]
            x ^= x >> np.uint64(32)
            drawn = x.view(np.int8).reshape(-1, 8)
            # four sums in the 16 bits of a number each, of bytes from 0 on, hold in runs of 256 words
            for j in (0, 1):
                np.cumsum((x ^ _SIGNS) >> np.uint64(8 * j) & _LANES, out=total[1:])
                sums = total[ends] - total[starts]
                for k in range(4):
                    out |= ((sums >> np.uint64(16 * k) & np.uint64(0xFFFF)) > even).astype(np.uint64) << np.uint64(i + 2 * k + j)
            if len(wide):
                out[wide] &= ~(np.uint64(255) << np.uint64(i))
                for k in range(8):
                    np.cumsum(drawn[:, k], dtype=np.int32, out=one_by_one[1:])
                    out[wide] |= (one_by_one[ends[wide]] > one_by_one[starts[wide]]).astype(np.uint64) << np.uint64(i + k)
        return out

    def quarters(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(line, token) of each pair of blocks, and every line's SimHash of four blocks, 0 where there are too few words.

        A form that is one word short of a longer step has the tokens of that, too.
        """
        step = lambda c: _WORD_STEPS[np.searchsorted(_WORD_STEPS, c // 4, "right") - 1]
        now, next_ = step(self.count), step(self.count + 1)
        some, more = np.flatnonzero(now > 1), np.flatnonzero((self.count >= QUARTERS) & (next_ > np.maximum(now, 1)))
        line, size = np.concatenate([some, more]), np.concatenate([now[some], next_[more]])
        low, high = self.begin[line], self.begin[line] + self.count[line]
        starts = [low, low + size, high - 2 * size, high - size]
        parts = self.simhashes(np.concatenate(starts), np.concatenate(starts) + np.tile(size, 4)).reshape(4, -1)
        base = tk.mix(size.astype(np.uint64))
        tokens = [tk.mix((base + (parts[i] << np.uint64(32) | parts[j])) * _SEEDS[4 * i + j]) for i in range(4) for j in range(i + 1, 4)]
        sketch = np.zeros((len(self.begin), 2), np.uint64)
        for i in (0, 1):
            sketch[some, i] = (parts[2 * i] << np.uint64(32) | parts[2 * i + 1])[: len(some)]
        return np.tile(line, 6), np.concatenate(tokens), sketch

    def bands(self) -> tuple[np.ndarray, np.ndarray]:
        """(line, token) of each band of minimum hashes over neighbouring words, the ends of the line included."""
        line = np.flatnonzero(self.count >= SPREAD)
        if not len(line):
            return line, np.zeros(0, np.uint64)
        n = self.count[line] + 1
        first = np.concatenate([[0], np.cumsum(n)[:-1]])
        at = np.repeat(self.begin[line] - first, n) + np.arange(n.sum())
        left, right = self.hashes[at - 1], self.hashes[np.minimum(at, len(self.hashes) - 1)]
        left[first], right[first + n - 1] = 1, 2
        pairs = tk.mix(left * _K + right)
        tokens = []
        for band in range(BANDS):
            token = np.full(len(line), band + 1, np.uint64)
            for i in range(band * IN_BAND, (band + 1) * IN_BAND):
                token = tk.mix(token * _K + np.minimum.reduceat(pairs * _SEEDS[i], first))
            tokens.append(token)
        return np.tile(line, BANDS), np.concatenate(tokens)

    def shorter(self) -> tuple[np.ndarray, np.ndarray]:
        """(line, token) of forms of few words: whole, without each one of the words, and by halves of their bytes."""
        lines, tokens = [], []
        for c in range(1, FEW + 1):
            line = np.flatnonzero((self.count == c) & (self.letters >= MEETING))
            if not len(line):
                continue
            words = self.hashes[self.begin[line][:, None] + np.arange(c)]
            for left_out in range(-1, c if c > 2 else 0):
                token = np.full(len(line), 99, np.uint64)
                for i in range(c):
                    if i != left_out:
                        token = tk.mix(token * _K + words[:, i])
                lines.append(line)
                tokens.append(token)
        few = np.flatnonzero((self.count <= FEW) & (self.letters >= MEETING))
        if len(few):
            # the bytes of these lines' words, one after the other
            n = self.count[few]
            of = np.repeat(self.begin[few] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            size = self.words.ends[of] - self.words.starts[of]
            upto = np.cumsum(size)
            raw = self.words.data[np.repeat(self.words.starts[of] - upto + size, size) + np.arange(upto[-1])]
            ends = upto[np.cumsum(n) - 1]
            starts = np.concatenate([[0], ends[:-1]])
            prefix = tk.Prefix(raw)
            level = np.searchsorted(_BYTE_STEPS, (ends - starts) // 2, "right") - 1
            for down in (0, 1):
                half = _BYTE_STEPS[np.maximum(level - down, 1)]
                for i, (s, e) in enumerate(((starts, starts + half), (ends - half, ends))):
                    lines.append(few)
                    tokens.append(tk.mix(prefix.of(s, e) + np.uint64(i + 1)))
        return (np.concatenate(lines), np.concatenate(tokens)) if lines else (np.zeros(0, np.int64), np.zeros(0, np.uint64))

    def tokens(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where each line's tokens begin, all tokens (48 bits keep them apart enough), and the lines' SimHashes."""
        *quarters, sketch = self.quarters()
        line, token = (np.concatenate(x) for x in zip(quarters, self.bands(), self.shorter(), strict=True))
        order = np.argsort(line, kind="stable")
        return np.searchsorted(line[order], np.arange(len(self.begin) + 1)), token[order] >> np.uint64(16), sketch


_LINED = "doc long, row long, n_lines long, number array<int>, high array<long>, low array<long>, left array<long>, right array<long>, tiny array<long>, form array<string>, part int, tokens binary, highs binary"


def _lined(parts: int):
    """Of each text the numbers, hashes and SimHashes of its lines and its tiny forms; then all tokens with their lines' hashes, in rows by part."""
    schema = pa.schema([("doc", pa.int64()), ("row", pa.int64()), ("n_lines", pa.int64()), ("number", pa.list_(pa.int32())), *((c, pa.list_(pa.int64())) for c in ("high", "low", "left", "right", "tiny")), ("form", pa.list_(pa.string())), ("part", pa.int32()), ("tokens", pa.binary()), ("highs", pa.binary())])

    def full(columns: dict[str, pa.Array], n: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([columns[f.name] if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)

    def posted(held: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        high, size, tokens = (np.concatenate(x) for x in zip(*held, strict=True))
        # a line that comes again has posted its tokens
        once = np.zeros(len(high), bool)
        once[np.unique(high, return_index=True)[1]] = True
        tokens, high = tokens[np.repeat(once, size)], np.repeat(high[once], size[once])
        part = (tokens % np.uint64(parts)).astype(np.uint16 if parts <= 1 << 16 else np.uint32)
        order = np.argsort(part, kind="stable")
        at = np.searchsorted(part[order], np.arange(parts + 1, dtype=part.dtype if parts < 1 << 16 else np.uint32))
        some = np.flatnonzero(np.diff(at))
        where = pa.py_buffer((np.append(at[some], at[-1]) * 8).astype(np.int32))
        blobs = {k: pa.Array.from_buffers(pa.binary(), len(some), [None, where, pa.py_buffer(x[order])]) for k, x in (("tokens", tokens), ("highs", high))}
        return full({"part": pa.array(some, pa.int32()), **blobs}, len(some))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        n = 0
        for batch in batches:
            data, offsets = tk.buffers(batch.column(2))
            for low, high, part, at in tk.chunks(data, offsets, 1 << 18):
                lines = Lines(part, at)
                where, tokens, sketch = lines.tokens()
                held.append((lines.high, np.diff(where), tokens))
                n += len(tokens)
                texts = np.arange(high - low + 1)
                first = pa.array(np.searchsorted(lines.text, texts), pa.int32())
                lists = [("number", lines.number.astype(np.int32)), ("high", lines.high.view(np.int64)), ("low", lines.low.view(np.int64)), ("left", sketch[:, 0].view(np.int64)), ("right", sketch[:, 1].view(np.int64))]
                tiny = np.flatnonzero(lines.letters < TINY)
                of = pa.array(np.searchsorted(lines.text[tiny], texts), pa.int32())
                columns = {k: pa.ListArray.from_arrays(first, pa.array(x)) for k, x in lists}
                columns |= {"tiny": pa.ListArray.from_arrays(of, pa.array(lines.high[tiny].view(np.int64))), "form": pa.ListArray.from_arrays(of, pa.array([lines.form(i) for i in tiny.tolist()], pa.string()))}
                columns |= {"doc": batch.column(0).slice(low, high - low), "row": batch.column(1).slice(low, high - low), "n_lines": pa.array(np.diff(first.to_numpy()), pa.int64())}
                yield full(columns, high - low)
                if n >= POSTED:
                    yield posted(held)
                    held, n = [], 0
        if n:
            yield posted(held)

    return run


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Posts (token, node, lead, n) of the tokens that two lines or more have; the lead is one of a token's lines.

    What comes is looked at in runs of bounded size, between which one line of each token
    is kept. If there are several runs, n is 3 for "two or more".
    """
    token, node, told = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, bool)
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size, runs = 0, 0

    def folded(last: bool) -> pa.RecordBatch:
        nonlocal token, node, told
        t, h = np.concatenate([token, *(x[0] for x in held)]), np.concatenate([node, *(x[1] for x in held)])
        old = np.append(told, np.zeros(len(t) - len(told), bool))
        order = np.argsort(t)
        same = np.diff(t[order]) == 0
        more = np.append(same, False) | np.append(False, same)
        alone, at = order[~more], order[more]
        # the line that is told as a token's lead comes first, else the one of the lowest hash
        at = at[np.lexsort((h[at], ~old[at], t[at]))]
        new = np.append(True, np.diff(t[at]) != 0)[: len(at)]
        lead = h[at[new]][np.cumsum(new) - 1]
        again = np.append(False, (np.diff(h[at]) == 0) & ~new[1:])[: len(at)]
        stay = new | ~again & (h[at] != lead)
        at, new, lead = at[stay], new[stay], lead[stay]
        group = np.cumsum(new) - 1
        n = np.bincount(group, minlength=1)[group]
        out = (n > 1) & ~old[at]
        if not last:
            first = at[new]
            token, node, told = np.append(t[alone], t[first]), np.append(h[alone], h[first]), np.append(old[alone], old[first] | (n[new] > 1))
        n = n[out] if last and not runs else np.full(np.count_nonzero(out), 3)
        return pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in (t[at][out].view(np.int64), h[at][out].view(np.int64), lead[out].view(np.int64), n)], ["token", "node", "lead", "n"])

    for batch in batches:
        for x, y in zip(batch.column(0), batch.column(1), strict=True):
            held.append((np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)))
            size += len(held[-1][0])
            if size >= FOLDED:
                yield folded(False)
                held, size, runs = [], 0, runs + 1
    if size:
        yield folded(True)


def _cut(size: int, pieces: int) -> list[tuple[int, int]]:
    edges = [size * i // pieces for i in range(pieces + 1)]
    return list(zip(edges[:-1], edges[1:], strict=True))


def pieces(form: str, similarity: float, longer: bool) -> set[str]:
    """Keys of a tiny form as the longer or the shorter of a pair: k edits spare one of k + 1 pieces and move it by k at most."""
    out = set()
    for size in [len(form)] if longer else range(len(form), TINY):
        most = int((1 - similarity) * size + 1e-9)
        if not most or size - len(form) > most:
            continue
        for i, (low, high) in enumerate(_cut(size, most + 1)):
            places = [low] if longer else range(max(0, low - most), min(len(form) - (high - low), low + most) + 1)
            out |= {f"{size}:{i}:{form[at : at + high - low]}" for at in places}
    return out


def _pieced(similarity: float, longer: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(n, f, k) for n, f in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for k in pieces(f, similarity, longer)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.string())], ["node", "form", "key"])

    return run


def tiny_links(tiny: DataFrame, similarity: float) -> DataFrame:
    """All pairs (a, b) of similar tiny forms; tiny: node, form."""
    x, y = (tiny.select("node", "form").mapInArrow(_pieced(similarity, longer), "node long, form string, key string") for longer in (True, False))
    most = f"int({1 - similarity!r}D * length(x.form) + 1e-9D)"
    near = F.expr(f"x.key = y.key AND x.node <> y.node AND levenshtein(x.form, y.form) <= {most}")
    return x.alias("x").join(y.alias("y"), near).select(F.expr("least(x.node, y.node)").alias("a"), F.expr("greatest(x.node, y.node)").alias("b")).distinct()


def edit_distance(a: str, b: str, most: float | None = None) -> int:
    """Levenshtein distance by bit vectors over the letters of a; where it exceeds most, some number beyond that."""
    if not a or not b:
        return len(a) + len(b)
    at: dict[str, int] = {}
    for i, ch in enumerate(a):
        at[ch] = at.get(ch, 0) | 1 << i
    mask, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    plus, minus, distance = mask, 0, len(a)
    bound = len(b) + (len(a) + len(b) if most is None else most)
    for j, ch in enumerate(b):
        eq = at.get(ch, 0)
        diagonal = (((eq & plus) + plus) ^ plus) | eq | minus
        up, down = minus | (~(diagonal | plus) & mask), plus & diagonal
        if up & top:
            distance += 1
        elif down & top:
            distance -= 1
        # each letter left brings it down by one at most
        if distance + j + 1 > bound:
            return distance + j + 1 - len(b)
        up = up << 1 | 1
        plus, minus = (down << 1 | ~(diagonal | up)) & mask, up & diagonal & mask
    return distance


def _trimmed(a: str, b: str) -> tuple[str, str]:
    """a and b without their common beginning."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return a[low:], b[low:]


def _by_words(a: str, b: str, most: float) -> bool:
    """Whether replacing runs of words, up to the nearest place where both agree again, changes at most so many letters."""
    x, y = [w + " " for w in a.split(" ")], [w + " " for w in b.split(" ")]
    i = j = cost = 0
    while i < len(x) or j < len(y):
        if x[i : i + 1] == y[j : j + 1]:
            i, j = i + 1, j + 1
            continue
        apart = ((p, far - p) for far in range(1, 7) for p in range(far + 1) if x[i + p : i + p + 1] == y[j + far - p : j + far - p + 1])
        p, q = next(apart, (len(x) - i, len(y) - j))
        cost += sum(max(len(u), len(v)) - 1 for u, v in zip(x[i : i + p], y[j : j + q], strict=True)) if p == q else max(sum(map(len, x[i : i + p])), sum(map(len, y[j : j + q])))
        if cost > most:
            return False
        i, j = i + p, j + q
    return True


def _letters(forms: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all forms, the form of each, its place in it."""
    size = np.array([len(x) for x in forms])
    form = np.repeat(np.arange(len(forms)), size)
    return np.frombuffer("".join(forms).encode("utf-32-le", "surrogatepass"), np.uint32), form, np.arange(len(form)) - np.repeat(np.cumsum(size) - size, size)


def _side_by_side(a: list[str], b: list[str], most: np.ndarray, words: int) -> np.ndarray:
    """Whether each a is within so many edits of its b: edit_distance() of all pairs at once, each in a field of one long number.

    A field has so many words of 64 bits, of which the highest bit stays free; the forms of b come longest first.
    """
    out = np.zeros(len(a), bool)
    points, form, place = _letters(a)
    others, other, behind = _letters(b)
    names = np.flatnonzero(np.bincount(points))
    # 0 are letters of no a
    code = np.zeros(int(max(points.max(), others.max())) + 1, np.int32)
    code[names] = np.arange(1, len(names) + 1)
    width = len(names) + 1
    equal = np.zeros((len(a) * width, words), np.uint64)
    order = np.argsort(place, kind="stable")
    ends = np.cumsum(np.bincount(place))
    for i, (low, high) in enumerate(zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)):
        now = order[low:high]
        equal[form[now] * width + code[points[now]], i >> 6] |= np.uint64(1 << (i & 63))
    text = np.zeros((len(b[0]), len(b)), np.int32)
    text[behind, other] = code[others]
    base = np.arange(len(a)) * width
    size, n, pair = np.array([len(x) for x in a]), np.array([len(x) for x in b]), np.arange(len(a))

    def fields(bits: list[int]) -> int:
        return int.from_bytes(b"".join(x.to_bytes(8 * words, "little") for x in bits), "little")

    def counted(x: int, k: int) -> np.ndarray:
        return np.bitwise_count(np.frombuffer(x.to_bytes(8 * words * k, "little"), np.uint64)).reshape(k, words).sum(axis=1, dtype=np.int64)

    k = len(a)
    mask, first = fields([(1 << x) - 1 for x in size.tolist()]), fields([1] * k)
    plus, minus, full = mask, 0, (1 << 64 * words * k) - 1
    for j in range(len(b[0])):
        if n[k - 1] <= j:
            # the last of them end here
            left, bits = int(np.searchsorted(-n, -j)), 64 * words
            out[pair[left:]] = j + counted(plus >> left * bits, k - left) - counted(minus >> left * bits, k - left) <= most[left:]
            plus, minus, mask, first, full = (x & ((1 << left * bits) - 1) for x in (plus, minus, mask, first, full))
            base, n, most, pair = (x[:left] for x in (base, n, most, pair))
            k = left
            if not k:
                return out
        if j % 32 == 0 and j:
            # each letter left brings it down by one at most
            stay = np.flatnonzero(j + counted(plus, k) - counted(minus, k) - (n - j) <= most)
            if 4 * len(stay) < 3 * k:
                plus, minus, mask, first = (np.frombuffer(x.to_bytes(8 * words * k, "little"), np.uint64).reshape(k, words)[stay] for x in (plus, minus, mask, first))
                plus, minus, mask, first = (int.from_bytes(x.tobytes(), "little") for x in (plus, minus, mask, first))
                text, (base, n, most, pair) = text[:, stay], (x[stay] for x in (base, n, most, pair))
                k = len(stay)
                full = (1 << 64 * words * k) - 1
                if not k:
                    return out
        # xor in place of ~ keeps the numbers positive, which is quicker
        eq = int.from_bytes(equal[base + text[j, :k]].tobytes(), "little")
        diagonal = (((eq & plus) + plus) ^ plus) | eq | minus
        up, down = minus | (diagonal | plus) & mask ^ mask, (plus & diagonal) << 1
        up = up << 1 | first
        plus, minus = (down | (diagonal | up) & full ^ full) & mask, up & diagonal & mask
    out[pair] = len(b[0]) + counted(plus, k) - counted(minus, k) <= most
    return out


class Alike:
    """Whether the edit distance of two normal forms is small enough."""

    def __init__(self, similarity: float) -> None:
        self.share = 1 - similarity

    def __call__(self, a: str, b: str) -> bool:
        return self.many([(a, b)])[0]

    def many(self, pairs: list[tuple[str, str]]) -> list[bool]:
        """The same for many pairs; those that are left after cheaper looks are compared side by side."""
        out = [False] * len(pairs)
        rest: dict[int, list[tuple[str, str, float, int]]] = {}
        for k, (a, b) in enumerate(pairs):
            most = self.share * max(len(a), len(b)) + 1e-9
            if abs(len(a) - len(b)) > most:
                continue
            a, b = _trimmed(a, b)
            a, b = (x[::-1] for x in _trimmed(a[::-1], b[::-1]))
            if max(len(a), len(b)) <= most:
                out[k] = True
            elif a and b:
                a, b = sorted((a, b), key=len)
                words = int(_WORD_STEPS[np.searchsorted(_WORD_STEPS, len(a) // 64 + 1)])
                rest.setdefault(words, []).append((a, b, most, k))
        for words, held in rest.items():
            held.sort(key=lambda x: -len(x[1]))
            while held:
                size = max(1, min(1024, ABREAST // max(64 * words, len(held[0][1]))))
                size = max(1, min(size, ABREAST // (words * len(set().union(*(x[0] for x in held[:size]))))))
                now, held = held[:size], held[size:]
                if len(now) < 3:
                    for a, b, most, k in now:
                        out[k] = _by_words(a, b, most) or edit_distance(a, b, most) <= most
                    continue
                found = _side_by_side([x[0] for x in now], [x[1] for x in now], np.array([x[2] for x in now]), words)
                for x, is_ in zip(now, found.tolist(), strict=True):
                    out[x[3]] = is_
        return out


def _as_it_is(form: str) -> str:
    return form


def _picked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The forms of the lines that are wanted of each text."""
    for batch in batches:
        nodes, raw = [], []
        for wanted, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            split = text.encode().split(b"\n")
            for w in wanted:
                nodes.append(w["node"])
                raw.append(split[w["number"]])
        lines = Lines(*tk.buffers(pa.array(raw, pa.binary())))
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), lines.forms()], ["node", "text"])


def repeated_lines(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row per row of docs: doc_id, n_lines (with words), removed (numbers of lines that repeat, from 0), row.

    The first occurrence of a group, by doc_id (null last) and number, stays. Lines without
    words are never removed; null or empty texts have no lines. Rows of one id and text
    are one document. Only doc_id and text are read. cleaned() gives the texts. similarity is 0.75 or more.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST))
    thin = docs.select(doc.alias("doc"), F.xxhash64(F.col("doc_id").cast("long"), text).alias("row"), text.alias("text"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = scratch.table(thin.mapInArrow(_lined(parts), _LINED))
    # lines post by the first half of their hash
    posts = scratch.table(rows.where("part IS NOT NULL").select("part", "tokens", "highs").repartition("part").select("tokens", "highs").mapInArrow(_met, "token long, node long, lead long, n long"))
    rows = rows.where("part IS NULL")
    lines = rows.select("doc", "row", F.explode(F.arrays_zip("number", "high", "low", "left", "right")).alias("x")).select("doc", "row", "x.*")
    distinct = lines.groupBy("high", "low").agg(F.min(F.struct("doc", "row", "number")).alias("place"), F.count("*").alias("n"), F.first("left").alias("left"), F.first("right").alias("right"))
    tiny = rows.where("size(tiny) > 0").select(F.explode(F.arrays_zip("tiny", "form")).alias("x")).select(F.col("x.tiny").alias("high"), F.lit(None).cast("long").alias("token"), F.col("x.form").alias("form"))
    keys = posts.select(F.col("node").alias("high"), "token", F.lit(None).cast("string").alias("form")).union(tiny.distinct())
    keys = keys.groupBy("high").agg(F.array_sort(F.collect_set("token")).alias("tokens"), F.max("form").alias("form"))
    # only lines that occur twice or meet another one; hashes of 128 bits tell forms apart, of those that share the first half one has its name
    nodes = distinct.join(keys, "high", "left").where("n > 1 OR tokens IS NOT NULL").withColumn("at", F.row_number().over(Window.partitionBy("high").orderBy("low")))
    nodes = nodes.select("high", "low", "place", "n", F.array("left", "right").alias("sketch"), F.expr("CASE WHEN at = 1 THEN tokens END").alias("tokens"), F.expr("CASE WHEN at = 1 THEN form END").alias("form"), F.expr("CASE WHEN at = 1 THEN high ELSE xxhash64(high, low) END").alias("node"))
    nodes = scratch.table(nodes)

    def texts_of(wanted: DataFrame) -> DataFrame:
        places = nodes.select("node", "place").join(wanted, "node", "left_semi")
        places = scratch.table(places.groupBy("place.doc", "place.row").agg(F.collect_list(F.struct("node", F.col("place.number").alias("number"))).alias("wanted")))
        texts = only(thin, places.select("row"), "row").dropDuplicates(["doc", "row"]).join(places, ["doc", "row"]).select("wanted", "text")
        return scratch.table(texts.mapInArrow(_picked, "node long, text string"))

    facts = nodes.where("size(tokens) > 0").select("node", "tokens", "sketch")
    links = linking.linked(facts, 2, DIFFER, texts_of, _as_it_is, Alike(similarity), posts=posts)
    found = graph.components(scratch.table(links.union(tiny_links(nodes.where("form IS NOT NULL"), similarity))))
    grouped = nodes.select("high", "low", "node", "place", "n").join(found, "node", "left").withColumn("group", F.coalesce("component", "node"))
    stay = grouped.groupBy("group").agg(F.min("place").alias("stay"), F.sum("n").alias("n")).where("n > 1")
    repeats = grouped.select("high", "low", "group").join(stay.select("group", "stay"), "group").select("high", "low", "stay")
    place = F.struct("doc", "row", F.col("x.number").alias("number"))
    lines = rows.select("doc", "row", F.explode(F.arrays_zip("number", "high", "low")).alias("x")).select("doc", "row", F.col("x.high").alias("high"), F.col("x.low").alias("low"), place.alias("place"))
    gone = lines.join(repeats, ["high", "low"]).where("place <> stay").groupBy("doc", "row").agg(F.array_sort(F.collect_set("place.number")).alias("removed"))
    out = rows.select("doc", "row", "n_lines").join(gone, ["doc", "row"], "left")
    return out.select(F.nullif("doc", F.lit(LAST)).alias("doc_id"), "n_lines", F.coalesce("removed", F.array().cast("array<int>")).alias("removed"), "row")


def cleaned(docs: DataFrame, found: DataFrame) -> DataFrame:
    """docs without the lines that repeated_lines() found in them."""
    key = F.xxhash64(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")))
    gone = found.select(F.col("row").alias("_row"), F.col("removed").alias("_removed")).dropDuplicates(["_row"])
    kept = F.array_join(F.filter(F.split("text", "\n", -1), lambda line, i: ~F.array_contains("_removed", i)), "\n")
    return docs.withColumn("_row", key).join(gone, "_row", "left").withColumn("text", F.when(F.size("_removed") > 0, kept).otherwise(F.col("text"))).select(*docs.columns)
