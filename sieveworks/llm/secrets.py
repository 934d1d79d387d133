"""Secret scan: fixed patterns, and a linear-chain conditional random field over tokens.

The field tags every token as outside, begin or inside of a secret from its shape, its
neighbours and features of the file, and is decoded by Viterbi. It is trained here on
generated lines. Tokens whose margin for "outside" exceeds what any transition can win
back are outside on every best path, so only the runs between them are decoded; the
result is that of decoding whole texts.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveworks.llm import scratch
from sieveworks.llm import textkit as tk

OUT, BEGIN, INSIDE = 0, 1, 2
KINDS = ("assign", "access", "hex", "crf")
_ASSIGN = re.compile(rb"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_STARTS = (b"password", b"passwd", b"secret", b"token", b"api")
#: Words beside a token that speak for a secret.
CUES = ("password", "passwd", "pwd", "pass", "secret", "token", "apikey", "api_key", "key", "auth", "bearer", "credential", "credentials", "private", "access_key", "client_secret", "authorization")
#: Beginnings of tokens that well-known issuers give out.
ISSUED = ("AKIA", "ASIA", "ghp_", "gho_", "ghs_", "sk-", "sk_live_", "pk_live_", "xoxb-", "xoxp-", "glpat-", "eyJ", "AIza", "npm_", "hf_")

_TOKEN = tk._table([(0x00, 0x2A), (0x2C, 0x2C), (0x3A, 0x40), (0x5B, 0x5E), (0x60, 0x60), (0x7B, 0x7F)])
_CLASS = np.zeros(256, dtype=np.int64)  # 0 sign, 1 lower, 2 upper, 3 digit, 4 other letters
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 1, 2, 3, 4
_HEX = np.zeros(256, dtype=bool)
_HEX[48:58] = _HEX[97:103] = True
_LENGTHS = np.array([4, 8, 12, 16, 20, 24, 32, 48, 64])
FEATURES = (
    *(f"length<{n}" for n in _LENGTHS), "length>=64", "upper", "lower", "digit", "sign", "other letters", "upper+lower+digit", "digit+letter", "upper+digit only",
    "digits only", "letters only", "changes>=4", "changes>=8", "changes>=14", "long and changing", "issued prefix", "cue before", "cue two before", "cue after",
    "assigned", "quoted", "long after cue", "long assigned", "long issued", "file has key block", "file has assignments", "file is short", "long in key block", "bias",
)


def _column(values: list[np.ndarray]) -> np.ndarray:
    return np.stack(values, axis=1).astype(np.float32)


def _hash_of(word: str) -> int:
    raw = np.frombuffer(word.encode(), np.uint8)
    return int(tk.Words(raw, np.array([0, len(raw)]), np.ones(256, bool)).hashes()[0])


_CUES = np.sort(np.array([_hash_of(w) for w in CUES], dtype=np.uint64))


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[tk.Words, np.ndarray]:
    """Tokens of some texts, and a row of FEATURES for each."""
    tokens = tk.Words(data, offsets, _TOKEN)
    starts, ends = tokens.starts, tokens.ends
    n = len(starts)
    if not n:
        return tokens, np.zeros((0, len(FEATURES)), np.float32)
    kind = _CLASS[data]
    size = ends - starts
    has = []
    for c in (2, 1, 3, 0, 4):
        total = np.concatenate([[0], np.cumsum(kind == c)])
        has.append(total[ends] - total[starts])
    upper, lower, digit, sign, other = has
    turn = np.concatenate([[0, 0], np.cumsum(kind[1:] != kind[:-1])])
    changes = turn[ends] - turn[starts + 1]
    low = tk.FOLD[data]
    hashes = tk.Words(low, offsets, _TOKEN).hashes()
    at = np.searchsorted(_CUES, hashes)
    cue = _CUES[np.minimum(at, len(CUES) - 1)] == hashes
    text = tokens.text_of()

    def beside(flags: np.ndarray, by: int) -> np.ndarray:
        out = np.zeros(n, bool)
        if by > 0:
            out[by:] = flags[:-by] & (text[by:] == text[:-by])
        else:
            out[:by] = flags[-by:] & (text[:by] == text[-by:])
        return out

    padded = np.concatenate([data, np.zeros(24, np.uint8)])
    issued = np.zeros(n, bool)
    for prefix in ISSUED:
        match = np.flatnonzero(padded[starts] == ord(prefix[0]))
        for i, ch in enumerate(prefix[1:], 1):
            match = match[padded[starts[match] + i] == ord(ch)]
        issued[match] = True
    issued &= size >= 12
    before = [np.where(starts >= j, data[np.maximum(starts - j, 0)], 0) for j in (1, 2, 3)]
    quoted = (before[0] == 34) | (before[0] == 39)
    is_sign = [(b == 61) | (b == 58) for b in before]
    assigned = is_sign[0] | (is_sign[1] & (quoted | (before[0] == 32))) | (is_sign[2] & quoted & (before[1] == 32))
    block = np.zeros(len(offsets) - 1, bool)
    raw = data.tobytes()
    place = raw.find(b"PRIVATE KEY-----")
    while place >= 0:
        block[np.searchsorted(offsets, place, "right") - 1] = True
        place = raw.find(b"PRIVATE KEY-----", place + 1)
    equals = np.concatenate([[0], np.cumsum(data == 61)])
    many = (equals[offsets[1:]] - equals[offsets[:-1]]) >= 5
    short = np.diff(tokens.first) < 40
    long = (size >= 12) & (digit > 0) & (other == 0)
    bucket = np.searchsorted(_LENGTHS, size, "right")
    near = beside(cue, 1) | beside(cue, 2)
    return tokens, _column([
        *(bucket == i for i in range(len(_LENGTHS) + 1)), upper > 0, lower > 0, digit > 0, sign > 0, other > 0, (upper > 0) & (lower > 0) & (digit > 0), (digit > 0) & (upper + lower > 0), (upper > 0) & (digit > 0) & (upper + digit == size),
        digit == size, upper + lower + other == size, changes >= 4, changes >= 8, changes >= 14, long & (changes >= 4), issued, beside(cue, 1), beside(cue, 2), beside(cue, -1),
        assigned, quoted, long & near, long & assigned, long & issued, block[text], many[text], short[text], block[text] & (size >= 24), np.ones(n, bool),
    ])


def generated(n: int, seed: int) -> Iterator[tuple[str, list[int]]]:
    """Texts with the tags of their tokens: prose, settings and key blocks with and without secrets."""
    rng = np.random.default_rng(seed)
    pick = lambda s: s[int(rng.integers(len(s)))]
    make = lambda alphabet, size: "".join(alphabet[i] for i in rng.integers(len(alphabet), size=size))
    low, up, dig = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    word = lambda: make(low, int(rng.integers(2, 12)))
    harmless = (
        lambda: word(), lambda: word().capitalize(), lambda: make(dig, int(rng.integers(1, 17))), lambda: f"{word()}.{word()}.com", lambda: f"/{word()}/{word()}/{word()}.py", lambda: f"20{make(dig, 2)}-{make('01', 2)}-{make('012', 2)}",
        lambda: f"v{pick(dig)}.{pick(dig)}.{pick(dig)}", lambda: word() + "-" + word(), lambda: make(up, 4), lambda: f"{word()}_{word()}_{word()}", lambda: "é" + word(), lambda: word() + "ß" + word(), lambda: make(low, int(rng.integers(12, 40))), lambda: word().capitalize() + word().capitalize(),
    )
    secret = (
        lambda: "AKIA" + make(up + dig, 16), lambda: "ghp_" + make(low + up + dig, 36), lambda: "sk-" + make(low + up + dig, 48), lambda: "xoxb-" + make(dig, 12) + "-" + make(low + up + dig, 24), lambda: "eyJ" + make(low + up + dig, 30) + "." + make(low + up + dig + "_-", 60),
        lambda: "AIza" + make(low + up + dig + "_-", 35), lambda: make(low + up + dig, 32), lambda: make(low + up + dig + "+/", 40), lambda: make("0123456789abcdef", 40), lambda: make("0123456789abcdef", 18), lambda: make(low + up + dig + "_", 20),
    )
    for _ in range(n):
        parts: list[tuple[str, int]] = []  # text with what follows it, tag of its token or -1
        for _ in range(int(rng.integers(1, 5))):
            parts += [(pick(harmless)() + pick((" ", " ", " ", ", ", ".\n", ": ", "=")), OUT) for _ in range(int(rng.integers(3, 25)))]
            form = rng.random()
            if form < 0.35:
                cue = pick(CUES)
                parts += [(cue + pick(("=", " = ", ": ", '="', "='", ' = "', " ")), OUT), (pick(secret)() + pick((" ", '" ', "\n", "' ")), BEGIN)]
            elif form < 0.5:
                parts.append((pick(secret[:6])() + " ", BEGIN))
            elif form < 0.56:
                parts += [("-----BEGIN ", OUT), ("RSA ", OUT), ("PRIVATE ", OUT), ("KEY-----\n", OUT)]
                parts += [(make(low + up + dig + "+/", 64) + "\n", INSIDE if i else BEGIN) for i in range(int(rng.integers(2, 9)))]
                parts += [("-----END ", OUT), ("RSA ", OUT), ("PRIVATE ", OUT), ("KEY-----\n", OUT)]
            elif form < 0.66:
                parts += [(pick(("size", "count", "name", "path", "date", "url")) + pick(("=", ": ")), OUT), (pick(harmless)() + "\n", OUT)]
            elif form < 0.7:
                parts += [(pick(CUES) + pick((" ", ": ")), OUT), (word() + " ", OUT)]
        text, tags = "", []
        for piece, tag in parts:
            text += piece
            data = np.frombuffer(piece.encode(), np.uint8)
            tags += [tag] * len(tk.Words(data, np.array([0, len(data)]), _TOKEN).starts)
        data = np.frombuffer(text.encode(), np.uint8)
        if len(tk.Words(data, np.array([0, len(data)]), _TOKEN).starts) == len(tags):
            yield text, tags


class Field:
    """weights: features x tags; moves: tag to tag; begin: tag of a text's first token."""

    def __init__(self, weights: np.ndarray, moves: np.ndarray, begin: np.ndarray) -> None:
        self.weights, self.moves, self.begin = weights.astype(np.float32), moves, begin
        # most that any tag at one place can win over "outside" through its transitions
        froms = [*moves, begin]
        tos = [*moves.T, np.zeros(3)]
        self.reach = max(float(a[x] + b[x] - a[OUT] - b[OUT]) for a in froms for b in tos for x in (BEGIN, INSIDE))

    def best(self, scores: np.ndarray, first: bool) -> list[int]:
        """Viterbi tags of a run of tokens between outside ones; first: the text begins with it."""
        moves, path = self.moves.tolist(), []
        now = [s + b for s, b in zip(scores[0].tolist(), (self.begin if first else self.moves[OUT]).tolist(), strict=True)]
        for row in scores[1:].tolist():
            came = [max(range(3), key=lambda x: now[x] + moves[x][y]) for y in range(3)]
            now = [now[x] + moves[x][y] + row[y] for y, x in enumerate(came)]
            path.append(came)
        tag = max(range(3), key=lambda x: now[x] + moves[x][OUT])
        tags = [tag]
        for came in reversed(path):
            tags.append(tag := came[tag])
        return tags[::-1]

    def tag(self, tokens: tk.Words, rows: np.ndarray) -> list[tuple[int, int]]:
        """Spans of tagged secrets as first and last token."""
        scores = rows @ self.weights
        open_ = np.flatnonzero(scores[:, OUT] - scores[:, 1:].max(axis=1) <= self.reach)
        if not len(open_):
            return []
        text = np.searchsorted(tokens.first, open_, "right") - 1
        spans: list[tuple[int, int]] = []
        for run in np.split(np.arange(len(open_)), np.flatnonzero((np.diff(open_) > 1) | (np.diff(text) > 0)) + 1):
            low, high = int(open_[run[0]]), int(open_[run[-1]])
            begin = -1
            for i, tag in enumerate([*self.best(scores[low : high + 1], low == tokens.first[text[run[0]]]), OUT], low):
                if begin >= 0 and tag != INSIDE:
                    spans.append((begin, i - 1))
                    begin = -1
                if tag == BEGIN or tag == INSIDE and begin < 0:
                    begin = i
        return spans


@functools.cache
def trained(texts: int = 1500, rounds: int = 120, seed: int = 7) -> Field:
    """Maximum likelihood with a Gaussian prior, by gradient steps over all texts at once."""
    data = [(features(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]))[1], np.array(y)) for t, y in generated(texts, seed)]
    longest = max(len(y) for _, y in data)
    x = np.zeros((len(data), longest, len(FEATURES)), np.float32)
    y = np.zeros((len(data), longest), np.int64)
    live = np.zeros((len(data), longest), bool)
    for i, (rows, tags) in enumerate(data):
        x[i, : len(tags)], y[i, : len(tags)], live[i, : len(tags)] = rows, tags, True
    params = [np.zeros((len(FEATURES), 3)), np.zeros((3, 3)), np.zeros(3)]
    sums = [np.full_like(p, 1e-8) for p in params]
    one = np.eye(3)
    lse = lambda a, axis: (m := a.max(axis=axis)) + np.log(np.exp(a - np.expand_dims(m, axis)).sum(axis=axis))
    for _ in range(rounds):
        w, moves, begin = params
        s = x @ w.astype(np.float32)
        ahead, back = np.zeros_like(s, dtype=np.float64), np.zeros_like(s, dtype=np.float64)
        ahead[:, 0] = s[:, 0] + begin
        for t in range(1, longest):
            step = lse(ahead[:, t - 1, :, None] + moves, 1) + s[:, t]
            ahead[:, t] = np.where(live[:, t, None], step, ahead[:, t - 1])
        for t in range(longest - 2, -1, -1):
            step = lse(moves + (s[:, t + 1] + back[:, t + 1])[:, None, :], 2)
            back[:, t] = np.where(live[:, t + 1, None], step, 0)
        total = lse(ahead[:, -1], 1)
        prob = np.exp(ahead + back - total[:, None, None]) * live[..., None]
        pair = np.exp(ahead[:, :-1, :, None] + moves + (s[:, 1:] + back[:, 1:])[:, :, None, :] - total[:, None, None, None]) * live[:, 1:, None, None]
        truth = one[y] * live[..., None]
        both = np.zeros((3, 3))
        np.add.at(both, (y[:, :-1][live[:, 1:]], y[:, 1:][live[:, 1:]]), 1)
        grads = [np.einsum("ntf,nty->fy", x, truth - prob) - 0.1 * w, both - pair.sum(axis=(0, 1)) - 0.1 * moves, (truth - prob)[:, 0].sum(axis=0) - 0.1 * begin]
        for p, g, total_ in zip(params, grads, sums, strict=True):
            total_ += g * g
            p += 0.7 * g / np.sqrt(total_)
    return Field(*params)


def base_spans(raw: bytes) -> list[tuple[str, int, int]]:
    """Spans of the fixed patterns in bytes: kind, start, end."""
    out = []
    if any(word in (low := raw.lower()) for word in _STARTS) and (b"=" in low or b":" in low):
        out += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(raw) if len(m[2]) >= 12]
    if b"AKIA" in raw:
        out += [("access", m.start(), m.end()) for m in _ACCESS.finditer(raw) if m.end() - m.start() >= 18]
    return out


def scan(data: np.ndarray, offsets: np.ndarray, field: Field) -> list[list[tuple[int, int, int]]]:
    """Of each text: (start, kind, end) in code points, by start and then kind."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(len(offsets) - 1)]
    found: list[list[tuple[int, int, int]]] = [[] for _ in range(len(offsets) - 1)]
    raw = data.tobytes()
    low = raw.lower()
    texts = set()
    for word in (*_STARTS, b"akia"):
        at = low.find(word)
        while at >= 0:
            d = int(np.searchsorted(offsets, at, "right")) - 1
            texts.add(d)
            at = low.find(word, int(offsets[d + 1]) - len(word) + 1) if at + len(word) <= offsets[d + 1] else low.find(word, at + 1)
    for d in texts:
        a = int(offsets[d])
        found[d] += [(s, KINDS.index(k), e) for k, s, e in base_spans(raw[a : int(offsets[d + 1])])]
    runs = tk.Words(data, offsets, _HEX)
    long = np.flatnonzero(runs.ends - runs.starts >= 16)
    for s, e in zip(runs.starts[long].tolist(), runs.ends[long].tolist(), strict=True):
        d = int(np.searchsorted(offsets, s, "right")) - 1
        found[d].append((s - int(offsets[d]), 2, e - int(offsets[d])))
    tokens, rows = features(data, offsets)
    for first, last in field.tag(tokens, rows):
        s, e = int(tokens.starts[first]), int(tokens.ends[last])
        d = int(np.searchsorted(offsets, s, "right")) - 1
        found[d].append((s - int(offsets[d]), 3, e - int(offsets[d])))
    for d, spans in enumerate(found):
        if spans:
            points = tk.code_points(data[offsets[d] : offsets[d + 1]])
            out[d] = sorted((int(points[s]), k, int(points[e])) for s, k, e in spans)
    return out


_SPANS = "array<struct<kind:string,start:bigint,stop:bigint>>"


def secret_spans(docs: DataFrame, text: Column | None = None, field: Field | None = None) -> DataFrame:
    """docs with a column _spans: kind, start, stop in code points, by start and then kind.

    Null or empty texts have no spans. Only the text is read, so docs may have any other
    columns; repeated rows are scanned as they come.
    """
    shared = scratch.Shared(docs.sparkSession, field or trained())

    @F.arrow_udf(_SPANS)
    def find(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64())]))
        for column in texts:
            data, offsets = tk.buffers(column)
            spans = [[{"kind": KINDS[k], "start": s, "stop": e} for s, k, e in x] for _, _, part, at in tk.chunks(data, offsets, 1 << 18) for x in scan(part, at, shared.value)]
            yield pa.array(spans, kind)

    return docs.withColumn("_spans", find((F.col("text") if text is None else text).cast("string")))
