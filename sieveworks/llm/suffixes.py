"""Removal of repeated byte strings by a hash-compared suffix sort.

A string of WIDTH bytes is filed under the smallest hash among the grams inside it, so
equal strings meet wherever they stand. Runs of strings with one such key form a block.
Three steps, each with whole texts dealt into batches of bounded size:

1. Every text sends its distinct keys, cut to 32 bits besides their bucket, with 15 bits
   of each block's hash; keys seen in two texts or more survive (with rare others, which do
   no harm), and those of CROWD blocks or more are marked.
2. Blocks of surviving keys are sent once per batch with the smallest document that
   holds them, each key to one task. Blocks of a marked key, which many documents put into
   different surroundings, are taken apart, and their strings are dealt to all tasks.
   Where a key has several different blocks, their suffixes are dealt by
   their first eight bytes and sorted by mergesort; two suffixes are compared through prefix hashes and binary search for
   their common extension, and neighbours that agree are verified byte by byte.
   Each string learns the smallest document in which it starts.
3. The answers go back to the batches, which mark the bytes covered by strings that
   start in a smaller document.

A passage that a third of all documents share costs one row per batch, not per document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveworks.llm import textkit as tk

WIDTH = 50
GRAM = 24
#: Bytes of text in a batch; larger inputs get more batches.
BATCH_BYTES = 8 << 20
#: Bytes of one text that are looked at together.
PIECE = 1 << 20
#: Different blocks of a key (a long one counts for each span of strings) from which on its strings are dealt to all tasks.
CROWD = 4096
#: Marks a string that was taken out of its block.
ALONE = 2
_LANES = tk.mix(np.arange(1, 9, dtype=np.uint64)) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_DOWN = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
NO_ID = np.iinfo(np.int64).max
_U = np.uint64


def keyed(data: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, tk.Prefix]:
    """Key of the string at each start, and the prefix hashes of data."""
    c = tk.Prefix(data)
    if len(data) < width:
        return np.zeros(0, _U), c
    # any mixture of the gram's bytes serves: what collides here is told apart later
    eight = np.ndarray(len(data) - 7, "<u8", np.ascontiguousarray(data), strides=(1,))
    n = len(data) - gram + 1
    low = np.zeros(n, _U)
    for i, at in enumerate([*range(0, gram - 8, 8), gram - 8]):
        low += eight[at : at + n] * _LANES[i % len(_LANES)]
        low ^= low >> _U(29)
    low = tk.mix(low)
    span, have = width - gram + 1, 1
    while 2 * have <= span:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    return (np.minimum(low[: len(low) - (span - have)], low[span - have :]) if span > have else low), c


def pieces(offsets: np.ndarray, width: int) -> Iterator[tuple[int, int, list[tuple[int, int, int]]]]:
    """Byte ranges to look at together, each with its (text, start, stop) parts."""
    row, n = 0, len(offsets) - 1
    while row < n:
        low, high = int(offsets[row]), int(offsets[row + 1])
        if high - low > PIECE:
            for at in range(low, high - width + 1, PIECE):
                yield at, min(high, at + PIECE + width - 1), [(row, at, min(high, at + PIECE + width - 1))]
            row += 1
            continue
        parts = []
        while row < n and offsets[row + 1] - low <= PIECE:
            if offsets[row + 1] - offsets[row] >= width:
                parts.append((row, int(offsets[row]), int(offsets[row + 1])))
            row += 1
        if parts:
            yield low, int(offsets[row]), parts


class Runs:
    """Blocks of one piece: text, first start, last start (all absolute), key, hash."""

    def __init__(self, data: np.ndarray, low: int, high: int, parts: list[tuple[int, int, int]], width: int, gram: int) -> None:
        keys, c = keyed(data[low:high], width, gram)
        self.c, self.low, self.width = c, low, width
        valid, fresh = np.zeros(len(keys), bool), np.zeros(len(keys) + 1, bool)
        for _, a, b in parts:
            valid[a - low : b - low - width + 1] = True
            fresh[a - low] = True
        fresh[1:-1] |= keys[1:] != keys[:-1]
        begin = np.flatnonzero(fresh[:-1] & valid)
        closed = np.append(fresh[1:-1] | ~valid[1:], True) & valid
        last = np.flatnonzero(closed)
        self.key = keys[begin]
        self.text = np.array([p[0] for p in parts])[np.searchsorted([p[1] - low for p in parts], begin, "right") - 1]
        self.hash = c.of(begin, last + width)
        self.begin, self.last = begin + low, last + low

    def split(self, crowded: np.ndarray) -> int:
        """Takes these blocks apart into their strings, behind all others; where these begin."""
        rest, taken = np.flatnonzero(~crowded), np.flatnonzero(crowded)
        size = (self.last - self.begin + 1)[taken]
        of = np.repeat(taken, size)
        at = self.begin[of] + np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size)
        hash_ = self.c.of(at - self.low, at - self.low + self.width)
        self.key, self.text = (np.concatenate([x[rest], x[of]]) for x in (self.key, self.text))
        self.begin, self.last, self.hash = (np.concatenate([x[rest], y]) for x, y in ((self.begin, at), (self.last, at), (self.hash, hash_)))
        return len(rest)


def sort_suffixes(data: np.ndarray, starts: np.ndarray, group: np.ndarray, width: int) -> np.ndarray:
    """Order of the suffixes at starts within each group, by their first width bytes.

    group ascends. Merges run level by level over all groups at once; each element finds
    its rank in the run beside its own by binary search.
    """
    n = len(starts)
    # at most width bytes are compared: far too few for strings built to collide modulo 2**64
    up, down = (np.multiply.accumulate(np.append(_U(1), np.full(len(data), base, _U))) for base in (_BASE, _BASE_DOWN))
    c = np.concatenate([np.zeros(1, _U), np.cumsum((data.astype(_U) + _U(1)) * up[: len(data)])])

    def extension(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Common bytes of the suffixes at i and j, at most width."""
        lcp, step = np.zeros(len(i), np.int64), 1 << (width.bit_length() - 1)
        while step:
            more = lcp + step
            fits = np.flatnonzero(more <= width)
            a, b, m = i[fits], j[fits], more[fits]
            same = (c[a + m] - c[a]) * down[a] == (c[b + m] - c[b]) * down[b]
            lcp[fits[same]] = m[same]
            step >>= 1
        return lcp

    def before(i: np.ndarray, j: np.ndarray, ties: np.ndarray) -> np.ndarray:
        """Suffix at i sorts before that at j; equal ones do where ties is set."""
        lcp = extension(i, j)
        whole = lcp >= width
        at = np.minimum(lcp, width - 1)
        return np.where(whole, ties, data[i + at] < data[j + at])

    first = np.searchsorted(group, group, "left")
    size = np.searchsorted(group, group, "right") - first
    order, local, w = np.arange(n), np.arange(n) - first, 1
    while w < (size.max() if n else 0):
        base = first + local // (2 * w) * (2 * w)
        middle = np.minimum(base + w, first + size)
        end = np.minimum(base + 2 * w, first + size)
        at = first + local
        left = at < middle
        low, high = np.where(left, middle, base), np.where(left, end, middle)
        origin = low.copy()
        mine = starts[order]
        while True:
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                break
            probe = (low[open_] + high[open_]) // 2
            # the left run's element goes first among equals
            ahead = before(mine[probe], mine[open_], ~left[open_])
            low[open_] = np.where(ahead, probe + 1, low[open_])
            high[open_] = np.where(ahead, high[open_], probe)
        to = at - np.where(left, 0, middle - base) + (low - origin)
        merged = np.empty(n, order.dtype)
        merged[to] = order
        order = merged
        w *= 2
    return order


def smallest_holders(blocks: list[bytes], holders: np.ndarray, group: np.ndarray, width: int) -> list[np.ndarray]:
    """For each block, of each string in it: the smallest holder of any block of the group with that string."""
    data = np.frombuffer(b"".join(blocks), np.uint8)
    sizes = np.array([len(b) for b in blocks])
    counts = sizes - width + 1
    base = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    which = np.repeat(np.arange(len(blocks)), counts)
    edges = np.concatenate([[0], np.cumsum(counts)])
    starts = np.arange(edges[-1]) - edges[which] + base[which]
    head = np.zeros(len(starts), _U)
    for i in range(min(8, width)):
        head = head << _U(8) | data[starts + i].astype(_U)
    order = np.lexsort((head, group[which]))
    fresh = np.append(True, (head[order][1:] != head[order][:-1]) | (np.diff(group[which[order]]) != 0))
    class_ = np.cumsum(fresh)
    shared = np.flatnonzero(~(fresh & np.append(fresh[1:], True)))
    order[shared] = order[shared][sort_suffixes(data, starts[order[shared]], class_[shared], width)]
    same = np.zeros(len(order), bool)
    reach = np.arange(width)
    second = shared[1:][(class_[shared[1:]] == class_[shared[:-1]])]
    for low in range(0, len(second), 1 << 16):
        at = second[low : low + (1 << 16)]
        same[at] = (data[starts[order[at - 1]][:, None] + reach] == data[starts[order[at]][:, None] + reach]).all(axis=1)
    run = np.flatnonzero(~same)
    least = np.minimum.reduceat(holders[which[order]], run)
    out = np.empty(len(order), np.int64)
    out[order] = np.repeat(least, np.diff(np.append(run, len(order))))
    return [out[edges[i] : edges[i + 1]] for i in range(len(blocks))]


def _codes(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket and tag (bits 8 to 39) of each key."""
    return (keys % _U(buckets)) << _U(32) | _tags(keys)


def _tags(keys: np.ndarray) -> np.ndarray:
    return keys >> _U(8) & _U((1 << 32) - 1)


def _packed(tags: np.ndarray, prints: np.ndarray) -> np.ndarray:
    """Six bytes each: tag and print."""
    out = np.empty((len(tags), 6), np.uint8)
    out[:, :4] = tags.astype("<u4").view(np.uint8).reshape(-1, 4)
    out[:, 4:] = prints.astype("<u2").view(np.uint8).reshape(-1, 2)
    return out


def _unpacked(blob: bytes) -> np.ndarray:
    """Tag and print in one number."""
    raw = np.frombuffer(blob, np.uint8).reshape(-1, 6)
    tag, print_ = np.ascontiguousarray(raw[:, :4]).view("<u4")[:, 0], np.ascontiguousarray(raw[:, 4:]).view("<u2")[:, 0]
    return tag.astype(_U) << _U(16) | print_.astype(_U)


def _send_keys(buckets: int, width: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            data, offsets = tk.buffers(rows.column(1))
            owner = rows.column(2).to_numpy()
            found: list[np.ndarray] = []
            prints: list[np.ndarray] = []
            owners: list[np.ndarray] = []
            for low, high, parts in pieces(offsets, width):
                runs = Runs(data, low, high, parts, width, gram)
                if not len(runs.key):
                    continue
                # each key and print once per text; the lowest bit marks the text's first of a key
                times = (runs.last - runs.begin) // (width - gram + 1) + 1
                row = np.repeat(np.arange(len(times)), times)
                print_ = tk.mix(runs.hash[row] + (np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)).astype(_U)) >> _U(49)
                key, text = runs.key[row], runs.text[row]
                at = np.lexsort((print_, key, text))
                key, text, print_ = key[at], text[at], print_[at]
                first = np.append(True, (key[1:] != key[:-1]) | (text[1:] != text[:-1]))
                new = first | np.append(True, print_[1:] != print_[:-1])
                found.append(key[new])
                prints.append((print_ << _U(1) | first.astype(_U))[new].astype(np.uint16))
                owners.append(owner[text[new]])
            if not found:
                continue
            keys, print_, own = np.concatenate(found), np.concatenate(prints), np.concatenate(owners)
            bucket = (keys % _U(buckets)).astype(np.int64)
            order = np.lexsort((bucket, own))
            keys, print_, own, bucket = keys[order], print_[order], own[order], bucket[order]
            cut = np.flatnonzero(np.append(True, (own[1:] != own[:-1]) | (bucket[1:] != bucket[:-1])))
            blobs = [k.tobytes() for k in np.split(_packed(_tags(keys), print_), cut[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(bucket[cut], pa.int64()), pa.array(own[cut], pa.int64()), pa.array(blobs, pa.binary())], ["bucket", "batch", "blob"])

    return run


def _survive(crowd: int):
    def run(table: pa.Table) -> pa.Table:
        blobs = [_unpacked(b) for b in table.column("blob").to_pylist()]
        words = np.concatenate(blobs)
        batch = np.repeat(table.column("batch").to_numpy(), [len(b) for b in blobs])
        order = np.argsort(words, kind="stable")
        words, batch = words[order], batch[order]
        keys = words >> _U(16)
        begin = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        # entries ascend by print within a key
        different = np.append(True, words[1:] >> _U(1) != words[:-1] >> _U(1))
        texts, prints = (np.add.reduceat(x, begin, dtype=np.int64) for x in (words & _U(1), different))
        size = np.diff(np.append(begin, len(keys)))
        seen, crowded = np.repeat(texts > 1, size), np.repeat(prints >= crowd, size)
        keys, batch, crowded = keys[seen], batch[seen], crowded[seen]
        order = np.lexsort((keys, batch))
        keys, batch, crowded = keys[order], batch[order], crowded[order]
        keep = np.append(True, (keys[1:] != keys[:-1]) | (batch[1:] != batch[:-1])) if len(keys) else np.zeros(0, bool)
        keys, batch, crowded = keys[keep].astype(np.uint32), batch[keep], crowded[keep]
        cut = np.flatnonzero(np.append(True, batch[1:] != batch[:-1])) if len(keys) else np.zeros(0, np.int64)
        split = [(k.tobytes(), k[c].tobytes()) for k, c in zip(np.split(keys, cut[1:]), np.split(crowded, cut[1:]), strict=True)] if len(cut) else []
        bucket = table.column("bucket")[0].as_py()
        blob, marked = (pa.array([x[i] for x in split], pa.binary()) for i in (0, 1))
        return pa.table({"batch": pa.array(batch[cut], pa.int64()), "bucket": pa.array([bucket] * len(cut), pa.int64()), "blob": blob, "crowd": marked})

    return run


def _ids(docs: pa.Table) -> np.ndarray:
    return docs.column("doc_id").combine_chunks().fill_null(NO_ID).to_numpy()


def _once(data: np.ndarray, found: list[tuple[np.ndarray, ...]], width: int) -> tuple[np.ndarray, ...]:
    """Of strings (hash, start, key, document) each once: hash, start, key, smallest document, whether there is another."""
    if not found:
        return np.zeros(0, _U), np.zeros(0, np.int64), np.zeros(0, _U), np.zeros(0, np.int64), np.zeros(0, np.int8)
    hash_, start, key, doc = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(hash_, kind="stable")
    hash_, start, key, doc = hash_[order], start[order], key[order], doc[order]
    same = np.append(False, hash_[1:] == hash_[:-1])
    at, reach = np.flatnonzero(same), np.arange(width)
    for low in range(0, len(at), 1 << 15):
        part = at[low : low + (1 << 15)]
        same[part] = (data[start[part - 1][:, None] + reach] == data[start[part][:, None] + reach]).all(axis=1)
    begin = np.flatnonzero(~same)
    least = np.minimum.reduceat(doc, begin)
    return hash_[begin], start[begin], key[begin], least, (np.maximum.reduceat(doc, begin) != least).astype(np.int8)


def _send_blocks(buckets: int, width: int, gram: int):
    def coded(answers: pa.Table, column: str) -> np.ndarray:
        blobs = zip(answers.column("bucket").to_pylist(), answers.column(column).to_pylist(), strict=True)
        return np.unique(np.concatenate([np.frombuffer(b, "<u4").astype(_U) | _U(bucket) << _U(32) for bucket, b in blobs]))

    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        empty = pa.table({"bucket": pa.array([], pa.int64()), "batch": pa.array([], pa.int64()), "blob": pa.array([], pa.binary())})
        if not answers.num_rows or not docs.num_rows:
            return empty
        table, crowd = coded(answers, "blob"), coded(answers, "crowd")
        data, offsets = tk.buffers(docs.column("text"))
        ids = _ids(docs)
        held: dict[bytes, list] = {}  # block: key, smallest document, whether there is another
        single: list[tuple[np.ndarray, ...]] = []  # strings of crowded keys: hash, start, key, document
        for low, high, parts in pieces(offsets, width):
            runs = Runs(data, low, high, parts, width, gram)
            codes = _codes(runs.key, buckets)
            at = np.searchsorted(table, codes)
            at[at == len(table)] = 0
            good = table[at] == codes
            if len(crowd) and (crowded := np.isin(codes, crowd)).any():
                good = good[~crowded]
                n = runs.split(crowded)
                single.append((runs.hash[n:], runs.begin[n:], runs.key[n:], ids[runs.text[n:]]))
            good = np.flatnonzero(good)
            raw = data[low:high].tobytes()
            for a, b, key, doc in zip((runs.begin[good] - low).tolist(), (runs.last[good] - low + width).tolist(), runs.key[good].tolist(), ids[runs.text[good]].tolist(), strict=True):
                entry = held.get(block := raw[a:b])
                if entry is None:
                    held[block] = [key, doc, 0]
                elif entry[1] != doc:
                    entry[1], entry[2] = min(doc, entry[1]), 1
        blocks = list(held)
        facts = list(held.values())
        prints, start, own_key, own_low, own_more = _once(data, single, width)
        keys = np.append(np.array([f[0] for f in facts], dtype=_U), own_key)
        bucket = (np.append(keys[: len(blocks)], prints) % _U(buckets)).astype(np.int64)
        low_doc, more = np.append(np.array([f[1] for f in facts], dtype=np.int64), own_low), np.append(np.array([f[2] for f in facts], dtype=np.int8), own_more | np.int8(ALONE))
        size = np.array([*map(len, blocks)] + [width] * len(start), dtype=np.int32)
        order = np.argsort(bucket, kind="stable")
        cut = np.flatnonzero(np.append(True, np.diff(bucket[order]) != 0)) if len(order) else np.zeros(0, np.int64)
        out = []
        for part in np.split(order, cut[1:]) if len(cut) else []:
            arrays = [np.int64(len(part)).tobytes(), keys[part].tobytes(), low_doc[part].tobytes(), more[part].tobytes(), size[part].tobytes()]
            n = np.searchsorted(part, len(blocks))
            tail = b"".join(blocks[i] for i in part[:n].tolist())
            whole = b"".join([*arrays, tail, data[start[part[n:] - len(blocks)][:, None] + np.arange(width)].tobytes()])
            out.append(np.int64(len(whole)).tobytes() + pa.compress(whole, codec="zstd", asbytes=True))
        batch = docs.column("batch")[0].as_py()
        return pa.table({"bucket": pa.array(bucket[order][cut], pa.int64()), "batch": pa.array([batch] * len(cut), pa.int64()), "blob": pa.array(out, pa.binary())})

    return run


def _decide(width: int):
    def run(table: pa.Table) -> pa.Table:
        of: dict[bytes, list] = {}  # block: key, smallest document, whether others hold it, batches
        for batch, blob in zip(table.column("batch").to_pylist(), table.column("blob").to_pylist(), strict=True):
            raw = pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True)
            n = int.from_bytes(raw[:8], "little")
            at = 8
            arrays = []
            for kind in (np.uint64, np.int64, np.int8, np.int32):
                step = n * np.dtype(kind).itemsize
                arrays.append(np.frombuffer(raw[at : at + step], kind))
                at += step
            for key, doc, more, size in zip(*(a.tolist() for a in arrays), strict=True):
                entry = of.get(block := raw[at : at + size])
                at += size
                if entry is None:
                    of[block] = [key, doc, more, [batch]]
                else:
                    entry[2] |= 1
                    entry[1] = min(entry[1], doc)
                    entry[3].append(batch)
        groups: dict[int, list[bytes]] = {}
        for block, entry in of.items():
            groups.setdefault(entry[0], []).append(block)
        least: dict[bytes, np.ndarray] = {}
        mixed: list[list[bytes]] = []
        size = 0
        for group in [*(v for v in groups.values() if len(v) > 1), None]:
            if mixed and (group is None or size > PIECE >> 2):
                blocks = [b for v in mixed for b in v]
                holders = np.array([of[b][1] for b in blocks], dtype=np.int64)
                least |= zip(blocks, smallest_holders(blocks, holders, np.repeat(np.arange(len(mixed)), [len(v) for v in mixed]), width), strict=True)
                mixed, size = [], 0
            if group is not None:
                mixed.append(group)
                size += sum(map(len, group))
        del groups
        parts: list[np.ndarray] = []  # batch, row of the block, start, stop, document
        rows: list[tuple[int, int, int, int, int]] = []
        keys, alone = [], []
        sizes = np.cumsum([0, *(len(b) for b in of)])
        prints = tk.Prefix(np.frombuffer(b"".join(of), np.uint8)).of(sizes[:-1], sizes[1:])
        for i, (block, (key, doc, more, batches)) in enumerate(of.items()):
            keys.append(key)
            alone.append(more & ALONE)
            found = least.get(block)
            if found is None:
                ranges = [(0, len(block) - width + 1, doc)] if more & 1 else []
            else:
                cut = np.append(np.flatnonzero(np.append(True, found[1:] != found[:-1])), len(found)).tolist()
                ranges = [(a, b, int(found[a])) for a, b in zip(cut, cut[1:], strict=False)]
                if not more & 1:  # its only holder learns nothing from itself
                    ranges = [r for r in ranges if r[2] < doc]
            rows += [(batch, i, a, b, low) for batch in batches for a, b, low in ranges]
            if len(rows) > 50_000:
                parts.append(np.array(rows, dtype=np.int64))
                rows = []
        packed = np.concatenate([*parts, np.array(rows, dtype=np.int64).reshape(-1, 5)])
        packed = packed[np.argsort(packed[:, 0], kind="stable")]
        named, alone_ = np.array(keys, dtype=_U), np.array(alone, dtype=np.int8)
        cut = np.flatnonzero(np.append(True, np.diff(packed[:, 0]) != 0)) if len(packed) else np.zeros(0, np.int64)
        out = []
        for part in np.split(packed, cut[1:]) if len(cut) else []:
            fields = [named[part[:, 1]], prints[part[:, 1]], part[:, 4].astype(np.int64), part[:, 2].astype(np.int32), part[:, 3].astype(np.int32), alone_[part[:, 1]]]
            whole = np.int64(len(part)).tobytes() + b"".join(np.ascontiguousarray(f).tobytes() for f in fields)
            out.append(np.int64(len(whole)).tobytes() + pa.compress(whole, codec="zstd", asbytes=True))
        return pa.table({"batch": pa.array(packed[cut, 0] if len(cut) else [], pa.int64()), "blob": pa.array(out, pa.binary())})

    return run


def _answers(blobs: list[bytes]) -> list[np.ndarray]:
    """Key, print, smallest document, first and last start of each range, and whether it is a string alone, by print."""
    kinds = (np.uint64, np.uint64, np.int64, np.int32, np.int32, np.int8)
    all_: list[list[np.ndarray]] = [[np.zeros(0, k)] for k in kinds]
    for blob in blobs:
        raw = pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True)
        n, at = int.from_bytes(raw[:8], "little"), 8
        for i, kind in enumerate(kinds):
            step = n * np.dtype(kind).itemsize
            all_[i].append(np.frombuffer(raw[at : at + step], kind))
            at += step
    whole = [np.concatenate(x) for x in all_]
    order = np.argsort(whole[1], kind="stable")
    return [x[order] for x in whole]


def _finish(width: int, gram: int, with_kept: bool):
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        key, print_, least, start, stop, alone = _answers(answers.column("blob").to_pylist())
        crowd = np.unique(key[alone != 0])
        data, offsets = tk.buffers(docs.column("text"))
        ids = _ids(docs)
        delta = np.zeros(len(data) + 1, np.int32)
        for low, high, parts in pieces(offsets, width) if len(print_) else ():
            runs = Runs(data, low, high, parts, width, gram)
            if len(crowd):
                runs.split(np.isin(runs.key, crowd))
            a, b = np.searchsorted(print_, runs.hash, "left"), np.searchsorted(print_, runs.hash, "right")
            hit = np.flatnonzero(b > a)
            times = (b - a)[hit]
            row = np.repeat(a[hit], times) + (np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times))
            which = np.repeat(hit, times)
            good = (key[row] == runs.key[which]) & (least[row] < ids[runs.text[which]])
            row, which = row[good], which[good]
            np.add.at(delta, runs.begin[which] + start[row], 1)
            np.add.at(delta, runs.begin[which] + stop[row] - 1 + width, -1)
        gone = np.cumsum(delta[:-1]) > 0
        spans, hashes, kept = [], [], []
        for i in range(len(ids)):
            low, high = offsets[i], offsets[i + 1]
            mask = gone[low:high]
            edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]])))
            spans.append([{"start": int(x), "stop": int(y)} for x, y in zip(edge[::2], edge[1::2], strict=True)])
            rest = data[low:high][~mask].tobytes() if len(edge) else data[low:high].tobytes()
            hashes.append(hashlib.sha256(rest).hexdigest())
            kept.append(rest if with_kept else None)
        out = {"doc_id": docs.column("doc_id"), "n_bytes": pa.array(np.diff(offsets), pa.int64()), "spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), "kept_sha256": pa.array(hashes, pa.string())}
        return pa.table(out | ({"kept": pa.array(kept, pa.binary())} if with_kept else {}))

    return run


def repeats(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, with_kept: bool = False, batch_bytes: int = BATCH_BYTES, crowd: int = CROWD) -> DataFrame:
    """doc_id, n_bytes, spans of removed bytes (maximal), kept_sha256, and kept (bytes) on request.

    Null or empty texts have no bytes. A null doc_id counts as larger than all others, and
    rows with one doc_id are one document: nothing is removed for a repeat within it. Only
    doc_id and text are read.
    """
    thin = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    total = thin.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = int(max(8, -(-total // batch_bytes)))
    dealt = thin.withColumn("batch", F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(n))).repartition(n, "batch")
    keys = dealt.mapInArrow(_send_keys(n, width, gram), "bucket long, batch long, blob binary")
    alive = keys.repartition(n, "bucket").groupBy("bucket").applyInArrow(_survive(crowd), "batch long, bucket long, blob binary, crowd binary").repartition(n, "batch")
    blocks = dealt.groupBy("batch").cogroup(alive.groupBy("batch")).applyInArrow(_send_blocks(n, width, gram), "bucket long, batch long, blob binary")
    told = blocks.repartition(n, "bucket").groupBy("bucket").applyInArrow(_decide(width), "batch long, blob binary").repartition(n, "batch")
    kind = "doc_id long, n_bytes long, spans array<struct<start:bigint,stop:bigint>>, kept_sha256 string" + ", kept binary" * with_kept
    return dealt.groupBy("batch").cogroup(told.groupBy("batch")).applyInArrow(_finish(width, gram, with_kept), kind)
