"""License scan: winnowed fingerprints pick candidates, banded alignment reports them.

Templates are cut into runs of GRAM words; of each WINDOW neighbouring runs the smallest
hash goes into an inverted index, so GRAM + WINDOW - 1 words in common always share an
entry. Hits of one template that lie near one diagonal are one candidate; a local
alignment in a band around the diagonal gives the words matched and their span.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveworks.llm import scratch
from sieveworks.llm import textkit as tk
from sieveworks.llm.decontaminate import Lookup, item_words

GRAM, WINDOW = 3, 2
COVERAGE = 0.75
#: Words of all templates at most; the index is sent to every executor.
INDEX_WORDS = 200_000

#: Fixed texts: notices and conditions as their licenses state them.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("warranty", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
)


class Index:
    """Fingerprints of templates (name, text)."""

    def __init__(self, templates: tuple[tuple[str, str], ...] = TEMPLATES) -> None:
        self.names = [n for n, _ in templates]
        self.words = [[w.encode() for w in item_words(t)] for _, t in templates]
        if sum(map(len, self.words)) > INDEX_WORDS:
            raise ValueError(f"templates of more than {INDEX_WORDS} words")
        entries: dict[int, list[tuple[int, int]]] = {}
        for t, words in enumerate(self.words):
            raw = b"".join(words)
            offsets = np.cumsum([0, *map(len, words)])
            hashes = tk.grams(tk.Words(np.frombuffer(raw, np.uint8), offsets, tk.ALNUM_WORDS).hashes(), GRAM)
            for i in winnowed(hashes, WINDOW):
                entries.setdefault(int(hashes[i]), []).append((t, i))
        self.lookup = Lookup(np.array(list(entries), dtype=np.uint64))
        self.places = [entries[int(v)] for v in self.lookup.values]

    def scan(self, data: np.ndarray, offsets: np.ndarray, coverage: float = COVERAGE) -> list[list[dict]]:
        words = tk.Words(tk.FOLD[data], offsets, tk.ALNUM_WORDS)
        at, entry = self.lookup.find(tk.grams(words.hashes(), GRAM))
        out: list[list[dict]] = [[] for _ in range(len(offsets) - 1)]
        text = np.searchsorted(words.first, at, "right") - 1
        whole = at + GRAM <= words.first[text + 1]
        at, entry, text = at[whole], entry[whole], text[whole]
        for d in np.unique(text).tolist():
            mine = np.flatnonzero(text == d) if len(text) < 64 else np.arange(*np.searchsorted(text, [d, d + 1]))
            hits: dict[int, list[tuple[int, int]]] = {}
            for pos, e in zip(at[mine].tolist(), entry[mine].tolist(), strict=True):
                for t, i in self.places[e]:
                    hits.setdefault(t, []).append((pos - i, pos))
            low, high = int(words.first[d]), int(words.first[d + 1])
            found = []
            for t, places in hits.items():
                template = self.words[t]
                band = max(2, len(template) // 10)
                places.sort()
                for group in _near(places, band):
                    middle = group[len(group) // 2]
                    a, b = max(low, middle - band), min(high, middle + len(template) + band)
                    tokens = [words.data[words.starts[i] : words.ends[i]].tobytes() for i in range(a, b)]
                    matched, first, last = aligned(template, tokens, middle - a, 2 * band)
                    if matched and matched >= coverage * len(template):
                        found.append((matched, matched / len(template), t, a + first, a + last))
            found.sort(key=lambda x: (-x[0], -x[1], x[2], x[3]))
            taken: list[tuple[int, int]] = []
            points = tk.code_points(data[offsets[d] : offsets[d + 1]])
            for _, share, t, first, last in found:
                if all(last < a or first > b for a, b in taken):
                    taken.append((first, last))
                    out[d].append({"license": self.names[t], "coverage": share, "start": int(points[words.starts[first] - offsets[d]]), "stop": int(points[words.ends[last] - offsets[d]])})
            out[d].sort(key=lambda x: x["start"])
        return out


def winnowed(hashes: np.ndarray, window: int) -> list[int]:
    """Places of the smallest hash of each window, the last one among equals."""
    chosen: list[int] = []
    for low in range(max(1, len(hashes) - window + 1)):
        part = hashes[low : low + window]
        if len(part) and (i := low + len(part) - 1 - int(np.argmin(part[::-1]))) not in chosen[-window:]:
            chosen.append(i)
    return chosen


def _near(places: list[tuple[int, int]], band: int) -> Iterator[list[int]]:
    """Groups of diagonals that lie within band of the one before."""
    group: list[int] = []
    for diagonal, _ in places:
        if group and diagonal - group[-1] > band:
            yield group
            group = []
        group.append(diagonal)
    if group:
        yield group


def aligned(template: list[bytes], tokens: list[bytes], shift: int, band: int) -> tuple[int, int, int]:
    """Best local alignment within band of the diagonal token = template + shift: words matched, first and last token."""
    best, end = (0, 0, 0), 0
    above: dict[int, tuple[int, int, int]] = {}  # token: score, matched, first token
    for i, word in enumerate(template):
        row: dict[int, tuple[int, int, int]] = {}
        for j in range(max(0, i + shift - band), min(len(tokens), i + shift + band + 1)):
            score, matched, first = above.get(j - 1, (0, 0, j))
            if not score:
                first = j
            cell = (score + 2, matched + 1, first) if tokens[j] == word else (score - 1, matched, first)
            up, left = above.get(j, (0, 0, j)), row.get(j - 1, (0, 0, j))
            cell = max(cell, (up[0] - 1, *up[1:]), (left[0] - 1, *left[1:]), key=lambda c: (c[0], c[1], -c[2]))
            if cell[0] > 0:
                row[j] = cell
                if (cell[1], cell[0]) > (best[1], best[0]):
                    best, end = cell, j
        above = row
    return best[1], best[2], end


_SPANS = "array<struct<license:string,coverage:double,start:bigint,stop:bigint>>"


def license_spans(docs: DataFrame, index: Index | None = None, coverage: float = COVERAGE) -> DataFrame:
    """docs with _licenses: license, matched share of its template, span in code points.

    Where candidates overlap, the one with more matched words stays. Null or empty texts
    have none. Only the text is read, so docs may have any other columns; repeated rows
    are scanned as they come.
    """
    shared = scratch.Shared(docs.sparkSession, index or Index())

    @F.arrow_udf(_SPANS)
    def find(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.list_(pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("start", pa.int64()), ("stop", pa.int64())]))
        for column in texts:
            data, offsets = tk.buffers(column)
            yield pa.array([x for _, _, part, at in tk.chunks(data, offsets) for x in shared.value.scan(part, at, coverage)], kind)

    return docs.withColumn("_licenses", find(F.col("text").cast("string")))
