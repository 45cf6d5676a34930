"""License scans: winnowed fingerprints of templates, then banded alignment.

Runs of k words of each template are hashed and winnowed (the least hash of each window of
w); an inverted index maps these fingerprints to templates and positions. A document's runs
are looked up in it, which gives candidates and the diagonals on which to align. Banded
local alignment of words then reports how much of the template is matched, and where.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from gridloom.llm.base import LOWER, ByteHash, Piece, mix, pieces, arrow

# Notices and short license texts, as published.
TEMPLATES: dict[str, str] = {
    "mit-notice": "Released under the MIT License.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "mit": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "isc": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "bsd-2-clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.""",
    "apache-2.0-header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "gpl-header": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
    "mpl-2.0-header": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
}

_C = np.uint64(0x9E3779B97F4A7C15)
_WORD = np.zeros(256, bool)
_WORD[np.r_[48:58, 65:91, 97:123, 128:256]] = True


@dataclass(frozen=True)
class LicenseParams:
    """gram: words a fingerprint covers; window: of the winnowing; least: reported coverage."""

    gram: int = 3
    window: int = 4
    short: int = 12  # templates of fewer words keep every fingerprint
    band: int = 6
    least: float = 0.6


def _spans(piece: Piece) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = len(piece.data)
    inside = _WORD[piece.data]
    begin, end = inside.copy(), inside.copy()
    if n:
        begin[1:] &= ~inside[:-1]
        end[:-1] &= ~inside[1:]
        edge = piece.offsets[:-1][piece.offsets[:-1] < n]
        begin[edge] = inside[edge]
        last = piece.offsets[1:][piece.offsets[1:] > 0] - 1
        end[last] = inside[last]
    s = np.flatnonzero(begin)
    return s, np.flatnonzero(end) + 1, np.searchsorted(s, piece.offsets)


def _hashed(piece: Piece, gram: int) -> tuple[np.ndarray, ...]:
    """Words' begin, end and hash, first word of each row, and the hash of the run of `gram`
    words from each word on (the last ones of a piece are meaningless)."""
    s, e, first = _spans(piece)
    words = ByteHash(LOWER[piece.data]).of(s, e) if len(s) else np.zeros(0, np.uint64)
    runs = words.copy()
    for k in range(1, gram):
        m = max(0, len(words) - k)
        runs[:m] = mix(runs[:m] * _C + words[k:])
    return s, e, words, first, runs


def winnow(hashes: np.ndarray, window: int) -> list[int]:
    """Positions of the rightmost least hash of each window; of all if there are fewer."""
    if not len(hashes):
        return []
    picked: list[int] = []
    for i in range(max(1, len(hashes) - window + 1)):
        part = hashes[i : i + window]
        at = i + len(part) - 1 - int(np.argmin(part[::-1]))
        if not picked or picked[-1] != at:
            picked.append(at)
    return sorted(set(picked))


@dataclass
class TemplateIndex:
    """Inverted index of fingerprints: keys ascending, each with its (template, position)s."""

    names: list[str]
    words: list[list[int]]
    keys: np.ndarray
    places: list[list[tuple[int, int]]]
    params: LicenseParams

    @classmethod
    def build(cls, templates: dict[str, str], p: LicenseParams) -> TemplateIndex:
        names, words, found = [], [], defaultdict(list)
        for name, text in templates.items():
            raw = np.frombuffer(text.encode("utf-8"), np.uint8)
            _, _, w, _, runs = _hashed(Piece(0, 1, raw, np.array([0, len(raw)])), p.gram)
            if len(w) < p.gram:
                raise ValueError(f"template {name} has fewer than {p.gram} words")
            runs = runs[: len(w) - p.gram + 1]
            # winnowing vouches for long unchanged runs only, which a short template may lack
            for at in range(len(runs)) if len(w) < p.short else winnow(runs, p.window):
                found[int(runs[at])].append((len(names), at))
            names.append(name)
            words.append(w.tolist())
        keys = np.array(sorted(found), np.uint64)
        return cls(names, words, keys, [found[int(k)] for k in keys], p)


def align(doc: list[int], template: list[int], diagonal: int, band: int) -> tuple[int, int, int]:
    """Local alignment of words within `band` of a diagonal (document minus template
    position): matched words, and the first and last matched document word (-1 if none)."""
    n = len(doc)
    before: dict[int, tuple[int, int, int, int]] = {}
    best = (0, 0, -1, -1)
    for i, t in enumerate(template):
        now: dict[int, tuple[int, int, int, int]] = {}
        for j in range(max(0, i + diagonal - band), min(n, i + diagonal + band + 1)):
            score, matched, first, last = before.get(j - 1, (0, 0, -1, -1))
            if doc[j] == t:
                cell = (score + 2, matched + 1, first if matched else j, j)
            else:
                cell = (score - 1, matched, first, last)
            for side in (before.get(j), now.get(j - 1)):
                if side and side[0] - 1 > cell[0]:
                    cell = (side[0] - 1, *side[1:])
            now[j] = cell if cell[0] > 0 else (0, 0, -1, -1)
            if cell[:2] > best[:2]:
                best = cell
        before = now
    return best[1:]


def find_in(words: list[int], hits: list[tuple[int, list[tuple[int, int]]]], index: TemplateIndex) -> list[tuple[int, int, int, int]]:
    """(template, first word, last word, matched) in one document. hits: (word, places).
    Of overlapping finds of one template the fullest stays (then the earliest)."""
    seeds = defaultdict(set)
    for at, places in hits:
        for template, position in places:
            seeds[template].add(at - position)
    out = []
    for template, diagonals in sorted(seeds.items()):
        t = index.words[template]
        # narrow enough that copies end to end lie on bands of their own
        band = max(min(index.params.band, len(t) // 4), len(t) // 10)
        found, done = [], None
        for d in sorted(diagonals):
            if done is not None and d - done <= band // 2:
                continue  # within the band of the diagonal before
            done = d
            lo = max(0, d - band)
            part = words[lo : d + len(t) + band + 1]
            matched, a, b = align(part, t, d - lo, band)
            if a >= 0 and matched >= index.params.least * len(t):
                found.append((-matched, a + lo, b + lo))
        kept: list[tuple[int, int, int]] = []
        for m, a, b in sorted(found):
            if all(b < x or a > y for _, x, y in kept):
                kept.append((m, a, b))
        out += [(template, a, b, -m) for m, a, b in kept]
    return sorted(out, key=lambda x: (x[1], x[2], x[0]))


def scan(docs: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text", params: LicenseParams | None = None) -> DataFrame:
    """(id, license, start, end, matched, coverage): one row for each find in each whole text.

    start and end are byte offsets of the first and last matched word; matched counts
    template words. Null and empty texts have no finds; repeated rows repeat theirs; an
    empty table gives none. Words are runs of letters and digits, A-Z as a-z.
    """
    index = TemplateIndex.build(TEMPLATES if templates is None else templates, params or LicenseParams())
    held = docs.sparkSession.sparkContext.broadcast(index)  # a few fingerprints a template
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        ix = held.value
        bits = np.zeros(1 << 16, bool)
        bits[(ix.keys & np.uint64(0xFFFF)).astype(np.int64)] = True
        for batch in batches:
            rows, name, start, end, matched, coverage = [], [], [], [], [], []
            for piece in pieces(batch.column(1)):
                s, e, words, first, runs = _hashed(piece, ix.params.gram)
                maybe = np.flatnonzero(bits[(runs & np.uint64(0xFFFF)).astype(np.int64)]) if len(ix.keys) else np.zeros(0, np.int64)
                at = np.minimum(np.searchsorted(ix.keys, runs[maybe]), max(0, len(ix.keys) - 1))
                ok = ix.keys[at] == runs[maybe] if len(maybe) else np.zeros(0, bool)
                hit, at = maybe[ok], at[ok]
                row = np.searchsorted(first, hit, "right") - 1
                ok = hit + ix.params.gram <= first[row + 1]  # runs never cross rows
                hit, at, row = hit[ok], at[ok], row[ok]
                for r in np.unique(row).tolist():
                    a, b = int(first[r]), int(first[r + 1])
                    own = np.flatnonzero(row == r)
                    for t, x, y, m in find_in(words[a:b].tolist(), [(int(hit[i]) - a, ix.places[at[i]]) for i in own], ix):
                        rows.append(piece.lo + r)
                        name.append(ix.names[t])
                        start.append(int(s[a + x] - piece.offsets[r]))
                        end.append(int(e[a + y] - piece.offsets[r]))
                        matched.append(m)
                        coverage.append(m / len(ix.words[t]))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(name, pa.string()), pa.array(start, pa.int64()), pa.array(end, pa.int64()), pa.array(matched, pa.int64()), pa.array(coverage, pa.float64())], ["id", "license", "start", "end", "matched", "coverage"])

    return arrow(docs.select(id_col, docs[text_col].cast("string")), run, f"id {kind}, license string, start long, end long, matched long, coverage double")
