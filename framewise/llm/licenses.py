"""License scan: winnowed fingerprints of templates in an inverted index pick candidates, banded alignment confirms them.

Template words get ids; k-grams of ids are hashed and winnowed (the least hash of each window of w k-grams), and the
kept hashes with their places form a small inverted index that every task holds. Texts are winnowed alike, so every
shared run of k + w - 1 words or more meets the index. A hit names a template and a diagonal; around it the template is
aligned as a whole with the text by banded edit distance, whose band is as wide as the edits that may pass. Edits are
words left out, put in or changed; a match has at most (1 - least) of its template's words in edits. Coverage is the
matched share of the template, `inserted` the words of the span that the template has not.

Words that tell licences apart are not open to edits: in a notice of up to `short` words all words but fillers must be
there, in any template those of TELLING and version numbers; no telling word may stand in the span beyond the template's
own; and no word of negation may stand among the three before a short notice. Of matches that overlap, that with most
matched words less edits stands (a full notice over the line it holds, the licence whose text fits best over a variant),
whatever their licences. Templates are a parameter; their total size bounds the index. Templates of more than `short`
words need two hits on near diagonals to be aligned.

Edge cases: null, empty and license-free texts get zero matches. Each copy of a notice is a match. Repeated rows each get
their row. A template of fewer than k + w - 1 words is an error.
"""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .text import map_rows, share, utf8, words_of

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
BASE = np.uint64(0x9E3779B97F4A7C15)

# Texts and notices as they stand in files.
_WARRANTY = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD3 = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_GNU = "This {what} is free software{end} you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation{either} version {v} of the License, or (at your option) any later version. This {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details."
_GPL, _LGPL, _AGPL = "General Public License", "Lesser General Public License", "Affero General Public License"


def _templates() -> dict[str, list[str]]:
    out = {
        "apache-2.0": [
            'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
            "Licensed under the Apache License, Version 2.0.",
        ],
        "mit": [
            'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
            "Released under the MIT License.",
            "Licensed under the MIT License.",
        ],
        "bsd-2-clause": [f"{_BSD} {_WARRANTY}", "Licensed under the BSD 2-Clause License."],
        "bsd-3-clause": [f"{_BSD} {_BSD3} {_WARRANTY}", "Licensed under the BSD 3-Clause License."],
        "isc": [
            'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
            "Licensed under the ISC License.",
        ],
        "zlib": [
            "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."
        ],
        "unlicense": [
            "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."
        ],
        "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.", "Licensed under the Mozilla Public License, version 2.0."],
        "cc0-1.0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", "This work is dedicated to the public domain under CC0 1.0."],
    }
    for key, name, versions in (("gpl", _GPL, ("2", "3")), ("lgpl", _LGPL, ("2.1", "3")), ("agpl", _AGPL, ("3",))):
        for v in versions:
            old = v.startswith("2")
            notice = _GNU.format(what="library" if v == "2.1" else "program", end=";" if old else ":", name=name, either="; either" if old else ", either", v=v)
            lines = [f"{lead} under the GNU {name}, version {v}." for lead in ("This work is licensed", "Released")]
            out[f"{key}-{v}.0" if "." not in v else f"{key}-{v}"] = [notice, *lines, f"Licensed under the {key.upper()} v{v}.", f"Licensed under the GNU {key.upper()}, version {v}."]
    parts = {"nc": "NonCommercial", "sa": "ShareAlike", "nd": "NoDerivatives"}
    for more in ((), ("sa",), ("nc",), ("nd",), ("nc", "sa"), ("nc", "nd")):
        for v in ("2.0", "2.5", "3.0", "4.0"):
            short, long = "-".join(["BY", *map(str.upper, more)]), "-".join(["Attribution", *(parts[m] for m in more)])
            kind = "International" if v == "4.0" else "Unported" if v == "3.0" else "Generic"
            out[f"cc-{short.lower()}-{v}"] = [f"Licensed under CC {short} {v}.", f"This work is licensed under a Creative Commons {long} {v} {kind} License.", f"Creative Commons {long} {v} License."]
    out["mit-0"] = []
    for name in out:
        out[name] = [*out[name], f"SPDX-License-Identifier: {name}"]
    return out


#: Texts and notices of each licence.
TEMPLATES = _templates()
#: Words that may be missing from a short notice (fixed values).
FILLER = set(b"a an the this that is are of in to and or at by for under with work works file files software program project code document content text page data material licensed released license licence available distributed published generic unported international public".split()) - {b"by"}
#: Words that tell one licence from another (fixed values).
TELLING = set(b"apache mit bsd isc zlib mozilla mpl gpl lgpl agpl gnu lesser library affero cc cc0 creative commons nc nd sa noncommercial noderivatives noderivs sharealike".split())
#: Words that deny what follows them (fixed values).
NEGATION = set(b"not never neither nor no non without isn aren wasn cannot longer unlike".split())


def hashes(ids: np.ndarray, k: int) -> np.ndarray:
    h = np.zeros(max(0, len(ids) - k + 1), np.uint64)
    for i in range(k):
        h = (h ^ ids[i : i + len(h)]) * BASE
        h ^= h >> np.uint64(29)
    return h


def winnow(h: np.ndarray, w: int) -> np.ndarray:
    """Places of the least hash (the last of equal ones) of each window of w; all of a shorter sequence count as one window."""
    if not len(h):
        return np.zeros(0, np.int64)
    if len(h) <= w:
        return np.array([len(h) - 1 - int(np.argmin(h[::-1]))])
    view = np.lib.stride_tricks.sliding_window_view(h, w)[:, ::-1]
    return np.unique(np.arange(len(view)) + w - 1 - view.argmin(axis=1))


def align(template: np.ndarray, words: np.ndarray, at: int, band: int) -> tuple[int, list[tuple[int, int]]]:
    """Least edits between the whole template and a stretch of words that starts within band of at, no place more than band off its diagonal; the matched pairs (template place, word place)."""
    m, width = len(template), 2 * band + 1
    place = at - band + np.arange(m + width)  # word place of (i, d) is place[i + d]
    inside = (place >= 0) & (place < len(words))
    text = np.where(inside, words[np.clip(place, 0, len(words) - 1)], -1)
    slope = np.arange(width, dtype=np.int32)
    table = np.zeros((m + 1, width), np.int32)  # row i: the first i template words used, d: diagonal of the next word
    for i in range(m):
        cur = table[i] + (text[i : i + width] != template[i])
        cur[:-1] = np.minimum(cur[:-1], table[i, 1:] + 1)
        table[i + 1] = np.minimum.accumulate(cur - slope) + slope
    d, i, pairs = int(table[m].argmin()), m, []
    edits = int(table[m, d])
    while i:
        here = table[i, d]
        if d and here == table[i, d - 1] + 1:
            d -= 1  # a word put in
        elif here == table[i - 1, d] + (text[i - 1 + d] != template[i - 1]):
            i -= 1
            if text[i + d] == template[i]:
                pairs.append((i, int(place[i + d])))
        else:
            i, d = i - 1, d + 1  # a template word left out
    return edits, pairs[::-1]


class Index:
    def __init__(self, templates: dict[str, list[str]], k: int, w: int, short: int):
        self.k, self.w, self.short = k, w, short
        texts = [(name, t) for name in sorted(templates) for t in templates[name]]
        self.names = [n for n, _ in texts]
        self.ids: dict[bytes, int] = {}
        raw = [words_of(t) for _, t in texts]
        if any(len(x) < k for x in raw):
            raise ValueError(f"templates need {k} words")
        self.words = [np.array([self.ids.setdefault(x, len(self.ids) + 1) for x in t]) for t in raw]
        telling = lambda t, i: t[i] in TELLING or t[i].isdigit() and i and (t[i - 1] in TELLING or t[i - 1] in (b"version", b"v", b"by", b"attribution") or t[i - 1].isdigit())
        self.must = [{i for i in range(len(t)) if telling(t, i) or len(t) <= short and t[i] not in FILLER} for t in raw]
        self.own = [set(t) & (TELLING | NEGATION) for t in raw]
        self.kinds = [np.unique(x) for x in self.words]
        self.needed = [sorted({int(x[i]) for i in must}) for x, must in zip(self.words, self.must)]
        posting: dict[int, list[tuple[int, int]]] = defaultdict(list)
        self.grams: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for t, ids in enumerate(self.words):
            h = hashes(ids.astype(np.uint64), k)
            for p, x in enumerate(h.tolist()):
                self.grams[x].append((t, p))
            for p in winnow(h, w).tolist():
                posting[int(h[p])].append((t, p))
        self.posting = dict(posting)
        self.known = np.array(sorted(posting), np.uint64)

    def candidates(self, ids: np.ndarray) -> list[tuple[int, int]]:
        """(template, diagonal) of every hit that may lead to a match."""
        h = hashes(ids.astype(np.uint64), self.k)
        votes: dict[tuple[int, int], int] = defaultdict(int)
        # every place of the text is looked up, so that one fingerprint of a template is enough, also of one shorter than a window
        for p in np.flatnonzero(self.known[np.minimum(np.searchsorted(self.known, h), len(self.known) - 1)] == h).tolist():
            for t, q in self.posting.get(int(h[p]), ()):
                votes[t, p - q] += 1
        hits = sorted(votes)
        near = lambda i, j: 0 <= j < len(hits) and hits[i][0] == hits[j][0] and abs(hits[i][1] - hits[j][1]) <= len(self.words[hits[i][0]])
        return [x for i, x in enumerate(hits) if len(self.words[x[0]]) <= self.short or votes[x] > 1 or near(i, i - 1) or near(i, i + 1)]

    def fits(self, t: int, words: list[bytes], pairs: list[tuple[int, int]]) -> bool:
        """Whether the words that tell licences apart agree."""
        i, j = pairs[0][1], pairs[-1][1]
        if not self.must[t] <= {p for p, _ in pairs}:
            return False
        other = (TELLING if len(self.words[t]) > self.short else TELLING | NEGATION) - self.own[t]
        if any(w in other for w in words[i : j + 1]):
            return False
        return len(self.words[t]) > self.short or NEGATION.isdisjoint(words[max(0, i - 3) : i])

    def possible(self, ids: np.ndarray, least: float):
        """Function (template, diagonal, band) -> whether an alignment there can be a match; what it denies cannot.

        The stretch must hold enough of the template's words, and each of those that must agree. An edit breaks at most k of
        the template's k-grams, so all but k times the edits allowed must stand on diagonals within the band.
        """
        k = self.k
        on: dict[int, list[int]] = defaultdict(list)
        for p, x in enumerate(hashes(ids.astype(np.uint64), k).tolist()):
            for t, q in self.grams.get(x, ()):
                on[t].append(p - q)
        diagonals = {t: np.sort(np.array(d)) for t, d in on.items()}
        sums: dict[int, np.ndarray] = {}
        places: dict[int, np.ndarray] = {}

        def look(t: int, at: int, band: int) -> bool:
            m = len(self.words[t])
            lo, hi = max(0, at - band), min(len(ids), at + m + band)
            if t not in sums:
                sums[t] = np.concatenate([[0], np.cumsum(np.isin(ids, self.kinds[t]))])
            first, end = np.searchsorted(diagonals[t], (at - band, at + band + 1))
            if end - first < m - k + 1 - k * int((1 - least) * m + 1e-9):
                return False
            if hi <= lo or sums[t][hi] - sums[t][lo] < least * m - 1e-9:
                return False
            for w in self.needed[t]:
                if w not in places:
                    places[w] = np.flatnonzero(ids == w)
                next_ = int(np.searchsorted(places[w], lo))
                if next_ == len(places[w]) or places[w][next_] >= hi:
                    return False
            return True

        return look

    def matches(self, words: list[bytes], least: float) -> list[tuple[str, float, int, int, int]]:
        """(licence, coverage, inserted, first word, last word) of each match, by place."""
        get = self.ids.get
        ids = np.array([get(w, 0) for w in words], np.int64)
        found: list[tuple[int, int, int, int, int, int]] = []
        last: dict[int, int] = {}
        candidates = self.candidates(ids)
        possible = self.possible(ids, least) if candidates else None
        for t, at in candidates:
            m = len(self.words[t])
            if at + m // 2 <= last.get(t, -1):
                continue  # inside a match of the same template
            band = int((1 - least) * m) + 1
            if not possible(t, at, band):
                continue
            edits, pairs = align(self.words[t], ids, at, band)
            if not pairs or edits > (1 - least) * m or not self.fits(t, words, pairs):
                continue
            i, j = pairs[0][1], pairs[-1][1]
            found.append((len(pairs) - edits, -t, i, j, len(pairs), j - i + 1 - len(pairs)))
            last[t] = j
        out: list[tuple[int, int, int, int, int, int]] = []
        ends: list[tuple[int, int]] = []
        for x in sorted(found, reverse=True):
            if _free(ends, x[2], x[3]):
                out.append(x)
        return [(self.names[-t], n / len(self.words[-t]), more, i, j) for _, t, i, j, n, more in sorted(out, key=lambda x: x[2])]


def _free(taken: list[tuple[int, int]], i: int, j: int) -> bool:
    """Whether [i, j] meets none of the sorted disjoint intervals taken; it is put among them if so."""
    import bisect

    at = bisect.bisect_left(taken, (i, j))
    if at and taken[at - 1][1] >= i or at < len(taken) and taken[at][0] <= j:
        return False
    taken.insert(at, (i, j))
    return True


def scan(docs: DataFrame, templates: dict[str, list[str]] | None = None, k: int = 3, w: int = 3, least: float = 0.8, short: int = 30, keep: list[str] | None = None) -> DataFrame:
    """docs (keep) with matches: array of (license, coverage, inserted, start, end); start and end are code points of the whole text."""
    table = share(docs.sparkSession, Index(templates or TEMPLATES, k, w, short))

    def make():
        index = table()

        def row(text):
            got = index.matches(words_of(text), least)
            if not got:
                return ([],)
            raw = utf8(text)
            at = [m.span() for m in WORD.finditer(raw.lower())]
            point = np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)])  # code points before each byte
            return ([{"license": n, "coverage": c, "inserted": more, "start": int(point[at[i][0]]), "end": int(point[at[j][1]])} for n, c, more, i, j in got],)

        return row

    return map_rows(docs, ["text"], make, "matches array<struct<license: string, coverage: double, inserted: int, start: bigint, end: bigint>>", keep=keep)


def report(docs: DataFrame, **how) -> DataFrame:
    """Per document: doc_id, n_matches, licenses (sorted, comma-joined), best_coverage, matches."""
    x = scan(docs, keep=["doc_id"], **how)
    return x.select("doc_id", F.size("matches").cast("bigint").alias("n_matches"), F.array_join(F.array_sort(F.array_distinct("matches.license")), ",").alias("licenses"), F.coalesce(F.array_max("matches.coverage"), F.lit(0.0)).alias("best_coverage"), "matches")
