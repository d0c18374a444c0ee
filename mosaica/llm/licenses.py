"""License scans over a positional index of rare words.

A template is a licence notice, whole or as it stands at the head of files, and the phrases in it that a file must have.
Words are runs of ASCII letters and digits and of all beyond ASCII, in lower case. The document frequency of every word of
the templates is counted over the whole corpus; the index has the postings ``(template, position)`` of each template's words
of highest IDF: the rarest of each mandatory phrase, and at least :data:`RARE` in all. A file's licence words are looked up
from the highest IDF down: templates of which it lacks a word drop out, and the places at which a word says that the template begins
are intersected with those of the next, within ``slack`` words of the relative position. At what is left the mandatory
phrases are compared word by word, and the share of all the template's words that stand within ``slack`` of their place is
reported as ``coverage``. Which words are looked up changes the speed only: the result is every place where all phrases of
a template stand at their relative positions. The work is linear in the file, up to sorting.

Defined cases: null and empty texts match nothing; one row per match and row, so repeated rows repeat theirs; a ``doc_id``
that is null or no integer is null; a notice within a longer one's text is reported too; two places of a phrase equally near its
own count as the earlier; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, flat, long_id, parts, ranges_hash, tidy, words

#: Words by which a phrase may stand off its place, relative to the template's first phrase.
SLACK = 3
#: Words of a template in the index, at least.
RARE = 3

_BSD = """[Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met]:
1. [Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer].
2. [Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation] and/or other materials provided with the distribution. """
_BSD_3 = """3. Neither the name of the copyright holder nor the names of its contributors [may be used to endorse or promote products derived from this software] without specific prior written permission. """
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_NO_WARRANTY = """This {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {kind}General Public License for more details."""


def _gnu(what: str, kind: str, version: str, later: bool) -> str:
    own = f"GNU {kind}General Public License"
    if later:
        return f"[This {what} is free software: you can redistribute it and/or modify it under the terms of the {own}] as published by the Free Software Foundation, [either version {version} of the License], or (at your option) any later version. " + _NO_WARRANTY.format(what=what, kind=kind)
    return f"[This {what} is free software; you can redistribute it and/or modify it under the terms of the {own}] [version {version}] [as published by the Free Software Foundation]. " + _NO_WARRANTY.format(what=what, kind=kind)


_TAGS = ("MIT", "MIT-0", "ISC", "BSD-2-Clause", "BSD-3-Clause", "Apache-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "AGPL-3.0-only", "AGPL-3.0-or-later", "MPL-2.0", "EPL-2.0", "Unlicense", "CC0-1.0", "BSL-1.0", "Zlib")

#: Licence -> its notice; mandatory phrases are in brackets.
TEMPLATES = {
    "MIT": """[Permission is hereby granted, free of charge, to any person obtaining a copy of this software] and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
[The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software].
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """[Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted], provided that the above [copyright notice and this permission notice appear in all copies].
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "BSD-2-Clause": _BSD + _BSD_END,
    "BSD-3-Clause": _BSD + _BSD_3 + _BSD_END,
    "Apache-2.0": """[Licensed under the Apache License, Version 2.0] (the "License"); you may not use this file except in compliance with the License. [You may obtain a copy of the License at] http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "GPL-2.0-or-later": _gnu("program", "", "2", True),
    "GPL-2.0-only": _gnu("program", "", "2", False),
    "GPL-3.0-or-later": _gnu("program", "", "3", True),
    "GPL-3.0-only": _gnu("program", "", "3", False),
    "LGPL-2.1-or-later": _gnu("library", "Lesser ", "2 1", True),
    "LGPL-3.0-or-later": _gnu("library", "Lesser ", "3", True),
    "LGPL-3.0-or-later (program)": _gnu("program", "Lesser ", "3", True),
    "AGPL-3.0-or-later": _gnu("program", "Affero ", "3", True),
    "MPL-2.0": """This Source Code Form is [subject to the terms of the Mozilla Public License, v. 2.0]. If a copy of the MPL was not distributed with this file, You can obtain one at""",
    "EPL-2.0": """[This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0] which is available at""",
    "Unlicense": """[This is free and unencumbered software released into the public domain]. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.""",
    "CC0-1.0": """[To the extent possible under law], the author(s) have [dedicated all copyright and related and neighboring rights to this software to the public domain worldwide]. This software is distributed without any warranty.""",
    "BSL-1.0": """[Distributed under the Boost Software License, Version 1.0].""",
    "BSL-1.0 (text)": """[Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license] (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so""",
    "Zlib": """[This software is provided 'as-is', without any express or implied warranty]. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. [The origin of this software must not be misrepresented]; you must not claim that you wrote the original software.""",
    "WTFPL": """[DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE]""",
    "MIT (named)": "[released under the MIT License]",
    "MIT (named, licensed)": "[licensed under the MIT License]",
    "Apache-2.0 (named)": "[licensed under the Apache License, Version 2.0]",
    "GPL-2.0 (named)": "[licensed under the GNU General Public License, version 2]",
    "GPL-3.0 (named)": "[licensed under the GNU General Public License, version 3]",
    "LGPL-3.0 (named)": "[licensed under the GNU Lesser General Public License, version 3]",
    "AGPL-3.0 (named)": "[licensed under the GNU Affero General Public License, version 3]",
    "BSD (named)": "[licensed under the BSD License]",
    "CC-BY-4.0 (named)": "[licensed under CC BY 4.0]",
    "CC-BY-SA-4.0 (named)": "[licensed under CC BY-SA 4.0]",
    "CC-BY-NC-4.0 (named)": "[licensed under CC BY-NC 4.0]",
    "CC-BY-ND-4.0 (named)": "[licensed under CC BY-ND 4.0]",
    **{f"{tag} (tag)": f"[SPDX-License-Identifier: {tag}]" for tag in _TAGS},
}
_WORD = re.compile("[0-9a-z\x80-\U0010ffff]+")


@dataclass(frozen=True)
class Template:
    name: str
    words: tuple[str, ...]
    #: Position and words of each mandatory phrase.
    phrases: tuple[tuple[int, tuple[str, ...]], ...]


def parse(templates: Mapping[str, str]) -> list[Template]:
    out = []
    for name, text in templates.items():
        phrases, every, begin = [], [], None
        for piece in re.findall(rf"\[|\]|{_WORD.pattern}", text.lower()):
            if piece == "[":
                begin = len(every)
            elif piece == "]":
                phrases.append((begin, tuple(every[begin:])))
            else:
                every.append(piece)
        if not phrases or not all(p for _, p in phrases):
            raise ValueError(f"{name} has no mandatory phrase, or an empty one")
        out.append(Template(name, tuple(every), tuple(phrases)))
    return out


def _hash(word: str) -> int:
    raw = np.frombuffer(word.encode(), np.uint8)
    return int(ranges_hash(raw, np.array([0]), np.array([len(raw)]))[0])


class Lookup:
    """Membership of hashes in a small set, by a table of their low bits first."""

    def __init__(self, hashes: list[int]):
        self.sorted = np.sort(np.array(hashes, np.uint64))
        self.low = np.zeros(1 << 16, bool)
        self.low[(self.sorted & np.uint64(0xFFFF)).astype(np.int64)] = True

    def places(self, h: np.ndarray) -> np.ndarray:
        p = np.flatnonzero(self.low[(h & np.uint64(0xFFFF)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.sorted, h[p]), len(self.sorted) - 1)
        return p[self.sorted[at] == h[p]]


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(long_id().alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))


def frequencies(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES) -> dict[str, int]:
    """Documents with each word of the templates, over all documents."""
    by_hash = {_hash(w): w for t in parse(templates) for w in t.words}
    lookup = Lookup(list(by_hash))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(len(lookup.sorted), np.int64)
        for b in parts(batches):
            raw, off = flat(pc.utf8_lower(b.column("text")))
            s, e, at = words(raw, off, ALNUM)
            h = ranges_hash(raw, s, e)
            p = lookup.places(h)
            doc = np.searchsorted(at, p, "right") - 1
            both = np.unique(doc * len(count) + np.searchsorted(lookup.sorted, h[p]))
            count += np.bincount(both % len(count), minlength=len(count))
        yield pa.RecordBatch.from_arrays([pa.array(lookup.sorted.view(np.int64)), pa.array(count)], names=["h", "n"])

    rows = _texts(docs).mapInArrow(tidy(run), "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).collect()
    found = {r.h: r.n for r in rows}
    return {w: found.get(int(np.uint64(h).view(np.int64)), 0) for h, w in by_hash.items()}


class Scanner:
    """The index: a template's words of highest IDF, rarest first, with their positions."""

    def __init__(self, templates: Mapping[str, str], df: Mapping[str, int], slack: int):
        self.templates, self.slack = parse(templates), slack
        self.hashes = [np.array([_hash(w) for w in t.words], np.uint64) for t in self.templates]
        rarity = lambda w: (df.get(w, 0), w)
        #: Of each template the positions in the index by falling IDF, and of each of its phrases the one in it.
        self.rare, self.of_phrase = [], []
        for t in self.templates:
            best = [min(range(at, at + len(p)), key=lambda j, t=t: (rarity(t.words[j]), j)) for at, p in t.phrases]
            more = sorted({j for at, p in t.phrases for j in range(at, at + len(p))} - set(best), key=lambda j, t=t: (rarity(t.words[j]), j))
            self.of_phrase.append(best)
            self.rare.append(sorted([*best, *more[: max(0, RARE - len(best))]], key=lambda j, t=t: (rarity(t.words[j]), j)))
        self.lookup = Lookup(sorted({int(h[j]) for h, js in zip(self.hashes, self.rare) for j in js}))
        #: For each template, the numbers of its indexed words.
        self.numbers = [np.searchsorted(self.lookup.sorted, h[js]) for h, js in zip(self.hashes, self.rare)]

    def candidates(self, number: np.ndarray, doc: np.ndarray, n: int) -> list[tuple[int, np.ndarray]]:
        """Template -> the texts (of ``n``) that have all its indexed words."""
        has = np.zeros((n, len(self.lookup.sorted)), bool)
        has[doc, number] = True
        return [(t, d) for t, ws in enumerate(self.numbers) if len(d := np.flatnonzero(has[:, ws].all(1)))]

    def matches(self, h: np.ndarray, place: np.ndarray, number: np.ndarray, t: int) -> list[tuple[int, int, float]]:
        """First word, words and coverage of each match of a template in a text's word hashes; ``place``: where its looked-up words are."""
        template, s = self.templates[t], self.slack
        starts = {j: place[number == w] - j for j, w in zip(self.rare[t], self.numbers[t])}
        left = starts[self.rare[t][0]]
        for j in self.rare[t][1:]:  # a phrase may be off the first by slack, so two may be off each other by twice that
            left = left[_near(left, starts[j], 2 * s) >= 0]
        if not len(left):
            return []
        begin = []
        for j, (at, p) in zip(self.of_phrase[t], template.phrases):
            q = starts[j][_near(starts[j], left, 2 * s) >= 0]
            want = self.hashes[t][at : at + len(p)]
            q = q[(q + at >= 0) & (q + at + len(p) <= len(h))]
            begin.append(q[(h[(q + at)[:, None] + np.arange(len(p))] == want).all(1)] if len(q) else q)
        d = begin[0]
        ok, last = np.ones(len(d), bool), d + template.phrases[0][0] + len(template.phrases[0][1])
        for q, (at, p) in zip(begin[1:], template.phrases[1:]):
            k = _near(d, q, s)
            ok &= k >= 0
            last = np.maximum(last, np.where(k >= 0, q[np.maximum(k, 0)] if len(q) else 0, 0) + at + len(p))
        first = template.phrases[0][0]
        return [(int(x) + first, int(y - x) - first, self._coverage(h, t, int(x))) for x, y in zip(d[ok], last[ok])]

    def _coverage(self, h: np.ndarray, t: int, begin: int) -> float:
        at = begin + np.arange(len(self.hashes[t]))
        found = np.zeros(len(at), bool)
        for off in range(-self.slack, self.slack + 1):
            inside = (at + off >= 0) & (at + off < len(h))
            found[inside] |= h[at[inside] + off] == self.hashes[t][inside]
        return round(float(found.mean()), 4)


def _near(x: np.ndarray, y: np.ndarray, most: int) -> np.ndarray:
    """For each of ``x`` the index in ascending ``y`` of the nearest value within ``most``, the lower of two; -1 without one."""
    if not len(y):
        return np.full(len(x), -1)
    hi = np.searchsorted(y, x)
    lo, hi = np.maximum(hi - 1, 0), np.minimum(hi, len(y) - 1)
    k = np.where(np.abs(y[lo] - x) <= np.abs(y[hi] - x), lo, hi)
    return np.where(np.abs(y[k] - x) <= most, k, -1)


def scan(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, slack: int = SLACK) -> DataFrame:
    """``(doc_id, license, start_word, n_words, coverage)`` for every match."""
    scanner = Scanner(templates, frequencies(docs, templates), slack)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches):
            raw, off = flat(pc.utf8_lower(b.column("text")))
            s, e, at = words(raw, off, ALNUM)
            h = ranges_hash(raw, s, e)
            place = scanner.lookup.places(h)
            if not len(place):
                continue
            number = np.searchsorted(scanner.lookup.sorted, h[place])
            edge = np.searchsorted(place, at)
            doc = np.repeat(np.arange(b.num_rows), np.diff(edge))
            found = []
            for t, docs_of in scanner.candidates(number, doc, b.num_rows):
                for d in docs_of.tolist():
                    mine = slice(edge[d], edge[d + 1])
                    found += [(d, scanner.templates[t].name, *m) for m in scanner.matches(h[at[d] : at[d + 1]], place[mine] - at[d], number[mine], t)]
            if found:
                rows, name, first, n, share = zip(*sorted(found, key=lambda m: (m[0], m[2], m[1])))
                yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(rows, pa.int64())), pa.array(name), pa.array(first, pa.int64()), pa.array(n, pa.int64()), pa.array(share, pa.float64())], names=["doc_id", "license", "start_word", "n_words", "coverage"])

    return _texts(docs).mapInArrow(tidy(run), "doc_id long, license string, start_word long, n_words long, coverage double")


def scan_sql(templates: Mapping[str, str] = TEMPLATES, slack: int = SLACK) -> str:
    """:func:`scan` of ``documents`` for DuckDB, which looks for every phrase at every place."""
    found = parse(templates)
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    phrases = ", ".join(f"({quoted(t.name)}, {k}, {at}, {len(p)}, {len(t.phrases)}, {quoted(p[0])}, {quoted(' '.join(p))})" for t in found for k, (at, p) in enumerate(t.phrases))
    every = ", ".join(f"({quoted(t.name)}, {j}, {quoted(w)})" for t in found for j, w in enumerate(t.words))
    return f"""
WITH p(license, k, place, len, phrases, first, phrase) AS (VALUES {phrases}),
t(license, j, word) AS (VALUES {every}),
d AS MATERIALIZED (SELECT doc_id, row_number() OVER () AS rid, regexp_extract_all(lower(coalesce(text, '')), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS ws FROM documents),
w AS (SELECT rid, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS i FROM d),
q AS MATERIALIZED (
  SELECT p.license, p.k, p.place, p.len, p.phrases, w.rid, w.i - p.place AS q FROM w JOIN p ON w.word = p.first JOIN d USING (rid)
  WHERE array_to_string(d.ws[w.i + 1 : w.i + p.len], ' ') = p.phrase
), n AS (
  SELECT a.license, a.rid, a.q AS d, b.k, min_by(b.q + b.place + b.len, (abs(b.q - a.q), b.q)) AS upto
  FROM q a JOIN q b ON a.license = b.license AND a.rid = b.rid AND a.k = 0 AND (b.k = 0 AND b.q = a.q OR b.k > 0 AND abs(b.q - a.q) <= {slack}) GROUP BY ALL
), m AS MATERIALIZED (
  SELECT n.license, rid, d, max(upto) AS upto FROM n JOIN p ON p.license = n.license AND p.k = 0 GROUP BY n.license, rid, d, p.phrases HAVING count(*) = p.phrases
), c AS (
  SELECT m.license, rid, m.d, round(avg((m.d + j + {slack} >= 0 AND list_contains(d.ws[greatest(1, m.d + j - {slack - 1}) : m.d + j + {slack + 1}], word))::INTEGER), 4) AS coverage
  FROM m JOIN t USING (license) JOIN d USING (rid) GROUP BY ALL
)
SELECT d.doc_id, m.license, m.d + p.place AS start_word, m.upto - m.d - p.place AS n_words, c.coverage
FROM m JOIN c ON c.license = m.license AND c.rid = m.rid AND c.d = m.d JOIN p ON p.license = m.license AND p.k = 0 JOIN d ON d.rid = m.rid
"""
