"""The index against looking for the phrases at every place."""

import random
import re
import time

import numpy as np
import pytest

from mosaica.llm.licenses import TEMPLATES, Scanner, _hash, frequencies, parse, scan, scan_sql


def brute(text, slack=3):
    w = re.findall(r"[0-9a-z\x80-\U0010ffff]+", text.lower())
    out = []
    for t in parse(TEMPLATES):
        at0, first = t.phrases[0]
        for d in range(-at0, len(w)):
            if d + at0 < 0 or tuple(w[d + at0 : d + at0 + len(first)]) != first:
                continue
            last, ok = d + at0 + len(first), True
            for at, p in t.phrases[1:]:
                near = [q for q in range(d - slack, d + slack + 1) if q + at >= 0 and tuple(w[q + at : q + at + len(p)]) == p]
                if not near:
                    ok = False
                    break
                q = min(near, key=lambda q: (abs(q - d), q))
                last = max(last, q + at + len(p))
            if ok:
                near = lambda k: set(w[max(0, d + k - slack) : max(0, d + k + slack + 1)])  # noqa: E731, B023
                out.append((t.name, d + at0, last - d - at0, round(sum(x in near(k) for k, x in enumerate(t.words)) / len(t.words), 4)))
    return sorted(out)


def notice(name):
    return TEMPLATES[name].replace("[", "").replace("]", "")


def corpus():
    r = random.Random(3)
    common = "the of and to is license software permission copy under version free".split()
    rows = []
    for i in range(150):
        w = [r.choice(common) for _ in range(r.choice([0, 5, 60]))]
        for _ in range(r.choice([0, 1, 2])):
            n = re.findall("[0-9A-Za-z]+", notice(r.choice(list(TEMPLATES))))
            kind = r.random()
            if kind < 0.3:
                n[r.randrange(len(n))] = "changed"
            elif kind < 0.5:
                p = r.randrange(len(n))
                n[p:p] = ["extra"] * r.choice([1, 3, 4])
            w[len(w) // 2 : len(w) // 2] = n
        rows.append((i, r.choice([" ", "\n", ", "]).join(w).title()))
    return rows


def test_matches_brute_force(spark):
    rows = corpus()
    got = {}
    for x in scan(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got.setdefault(x.doc_id, []).append((x.license, x.start_word, x.n_words, x.coverage))
    assert {i: sorted(m) for i, m in got.items()} == {i: m for i, t in rows if (m := brute(t))}
    assert len({x[0] for m in got.values() for x in m}) > 10


def test_sql():
    """The SQL on notices with several phrases, some changed, pushed apart, cut off at either end or repeated."""
    duckdb = pytest.importorskip("duckdb")
    cut = re.findall("[0-9A-Za-z]+", notice("BSD-3-Clause"))
    rows = [*corpus(), (500, None), (501, ""), (502, " ".join(cut[3:])), (503, " ".join(cut[:-9])), (504, " ".join(cut * 3)), (505, " ".join(cut))]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    got = {}
    for i, *m in con.execute(scan_sql()).fetchall():
        got.setdefault(i, []).append(tuple(m))
    assert {i: sorted(m) for i, m in got.items()} == {i: m for i, t in rows if (m := brute(t or ""))}


def test_frequencies_count_documents(spark):
    docs = spark.createDataFrame([(1, "license LICENSE the"), (2, "the license"), (3, "copy"), (3, None)], "doc_id long, text string")
    df = frequencies(docs)
    assert (df["license"], df["the"], df["copy"], df["gnu"]) == (2, 2, 1, 0)
    s = Scanner({"t": "[the license of gnu]", "u": "[of the] license [gnu the]"}, {"the": 9, "license": 5, "of": 8, "gnu": 1}, 3)
    assert s.rare == [[3, 1, 2], [3, 0, 1]] and s.of_phrase == [[3], [0, 3]]  # by falling IDF; each phrase's rarest is among them


@pytest.mark.parametrize(
    "text,want",
    [
        ("# SPDX-License-Identifier: Apache-2.0\n", {"Apache-2.0 (tag)"}),
        ("// SPDX-License-Identifier: GPL-2.0-or-later", {"GPL-2.0-or-later (tag)"}),
        (" * This program is free software; you can redistribute it and/or modify\n * it under the terms of the GNU General Public License version 2 as\n * published by the Free Software Foundation.", {"GPL-2.0-only"}),
        (" This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", {"AGPL-3.0-or-later"}),
        ("/* Licensed under the Apache License, Version 2.0 (the \"License\");\n * you may not use this file except in compliance with the License.\n * You may obtain a copy of the License at", {"Apache-2.0", "Apache-2.0 (named)"}),
        ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or", {"LGPL-2.1-or-later"}),
        ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy", {"MPL-2.0"}),
        ("permission is hereby granted, and the license of this software says so: free of charge", set()),
        ("Released under the MIT Licence", set()),
    ],
)
def test_headers(text, want):
    scanner = Scanner(TEMPLATES, {}, 3)
    assert {m[0] for m in brute(text)} == want
    assert {m[1] for m in scan_text(scanner, text)} == want


def scan_text(scanner, text):
    w = re.findall(r"[0-9a-z\x80-\U0010ffff]+", text.lower())
    h = np.array([_hash(x) for x in w], np.uint64)
    place = scanner.lookup.places(h)
    number = np.searchsorted(scanner.lookup.sorted, h[place])
    return [(0, scanner.templates[t].name, *m) for t, _ in scanner.candidates(number, np.zeros(len(place), int), 1) for m in scanner.matches(h, place, number, t)]


def test_many_notices_in_one_file():
    """Work in proportion to the file."""
    scanner, took = Scanner(TEMPLATES, {}, 3), []
    for n in (500, 4000):
        text = (notice("MIT") + " " + notice("GPL-2.0-or-later") + " ") * n
        h = np.tile(np.array([_hash(x) for x in re.findall("[0-9a-z]+", text[: len(text) // n].lower())], np.uint64), n)
        place = scanner.lookup.places(h)
        number = np.searchsorted(scanner.lookup.sorted, h[place])
        began = time.perf_counter()
        got = [m for t in (0, 5) for m in scanner.matches(h, place, number, t)]
        took.append(time.perf_counter() - began)
        assert len(got) == 2 * n and min(m[2] for m in got) > 0.99
    assert took[1] < 30 * took[0]


def test_cases(spark):
    mit = "Released under the MIT License."
    rows = [(1, mit, "x"), (1, mit, "x"), (None, mit + " " + mit, "x"), (3, None, "x"), (4, "", "x"), (5, "word " * 60_000 + mit, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, license string")
    got = sorted((str(r.doc_id), r.license, r.start_word) for r in scan(docs).collect())
    assert got == [("1", "MIT (named)", 0)] * 2 + [("5", "MIT (named)", 60_000), ("None", "MIT (named)", 0), ("None", "MIT (named)", 5)]
    assert scan(spark.createDataFrame([], "doc_id long, text string")).collect() == []
