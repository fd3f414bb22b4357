"""Operators over whole units: wrapped notices, all links, rows that share an id."""

import math
import random
from collections import Counter

import pytest

from tests.llm.test_jaccard_join import texts
from tracelake.llm.jaccard_join import ngram_jaccard_link_counts
from tracelake.llm.licenses import scan_licenses

MIT = """# Permission is hereby granted, free of charge, to any person obtaining
# a copy of this software and associated documentation files
# (the "Software"), to deal in the Software without restriction"""


def test_wrapped_licence_files_are_whole(spark):
    rows = [(1, "r/LICENSE", BSD_CLAUSES + BSD_THIRD), (2, "r/src/a.py", "print(1)"), (3, "q/b.py", MIT), (4, "q/c.py", "nothing"), (5, "z/x", "a\nMIT\nb c d e f\nLicense")]
    got = {r["id"]: (r["license"], r["origin"]) for r in scan_licenses(spark.createDataFrame(rows, "page_id long, url string, html string"), markup=False).collect()}
    assert got == {1: ("BSD-3-Clause", "own"), 2: ("BSD-3-Clause", "inherited"), 3: ("MIT", "own"), 4: (None, None), 5: (None, None)}


GPL2 = """/*
 * This program is free software; you can redistribute it and/or
 * modify it under the terms of the GNU General Public License
 * as published by the Free Software Foundation; either version 2
 * of the License, or (at your option) any later version.
 *
 * This program is distributed in the hope that it will be useful,
 * but WITHOUT ANY WARRANTY; without even the implied warranty of
 * MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.
 */
int main() { return 0; }"""
LGPL21 = """This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either
version 2.1 of the License, or (at your option) any later version."""
GPL3_FILE = """                    GNU GENERAL PUBLIC LICENSE
                       Version 3, 29 June 2007

 Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/>
 Everyone is permitted to copy and distribute verbatim copies
 of this license document, but changing it is not allowed.

                            Preamble

  The GNU General Public License is a free, copyleft license for
software and other kinds of works."""
MIT_FILE = """MIT License

Copyright (c) 2021 Somebody Else

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND."""
BSD_CLAUSES = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
BSD_THIRD = """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""


def test_versions_and_whole_files_are_told_apart(spark):
    rng = random.Random(2)
    prose = [" ".join(rng.choice(["the", "of", "and", "river", "stone", "to", "without", "any"]) for _ in range(12)) for _ in range(200)]
    files = {"GPL-2.0": GPL2, "LGPL-2.1": LGPL21, "GPL-3.0": GPL3_FILE, "MIT": MIT_FILE, "BSD-2-Clause": BSD_CLAUSES, "BSD-3-Clause": BSD_CLAUSES + BSD_THIRD}
    rows = [(i, f"r{i}/LICENSE", x) for i, x in enumerate(files.values())] + [(100 + i, f"r{i}/src/deep/a.c", "int x;") for i in range(len(files))]
    rows += [(200 + i, f"prose/{i}.txt", "\n".join(prose[i : i + 20])) for i in range(150)]
    rows += [(300, "long/x.txt", "\n".join(prose * 40 + GPL2.split("\n") + prose * 40)), (301, "e/LICENSE", ""), (302, None, None)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string")
    for all_terms in (False, True):
        got = {r["id"]: (r["license"], r["origin"]) for r in scan_licenses(table, markup=False, all_terms=all_terms).collect()}
        assert {i: got[i] for i in range(len(files))} == {i: (name, "own") for i, name in enumerate(files)}
        assert {i: got[100 + i] for i in range(len(files))} == {i: (name, "inherited") for i, name in enumerate(files)}
        assert {got[i] for i in range(200, 350)} | {got[301], got[302]} >= {(None, None)} and not any(got[200 + i][0] for i in range(100))
        assert got[300] == ("GPL-2.0", "own")


def test_inline_tags_do_not_cut_a_notice(spark):
    rows = [(1, "h/x", "<p>one</p><div>Licensed under the <a href='http://x/'>Apache License</a>,\nVersion <B>2.0</B>.</div><p>two"), (2, "h/y", "<body><article>x</article></body>")]
    for all_terms in (False, True):
        got = {r["id"]: (r["license"], r["cosine"]) for r in scan_licenses(spark.createDataFrame(rows, "page_id long, url string, html string"), all_terms=all_terms).collect()}
        assert got[1][0] == "Apache-2.0" and abs(got[1][1] - 1) < 1e-6 and got[2] == (None, None)


def test_all_terms_have_their_idf(spark):
    lines = ["please note all rights reserved", "please note", "please", "please note it", "note well"]
    df = Counter(w for x in lines for w in set(x.split()))
    idf = {w: 1 + math.log((1 + len(lines)) / (1 + n)) for w, n in df.items()}
    of = lambda words: math.sqrt(sum(idf[w] ** 2 for w in words))
    want = of(["all", "rights", "reserved"]) / of(lines[0].split())
    table = spark.createDataFrame([(i, f"d{i}/x", x) for i, x in enumerate(lines)], "page_id long, url string, html string")
    got = {r["id"]: r["cosine"] for r in scan_licenses(table, all_terms=True).collect()}
    assert want >= 0.75 and abs(got[0] - want) < 1e-8 and set(got.values()) == {got[0], None}


@pytest.mark.parametrize("limit", [8_000_000, 15_000])
def test_all_links_are_counted(spark, limit):
    rows = [*texts(3), (1, "a b c d e"), (6000, "A b c d e"), (None, "a b c d e")]
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        sets.append({tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} if w else set())
    linked = lambda x, y: bool(x and y) and 100 * len(x & y) >= 85 * len(x | y)
    want = sorted(((d, sum(linked(x, y) for j, y in enumerate(sets) if j != i and rows[j][0] is not None) if d is not None else None) for i, (d, x) in enumerate(zip((d for d, _ in rows), sets, strict=True))), key=str)
    got = ngram_jaccard_link_counts(spark.createDataFrame(rows, "doc_id long, text string"), shingle=4, percent=85, region_shingles=limit)
    assert sorted(map(tuple, got.collect()), key=str) == want and max(n or 0 for _, n in want) > 20
