"""License scan: sparse TF-IDF cosine of header blocks and licence files to templates, then inheritance from the nearest ancestor directory.

A block is a line or a run of lines (hard-wrapped notices, headers and whole files are runs), short enough to be a template. One pass over the texts counts in how many
lines each term occurs. A second one keeps the blocks that can reach the threshold, by two bounds: a block's cosine to a template is at most the length of the
template's part whose terms the text has at all, which settles nearly all texts with one look-up a word; and word by word, a block's dot product with a template adds
up, and its squared length is at least the sum of its words' squared idf, at least 1 for a term of no template, so prefix sums bound every block's cosine.
Cosines are joined and summed for the blocks that are left. Licence files and index pages give their licence to their directory;
files without one of their own look it up by joining all their ancestor directories. Each version of a licence has templates of its own.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.llm.scratch import keep
from tracelake.llm.words import slices

_PERMISSION = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without "
    "restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
    "Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
)
_REDISTRIBUTION = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
)
_ENDORSEMENT = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_VERBATIM = "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."


def _free_software(program: str, name: str, version: str) -> str:
    return f"{program} is free software; you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation; either version {version} of the License, or (at your option) any later version."


# Notices, headers and opening paragraphs of licence files in their usual words.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("MIT", _PERMISSION),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", _free_software("This program", "General Public License", "2")),
    ("GPL-2.0", f"GNU GENERAL PUBLIC LICENSE Version 2, June 1991 Copyright (C) 1989, 1991 Free Software Foundation, Inc. {_VERBATIM}"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", _free_software("This program", "General Public License", "3")),
    ("GPL-3.0", f"GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. https://fsf.org/ {_VERBATIM}"),
    ("LGPL-2.1", "This work is licensed under the GNU Lesser General Public License, version 2.1."),
    ("LGPL-2.1", _free_software("This library", "Lesser General Public License", "2.1")),
    ("LGPL-2.1", f"GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999 Copyright (C) 1991, 1999 Free Software Foundation, Inc. {_VERBATIM}"),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-3.0", _free_software("This library", "Lesser General Public License", "3")),
    ("LGPL-3.0", f"GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. https://fsf.org/ {_VERBATIM}"),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0", _free_software("This program", "Affero General Public License", "3")),
    ("AGPL-3.0", f"GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007 Copyright (C) 2007 Free Software Foundation, Inc. https://fsf.org/ {_VERBATIM}"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, for any purpose, commercial or non-commercial, and by any means."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("BSD-2-Clause", _REDISTRIBUTION),
    ("BSD-3-Clause", f"{_REDISTRIBUTION} {_ENDORSEMENT}"),
    ("Proprietary", "All rights reserved."),
]

#: Terms of kept runs whose line counts are broadcast; above it the join shuffles.
BROADCAST_TERMS = 200_000
#: Distinct terms that a task counts before it sends them on.
COUNTED_TERMS = 100_000

#: Directory licences are broadcast up to so many directories; above it the join shuffles.
BROADCAST_DIRS = 200_000

_TERM = re.compile(rb"[a-z0-9]+")
_TAGS = re.compile(rb"<(script|style)\b.*?</\1\s*>|<[^>]*>", re.S)
_INLINE = re.compile(rb"</?(?:a|abbr|acronym|b|bdi|bdo|big|cite|code|data|del|dfn|em|font|i|ins|kbd|mark|q|s|samp|small|span|strike|strong|sub|sup|time|tt|u|var|wbr)(?:\s[^>]*)?/?>", re.I)
_FILE = r"(?i)^(licen[cs]e|copying|copyright|notice|legal)(\..*)?$"


def _terms(line: bytes) -> Counter:
    return Counter(_TERM.findall(line.lower()))


def _lines(text: bytes | None, markup: bool) -> list[tuple[int, list[bytes]]]:
    """``(number, terms)`` of the lines with terms. Inline tags are spaces, other tags end a line."""
    text = text or b""
    if markup and b"<" in text:
        text = _TAGS.sub(lambda m: b" " if _INLINE.fullmatch(m[0]) else b"\n", text)
    return [(i, words) for i, line in enumerate(text.split(b"\n")) if (words := _TERM.findall(line.lower()))]


def _count(vocabulary: dict[bytes, int] | None, markup: bool):
    """In how many lines each term occurs (of ``vocabulary``, or of all); the null term counts the lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df: Counter = Counter()

        def send() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(df), pa.binary()), pa.array(list(df.values()), pa.int64())], names=["term", "n"])
            df.clear()
            return out

        for batch in slices(batches):
            for text in batch.column("text").to_pylist():
                for _, words in _lines(text, markup):
                    df[None] += 1
                    df.update(set(words) if vocabulary is None else vocabulary.keys() & words)
            if len(df) > COUNTED_TERMS:
                yield send()
        yield send()

    return run


def _scan(vocabulary: dict[bytes, int], weights: np.ndarray, idf: np.ndarray, other: float, threshold: float, most: int, markup: bool):
    """Blocks whose bounds reach the threshold. weights: template terms x templates, a last row for other terms; idf likewise."""
    squares = np.append(idf**2, other**2)
    table = np.hstack([weights, squares[:, None]])
    part = np.divide(weights, np.append(idf, 1.0)[:, None]) ** 2  # the squared shares of a template's length; the last row is 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get, none = vocabulary.get, len(idf)
        for batch in slices(batches, 64):
            row, nth, span, terms, others = [], [], [], [], []
            lines = []
            for r, text in zip(batch.column("row").to_pylist(), batch.column("text").to_pylist(), strict=True):
                own = _lines(text, markup)
                held = vocabulary.keys() & {w for _, words in own for w in words}
                if held and part[[vocabulary[w] for w in held]].sum(axis=0).max(initial=0.0) >= (threshold - 1e-6) ** 2:
                    lines += [(r, i, words) for i, words in own]
            if lines:
                of = np.array([r for r, _, _ in lines])
                ends = np.concatenate([[0], np.cumsum([len(words) for _, _, words in lines])])
                ids = np.fromiter((get(w, none) for _, _, words in lines for w in words), np.int64, ends[-1])
                by_line = np.add.reduceat(table[ids], ends[:-1])
                sums = np.vstack([np.zeros(table.shape[1]), np.cumsum(by_line, axis=0)])
                first = np.arange(len(lines))
                size = 1
                while len(first):
                    x = sums[first + size] - sums[first]
                    # prefix sums lose some digits, the exact cosine is taken later
                    for i in first[x[:, :-1].max(axis=1, initial=0.0) >= (threshold - 1e-6) * np.sqrt(np.maximum(x[:, -1], 1e-300))]:
                        counts = Counter(w for _, _, words in lines[i : i + size] for w in words)
                        row.append(lines[i][0])
                        nth.append(lines[i][1])
                        span.append(size)
                        terms.append([{"term": vocabulary[w], "n": n} for w, n in counts.items() if w in vocabulary])
                        others.append([{"word": w, "n": n} for w, n in counts.items() if w not in vocabulary])
                    size += 1
                    first = first[first + size <= len(lines)]
                    first = first[(of[first + size - 1] == of[first]) & (ends[first + size] - ends[first] <= most)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(row, pa.int64()), pa.array(nth, pa.int64()), pa.array(span, pa.int64()), pa.array(terms, pa.list_(pa.struct([("term", pa.int32()), ("n", pa.int64())]))), pa.array(others, pa.list_(pa.struct([("word", pa.binary()), ("n", pa.int64())])))],
                names=["row", "nth", "span", "terms", "others"],
            )

    return run


def _place(url: Column) -> Column:
    """host, directory (ends in /), file name of a URL or plain path."""
    path = F.regexp_replace(F.regexp_replace(F.coalesce(url, F.lit("")), r"[?#].*$", ""), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    full = F.when(path.contains("/"), path).otherwise(F.concat(F.lit("/"), path))
    return F.struct(F.regexp_extract(full, r"^(.*/)", 1).alias("dir"), F.regexp_extract(full, r"([^/]*)$", 1).alias("name"))


def scan_licenses(
    files: DataFrame, id_col: str = "page_id", path_col: str = "url", text_col: str = "html", markup: bool = True, templates: list[tuple[str, str]] | None = None, threshold: float = 0.75, all_terms: bool = False
) -> DataFrame:
    """One row a row of ``files``: ``id``, ``license``, ``cosine`` (null if inherited), ``origin`` ("own", "inherited" or null), ``dir`` it was found in.

    Each template takes the file's block of the highest cosine, at least ``threshold`` (then the first line, the shorter block). Of these the template whose block lies
    longest along it wins (the dot product: a file of three clauses is not taken for two), then the higher cosine, the first line, the first licence by name. Blocks have at most the longest template's terms / ``threshold`` squared: of different words, more cannot reach it. A directory's is the longest of its
    licence files', else of its index pages'. Idf: ``1 + ln((1 + lines) / (1 + lines with the term))`` over all lines; terms of no template have that too with
    ``all_terms``, and else the highest idf there is.
    Null texts have no lines; null paths lie in the root; without templates or rows nothing is found. Repeated rows count each; other columns are ignored.
    """
    templates = TEMPLATES if templates is None else templates
    spark = files.sparkSession
    vectors = [(name, _terms(text.encode())) for name, text in templates]
    words = sorted({w for _, v in vectors for w in v})
    vocabulary = {w: i for i, w in enumerate(words)}
    key = F.xxhash64(*(F.col(f"`{c}`") for c in (id_col, path_col, text_col)))
    rows = files.select(key.alias("row"), F.col(f"`{id_col}`").alias("id"), _place(F.col(f"`{path_col}`")).alias("at"), F.col(f"`{text_col}`").cast("binary").alias("text"))
    counted = rows.select("text").mapInArrow(_count(None if all_terms else vocabulary, markup), "term binary, n long")
    counted = keep(counted.groupBy("term").agg(F.sum("n").alias("n")), "terms")
    known = spark.createDataFrame([(w,) for w in words], "term binary")
    df = {bytes(r["term"]): r["n"] for r in counted.join(F.broadcast(known), "term").collect()}
    lines = (counted.where("term IS NULL").first() or {"n": 0})["n"]
    top = 1 + math.log(1 + lines)
    idf = np.array([1 + math.log((1 + lines) / (1 + df.get(w, 0))) for w in words])
    matrix = np.zeros((len(words) + 1, len(vectors)))
    for k, (_, v) in enumerate(vectors):
        x = np.array([v[w] for w in words]) * idf
        matrix[:-1, k] = x / np.sqrt((x * x).sum()) * idf
    most = math.ceil(max((sum(v.values()) for _, v in vectors), default=0) / threshold**2)
    found = rows.select("row", "text").mapInArrow(_scan(vocabulary, matrix, idf, 1.0 if all_terms else top, threshold, most, markup), "row long, nth long, span long, terms array<struct<term:int,n:bigint>>, others array<struct<word:binary,n:bigint>>")
    found = keep(found.dropDuplicates(["row", "nth", "span"]), "blocks")  # repeated rows share a key
    table = spark.createDataFrame([(k, name, i, float(matrix[i, k])) for k, (name, v) in enumerate(vectors) for i in (vocabulary[w] for w in v)], "template int, license string, term int, weight double")
    idfs = spark.createDataFrame([(i, float(x)) for i, x in enumerate(idf)], "term int, idf double")
    unit = ["row", "nth", "span"]
    each = found.select(*unit, F.explode("terms").alias("t")).select(*unit, "t.*")
    rest = found.select(*unit, F.explode("others").alias("t")).select(*unit, "t.*")
    if all_terms:
        wanted = keep(rest.select(F.col("word").alias("term")).distinct().join(counted, "term").select(F.col("term").alias("word"), (1 + F.log((1 + F.lit(lines)) / (1 + F.col("n")))).alias("idf")), "others")
        rest = rest.join(F.broadcast(wanted) if wanted.count() <= BROADCAST_TERMS else wanted, "word")
    else:
        rest = rest.withColumn("idf", F.lit(top))
    # templates and their terms are a fixed table
    squares = each.join(F.broadcast(idfs), "term").select(*unit, "n", "idf").unionByName(rest.select(*unit, "n", "idf"))
    length = squares.groupBy(*unit).agg(F.sqrt(F.sum((F.col("n") * F.col("idf")) ** 2)).alias("length"))
    dots = each.join(F.broadcast(table), "term").groupBy(*unit, "license", "template").agg(F.sum(F.col("n") * F.col("weight")).alias("dot"))
    cosines = dots.join(length, unit).select(*unit, "license", "template", F.round("dot", 6).alias("dot"), F.round(F.col("dot") / F.col("length"), 9).alias("cosine")).where(F.col("cosine") >= threshold)
    # a template's best block, then the template that explains most
    block = cosines.groupBy("row", "license", "template").agg(F.min(F.struct((-F.col("cosine")).alias("c"), "nth", "span", (-F.col("dot")).alias("d"))).alias("b"))
    best = block.groupBy("row").agg(F.min(F.struct("b.d", "b.c", "b.nth", "b.span", "license")).alias("b")).select("row", "b.license", (-F.col("b.c")).alias("cosine"), (-F.col("b.d")).alias("dot"))
    own = keep(rows.select("row", "id", "at.dir", "at.name").join(best, "row", "left"), "own")
    rank = F.when(F.col("name").rlike(_FILE), 0).when(F.col("name").rlike(r"(?i)^(index(\..*)?)?$"), 1)
    dirs = own.where(F.col("license").isNotNull()).withColumn("rank", rank).where("rank IS NOT NULL")
    dirs = keep(dirs.groupBy("dir").agg(F.min(F.struct("rank", (-F.col("dot")).alias("d"), "license")).alias("b")).select(F.col("dir").alias("d"), F.col("b.license").alias("given")), "dirs")
    few = dirs.count() <= BROADCAST_DIRS
    # "a/b/c/" has the ancestors "a/b/c/", "a/b/" and "a/"
    parts = F.split("dir", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.concat(F.array_join(F.slice(parts, F.lit(1), i), "/"), F.lit("/")))
    asks = own.where("license IS NULL").select("row", F.explode(above).alias("d"))
    nearest = asks.distinct().join(F.broadcast(dirs) if few else dirs, "d").groupBy("row").agg(F.max(F.struct(F.length("d").alias("n"), "d", "given")).alias("b")).select("row", "b.d", "b.given")
    out = own.join(nearest, "row", "left")
    origin = F.when(F.col("license").isNotNull(), "own").when(F.col("given").isNotNull(), "inherited")
    return out.select("id", F.coalesce("license", "given").alias("license"), "cosine", origin.alias("origin"), F.when(F.col("license").isNotNull(), F.col("dir")).otherwise(F.col("d")).alias("dir"))
