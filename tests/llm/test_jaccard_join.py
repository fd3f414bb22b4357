import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracelake.llm import jaccard_join
from tracelake.llm.components import connected_components
from tracelake.llm.jaccard_join import _join_region, keep_first, ngram_jaccard_join, split_hot
from tracelake.llm.scratch import keep


def brute(rows, width=4, percent=85):
    sets = []
    for doc, text in rows:
        raw = (text or "").encode().lower().split()
        sets.append((doc, {tuple(raw[i : i + width]) for i in range(len(raw) - width + 1)} if len(raw) >= width else ({tuple(raw)} if raw else set())))
    up = {d: d for d, _ in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                r, s = root(a), root(b)
                up[max(r, s)] = min(r, s)
    return sorted((d, len(x), root(d)) for d, x in sets)


def texts(seed=0, n=120):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    base = [[rng.choice(vocabulary) for _ in range(rng.choice([3, 5, 9, 30, 60, 120]))] for _ in range(n // 4)]
    passage = [rng.choice(vocabulary) for _ in range(50)]
    out = []
    for i in range(n):
        words = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 4])):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        if rng.random() < 0.3:
            words[2:2] = passage
        out.append((i, " ".join(words)))
    hot = [rng.choice(vocabulary) for _ in range(300)]
    for i in range(n, n + 60):
        words = list(hot)
        for _ in range(rng.randrange(9)):
            words[rng.randrange(300)] = rng.choice(vocabulary)
        out.append((i, " ".join(words)))
    return out + [(5000, None), (5001, ""), (5002, " \t\n"), (5003, "A b"), (5004, "a  B"), (5005, "É b"), (5006, "é b"), (5007, "x y z")]


@pytest.mark.parametrize("limit", [8_000_000, 15_000])
def test_equals_brute_force(spark, limit):
    rows = texts(limit % 7)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, ngram_jaccard_join(df, shingle=4, percent=85, region_shingles=limit).collect()))
    assert got == brute(rows)


def test_rounds_do_not_grow_with_unlinked_texts_of_one_boilerplate(spark, monkeypatch):
    """Texts of one template, each with a seventh of its own words: none link, all are equally far apart, and no text is a useful pivot."""
    rng = random.Random(5)
    template = [f"t{i}" for i in range(120)]
    rows = []
    for i in range(300):
        rows.append((i, " ".join([*template, *(f"own{i}x{j}" for j in range(18 + i % 3))])))
    for i in range(40):  # near copies of some of them, and a chain in order of ids
        words = rows[i * 3][1].split()
        words[rng.randrange(len(words))] = f"new{i}"
        rows.append((1000 + i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    kept = []
    monkeypatch.setattr(jaccard_join, "TILED", 1)
    monkeypatch.setattr(jaccard_join, "keep", lambda df, name: kept.append(name) or keep(df, name))
    got = sorted(map(tuple, ngram_jaccard_join(df, shingle=4, percent=85, region_shingles=30_000).collect()))
    assert got == brute(rows) and len({c for _, _, c in got}) > 200
    assert 1 <= kept.count("cells") <= 3


def test_tiles_are_exact(spark, monkeypatch):
    rows = texts(4)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    tokens = {w: i for i, w in enumerate({tuple(t.encode().lower().split()[i : i + 4]) for _, t in rows for i in range(len((t or "").split()) - 3)})}
    sets = [(d, sorted({tokens[tuple(t.encode().lower().split()[i : i + 4])] for i in range(len(t.split()) - 3)})) for d, t in rows if len((t or "").split()) >= 4]
    table = spark.createDataFrame([(d, len(x), bytearray(np.array(x, np.uint64).tobytes())) for d, x in sets], "doc long, n long, shingles binary")
    hot = table.select(F.lit(1).cast("long").alias("region"), "doc")
    for rounds, tiled in ((0, 1), (1, 1), (6, 1), (1, 9)):
        monkeypatch.setattr(jaccard_join, "TILED", tiled)
        left, links = split_hot(hot, table, 85, 20_000, rounds)
        found = left.join(table.select("doc", "shingles"), "doc").groupBy("region").applyInArrow(_join_region(85), "a long, b long")
        for x in links:
            found = found.unionByName(x)
        labels = dict(map(tuple, connected_components(found).collect()))
        assert [labels.get(d, d) for d, _ in sets] == [c for d, _, c in brute([r for r in rows if r[0] in dict(sets)])]
    assert df.count() == len(rows)


@pytest.mark.parametrize("last", [0, 100_000])
def test_a_chain_in_order_of_ids_takes_few_rounds(spark, last):
    chain = spark.range(3000).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    began = time.time()
    got = connected_components(chain, last_links=last)
    assert got.count() == 3001 and got.agg(F.max("component")).first()[0] == 0 and time.time() - began < 120


def test_first_of_each_group_stays(spark):
    rows = [(1, "a b c d e", "x"), (1, "a b c d e", "w"), (1, "p q r s t u", "y"), (2, "a b c d e", "z"), (None, "a b c d e", "n"), (3, None, "m"), (3, "", "m"), (4, "p q r s t u", "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, __id string")
    got = sorted((tuple(r) for r in keep_first(df.withColumnRenamed("__id", "first")).collect()), key=str)
    assert got == sorted([(1, "a b c d e", "w"), (1, "p q r s t u", "y"), (None, "a b c d e", "n"), (3, None, "m"), (3, "", "m")], key=str)


def test_empty_repeated_and_clashing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert ngram_jaccard_join(empty).collect() == []
    rows = [(1, "a b c d e", "x"), (1, "a b c d e", "y"), (2, "q r s t u", None), (1, "q r s t u", "z"), (None, "a b c d e", "n"), (9, "k", "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, doc string")
    got = sorted(map(tuple, ngram_jaccard_join(df, shingle=4, percent=85).collect()), key=str)
    assert got == sorted([(1, 2, 1), (1, 2, 1), (1, 2, 1), (2, 2, 1), (None, 2, None), (9, 1, 9)], key=str)
