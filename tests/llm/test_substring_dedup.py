import hashlib
import random
from collections import Counter

import pytest

from tracelake.llm.substring_dedup import FingerprintIndex, dedup_batch, substring_dedup


def brute(rows, width):
    return brute_of(rows, rows, width)


def brute_of(rows, every, width):
    """``rows`` judged on ``every``, which holds them."""
    words = [(text or "").encode().split() for _, text in every]
    seen = Counter(tuple(w[i : i + width]) for w in words for i in range(len(w) - width + 1))
    out = []
    for doc, text in rows:
        w = (text or "").encode().split()
        gone = {i + j for i in range(len(w) - width + 1) if seen[tuple(w[i : i + width])] > 1 for j in range(width)}
        left = [x for i, x in enumerate(w) if i not in gone]
        out.append((doc, len(w), len(gone), hashlib.sha256(b" ".join(left)).hexdigest()))
    return sorted(out, key=str)


def texts(seed):
    rng = random.Random(seed)
    v = [f"w{i}" for i in range(50)] + ["é", " x", "A", "a"]
    base = [[rng.choice(v) for _ in range(rng.choice([5, 12, 40, 150]))] for _ in range(12)]
    passages = [[rng.choice(v) for _ in range(n)] for n in (9, 10, 11, 25, 60)]
    rows = []
    for i in range(90):
        w = list(rng.choice(base)) if rng.random() < 0.5 else [rng.choice(v) for _ in range(rng.choice([0, 3, 30, 100]))]
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(w) + 1)
            w[at:at] = rng.choice(passages)
        if w and rng.random() < 0.3:
            w[rng.randrange(len(w))] = "changed"
        rows.append((i, rng.choice([" ", "\n", " \t "]).join(w)))
    return rows + [(500, None), (501, ""), (502, "a " * 40), (503, "a b " * 30), (504, "x a b c " * 3), (505, rows[3][1]), (505, rows[3][1]), (505, "other words"), (None, rows[4][1])]


@pytest.mark.parametrize(("seed", "width", "gram", "batches"), [(1, 10, 4, 1), (2, 10, 4, 3), (3, 35, 8, 2)])
def test_equals_brute_force(spark, seed, width, gram, batches):
    rows = texts(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS doc", "'x' AS spans")
    got = substring_dedup(df, width=width, gram=gram, batches=batches)
    assert sorted((tuple(r)[:4] for r in got.collect()), key=str) == brute(rows, width)


def test_history_finds_what_an_earlier_batch_had(spark):
    long = " ".join(f"w{i}" for i in range(80))
    make = lambda rows: spark.createDataFrame(rows, "doc long, t64 long, text binary")
    with FingerprintIndex(spark, buckets=3) as index:
        index.add(make([(1, 1, long.encode())]))
        assert [x.count() for x in index.repeated()] == [0, 0]
        run = index.add(make([(2, 2, ("new " + long).encode()), (3, 3, b"short")]))
        same, mixed = index.repeated(run)
        assert same.count() > 0 and {r["doc"] for r in mixed.collect()} <= {1, 2}
        index.add(make([]))
        assert index.repeated()[0].count() == same.count()
        names = [*index.runs, index.history]
    assert not any(spark.catalog.tableExists(n) for n in names)


def test_batches_against_kept_history(spark):
    width = 10
    rows = texts(5)
    parts = [[r for i, r in enumerate(rows) if i % 3 == k] for k in range(3)]
    make = lambda part: spark.createDataFrame(part, "doc_id long, text string")
    with FingerprintIndex(spark, width, 4, buckets=3) as index:
        for k, part in enumerate(parts):
            before = [r for p in parts[:k] for r in p]
            got = dedup_batch(index, make(part), make(before) if before else None)
            assert sorted((tuple(r)[:4] for r in got.collect()), key=str) == brute_of(part, [*before, *part], width)
        assert dedup_batch(index, make([]), make(rows)).count() == 0


def test_empty_table(spark):
    assert substring_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0
