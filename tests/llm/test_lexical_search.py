import math
import random
import re
from collections import Counter

import pytest

from tracelake.llm import lexical_search as ls

TERM = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def brute(docs, items, k):
    low = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
    of = lambda t: TERM.findall((t or "").encode().translate(low))
    bags = [(d, Counter(of(t))) for d, t in docs]
    bags = [(d, c) for d, c in bags if c]
    n_docs, total = len(bags), sum(c.total() for _, c in bags)
    df = Counter(t for _, c in bags for t in c)
    out = []
    for item, text in items:
        scored = []
        for d, c in bags:
            m = 100 - 50 + (50 * c.total() * n_docs) // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 20 * m)) for t in set(of(text)) if c[t])
            if s > 0:
                scored.append((-s, d is not None, d or 0, d))
        out += [(item, i + 1, x[3], -x[0]) for i, x in enumerate(sorted(scored, key=lambda x: x[:3])[:k])]
    return sorted(out, key=repr)


def cases():
    rng = random.Random(8)
    rare, common = [f"r{i}" for i in range(300)], ["the", "of", "É", "zwei", "9"]
    text = lambda n: rng.choice([" ", ", ", "_"]).join(rng.choice(common if rng.random() < 0.7 else rare) for _ in range(n))
    docs = [(i, text(rng.choice([0, 1, 3, 20, 90]))) for i in range(260)]
    docs += [(d + 1000, docs[40][1]) for d in range(30)] + [(5, docs[6][1]), (5, docs[6][1]), (None, docs[40][1]), (900, None), (901, ""), (902, "!?"), (903, "The " * 30_000 + "r7")]
    items = [(i, text(rng.choice([1, 4, 30]))) for i in range(25)] + [(3, "the THE of r1"), (None, "r5 r6"), (70, None), (71, ""), (72, "unknown"), (73, docs[40][1])]
    return docs, items


@pytest.mark.parametrize(("block", "pairs", "owners"), [(2048, 500_000, ls.OWNERS), (16, 60, (0.1, 0.5, 1.0)), (64, 500_000, (1.0,)), (7, 100, (0.01, 0.02, 0.2, 0.3, 1.0))])
def test_ranks_equal_brute_force(spark, monkeypatch, block, pairs, owners):
    monkeypatch.setattr(ls, "BLOCK_DOCS", block)
    monkeypatch.setattr(ls, "BUNDLE_PAIRS", pairs)
    monkeypatch.setattr(ls, "OWNERS", owners)
    docs, items = cases()
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3).selectExpr("*", "1 AS row", "2 AS item", "3 AS block", "4 AS score")
    q = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS row", "2 AS item", "3 AS terms")
    got = sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in ls.ranked_search(d, q, k=10).collect()), key=repr)
    assert got == brute(docs, items, 10)


def test_accumulators_stay_sparse(spark, monkeypatch):
    """Common terms do not make a pair of every item and document."""
    sizes = []
    first = ls._first
    monkeypatch.setattr(ls, "_first", lambda acc, k: sizes.append(acc.count()) or first(acc, k))
    docs = [(i, f"the of and r{i % 200} r{i % 200} s{i}") for i in range(4000)]
    items = [(i, f"the of and r{i} s{i}") for i in range(20)]
    ls.ranked_search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), k=5).collect()
    assert max(sizes) < 20 * 4000 / 20


def test_empty_tables(spark):
    none = lambda c: spark.createDataFrame([], f"{c} long, text string")
    one = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert ls.ranked_search(none("doc_id"), one.withColumnRenamed("doc_id", "item_id")).collect() == []
    assert ls.ranked_search(one, none("item_id")).collect() == []
