import math
import random
import re
from collections import Counter, defaultdict

import pytest

from tracelake.operators import search


def brute(queries, docs, k, only=None):
    words = lambda t: re.findall(r"[a-z0-9一-鿿]{2,}", (t or "").lower())
    bags = {d: Counter(words(t)) for d, t in docs}
    n, avg = len(bags), sum(c.total() for c in bags.values()) / max(1, len(bags)) or 1.0
    df = Counter(t for c in bags.values() for t in c)
    out = []
    for q, text in queries:
        scores = defaultdict(float)
        for t in set(words(text)):
            idf = max(math.log(max(n - df[t] + 0.5, 1e-300) / (df[t] + 0.5)), 1e-6)
            for d, c in bags.items():
                if c[t] and (only is None or d in only):
                    scores[d] += idf * c[t] * 2.2 / (c[t] + 1.2 * (0.25 + 0.75 * c.total() / avg))
        best = sorted((-round(s, 6), d) for d, s in scores.items())[:k]
        out += [(q, d, i + 1, -s, 1 - i / len(best)) for i, (s, d) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize(("queries_a_block", "docs_a_block", "held"), [(4096, 512, 400_000), (5, 16, 50)])
def test_bm25_equals_brute_force(spark, monkeypatch, queries_a_block, docs_a_block, held):
    monkeypatch.setattr(search, "QUERY_BLOCK", queries_a_block)
    monkeypatch.setattr(search, "INDEX_BLOCK", docs_a_block)
    monkeypatch.setattr(search, "CANDIDATES", held)
    rng = random.Random(2)
    v = ["the", "The", "of", "日本", "x"] + [f"w{i}" for i in range(60)]
    text = lambda n: " ".join(rng.choice(v[:5]) if rng.random() < 0.6 else rng.choice(v) for _ in range(n))
    docs = [(i, text(rng.choice([0, 1, 10, 60]))) for i in range(200)] + [(900, None), (901, ""), (902, "the " * 5000)] + [(300 + i, "w1 w2 the") for i in range(20)]
    queries = [(i, text(rng.choice([1, 3, 12]))) for i in range(20)] + [(80, None), (81, ""), (82, "unknownword")]
    d, q = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(queries, "query_id long, text string")
    near = lambda rows: sorted((r["query_id"], r["doc_id"], r["rank"], round(r["score"], 6), r["signal"]) for r in rows.collect())
    want = brute(queries, docs, 7)
    assert [(a[0], a[2], a[4]) for a in near(search.bm25(q, d, 7))] == [(a[0], a[2], a[4]) for a in want]
    assert sorted(near(search.bm25(q, d, 7))) == want
    only = {i for i in range(0, 320, 3)}
    assert near(search.bm25(q, d, 7, only=spark.createDataFrame([(i,) for i in only], "doc_id long"))) == brute(queries, docs, 7, only)
    assert search.bm25(q, d.limit(0), 7).collect() == [] and search.bm25(q.limit(0), d, 7).collect() == []
