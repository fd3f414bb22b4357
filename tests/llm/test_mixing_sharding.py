import math
import random
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest

from tracelake.llm.mixing import apply_mix, mix_sources
from tracelake.llm.shards import pack_shards, place


def rows(n=600, seed=1):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        source = "hot" if rng.random() < 0.4 else f"s{rng.randrange(6)}"
        text = "copied text here " * 40 if rng.random() < 0.25 else " ".join(f"w{rng.randrange(99)}" for _ in range(rng.choice([0, 1, 20, 100, 700])))
        out.append((i, text, source))
    return out + [(9000, None, None), (9001, "", "void"), (9002, "lone words", None), (5, out[5][1], out[5][2]), (None, "a b", "s1")]


def weights(tokens, a):
    total = sum(tokens.values())
    p = {s: (t / total) ** a for s, t in tokens.items() if t}
    return {s: x / sum(p.values()) for s, x in p.items()}


def brute_exponent(tokens, good):
    lo, hi = 0.0, 1.0
    first = good(weights(tokens, 0.0))
    if good(weights(tokens, 1.0)) == first:
        return 1.0 if first else 0.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if good(weights(tokens, mid)) == first else (lo, mid)
    return lo


@pytest.mark.parametrize(("entropy", "most"), [(0.97, None), (None, 1.5), (0.99, 1.2), (None, None)])
def test_weights_and_budgets(spark, entropy, most):
    data = rows()
    df = spark.createDataFrame(data, "doc_id long, text string, source string").selectExpr("*", "1 AS block", "2 AS tokens", "3 AS id")
    got = mix_sources(df, budget_share=1.0, entropy=entropy, max_epochs=most, block_tokens=700).collect()
    assert sorted((r["id"] is None, r["id"]) for r in got) == sorted((r[0] is None, r[0]) for r in data)
    tokens = Counter()
    for _, text, source in data:
        tokens[source] += len((text or "").split())
    total = sum(tokens.values())
    n = sum(t > 0 for t in tokens.values())
    a = 1.0
    if entropy:
        a = brute_exponent(tokens, lambda w: -sum(x * math.log(x) for x in w.values()) >= entropy * math.log(n))
    if most:
        a = max(a if entropy else 0.0, brute_exponent(tokens, lambda w: max(w[s] * total / tokens[s] for s in w) <= most))
    want = weights(tokens, a)
    drawn, budget, longest = Counter(), {}, Counter()
    for r in got:
        assert r["weight"] == pytest.approx(want.get(r["source"], 0.0), abs=1e-6)
        drawn[r["source"]] += r["copies"] * r["n_tokens"]
        budget[r["source"]] = r["budget"]
        longest[r["source"]] = max(longest[r["source"]], r["n_tokens"])
    for s in tokens:
        assert budget[s] == pytest.approx(want.get(s, 0.0) * total, abs=1)
        assert budget[s] <= drawn[s] < budget[s] + max(1, longest[s])
    # positions lay each source's documents end to end
    for s in tokens:
        own = sorted((r["position"], r["n_tokens"]) for r in got if r["source"] == s)
        at = 0
        for position, k in own:
            assert position == at
            at += k


def test_mix_keeps_all_without_budget(spark):
    data = [r for r in rows() if r[1] and r[1].split() and r[0] is not None]
    df = spark.createDataFrame(data, "doc_id long, text string, source string")
    out = Counter(r["doc_id"] for r in apply_mix(df, max_epochs=2.0).collect())
    assert set(out) == {r[0] for r in data}
    assert max(out.values()) <= 4  # id 5 is there twice
    assert apply_mix(df.limit(0), max_epochs=2.0).count() == 0


@pytest.mark.parametrize("cell", [20_000, 50])
def test_shards(spark, cell):
    data = rows(900, 4)
    df = spark.createDataFrame(data, "doc_id long, text string, source string").selectExpr("*", "1 AS shard", "2 AS size", "3 AS key")
    got = pack_shards(df, shards=6, cell_rows=cell).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in data)
    text = {r[0]: r[1] for r in data}
    slots, size, n, where = defaultdict(list), Counter(), Counter(), defaultdict(set)
    for r in got:
        t = text[r["doc_id"]]
        assert r["size"] == len((t or "").encode()) + 8
        assert r["text_crc32"] == zlib.crc32((t or "").encode())
        assert r["law"] == "bytes" and r["grown_shard"] is None
        slots[r["shard"]].append(r["slot"])
        size[r["shard"]] += r["size"]
        n[r["shard"]] += 1
        where[t].add(r["shard"])
    assert set(slots) == set(range(6))
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert max(size.values()) <= 1.1 * min(size.values())
    assert max(n.values()) <= 1.35 * min(n.values())
    assert all(len(x) == 1 for t, x in where.items() if t and not t.startswith("copied text"))


@pytest.mark.parametrize("first", [0, 2])
def test_placing_equals_the_greedy_rule(first):
    """Each item to the highest dot product with what is left, of those it fits; in sixty-fourths, so that sums are exact and ties are ties."""
    rng = random.Random(9)
    items = [[Fraction(rng.randrange(0, 9), 64) for _ in range(3)] for _ in range(120)]
    shards = 5
    left, want = [[Fraction(1)] * 3 for _ in range(shards)], []
    for item in items:
        fits = [i for i in range(shards) if all(a >= b for a, b in zip(left[i], item, strict=True))] or range(shards)
        best = max(sorted(fits, key=lambda i: (i - first) % shards), key=lambda i: sum(a * b for a, b in zip(left[i], item, strict=True)))
        left[best] = [a - b for a, b in zip(left[best], item, strict=True)]
        want.append(best)
    assert place(np.array([[float(x) for x in item] for item in items]), np.ones((shards, 3)), first).tolist() == want


def test_ties_and_long_texts_have_shards(spark):
    data = [(i, "same size " + chr(97 + i % 26) * 3, "s") for i in range(260)] + [(900, "long " * 200_000, "s")]
    got = pack_shards(spark.createDataFrame(data, "doc_id long, text string, source string"), shards=4).collect()
    assert len(got) == len(data) and {r["shard"] for r in got} == {0, 1, 2, 3}
    assert sorted(r["size"] for r in got)[-1] == 1_000_008
    again = pack_shards(spark.createDataFrame(data[::-1], "doc_id long, text string, source string"), shards=4).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_shards_of_nothing_and_one(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert pack_shards(df).count() == 0
    one = spark.createDataFrame([(1, None)], "doc_id long, text string")
    assert [(r["size"], r["slot"]) for r in pack_shards(one).collect()] == [(8, 0)]


def test_sizes_are_near_equal(spark):
    """Thousands of documents of very different lengths, with groups of copies, and 24 shards."""
    rng = random.Random(12)
    rows = [(i, " ".join(f"w{rng.randrange(999)}" for _ in range(int(rng.lognormvariate(4, 1))))) for i in range(6000)] + [(7000 + i, "one text that many rows share") for i in range(1500)]
    got = pack_shards(spark.createDataFrame(rows, "doc_id long, text string"), shards=24).collect()
    size, n = Counter(), Counter()
    for r in got:
        size[r["shard"]] += r["size"]
        n[r["shard"]] += 1
    assert len(got) == len(rows) and len(size) == 24
    assert max(size.values()) <= 1.01 * min(size.values())
    assert max(n.values()) <= 1.02 * min(n.values())
