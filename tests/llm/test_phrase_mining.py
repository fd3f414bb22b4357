import random
import re
from collections import Counter, defaultdict

import pyarrow as pa
import pytest

from tracelake.llm import phrase_mining as pm

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, least, most, covered):
    f, n = Counter(), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(LOW)):
            w = re.findall(r"[^ \t]+", piece)
            n[lang] += len(w)
            for k in range(1, 5):
                f.update((lang, tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    candidates = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= least}
    dropped = set()
    for (lang, w), a in candidates.items():
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                inside = (lang, w[i : i + k])
                if 100 * a >= covered * candidates[inside]:
                    dropped.add(inside)
    found = defaultdict(list)
    for (lang, w), a in candidates.items():
        if (lang, w) not in dropped:
            cuts = [(2_000_000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w))]
            score, _, left, right = min(cuts)
            found[lang].append((-score, -a, " ".join(w).encode(), left, right))
    return sorted((lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for lang, own in found.items() for i, (s, a, p, left, right) in enumerate(sorted(own)[:most]))


def cases():
    rng = random.Random(4)
    v = ["new", "york", "New", "of", "the", "É", "zé", "a b", "\x1cx", "r"] + [f"w{i}" for i in range(25)]
    passage = "one long passage that many documents share word for word without any change"
    docs = []
    for i in range(220):
        words = [rng.choice(v[:6]) if rng.random() < 0.6 else rng.choice(v) for _ in range(rng.choice([0, 1, 2, 3, 5, 40]))]
        text = "".join(w + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", "\x0b"]) for w in words)
        if i % 9 == 0:
            text += f" {passage} " + rng.choice(["", "again", "x y z"])
        docs.append((rng.choice(["en", "en", "en", "de", None, "und"]), text))
    return docs + [("en", None), ("en", ""), ("fr", " \t "), ("fr", "lone"), ("xx", "New York " * 4000), ("en", passage)] + [("en", docs[9][1])] * 5


@pytest.mark.parametrize(("dictionary", "counted"), [(500_000, 200_000), (0, 3)])
@pytest.mark.parametrize(("least", "most", "covered"), [(6, 2000, 80), (3, 15, 50), (30, 5, 80)])
def test_phrases_equal_brute_force(spark, monkeypatch, dictionary, counted, least, most, covered):
    monkeypatch.setattr(pm, "DICTIONARY", dictionary)
    monkeypatch.setattr(pm, "_COUNTED", counted)
    docs = cases()
    d = spark.createDataFrame(docs, "lang string, text string").repartition(3).selectExpr("*", "1 AS w1", "2 AS word", "3 AS f", "4 AS a", "5 AS phrase")
    got = sorted(tuple(r)[:8] for r in pm.mine_phrases(d, least, most, covered).collect())
    assert got == brute(docs, least, most, covered)


def test_paths_are_as_long_as_what_always_goes_on(spark):
    words = [f"p{i}" for i in range(40)]
    docs = [("en", "x " + " ".join(words) + f" tail{i % 7}") for i in range(20)] + [("en", " ".join(words[20:24]))] * 3
    got = {r["phrase"]: r["path_words"] for r in pm.mine_phrases(spark.createDataFrame(docs, "lang string, text string"), 10, 2000, 80).collect()}
    assert got[" ".join(words[3:7])] == 24  # x p0 .. p22: three more end in p21 p22 p23
    assert got[" ".join(words[30:34])] == 19  # from p21 on
    assert got[" ".join(words[20:24])] == 4


def test_no_documents_no_phrases(spark):
    assert pm.mine_phrases(spark.createDataFrame([], "lang string, text string")).collect() == []
    assert pm.mine_phrases(spark.createDataFrame([("en", "a b c")], "lang string, text string")).collect() == []


@pytest.mark.parametrize("size", [1, 2, 3, 7, 1000])
def test_flows_do_not_depend_on_batches(size):
    rng = random.Random(size)
    rows = []
    for _ in range(300):
        w = [rng.randrange(1, 4) for _ in range(4)]
        cut = rng.choice([2, 3, 4, 4, 4])
        rows.append((*w[:cut], *[0] * (4 - cut), rng.randrange(1, 5)))
    rows.sort()
    batches = (pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows[i : i + size])], names=["w1", "w2", "w3", "w4", "a"]) for i in range(0, len(rows), size))
    got = Counter()
    for b in pm._flows(9)(batches):
        for *w, a in zip(*(c.to_pylist() for c in b.columns)):
            got[tuple(w)] += a
    edges, flows, twos = Counter(), Counter(), Counter()
    for *w, a in rows:
        edges[tuple(w)] += a
        flows[tuple(w[:3])] += a
        twos[tuple(w[:2])] += a
        if w[2] and not w[3]:
            twos[w[1], w[2]] += a
    want = Counter({k: a for k, a in edges.items() if k[3] and a >= 9}) + Counter({(*k, 0): a for k, a in flows.items() if k[2] and a >= 9}) + Counter({(*k, 0, 0): a for k, a in twos.items()})
    assert got == want
