import random
import re

import pytest

from tracelake.llm import decontaminate as dec
from tracelake.llm.quality_rules import host_quality, keep_good

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_hits(docs, items, width=13):
    windows = {}
    for item, text in items:
        w = WORD.findall((text or "").encode().lower())
        m = min(width, len(w))
        for i in range(len(w) - m + 1) if m else ():
            windows.setdefault(tuple(w[i : i + m]), set()).add(str(item))
    out = []
    for doc, text in docs:
        w = WORD.findall((text or "").encode().lower())
        hit, found = set(), set()
        for key, of in windows.items():
            for i in range(len(w) - len(key) + 1):
                if tuple(w[i : i + len(key)]) == key:
                    hit |= set(range(i, i + len(key)))
                    found |= of
        out.append((doc, len(w), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out)


def cases():
    rng = random.Random(3)
    v = [f"w{i}" for i in range(60)] + ["É", "é", "Zed", "x1"]
    items = [(i, " ".join(rng.choice(v) for _ in range(rng.choice([0, 1, 2, 5, 13, 20])))) for i in range(12)] + [(77, None), (78, "")]
    docs = []
    for i in range(80):
        words = [rng.choice(v) for _ in range(rng.choice([0, 1, 4, 30, 200]))]
        if i % 3 == 0:
            at = rng.randrange(len(words) + 1)
            words[at:at] = rng.choice(items)[1].upper().split() if rng.random() < 0.5 else (items[8][1] or "").split()[1:]
        docs.append((i, rng.choice([" ", ", ", "\n"]).join(words)))
    return docs + [(900, None), (901, "!!"), (902, docs[3][1])], items


@pytest.mark.parametrize(("size", "most"), [(2**20, 20_000), (64, 0)])
def test_hits_equal_brute_force(spark, monkeypatch, size, most):
    monkeypatch.setattr(dec, "BITMAP_BYTES", size)
    monkeypatch.setattr(dec, "BROADCAST_WINDOWS", most)
    docs, items = cases()
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS k", "2 AS id", "3 AS items")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((r["id"], r["n_words"], r["n_hit"], r["items"], r["contaminated"]) for r in dec.contamination(d, b).collect())
    assert got == brute_hits(docs, items)
    kept = {r["doc_id"] for r in dec.decontaminate(d, b).collect()}
    assert kept == {r[0] for r in brute_hits(docs, items) if not r[4]}


def test_windows_of_items_without_an_id_hit_but_are_not_listed(spark):
    rng = random.Random(1)
    long = " ".join(f"n{rng.randrange(10**6)}" for _ in range(20))
    items = [(None, long), (1, "one two"), (None, "one two"), *((i, "shared by many") for i in range(50, 90))]
    docs = [(1, long), (2, "x one two y"), (3, "is shared by many"), (4, "clean"), (4, "clean")]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = sorted((r["id"], r["n_hit"], r["items"]) for r in dec.contamination(d, b).collect())
    assert got == [(1, 20, []), (2, 2, ["1"]), (3, 3, [str(i) for i in range(50, 90)]), (4, 0, []), (4, 0, [])]


def test_spans_are_cut(spark):
    b = spark.createDataFrame([(1, "a b c d e f g h i j k l m"), (2, "zz")], "item_id long, text string")
    d = spark.createDataFrame([(1, "- one, A b c d e f g h i j k l M. two zz! three"), (2, None), (3, "clean"), (4, "")], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in dec.decontaminate(d, b, remove="spans").collect()}
    assert got == {1: "- one, two three", 2: None, 3: "clean", 4: ""}


def test_empty_benchmark_table_and_repeats(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    d = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "a")], "doc_id long, text string")
    assert sorted((r["n_words"], r["n_hit"], r["contaminated"]) for r in dec.contamination(d, none).collect()) == [(1, 0, False), (2, 0, False), (2, 0, False)]
    assert dec.contamination(d.limit(0), none).count() == 0


def brute_features(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    three = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    rep = {i + j for i, x in enumerate(three) if three.count(x) > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(rep)


def test_features_equal_brute_force(spark):
    rng = random.Random(5)
    rows = [(i, "".join(rng.choice(["a", "b", "ab", " ", " ", "\n", "#", "é", " ", "😀", "\t", "|"]) for _ in range(rng.choice([0, 3, 40, 300]))), f"h{i % 3}") for i in range(60)]
    rows += [(100, None, None), (101, "", "h1"), (102, "x y z " * 4000, "h1"), (102, "x y z " * 4000, "h1")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 AS host", "2 AS n_words")
    got = sorted((r["doc_id"], *(r["__quality"][c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))) for r in host_quality(df, carry=["doc_id"]).collect())
    assert got == sorted((d, *brute_features(t)) for d, t, _ in rows)
    assert host_quality(df.limit(0)).count() == 0


def test_bad_host_takes_its_documents(spark):
    good = lambda i: " ".join(f"word{i}x{j}" for j in range(60))
    rows = [(i, good(i), "fine") for i in range(200)] + [(1000 + i, good(i) if i % 10 == 0 else "short", "farm") for i in range(200)] + [(3000 + i, good(i), f"h{i % 20}") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = keep_good(df)
    assert kept.columns == df.columns
    assert {r["doc_id"] for r in kept.collect()} == {r[0] for r in rows if r[2] != "farm"}
