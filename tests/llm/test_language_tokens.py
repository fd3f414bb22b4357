import itertools
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tracelake.llm import language_id as lid
from tracelake.llm.token_counts import VOCABULARY, LongestMatch, count_tokens, read_vocabulary

SYLLABLES = {"xx": ["tha", "sh", "ing", "ou"], "yy": ["éa", "eux", "oi", "que"], "zz": ["привет", "мир", "да", "нет"]}


def text(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 AS held_out", "'s' AS source")


def test_held_out_accuracy_spans_and_odd_texts(spark):
    rng = random.Random(2)
    rows = [(i, text(rng, lang, rng.choice([3, 40, 200])), lang) for i, lang in enumerate(itertools.islice(itertools.cycle(SYLLABLES), 240))]
    mixed = text(rng, "xx", 12) + " " + text(rng, "zz", 30) + " " + text(rng, "yy", 15)
    rows += [(1000, mixed, None), (1001, None, "xx"), (1002, "", "xx"), (1003, "12 -- 3!", "yy"), (1004, "你好", None), (None, text(rng, "yy", 9), "yy"), (3, rows[3][1], rows[3][2])]
    got = {r["id"]: r for r in lid.identify_languages(table(spark, rows)).collect()}
    held = [(i, lang) for i, _, lang in rows if i is not None and i < 240 and got[i]["held_out"]]
    assert 30 < len(held) < 90
    assert sum(got[i]["lang_pred"] == lang for i, lang in held) >= 0.97 * len(held)
    assert [(s["first"], s["end"], s["lang"]) for s in got[1000]["spans"]] == [(0, 12, "xx"), (12, 42, "zz"), (42, 57, "yy")]
    assert got[1000]["lang_pred"] == "zz" and got[1000]["score"] == pytest.approx(30 / 57)
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (1001, 1002, 1003))
    assert got[1004]["lang_pred"] in SYLLABLES and not got[None]["held_out"]


def test_nothing_to_learn_and_no_rows(spark):
    rows = [(1, "some words", None)]
    assert [(r["lang_pred"], r["score"]) for r in lid.identify_languages(table(spark, rows)).collect()] == [("und", 0.0)]
    assert lid.identify_languages(table(spark, []).limit(0)).count() == 0


@given(st.lists(st.integers(0, 7), min_size=1, max_size=6), st.integers(0, 10**6), st.floats(0, 3))
@settings(max_examples=40, deadline=None)
def test_viterbi_is_the_best_path(lengths, seed, penalty):
    rng = np.random.default_rng(seed)
    model = lid.LanguageModel(["a", "b", "c"], rng.normal(size=(3, 50)).astype(np.float32), np.ones((10, 3), bool), penalty)
    texts = [" ".join("".join(rng.choice(list("abcde"), rng.integers(1, 4))) for _ in range(n)) for n in lengths]
    labels, first = lid.word_labels(texts, model)
    for t, s, e in zip(texts, first[:-1], first[1:], strict=True):
        if not t:
            assert s == e
            continue
        data, _ = lid._encode([t])
        words = lid._word_starts(data)
        bucket, at = lid._triples(data, 50)
        score = np.array([[own[bucket[(at >= a) & (at < b)]].sum() for own in model.scores] for a, b in zip(words, [*words[1:], len(data)], strict=True)])
        value = lambda path: sum(score[i, x] for i, x in enumerate(path)) - penalty * sum(x != y for x, y in itertools.pairwise(path))
        best = max(value(p) for p in itertools.product(range(3), repeat=len(words)))
        assert value([int(x) for x in labels[s:e]]) == pytest.approx(best, abs=1e-4)


def greedy(word, pieces):
    word, n = b" " + word, 0
    while word:
        word = word[next(k for k in range(len(word), 0, -1) if k == 1 or word[:k] in pieces) :]
        n += 1
    return n


@given(st.sets(st.binary(min_size=1, max_size=5), max_size=30), st.lists(st.binary(min_size=1, max_size=12), max_size=20))
@settings(max_examples=200, deadline=None)
def test_longest_match_equals_greedy(pieces, words):
    pieces = {bytes(97 + b % 3 if b != 32 else 32 for b in x) for x in pieces}
    words = [bytes(97 + b % 3 for b in x) for x in words]
    count = LongestMatch(pieces)
    assert [count[w] for w in words] == [greedy(w, pieces) for w in words]


def test_token_counts_of_texts(spark):
    rows = [(1, "The quick  brown\tfox, naïve 你好 ünïcödé\n"), (2, None), (3, ""), (4, " \n"), (1, "The quick"), (None, "internationalization " * 300)]
    pieces = set(read_vocabulary(VOCABULARY))
    got = sorted((tuple(r) for r in count_tokens(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS n_words")).collect()), key=str)
    want = sorted(((i, len((t or "").encode().split()), sum(greedy(w, pieces) for w in (t or "").encode().split())) for i, t in rows), key=str)
    assert got == want
    assert count_tokens(spark.createDataFrame([], "doc_id long, text string")).count() == 0
