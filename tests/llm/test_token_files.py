import pickle
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tracelake.llm import token_files as tf
from tracelake.llm.simple8b import SELECTORS, pack, unpack

public = pytest.importorskip("public_tokenizers")
PATH = public.path(tf.TOKENIZER)

ODD = [
    "a  b", "a \n b", "  x", " ", "", "\n\n a\tb    c 　 d", "it's 'll  's.x,y", "<|endoftext|> a <|endoftext|>. b", "a  b \x1c c \x85 d", "日本 語 ", "x\r\n y  ", "\nA\n\nB \nC.\n\nd",
    " é  à é.\né. \nX! ?", "don't, we'll. 'S\n'tis", " x  y", "é a² bⅧ", "0 12,5 a1.b2", "\x00 \x00a\x00",
]


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def coded(encode, texts):
    ids, starts = encode(pa.array(texts, pa.string()))
    return [ids[a:b].tolist() for a, b in zip(starts, starts[1:])]


@pytest.fixture(scope="module")
def encoder():
    with open(PATH, encoding="utf-8") as file:
        return tf.Encoder(file.read())


def test_stretches_give_the_library_ids(encoder):
    assert coded(encoder, ODD) == [e.ids for e in library().encode_batch(ODD, add_special_tokens=False)]
    assert coded(encoder, []) == []
    assert coded(encoder, ["", ""]) == [[], []]
    encoder._forget()
    assert coded(encoder, ODD[::-1]) == [e.ids for e in library().encode_batch(ODD[::-1], add_special_tokens=False)]


@settings(max_examples=150, deadline=None)
@given(texts=st.lists(st.text(alphabet=st.sampled_from("aZé .,!?\n\t' 　\x1c1²日s"), max_size=30), max_size=4))
def test_any_text_gives_the_library_ids(encoder, texts):
    assert coded(encoder, texts) == [e.ids for e in library().encode_batch(texts, add_special_tokens=False)]


@settings(max_examples=150, deadline=None)
@given(runs=st.lists(st.tuples(st.integers(0, 64), st.integers(1, 150)), max_size=12), block=st.sampled_from([1, 7, 64, 1024]), seed=st.integers(0, 99))
def test_packing_comes_back(runs, block, seed):
    rng = np.random.default_rng(seed)
    values = np.concatenate([np.zeros(0, np.uint64)] + [np.array([int(rng.integers(0, 2**63)) >> max(0, 63 - w) | (1 << 63 if w == 64 else 0) for _ in range(n)], np.uint64) for w, n in runs])
    words, blocks, escapes = pack(values, block)
    assert (unpack(words, escapes) == values).all()
    assert len(escapes) == (values >= np.uint64(1 << 60)).sum()
    for k in range(len(blocks)):
        last = (len(words), len(escapes)) if k + 1 == len(blocks) else blocks[k + 1]
        assert (unpack(words[blocks[k][0] : last[0]], escapes[blocks[k][1] : last[1]]) == values[k * block : (k + 1) * block]).all()


def test_common_stretches_outlive_rare_ones(monkeypatch):
    """However many different words pass through, the library is given those of most batches only once or twice."""
    with open(PATH, encoding="utf-8") as file:
        encoder = tf.Encoder(file.read())
    monkeypatch.setattr(tf, "_KEPT_BYTES", 60_000)
    asked, library_ids = [], encoder._library

    def counted(texts):
        asked.extend(texts)
        return library_ids(texts)

    monkeypatch.setattr(encoder, "_library", counted)
    common, letters = [f" common{c}x" for c in "abcdefghij"], np.array(list("abcdefghijklmnopqrstuvwxyz"))
    rng, whole, most = np.random.default_rng(3), library(), 0
    for _ in range(30):
        rare = [" " + "".join(rng.choice(letters, 8)) for _ in range(150)]
        texts = ["".join(common + rare), "".join(rare[:20] + common), "x,\n é" + rare[0]]
        assert coded(encoder, texts) == [e.ids for e in whole.encode_batch(texts, add_special_tokens=False)]
        most = max(most, encoder.held)
    assert all(sum(row.count(c) for row in asked) <= 2 for c in common)
    assert most < 60_000 + 200 * 200


def test_letters_end_before_any_sign(encoder):
    """Each letter up to U+023F before each visible character of ASCII, and each of those after a line end, gives the library's ids and few stretches."""
    signs = [chr(c) for c in range(0x21, 0x7F)]
    letters = [chr(c) for c in range(0x41, 0x240) if chr(c).isalpha()] + ["×", "÷", "²", "ª", "\x80"]
    texts = ["".join(f"{a}{b}s{b}\n{b}{a}\n{a}" for b in signs) for a in letters]
    assert coded(encoder, texts) == [e.ids for e in library().encode_batch(texts, add_special_tokens=False)]
    text = np.frombuffer("año###señor-y(tú)9 más\n- no".encode(), np.uint8)
    assert [x.tobytes().decode() for x in np.split(text, np.flatnonzero(tf._borders(text)))] == ["año", "###señor", "-y", "(tú", ")9", " más", "\n", "-", " no"]


def greedy(values):
    """The packing rule in plain loops: number of words."""
    i = n = 0
    while i < len(values):
        fits = [c for s, (c, w) in enumerate(SELECTORS) if s != 1 and i + c <= len(values) and all(v < 1 << w for v in values[i : i + c])]
        i += max(fits, default=1)
        n += 1
    return n


def test_selectors_are_taken_greedily():
    rng = np.random.default_rng(5)
    values = np.concatenate([rng.integers(0, 1 << w, n) for w, n in [(0, 500), (1, 130), (3, 70), (16, 40), (40, 9), (12, 33), (62, 3), (0, 239)]]).astype(np.uint64)
    assert len(pack(values, 1 << 20)[0]) == greedy([int(v) for v in values])
    for block in (1, 64, 300):
        assert len(pack(values, block)[0]) == sum(greedy([int(v) for v in values[i : i + block]]) for i in range(0, len(values), block))


def test_files_hold_every_document_in_order(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tf, "FRAME_IDS", 50)
    monkeypatch.setattr(tf, "FRAMES_A_FILE", 2)
    rng = np.random.default_rng(2)
    rows = [(int(i), ODD[i % len(ODD)] * int(rng.integers(1, 4))) for i in rng.permutation(300)] + [(7, "twice"), (7, "twice"), (None, "no id"), (5000, None), (400, "word " * 20_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5).selectExpr("*", "1 AS row", "2 AS h", "3 AS part", "4 AS ids")
    got = [(r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in tf.token_ids(docs).orderBy("start").collect()]
    assert [g[0] for g in got] == sorted((r[0] for r in rows), key=lambda d: (d is not None, d))
    assert [g[1] for g in got] == np.concatenate([[0], np.cumsum([g[2] for g in got])[:-1]]).tolist()
    whole = library()
    want = sorted((d is not None, d, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))) for d, t in rows for ids in [whole.encode(t or "", add_special_tokens=False).ids + [0]])
    assert sorted((g[0] is not None, g[0], g[2], g[3]) for g in got if g[0] is not None) == [w for w in want if w[1] is not None]
    path = str(tmp_path / "ids")
    tf.write_token_files(docs, path, end_id=9)
    names = sorted(x for x in (tmp_path / "ids").iterdir() if x.name.startswith("part"))
    assert len(names) > 4
    seen = []
    for name in names:  # files in order of their names hold documents in order; blocks decode on their own
        for parts in tf.frames(name.read_bytes()):
            ids = np.concatenate([tf.decode_block(parts, k) for k in range(len(parts[2]))])
            assert (ids == unpack(parts[3], parts[4])).all()
            seen += [d if not null else None for d, null, _ in parts[1].tolist()]
    assert seen == [g[0] for g in got]
    back = tf.read_token_files(spark, path).where("doc_id = 3").select(F.col("ids")).first()["ids"]
    assert list(struct.unpack(f"<{len(back) // 4}I", back)) == whole.encode(dict(rows)[3], add_special_tokens=False).ids + [9]
    with pytest.raises(ValueError):
        list(tf.frames(names[0].read_bytes()[:-8] + b"\0" * 8))


def test_executors_need_no_copy_of_the_package(spark, monkeypatch):
    sent, broadcast = [], type(spark.sparkContext).broadcast
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, value: sent.append(pickle.dumps(value)) or broadcast(self, value))
    assert tf.token_ids(spark.createDataFrame([(1, "a b")], "doc_id long, text string")).first()["n_tokens"] == 3
    assert sent and not any(b"tracelake" in x for x in sent)


def test_no_documents_no_ids(spark):
    assert tf.token_ids(spark.createDataFrame([], "doc_id long, text string")).collect() == []
