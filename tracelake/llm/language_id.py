"""Language of texts and of the parts of mixed texts: script ranges, byte n-gram scores of words, Viterbi with a switching penalty.

The model is learned here: counts of byte triples of lower-cased words by language, hashed to ``buckets``, and how often each
language's words begin in each script. A word's candidates are the languages seen in its script; its score is the sum of its
triples' log probabilities. The best path through the languages pays ``penalty`` for each switch; its runs are the spans. All texts of a chunk
go through the recursion in step, so each step is a few array operations over all texts that still have words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.llm.words import chunks, slices

_LETTER = re.compile(r"[^\W\d_]")
_CHUNK_BYTES = 3_000_000
#: A script counts for a language if at least this share of its words begin in it.
_SCRIPT_SHARE = 0.01
_SCRIPTS = 10


def _byte_classes() -> tuple[np.ndarray, np.ndarray]:
    """For each byte: itself, or a space where it belongs to no word; the script it begins."""
    keep, script = np.full(256, 32, np.uint8), np.full(256, 9, np.uint8)
    for b in range(256):
        if b >= 0x80 or chr(b).isalpha():
            keep[b] = b
    # UTF-8 lead bytes by script: Latin, Greek, Cyrillic, Hebrew, Arabic, Indic and South-East Asian, kana, Han, Hangul
    for i, (lo, hi) in enumerate([(0x41, 0xCC), (0xCD, 0xCF), (0xD0, 0xD4), (0xD6, 0xD7), (0xD8, 0xDD), (0xE0, 0xE1), (0xE3, 0xE3), (0xE4, 0xE9), (0xEA, 0xED)]):
        script[lo : hi + 1] = i
    return keep, script


_KEEP, _SCRIPT = _byte_classes()


def _encode(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """All texts, lower-cased, with spaces for what is no letter, a space around each; and where each begins."""
    raw = [(" " + t.lower() + " ").encode("utf-8", "surrogatepass") if t else b"  " for t in texts]
    starts = np.concatenate([[0], np.cumsum([len(x) for x in raw])])
    return _KEEP[np.frombuffer(b"".join(raw), np.uint8)], starts


def _triples(data: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of the triple around each byte that belongs to a word, and those bytes' places."""
    at = np.flatnonzero(data[1:-1] != 32) + 1
    x = data.astype(np.uint32)
    h = (x[at - 1] * np.uint32(0x9E3779B1)) ^ (x[at] * np.uint32(0x85EBCA77) << np.uint32(3)) ^ (x[at + 1] * np.uint32(0xC2B2AE3D) << np.uint32(7))
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    return ((h ^ (h >> np.uint32(13))) % np.uint32(buckets)), at


def _word_starts(data: np.ndarray) -> np.ndarray:
    return np.flatnonzero((data[1:] != 32) & (data[:-1] == 32)) + 1


def _count(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in slices(batches, 2048):
            texts, langs = batch.column("text").to_pylist(), batch.column("lang").to_pylist()
            for lang in set(langs):
                own = [t for t, x in zip(texts, langs, strict=True) if x == lang]
                for a, b in chunks(own, _CHUNK_BYTES):
                    data, _ = _encode(own[a:b])
                    n = counts.setdefault(lang, np.zeros(buckets + _SCRIPTS, np.int64))
                    n[:buckets] += np.bincount(_triples(data, buckets)[0], minlength=buckets)
                    n[buckets:] += np.bincount(_SCRIPT[data[_word_starts(data)]], minlength=_SCRIPTS)
        for lang, n in counts.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(n[at], pa.int64())], names=["lang", "bucket", "n"])

    return run


@dataclass
class LanguageModel:
    """Languages in order; log probabilities (languages x buckets); for each script, which languages it leaves."""

    langs: list[str]
    scores: np.ndarray
    allowed: np.ndarray
    penalty: float

    @property
    def buckets(self) -> int:
        return self.scores.shape[1]


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", buckets: int = 65_536, penalty: float = 8.0, smoothing: float = 0.5) -> LanguageModel:
    """Counts over all rows with a text and a language. The model has ``buckets`` numbers a language, whatever the input's size."""
    rows = labelled.where(F.col(f"`{text_col}`").isNotNull() & F.col(f"`{lang_col}`").isNotNull()).select(F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").alias("lang"))
    table = rows.mapInArrow(_count(buckets), "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(table["lang"].unique())
    n = np.zeros((buckets + _SCRIPTS, len(langs)))
    n[table["bucket"].to_numpy(int), np.searchsorted(langs, table["lang"].to_numpy(str)) if langs else []] = table["n"]
    triples = n[:buckets] + smoothing
    words = n[buckets:]
    allowed = words >= _SCRIPT_SHARE * np.maximum(words.sum(axis=0), 1)
    allowed[~allowed.any(axis=1)] = True
    return LanguageModel(langs, np.ascontiguousarray(np.log(triples / triples.sum(axis=0)).T.astype(np.float32)), allowed, penalty)


def word_labels(texts: list[str | None], model: LanguageModel) -> tuple[np.ndarray, np.ndarray]:
    """The best path's language for each word of all texts, and where each text's words begin."""
    data, starts = _encode(texts)
    words = _word_starts(data)
    first = np.searchsorted(words, starts)
    if not len(words):
        return np.zeros(0, np.int8), first
    bucket, at = _triples(data, model.buckets)
    of_word = np.searchsorted(at, words)
    scores = np.stack([np.add.reduceat(own[bucket], of_word) for own in model.scores], axis=1).astype(np.float64)
    scores[~model.allowed[_SCRIPT[data[words]]]] -= 1e6
    n = np.diff(first)
    order = np.argsort(-n, kind="stable")
    begin, n = first[:-1][order], n[order]
    longest = int(n[0])
    alive = np.searchsorted(-n, -np.arange(longest), side="left")  # texts with more than t words
    back = np.zeros(scores.shape, np.int8)
    best = np.zeros((len(n), scores.shape[1]))
    own = np.arange(scores.shape[1], dtype=np.int8)
    for t in range(longest):
        k = alive[t]
        now = best[:k]
        if t:
            top = now.argmax(axis=1)
            switched = now[np.arange(k), top] - model.penalty
            stay = now >= switched[:, None]
            back[begin[:k] + t] = np.where(stay, own, top[:, None])
            now = np.where(stay, now, switched[:, None])
        best[:k] = now + scores[begin[:k] + t]
    labels = np.zeros(len(words), np.int8)
    state = best.argmax(axis=1).astype(np.int8)
    for t in range(longest - 1, -1, -1):
        k = alive[t]
        place = begin[:k] + t
        labels[place] = state[:k]
        if t:
            state[:k] = back[place, state[:k]]
    return labels, first


def _predict(model: LanguageModel, with_spans: bool):
    def one(labels: np.ndarray) -> tuple[str, float, list[dict] | None]:
        n = np.bincount(labels, minlength=len(model.langs))
        top = int(n.argmax())
        spans = None
        if with_spans:
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(labels)) + 1, [len(labels)]])
            spans = [{"first": int(a), "end": int(b), "lang": model.langs[labels[a]]} for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        return model.langs[top], float(n[top] / len(labels)), spans

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2048):
            texts = batch.column("text").to_pylist()
            out: list[tuple[str, float, list[dict] | None]] = []
            for a, b in chunks(texts, _CHUNK_BYTES):
                labels, first = word_labels(texts[a:b], model) if model.langs else (np.zeros(0, np.int8), np.zeros(b - a + 1, int))
                for text, s, e in zip(texts[a:b], first[:-1], first[1:], strict=True):
                    out.append(one(labels[s:e]) if e > s and _LETTER.search(text) else ("und", 0.0, [] if with_spans else None))
            lang, score, spans = zip(*out, strict=True) if out else ((), (), ())
            kind = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("held_out"), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(spans, kind)], names=["id", "held_out", "lang_pred", "score", "spans"])

    return run


def held_out(id_col: Column) -> Column:
    """Whether a row is kept out of training: crc32 of the id as text, modulo 4, is 2. A null id is not."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", with_spans: bool = True, **options) -> DataFrame:
    """One row a row of ``docs``: ``id``, ``held_out``, ``lang_pred``, ``score`` (share of the words in the predicted language), ``spans`` of words.

    Learns from the rows that are not held out and have a text and a language; predicts from the text alone. ``und`` with score 0: null texts,
    texts without a letter, and all texts if nothing can be learned. Ties go to the first language in order. Repeated rows count each; an empty table gives no rows.
    """
    model = train(docs.where(~held_out(F.col(f"`{id_col}`"))), text_col, lang_col, **options)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), held_out(F.col(f"`{id_col}`")).alias("held_out"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInArrow(_predict(model, with_spans), "id long, held_out boolean, lang_pred string, score double, spans array<struct<first:int,end:int,lang:string>>")
