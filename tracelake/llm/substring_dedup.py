"""Substring dedup over a log-structured index of window fingerprints.

A window is ``width`` consecutive words. Its fingerprint is the smallest hash of the ``gram``-word runs in it (the last one among
equals), so equal windows have equal fingerprints at equal places, and neighbouring windows share one: a text gives
about ``2 / (width - gram + 2)`` entries a word. An entry covers a stretch of window starts and carries a hash of all their words.

Each batch of documents becomes one immutable run: how often each (fingerprint, stretch) occurs, and one place of it, bucketed and sorted by fingerprint. Entries are
counted before they are dealt to buckets, so a passage in a third of all texts is a few rows. A run is merge-joined with the history of all runs before it and
compacted into a new one; buckets line up, so neither step shuffles. Entries whose fingerprint occurs once are settled. Of the others, stretches that
are equal as a whole are duplicates; the rest, and one of each kind of equal stretches, are expanded to windows.

Nothing is taken for equal by its fingerprint alone: whole stretches are compared by 128 bits (fingerprint and a hash of all their words), single windows by 128 bits of their own.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracelake.llm.scratch import drop, keep, release, shared_dir, tidy
from tracelake.llm.words import WordHashes, chunks, finish, hash_words, slices, window_hashes

#: Documents with something to expand or to cut are broadcast up to so many, and up to so many stretches or cuts in all
#: (some 50 and 16 bytes each, so under 50 MB); above it Spark shuffles.
BROADCAST_DOCS = 200_000
BROADCAST_PARTS = 2_000_000


def _windows(texts: list[bytes | None], known: WordHashes, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, where each text's begin, and for each word whether a window of its own text starts there."""
    words, starts = hash_words(texts, known)
    owner_end = np.repeat(starts[1:], np.diff(starts))
    return words, starts, np.arange(len(words)) + width <= owner_end


def stretches(words: np.ndarray, valid: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, ...]:
    """``(fp, lo, count, span)``: stretches of valid window starts that share a fingerprint."""
    n = len(words) - width + 1
    if n <= 0 or not valid.any():
        return tuple(np.zeros(0, t) for t in (np.uint64, np.int64, np.int64, np.uint64))
    reach = width - gram + 1
    grams = window_hashes(words, gram, 1)
    # the smallest gram of each window, the last among equals, by doubling
    at = np.arange(len(grams))
    size = 1
    while size < reach:
        step = min(size, reach - size)
        right = at[step:]
        left = at[: len(right)]
        at = np.where(grams[right] <= grams[left], right, left)
        size += step
    at = at[:n]
    valid = valid[:n]
    new = valid.copy()
    new[1:] &= ~valid[:-1] | (at[1:] != at[:-1])
    lo = np.flatnonzero(new)
    stop = valid.copy()
    stop[:-1] &= ~valid[1:] | (at[1:] != at[:-1])
    hi = np.flatnonzero(stop)
    whole = window_hashes(words, width)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(finish(whole), dtype=np.uint64)])
    rel = (at[lo] - lo).astype(np.uint64)
    span = finish(total[hi + 1] - total[lo] + finish(whole[lo] + rel * np.uint64(0x9E3779B97F4A7C15) + (hi - lo).astype(np.uint64)))
    return grams[at[lo]], lo, hi - lo + 1, span


def _fingerprints(width: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in slices(batches):
            texts = batch.column("text").to_pylist()
            for a, b in chunks(texts):
                words, starts, valid = _windows(texts[a:b], known, width)
                fp, lo, count, span = stretches(words, valid, width, gram)
                owner = np.searchsorted(starts, lo, side="right") - 1
                rows = pa.array(owner + a)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(fp.view(np.int64)), pa.array(span.view(np.int64)), batch.column("doc").take(rows), batch.column("t64").take(rows), pa.array((lo - starts[owner]).astype(np.int32)), pa.array(count.astype(np.int32))],
                    names=["fp", "span", "doc", "t64", "lo", "n"],
                )

    return run


def _expand(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in slices(batches):
            texts, asked = batch.column("text").to_pylist(), batch.column("asked").to_pylist()
            for a, b in chunks(texts):
                words, starts, _ = _windows(texts[a:b], known, width)
                h1, h2 = window_hashes(words, width), window_hashes(words, width, 7)
                owner = np.repeat(np.arange(a, b), [len(x) for x in asked[a:b]])
                lo = np.array([x["lo"] for own in asked[a:b] for x in own], np.int64)
                n = np.array([x["n"] for own in asked[a:b] for x in own], np.int64)
                only = np.array([x["only"] for own in asked[a:b] for x in own], bool)
                at = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())  # lo, lo + 1, ... of each stretch
                owner, only = np.repeat(owner, n), np.repeat(only, n)
                place = starts[owner - a] + at
                rows = pa.array(owner)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h1[place].view(np.int64)), pa.array(h2[place].view(np.int64)), batch.column("doc").take(rows), batch.column("t64").take(rows), pa.array(at.astype(np.int32)), pa.array(only)],
                    names=["h1", "h2", "doc", "t64", "at", "only"],
                )

    return run


def _cut(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            n_words, removed, sha, left = [], [], [], []
            for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                words = text.split() if text else []
                kept, at = [], 0
                for s in spans or ():
                    kept += words[at : s["s"]]
                    at = s["e"]
                kept += words[at:]
                joined = b" ".join(kept)
                n_words.append(len(words))
                removed.append(len(words) - len(kept))
                sha.append(hashlib.sha256(joined).hexdigest())
                left.append(joined if with_text else None)
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(n_words, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha, pa.string()), pa.array(left, pa.binary())], names=["doc", "n_words", "n_removed", "kept_sha256", "kept"])

    return run


_ENTRY = "fp long, span long, doc long, t64 long, lo int, n int"


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries of a batch that are the same stretch become one, with their number and one of their places."""
    for batch in batches:
        if batch.num_rows:
            both = np.empty(batch.num_rows, [("fp", np.int64), ("span", np.int64)])
            both["fp"], both["span"] = batch.column("fp").to_numpy(), batch.column("span").to_numpy()
            _, first, times = np.unique(both, return_index=True, return_counts=True)
            own = batch.take(pa.array(first))
            yield pa.RecordBatch.from_arrays([*own.columns, pa.array(times, pa.int64())], names=[*own.schema.names, "times"])


class FingerprintIndex:
    """Runs of counted stretches, one a batch, and the compacted history of all of them. Use it in a ``with`` statement, or ``close`` it: its tables are dropped then."""

    def __init__(self, spark: SparkSession, width: int = 35, gram: int = 8, buckets: int | None = None):
        self.spark, self.width, self.gram = spark, width, gram
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.runs: list[str] = []
        self.entries: dict[str, DataFrame] = {}
        self.history: str | None = None

    def __enter__(self) -> FingerprintIndex:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def _store(self, df: DataFrame) -> str:
        name = f"tracelake_run_{uuid.uuid4().hex}"
        df.write.bucketBy(self.buckets, "fp").sortBy("fp", "span").option("path", self._path(name)).saveAsTable(name)
        return name

    def add(self, texts: DataFrame) -> str:
        """A batch ``(doc, t64, text)`` becomes a run; the history is merged with it. Returns the run's table."""
        entries = keep(texts.mapInArrow(_fingerprints(self.width, self.gram), _ENTRY), "entries")
        dealt = entries.mapInArrow(_combine, _ENTRY + ", times long").repartition(self.buckets, "fp")
        place = F.min(F.struct("doc", "t64", "lo", "n")).alias("one")
        with self._by_bucket():
            run = self._store(dealt.groupBy("fp", "span").agg(F.sum("times").alias("times"), place).select("fp", "span", "times", "one.*"))
            self.runs.append(run)
            self.entries[run] = entries
            before = self.history
            if before is None:
                self.history = run
                return run
            old = self.spark.table(before).select("fp", "span", F.col("times").alias("before"), F.struct("doc", "t64", "lo", "n").alias("old"))
            both = old.join(self.spark.table(run).select("fp", "span", "times", F.struct("doc", "t64", "lo", "n").alias("new")), ["fp", "span"], "full")
            times = F.coalesce("before", F.lit(0)) + F.coalesce("times", F.lit(0))
            self.history = self._store(both.select("fp", "span", times.alias("times"), F.coalesce("old", "new").alias("one")).select("fp", "span", "times", "one.*"))
        if before not in self.runs:
            self._forget(before)
        return run

    def repeated(self, run: str | None = None) -> tuple[DataFrame, DataFrame]:
        """What the history says about a run's stretches (or all): ``(fp, span)`` of those that occur more than once, and the places to expand.

        A place ``(doc, t64, lo, n, only)`` stands for a stretch whose fingerprint others have too; ``only``: it occurs once, and in the run.
        """
        with self._by_bucket():
            known = self.spark.table(self.history)
            if run is not None:
                own = self.spark.table(run).select("fp", "span", F.lit(True).alias("own"))
                known = known.join(self.spark.table(run).select("fp").distinct(), "fp").join(own, ["fp", "span"], "left")
            else:
                known = known.withColumn("own", F.lit(True))
            kinds = known.groupBy("fp").agg(F.count("*").alias("kinds")).where("kinds > 1").select("fp")
            whole = keep(known.where("times > 1 AND own").select("fp", "span"), "repeated")
            mixed = keep(known.join(kinds, "fp").select("doc", "t64", "lo", "n", (F.coalesce("own", F.lit(False)) & (F.col("times") == 1)).alias("only")), "mixed")
        return whole, mixed

    def close(self) -> None:
        for name in {*self.runs, self.history} - {None}:
            self._forget(name)
        for entries in self.entries.values():
            release(entries)
        self.runs, self.entries, self.history = [], {}, None

    @contextmanager
    def _by_bucket(self) -> Iterator[None]:
        """Rows that are together by fingerprint are so by (fingerprint, stretch) too: joins and counts of both need no shuffle."""
        name = "spark.sql.requireAllClusterKeysForCoPartition"
        before = self.spark.conf.get(name)
        self.spark.conf.set(name, "false")
        try:
            yield
        finally:
            self.spark.conf.set(name, before)

    def _forget(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        drop(self.spark, self._path(name))

    def _path(self, name: str) -> str:
        return f"{shared_dir(self.spark)}/tracelake/{name}"


def _with_docs(texts: DataFrame, about: DataFrame, parts: str, how: str) -> DataFrame:
    size = about.agg(F.count("*").alias("docs"), F.coalesce(F.sum(F.size(parts)), F.lit(0)).alias("parts")).first()
    few = size["docs"] <= BROADCAST_DOCS and size["parts"] <= BROADCAST_PARTS
    about = about.withColumnsRenamed({"doc": "__doc", "t64": "__t64"})
    return texts.join(F.broadcast(about) if few else about, F.col("doc").eqNullSafe(F.col("__doc")) & (F.col("t64") == F.col("__t64")), how).drop("__doc", "__t64")


def _few(rows: DataFrame) -> DataFrame:
    return F.broadcast(rows) if rows.count() <= BROADCAST_PARTS else rows


@tidy
def repeated_spans(index: FingerprintIndex, texts: DataFrame, run: str | None = None, history: DataFrame | None = None) -> DataFrame:
    """``(doc, t64, spans [(s, e)])``: the words ``s`` to ``e`` (excluded) of the run's texts (or all) that lie in repeated windows, in order and apart.

    ``history``: the texts of the runs before, of which only those that share a fingerprint are read again.
    """
    width = index.width
    same, mixed = index.repeated(run)
    same = _few(same)
    whole = None
    for entries in [index.entries[run]] if run else index.entries.values():
        found = entries.join(same, ["fp", "span"]).select("doc", "t64", F.col("lo").alias("s"), (F.col("lo") + F.col("n") + width - 1).alias("e"))
        whole = found if whole is None else whole.unionByName(found)
    asked = keep(mixed.groupBy("doc", "t64").agg(F.collect_list(F.struct("lo", "n", "only")).alias("asked")), "asked")
    every = texts if history is None else texts.unionByName(history)
    read = _with_docs(every, asked, "asked", "inner")
    windows = keep(read.mapInArrow(_expand(width), "h1 long, h2 long, doc long, t64 long, at int, only boolean"), "windows")
    twice = windows.groupBy("h1", "h2").agg(F.count("*").alias("times")).where("times > 1").select("h1", "h2")
    single = windows.where("only").join(_few(keep(twice, "twice")), ["h1", "h2"]).select("doc", "t64", F.col("at").alias("s"), (F.col("at") + width).alias("e"))
    order = W.partitionBy("doc", "t64").orderBy("s", "e")
    reached = F.max("e").over(order.rowsBetween(W.unboundedPreceding, -1))
    islands = whole.unionByName(single).withColumn("new", F.when(reached >= F.col("s"), 0).otherwise(1)).withColumn("island", F.sum("new").over(order))
    islands = islands.groupBy("doc", "t64", "island").agg(F.min("s").alias("s"), F.max("e").alias("e"))
    return keep(islands.groupBy("doc", "t64").agg(F.sort_array(F.collect_list(F.struct("s", "e"))).alias("spans")), "cuts")


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc"), F.xxhash64(F.col(f"`{text_col}`")).alias("t64"), F.col(f"`{text_col}`").cast("binary").alias("text"))


def _without(texts: DataFrame, cuts: DataFrame, id_col: str, with_text: bool) -> DataFrame:
    out = _with_docs(texts, cuts, "spans", "left").select("doc", "text", "spans").mapInArrow(_cut(with_text), "doc long, n_words long, n_removed long, kept_sha256 string, kept binary")
    out = out.withColumn("kept", F.col("kept").cast("string")).withColumnRenamed("doc", id_col)
    return out if with_text else out.drop("kept")


def dedup_batch(index: FingerprintIndex, batch: DataFrame, history: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True) -> DataFrame:
    """``batch`` joins the index, and loses the words of each window that starts anywhere else, in the batch or in the ``history``: all documents added before.

    Columns and rules are those of ``substring_dedup``. Earlier batches keep what they had when they were added. An empty batch gives no rows, and no ``history`` means none.
    """
    texts = _texts(batch, id_col, text_col)
    run = index.add(texts)
    cuts = repeated_spans(index, texts, run, None if history is None else _texts(history, id_col, text_col))
    return _without(texts, cuts, id_col, with_text)


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 35, gram: int = 8, batches: int = 2, with_text: bool = True) -> DataFrame:
    """One row a row of ``docs``: id, ``n_words``, ``n_removed``, ``kept_sha256``, ``kept`` (the words left, joined by spaces).

    Words are runs of anything but space and 0x09-0x0D. Each word inside a window of ``width`` words whose sequence starts
    anywhere else too, in any row, goes, the first occurrence like the others; windows are judged on the input. ``batches``: the
    input is added to the index in so many batches; the result is the same for any number.

    Null and empty texts have no words. Rows repeated as a whole are repeats of each other. Null ids are kept apart by their text.
    An empty table gives no rows; other columns are ignored.
    """
    texts = _texts(docs, id_col, text_col)
    with FingerprintIndex(docs.sparkSession, width, gram) as index:
        for i in range(batches):
            index.add(texts.where(F.pmod(F.xxhash64("doc", "t64"), F.lit(batches)) == i) if batches > 1 else texts)
        cuts = repeated_spans(index, texts)
    return _without(texts, cuts, id_col, with_text)
