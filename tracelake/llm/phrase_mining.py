"""Phrase collocations from a weighted de Bruijn graph of words.

Nodes are runs of three words, edges runs of four; an edge leads from its first three words to its last three. One pass aggregates the edges with
their counts, and the ends of pieces: the last three words (or fewer) of each. Shorter counts follow without another pass over the texts: a run of
three words occurs as often as its node's edges go out, plus the pieces that end in it; a run of two as often as the runs of three that
begin with it, plus the pieces that end in it. Unary paths (edges joined by nodes whose whole flow comes in by one edge and goes out by one) are
compacted by pointer doubling; their inner nodes never outlast their edges, so they leave the candidates before parts are looked up.

Every word of a phrase is at least as frequent as the phrase. Rarer words therefore end a piece: no count of a phrase that matters changes.
Words are numbers: places in the dictionary of frequent words while that has at most ``DICTIONARY`` entries, 63-bit hashes of all words beyond.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelake.llm.scratch import keep, release, tidy
from tracelake.llm.words import chunks

#: Frequent words that tasks hold as a dictionary; words and edges that a task counts before it hands counts on.
DICTIONARY, _COUNTED, _EDGES = 500_000, 200_000, 1_000_000
_SALTS = 32
_POINTS = b".,;:!?\n\x0b\x0c\r"
_FOLD = bytes.maketrans(_POINTS + b"\tABCDEFGHIJKLMNOPQRSTUVWXYZ", b"\n" * len(_POINTS) + b" abcdefghijklmnopqrstuvwxyz")
_W = ("w1", "w2", "w3", "w4")


def tokens_of(text: bytes) -> list[bytes]:
    """Words and, where a piece ends, line ends; empty strings between two spaces."""
    return text.translate(_FOLD).replace(b"\n", b" \n ").split(b" ")


def word_code(lang: str, word: bytes) -> int:
    return (xxhash.xxh3_64_intdigest(lang.encode() + b"\0" + word) >> 1) or 1


def _texts(batch: pa.RecordBatch) -> Iterator[list[tuple[str, bytes]]]:
    langs, texts = batch.column("lang"), batch.column("text")
    for a, b in chunks([range(n or 0) for n in pc.binary_length(texts).to_pylist()]):
        yield list(zip(langs.slice(a, b - a).to_pylist(), (t or b"" for t in texts.slice(a, b - a).to_pylist()), strict=True))


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, Counter] = defaultdict(Counter)

    def out() -> Iterator[pa.RecordBatch]:
        for lang, own in counts.items():
            for mark in (b"", b"\n"):
                own.pop(mark, None)
            words = list(own)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(words), pa.string()), pa.array(words, pa.binary()), pa.array(list(own.values()), pa.int64())], names=["lang", "word", "f"])
        counts.clear()

    for batch in batches:
        for texts in _texts(batch):
            for lang, text in texts:
                counts[lang].update(tokens_of(text))
            if sum(map(len, counts.values())) > _COUNTED:
                yield from out()
    yield from out()


class _Hashes(dict):
    """Word -> hash; empty strings are dropped, line ends are ends."""

    def __init__(self, lang: str):
        super().__init__({b"": -1, b"\n": 0})
        self.lang = lang

    def __missing__(self, word: bytes) -> int:
        if len(self) > _COUNTED:
            self.clear()
            self.update({b"": -1, b"\n": 0})
        h = self[word] = word_code(self.lang, word)
        return h


def _edges(shared):
    """Edges and ends of pieces of each text, as four words, 0 for none, with their counts among every ``_EDGES`` or so: copies of a passage become one row there."""

    def out(parts: list[np.ndarray]) -> pa.RecordBatch:
        rows = np.concatenate(parts, axis=1)
        rows = rows[:, np.lexsort(rows)]
        first = np.append(True, (rows[:, 1:] != rows[:, :-1]).any(axis=0)) if rows.shape[1] else np.zeros(0, bool)
        at = np.flatnonzero(first)
        return pa.RecordBatch.from_arrays([*(pa.array(w) for w in rows[:, at]), pa.array(np.diff(np.append(at, rows.shape[1])))], names=[*_W, "a"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, dict] = {}
        if shared is not None:
            langs, words = shared.value
            known = {lang: {b"": -1} for lang in set(langs)}
            for i, (lang, word) in enumerate(zip(langs, words, strict=True)):
                known[lang][word] = i + 1
        held, n = [np.zeros((4, 0), np.int64)], 0
        for batch in batches:
            for texts in _texts(batch):
                parts = [np.zeros(3, np.int64)]
                for lang, text in texts:
                    own = tokens_of(text)
                    if shared is None:
                        if lang not in known:
                            known[lang] = _Hashes(lang)
                        numbers = map(known[lang].__getitem__, own)
                    else:
                        numbers = map(known.get(lang, {}).get, own, repeat(0))
                    parts += [np.fromiter(numbers, np.int64, len(own)), np.zeros(1, np.int64)]
                x = np.concatenate([*parts, np.zeros(3, np.int64)])
                x = x[x >= 0]
                a, b, c, d = (x[i : len(x) - 3 + i] for i in range(4))
                here = np.flatnonzero((a > 0) & (b > 0) & ((d > 0) & (c > 0) | (d == 0) & (c > 0)))  # edges, and ends of three words
                two = np.flatnonzero((a == 0) & (b > 0) & (c > 0) & (d == 0))  # pieces of two words
                none = np.zeros(len(two), np.int64)
                held.append(np.stack([np.concatenate(p) for p in ((a[here], b[two]), (b[here], c[two]), (c[here], none), (d[here], none))]))
                n += held[-1].shape[1]
                if n >= _EDGES:
                    yield out(held)
                    held, n = [np.zeros((4, 0), np.int64)], 0
        yield out(held)

    return run


def _code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        codes = [word_code(lang, word) for lang, word in zip(batch.column("lang").to_pylist(), batch.column("word").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(codes, pa.int64()), *(batch.column(c) for c in ("lang", "word", "f"))], names=["code", "lang", "word", "f"])


def _parts(*spans: tuple[int, int]):
    """Runs of words of a row as an array of structs with the same four columns."""
    zero = F.lit(0).cast("long")
    return F.array(*(F.struct(*((F.col(_W[first + i]) if i < n else zero).alias(_W[i]) for i in range(4))) for first, n in spans))


def _flows(least: int):
    """Edges, sorted, to frequent edges and nodes, and to what nodes and piece ends give to runs of two words. All that is carried from batch to batch is the last edge and its node's flow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edge, node, carried = np.zeros((5, 0), np.int64), None, 0  # the edge that may go on, and its node with the flow of its earlier edges

        def row(*columns) -> np.ndarray:
            n = max(len(c) for c in columns if isinstance(c, np.ndarray))
            return np.stack([c if isinstance(c, np.ndarray) else np.full(n, c) for c in columns])

        def step(rows: np.ndarray, last: bool) -> pa.RecordBatch:
            nonlocal edge, node, carried
            rows = np.concatenate([edge, rows], axis=1)
            at = np.flatnonzero(np.append(True, (rows[:4, 1:] != rows[:4, :-1]).any(axis=0)))
            rows = np.concatenate([rows[:4, at], np.add.reduceat(rows[4], at)[None]])
            edge = rows[:, rows.shape[1] if last else -1 :]
            rows = rows[:, : rows.shape[1] if last else -1]
            w1, w2, w3, w4, a = rows
            some, end = (w4 > 0) & (a >= least), (w4 == 0) & (w3 > 0)
            out = [rows[:, some], row(w2[end], w3[end], 0, 0, a[end])]
            if rows.shape[1]:
                at = np.flatnonzero(np.append(True, (rows[:3, 1:] != rows[:3, :-1]).any(axis=0)))
                nodes, flow = rows[:3, at], np.add.reduceat(a, at)
            else:
                nodes, flow = rows[:3], a
            if node is not None:
                if nodes.shape[1] and (nodes[:, 0] == node).all():
                    flow[0] += carried
                else:
                    nodes, flow = np.concatenate([node[:, None], nodes], axis=1), np.append(carried, flow)
                node = None
            if not last and nodes.shape[1] and (nodes[:, -1] == edge[:3, 0]).all():
                node, carried, nodes, flow = nodes[:, -1].copy(), int(flow[-1]), nodes[:, :-1], flow[:-1]
            if nodes.shape[1]:
                some = (nodes[2] > 0) & (flow >= least)
                at = np.flatnonzero(np.append(True, (nodes[:2, 1:] != nodes[:2, :-1]).any(axis=0)))
                out += [row(*nodes[:, some], 0, flow[some]), row(*nodes[:2, at], 0, 0, np.add.reduceat(flow, at))]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in np.concatenate(out, axis=1)], names=[*_W, "a"])

        for batch in batches:
            if batch.num_rows:
                yield step(np.stack([batch.column(c).to_numpy() for c in (*_W, "a")]), False)
        if edge.shape[1]:
            yield step(np.zeros((5, 0), np.int64), True)

    return run


def _frequent_runs(edges: DataFrame, least: int) -> DataFrame:
    """Runs of two to four words that occur ``least`` times: ``w1``..``w4`` (0 for none) and ``a``.

    Edges meet, sorted, at the node that they leave, so their own counts and the node's flow (f of three words) need one shuffle; of a node only its flow goes on, to the two
    words that it begins with, and of a piece's end its last two words.
    """
    longs = ", ".join(f"{w} long" for w in (*_W, "a"))
    found = edges.repartition("w1", "w2", "w3").sortWithinPartitions(*_W).mapInArrow(_flows(least), longs)
    return found.groupBy(*_W).agg(F.sum("a").alias("a")).where(F.col("a") >= least)


def unary_paths(edges: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Compacted unary paths of frequent edges (``w1``..``w4``, ``a``) and the nodes (``w1``..``w3``, ``a``): each edge's ``path_words``, and the inner nodes.

    A node is inner if all that passes it comes in by one edge and goes out by one. Each round doubles what a pointer skips; there are as many rounds as the longest path's length has bits.
    """
    edges = keep(edges.select(*_W, "a").withColumn("edge", F.monotonically_increasing_id()), "edges-numbered")
    into = edges.select(F.col("edge").alias("before"), F.col("w2").alias("w1"), F.col("w3").alias("w2"), F.col("w4").alias("w3"), "a")
    out = edges.select(F.col("edge").alias("after"), "w1", "w2", "w3", "a")
    key = ["w1", "w2", "w3", "a"]  # with equal counts on both sides nothing else passes the node
    inner = keep(nodes.select(*key).join(into, key).join(out, key), "nodes-inner")
    at = edges.select("edge").join(inner.select(F.col("before").alias("edge"), F.col("after").alias("to")), "edge", "left").withColumn("steps", F.when(F.col("to").isNull(), 0).otherwise(1).cast("long"))
    at = keep(at.withColumns({"open": F.col("to").isNotNull(), "to": F.coalesce("to", "edge")}), "paths")
    while at.where("open").limit(1).count():
        ahead = at.select(F.col("edge").alias("to"), F.col("to").alias("further"), F.col("steps").alias("more"), F.col("open").alias("goes_on"))
        doubled = at.join(ahead, "to").select("edge", F.col("further").alias("to"), (F.col("steps") + F.col("more")).alias("steps"), (F.col("open") & F.col("goes_on")).alias("open"))
        last, at = at, keep(doubled, "paths")
        release(last)
    whole = at.groupBy("to").agg((F.max("steps") + 4).alias("path_words"))
    lengths = at.join(whole, "to").join(edges, "edge").select(*_W, "path_words")
    return lengths, inner.select("w1", "w2", "w3")


@tidy
def mine_phrases(docs: DataFrame, least: int = 30, most: int = 2000, covered: int = 80, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The ``most`` best phrases of two to four words of each language that occur ``least`` times or more: ``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score``, ``path_words``.

    ``a`` counts the phrase, ``l`` and ``r`` the two parts of its worst cut, ``n`` all words of the language; ``score`` is ``2000000 a div (l + r)``. A phrase inside a longer
    one that has at least ``covered`` percent of its count is dropped. ``path_words``: words of the unary path through a phrase of four words (how long the passage is that always
    goes on like it), else the phrase's own.

    A null language is ``und``. Null, empty and blank texts have no words. Repeated rows count each. Equal scores go by count, then by phrase. An empty table gives no rows; other
    columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"), F.col(f"`{text_col}`").cast("binary").alias("text"))
    words = keep(rows.mapInArrow(_count_words, "lang string, word binary, f long").groupBy("lang", "word").agg(F.sum("f").alias("f")), "words")
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    frequent = words.where(F.col("f") >= least)
    if frequent.count() <= DICTIONARY:
        table = frequent.orderBy(F.col("f").desc(), "lang", "word").toArrow()
        shared = spark.sparkContext.broadcast((table.column("lang").to_pylist(), table.column("word").to_pylist()))
        coded = table.append_column("code", pa.array(np.arange(1, table.num_rows + 1)))
        coded = spark.createDataFrame(coded.to_pandas() if table.num_rows else [], "lang string, word binary, f long, code long")
    else:
        shared, coded = None, frequent.mapInArrow(_code, "code long, lang string, word binary, f long")
    coded = keep(coded, "words-coded")
    phrases = keep(_frequent_runs(rows.mapInArrow(_edges(shared), ", ".join(f"{w} long" for w in (*_W, "a"))), least), "phrases")
    paths, inner = unary_paths(phrases.where("w4 > 0"), phrases.where("w3 > 0 AND w4 = 0"))
    zero = F.lit(0).cast("long")
    size = F.when(F.col("w4") > 0, 4).when(F.col("w3") > 0, 3).otherwise(2)
    within = F.when(F.col("w4") > 0, _parts((0, 3), (1, 3), (0, 2), (1, 2), (2, 2))).otherwise(_parts((0, 2), (1, 2)))
    longer = phrases.where("w3 > 0").select(F.explode(within).alias("p"), "a").select("p.*", "a").groupBy(*_W).agg(F.max("a").alias("longest"))
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    left = phrases.join(inner.distinct().withColumn("w4", zero), list(_W), "left_anti").join(longer, list(_W), "left")
    left = left.where(F.col("longest").isNull() | (wide("longest") * 100 < wide("a") * covered)).drop("longest")
    cut = lambda k, n: F.struct(F.lit(k).alias("k"), _parts((0, k), (k, n - k)).alias("two"))
    cuts = F.when(size == 2, F.array(cut(1, 2))).when(size == 3, F.array(cut(1, 3), cut(2, 3))).otherwise(F.array(cut(1, 4), cut(2, 4), cut(3, 4)))
    parts = left.select(F.struct(*_W).alias("phrase"), "a", F.explode(cuts).alias("cut")).select("phrase", "a", "cut.k", F.posexplode("cut.two").alias("side", "part")).select("phrase", "a", "k", "side", "part.*")
    counts = phrases.unionByName(coded.select(F.col("code").alias("w1"), zero.alias("w2"), zero.alias("w3"), zero.alias("w4"), F.col("f").alias("a"))).withColumnRenamed("a", "times")
    sides = parts.join(counts, list(_W)).groupBy("phrase", "a", "k").agg(F.max(F.when(F.col("side") == 0, F.col("times"))).alias("l"), F.max(F.when(F.col("side") == 1, F.col("times"))).alias("r"))
    scored = sides.withColumn("score", F.expr("(CAST(2000000 AS DECIMAL(10,0)) * CAST(a AS DECIMAL(20,0))) div (CAST(l AS DECIMAL(20,0)) + CAST(r AS DECIMAL(20,0)))"))
    worst = keep(scored.groupBy("phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("w")).select("phrase", "a", "w.l", "w.r", "w.score"), "phrases-scored")
    each = worst.select("phrase", F.posexplode(F.filter(F.array(*(F.col(f"phrase.{w}") for w in _W)), lambda w: w > 0)).alias("at", "code"))
    named = each.join(coded.select("code", "lang", "word"), "code").groupBy("phrase").agg(F.first("lang").alias("lang"), F.array_sort(F.collect_list(F.struct("at", F.col("word").cast("string").alias("word")))).alias("names"))
    text = F.array_join(F.transform("names", lambda x: x["word"]), " ")
    full = worst.join(named, "phrase").join(paths.select(F.struct(*_W).alias("phrase"), "path_words"), "phrase", "left").select("lang", text.alias("phrase"), "a", "l", "r", "score", F.coalesce("path_words", F.size("names").cast("long")).alias("path_words"))
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    some = full.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(_SALTS))).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= most)
    best = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= most)
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score", "path_words")
