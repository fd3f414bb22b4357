"""Vector and keyword search for many queries at once."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.functions.constants import C_EXPLORATION, W_KEYWORD, W_Q, W_SIMILARITY, W_VECTOR
from tracelake.functions.scores import weighted
from tracelake.operators.dedup import _cut
from tracelake.operators.ranking import top_k

#: Queries scored at a time: the matrix of a block is the only thing each task holds (4096 x 256 doubles are 8 MB).
QUERY_BLOCK = 4096
#: The same where keyword hits (some hundreds a query) go with the queries, and rows scored at a time.
HIT_BLOCK = ROW_BLOCK = 1024
#: Who may read: whole numbers for the owner and team of a query's viewer (0: none) or of a row (-1: none), and whether the shared rows are open to it or it is one.
READ = ("read_owner", "read_team", "read_shared")


def vector_top_k(queries: DataFrame, rows: DataFrame, k: int, query_id: str = "query_id", row_id: str = "experience_id", vector: str = "vector", skip_self: bool = False, acl: bool = False) -> DataFrame:
    """``(query_id, row_id, similarity, rank)``: exact cosines. A block of queries meets slices of rows as two matrices, and only a partition's best ``k`` a query are shuffled.

    With ``acl`` both sides have the columns ``READ``, and only rows that the query's viewer may read are ranked.
    """
    extra = list(READ) if acl else []
    blocks = [queries.select(query_id, vector, *extra).toPandas()] if queries.count() <= QUERY_BLOCK else None
    if blocks is None:
        n = -(-queries.count() // QUERY_BLOCK)
        numbered = queries.select(query_id, vector, *extra, F.pmod(F.xxhash64(query_id), F.lit(n)).alias("__b"))
        blocks = (numbered.where(F.col("__b") == i).drop("__b").toPandas() for i in range(n))
    out = None
    for block in blocks:
        if not len(block):
            continue
        may = block[extra].to_numpy(np.int64) if acl else None
        found = rows.select(row_id, vector, *extra).mapInPandas(_best(block[query_id].to_numpy(), np.stack(block[vector].to_numpy()).astype(float), k, row_id, vector, skip_self, may), f"query_id long, {row_id} long, similarity double")
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = rows.sparkSession.createDataFrame([], f"query_id long, {row_id} long, similarity double")
    return top_k(out.withColumn("similarity", F.round("similarity", 9)), "query_id", k, F.desc("similarity"), row_id)


def _unit(vectors) -> np.ndarray:
    m = np.stack(list(vectors)).astype(float)
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)


def _slices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for start in range(0, len(batch), ROW_BLOCK):
            yield batch.iloc[start : start + ROW_BLOCK]


def _running_best(scored: Iterator[tuple[np.ndarray, np.ndarray]], ids: np.ndarray, k: int, row_id: str, score: str) -> Iterator[pd.DataFrame]:
    """The best ``k`` rows a query of all ``(row ids, scores)``, by score and then id; minus infinity is no row."""
    keys, best = np.zeros((len(ids), 0), np.int64), np.zeros((len(ids), 0))
    for own, s in scored:
        keys, best = np.hstack([keys, np.broadcast_to(own, s.shape)]), np.hstack([best, s])
        order = np.lexsort((keys, -best), axis=1)[:, :k]
        keys, best = np.take_along_axis(keys, order, axis=1), np.take_along_axis(best, order, axis=1)
    yield pd.DataFrame({"query_id": np.repeat(ids, keys.shape[1]), row_id: keys.ravel(), score: best.ravel()}).query(f"{score} > -inf")


def _best(ids: np.ndarray, matrix: np.ndarray, k: int, row_id: str, vector: str, skip_self: bool, may: np.ndarray | None = None):
    unit = matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-300)

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for rows in _slices(batches):
            keys = rows[row_id].to_numpy()
            scores = np.round(unit @ _unit(rows[vector]).T, 9)
            if skip_self:
                scores[ids[:, None] == keys[None, :]] = -np.inf
            if may is not None:
                owner, team, shared = (rows[c].to_numpy() for c in READ)
                scores[~((may[:, 0, None] == owner) | (may[:, 1, None] == team) | ((may[:, 2, None] > 0) & (shared > 0)))] = -np.inf
            yield keys, scores

    return lambda batches: _running_best(scored(batches), ids, k, row_id, "similarity")


_TOKEN = r"[a-z0-9一-鿿]{2,}"


def tokens(text):
    """Runs of at least two ASCII letters, digits or CJK ideographs, lower-cased."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(_TOKEN), F.lit(0))


#: Documents of a block of the keyword index, and candidates a task holds before it cuts them to the best.
INDEX_BLOCK, CANDIDATES = 512, 400_000
_INDEX = "doc_id long, len long, terms array<int>, tfs array<int>"
_FIND = re.compile(_TOKEN)


def _indexer(code: dict[str, int]):
    """Length of each document and its counts of the known terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, ROW_BLOCK):
                part = batch.slice(start, ROW_BLOCK)
                lengths, terms, tfs, ends = [], [], [], [0]
                for text in part.column("text").to_pylist():
                    found = _FIND.findall(text or "")
                    lengths.append(len(found))
                    own = Counter(filter(code.__contains__, found))
                    terms += map(code.__getitem__, own)
                    tfs += own.values()
                    ends.append(len(terms))
                cut = lambda x: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, pa.int32()))  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(lengths, pa.int64()), cut(terms), cut(tfs)], names=["doc_id", "len", "terms", "tfs"])

    return run


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document's place, term and count of each posting."""
    terms = batch.column("terms")
    return np.repeat(np.arange(batch.num_rows), pc.list_value_length(terms).to_numpy()), terms.flatten().to_numpy(), batch.column("tfs").flatten().to_numpy()


def _doc_counts(n_terms: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(n_terms, np.int64)
        for batch in batches:
            df += np.bincount(_flat(batch)[1], minlength=n_terms)
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(df[some])], names=["term", "df"])

    return run


def _walk(ids: np.ndarray, begins: np.ndarray, queries: np.ndarray, idf: np.ndarray, average: float, k: int, k1: float, b: float):
    """A task's best ``k`` documents a query. ``queries[begins[t]:begins[t + 1]]`` have term t.

    A block's bound for a query is the sum of its terms' best parts in the block; queries whose k-th best is above it pass the block by.
    """
    pair_query = queries
    pair_term = np.repeat(np.arange(len(begins) - 1), np.diff(begins))

    def cut(q: np.ndarray, s: np.ndarray, d: np.ndarray, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order = np.lexsort((d, -s, q))
        q, s, d = q[order], s[order], d[order]
        nth = np.arange(len(q)) - np.searchsorted(q, q)
        floor[q[nth == k - 1]] = s[nth == k - 1]
        return q[nth < k], s[nth < k], d[nth < k]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        floor = np.zeros(len(ids))
        q, s, d = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
        for batch in batches:
            for start in range(0, batch.num_rows, INDEX_BLOCK):
                part = batch.slice(start, INDEX_BLOCK)
                doc, term, tf = _flat(part)
                length = part.column("len").to_numpy()
                gain = idf[term] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length[doc] / average))
                top = np.zeros(len(begins) - 1)
                np.maximum.at(top, term, gain)
                bound = np.bincount(pair_query, weights=top[pair_term], minlength=len(ids))
                awake = (bound > 0) & (np.round(bound, 6) + 1e-6 >= floor)
                if not awake.any():
                    continue
                at = np.cumsum(awake) - 1
                score = np.zeros((int(awake.sum()), part.num_rows))
                order = np.argsort(term, kind="stable")
                doc, term, gain = doc[order], term[order], gain[order]
                cuts = np.flatnonzero(np.diff(term, prepend=-1, append=-1))
                for x, y in zip(cuts, cuts[1:]):
                    own = pair_query[begins[term[x]] : begins[term[x] + 1]]
                    own = at[own[awake[own]]]
                    if len(own):
                        score[np.ix_(own, doc[x:y])] += gain[x:y]
                rounded = np.round(score, 6)
                i, j = np.nonzero((score > 0) & (rounded >= floor[awake][:, None]))
                q = np.concatenate([q, np.flatnonzero(awake)[i]])
                s, d = np.concatenate([s, rounded[i, j]]), np.concatenate([d, part.column("doc_id").to_numpy()[j]])
                if len(q) > CANDIDATES:
                    q, s, d = cut(q, s, d, floor)
        q, s, d = cut(q, s, d, floor)
        yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(d), pa.array(s)], names=["query_id", "doc_id", "score"])

    return run


#: A table of fewer bytes a core than a split has is dealt to the cores before its texts are worked on; what that shuffles is bounded by as many splits as there are cores.
SPLIT_BYTES = 128 << 20


def dealt(rows: DataFrame) -> DataFrame:
    """``rows`` over all cores if their files are too small to be split that far, else as they are. The size is the optimizer's estimate, nothing runs for it."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return rows.repartition(cores) if size < cores * SPLIT_BYTES else rows


def bm25(queries: DataFrame, docs: DataFrame, k: int = 200, k1: float = 1.2, b: float = 0.75, only: DataFrame | None = None) -> DataFrame:
    """``(query_id, doc_id, score, rank, signal)``: BM25 of any query term, the top ``k``, and 1 - rank / hits. Query ids are unique.

    Texts are read once for up to ``QUERY_BLOCK`` queries: an index keeps each document's length and its counts of their terms. Lengths and document counts cover
    all documents; with ``only`` (``doc_id``) no others are ranked. The index is walked in blocks, and nothing but each task's best is shuffled.
    """
    asked = queries.select(F.col("query_id").cast("long").alias("query_id"), F.array_distinct(tokens(F.col("text"))).alias("terms")).where(F.size("terms") > 0)
    n_blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    text = dealt(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lower("text").alias("text")))
    scores = docs.sparkSession.createDataFrame([], "query_id long, doc_id long, score double")
    for i in range(n_blocks):
        own = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(n_blocks)) == i).collect()  # about QUERY_BLOCK queries
        code = {t: j for j, t in enumerate(sorted({t for r in own for t in r["terms"]}))}
        if not own:
            continue
        index = _cut(text.mapInArrow(_indexer(code), _INDEX))
        n, average = index.agg(F.count("*"), F.avg("len")).first()
        df = np.zeros(len(code), np.int64)
        for term, count in index.mapInArrow(_doc_counts(len(code)), "term long, df long").groupBy("term").agg(F.sum("df")).collect():  # one row a term
            df[term] = count
        idf = np.maximum(np.log(np.maximum(n - df + 0.5, 1e-300) / (df + 0.5)), 1e-6)
        term = np.array([code[t] for r in own for t in r["terms"]])
        of = np.repeat(np.arange(len(own)), [len(r["terms"]) for r in own])
        order = np.argsort(term, kind="stable")
        walk = _walk(np.array([r["query_id"] for r in own]), np.searchsorted(term[order], np.arange(len(code) + 1)), of[order], idf, average or 1.0, k, k1, b)
        ranked = index if only is None else index.join(only.select(F.col("doc_id").cast("long").alias("doc_id")).distinct(), "doc_id", "left_semi")
        scores = scores.unionByName(ranked.mapInArrow(walk, "query_id long, doc_id long, score double"))
    hits = top_k(scores, "query_id", k, F.desc("score"), "doc_id")
    total = hits.groupBy("query_id").agg(F.count("*").alias("hits"))
    return hits.join(total, "query_id").withColumn("signal", 1 - (F.col("rank") - 1) / F.col("hits")).drop("hits")


class _Hits:
    """Keyword hits ``(query_id, row, signal)`` of a block of queries, sorted by row."""

    def __init__(self, ids: np.ndarray, hits: pd.DataFrame, row_id: str):
        at = pd.Index(ids).get_indexer(hits["query_id"])
        order = np.argsort(hits[row_id].to_numpy(), kind="stable")
        self.rows, self.query, self.signal = hits[row_id].to_numpy()[order], at[order], hits["signal"].to_numpy(dtype=float)[order]

    def of(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query number, place in ``keys`` and signal of each hit among ``keys``."""
        lo = np.searchsorted(self.rows, keys, "left")
        n = np.searchsorted(self.rows, keys, "right") - lo
        hit = np.arange(n.sum()) + np.repeat(lo - (np.cumsum(n) - n), n)
        return self.query[hit], np.repeat(np.arange(len(keys)), n), self.signal[hit]


def _hit_blocks(queries: DataFrame, hits: DataFrame, row_id: str) -> Iterator[tuple[np.ndarray, np.ndarray, _Hits]]:
    """Ids, unit vectors and hits of about ``HIT_BLOCK`` queries at a time."""
    n = max(1, -(-queries.count() // HIT_BLOCK))
    own = F.pmod(F.xxhash64(F.col("query_id").cast("long")), F.lit(n))
    for i in range(n):
        block = queries.where(own == i).select("query_id", "vector").toPandas()
        if len(block):
            ids = block["query_id"].to_numpy()
            found = hits.where(own == i).join(queries.select("query_id"), "query_id", "left_semi")
            yield ids, _unit(block["vector"]), _Hits(ids, found.select("query_id", row_id, "signal").toPandas(), row_id)


def hit_similarities(hits: DataFrame, queries: DataFrame, rows: DataFrame, row_id: str) -> DataFrame:
    """``hits`` (query_id, row, signal, ...) with the cosine of each; queries: query_id, vector; rows: row, vector."""
    out = rows.sparkSession.createDataFrame([], f"query_id long, {row_id} long, similarity double")
    hits, queries = _cut(hits), _cut(queries.select("query_id", "vector"))
    for ids, unit, found in _hit_blocks(queries, hits, row_id):

        def run(batches: Iterator[pd.DataFrame], ids=ids, unit=unit, found=found) -> Iterator[pd.DataFrame]:
            for part in _slices(batches):
                keys, own = part[row_id].to_numpy(), _unit(part["vector"])
                q, at, _ = found.of(keys)
                yield pd.DataFrame({"query_id": ids[q], row_id: keys[at], "similarity": np.round(np.einsum("ij,ij->i", unit[q], own[at]), 9)})

        out = out.unionByName(rows.select(row_id, "vector").mapInPandas(run, f"query_id long, {row_id} long, similarity double"))
    return hits.join(out, ["query_id", row_id])


def _blended(part: pd.DataFrame, unit: np.ndarray, found: _Hits) -> np.ndarray:
    s = W_VECTOR * (unit @ _unit(part["vector"]).T)
    q, at, signal = found.of(part["experience_id"].to_numpy())
    np.add.at(s, (q, at), W_KEYWORD * signal)
    return s


def hybrid_search(queries: DataFrame, vectors: DataFrame, keyword_hits: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """``(query_id, experience_id, score, rank)``: every one of ``rows`` is scored; similarity and keyword signal are blended before the z-scores, then similarity, Q and exploration.

    queries: query_id, vector; vectors: experience_id, vector; keyword_hits: query_id, doc_id, signal. A block of queries goes over the rows twice: once for
    the mean and deviation of its similarities, and once for each partition's best ``k`` by the final score.
    """
    own = _cut(vectors.join(rows.select("experience_id", weighted().alias("q"), F.coalesce("visit_count", F.lit(0)).cast("double").alias("visits")), "experience_id"))
    about = own.agg(F.count("*").alias("n"), F.avg("q").alias("mq"), F.stddev_pop("q").alias("sq"), F.sum("visits").alias("visits")).first()
    out = own.sparkSession.createDataFrame([], "query_id long, experience_id long, score double")
    if not about["n"]:
        return out.withColumn("rank", F.lit(0))
    queries, keyword_hits = _cut(queries.select("query_id", "vector")), _cut(keyword_hits.select("query_id", "doc_id", "signal"))  # blocks read them again
    mq, sq, log = about["mq"], about["sq"] if about["sq"] > 1e-12 else 1.0, np.log(about["visits"] + 1)
    for ids, unit, found in _hit_blocks(queries, keyword_hits.withColumnRenamed("doc_id", "experience_id"), "experience_id"):

        def moments(batches: Iterator[pd.DataFrame], unit=unit, found=found) -> Iterator[pd.DataFrame]:
            n, mean, m2 = 0, np.zeros(len(unit)), np.zeros(len(unit))
            for part in _slices(batches):
                s = _blended(part, unit, found)
                m, here, gap = s.shape[1], s.mean(axis=1), s.mean(axis=1) - mean
                m2 += ((s - here[:, None]) ** 2).sum(axis=1) + gap**2 * n * m / (n + m)
                mean += gap * m / (n + m)
                n += m
            yield pd.DataFrame({"at": np.arange(len(unit)), "n": n, "mean": mean, "m2": m2}).query("n > 0")

        parts = own.select("experience_id", "vector").mapInPandas(moments, "at long, n long, mean double, m2 double")
        total = parts.groupBy("at").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("mean")).alias("s"), F.sum("m2").alias("m2"))
        apart = parts.join(F.broadcast(total.select("at", (F.col("s") / F.col("n")).alias("all"))), "at").groupBy("at").agg(F.sum(F.col("n") * (F.col("mean") - F.col("all")) ** 2).alias("between"))
        stats = total.join(apart, "at").orderBy("at").toPandas()
        mean, sigma = (stats["s"] / stats["n"]).to_numpy(), np.sqrt(((stats["m2"] + stats["between"]) / stats["n"]).to_numpy())
        sigma = np.where(sigma > 1e-12, sigma, 1.0)

        def best(batches: Iterator[pd.DataFrame], ids=ids, unit=unit, found=found, mean=mean, sigma=sigma) -> Iterator[pd.DataFrame]:
            def scored() -> Iterator[tuple[np.ndarray, np.ndarray]]:
                for part in _slices(batches):
                    fixed = W_Q * (part["q"].to_numpy() - mq) / sq + C_EXPLORATION * np.sqrt(log / np.maximum(part["visits"].to_numpy(), 1))
                    yield part["experience_id"].to_numpy(), np.round(W_SIMILARITY * (_blended(part, unit, found) - mean[:, None]) / sigma[:, None] + fixed, 6)

            yield from _running_best(scored(), ids, k, "experience_id", "score")

        out = out.unionByName(own.mapInPandas(best, "query_id long, experience_id long, score double"))
    return top_k(out, "query_id", k, F.desc("score"), "experience_id")


def diverse_top_k(candidates: DataFrame, k: int, per_experience: int = 1) -> DataFrame:
    """Greedy walk down the score that skips a repeated experience, session, search text or action. Candidates a query are bounded by the rerank limits."""
    cols = ["query_id", "chunk_id", "experience_id", "session", "text_key", "action_key", "score"]

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        seen: list[set] = [set(), set(), set()]
        times: dict = {}
        keep = []
        for row in rows.sort_values(["score", "chunk_id"], ascending=[False, True]).itertuples():
            keys = (row.session, row.text_key or None, row.action_key or None)
            if times.get(row.experience_id, 0) >= per_experience or any(x is not None and x in s for x, s in zip(keys, seen, strict=True)):
                continue
            times[row.experience_id] = times.get(row.experience_id, 0) + 1
            for x, s in zip(keys, seen, strict=True):
                s.add(x)
            keep.append((row.query_id, row.chunk_id, len(keep) + 1))
            if len(keep) >= k:
                break
        return pd.DataFrame(keep, columns=["query_id", "chunk_id", "position"])

    types = dict(candidates.dtypes)
    return candidates.select(*cols).groupBy("query_id").applyInPandas(run, f"query_id {types['query_id']}, chunk_id {types['chunk_id']}, position int")
