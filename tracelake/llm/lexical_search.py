"""Ranked lexical search for sets of items, with the terms dealt to owners that items visit one after another.

A bundle of items is worked off at a time; its terms are the dictionary. Documents are read once: each gives the bundle's terms in it with
their counts. Terms are ordered from rare to common and cut into owners of growing size. A bundle's accumulators (item, document, score so far)
pass through the owners: each stage cogroups them with the owner's part of every block of documents and adds whole-number contributions.

Contributions are never negative, so the k-th best score so far is a floor of the final k-th best, and what an item can still gain is at
most the sum of its later terms' best contributions. A pair that cannot reach the floor with all of that is let go, and new pairs are only opened
while the rest alone could reach it: accumulators stay sparse though the common terms are in nearly all documents, and the result is exact.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelake.llm.scratch import keep, release, tidy
from tracelake.llm.words import chunks

#: Item-term pairs and items of a bundle, which the driver holds and tasks get; documents of a block; where owners end, as shares of all additions.
BUNDLE_PAIRS, BUNDLE_ITEMS, BLOCK_DOCS, OWNERS = 500_000, 1000, 2048, (0.01, 0.05, 0.2, 1.0)
_SALTS = 32
_SEPARATORS = bytes(b for b in range(128) if not chr(b).isalnum())
_FOLD = bytes.maketrans(_SEPARATORS + b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b" " * len(_SEPARATORS) + b"abcdefghijklmnopqrstuvwxyz")
_ACC = "block long, item int, row long, doc_id long, score long"


def terms_of(text: bytes) -> list[bytes]:
    """Runs of letters, digits and anything outside ASCII; only A-Z are lowered."""
    return text.translate(_FOLD).split()


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b in chunks([range(n or 0) for n in pc.binary_length(batch.column("text")).to_pylist()]):
            own = [sorted(set(terms_of(t or b""))) for t in batch.column("text").slice(a, b - a).to_pylist()]
            rows = [batch.column(c).slice(a, b - a) for c in ("item", "item_id")]
            yield pa.RecordBatch.from_arrays([*rows, pa.array(own, pa.list_(pa.binary()))], names=["item", "item_id", "terms"])


def _counter(shared):
    """Each document's length and its counts of the bundle's terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get, size = shared.value["code"].get, len(shared.value["code"])
        for batch in batches:
            for a, b in chunks([range(n or 0) for n in pc.binary_length(batch.column("text")).to_pylist()]):
                lengths, codes = [], [np.zeros(0, np.int64)]
                for text in batch.column("text").slice(a, b - a).to_pylist():
                    own = terms_of(text or b"")
                    lengths.append(len(own))
                    codes.append(np.fromiter(map(get, own, repeat(-1)), np.int64, len(own)))
                flat, of = np.concatenate(codes), np.repeat(np.arange(b - a), lengths)
                key, n = np.unique((of * size + flat)[flat >= 0], return_counts=True)
                ends = np.searchsorted(key, np.arange(b - a + 1) * size).astype(np.int32)
                cut = lambda x: pa.ListArray.from_arrays(pa.array(ends), pa.array(x.astype(np.int32)))  # noqa: B023, E731
                ids = [batch.column(c).slice(a, b - a) for c in ("row", "doc_id")]
                out = pa.RecordBatch.from_arrays([*ids, pa.array(lengths, pa.int64()), cut(key % max(size, 1)), cut(n)], names=["row", "doc_id", "n", "terms", "tfs"])
                yield out.filter(pc.greater(out.column("n"), 0))

    return run


def _flat(table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place of the document, term and count of each posting of a batch or table."""
    terms, tfs = (pa.chunked_array([c]) if isinstance(c, pa.Array) else c for c in (table.column("terms"), table.column("tfs")))
    sizes = pc.list_value_length(terms).to_numpy()
    return np.repeat(np.arange(len(sizes)), sizes), pc.list_flatten(terms).to_numpy(), pc.list_flatten(tfs).to_numpy().astype(np.int64)


def _share(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


def _measure(n_terms: int, n_docs: int, total: int):
    """Documents and best share of each term in a task's documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, top = np.zeros(n_terms, np.int64), np.zeros(n_terms, np.int64)
        for batch in batches:
            doc, term, tf = _flat(batch)
            m = 50 + (50 * batch.column("n").to_numpy() * n_docs) // total
            df += np.bincount(term, minlength=n_terms)
            np.maximum.at(top, term, _share(tf, m[doc]))
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(df[some]), pa.array(top[some])], names=["term", "df", "top"])

    return run


def _deal(owner: np.ndarray, n_docs: int, total: int):
    """A row for each document and owner that holds some of its terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, term, tf = _flat(batch)
            m = 50 + (50 * batch.column("n").to_numpy() * n_docs) // total
            row, ids = batch.column("row").to_numpy(), batch.column("doc_id")
            for s in np.unique(owner[term]):
                mine = owner[term] == s
                some, first = np.unique(doc[mine], return_index=True)
                ends = pa.array(np.append(first, mine.sum()).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(some), s, np.int32)), pa.array(row[some] // BLOCK_DOCS), pa.array(row[some]), ids.take(pa.array(some)), pa.array(m[some]),
                        pa.ListArray.from_arrays(ends, pa.array(term[mine])), pa.ListArray.from_arrays(ends, pa.array(tf[mine].astype(np.int32))),
                    ],
                    names=["owner", "block", "row", "doc_id", "m", "terms", "tfs"],
                )

    return run


def _visit(shared, floor: np.ndarray, rest: np.ndarray, later: np.ndarray, k: int):
    """A bundle's accumulators of one block at one owner. ``floor``: of the k-th best score; ``rest``, ``later``: what an item can gain with and after this owner."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        weight, begins, items = (shared.value[x] for x in ("weight", "begins", "items"))
        opened = rest >= floor
        rows = np.unique(np.concatenate([left.column("row").to_numpy(), right.column("row").to_numpy()]))
        held = np.searchsorted(rows, left.column("row").to_numpy())
        ids = np.zeros(len(rows), object)
        for t in (left, right):
            ids[np.searchsorted(rows, t.column("row").to_numpy())] = t.column("doc_id").to_pylist()
        score = np.zeros((len(floor), len(rows)), np.int64)
        live = np.repeat(opened[:, None], len(rows), axis=1)
        of = left.column("item").to_numpy()
        score[of, held] = left.column("score").to_numpy()
        live[of, held] = True
        wanted = live.any(axis=0)
        place = np.searchsorted(rows, right.column("row").to_numpy())
        doc, term, tf = _flat(right)
        mine = wanted[place[doc]]
        doc, term, tf = doc[mine], term[mine], tf[mine]
        gain = weight[term] * _share(tf, right.column("m").to_numpy()[doc])
        order = np.argsort(term, kind="stable")
        at, gain, term = place[doc][order], gain[order], term[order]
        cuts = np.flatnonzero(np.diff(term, prepend=-1, append=-1))
        for a, b in zip(cuts, cuts[1:]):
            score[np.ix_(items[begins[term[a]] : begins[term[a] + 1]], at[a:b])] += gain[a:b]
        score[~live] = 0
        if k < len(rows):  # the k-th best of one block is a floor as well
            best = np.maximum(floor, np.partition(score, len(rows) - k, axis=1)[:, len(rows) - k])
        else:
            best = floor
        item, doc = np.nonzero((score > 0) & (score + later[:, None] >= best[:, None]))
        found = score[item, doc]
        if not later.any():  # nothing follows: the best k of the block, ties by id
            order = np.lexsort((rows[doc], np.array([(-(1 << 63) if x is None else x) for x in ids[doc]], np.int64), -found, item))
            item, doc, found = item[order], doc[order], found[order]
            nth = np.arange(len(item)) - np.searchsorted(item, item)
            item, doc, found = item[nth < k], doc[nth < k], found[nth < k]
        block = (left if left.num_rows else right).column("block")[0].as_py()
        return pa.table({"block": np.full(len(item), block), "item": item.astype(np.int32), "row": rows[doc], "doc_id": pa.array(ids[doc].tolist(), pa.int64()), "score": found})

    return run


def _first(acc: DataFrame, k: int) -> DataFrame:
    """Each item's first k rows, ranked. Items are cut into salts before they meet, so that no task gets more than a bounded part of one."""
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_first(), F.col("row")]
    some = acc.withColumn("salt", F.col("block") % _SALTS).withColumn("rank", F.row_number().over(Window.partitionBy("item", "salt").orderBy(*order))).where(F.col("rank") <= k)
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k)


def _search(rows: DataFrame, bundle: list, k: int) -> DataFrame | None:
    spark = rows.sparkSession
    names = sorted({t for r in bundle for t in r["terms"]})
    code = {t: i for i, t in enumerate(names)}
    item = np.repeat(np.arange(len(bundle)), [len(r["terms"]) for r in bundle])
    term = np.array([code[t] for r in bundle for t in r["terms"]], np.int64)
    counted = keep(rows.mapInArrow(_counter(spark.sparkContext.broadcast({"code": code})), "row long, doc_id long, n long, terms array<int>, tfs array<int>"), "search-counts")
    n_docs, total = counted.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    if not n_docs or not len(term):
        release(counted)
        return None
    measured = counted.select("n", "terms", "tfs").mapInArrow(_measure(len(names), n_docs, total), "term long, df long, top long").groupBy("term").agg(F.sum("df"), F.max("top"))
    df, weight, gain = np.zeros(len(names), np.int64), np.zeros(len(names), np.int64), np.zeros(len(names), np.int64)
    for t, n, top in measured.collect():  # a row a term of the bundle
        df[t], weight[t] = n, math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1)))
        gain[t] = weight[t] * top
    order = np.argsort(df, kind="stable")
    work = np.cumsum((df * np.bincount(term, minlength=len(names)))[order]) / max(1, (df[term]).sum())
    owner = np.zeros(len(names), np.int32)
    owner[order] = np.minimum(np.searchsorted(OWNERS, work), len(OWNERS) - 1)
    dealt = counted.mapInArrow(_deal(owner, n_docs, total), "owner int, block long, row long, doc_id long, m long, terms array<int>, tfs array<int>")
    dealt = keep(dealt, "search-owners", by="owner")
    release(counted)
    by_term = np.argsort(term, kind="stable")
    shared = spark.sparkContext.broadcast({"weight": weight, "begins": np.searchsorted(term[by_term], np.arange(len(names) + 1)), "items": item[by_term]})
    can = np.zeros((len(OWNERS) + 1, len(bundle)), np.int64)
    for s in range(len(OWNERS)):
        mine = owner[term] >= s
        np.add.at(can[s], item[mine], gain[term[mine]])
    floor, acc = np.ones(len(bundle), np.int64), spark.createDataFrame([], _ACC)
    for s in range(len(OWNERS)):
        owned = dealt.where(F.col("owner") == s).drop("owner")
        passed = acc.groupBy("block").cogroup(owned.groupBy("block")).applyInArrow(_visit(shared, floor.copy(), can[s], can[s + 1], k), _ACC)
        before, acc = acc, keep(passed, "search-accumulators")
        if s:
            release(before)
        if s + 1 < len(OWNERS):
            for r in _first(acc, k).where(F.col("rank") == k).select("item", "score").collect():
                floor[r["item"]] = max(1, r["score"])
    release(dealt)
    found = _first(acc, k)
    ids = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(bundle)], "item int, item_id long")
    found = keep(found.join(F.broadcast(ids), "item").select("item_id", "rank", "doc_id", "score"), "search-ranks")
    release(acc)
    return found


@tidy
def ranked_search(docs: DataFrame, items: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Each item's ``k`` best documents with a score above 0: ``item_id``, ``rank`` (from 1), ``doc_id``, ``score``; all if there are fewer. Equal scores rank by ascending id.

    N documents have terms, L in all; n of one document, df documents of a term, tf times in a document. A term weighs ``floor(1000 ln((2N+2)/(2df+1)))`` and adds
    ``weight * (1e9 tf div (1000 tf + 20 m))`` with ``m = 50 + (50 n N div L)``. Null and empty texts have no terms: such documents are never found, such items find none.
    Every row of either table counts for itself: rows that share an id, repeated ones too, are ranked (or searched for) each; null ids come first in ties. Empty tables give no rows.
    Other columns are ignored.
    """
    spark = docs.sparkSession
    text = lambda c: F.col(f"`{c}`").cast("binary").alias("text")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").cast("long").alias("doc_id"), text(text_col))
    asked = items.select(F.monotonically_increasing_id().alias("item"), F.col(f"`{item_id_col}`").cast("long").alias("item_id"), text(item_text_col))
    asked = keep(asked.mapInArrow(_item_terms, "item long, item_id long, terms array<binary>"), "search-items")
    n_items, n_pairs = asked.agg(F.count("*"), F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()
    n_bundles = max(1, math.ceil(n_pairs / BUNDLE_PAIRS), math.ceil(n_items / BUNDLE_ITEMS))
    found = []
    for b in range(n_bundles):
        bundle = asked.where(F.pmod(F.xxhash64("item"), F.lit(n_bundles)) == b).orderBy("item").collect()
        found += [x for x in [_search(rows, bundle, k)] if x is not None] if bundle else []
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for x in found:
        out = out.unionByName(x)
    return out if len(found) != 1 else found[0]
