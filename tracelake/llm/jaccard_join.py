"""N-gram Jaccard join in the metric space of shingle sets (distance 1 - Jaccard, reach r = 1 - t).

The space is cut into Voronoi regions of pivots; each text goes to the region of its nearest pivot and is replicated to those pivots whose
distance is at most 2 r more, which by the triangle inequality brings every two texts within reach of each other together. Three kinds of pivots:

* One-shingle sets first. Unrelated texts all lie at distance 1 from each other, so windows of texts as pivots would hold everything. A text of n shingles
  has at most n - ceil(t n) of them outside any partner, so its window is its first ``n - ceil(t n) + 1`` shingles in a fixed order of all (rare
  ones first). A text whose window holds no other text has no partner. Texts of a region are cut apart where sizes leave a gap wider than t.
* Texts, inside those regions: up to ``PIVOTS`` at once, nearest pivot, window of 2 r, recursively as long as the regions get smaller.
* A core, where texts do not split a region (near copies of one template lie equally far from each other): the set of shingles that most of its texts
  hold. Texts are taken as differences from the core, and with e = (100 + percent) * differences - (100 - percent) * n two texts link when
  e + e' <= 2 (100 + percent) * shared differences. So all texts of e <= 0 link, and so do all whose e the innermost text makes up for; the others
  must share differences with a partner, and the rarest of theirs are the one-shingle pivots of smaller regions.

Overlapping first regions are joined together, one task each. Those over ``region_shingles`` are split in at most ``ROUNDS`` distributed rounds, whatever the
number of texts (little over it, they go to tiles at once): cells of a region take its pivots (or core) to them, so no task holds more than about ``region_shingles``. Each round of cores at least halves a
region's texts, because a difference is held by half of them at most; what is still too large after the last round is compared by tiles of two cells.
In a task, regions are split by the same text pivots and end in postings of differences from their core. Pairs that are connected already are passed over: a group of
n near copies gives n - 1 links.

Shingles are compared by 64-bit hashes, whole sets by 128-bit digests. The order of the pivots only steers the work:
shingles whose hash falls in the lowest ``counted`` share of the hash space are counted over all texts and come first, by count.
The share is a third more than a text's window, so that most windows lie within it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracelake.llm.components import connected_components
from tracelake.llm.scratch import keep, release, tidy, unused
from tracelake.llm.words import WordHashes, chunks, hash_words, sequence_hash, slices, window_hashes

#: At most so many ids are broadcast (8 bytes each, and as much again for the region); above it Spark shuffles.
BROADCAST_IDS = 1_000_000
#: A region's weight is its shingles and so many for each text, which bounds its texts too.
DOC_WEIGHT = 400
#: What one task joins; larger regions are split first.
REGION_SHINGLES = 2_000_000
#: Text pivots of a region at a time.
PIVOTS = 16
#: Texts that are compared without pivots.
SMALL = 64
#: Distributed rounds before tiles.
ROUNDS = 6
#: Regions up to so many times the limit are compared by tiles at once, which repeats a text at most ``2 * TILED - 1`` times.
TILED = 4
#: How often the first pivots may repeat the texts of a large region.
REPEATS = 4


def _least_shared(n: np.ndarray | int, percent: int):
    return -(-percent * n // 100)


def _shingle_sets(texts: list[bytes | None], known: WordHashes, width: int) -> Iterator[np.ndarray]:
    for a, b in chunks(texts):
        words, starts = hash_words(texts[a:b], known, lower=True)
        windows = window_hashes(words, width)
        for s, e in zip(starts[:-1], starts[1:], strict=True):
            if e - s >= width:
                yield np.unique(windows[s : e - width + 1])
            elif e > s:
                yield np.array([sequence_hash(words[s:e])], np.uint64)
            else:
                yield np.zeros(0, np.uint64)


def _describe(width: int, percent: int, counted: float):
    edge = np.uint64(int(counted * 2**64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in slices(batches):
            n, digest, near, far = [], [], [], []
            for x in _shingle_sets(batch.column("text").to_pylist(), known, width):
                cut = int(np.searchsorted(x, edge))
                need = len(x) - int(_least_shared(len(x), percent)) + 1 if len(x) else 0
                n.append(len(x))
                digest.append(xxhash.xxh3_128_digest(x.tobytes()))
                near.append(x[:cut].view(np.int64))
                far.append(x[cut : max(cut, need)].view(np.int64))
            cols = [*batch.columns[:3], pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(near, pa.list_(pa.int64())), pa.array(far, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, names=["row", "id", "t64", "n", "digest", "near", "far"])

    return run


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in slices(batches):
            sets = [x.tobytes() for x in _shingle_sets(batch.column("text").to_pylist(), known, width)]
            yield pa.RecordBatch.from_arrays([batch.column("region"), batch.column("doc"), pa.array(sets, pa.binary())], names=["region", "doc", "shingles"])

    return run


def _differences(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each set against the shingles that more than half of the sets hold: how many differ, and ``(set, shingle)`` of the differences that others share."""
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, token, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    common = np.flatnonzero(2 * count > len(sets))
    column = np.full(len(count), -1)
    column[common] = np.arange(len(common))
    usual = column[token] >= 0
    lacks = np.ones((len(sets), len(common)), bool)
    lacks[owner[usual], column[token[usual]]] = False
    size = np.bincount(owner[~usual], minlength=len(sets)) + lacks.sum(axis=1)
    shared = ~usual & (count[token] > 1)
    lack_set, lack_column = np.nonzero(lacks)
    return size, np.concatenate([owner[shared], lack_set]), np.concatenate([token[shared], common[lack_column]])


def windows_of(sets: list[np.ndarray], pivots: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Texts x pivots: whether they link, and whether the pivot's distance is at most twice the reach more than that of the nearest one."""
    tokens = np.unique(np.concatenate(pivots))
    holds = np.zeros((len(tokens) + 1, len(pivots)), np.int32)
    for j, p in enumerate(pivots):
        holds[np.searchsorted(tokens, p), j] = 1
    n, of = np.array([len(x) for x in sets], np.int64), np.array([len(p) for p in pivots], np.int64)
    same = np.zeros((len(sets), len(pivots)), np.int64)
    first = 0
    while first < len(sets):
        last = max(first + 1, int(np.searchsorted(np.cumsum(n[first:]), 500_000)) + first)
        values = np.concatenate(sets[first:last])
        at = np.searchsorted(tokens, values)
        at[tokens[np.minimum(at, len(tokens) - 1)] != values] = len(tokens)
        same[first:last] = np.add.reduceat(holds[at], np.concatenate([[0], np.cumsum(n[first:last])[:-1]]), axis=0)
        first = last
    union = n[:, None] + of - same
    apart = 1 - same / union
    reach = 1 - percent / 100
    return 100 * same >= percent * union, apart <= apart.min(axis=1, keepdims=True) + 2 * reach + 1e-9


class _Region:
    """The texts of one region: links that connect all texts within reach of each other."""

    def __init__(self, ids: np.ndarray, sets: list[np.ndarray], percent: int):
        self.ids, self.sets, self.percent = ids, sets, percent
        self.n = np.array([len(x) for x in sets], np.int64)
        self.root = np.arange(len(ids))
        self.links: list[tuple[int, int]] = []

    def join(self, i: int, j: int, link: bool = True) -> None:
        a, b = self.root[i], self.root[j]
        if a != b:
            self.root[self.root == max(a, b)] = min(a, b)
            if link:
                self.links.append((int(self.ids[i]), int(self.ids[j])))

    def solve(self, members: np.ndarray) -> None:
        """Voronoi regions of text pivots, recursively; ``pairs`` where they do not get smaller."""
        stack = [members]
        while stack:
            m = stack.pop()
            if len(np.unique(self.root[m])) < 2:
                continue
            if len(m) > SMALL:
                pivots = m[np.linspace(0, len(m) - 1, min(PIVOTS, math.isqrt(len(m)))).astype(int)]
                linked, window = windows_of([self.sets[i] for i in m], [self.sets[i] for i in pivots], self.percent)
                for i, j in zip(*np.nonzero(linked), strict=True):
                    self.join(int(pivots[j]), int(m[i]))
                parts = [m[window[:, j]] for j in range(len(pivots))]
                if sum(len(x) ** 2 for x in parts) <= len(m) ** 2 / 2:
                    stack += [x for x in parts if len(x) > 1]
                    continue
            self.pairs(m)

    def pairs(self, m: np.ndarray) -> None:
        """A region that no pivot splits. Its texts are compared by how they differ from what most of them share, by way of postings."""
        if len(np.unique(self.root[m])) < 2:
            return
        size, owner, token = _differences([self.sets[i] for i in m])
        by_token = np.argsort(token, kind="stable")
        holders = owner[by_token]
        at = np.searchsorted(token[by_token], np.arange(token.max() + 2 if len(token) else 1))
        by_owner = np.argsort(owner, kind="stable")
        tokens = token[by_owner]
        own = np.searchsorted(owner[by_owner], np.arange(len(m) + 1))
        n = self.n[m]
        for i in range(len(m) - 1):
            later = np.flatnonzero(self.root[m[i + 1 :]] != self.root[m[i]]) + i + 1
            if not len(later):
                continue
            lists = [holders[at[t] : at[t + 1]] for t in tokens[own[i] : own[i + 1]]]
            both = np.bincount(np.concatenate(lists), minlength=len(m))[later] if lists else 0
            apart = size[i] + size[later] - 2 * both
            same = (n[i] + n[later] - apart) // 2
            for j in later[100 * same >= self.percent * (same + apart)]:
                self.join(int(m[i]), int(m[j]))


def _join_region(percent: int):
    def run(rows: pa.Table) -> pa.Table:
        texts = dict(sorted(zip(rows["doc"].to_pylist(), rows["shingles"].to_pylist(), strict=True)))
        region = _Region(np.array(list(texts), np.int64), [np.frombuffer(x, np.uint64) for x in texts.values()], percent)
        region.solve(np.arange(len(texts)))
        return pa.table({"a": pa.array([a for a, _ in region.links], pa.int64()), "b": pa.array([b for _, b in region.links], pa.int64())})

    return run


def _to_pivots(percent: int):
    """A cell of a region against all the region's pivots: one row for each window that a text lies in."""

    def run(cell: pa.Table, pivots: pa.Table) -> pa.Table:
        linked, window = windows_of([np.frombuffer(x, np.uint64) for x in cell["shingles"].to_pylist()], [np.frombuffer(x, np.uint64) for x in pivots["held"].to_pylist()], percent)
        i, j = np.nonzero(window | linked)
        rows = cell.take(pa.array(i)).select(["region", "doc", "n"])
        return rows.append_column("pivot", pivots["pivot"].take(pa.array(j))).append_column("linked", pa.array(linked[i, j]))

    return run


def _usual(rows: pa.Table) -> pa.Table:
    """The shingles that more than half of a cell's texts hold."""
    token, count = np.unique(np.concatenate([np.frombuffer(x, np.uint64) for x in rows["shingles"].to_pylist()]), return_counts=True)
    token = token[2 * count > rows.num_rows]
    fill = lambda c, t: pa.array(np.full(len(token), rows[c][0].as_py()), t)
    return pa.table({"region": fill("region", pa.int64()), "cells": fill("cells", pa.int32()), "token": pa.array(token.view(np.int64))})


def _from_core(percent: int):
    """A cell's texts as differences from the region's core, with their e."""

    def run(cell: pa.Table, core: pa.Table) -> pa.Table:
        usual = np.sort(core["token"].to_numpy().astype(np.int64).view(np.uint64))
        apart = [np.setxor1d(np.frombuffer(x, np.uint64), usual, assume_unique=True) for x in cell["shingles"].to_pylist()]
        e = np.array([len(x) for x in apart], np.int64) * (100 + percent) - (100 - percent) * cell["n"].to_numpy()
        out = cell.select(["region", "doc"]).append_column("e", pa.array(e))
        return out.append_column("apart", pa.array([x.view(np.int64) for x in apart], pa.list_(pa.int64())))

    return run


def _few(rows: DataFrame) -> DataFrame:
    """``rows`` of a few numbers each, broadcast if there are not many."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_IDS else rows


def _smallest_alike(parts: DataFrame) -> DataFrame:
    """Of the regions of ``(region, doc)`` that hold the same texts, one."""
    who = [F.sum(F.xxhash64("doc").cast("decimal(38,0)")).alias("who"), F.bit_xor(F.xxhash64("doc", F.lit(1))).alias("who2"), F.count("*").alias("m")]
    alike = parts.groupBy("region").agg(*who).where("m > 1").groupBy("m", "who", "who2").agg(F.min("region").alias("region"))
    return parts.join(_few(keep(alike.select("region"), "alike")), "region")


def _by_core(own: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Regions that texts do not split: smaller regions ``(region, doc)`` by rare shared differences from the core, and links to the innermost text."""
    unit = 2 * (100 + percent)
    usual = own.groupBy("region", "cell").applyInArrow(_usual, "region long, cells int, token long")
    core = usual.groupBy("region", "token").agg(F.count("*").alias("c"), F.max("cells").alias("cells")).where("2 * c > cells").select("region", "token")
    core = own.select("region", "cell").distinct().join(core, "region").select(F.col("region").alias("of"), F.col("cell").alias("at"), "token")
    apart = own.groupBy("region", "cell").cogroup(core.groupBy("of", "at")).applyInArrow(_from_core(percent), "region long, doc long, e long, apart array<bigint>")
    apart = keep(apart, "differences")
    centre = apart.groupBy("region").agg(F.min(F.struct("e", "doc")).alias("c")).select("region", F.col("c.e").alias("least"), F.col("c.doc").alias("centre"))
    rated = apart.join(_few(keep(centre, "centres")), "region").withColumn("far", F.col("e") + F.col("least") > 0)
    links = rated.where("NOT far").select(F.col("centre").alias("a"), F.col("doc").alias("b"))
    nearest = rated.where("far").groupBy("region").agg(F.min("e").alias("far_e"))
    other = F.when(F.col("far"), F.col("least")).otherwise(F.col("far_e"))
    need = F.greatest(F.ceil((F.col("e") + other) / unit), F.lit(1))
    rated = rated.join(_few(keep(nearest, "nearest")), "region").select("region", "doc", "far", "apart", (F.size("apart") - need + 1).alias("take")).where("take > 0")
    each = rated.select("region", "doc", "far", F.explode("apart").alias("token"))
    live = each.groupBy("region", "token").agg(F.count("*").alias("m"), F.max("far").alias("any")).where("m > 1 AND any").drop("any")
    live = keep(live, "live")
    shared = each.join(live, ["region", "token"]).groupBy("region", "doc").agg(F.sort_array(F.collect_list(F.struct("m", "token"))).alias("shared"))
    # differences that no other text of use has come first in the order, and lead nowhere
    left = (F.col("take") - (F.size("apart") - F.size("shared"))).cast("int")
    first = rated.join(shared, ["region", "doc"]).withColumn("left", left).where("left > 0").select("region", "doc", "far", F.explode(F.slice("shared", F.lit(1), F.col("left"))).alias("x"))
    parts = keep(first.select(F.xxhash64("region", "x.token").alias("region"), "doc", "far"), "parts")
    wanted = parts.groupBy("region").agg(F.max("far").alias("any"), F.count("*").alias("m")).where("any AND m > 1").select("region")
    return _smallest_alike(keep(parts.select("region", "doc").join(_few(keep(wanted, "wanted")), "region"), "parts")), links


def _weighed(own: DataFrame) -> DataFrame:
    """``own`` with its region's ``weight``; weights are counted first, so that a hot region is no task of its own."""
    weight = keep(own.groupBy("region").agg(F.sum(F.col("n") + DOC_WEIGHT).alias("weight")), "weights")
    return own.join(_few(weight), "region")


def _sized(regions: DataFrame, sets: DataFrame) -> DataFrame:
    """``(region, doc, n, weight)``."""
    return _weighed(keep(regions.join(sets.select("doc", "n"), "doc"), "sizes"))


def _cells(own: DataFrame, sets: DataFrame, limit: int, number: int) -> DataFrame:
    """Each region's texts dealt to cells of about half of ``limit`` shingles, with their sets."""
    cells = F.ceil(2 * F.col("weight") / limit).cast("int")
    dealt = own.select("region", "doc", "n", "weight", cells.alias("cells")).withColumn("cell", F.pmod(F.xxhash64("doc", F.lit(number)), F.col("cells")).cast("int"))
    return dealt.join(sets.select("doc", "shingles"), "doc")


def _tiles(own: DataFrame) -> DataFrame:
    """Every two cells of a region as a region of their own."""
    other = F.explode(F.sequence(F.lit(0), F.col("cells") - 1))
    pair = own.select("region", "doc", "cell", "cells", other.alias("with"))
    return pair.where("cells = 1 OR cell != with").select(F.xxhash64("region", F.least("cell", "with"), F.greatest("cell", "with")).alias("region"), "doc")


def split_hot(regions: DataFrame, sets: DataFrame, percent: int, limit: int, rounds: int | None = None) -> tuple[DataFrame, list[DataFrame]]:
    """``(region, doc)`` taken apart until no region is over ``limit`` shingles, and the links found on the way; ``sets``: ``(doc, n, shingles)``."""
    done: list[DataFrame] = []
    links: list[DataFrame] = []
    for number in range(ROUNDS if rounds is None else rounds):
        own = keep(_sized(regions, sets), "regions")
        done.append(own.where(F.col("weight") <= limit).select("region", "doc"))
        done.append(_tiles(_cells(own.where((F.col("weight") > limit) & (F.col("weight") <= TILED * limit)), sets, limit, -1)))
        own = own.where(F.col("weight") > TILED * limit)
        if not own.take(1):
            return _union(done), links
        own = keep(_cells(own, sets, limit, number), "cells")
        nearest = F.min(F.struct(F.xxhash64("doc", F.lit(number + 100)), "doc"))
        pivots = own.groupBy("region", F.pmod("cell", F.lit(PIVOTS)).alias("g")).agg(nearest.alias("x")).select("region", F.col("x.doc").alias("doc"))
        pivots = own.select("region", "cell").distinct().join(pivots, "region").join(sets.select("doc", "shingles"), "doc")
        pivots = pivots.select(F.col("region").alias("of"), F.col("cell").alias("at"), F.col("doc").alias("pivot"), F.col("shingles").alias("held"))
        found = own.groupBy("region", "cell").cogroup(pivots.groupBy("of", "at")).applyInArrow(_to_pivots(percent), "region long, doc long, n long, pivot long, linked boolean")
        found = keep(found, "windows")
        links.append(found.where("linked").select(F.col("pivot").alias("a"), F.col("doc").alias("b")))
        sizes = found.groupBy("region", "pivot").agg(F.sum(F.col("n") + DOC_WEIGHT).alias("part")).groupBy("region").agg(F.max("part").alias("top"), F.sum("part").alias("total"))
        smaller = own.groupBy("region").agg(F.max("weight").alias("weight")).join(sizes, "region").where("top <= 0.7 * weight AND total <= 3 * weight")
        smaller = _few(keep(smaller.select("region"), "split"))
        regions = found.join(smaller, "region").select(F.xxhash64("region", "pivot").alias("region"), "doc")
        rest = own.join(smaller, "region", "left_anti")
        if rest.take(1):
            parts, near = _by_core(rest, percent)
            links.append(near)
            regions = regions.unionByName(parts)
        regions = keep(regions, "regions")
    own = _sized(regions, sets)
    done.append(own.where(F.col("weight") <= limit).select("region", "doc"))
    done.append(_tiles(_cells(own.where(F.col("weight") > limit), sets, limit, -1)))
    return _union(done), links


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for x in frames[1:]:
        out = out.unionByName(x)
    return out


def _held(about: DataFrame, percent: int) -> DataFrame:
    """``(doc, n, lead, part)``: the first pivots of each text that others hold too; texts within reach of each other share a part.

    Shingles are counted before they are joined back, and sizes of a pivot's texts are cut by their distinct values, so that a shingle
    in a third of all texts is never one task's rows.
    """
    first = about.select("doc", F.explode("near").alias("token"))
    counts = first.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    seen = first.join(counts, "token").groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("seen"))
    need: Column = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1 - (F.col("n_near") - F.coalesce(F.size("seen"), F.lit(0)))
    rare = about.select("doc", "n", F.size("near").alias("n_near"), "far").join(seen.withColumn("has", F.lit(1)), "doc", "left")
    rare = rare.withColumn("seen", F.coalesce("seen", F.expr("CAST(array() AS array<struct<df:bigint,token:bigint>>)"))).withColumn("need", need.cast("int")).where("need > 0")
    pivots = F.concat(F.transform(F.slice("seen", F.lit(1), F.col("need")), lambda x: x["token"]), "far")
    held = keep(rare.select("doc", "n", F.explode(pivots).alias("token")), "prefixes")
    by_size = W.partitionBy("token").orderBy("n")
    gap = F.when(F.lag("n").over(by_size) * 100 >= percent * F.col("n"), 0).otherwise(1)
    sizes = held.groupBy("token", "n").agg(F.count("*").alias("m"), F.min("doc").alias("lead"))
    sizes = sizes.withColumn("gap", gap).withColumn("cut", F.sum("gap").over(by_size))
    part = W.partitionBy("token", "cut")
    sizes = sizes.select("token", "n", "cut", F.sum("m").over(part).alias("many"), F.min("lead").over(part).alias("lead")).where("many > 1")
    return keep(held.join(sizes, ["token", "n"]).select("doc", "n", "lead", F.xxhash64("token", "cut").alias("part")), "held")


def _sets_of(texts: DataFrame, kinds: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """``(region, doc, shingles)`` of the wanted ``(region, doc)``, made again from one text of each."""
    one = keep(wanted.join(kinds.select("doc", "row"), "doc"), "wanted")
    return texts.join(_few(one), "row").select("region", "doc", "text").mapInArrow(_sets(shingle), "region long, doc long, shingles binary")


def _large_regions(held: DataFrame, large: DataFrame) -> DataFrame:
    """``(region, doc)``: a large set of overlapping regions taken apart by its pivots, or left whole where that would repeat its texts more than ``REPEATS`` times.

    The pivots of near copies are held by nearly all of them, each by a few less: such texts are better split from their core.
    """
    weight = F.sum(F.col("n") + DOC_WEIGHT).alias("part_weight")
    parts = held.groupBy("part", "lead").agg(F.count("*").alias("m"), F.sum(F.xxhash64("doc").cast("decimal(38,0)")).alias("who"), F.bit_xor(F.xxhash64("doc", F.lit(1))).alias("who2"), weight)
    parts = parts.groupBy("m", "who", "who2").agg(F.min(F.struct("part", "lead", "part_weight")).alias("x")).select("x.*")
    rated = keep(parts.join(large.select(F.col("doc").alias("lead"), "region", "weight"), "lead").select("part", "part_weight", "region", "weight"), "rated")
    apart = rated.groupBy("region").agg((F.sum("part_weight") <= REPEATS * F.max("weight")).alias("apart"))
    apart = _few(keep(apart.where("apart").select("region"), "apart"))
    by_pivot = held.join(_few(keep(rated.join(apart, "region").select("part"), "by-pivot")), "part").select(F.col("part").alias("region"), "doc")
    return by_pivot.unionByName(large.join(apart, "region", "left_anti").select("region", "doc"))


def jaccard_links(texts: DataFrame, kinds: DataFrame, about: DataFrame, shingle: int, percent: int, region_shingles: int) -> DataFrame:
    """Links ``(a, b)`` that connect every two distinct sets within reach of each other.

    texts: ``row``, ``text`` (binary); kinds: a ``row`` of each set ``doc``; about: what ``_describe`` gives for it.
    """
    held = _held(about, percent)
    near = connected_components(held.select(F.col("doc").alias("a"), F.col("lead").alias("b"))).toDF("doc", "region")
    own = keep(_weighed(keep(held.select("doc", "n").distinct().join(near, "doc"), "near")), "regions")
    small = own.where(F.col("weight") <= region_shingles).select("region", "doc")
    links: list[DataFrame] = []
    large = own.where(F.col("weight") > region_shingles)
    if large.take(1):
        wanted = large.select(F.lit(0).cast("long").alias("region"), "doc")
        sets = _sets_of(texts, kinds, wanted, shingle).dropDuplicates(["doc"])
        sets = keep(sets.select("doc", (F.length("shingles") / 8).cast("long").alias("n"), "shingles"), "sets")
        left, links = split_hot(_large_regions(held, large), sets, percent, region_shingles)
        links.append(left.join(sets.select("doc", "shingles"), "doc").groupBy("region").applyInArrow(_join_region(percent), "a long, b long"))
    links.append(_sets_of(texts, kinds, small, shingle).groupBy("region").applyInArrow(_join_region(percent), "a long, b long"))
    return _union(links)


def _described(docs: DataFrame, id_col: str, text_col: str, shingle: int, percent: int, counted: float | None) -> tuple[DataFrame, DataFrame]:
    """The texts ``(row, id, t64, text)``, and what ``_describe`` gives for each; a row is known by its id and text, a set (``doc``) by its digest."""
    if counted is None:
        counted = min(1.0, (1 - percent / 100) * 4 / 3)
    text = F.col(f"`{text_col}`")
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.xxhash64(text).alias("t64"), text.cast("binary").alias("text")).withColumn("row", F.xxhash64("id", "t64"))
    described = texts.select("row", "id", "t64", "text").mapInArrow(_describe(shingle, percent, counted), "row long, id long, t64 long, n long, digest binary, near array<long>, far array<long>")
    return texts, keep(described.withColumn("doc", F.xxhash64("digest")).drop("digest"), "shingles")


def _distinct(described: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(doc, first, row, copies)`` for each distinct set, its first id and text and one of its rows; and ``(doc, n, near, far)``."""
    alive = described.where("n > 0 AND id IS NOT NULL")
    rows = alive.groupBy("doc", "row", "id", "t64").agg(F.count("*").alias("times"))
    kinds = keep(rows.groupBy("doc").agg(F.min(F.struct("id", "t64")).alias("first"), F.min("row").alias("row"), F.min_by("times", "row").alias("times"), F.sum("times").alias("copies")), "kinds")
    others = keep(alive.select("doc", "row").join(kinds.select("doc", F.col("row").alias("kept")), "doc").where("row != kept").select("row").distinct(), "copies")
    about = alive.join(_few(others), "row", "left_anti").select("doc", "n", "near", "far")
    return kinds, about.dropDuplicates(["doc"]) if kinds.where("times > 1").take(1) else about


@tidy
def _components(docs: DataFrame, id_col: str, text_col: str, shingle: int, percent: int, counted: float | None, region_shingles: int) -> DataFrame:
    """``(id, t64, n, first)`` of each row: how many shingles, and the first ``(id, t64)`` of its component (null without id or shingles)."""
    texts, described = _described(docs, id_col, text_col, shingle, percent, counted)
    rows = keep(described.select("id", "t64", "n", "doc"), "rows")
    kinds, about = _distinct(described)
    links = keep(jaccard_links(texts, kinds, about, shingle, percent, region_shingles), "found")
    release(described)
    labels = connected_components(links)
    groups = keep(kinds.select("doc", "first").join(labels.toDF("doc", "label"), "doc", "left"), "groups")
    # only components of several sets need their first row looked up
    least = keep(groups.where("label IS NOT NULL").groupBy("label").agg(F.min("first").alias("least")), "firsts")
    groups = groups.join(_few(least), "label", "left").select("doc", F.coalesce("least", "first").alias("least"))
    return rows.join(groups, "doc", "left").select("id", "t64", "n", F.when(F.col("id").isNotNull(), F.col("least")).alias("first"))


def ngram_jaccard_join(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80, counted: float | None = None, region_shingles: int = REGION_SHINGLES
) -> DataFrame:
    """One row a row of ``docs``: ``id_col``, ``n_shingles``, ``component_id``.

    Texts are lower-cased (A-Z), words are runs of anything but space and 0x09-0x0D, a set holds the distinct runs of ``shingle``
    words (the whole sequence where there are fewer words). Two texts link when 100 * shared >= percent * union;
    ``component_id`` is the smallest id reachable by links.

    Null, empty and wordless texts have 0 shingles and are alone. Equal texts link. Rows that share an id but not their text are documents of their own. A null id
    takes no part (component null). An empty table gives no rows; other columns are ignored, whatever their names.
    """
    found = _components(docs, id_col, text_col, shingle, percent, counted, region_shingles)
    return found.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("first.id", "id").alias("component_id"))


def keep_first(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80, counted: float | None = None, region_shingles: int = REGION_SHINGLES
) -> DataFrame:
    """``docs`` with one row of each group of linked texts, that of the smallest id, and all its columns.

    Of rows that are the same in id and text one stays (the first by its other columns). Rows without an id, or without words, stay. Rows that share an id but
    have unlinked texts stay. An empty table gives no rows.
    """
    found = keep(_components(docs, id_col, text_col, shingle, percent, counted, region_shingles), "components")
    found = found.where("first IS NOT NULL")
    name, hash_, rank = unused(docs, "__id", "__t64", "__nth")
    gone = found.where("first.id != id OR first.t64 != t64").select(F.col("id").alias(name), F.col("t64").alias(hash_)).distinct()
    several = keep(found.groupBy("id", "t64").count().where("count > 1").select(F.col("id").alias(name), F.col("t64").alias(hash_)), "several")
    same = (F.col(f"`{id_col}`").cast("long") == F.col(name)) & (F.xxhash64(F.col(f"`{text_col}`")) == F.col(hash_))
    left = docs.join(_few(keep(gone, "gone")), same, "left_anti")
    if not several.take(1):
        return left
    columns = [F.col(f"`{c}`") for c in docs.columns]
    nth = F.row_number().over(W.partitionBy(columns[docs.columns.index(id_col)], F.xxhash64(F.col(f"`{text_col}`"))).orderBy(*columns))
    one = left.join(_few(several), same, "left_semi").withColumn(rank, nth).where(F.col(rank) == 1).drop(rank)
    return left.join(_few(several), same, "left_anti").unionByName(one)


def _count_links(percent: int):
    """Of two tiles of a region, or one: how many rows each text links to in the other, or in its own. A pair counts in the first part that both texts hold."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("side")
        sets = [np.frombuffer(x, np.uint64) for x in rows["shingles"].to_pylist()]
        copies, parts, region = rows["copies"].to_numpy(), [set(x) for x in rows["parts"].to_pylist()], rows["region"][0].as_py()
        n, found = np.array([len(x) for x in sets], np.int64), np.zeros(len(sets), np.int64)
        firsts = int((rows["side"].to_numpy() == 0).sum())
        within = rows["i"][0].as_py() == rows["j"][0].as_py()
        size, owner, token = _differences(sets)
        by_token = np.argsort(token, kind="stable")
        holders = owner[by_token]
        at = np.searchsorted(token[by_token], np.arange(token.max() + 2 if len(token) else 1))
        by_owner = np.argsort(owner, kind="stable")
        tokens = token[by_owner]
        own = np.searchsorted(owner[by_owner], np.arange(len(sets) + 1))
        for i in range(firsts):
            later = np.arange(i + 1 if within else firsts, len(sets))
            if not len(later):
                continue
            lists = [holders[at[t] : at[t + 1]] for t in tokens[own[i] : own[i + 1]]]
            both = np.bincount(np.concatenate(lists), minlength=len(sets))[later] if lists else 0
            apart = size[i] + size[later] - 2 * both
            same = (n[i] + n[later] - apart) // 2
            linked = later[100 * same >= percent * (same + apart)]
            if parts[i]:
                linked = np.array([j for j in linked if min(parts[i] & parts[j]) == region], np.int64)
            found[i] += copies[linked].sum()
            found[linked] += copies[i]
        return pa.table({"doc": rows["doc"], "links": pa.array(found, pa.int64())})

    return run


def ngram_jaccard_link_counts(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80, counted: float | None = None, region_shingles: int = REGION_SHINGLES
) -> DataFrame:
    """One row a row of ``docs``: ``id_col``, ``n_links``, the number of other rows that its text links to.

    Every two distinct texts that share a region are compared, none are passed over because they are connected already. Regions over
    ``region_shingles`` are taken apart by shingle and cut into tiles; each two tiles are one task, and only counts leave it. Rows without shingles have 0 links, rows without an id null;
    rows that share an id count each.
    """
    texts, described = _described(docs, id_col, text_col, shingle, percent, counted)
    kinds, about = _distinct(described)
    held = _held(about, percent)
    near = connected_components(held.select(F.col("doc").alias("a"), F.col("lead").alias("b"))).toDF("doc", "region")
    own = keep(_weighed(keep(held.select("doc", "n").distinct().join(near, "doc"), "near")), "regions")
    small = own.where(F.col("weight") <= region_shingles).select("region", "doc", F.lit(1).alias("tiles"), F.expr("CAST(array() AS array<bigint>)").alias("parts"))
    large = held.join(own.where(F.col("weight") > region_shingles).select("doc"), "doc")
    parts = large.groupBy("doc").agg(F.array_sort(F.collect_set("part")).alias("parts"))
    tiles = large.groupBy("part").agg(F.ceil(F.sum(F.col("n") + DOC_WEIGHT) / (region_shingles / 2)).cast("int").alias("tiles"))
    large = large.join(tiles, "part").join(parts, "doc").select(F.col("part").alias("region"), "doc", "tiles", "parts")
    regions = keep(small.unionByName(large).withColumn("t", F.pmod(F.xxhash64("doc"), F.col("tiles")).cast("int")), "tiles")
    wanted = regions.select(F.lit(0).cast("long").alias("region"), "doc").distinct()
    sets = _sets_of(texts, kinds, wanted, shingle).dropDuplicates(["doc"]).join(kinds.select("doc", "copies"), "doc").select("doc", "copies", "shingles")
    first = F.transform(F.sequence("t", F.col("tiles") - 1), lambda j: F.struct(F.col("t").alias("i"), j.alias("j"), F.lit(0).alias("side")))
    second = F.when(F.col("t") > 0, F.transform(F.sequence(F.lit(0), F.col("t") - 1), lambda i: F.struct(i.alias("i"), F.col("t").alias("j"), F.lit(1).alias("side")))).otherwise(F.slice(first, 1, 0))
    each = regions.select("region", "doc", "parts", F.explode(F.concat(first, second)).alias("g")).select("region", "doc", "parts", "g.*").join(sets, "doc")
    links = each.groupBy("region", "i", "j").applyInArrow(_count_links(percent), "doc long, links long").groupBy("doc").agg(F.sum("links").alias("links"))
    by_set = kinds.join(links, "doc", "left").select("doc", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    return described.select("id", "doc").join(by_set, "doc", "left").select(F.col("id").alias(id_col), F.when(F.col("id").isNotNull(), F.coalesce("n_links", F.lit(0))).alias("n_links"))
