"""Semantic dedup and leader clustering of vectors."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracelake.functions.constants import CLUSTER_MIN, CLUSTER_NEW, CLUSTER_SIMILARITY, DEDUP_INTENT, DEDUP_SCRIPT

#: Rows of one side of a tile, and how many of them a task compares with the other side at a time. Rows are shuffled once for each tile of their block, so tiles are as large as a task can hold.
TILE, STRIP = 8192, 512


def similar_pairs(rows: DataFrame, block: str, key: str, vector: str, least: float = DEDUP_INTENT, script: str | None = None, least_script: float = DEDUP_SCRIPT) -> DataFrame:
    """Exact pairs ``(a, b, similarity)`` with a < b inside a block and a cosine of at least ``least``; with ``script``, the cosine of these vectors must reach ``least_script`` as well.

    A block of n rows is cut into tiles of ``TILE`` rows, and each pair of tiles is one group, so that no task holds more than two tiles
    however large the block is.
    """
    vectors = [vector, *([script] if script else [])]
    sizes = rows.groupBy(block).agg(F.count("*").alias("__n")).withColumn("__tiles", F.ceil(F.col("__n") / TILE).cast("int"))
    x = rows.join(sizes, block).withColumn("__t", F.pmod(F.xxhash64(key), F.col("__tiles")).cast("int"))
    # tile t meets tiles t..last as the first side and 0..t as the second; with itself, it comes once
    first = F.transform(F.sequence(F.col("__t"), F.col("__tiles") - 1), lambda j: F.struct(F.col("__t").alias("i"), j.alias("j"), F.lit(0).alias("side")))
    second = F.transform(F.sequence(F.lit(0), F.col("__t")), lambda i: F.struct(i.alias("i"), F.col("__t").alias("j"), F.lit(1).alias("side")))
    tiles = x.select(block, key, *vectors, F.explode(F.concat(first, F.filter(second, lambda g: g["i"] < g["j"]))).alias("__g")).select(block, key, *vectors, "__g.*")
    unit = lambda f, name: (lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300))(np.stack(f[name].to_numpy()).astype(float))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        a = group[group["side"] == 0]
        b = a if group["i"].iloc[0] == group["j"].iloc[0] else group[group["side"] == 1]
        none = pd.DataFrame({"a": pd.Series(dtype="int64"), "b": pd.Series(dtype="int64"), "similarity": pd.Series(dtype="float64")})
        if not len(a) or not len(b):
            return none
        sides = {name: (unit(a, name), unit(b, name)) for name in vectors}
        ids, others, out = a[key].to_numpy(), b[key].to_numpy(), []
        for at in range(0, len(a), STRIP):
            s = np.round(sides[vector][0][at : at + STRIP] @ sides[vector][1].T, 9)
            near = s >= least
            if script:
                near &= np.round(sides[script][0][at : at + STRIP] @ sides[script][1].T, 9) >= least_script
            i, j = np.nonzero(near)
            ka, kb = ids[at + i], others[j]
            found = pd.DataFrame({"a": np.minimum(ka, kb), "b": np.maximum(ka, kb), "similarity": s[i, j]})
            out.append(found[found["a"] < found["b"]])
        return pd.concat(out).drop_duplicates()

    return tiles.groupBy(block, "i", "j").applyInPandas(run, "a long, b long, similarity double")


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which the driver and all executors share; only a session on one machine may go without."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        found = spark.conf.get("spark.checkpoint.dir", None)
        if not found and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(found or tempfile.mkdtemp(prefix="spark-checkpoint-", dir="/tmp"))
    return sc.getCheckpointDir()


def _cut(df: DataFrame) -> DataFrame:
    shared_folder(df.sparkSession)
    return df.checkpoint()


def components(pairs: DataFrame) -> DataFrame:
    """``(k, component)``: the smallest key each key of ``(a, b)`` is linked to; rounds of the smallest neighbour's label."""
    both = _cut(pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    labels = _cut(both.groupBy(F.col("a").alias("k")).agg(F.least("k", F.min("b")).alias("component")))
    while True:
        seen = both.join(labels.toDF("b", "l"), "b").groupBy(F.col("a").alias("k")).agg(F.min("l").alias("l"))
        moved = labels.join(seen, "k").select("k", F.least("component", "l").alias("component"), (F.col("l") < F.col("component")).alias("m"))
        moved = _cut(moved)
        labels = moved.select("k", "component")
        if not moved.where("m").take(1):
            return labels


def mergeable_pairs(rows: DataFrame, block: str, key: str, intent: str, script: str, least: float = DEDUP_INTENT, least_script: float = DEDUP_SCRIPT) -> DataFrame:
    """Pairs ``(a, b, similarity)`` of ``similar_pairs`` whose script vectors reach ``least_script`` as well; a row without a script vector has none. A tile tries both conditions, so pairs that only their intents make are never written."""
    return similar_pairs(rows.where(F.col(script).isNotNull()), block, key, intent, least, script, least_script)


def merge_replay(pairs: DataFrame, rows: DataFrame, key: str = "experience_id") -> DataFrame:
    """Merges in order of arrival: a row merges with its first live earlier partner; the stronger stays, the newcomer on a tie. A loser is no partner any more.

    ``rows``: key, arrived, strength and, if there are rows that nothing merges with, ``approved``: the newcomer may wait for review, its partner may not. Only rows of one component of ``pairs`` matter to each other. Its pairs stream past in order of arrival, sorted by Spark;
    a task keeps no more than the losers of the component it is at. Returns ``(key, merged_into)`` of the losers.
    """
    own = rows.select(F.col(key).alias("k"), F.struct(F.col("arrived").cast("string").alias("at"), F.col(key).alias("k")).alias("arrived"), F.col("strength").cast("double").alias("strength"), (F.coalesce("approved", F.lit(False)) if "approved" in rows.columns else F.lit(True)).alias("approved"))
    side = lambda name: own.select(F.col("k").alias(name), *(F.col(c).alias(f"{name}_{c}") for c in ("arrived", "strength", "approved")))
    edges = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b")
    later = F.col("a_arrived") > F.col("b_arrived")
    pick = lambda what, first: F.when(later if first else ~later, F.col(f"a{what}")).otherwise(F.col(f"b{what}"))
    edges = _cut(edges.select("a", "b", *(pick(what, first).alias(name + what) for name, first in (("new", True), ("old", False)) for what in ("", "_arrived", "_strength", "_approved"))).where("old_approved"))
    order = edges.join(components(edges).withColumnRenamed("k", "a"), "a").repartition("component").sortWithinPartitions("component", "new_arrived", "old_arrived").select("component", "new", "old", "new_strength", "old_strength")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, done, lost = None, None, set()
        for batch in batches:
            out = []
            for c, new, old, new_strength, old_strength in batch.itertuples(index=False):
                if c != at:
                    at, done, lost = c, None, set()
                if new == done or old in lost:
                    continue
                done = new
                winner, loser = (new, old) if new_strength >= old_strength else (old, new)
                lost.add(loser)
                out.append((loser, winner))
            yield pd.DataFrame(out, columns=[key, "merged_into"], dtype="int64")

    return order.mapInPandas(run, f"{key} long, merged_into long")


def nearest_centroid(rows: DataFrame, centroids: pd.DataFrame, key: str, vector: str, least: float = CLUSTER_SIMILARITY) -> DataFrame:
    """``(key, cluster_id, similarity)``: the best centroid of each row, null below ``least``."""
    ids = centroids["cluster_id"].to_numpy()
    m = np.stack(centroids["centroid"].to_numpy()).astype(float) if len(ids) else np.zeros((0, 1))
    m = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300) if len(ids) else m

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(ids):
                yield pd.DataFrame({key: b[key], "cluster_id": pd.array([None] * len(b), dtype="Int64"), "similarity": -1.0})
                continue
            v = np.stack(b[vector].to_numpy()).astype(float)
            s = np.round((v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)) @ m.T, 9)
            best = s.argmax(axis=1)
            top = s[np.arange(len(v)), best]
            yield pd.DataFrame({key: b[key], "cluster_id": pd.Series(np.where(top >= least, ids[best], None), index=b.index, dtype="Int64"), "similarity": top})

    return rows.select(key, vector).mapInPandas(run, f"{key} long, cluster_id long, similarity double")


def leader_clusters(rows: DataFrame, block: str, key: str, vector: str, least: float = CLUSTER_SIMILARITY) -> DataFrame:
    """Leader rule in order of block and key: join the best centroid of at least ``least``, else found a cluster named by the key; centroids are member means.

    A block is a bounded arrival batch (one task). Blocks follow each other: each starts from the centroids that the blocks before it left in a written
    table, so the result is that of one pass over all rows. The rule has no other order, and the centroids are all that a task holds besides its block.
    """
    row = f"{key} long, cluster_id long, similarity double"
    state = rows.sparkSession.createDataFrame([], "cluster_id long, total array<double>, members long")
    out = []

    def run(group: pd.DataFrame, before: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(key)
        m = np.stack(group[vector].to_numpy()).astype(float)
        before = before.sort_values("cluster_id")
        used = len(before)
        names = np.concatenate([before["cluster_id"].to_numpy(np.int64), np.zeros(len(m), np.int64)])
        counts = np.concatenate([before["members"].to_numpy(np.int64), np.zeros(len(m), np.int64)])
        sums = np.zeros((used + len(m), m.shape[1]))
        if used:
            sums[:used] = np.stack(before["total"].to_numpy())
        norms = np.linalg.norm(sums, axis=1)
        hit, sim = np.zeros(len(m), np.int64), np.ones(len(m))
        for i, (k, v) in enumerate(zip(group[key].to_numpy(), m, strict=True)):
            # the direction of a mean is that of the sum
            s = np.round(sums[:used] @ v / np.maximum(norms[:used] * np.linalg.norm(v), 1e-300), 9)
            at = int(s.argmax()) if used else -1
            if at >= 0 and s[at] >= least:
                sim[i] = s[at]
            else:
                at, names[used] = used, k
                used += 1
            sums[at] += v
            counts[at] += 1
            norms[at] = np.linalg.norm(sums[at])
            hit[i] = names[at]
        found = pd.DataFrame({key: group[key].to_numpy(), "cluster_id": hit, "similarity": sim, "total": None, "members": 0})
        left = pd.DataFrame({key: None, "cluster_id": names[:used], "similarity": 0.0, "total": list(sums[:used]), "members": counts[:used]})
        return pd.concat([found.astype({key: "Int64"}), left.astype({key: "Int64"})])

    for (b,) in rows.where(F.col(key).isNotNull()).select(block).distinct().orderBy(block).collect():
        mine = rows.where(F.col(block).eqNullSafe(F.lit(b)) & F.col(key).isNotNull()).select(key, vector)
        step = _cut(mine.groupBy(F.lit(0).alias("g")).cogroup(state.groupBy(F.lit(0).alias("g"))).applyInPandas(run, f"{row}, total array<double>, members long"))
        out.append(step.where(F.col(key).isNotNull()).select(key, "cluster_id", "similarity"))
        state = step.where(F.col(key).isNull()).select("cluster_id", "total", "members")
    return reduce(DataFrame.unionByName, out) if out else rows.sparkSession.createDataFrame([], row)


def crystallise_candidates(clusters: DataFrame) -> DataFrame:
    """Clusters of enough members without a skill, or with a skill and enough new members."""
    none = F.col("crystallized_skill_id").isNull()
    due = (none & (F.col("member_count") >= CLUSTER_MIN)) | (~none & (F.col("new_since_crystallize") >= CLUSTER_NEW))
    return clusters.where(due).select("cluster_id", F.when(none, "first").otherwise("again").alias("reason"))


def improving_versions(skills: DataFrame) -> DataFrame:
    """Of each cluster's drafts in order, those whose structure score beats all published before."""
    w = W.partitionBy("cluster_id").orderBy("created_at", "skill_id").rowsBetween(W.unboundedPreceding, -1)
    best = F.max("structure_score").over(w)
    out = skills.withColumn("before", best).where(F.col("before").isNull() | (F.col("structure_score") > F.col("before")))
    v = F.row_number().over(W.partitionBy("cluster_id").orderBy("created_at", "skill_id"))
    nxt = F.lead("skill_id").over(W.partitionBy("cluster_id").orderBy("created_at", "skill_id"))
    return out.select("cluster_id", "skill_id", "structure_score", v.alias("version"), nxt.alias("superseded_by"))


def apply_merges(rows: DataFrame, merges: DataFrame, key: str = "experience_id", counts: tuple[str, ...] = ("visit_count", "reuse_count")) -> DataFrame:
    """``rows`` after the merges ``(key, merged_into)``: counts have moved to winners, losers are rejected and tagged ``merged_into:<winner>``.

    A loser hands on what it had been given before, so a row ends with the counts of all rows below it in the forest of merges. They are added up by doubling: each
    round a row takes the sums of those whose pointer has reached it, and pointers skip twice as far; there are as many rounds as the longest chain has bits. Losers keep
    what they had when they lost.
    """
    up = _cut(merges.select(F.col(key).alias("k"), F.col("merged_into").alias("up")))
    member = up.select("k").unionByName(up.select(F.col("up").alias("k"))).distinct()
    sums = _cut(member.join(rows.select(F.col(key).alias("k"), *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts)), "k"))
    while up.take(1):
        given = up.join(sums, "k").groupBy(F.col("up").alias("k")).agg(*(F.sum(c).alias(f"__{c}") for c in counts))
        sums = _cut(sums.join(given, "k", "left").select("k", *((F.col(c) + F.coalesce(f"__{c}", F.lit(0))).alias(c) for c in counts)))
        up = _cut(up.join(up.select(F.col("k").alias("up"), F.col("up").alias("further")), "up").select("k", F.col("further").alias("up")))
    moved = sums.select(F.col("k").alias(key), *(F.col(c).alias(f"__{c}") for c in counts))
    out = rows.join(moved, key, "left").join(merges.select(key, F.col("merged_into").alias("__into")), key, "left")
    lost = F.col("__into").isNotNull()
    tag = F.array(F.concat(F.lit("merged_into:"), F.col("__into").cast("string")))
    none = F.expr("CAST(array() AS array<string>)")
    out = out.withColumns({**{c: F.coalesce(F.col(f"__{c}"), F.col(c).cast("long")) for c in counts}, "review_status": F.when(lost, "rejected").otherwise(F.col("review_status")), "tags": F.when(lost, F.concat(F.coalesce("tags", none), tag)).otherwise(F.col("tags"))})
    return out.drop("__into", *(f"__{c}" for c in counts))
