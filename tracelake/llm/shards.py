"""Vector bin packing of documents into shards: bytes, tokens and rows balanced together.

A group is all rows of one text. Each goes to the shard where the dot product of its vector with the shards' residual capacities
(all in shares of one shard's capacity) is highest, large groups first. Groups of more than 1/64 of a shard in some measure are at most
``192 * shards`` and are placed on the driver; those over a quarter of a shard are first split by id. The others are dealt by hash
to cells of about ``cell_rows`` rows, and each cell packs its groups against its share of what the large ones left.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracelake.llm.scratch import keep

_LARGE = 64
_PIECE = 4


def place(items: np.ndarray, residual: np.ndarray, first: int = 0) -> np.ndarray:
    """The shard of each item, placed in the given order; ``residual`` (shards x measures) is used up. Ties go to ``first`` and on."""
    shards = len(residual)
    residual = np.roll(residual, -first, axis=0)
    out = np.empty(len(items), np.int64)
    for i, item in enumerate(items):
        score = residual @ item
        fits = (residual >= item).all(axis=1)
        best = int(np.where(fits, score, -np.inf).argmax()) if fits.any() else int(score.argmax())
        residual[best] -= item
        out[i] = best
    return (out + first) % shards


def _pack(capacity: list[float], left: list[list[float]]):
    cap, rest = np.array(capacity), np.array(left)
    total = rest.sum(axis=0)

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        items = rows[["bytes", "tokens", "rows"]].to_numpy(float) / cap
        order = np.lexsort((rows["key"].to_numpy(), -items.max(axis=1)))
        share = np.divide(items.sum(axis=0), total, out=np.zeros(3), where=total > 0)
        shard = np.empty(len(rows), np.int64)
        shard[order] = place(items[order], rest * share, int(key[0]) % len(rest))
        return pd.DataFrame({"key": rows["key"], "shard": shard.astype(np.int32)})

    return run


def pack_shards(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", cell_rows: int = 20_000) -> DataFrame:
    """One row a row of ``docs``: id, ``size`` (UTF-8 bytes + 8), ``text_crc32``, ``law`` ("bytes"), ``shard``, ``slot``, ``grown_shard`` (null).

    Slots count from 0 without gaps in each shard. Rows of equal text share a shard unless together they exceed a quarter of one, when they are
    split by id. Null texts are 8 bytes and one group, with the crc of no bytes, 0. Rows repeated as a whole get a slot each. An empty table gives
    no rows; other columns are ignored.
    """
    text = F.col(f"`{text_col}`")
    words = F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")).cast("long")
    slim = docs.select(
        F.col(f"`{id_col}`").alias("doc"), (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"), words.alias("tokens"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("crc"), F.coalesce(F.md5(text.cast("binary")), F.lit("")).alias("key"),
    )
    slim = keep(slim, "sizes")
    total = slim.agg(F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count("*").alias("rows")).first()
    cap = [max(1.0, (total[c] or 0) / shards) for c in ("bytes", "tokens", "rows")]
    measures = [F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count("*").alias("rows")]
    part = F.greatest(*(F.col(c) / x for c, x in zip(("bytes", "tokens", "rows"), cap, strict=True)))
    groups = slim.groupBy("key").agg(*measures).withColumn("part", part)
    large = keep(groups.where(F.col("part") > 1 / _LARGE).select("key", F.ceil(F.col("part") * _PIECE).cast("int").alias("pieces")), "large")
    # at most 3 * shards * 64 rows
    rows = slim.join(F.broadcast(large), "key", "left").withColumn("piece", F.pmod(F.xxhash64("doc"), F.coalesce("pieces", F.lit(1))))
    pieces = sorted(
        rows.where("pieces IS NOT NULL").groupBy("key", "piece").agg(*measures).collect(),
        key=lambda x: (-max(x["bytes"] / cap[0], x["tokens"] / cap[1], x["rows"] / cap[2]), x["key"], x["piece"]),
    )
    residual = np.ones((shards, 3))
    items = np.array([[x["bytes"] / cap[0], x["tokens"] / cap[1], x["rows"] / cap[2]] for x in pieces]).reshape(-1, 3)
    placed = place(items, residual)
    for shard, item in zip(placed, items, strict=True):
        residual[shard] -= item
    spark = docs.sparkSession
    where = spark.createDataFrame([(x["key"], int(x["piece"]), int(s)) for x, s in zip(pieces, placed, strict=True)], "key string, piece long, shard int")
    cells = max(1, -(-(total["rows"] or 0) // cell_rows))
    small = groups.where(F.col("part") <= 1 / _LARGE).withColumn("cell", F.pmod(F.xxhash64("key"), F.lit(cells)))
    packed = small.groupBy("cell").applyInPandas(_pack(cap, np.maximum(residual, 0).tolist()), "key string, shard int")
    put = rows.where("pieces IS NULL").select("key", "doc", "size", "crc").join(packed, "key").select("doc", "size", "crc", "key", "shard")
    put = put.unionByName(rows.where("pieces IS NOT NULL").join(F.broadcast(where), ["key", "piece"]).select("doc", "size", "crc", "key", "shard"))
    put = keep(put.withColumn("cell", F.pmod(F.xxhash64("doc", "key"), F.lit(cells))), "placed")
    counts = put.groupBy("shard", "cell").agg(F.count("*").alias("n"))
    before = F.sum("n").over(W.partitionBy("shard").orderBy("cell").rowsBetween(W.unboundedPreceding, -1))
    starts = counts.select("shard", "cell", F.coalesce(before, F.lit(0)).alias("start"))
    nth = F.row_number().over(W.partitionBy("shard", "cell").orderBy("doc", "key"))
    out = put.withColumn("nth", nth).join(starts, ["shard", "cell"])
    return out.select(
        F.col("doc").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard",
        (F.col("start") + F.col("nth") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
