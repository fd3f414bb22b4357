"""Connected components by randomised contraction; links and labels stay distributed."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.llm.scratch import keep, tidy

#: So many links that are left after some rounds are finished by one task (16 bytes each); more take another round.
LAST_LINKS = 16_384


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            a, b = root(a), root(b)
            up[max(a, b)] = min(a, b)
    nodes = list(up)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([root(x) for x in nodes], pa.int64())], names=["node", "up"])


@tidy
def connected_components(links: DataFrame, a: str = "a", b: str = "b", last_links: int = LAST_LINKS) -> DataFrame:
    """``(node, component)`` for each node of ``links`` (long ids); the component is its smallest node.

    Each round puts the nodes in an order, maps every node to the first of itself and its neighbours, and rewrites the links between the images. The order
    of the first, third, ... round is that of the ids, which settles groups that hang on their smallest node; that of the others is by a fresh hash, so that for any graph
    and any numbering of its nodes (a chain in order of its ids too) a share of the nodes that still have links is expected to go: rounds grow with the
    logarithm of the nodes. The last ``last_links`` links are finished at once. The maps are then composed from the last to the first. Null ends and loops of a node to
    itself are left out; no links give an empty table.
    """
    edges = keep(links.where(F.col(a) != F.col(b)).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct(), "links")
    left = edges.count()
    maps: list[DataFrame] = []
    while left > last_links:
        number = len(maps)

        def ranked(node: str, number: int = number) -> Column:
            return F.struct((F.xxhash64(node, F.lit(number)) if number % 2 else F.col(node)).alias("h"), F.col(node).alias("node"))

        both = edges.union(edges.select("b", "a")).toDF("node", "other")
        step = keep(both.groupBy("node").agg(F.min(ranked("other")).alias("o")).select("node", F.least(ranked("node"), F.col("o"))["node"].alias("up")), "step")
        maps.append(step)
        images = edges.join(step.toDF("a", "a_up"), "a").select("a_up", "b").join(step.toDF("b", "b_up"), "b").where("a_up != b_up")
        edges = keep(images.select(F.least("a_up", "b_up").alias("a"), F.greatest("a_up", "b_up").alias("b")).distinct(), "links")
        left = edges.count()
    maps.append(keep(edges.coalesce(1).mapInArrow(_finish, "node long, up long"), "step"))
    out = maps[-1].toDF("node", "image")
    for step in reversed(maps[:-1]):
        out = keep(step.join(out.toDF("up", "image"), "up", "left").select("node", F.coalesce("image", "up").alias("image")), "labels")
    if len(maps) == 1:
        return keep(out.toDF("node", "component"), "labels")
    least = keep(out.groupBy("image").agg(F.min("node").alias("component")), "components")
    return keep(out.join(least, "image").select("node", "component"), "labels")
