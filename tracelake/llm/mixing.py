"""Temperature mixing of sources, realised as budgeted block permutations.

Source weights are token shares to the power ``a``, normalised; ``a`` in [0, 1] is found by bisection. Each pass over the table of
sources measures the 31 points that five steps of bisection can reach and takes the five steps, so a pass returns one row of fixed
size however many sources there are. A source's documents lie in blocks in a pseudo-random order; a budget takes the whole order
as often as it goes in, and then blocks from its start up to the rest.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracelake.llm.scratch import keep, unused

#: Rows of the source table or of the copies that are broadcast at most; above it Spark shuffles.
BROADCAST_SOURCES = 100_000
BROADCAST_ROWS = 1_000_000
_STEPS = 5


def _measure(sources: DataFrame, at: list[float], total: float, budget: float | None) -> list[tuple[float, float]]:
    """Entropy of the weights, and most repetitions of a source, for each exponent."""
    p = F.col("tokens") / total
    aggs = []
    for i, a in enumerate(at):
        aggs += [F.sum(F.pow(p, F.lit(a))).alias(f"z{i}"), F.sum(F.pow(p, F.lit(a)) * F.log(p)).alias(f"s{i}"), F.max(F.pow(p, F.lit(a - 1))).alias(f"hi{i}"), F.min(F.pow(p, F.lit(a - 1))).alias(f"lo{i}")]
    row = sources.where("tokens > 0").agg(*aggs).first()
    out = []
    for i, a in enumerate(at):
        z = row[f"z{i}"]
        entropy = math.log(z) - a * row[f"s{i}"] / z
        out.append((entropy, row[f"hi{i}"] / row[f"lo{i}"] if budget is None else row[f"hi{i}"] * budget / (z * total)))
    return out




def _bisect(sources: DataFrame, total: float, budget: float | None, good, passes: int = 8) -> float:
    """The end of [0, 1] nearest to where ``good`` changes, on its good side; ``good(entropy, repetitions)`` is monotone in the exponent."""
    first, last = (good(*x) for x in _measure(sources, [0.0, 1.0], total, budget))
    if first == last:
        return 1.0 if last else 0.0
    lo, hi = 0.0, 1.0
    for _ in range(passes):
        n = 2**_STEPS
        points = [lo + (hi - lo) * i / n for i in range(1, n)]
        fine = [good(*x) for x in _measure(sources, points, total, budget)]
        a, b = 0, n
        for _ in range(_STEPS):
            mid = (a + b) // 2
            a, b = (mid, b) if fine[mid - 1] == first else (a, mid)
        lo, hi = lo + (hi - lo) * a / n, lo + (hi - lo) * b / n
    return lo if first else hi


def source_weights(sources: DataFrame, budget: float | None, entropy: float | None, max_epochs: float | None) -> tuple[float, float, float]:
    """``(exponent, normaliser, budget)`` for a table ``(source, tokens)``.

    entropy: the weights' entropy is at least this share of the log of the number of sources, with the largest exponent that gives it.
    max_epochs: no source is repeated more often; where both bind, this wins. budget None: just enough that the least repeated source is taken once.
    """
    about = sources.where("tokens > 0").agg(F.sum("tokens").alias("total"), F.count("*").alias("n")).first()
    total, n = float(about["total"] or 0), about["n"]
    if not n:
        return 1.0, 1.0, 0.0
    a = 1.0
    if entropy is not None:
        most = math.log(n) * entropy
        a = _bisect(sources, total, budget, lambda h, _: h >= most - 1e-12)
    if max_epochs is not None:
        a = max(a if entropy is not None else 0.0, _bisect(sources, total, budget, lambda _, r: r <= max_epochs + 1e-9))
    p = F.col("tokens") / total
    row = sources.where("tokens > 0").agg(F.sum(F.pow(p, F.lit(a))).alias("z"), F.max(F.pow(p, F.lit(1 - a))).alias("m")).first()
    return a, row["z"], float(budget) if budget is not None else total * row["z"] * row["m"]


def mix_sources(
    docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", budget: float | None = None, budget_share: float | None = None,
    entropy: float | None = None, max_epochs: float | None = None, block_tokens: int = 1_000_000, seed: int = 17,
) -> DataFrame:
    """One row a row of ``docs``: ``id``, ``t64`` (hash of the text), ``source``, ``n_tokens``, ``weight``, ``budget``, ``copies``, ``block``, ``position``.

    Tokens are words. ``budget`` tokens (or ``budget_share`` of all, or none: see ``source_weights``) go to sources by weight. ``copies`` is how often the row is
    taken, ``position`` the tokens before it in its source's order. What is taken of a source exceeds its budget by less than one document.

    Null sources are one source. Sources without tokens have weight 0 and their rows no copies. Null texts have no tokens. Repeated rows count each.
    An empty table gives no rows; other columns are ignored.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    n_words = F.size(F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")).cast("long")
    slim = keep(docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(F.col(f"`{text_col}`")).alias("t64"), F.col(f"`{source_col}`").alias("source"), n_words.alias("n_tokens")), "tokens")
    sources = keep(slim.groupBy("source").agg(F.sum("n_tokens").alias("tokens")), "sources")
    about = sources.agg(F.sum("tokens").alias("total"), F.count("*").alias("n")).first()
    total = float(about["total"] or 0)
    if budget_share is not None:
        budget = total * budget_share
    a, z, budget = source_weights(sources, budget, entropy, max_epochs)
    few = about["n"] <= BROADCAST_SOURCES
    weight = F.when(F.col("tokens") > 0, F.pow(F.col("tokens") / max(total, 1.0), F.lit(a)) / z).otherwise(0.0)
    plan = sources.withColumn("weight", weight).withColumn("budget", F.round(F.col("weight") * budget).cast("long"))
    plan = plan.withColumn("epochs", F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens"))).otherwise(0).cast("long"))
    plan = plan.select(F.col("source").alias("of"), "weight", "budget", "epochs", (F.col("budget") - F.col("epochs") * F.col("tokens")).alias("rest"), F.greatest(F.lit(1), F.ceil(F.col("tokens") / block_tokens)).cast("long").alias("blocks"))
    rows = slim.join(F.broadcast(plan) if few else plan, F.col("source").eqNullSafe(F.col("of")))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("id", "t64", F.lit(seed)), F.col("blocks")))
    order = W.partitionBy("source", "block").orderBy(F.xxhash64(F.lit(seed + 1), "id", "t64"), "id", "t64").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("inside", F.coalesce(F.sum("n_tokens").over(order), F.lit(0)))
    blocks = slim.join(F.broadcast(plan) if few else plan, F.col("source").eqNullSafe(F.col("of"))).groupBy("source", F.pmod(F.xxhash64("id", "t64", F.lit(seed)), F.col("blocks")).alias("block")).agg(F.sum("n_tokens").alias("n"))
    earlier = W.partitionBy("source").orderBy(F.xxhash64(F.lit(seed + 2), "source", "block"), "block").rowsBetween(W.unboundedPreceding, -1)
    blocks = blocks.select(F.col("source").alias("of"), F.col("block").alias("b"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"))
    rows = rows.drop("of").join(blocks, F.col("source").eqNullSafe(F.col("of")) & (F.col("block") == F.col("b")))
    position = F.col("start") + F.col("inside")
    return rows.select("id", "t64", "source", "n_tokens", "weight", "budget", (F.col("epochs") + (position < F.col("rest")).cast("long")).alias("copies"), "block", position.alias("position"))


def apply_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, each as often as ``mix_sources`` takes it. Rows of one id and text are taken equally often (the most of any of them).

    Null ids, sources and texts are taken like others; rows of a source without tokens are not taken. An empty table stays empty. Columns stay as they are, whatever their names.
    """
    copies = mix_sources(docs, id_col, text_col=text_col, **options).groupBy("id", "t64").agg(F.max("copies").alias("copies")).where("copies != 1")
    name, hash_, times, nth = unused(docs, "__id", "__t64", "__copies", "__nth")
    copies = keep(copies.toDF(name, hash_, times), "copies")  # most rows are taken once: they are not in it
    few = copies.count() <= BROADCAST_ROWS
    same = F.col(f"`{id_col}`").eqNullSafe(F.col(name)) & (F.xxhash64(F.col(f"`{text_col}`")) == F.col(hash_))
    out = docs.join(F.broadcast(copies) if few else copies, same, "left")
    each = F.array_repeat(F.lit(1), F.coalesce(F.col(times), F.lit(1)).cast("int"))
    return out.withColumn(nth, F.explode(each)).select(*(F.col(f"`{c}`") for c in docs.columns))
