"""Mixed ranking, top-k per query and retrieval metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracelake.functions.constants import C_EXPLORATION, W_Q, W_SIMILARITY
from tracelake.functions.scores import exploration


def top_k(rows: DataFrame, key: str, k: int, *order) -> DataFrame:
    w = W.partitionBy(key).orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def mixed_scores(candidates: DataFrame, key: str = "query_id") -> DataFrame:
    """``candidates`` (key, similarity, q, visit_count) with z-scored similarity and Q and an exploration bonus; one aggregate a query."""
    stats = candidates.groupBy(key).agg(
        F.avg("similarity").alias("ms"), F.stddev_pop("similarity").alias("ss"), F.avg("q").alias("mq"), F.stddev_pop("q").alias("sq"), F.sum("visit_count").alias("visits"),
    )
    z = lambda c, m, s: (F.col(c) - F.col(m)) / F.when(F.col(s) > 1e-12, F.col(s)).otherwise(1.0)
    out = candidates.join(stats, key)
    out = out.withColumn("similarity_part", W_SIMILARITY * z("similarity", "ms", "ss")).withColumn("q_part", W_Q * z("q", "mq", "sq")).withColumn("explore_part", exploration(F.col("visits"), F.col("visit_count"), C_EXPLORATION))
    return out.withColumn("score", F.col("similarity_part") + F.col("q_part") + F.col("explore_part")).drop("ms", "ss", "mq", "sq", "visits")


def readable_top_k(ranked: DataFrame, readable: DataFrame, k: int, key: str = "query_id") -> DataFrame:
    """Over-fetch 4 k by rank, drop what is not readable, keep k with new ranks."""
    near = ranked.where(F.col("rank") <= 4 * k).join(readable, "experience_id", "left_semi").withColumnRenamed("rank", "raw_rank")
    return top_k(near, key, k, "raw_rank")


def staged_top_k(personal: DataFrame, community: DataFrame, k: int, key: str = "query_id") -> DataFrame:
    """Personal hits first, then community ones not already there."""
    both = personal.select(key, "experience_id", "similarity", F.lit(0).alias("stage")).unionByName(community.select(key, "experience_id", "similarity", F.lit(1).alias("stage")))
    one = both.groupBy(key, "experience_id").agg(F.min("stage").alias("stage"), F.max("similarity").alias("similarity"))
    return top_k(one, key, k, "stage", F.desc("similarity"), "experience_id")


def retrieval_metrics(hits: DataFrame, labels: DataFrame, ks: tuple[int, ...]) -> DataFrame:
    """Mean recall, precision, nDCG at each k and MRR over the cases of ``labels`` (case_id, item_id, grade); hits are (case_id, item_id, rank)."""
    graded = labels.where("grade > 0")
    total = graded.groupBy("case_id").agg(F.count("*").alias("relevant"))
    found = hits.join(graded, ["case_id", "item_id"])
    gain, discount = F.pow(F.lit(2.0), "grade") - 1, lambda r: F.log2(F.col(r) + 1.0)
    ideal = graded.withColumn("r", F.row_number().over(W.partitionBy("case_id").orderBy(F.desc("grade"), "item_id")))
    best = ideal.groupBy("case_id").agg(*(F.sum(F.when(F.col("r") <= k, gain / discount("r"))).alias(f"ideal{k}") for k in ks))
    got = found.groupBy("case_id").agg(F.min("rank").alias("first"), *(x for k in ks for x in (F.count(F.when(F.col("rank") <= k, 1)).alias(f"n{k}"), F.sum(F.when(F.col("rank") <= k, gain / discount("rank"))).alias(f"dcg{k}"))))
    per = total.join(best, "case_id").join(got, "case_id", "left")
    z = lambda c: F.coalesce(c, F.lit(0))
    aggs = [F.count("*").alias("cases"), F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))).alias("mrr")]
    for k in ks:
        aggs += [F.avg(F.least(F.lit(1.0), z(f"n{k}") / F.col("relevant"))).alias(f"recall_{k}"), F.avg(z(f"n{k}") / F.lit(k)).alias(f"precision_{k}"), F.avg(F.coalesce(F.col(f"dcg{k}"), F.lit(0.0)) / F.col(f"ideal{k}")).alias(f"ndcg_{k}")]
    return per.agg(*aggs)


def equivalent_chunks(chunks: DataFrame) -> DataFrame:
    """``(chunk_id, peers)``: how many chunks share its action signature or its type and search text; group sizes, never pairs."""
    sig = chunks.where("action_signature <> ''").groupBy("action_signature").agg(F.count("*").alias("by_sig"))
    text = chunks.groupBy("chunk_type", "search_text").agg(F.count("*").alias("by_text"))
    both = chunks.where("action_signature <> ''").groupBy("action_signature", "chunk_type", "search_text").agg(F.count("*").alias("by_both"))
    out = chunks.join(sig, "action_signature", "left").join(text, ["chunk_type", "search_text"]).join(both, ["action_signature", "chunk_type", "search_text"], "left")
    z = lambda c: F.coalesce(c, F.lit(0))
    return out.select("chunk_id", (z("by_sig") + F.col("by_text") - z("by_both")).alias("peers"))
