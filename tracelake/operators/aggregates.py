"""Dashboards, leaderboards and statistics: built-in aggregates only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracelake.functions.constants import DIMS, DRIFT, MEMORY_SCORE, SCORE_WEIGHTS, SFT_SCORE, SUMMARY_WEIGHTS
from tracelake.functions.scores import clamp, q_or_score, weighted


def _count(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def _live() -> Column:
    return ~F.coalesce("revoked", F.lit(False))


def facet_counts(e: DataFrame, *facets: str) -> DataFrame:
    """``(facet, value, n)`` of each facet and the total (facet null), in one pass of grouping sets."""
    sets = e.groupingSets([[], *([c] for c in facets)], *facets).agg(F.count("*").alias("n"), F.grouping_id().alias("__g"))
    n = len(facets)
    facet = F.coalesce(*(F.when(F.col("__g") == (1 << n) - 1 - (1 << (n - 1 - i)), F.lit(c)) for i, c in enumerate(facets)))
    return sets.select(facet.alias("facet"), F.coalesce(*facets).alias("value"), "n")


def feedback_by_experience(items: DataFrame) -> DataFrame:
    given = items.where(F.col("feedback_at").isNotNull())
    return given.groupBy("experience_id").agg(
        F.count_distinct("event_id").alias("event_count"), F.count("*").alias("feedback_count"), _count(F.col("was_used")).alias("used_count"), _count(~F.col("was_used")).alias("not_used_count"),
        _count(F.col("reward") > 0).alias("positive_count"), _count(F.col("reward") < 0).alias("negative_count"), F.avg("reward").alias("avg_reward"), F.avg("confidence").alias("avg_confidence"),
        F.max("feedback_at").alias("latest_feedback_at"),
    )


_COUNTS = ("event_count", "feedback_count", "used_count", "not_used_count", "positive_count", "negative_count")


def _with_feedback(e: DataFrame, items: DataFrame) -> DataFrame:
    return e.join(feedback_by_experience(items), "experience_id", "left").fillna(0, list(_COUNTS))


def reuse_leaderboard(e: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """Reuse rate, reward, Q and reuse count in one rank; ties go to the latest feedback, then the id."""
    n = F.col("feedback_count")
    board = _with_feedback(e.where(_live() & ~F.coalesce("superseded", F.lit(False))), items).withColumn("q_scalar", q_or_score())
    rate = F.when(n > 0, F.col("used_count") / n).otherwise(0.0)
    rank = 0.45 * rate + 0.25 * F.when(n > 0, (F.col("avg_reward") + 1) / 2).otherwise(0.0) + 0.20 * (F.col("q_scalar") + 1) / 2 + 0.10 * F.col("reuse_count") / (F.col("reuse_count") + 5.0)
    board = board.withColumn("reuse_rate", rate).withColumn("rank_score", F.round(rank, 9))
    board = board.orderBy(F.desc("rank_score"), F.desc(F.coalesce("latest_feedback_at", "created_at")), "experience_id").limit(k)
    return board.select("experience_id", "task_type", *_COUNTS, "avg_reward", "avg_confidence", "q_scalar", "reuse_rate", "rank_score")


def smoothed_leaderboard(e: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """The same with rates shrunk to a neutral prior and weighed by evidence n / (n + 5)."""
    n = F.col("feedback_count")
    evidence = n / (n + 5.0)
    reuse, reward = (F.col("used_count") + 2.0) / (n + 4.0), (n * (F.coalesce("avg_reward", F.lit(0.0)) + 1) / 2 + 2.0) / (n + 4.0)
    board = _with_feedback(e.where(_live()), items).withColumn("q_scalar", q_or_score())
    rank = 0.45 * evidence * reuse + 0.25 * evidence * reward + 0.20 * (F.col("q_scalar") + 1) / 2 + 0.10 * F.col("reuse_count") / (F.col("reuse_count") + 5.0)
    board = board.withColumn("reuse_rate", F.when(n > 0, F.col("used_count") / n).otherwise(0.0)).withColumn("feedback_evidence", evidence).withColumn("rank_score", F.round(rank, 9))
    order = [F.desc("rank_score"), F.desc(F.round("reuse_rate", 9)), F.desc(F.round(F.coalesce("avg_reward", F.lit(-2.0)), 9)), F.desc("reuse_count"), F.desc(F.round("q_scalar", 9)), F.desc("created_at"), F.asc("experience_id")]
    return board.orderBy(*order).limit(k).select("experience_id", "feedback_count", "used_count", "reuse_count", "reuse_rate", "feedback_evidence", "q_scalar", "rank_score")


def reuse_totals(items: DataFrame, e: DataFrame) -> DataFrame:
    given = F.col("feedback_at").isNotNull()
    return items.join(e.where(_live()).select("experience_id"), "experience_id").agg(
        F.count_distinct("event_id").alias("recall_events"), F.count("*").alias("injected_items"), _count(given).alias("feedback_items"), _count(F.col("was_used")).alias("used_items"),
        _count(~F.col("was_used")).alias("not_used_items"), _count(given & (F.col("reward") > 0)).alias("positive_items"), _count(given & (F.col("reward") < 0)).alias("negative_items"),
        _count(given & (F.col("reward") == 0)).alias("neutral_items"), F.count_distinct(F.when(given, F.col("experience_id"))).alias("experiences_touched"),
        F.avg(F.when(given, F.col("reward"))).alias("avg_reward"), F.avg(F.when(given, F.col("confidence"))).alias("avg_confidence"), F.max("feedback_at").alias("last_feedback_at"),
    )


def event_summaries(events: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    given = F.col("feedback_at").isNotNull()
    per = items.groupBy("event_id").agg(
        F.count("*").alias("item_count"), _count(given).alias("feedback_count"), _count(F.col("was_used")).alias("used_count"), F.avg(F.when(given, F.col("reward"))).alias("avg_reward"),
        F.max("feedback_at").alias("item_feedback_at"),
    )
    out = events.join(per, "event_id").orderBy(F.desc(F.coalesce("item_feedback_at", "created_at")), "event_id").limit(k)
    return out.select("event_id", "item_count", "feedback_count", "used_count", "avg_reward")


def histogram(values: DataFrame, column: str, buckets: int = 10) -> DataFrame:
    """Equal-width buckets over [min, max], the last one closed; one bucket if all are equal. Empty buckets are listed."""
    edge = values.agg(F.min(column).alias("lo"), F.max(column).alias("hi")).first()
    lo, hi = edge["lo"], edge["hi"]
    if lo is None:
        return values.sparkSession.createDataFrame([], "bucket int, lo double, hi double, n long")
    if lo == hi:
        return values.where(F.col(column).isNotNull()).agg(F.lit(0).alias("bucket"), F.lit(float(lo)).alias("lo"), F.lit(float(hi)).alias("hi"), F.count("*").alias("n"))
    width = (hi - lo) / buckets
    at = F.least(F.lit(buckets - 1), F.floor((F.col(column) - lo) / width)).cast("int")
    counts = values.where(F.col(column).isNotNull()).groupBy(at.alias("bucket")).agg(F.count("*").alias("n"))
    spine = values.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    out = spine.join(counts, "bucket", "left")
    return out.select("bucket", (lo + F.col("bucket") * width).alias("lo"), (lo + (F.col("bucket") + 1) * width).alias("hi"), F.coalesce("n", F.lit(0)).alias("n"))


def nearest_rank(values: DataFrame, column: str, percents: list[float]) -> DataFrame:
    """``(percent, value)`` at index ``round_half_even(p / 100 * (n - 1))`` of the sorted values.

    Counts by value come first, so the running count is over distinct values; they are range-partitioned, and only one total a partition is
    gathered to place the partitions.
    """
    spark = values.sparkSession
    counts = values.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n")).first()[0]
    if not total:
        return spark.createDataFrame([(float(p), 0.0) for p in percents], "percent double, value double")
    wanted = {p: int(round(p / 100 * (total - 1))) for p in percents}
    parts = counts.repartitionByRange("value").withColumn("part", F.spark_partition_id()).persist()
    sizes = {r["part"]: r["n"] for r in parts.groupBy("part").agg(F.sum("n").alias("n")).collect()}  # one row a partition
    first, at = {}, 0
    for part in sorted(sizes):
        first[part], at = at, at + sizes[part]
    starts = spark.createDataFrame(list(first.items()), "part int, start long")
    before = F.sum("n").over(W.partitionBy("part").orderBy("value").rowsBetween(W.unboundedPreceding, 0)) - F.col("n")
    placed = parts.withColumn("before", before).join(F.broadcast(starts), "part").withColumn("from", F.col("start") + F.col("before"))
    asked = spark.createDataFrame([(float(p), i) for p, i in wanted.items()], "percent double, at long")
    out = placed.join(F.broadcast(asked), (F.col("at") >= F.col("from")) & (F.col("at") < F.col("from") + F.col("n")))
    return out.select("percent", F.col("value").cast("double").alias("value"))


def q_buckets(e: DataFrame) -> DataFrame:
    """Q in steps of 0.2 from -1, clamped to [-1, 0.99]; all ten listed."""
    at = F.floor(F.round((clamp(q_or_score(), -1.0, 0.99) + 1) / 0.2, 9)).cast("int")
    counts = e.groupBy(at.alias("i")).agg(F.count("*").alias("n"))
    spine = e.sparkSession.range(10).select(F.col("id").cast("int").alias("i"))
    return spine.join(counts, "i", "left").select(F.round(F.col("i") * 0.2 - 1, 1).alias("bucket"), F.coalesce("n", F.lit(0)).alias("n"))


def day_counts(rows: DataFrame, column: str, as_of: str, days: int, aggs: dict[str, Column] | None = None) -> DataFrame:
    """The last ``days`` days up to ``as_of``, each with its count and other aggregates; days without rows are listed."""
    spine = rows.sparkSession.range(days).select(F.date_sub(F.lit(as_of).cast("date"), (days - 1 - F.col("id")).cast("int")).alias("day"))
    own = rows.where((F.to_date(column) > F.date_sub(F.lit(as_of).cast("date"), days)) & (F.to_date(column) <= F.lit(as_of).cast("date")))
    counts = own.groupBy(F.to_date(column).alias("day")).agg(F.count("*").alias("n"), *(c.alias(k) for k, c in (aggs or {}).items()))
    return spine.join(counts, "day", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def usage_totals(u: DataFrame, price_in: float = 0.0, price_out: float = 0.0) -> DataFrame:
    """Calls, failures, tokens and cost: total, by kind and by model."""
    cost = F.col("prompt_tokens") / 1e6 * price_in + F.col("completion_tokens") / 1e6 * price_out
    out = u.groupingSets([[], ["kind"], ["model"]], "kind", "model").agg(
        F.count("*").alias("calls"), _count(F.col("ok")).alias("ok_calls"), _count(~F.col("ok")).alias("error_calls"), F.sum("prompt_tokens").alias("prompt_tokens"),
        F.sum("completion_tokens").alias("completion_tokens"), F.round(F.round(F.sum(cost), 9), 4).alias("cost_usd"), F.grouping_id().alias("g"),
    )
    return out.select(F.when(F.col("g") == 3, "total").when(F.col("g") == 1, "kind").otherwise("model").alias("level"), F.coalesce("kind", "model").alias("name"), "calls", "ok_calls", "error_calls", "prompt_tokens", "completion_tokens", "cost_usd")


def cluster_stats(k: DataFrame) -> DataFrame:
    return k.agg(F.count("*").alias("clusters"), F.count("crystallized_skill_id").alias("crystallized"), F.round(F.avg("member_count"), 2).alias("avg_members"), F.max("member_count").alias("max_members"))


def pool_stats(e: DataFrame) -> DataFrame:
    """Per agent: rows, live, revoked, published."""
    published = (F.col("acl") == "public") & (F.col("publish_status") == "published") & _live()
    return e.groupBy("agent_id").agg(F.count("*").alias("total"), _count(_live()).alias("live"), _count(~_live()).alias("revoked"), _count(published).alias("published"))


def community_stats(e: DataFrame, as_of: str) -> DataFrame:
    shared = e.where((F.col("acl") == "public") & (F.col("publish_status") == "published") & _live())
    return shared.agg(F.count("*").alias("published"), F.count_distinct("agent_id").alias("contributors"), _count(F.col("created_at") >= F.lit(as_of).cast("timestamp") - F.expr("INTERVAL 7 DAYS")).alias("last_7_days"))


def redaction_total(audit: DataFrame, newest: int = 500) -> DataFrame:
    """Sum of all category counts in the payloads of the newest audit rows."""
    rows = audit.orderBy(F.desc("created_at"), F.desc("audit_id")).limit(newest)
    counts = F.map_values(F.from_json("payload", "map<string,int>"))
    return rows.agg(F.coalesce(F.sum(F.aggregate(counts, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0)))), F.lit(0)).alias("redactions"))


def turn_reward_summary(t: DataFrame, by_judge: bool = False) -> DataFrame:
    keys = ["experience_id", "judge_model"] if by_judge else ["experience_id"]
    means = [F.round(F.round(F.avg(f"r_{d}"), 9), 3).alias(f"r_{d}") for d in DIMS]
    score = sum(w * F.avg(f"r_{d}") for d, w in SUMMARY_WEIGHTS.items())
    return t.groupBy(*keys).agg(F.count("*").alias("n"), *means, F.round(F.round(score, 9), 3).alias("score"), F.round(F.round(F.avg("confidence"), 9), 3).alias("confidence"), F.array_join(F.sort_array(F.collect_set("judge_model")), ",").alias("judges"))


def trajectory_scores(e: DataFrame, t: DataFrame) -> DataFrame:
    """The rewards of the judge who annotated last (then the greater name), blended with the structural score; memory and training eligibility."""
    last = t.groupBy("experience_id").agg(F.max(F.struct("annotated_at", "judge_model")).alias("x")).select("experience_id", F.col("x.judge_model").alias("judge_model"))
    means = t.join(last, ["experience_id", "judge_model"]).groupBy("experience_id").agg(F.count("*").alias("n"), sum(w * F.avg(f"r_{d}") for d, w in SCORE_WEIGHTS.items()).alias("judged"))
    s = F.col("structural_score")
    score = F.when(F.col("n").isNotNull() & s.isNotNull(), 0.6 * F.col("judged") + 0.4 * s).when(F.col("n").isNotNull(), F.col("judged")).otherwise(F.coalesce(s, F.lit(0.0)))
    out = e.select("experience_id", "structural_score").join(means, "experience_id", "left").withColumn("trajectory_score", clamp(F.round(F.round(score, 9), 3), -1.0, 1.0))
    return out.select("experience_id", "trajectory_score", (F.col("trajectory_score") >= MEMORY_SCORE).alias("is_memory_eligible"), (F.col("trajectory_score") >= SFT_SCORE).alias("is_sft_eligible"), F.coalesce("n", F.lit(0)).alias("n_turn_rewards"))


def judge_drift(baseline: DataFrame, current: DataFrame, threshold: float = DRIFT) -> DataFrame:
    both = baseline.select("experience_id", *(F.col(f"r_{d}").alias(f"b_{d}") for d in DIMS)).join(current, "experience_id")
    out = both.agg(F.count("*").alias("n_items"), *(F.coalesce(F.avg(F.abs(F.col(f"r_{d}") - F.col(f"b_{d}"))), F.lit(0.0)).alias(d) for d in DIMS))
    mean = sum(F.col(d) for d in DIMS) / len(DIMS)
    return out.withColumn("overall", mean).withColumn("triggered", mean > threshold)


def contributors(agents: DataFrame, e: DataFrame, k: int = 10) -> DataFrame:
    per = e.where(_live() & (F.col("acl") == "public") & (F.col("publish_status") == "published")).groupBy("agent_id").agg(F.count("*").alias("experiences"), F.max("created_at").alias("last_active"))
    return agents.join(per, "agent_id").orderBy(F.desc("experiences"), F.desc("last_active"), "agent_id").limit(k).select("agent_id", "team", "experiences", "last_active")


def skill_stats(s: DataFrame) -> DataFrame:
    return s.groupBy("review_status").agg(F.count("*").alias("n"), F.sum("invoke_count").alias("invocations"))


def judge_shots(shots: DataFrame) -> DataFrame:
    """Median of each dimension over a judge's shots, clipped; variance of the raw shots; instability."""
    med = [clamp(F.percentile(f"r_{d}", F.lit(0.5)), -1.0, 1.0).alias(f"r_{d}") for d in DIMS]
    spread = sum(F.coalesce(F.var_samp(f"r_{d}"), F.lit(0.0)) for d in DIMS) / len(DIMS)
    out = shots.groupBy("experience_id").agg(*med, F.percentile("confidence", F.lit(0.5)).alias("confidence"), F.round(spread, 9).alias("variance"), F.count("*").alias("shots"))
    return out.withColumn("unstable", F.col("variance") > 0.05)


def q_table(e: DataFrame) -> DataFrame:
    return e.select("experience_id", F.round(weighted(), 9).alias("q_scalar"), F.round(q_or_score(), 9).alias("q_shown"))
