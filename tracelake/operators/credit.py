"""Credit and feedback: exponential moving averages over ordered events, in closed form.

Q_n = Q_0 * prod(1 - e_i) + sum(e_i * r_i * prod_{j > i}(1 - e_j)), with every e at most alpha: suffix products are exponentials of window sums of logs,
so a popular parent's events need no list in one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracelake.functions.constants import ALPHA, DIMS, FEEDBACK_CONFIDENCE
from tracelake.functions.scores import clamp, learned
from tracelake.operators.windows import latest


def fold(start: DataFrame, events: DataFrame, key: str, order: list[str], alpha: float = ALPHA) -> DataFrame:
    """``start`` (key, q_* of the five dimensions) after all ``events`` (key, confidence, r_*), with the number of updates."""
    e = events.withColumn("__e", alpha * clamp(F.coalesce("confidence", F.lit(0.0)), 0.0, 1.0))
    later = W.partitionBy(key).orderBy(*order).rowsBetween(1, W.unboundedFollowing)
    e = e.withColumn("__left", F.exp(F.coalesce(F.sum(F.log(1 - F.col("__e"))).over(later), F.lit(0.0))))
    gains = [F.sum(F.col("__e") * F.col(f"r_{d}") * F.col("__left")).alias(f"__g_{d}") for d in DIMS]
    total = e.groupBy(key).agg(F.count("*").alias("updates"), F.exp(F.sum(F.log(1 - F.col("__e")))).alias("__keep"), *gains)
    out = start.join(total, key, "left")
    new = [(F.col(f"q_{d}") * F.coalesce("__keep", F.lit(1.0)) + F.coalesce(f"__g_{d}", F.lit(0.0))).alias(f"q_{d}") for d in DIMS]
    return out.select(key, *new, F.coalesce("updates", F.lit(0)).alias("updates"))


#: A stretch of a key's events ends when what came before it counts less than exp(-400), which no double sees.
_DECAY = 400.0


def fold_log(start: DataFrame, events: DataFrame, key: str, order: list[str], carry: list[str], alpha: float = ALPHA) -> DataFrame:
    """What each event changed: ``key``, ``nth`` (from 1), ``carry``, ``alpha``, ``confidence``, ``q_*`` before it and ``delta_*``, in the order of ``order``. Events of keys that ``start`` lacks change nothing and are left out.

    A key's events are cut into stretches by how much they decay. Inside one, Q is a prefix sum of gains over the products up to them; what a stretch starts from is the
    end of the one before it, and further back nothing is left. Events are shuffled once, by key, and sorted by it twice; all else are windows over that, and ``start`` meets them last.
    """
    e = events.select(key, *dict.fromkeys([*order, *carry]), F.col("confidence").alias("__c"), *(F.col(f"r_{d}").alias(f"__r_{d}") for d in DIMS))
    e = e.withColumn("__e", alpha * clamp(F.coalesce("__c", F.lit(0.0)), 0.0, 1.0))
    by_key = W.partitionBy(key).orderBy(*order)
    e = e.withColumns({"nth": F.row_number().over(by_key), "__t": F.sum(-F.log(1 - F.col("__e"))).over(by_key.rowsBetween(W.unboundedPreceding, 0))})
    e = e.withColumn("__stretch", F.floor(F.col("__t") / _DECAY))
    inside = W.partitionBy(key, "__stretch").orderBy("nth").rowsBetween(W.unboundedPreceding, 0)
    previous = W.partitionBy(key).orderBy("__stretch", "nth")
    e = e.withColumn("__p", F.col("__t") - F.first("__t").over(inside))
    # "__all": with the first event's own decay
    e = e.withColumns({"__all": F.col("__p") - F.log(1 - F.first("__e").over(inside)), **{f"__g_{d}": F.sum(F.col("__e") * F.col(f"__r_{d}") * F.exp("__p")).over(inside) for d in DIMS}})
    # what the row before has, as the first row of a stretch sees it, is the end of the stretch before; taken twice, of the one before that
    ends = {f"__end_{d}": F.col(f"__g_{d}") * F.exp(-F.col("__p")) for d in DIMS}
    e = e.withColumns(ends)
    e = e.withColumns({c: F.lag(old).over(previous) for c, old in (("__lost", "__all"), *((f"__x_{d}", f"__end_{d}") for d in DIMS))})
    e = e.withColumns({"__lost": F.first("__lost").over(inside), **{f"__x_{d}": F.first(f"__x_{d}").over(inside) for d in DIMS}})
    e = e.withColumns({"__lost2": F.lag("__lost").over(previous), **{f"__y_{d}": F.lag(f"__x_{d}").over(previous) for d in DIMS}})
    e = e.withColumns({"__lost2": F.first("__lost2").over(inside), **{f"__y_{d}": F.first(f"__y_{d}").over(inside) for d in DIMS}})
    # of the row before: how much of its stretch's start is left, and its own part
    e = e.withColumns({"__before": F.lag("__all").over(previous), "__same": F.lag("__stretch").over(previous) == F.col("__stretch"), **{f"__b_{d}": F.lag(f"__end_{d}").over(previous) for d in DIMS}})
    e = e.drop(*(f"__g_{d}" for d in DIMS), *ends, "__t", "__p", "__all").join(start.select(key, *(F.col(f"q_{d}").alias(f"__s_{d}") for d in DIMS)), key)
    before = {}
    for d in DIMS:
        s = F.col(f"__s_{d}")
        # the first stretch starts from the stored Q; the second may still see a trace of it, the others only what is before them
        begin = F.when(F.col("__lost").isNull(), s).otherwise(F.col(f"__x_{d}") + F.when(F.col("__lost2").isNull(), s).otherwise(F.coalesce(f"__y_{d}", F.lit(0.0))) * F.exp(-F.col("__lost")))
        before[f"q_{d}"] = F.when(F.col("__same"), begin * F.exp(-F.col("__before")) + F.col(f"__b_{d}")).otherwise(begin)
    e = e.withColumns(before)
    return e.select(key, "nth", *[c for c in carry if c != key], F.lit(alpha).alias("alpha"), F.col("__c").alias("confidence"), *(f"q_{d}" for d in DIMS), *((F.col("__e") * (F.col(f"__r_{d}") - F.col(f"q_{d}"))).alias(f"delta_{d}") for d in DIMS))


def credit_log(e: DataFrame, edges: DataFrame, rewards: DataFrame) -> DataFrame:
    """The log of ``apply_credit``: one row an applied edge, with the child that triggered it and what it changed of its parent's Q."""
    own = ["confidence", *(f"r_{d}" for d in DIMS)]
    last = rewards.groupBy(F.col("experience_id").alias("child_id")).agg(F.max_by(F.struct(*own), F.struct("created_at", "reward_id")).alias("last")).select("child_id", "last.*")
    events = edges.where(~F.coalesce("credit_applied", F.lit(False))).join(last, "child_id").withColumnRenamed("parent_id", "experience_id")
    return fold_log(e.select("experience_id", *(f"q_{d}" for d in DIMS)), events, "experience_id", ["created_at", "child_id"], ["child_id", "created_at"])


def feedback_log(e: DataFrame, items: DataFrame) -> DataFrame:
    """The log of ``apply_feedback``: one row a search event whose feedback changed an experience's Q."""
    base = clamp(F.coalesce("trajectory_score", F.lit(0.0)), -1.0, 1.0)
    start = e.select("experience_id", *(F.when(learned(), F.col(f"q_{d}")).otherwise(base).alias(f"q_{d}") for d in DIMS))
    return fold_log(start, feedback_events(items), "experience_id", ["created_at", "event_id"], ["event_id", "created_at"])


def apply_credit(e: DataFrame, edges: DataFrame, rewards: DataFrame) -> DataFrame:
    """Parents' Q after the pending edges, each with its child's latest reward, by edge time, then child."""
    last = latest(rewards, ["experience_id"], "created_at", "reward_id").select(F.col("experience_id").alias("child_id"), "confidence", *(f"r_{d}" for d in DIMS))
    events = edges.where(~F.coalesce("credit_applied", F.lit(False))).join(last, "child_id").withColumnRenamed("parent_id", "experience_id")
    return fold(e.select("experience_id", *(f"q_{d}" for d in DIMS)), events, "experience_id", ["created_at", "child_id"])


def feedback_events(items: DataFrame) -> DataFrame:
    """First feedback of each (event, experience, chunk), clamped; then one row an (event, experience) with the confidence-weighted reward.

    Items without feedback, or with one that gives no reward, teach nothing; a missing confidence is ``FEEDBACK_CONFIDENCE``, and feedback is taken as used unless it says not.
    """
    given = items.where("feedback_at IS NOT NULL AND reward IS NOT NULL")
    first = given.groupBy("event_id", "experience_id", "chunk_id").agg(F.min_by(F.struct("reward", "confidence", "was_used", "feedback_at"), F.struct("feedback_at", "item_id")).alias("x"))
    first = first.select(
        "event_id", "experience_id", clamp(F.col("x.reward"), -1.0, 1.0).alias("r"), clamp(F.coalesce("x.confidence", F.lit(FEEDBACK_CONFIDENCE)), 0.0, 1.0).alias("c"),
        F.coalesce("x.was_used", F.lit(True)).alias("used"), F.col("x.feedback_at").alias("at"),
    )
    per = first.groupBy("event_id", "experience_id").agg(
        F.when(F.sum("c") > 0, F.sum(F.col("r") * F.col("c")) / F.sum("c")).otherwise(F.avg("r")).alias("reward"), F.avg("c").alias("confidence"), F.max("used").alias("used"), F.max("at").alias("created_at"),
    )
    factor = {"outcome": 1.0, "intent": 1.0, "execution": 1.0, "orchestration": 0.6, "expression": 0.4}
    return per.select("*", *((F.col("reward") * k).alias(f"r_{d}") for d, k in factor.items()))


def apply_feedback(e: DataFrame, items: DataFrame) -> DataFrame:
    """Q after all feedback; a row that never learned starts from its trajectory score. Reuse counts only used ones."""
    events = feedback_events(items)
    base = clamp(F.coalesce("trajectory_score", F.lit(0.0)), -1.0, 1.0)
    touched = events.groupBy("experience_id").agg(F.count(F.when(F.col("used"), 1)).alias("reused"))
    start = e.join(touched, "experience_id").select("experience_id", *(F.when(learned(), F.col(f"q_{d}")).otherwise(base).alias(f"q_{d}") for d in DIMS))
    done = fold(start, events, "experience_id", ["created_at", "event_id"])
    return done.join(touched, "experience_id")


def hit_counts(hits: DataFrame) -> DataFrame:
    """Visits to add: one for each distinct experience of an event."""
    return hits.select("event_id", "experience_id").distinct().groupBy("experience_id").agg(F.count("*").alias("visits"))
