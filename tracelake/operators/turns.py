"""Jobs on turns of trajectories: metrics, cards, fingerprints, segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Phrases of an agent that corrects itself, and of one that is done.
SELF_CORRECTION = (
    "let me try", "let's try a different", "try a different approach", "instead", "actually,", "actually i", "wait,", "sorry, that", "另一种", "换个方式", "再试", "重新",
    "我刚才搞错", "我搞错了", "let me retry", "retry with", "fix that", "correct that",
)
COMPLETION = ("done", "完成", "搞定", "解决", "成功", "fixed", "all set", "tests pass", "everything works")


def _any(text: Column, phrases: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in phrases:
        out = out | text.contains(p)
    return out


def structural_metrics(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """One row a trajectory from turns (key, turn, role, text; optional tool_names array, is_tool_error): counts, rates and the structural score."""
    cols = turns.columns
    tools = F.col("tool_names") if "tool_names" in cols else F.expr("CAST(array() AS array<string>)")
    error = F.coalesce("is_tool_error", F.lit(False)) if "is_tool_error" in cols else F.lit(False)
    text = F.coalesce("text", F.lit(""))
    head = F.substring(F.lower(text), 1, 600)
    bot = F.col("role") == "assistant"
    t = turns.select(key, "role", bot.alias("bot"), tools.alias("tools"), error.alias("err"), F.length(text).alias("len"), (bot & _any(head, SELF_CORRECTION)).alias("again"), (bot & _any(head, COMPLETION)).alias("done"))
    yes = lambda c: F.count(F.when(c, 1))
    m = t.groupBy(key).agg(
        yes(F.col("role") == "user").alias("user_turn_count"), yes(F.col("bot")).alias("assistant_turn_count"), F.coalesce(F.sum(F.size("tools")), F.lit(0)).alias("tool_call_count"),
        yes(F.col("err")).alias("tool_error_count"), F.size(F.array_distinct(F.flatten(F.collect_set("tools")))).alias("unique_tools"), yes(F.col("again")).alias("self_correction_count"),
        F.round(F.coalesce(F.avg(F.when(F.col("bot"), F.col("len"))), F.lit(0.0)), 1).alias("avg_assistant_chars"), F.coalesce(F.max(F.when(F.col("bot"), F.col("len"))), F.lit(0)).alias("max_assistant_chars"),
        F.max("done").alias("completion_signal"),
    )
    calls = F.greatest(F.col("tool_call_count"), F.lit(1))
    err, div, sc = F.col("tool_error_count") / calls, F.col("unique_tools") / calls, F.col("self_correction_count") / F.greatest(F.col("assistant_turn_count"), F.lit(1))
    err, div = (F.when(F.col("tool_call_count") > 0, c).otherwise(0.0) for c in (err, div))
    score = F.when(F.col("completion_signal"), 0.4).otherwise(0.0) - F.least(F.lit(0.5), err * 0.7) + F.least(F.lit(0.3), div * 0.5) - F.least(F.lit(0.3), sc * 0.6) - F.when(F.col("assistant_turn_count") == 0, 0.5).otherwise(0.0)
    return m.select(
        key, (F.col("user_turn_count") + F.col("assistant_turn_count")).alias("turn_count"), "user_turn_count", "assistant_turn_count", "tool_call_count", "tool_error_count", F.round(err, 3).alias("tool_error_rate"),
        "unique_tools", F.round(div, 3).alias("tool_diversity"), "self_correction_count", F.round(sc, 3).alias("self_correction_rate"), "avg_assistant_chars", "max_assistant_chars", "completion_signal",
        F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.round(score, 3))).alias("structural_score"),
    )


def _stripped(c: str = "text") -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"^\s+|\s+$", "")


def rule_cards(turns: DataFrame, key: str = "conv_id", clip_step: int = 280) -> DataFrame:
    """Card without a model: first user turn, its head as intent, assistant turns as steps, the last one as outcome."""
    t = turns.withColumn("s", _stripped()).where("s <> ''")
    user, bot = F.col("role") == "user", F.col("role") == "assistant"
    cards = t.groupBy(key).agg(
        F.min_by(F.when(user, F.col("s")), F.when(user, F.col("turn"))).alias("query"), F.max_by(F.when(bot, F.col("s")), F.when(bot, F.col("turn"))).alias("last"),
        F.transform(F.sort_array(F.collect_list(F.when(bot, F.struct("turn", F.substring("s", 1, clip_step).alias("s"))))), lambda x: x["s"]).alias("steps"),
    )
    intent = F.trim(F.when(F.col("query").isNotNull(), F.substring("query", 1, 120)).otherwise("unspecified task"))
    return cards.select(key, F.coalesce("query", F.lit("(no user turn)")).alias("query"), intent.alias("intent"), "steps", F.coalesce(F.substring("last", 1, 500), F.lit("(no assistant turn)")).alias("outcome"))


def last_request_cards(turns: DataFrame, key: str = "conv_id", steps: int = 8) -> DataFrame:
    """Card of the last user turn with text, with at most ``steps`` steps."""
    t = turns.withColumn("s", _stripped()).where("s <> ''")
    user = F.col("role") == "user"
    last = t.groupBy(key).agg(F.max_by(F.when(user, F.col("s")), F.when(user, F.col("turn"))).alias("request"))
    return rule_cards(turns, key).join(last, key).select(key, F.coalesce("request", F.lit("(no user turn)")).alias("query"), F.slice("steps", 1, steps).alias("steps"), "outcome")


def fingerprints(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """First 16 hex digits of SHA-256 over role, 0x00, content, 0x01 of each turn in order."""
    part = F.concat(F.encode(F.coalesce("role", F.lit("")), "UTF-8"), F.unhex(F.lit("00")), F.encode(F.coalesce("text", F.lit("")), "UTF-8"), F.unhex(F.lit("01")))
    parts = turns.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("turn", part.alias("p")))).alias("ps"))
    joined = F.aggregate("ps", F.unhex(F.lit("")), lambda a, x: F.concat(a, x["p"]))
    return parts.select(key, F.substring(F.sha2(joined, 256), 1, 16).alias("fingerprint"))


def first_by_fingerprint(e: DataFrame) -> DataFrame:
    """Exact duplicates by (fingerprint, agent): each row and the first one it stands for. Empty fingerprints are never duplicates."""
    named = e.where("fingerprint <> ''")
    first = named.groupBy("agent_id", "fingerprint").agg(F.min(F.struct("created_at", "experience_id")).alias("f"))
    out = named.join(first, ["agent_id", "fingerprint"]).select("experience_id", F.col("f.experience_id").alias("kept_id"))
    return out.unionByName(e.where("fingerprint = '' OR fingerprint IS NULL").select("experience_id", F.col("experience_id").alias("kept_id")))


def segments(turns: DataFrame, key: str = "conv_id", most: int = 8) -> DataFrame:
    """A user turn of more than three characters opens a segment; its first user text and up to ``most`` distinct assistant heads."""
    t = turns.withColumn("s", _stripped()).where("s <> ''")
    opens = ((F.col("role") == "user") & (F.length("s") > 3)).cast("int")
    t = t.withColumn("segment", F.sum(opens).over(W.partitionBy(key).orderBy("turn"))).where("segment > 0")
    bot = F.col("role") == "assistant"
    seg = t.groupBy(key, "segment").agg(
        F.min("turn").alias("turn_start"), F.max("turn").alias("turn_end"), F.min_by("s", "turn").alias("context"),
        F.slice(F.array_distinct(F.transform(F.sort_array(F.collect_list(F.when(bot, F.struct("turn", F.substring("s", 1, 120).alias("s"))))), lambda x: x["s"])), 1, most).alias("work"),
    )
    return seg


def head_tail_clip(c: Column, limit: int, marker: str = "\n…[truncated]…\n") -> Column:
    """At most ``limit`` characters: 70 % from the head, the rest from the tail, with a marker between."""
    head = int(limit * 0.7)
    return F.when(F.length(c) <= limit, c).otherwise(F.concat(F.substring(c, 1, head), F.lit(marker), F.substring(c, -(limit - head), limit - head)))


def digest(turns: DataFrame, key: str = "conv_id", budget: int = 6000, clip: int = 600) -> DataFrame:
    """A transcript for labelling: one line a turn until the budget is used up, then a line that says so."""
    line = F.concat(F.lit("["), F.col("role"), F.lit("] "), F.substring(_stripped(), 1, clip))
    t = turns.where(_stripped() != "").withColumn("line", line)
    used = F.sum(F.length("line") + 1).over(W.partitionBy(key).orderBy("turn"))
    t = t.withColumn("fits", used <= budget)
    out = t.groupBy(key).agg(F.sort_array(F.collect_list(F.when(F.col("fits"), F.struct("turn", "line")))).alias("x"), F.count(F.when(~F.col("fits"), 1)).alias("left_out"))
    return out.select(key, F.concat(F.array_join(F.transform("x", lambda y: y["line"]), "\n"), F.when(F.col("left_out") > 0, "\n[truncated]").otherwise("")).alias("digest"), "left_out")
