"""Latest rows, session collapse, timelines, pairs of turns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def latest(rows: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The row with the greatest ``order`` of each key. An aggregate, so nothing is sorted and the map side combines."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__row"))
    return best.select(*keys, *(F.col(f"__row.{c}").alias(c) for c in rest)).select(rows.columns)


def with_latest_reward(e: DataFrame, rewards: DataFrame) -> DataFrame:
    last = latest(rewards, ["experience_id"], "created_at", "reward_id").drop("created_at")
    return e.join(last, "experience_id", "left")


def with_parents_and_updates(e: DataFrame, edges: DataFrame, updates: DataFrame) -> DataFrame:
    """Sorted parent ids, and how many updates were logged, or else the stored counter."""
    parents = edges.groupBy(F.col("child_id").alias("experience_id")).agg(F.sort_array(F.collect_set("parent_id")).alias("parent_ids"))
    logged = updates.groupBy("experience_id").agg(F.count("*").alias("logged"))
    out = e.join(parents, "experience_id", "left").join(logged, "experience_id", "left")
    n = F.when(F.coalesce("logged", F.lit(0)) > 0, F.col("logged")).otherwise(F.col("q_update_count"))
    return out.select("experience_id", F.coalesce("parent_ids", F.expr("CAST(array() AS array<bigint>)")).alias("parent_ids"), n.alias("n_updates"))


def without_chunks(e: DataFrame, chunks: DataFrame) -> DataFrame:
    return e.join(chunks.select("experience_id"), "experience_id", "left_anti")


def stale_chunks(chunks: DataFrame, e: DataFrame) -> DataFrame:
    """Experiences whose chunks should go, with counts: their row is missing, not approved, not extracted or revoked."""
    ok = e.where(F.col("review_status").isin("approved", "auto_approved", "edited") & (F.col("extraction_status") == "done") & ~F.coalesce("revoked", F.lit(False)))
    return chunks.join(ok.select("experience_id"), "experience_id", "left_anti").groupBy("experience_id").agg(F.count("*").alias("n_chunks"))


def collapse_sessions(e: DataFrame) -> DataFrame:
    """Per (agent, session) the snapshot with most turns stays, the newest of equals (then the greatest id); the others are superseded. Rows without a session stay."""
    named = F.col("session_id").isNotNull() & (F.col("session_id") != "")
    w = W.partitionBy("agent_id", "session_id").orderBy(F.desc("turn_count"), F.desc("created_at"), F.desc("experience_id"))
    ranked = e.where(named).withColumn("rn", F.row_number().over(w))
    out = ranked.select("experience_id", "agent_id", "session_id", (F.col("rn") > 1).alias("superseded"))
    return out.unionByName(e.where(~F.coalesce(named, F.lit(False))).select("experience_id", "agent_id", "session_id", F.lit(False).alias("superseded")))


def recent_sessions(e: DataFrame, limit: int) -> DataFrame:
    """The segments of the latest ``limit`` sessions, numbered from 0 by byte start, then time, with their number."""
    blank = lambda c: F.when(F.col(c) != "", F.col(c))
    e = e.where(~F.coalesce("revoked", F.lit(False))).withColumn("group_id", F.coalesce(blank("parent_session_id"), blank("session_id"), F.col("experience_id").cast("string")))
    groups = e.groupBy("agent_id", "group_id").agg(F.max("created_at").alias("ended_at"), F.min("created_at").alias("started_at"))
    top = groups.orderBy(F.desc("ended_at"), "agent_id", "group_id").limit(limit)
    w = W.partitionBy("agent_id", "group_id")
    order = w.orderBy(F.coalesce("source_byte_start", F.lit(2**63 - 1)), "created_at", "experience_id")
    own = e.join(F.broadcast(top), ["agent_id", "group_id"])  # ``limit`` rows
    return own.select("agent_id", "group_id", "experience_id", "started_at", "ended_at", (F.row_number().over(order) - 1).alias("seg_index"), F.count("*").over(w).alias("total_segments"))


def visible_clusters(clusters: DataFrame, members: DataFrame, visible: DataFrame) -> DataFrame:
    """Clusters with visible members; what describes the whole is hidden unless all members are visible."""
    n = members.join(visible.select("experience_id"), "experience_id").groupBy("cluster_id").agg(F.count("*").alias("seen"))
    out = clusters.join(n, "cluster_id")
    whole = F.col("seen") == F.col("member_count")
    return out.select("cluster_id", F.when(whole, F.col("label")).alias("label"), F.col("seen").alias("member_count"), F.when(whole, F.col("crystallized_skill_id")).alias("crystallized_skill_id"))


def resolve_skills(declared: DataFrame, skills: DataFrame) -> DataFrame:
    """``name`` is its newest version (then the greatest id), ``name@version`` that one; unknown names are dropped. With invocations per skill. Skill ids are unique.

    Many skills may have the same name and version, and a use counts for each: uses are counted before they meet the skills. Only the newest of a name has uses of two kinds.
    """
    d = declared.select("experience_id", F.split_part("declared", F.lit("@"), F.lit(1)).alias("name"), F.when(F.col("declared").contains("@"), F.split_part("declared", F.lit("@"), F.lit(2))).alias("version"))
    newest = latest(skills.select("name", "version", "skill_id", "created_at"), ["name"], "created_at", "skill_id").select("name", "skill_id", F.col("version").alias("newest"))
    counts = [F.count("*").alias("invocations"), F.count_distinct("experience_id").alias("experiences")]
    first = d.join(newest, "name").where(F.col("version").isNull() | (F.col("version") == F.col("newest"))).groupBy("skill_id").agg(*counts)
    exact = d.where("version IS NOT NULL").groupBy("name", "version").agg(*counts)
    others = skills.select("name", "version", "skill_id").join(newest.select("skill_id"), "skill_id", "left_anti").join(exact, ["name", "version"])
    return first.unionByName(others.select("skill_id", "invocations", "experiences"))


def missing_dependencies(skills: DataFrame) -> DataFrame:
    needs = skills.select("skill_id", F.explode("dependencies").alias("name"))
    return needs.join(skills.select("name").distinct(), "name", "left_anti").select("skill_id", "name")


def visible_owners(members: DataFrame, grants: DataFrame) -> DataFrame:
    """Users and the owners their projects share with them: (project_id, user_id) with grants that are not revoked."""
    return members.join(grants.where(F.col("revoked_at").isNull()), "project_id").groupBy("user_id").agg(F.count_distinct("owner").alias("owners"), F.count_distinct("project_id").alias("projects"))


def lacking_rewards(e: DataFrame, turn_rewards: DataFrame, judge: str | None = None) -> DataFrame:
    done = turn_rewards if judge is None else turn_rewards.where(F.col("judge_model") == judge)
    return e.select("experience_id").join(done.select("experience_id"), "experience_id", "left_anti")


def last_units(chunks: DataFrame, k: int, min_turns: int = 0, min_fraction: float = 0.0) -> DataFrame:
    """Of each experience the last ``k`` unit chunks by turn, of those late enough."""
    c = chunks.where((F.col("turn_count") >= min_turns) & (F.col("turn_start") >= min_fraction * F.greatest(F.col("turn_count") - 1, F.lit(1))))
    w = W.partitionBy("experience_id").orderBy(F.desc("turn_start"), "chunk_id")
    return c.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k).drop("rn")


def _spaced(n: Column, count: Column, at: Column) -> Column:
    """Whether position ``at`` of ``n`` is one of ``count`` evenly spaced ones: ``slot * (n - 1) div (count - 1)``; the middle for one."""
    # the slots that could give `at` are around at * (count - 1) / (n - 1)
    near = F.floor(at * (count - 1) / F.greatest(n - 1, F.lit(1)))
    hits = [(F.floor((near + d) * (n - 1) / F.greatest(count - 1, F.lit(1))) == at) & (near + d <= count - 1) for d in (0, 1)]
    return F.when(count <= 0, False).when(count >= n, True).when(count == 1, at == F.floor(n / 2)).otherwise(hits[0] | hits[1])


def sample_timeline(items: DataFrame, keys: list[str], position: str, priority: str, limit: int) -> DataFrame:
    """At most ``limit`` items of each key, spread over the timeline; priority items first if they fit, themselves spread if not."""
    own, group = W.partitionBy(*keys), W.partitionBy(*keys, priority)
    x = items.withColumn("n", F.count("*").over(own)).withColumn("of", F.count("*").over(group)).withColumn("at", F.row_number().over(group.orderBy(position)) - 1)
    first = F.when(F.col(priority), F.col("of")).otherwise(F.col("n") - F.col("of"))  # number of priority items
    slots = F.when(first >= limit, F.when(F.col(priority), F.lit(limit)).otherwise(0)).otherwise(F.when(F.col(priority), F.col("of")).otherwise(limit - first))
    return x.where((F.col("n") <= limit) | _spaced(F.col("of"), slots, F.col("at"))).drop("n", "of", "at")


def turn_pairs(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """Each assistant turn after a user turn with text, with the latest such turn; a user turn is used once. ``(key, user_turn, assistant_turn)``."""
    w = W.partitionBy(key).orderBy("turn").rowsBetween(W.unboundedPreceding, -1)
    asked = F.last(F.when((F.col("role") == "user") & (F.trim("text") != ""), F.col("turn")), ignorenulls=True).over(w)
    answers = turns.withColumn("user_turn", asked).where((F.col("role") == "assistant") & F.col("user_turn").isNotNull())
    return answers.groupBy(key, "user_turn").agg(F.min("turn").alias("assistant_turn"))


def pick_pairs(pairs: DataFrame, n: int, key: str = "conv_id") -> DataFrame:
    """Evenly spaced pairs with the first and the last, positions rounded half to even."""
    w = W.partitionBy(key)
    x = pairs.withColumn("at", F.row_number().over(w.orderBy("user_turn")) - 1).withColumn("of", F.count("*").over(w))
    if n <= 1:
        return x.where("at = 0").drop("at", "of")
    asked = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.bround(i * (F.col("of") - 1) / F.lit(n - 1), 0).cast("long"))
    return x.where((F.col("of") <= n) | F.array_contains(asked, F.col("at").cast("long"))).drop("at", "of")


def following_text(pairs: DataFrame, turns: DataFrame, k: int = 4, clip: int = 600, key: str = "conv_id") -> DataFrame:
    """For each pair the next ``k`` user and assistant turns, clipped and labelled, as one text."""
    later = pairs.join(turns.where(F.col("role").isin("user", "assistant")), key).where("turn > assistant_turn")
    later = later.withColumn("rn", F.row_number().over(W.partitionBy(key, "user_turn").orderBy("turn"))).where(F.col("rn") <= k)
    line = F.concat(F.initcap("role"), F.lit(": "), F.substring("text", 1, clip))
    texts = later.groupBy(key, "user_turn").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rn", line.alias("line")))), lambda x: x["line"]), "\n\n").alias("following"))
    return pairs.join(texts, [key, "user_turn"], "left").withColumn("following", F.coalesce("following", F.lit("")))


def z_scores(rows: DataFrame, key: str, column: str) -> DataFrame:
    """(value - mean) / population deviation within each key; a deviation of 0 counts as 1."""
    stats = rows.groupBy(key).agg(F.avg(column).alias("__m"), F.stddev_pop(column).alias("__s"))
    return rows.join(stats, key).withColumn(f"{column}_z", (F.col(column) - F.col("__m")) / F.when(F.col("__s") > 0, F.col("__s")).otherwise(1.0)).drop("__m", "__s")
