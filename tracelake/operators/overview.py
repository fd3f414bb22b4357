"""Whole dashboards: the numbers and short lists that one page shows, each as rows of ``(section, name, n)`` or a day."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.operators.access import acl_kind, searchable
from tracelake.operators.aggregates import day_counts, facet_counts, redaction_total
from tracelake.operators.review import lineage


def _rows(section: str, df: DataFrame, name, n) -> DataFrame:
    return df.select(F.lit(section).alias("section"), name.cast("string").alias("name"), n.cast("long").alias("n"))


def _all(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _top(section: str, df: DataFrame, name: str, n: str, k: int) -> DataFrame:
    return _rows(section, df.orderBy(F.desc(n), name).limit(k), F.col(name), F.col(n))


def dashboard(e: DataFrame, as_of: str, top: int = 10) -> DataFrame:
    """Total, counts by review, task and sensitivity, rows of the last seven days up to ``as_of``, and the most reused rows (those that were reused at all)."""
    facets = facet_counts(e, "review_status", "task_type", "sensitivity").where("facet IS NOT NULL")
    total = _rows("total", e.agg(F.count("*").alias("n")), F.lit(None), F.col("n"))  # grouping sets give none for no rows
    week = e.where(F.col("created_at") >= F.lit(as_of).cast("timestamp") - F.expr("INTERVAL 7 DAYS")).agg(F.count("*").alias("n"))
    return _all(total, facets.select(F.col("facet").alias("section"), F.col("value").cast("string").alias("name"), F.col("n").cast("long").alias("n")), _rows("last_7_days", week, F.lit(None), F.col("n")), _top("top_reused", e.where("reuse_count > 0"), "experience_id", "reuse_count", top))


def skill_overview(skills: DataFrame, top: int = 10) -> DataFrame:
    """Skills that are not revoked: total, by review, invocations in all, and the most invoked."""
    live = skills.where(~F.coalesce("revoked", F.lit(False)))
    about = live.agg(F.count("*").alias("n"), F.coalesce(F.sum("invoke_count"), F.lit(0)).alias("calls"))
    by = live.groupBy("review_status").agg(F.count("*").alias("n"))
    return _all(_rows("total", about, F.lit(None), F.col("n")), _rows("invocations", about, F.lit(None), F.col("calls")), _rows("review_status", by, F.col("review_status"), F.col("n")), _top("top_invoked", live, "skill_id", "invoke_count", top))


def pool_overview(e: DataFrame, agents: DataFrame, audits: DataFrame, top: int = 5) -> DataFrame:
    """Agents, teams, live rows by who may read them, the largest tasks, and redactions in the newest audits."""
    live = e.where(~F.coalesce("revoked", F.lit(False)))
    about = agents.agg(F.count("*").alias("agents"), F.count_distinct("team").alias("teams"))
    by = live.groupBy(acl_kind(F.col("acl")).alias("kind")).agg(F.count("*").alias("n"))
    tasks = live.groupBy("task_type").agg(F.count("*").alias("n"))
    return _all(
        _rows("agents", about, F.lit(None), F.col("agents")), _rows("teams", about, F.lit(None), F.col("teams")), _rows("acl", by, F.col("kind"), F.col("n")), _top("top_tasks", tasks, "task_type", "n", top),
        _rows("redactions", redaction_total(audits), F.lit(None), F.col("redactions")), _rows("searchable", searchable(e).agg(F.count("*").alias("n")), F.lit(None), F.col("n")),
    )


def timeline(items: DataFrame, updates: DataFrame, as_of: str, days: int = 14) -> DataFrame:
    """Feedback, its mean reward and Q updates of each day; days without any are listed."""
    given = day_counts(items.where("feedback_at IS NOT NULL"), "feedback_at", as_of, days, {"avg_reward": F.avg("reward")}).withColumnRenamed("n", "feedback")
    return given.join(day_counts(updates, "created_at", as_of, days).withColumnRenamed("n", "q_updates"), "day")


def newest_audits(audits: DataFrame, k: int = 20) -> DataFrame:
    """The newest audit rows with their payloads as maps; a payload that cannot be read is null."""
    return audits.orderBy(F.desc("created_at"), F.desc("audit_id")).limit(k).withColumn("payload", F.from_json("payload", "map<string,string>"))


def audited_lineage(ids: DataFrame, edges: DataFrame, updates: DataFrame, audits: DataFrame) -> DataFrame:
    """``lineage`` and the audit rows about each id (``target_id``)."""
    i = ids.select("experience_id").distinct()
    own = audits.join(i, audits.target_id == i.experience_id).select("experience_id", F.lit("audit").alias("kind"), F.col("audit_id").alias("other_id"), F.col("created_at").alias("at"))
    return lineage(ids, edges, updates).unionByName(own)


def extraction_states(e: DataFrame, picked: DataFrame) -> DataFrame:
    """The state of each experience's extraction: that of its pair of runs, ``failed`` where both are missing."""
    return e.select("experience_id").join(picked, "experience_id", "left").withColumn("status", F.coalesce("status", F.lit("failed")))
