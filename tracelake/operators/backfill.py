"""The second layer of redaction over sessions that only had the rules: a model's spans, oldest sessions first, with status and review of each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.operators.redaction import splice


def due(experiences: DataFrame, limit: int | None = None) -> DataFrame:
    """Experiences of the first layer only that are not revoked, the ``limit`` oldest of them if one is given."""
    rows = experiences.where((F.col("sanitization_status") == "layer1_only") & ~F.coalesce("revoked", F.lit(False)))
    return rows if limit is None else rows.orderBy("created_at", "experience_id").limit(limit)


def backfill(experiences: DataFrame, turns: DataFrame, scanned: DataFrame, spans: DataFrame, limit: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Turns, experiences and audit rows after a model's spans were applied to what is due.

    turns: ``experience_id``, ``turn``, ``text`` as the rules left it; scanned: the ``experience_id`` that the model got through; spans: ``experience_id``, ``turn``, ``start``, ``end``, ``label`` by code points of that text.

    A due experience without turns is done as it is. A scanned one is done, or waits for a person if a span is a secret; its review is approved, unless a secret was
    found in a row that is not private. One that the model failed on keeps its state and is due again. Spans of other experiences are left alone. Overlapping spans: the later one counts.
    """
    rows = due(experiences, limit).select("experience_id", F.coalesce("acl", F.lit("private")).alias("acl"))
    with_turns = rows.join(turns.select("experience_id").distinct(), "experience_id", "left_semi")
    read = with_turns.join(scanned.select("experience_id").distinct(), "experience_id", "left_semi")
    own = spans.join(read.select("experience_id"), "experience_id", "left_semi")
    per_turn = own.groupBy("experience_id", "turn").agg(F.collect_list(F.struct("start", "end", "label")).alias("spans"))  # spans of one turn's text
    touched = turns.join(per_turn, ["experience_id", "turn"], "left")
    whole = touched.where("spans IS NULL").select("experience_id", "turn", "text")
    cut = splice(touched.where("spans IS NOT NULL"), "text", "spans").select("experience_id", "turn", "text")
    hits = own.groupBy("experience_id", F.upper("label").alias("label")).agg(F.count("*").alias("n")).groupBy("experience_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", "n")))).alias("hits"), F.max(F.col("label").contains("SECRET")).alias("high"))
    about = read.join(hits, "experience_id", "left").withColumn("high", F.coalesce("high", F.lit(False)))
    about = about.withColumn("blocked", F.col("high") & (F.col("acl") != "private"))
    about = about.select("experience_id", "acl", "hits", "high", "blocked", F.when(F.col("high"), "human_review").otherwise("done").alias("__status"), F.when(F.col("blocked"), "pending").otherwise("auto_approved").alias("__review"))
    empty = rows.join(with_turns, "experience_id", "left_anti").select("experience_id", F.lit("done").alias("__status"), F.lit(None).cast("string").alias("__review"))
    new = about.select("experience_id", "__status", "__review").unionByName(empty)
    updated = experiences.join(new, "experience_id", "left").withColumns({"sanitization_status": F.coalesce("__status", "sanitization_status"), "review_status": F.coalesce("__review", "review_status")}).drop("__status", "__review")
    audit = about.select(F.lit("model_backfill").alias("action"), F.col("experience_id").alias("target_id"), "hits", F.col("high").alias("triggered_high"), F.col("__review").alias("review_status"), F.col("blocked").alias("sanitizer_blocked_review"), "acl")
    return whole.unionByName(cut), updated, audit
