"""Training export, graded cases and pool tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STEPS = "array<struct<step:string,why:string,how:string>>"

# Explicit schemas of the pool's tables, by name.
SCHEMAS = {
    "agents": "agent_id string, name string, team string, owner string",
    "experiences": "experience_id string, agent_id string, task_type string, source_model string, created_at string, query string, intent_text string, preconditions string, script_steps string, "
    "tool_capabilities string, key_decisions string, pitfalls string, summary string, outcome string, trajectory_path string, q_outcome double, q_intent double, q_execution double, q_orchestration double, "
    "q_expression double, q_update_count int, visit_count int, reuse_count int, sanitization_status string, review_status string, extraction_status string, acl string, tags string, sensitivity string",
    "rewards": "reward_id string, experience_id string, r_outcome double, r_intent double, r_execution double, r_orchestration double, r_expression double, confidence double, created_at string",
    "experience_edges": "parent_id string, child_id string, created_at string, credit_applied int",
    "turn_rewards": "experience_id string, turn_index int, judge_model string, r_outcome int, r_intent int, r_execution int, r_orchestration int, r_expression int, confidence double, annotated_at string",
    "content_fingerprints": "fingerprint string, agent_id string, experience_id string",
    "knowledge_clusters": "cluster_id string, label string, centroid array<float>, member_count int, new_since_crystallize int, crystallized_skill_id string, last_structure_score double, created_at string, updated_at string",
    "cluster_membership": "cluster_id string, experience_id string, similarity double, added_at string",
    "q_updates": "update_id string, experience_id string, triggered_by_child string, alpha double, confidence double, delta_outcome double, delta_intent double, delta_execution double, delta_orchestration double, delta_expression double, created_at string",
    "skill_q_updates": "update_id string, skill_id string, triggered_by_child string, alpha double, confidence double, delta_outcome double, delta_intent double, delta_execution double, delta_orchestration double, delta_expression double, created_at string",
    "reuse_events": "event_id string, viewer_name string, query_text string, scope string, task_type string, top_k int, final_status string, created_at string, feedback_at string",
    "search_log": "log_id string, experience_id string, query_text string, rank int, similarity double, score double, created_at string",
    "audit_log": "audit_id string, actor string, action string, target_id string, payload string, created_at string",
    "vectors": "experience_id string, kind string, vector array<float>",
    "skills": "skill_id string, name string, version string, description string, agent_id string, acl string, review_status string, dependencies string, q_outcome double, q_intent double, q_execution double, q_orchestration double, q_expression double, "
    "q_update_count int, invoke_count int, install_count int, created_at string",
    "experience_skill_uses": "experience_id string, skill_id string, credit_applied int, created_at string",
    "rag_chunks": "chunk_id string, experience_id string, owner string, chunk_type string, text string, search_text string, lexical_terms string, turn_start int, turn_end int, meta_json string, quality_score double",
    "rag_vectors": "chunk_id string, vector array<float>",
    "owner_quotas": "owner string, publish_count int, unpublished_count int",
    "project_members": "project_id string, user_id string",
    "project_owner_grants": "project_id string, owner string, include_high_sensitivity int, revoked_at string",
    "crystallized_skills": "skill_id string, cluster_id string, name string, version int, structure_score double, member_count int, superseded_by string, created_at string",
    "llm_usage": "usage_id string, kind string, model string, prompt_tokens long, completion_tokens long, total_tokens long, cost_usd double, ok int, created_at string",
    "reuse_items": "event_id string, experience_id string, chunk_id string, rank int, score double, was_used_by_agent int, reward double, confidence double, feedback_at string",
}


def read_pool(spark: SparkSession, path: str, table: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.schema(SCHEMAS[table]).format(fmt).load(f"{path}/{table}")


def utc_date(column: str):
    """The UTC day of either spelling of a time; what cannot be read is ``unknown``."""
    c = F.col(column).cast("string")
    t = F.coalesce(F.try_to_timestamp(c, F.lit("yyyy-MM-dd HH:mm:ss")), F.try_to_timestamp(c))
    return F.coalesce(F.date_format(t, "yyyy-MM-dd"), F.lit("unknown"))


def json_list(column: str):
    """A JSON list of strings; anything else is empty."""
    return F.coalesce(F.from_json(column, "array<string>"), F.expr("CAST(array() AS array<string>)"))


def json_steps(column: str):
    """A JSON list of steps; an item that is no object is a step without why and how."""
    items = F.coalesce(F.from_json(column, "array<string>"), F.expr("CAST(array() AS array<string>)"))
    z = lambda c: F.coalesce(c, F.lit(""))
    return F.transform(items, lambda x: F.when(x.startswith("{"), F.struct(z(F.get_json_object(x, "$.step")).alias("step"), z(F.get_json_object(x, "$.why")).alias("why"), z(F.get_json_object(x, "$.how")).alias("how"))).otherwise(F.struct(x.alias("step"), F.lit("").alias("why"), F.lit("").alias("how"))))


def export(rows: DataFrame, root: str, since: str | None = None, until: str | None = None, task_type: str | None = None, files_a_day: int = 1) -> None:
    """Parquet by ``task_type=`` and ``date=``. Rows are dealt by partition, and large days over ``files_a_day`` files."""
    out = rows.withColumn("date", utc_date("created_at"))
    if since:
        out = out.where(F.col("date") >= since)
    if until:
        out = out.where((F.col("date") <= until) & (F.col("date") != "unknown"))
    if task_type:
        out = out.where(F.col("task_type") == task_type)
    salt = F.pmod(F.xxhash64(*rows.columns[:1]), F.lit(files_a_day))
    out.repartition("task_type", "date", salt).write.mode("overwrite").partitionBy("task_type", "date").option("compression", "snappy").parquet(root)


def read_export(spark: SparkSession, root: str, task_type: str | None = None, since: str | None = None, until: str | None = None, columns: list[str] | None = None) -> DataFrame:
    """Only the partitions and columns asked for are read."""
    df = spark.read.option("basePath", root).parquet(root).withColumn("date", F.col("date").cast("string"))
    for c in [F.col("task_type") == task_type if task_type else None, F.col("date") >= since if since else None, F.col("date") <= until if until else None]:
        df = df if c is None else df.where(c)
    return df.select(*columns) if columns else df


def load_cases(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Graded cases of JSON lines: ``(case_id, query, source)`` and ``(case_id, kind, item_id, grade)``. A case without a query or a label is an error."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("n", "raw")).where((F.trim("raw") != "") & ~F.trim("raw").startswith("#"))
    g = lambda *paths: F.coalesce(*(F.get_json_object("raw", f"$.{p}") for p in paths))
    cases = lines.select(g("id", "case_id").alias("id"), "n", g("query", "q").alias("query"), F.coalesce(g("source"), F.lit("gold")).alias("source"),
                         g("relevant_chunk_ids", "relevant_chunks", "relevant_unit_ids", "relevant_units").alias("chunks"), g("relevant_experience_ids", "relevant_experiences").alias("experiences"))
    cases = cases.withColumn("case_id", F.coalesce("id", F.concat(F.lit("case-"), (F.col("n") + 1).cast("string"))))
    empty = F.expr("CAST(array() AS array<struct<item_id:string,grade:double>>)")

    def graded(column: str):
        c = F.col(column)
        grade = lambda x: F.coalesce(F.get_json_object(x, "$.grade").try_cast("double"), F.get_json_object(x, "$.relevance").try_cast("double"), F.lit(1.0))
        item = lambda x: F.coalesce(F.get_json_object(x, "$.chunk_id"), F.get_json_object(x, "$.experience_id"), F.get_json_object(x, "$.id"))
        of_list = F.transform(F.from_json(c, "array<string>"), lambda x: F.when(x.startswith("{"), F.struct(item(x).alias("item_id"), grade(x).alias("grade"))).otherwise(F.struct(x.alias("item_id"), F.lit(1.0).alias("grade"))))
        of_map = F.transform(F.map_entries(F.from_json(c, "map<string,double>")), lambda e: F.struct(e["key"].alias("item_id"), e["value"].alias("grade")))
        one = F.array(F.struct(c.alias("item_id"), F.lit(1.0).alias("grade")))
        found = F.when(c.isNull(), empty).when(F.trim(c).startswith("["), of_list).when(F.trim(c).startswith("{"), of_map).otherwise(one)
        return F.filter(F.coalesce(found, empty), lambda x: x["item_id"].isNotNull() & (x["grade"] > 0))

    cases = cases.withColumn("chunks", graded("chunks")).withColumn("experiences", graded("experiences"))
    bad = cases.where(F.col("query").isNull() | (F.col("query") == "") | (F.size("chunks") + F.size("experiences") == 0)).agg(F.count("*").alias("n"), F.min("n").alias("first")).first()
    if bad["n"]:
        raise ValueError(f"{path}: {bad['n']} cases lack a query or relevant ids, the first on line {bad['first'] + 1}")
    labels = cases.select("case_id", F.lit("chunk").alias("kind"), F.inline("chunks")).unionByName(cases.select("case_id", F.lit("experience").alias("kind"), F.inline("experiences")))
    return cases.select("case_id", "query", "source"), labels


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)
