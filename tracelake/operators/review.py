"""Review, labelling and upkeep of the pool's rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.functions.constants import DIMS, DIVERGENCE
from tracelake.functions.scores import valid_confidence, valid_reward
from tracelake.operators.aggregates import trajectory_scores
from tracelake.operators.windows import latest

# Messages that wrap no task, and acknowledgements.
WRAPPERS = (
    "# agents.md instructions", "<environment_context>", "<permissions instructions>", "<collaboration_mode>", "<subagent_notification>", "<local-command-caveat>", "<command-message>", "<command-name>",
    "<system-reminder>", "<transcript>",
)
TRIVIAL = (
    "", "1", "ok", "okay", "yes", "no", "hi", "hello", "hey", "thanks", "thank you", "continue", "go on", "done", "你好", "您好", "在吗", "在不在", "继续", "继续做", "继续吧", "好的", "好", "可以", "行", "收到",
    "谢谢", "完成", "搞定", "快点", "开始吧",
)
# How titles begin, or what they hold, that name no task.
BAD_PREFIXES = (
    "<", "[", "(", "the ", "i ", "i'", "it ", "it'", "let ", "let's", "we ", "we'", "looking", "let me", "sure", "okay", "ok,", "hi,", "hi!", "hello", "yes,", "no,", "sorry", "waiting", "based on", "from the",
    "我需要", "我看到", "我注意", "我会", "这段", "这个", "这是", "这条", "看起来", "根据", "请告诉", "请提供", "你好",
)
BAD_PARTS = ("approval", "permission", "transcript", "got cut off", "truncated", "incomplete", "could you clarify", "what would you", "what can i", "请确认", "需要确认", "需要权限", "请提供更多")
GREETING = r"(?i)^(你好|您好|hi|hello|hey|嗨|你在|在的|帮我|请|能否)"
SUMMARY_MARK = r"(?i)task[ _-]?summary\s*[:：]"


def _strip(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)^\s+|\s+$", "")


def task_text(text: Column) -> Column:
    """The request inside wrapper messages; empty for wrappers and bare image placeholders."""
    t = _strip(text)
    objective = F.regexp_extract(t, r"(?is)<objective>\s*(.*?)\s*</objective>", 1)
    wrapped = F.lit(False)
    for w in WRAPPERS:
        wrapped = wrapped | F.lower(t).startswith(w)
    out = F.when(t.rlike(r"(?is)<objective>.*?</objective>"), objective).when(wrapped, "").otherwise(t)
    return F.when(out.rlike(r"(?i)\A(?:<image[^>]*>\s*)+\z"), "").otherwise(out)


def is_task(text: Column) -> Column:
    """A request worth keeping: no acknowledgement, and three characters or a letter next to a digit."""
    t = task_text(text)
    plain = F.lower(F.trim(F.regexp_replace(t, r"(?U)[\s\W_]+", " ")))
    compact = F.regexp_replace(t, r"(?U)\s+", "")
    return (t != "") & ~plain.isin(*TRIVIAL) & ((F.length(compact) >= 3) | compact.rlike("[A-Za-z][0-9]|[0-9][A-Za-z]"))


def retrievable_sessions(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    user, bot = F.col("role") == "user", F.col("role") == "assistant"
    ok = F.max((user & is_task(F.col("text"))) | (bot & F.coalesce("text", F.lit("")).rlike(SUMMARY_MARK)))
    return turns.groupBy(key).agg(F.coalesce(ok, F.lit(False)).alias("retrievable"))


def bad_title(label: Column) -> Column:
    low = F.lower(F.trim(F.coalesce(label, F.lit(""))))
    bad = (low == "") | label.endswith("…") | label.endswith("...")
    for p in BAD_PREFIXES:
        bad = bad | low.startswith(p)
    for p in BAD_PARTS:
        bad = bad | low.contains(p)
    return F.when(label == "(闲聊)", False).otherwise(F.coalesce(bad, F.lit(True)))


def needs_relabel(intent: Column, query: Column) -> Column:
    """An intent that is missing, very short, a greeting, or only the head of the query."""
    i = _strip(intent)
    bare = lambda c: F.trim(F.regexp_replace(c, "…+$", ""))
    same = bare(i) == bare(F.substring(_strip(query), 1, 120))
    return (F.length(i) < 4) | i.rlike(GREETING) | F.coalesce(same & query.isNotNull() & (query != ""), F.lit(False))


def orphans(e: DataFrame) -> DataFrame:
    return e.where(F.col("trajectory_path").isNull() & ~F.coalesce("revoked", F.lit(False)))


def browse_skills(s: DataFrame, review: str | None = None, search: str | None = None, limit: int = 100, offset: int = 0) -> DataFrame:
    out = s.where(~F.coalesce("revoked", F.lit(False)))
    if review and review != "all":
        out = out.where(F.col("review_status") == review)
    if search:
        out = out.where(F.col("name").contains(search) | F.col("skill_id").cast("string").contains(search))
    return out.orderBy(F.desc("created_at"), "skill_id").offset(offset).limit(limit)


def pick_extraction(runs: DataFrame, key: str = "experience_id") -> DataFrame:
    """Runs A and B ``(key, run, n_steps, n_tools, n_decisions, n_pitfalls, confidence)``: the surer one (A on a tie), how far they differ, and the status. One missing: the other, done. None: no row here."""
    cols = ("n_steps", "n_tools", "n_decisions", "n_pitfalls")
    a, b = (runs.where(F.col("run") == r).select(key, F.col("confidence").alias(f"c_{r}"), *(F.col(c).alias(f"{c}_{r}") for c in cols)) for r in ("A", "B"))
    both = a.join(b, key, "full")
    gap = sum(F.abs(F.col(f"{c}_A") - F.col(f"{c}_B")) for c in cols)
    most = sum(F.greatest(f"{c}_A", f"{c}_B") for c in cols)
    whole = F.col("c_A").isNotNull() & F.col("c_B").isNotNull()
    div = F.when(whole, gap / F.greatest(most, F.lit(1))).otherwise(0.0)
    chosen = F.when(F.col("c_B").isNull() | (F.col("c_A") >= F.col("c_B")), "A").otherwise("B")
    return both.select(key, chosen.alias("chosen"), div.alias("divergence"), F.when(whole & (div >= DIVERGENCE), "unstable").otherwise("done").alias("status"))


def apply_decisions(e: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The rows after the latest decision on each (if its actor owns it), an audit row for each valid decision, and the ids to embed again.

    decisions: decision_id, experience_id, actor, action (approve, reject, edit, soft_delete), intent_text, decided_at.
    """
    own = decisions.join(e.select("experience_id", F.col("agent_id").alias("__owner")), "experience_id").where(F.col("actor") == F.col("__owner")).drop("__owner")
    last = latest(own, ["experience_id"], "decided_at", "decision_id").select("experience_id", "action", F.col("intent_text").alias("__new"))
    out = e.join(last, "experience_id", "left")
    a = F.col("action")
    status = F.when(a == "approve", "approved").when(a.isin("reject", "soft_delete"), "rejected").when((a == "edit") & F.col("__new").isNotNull(), "edited").otherwise(F.col("review_status"))
    tags = F.when(a == "soft_delete", F.array_union(F.coalesce("tags", F.expr("CAST(array() AS array<string>)")), F.array(F.lit("soft_deleted")))).otherwise(F.col("tags"))
    edited = F.coalesce((a == "edit") & F.col("__new").isNotNull(), F.lit(False))
    rows = out.withColumn("review_status", status).withColumn("tags", tags).withColumn("intent_text", F.when(edited, F.col("__new")).otherwise(F.col("intent_text"))).withColumn("q_update_count", F.when(edited, 0).otherwise(F.col("q_update_count")))
    audit = own.select("decision_id", F.col("actor"), F.col("action"), F.col("experience_id").alias("target_id"), "decided_at")
    queue = own.where("action = 'edit'").select("experience_id").distinct()
    return rows.drop("action", "__new"), audit, queue


def upsert_rewards(old: DataFrame, new: DataFrame, e: DataFrame, replace: bool = False) -> tuple[DataFrame, DataFrame]:
    """Turn rewards after an upload (raw values validated; the last row of a key wins), and the scores of the experiences it touched. ``replace`` drops all old rows of an uploaded (experience, judge)."""
    clean = new.select("experience_id", "turn_index", "judge_model", *(valid_reward(F.col(f"r_{d}")).alias(f"r_{d}") for d in DIMS), valid_confidence(F.col("confidence")).alias("confidence"), "annotated_at", "upload_order")
    clean = latest(clean, ["experience_id", "turn_index", "judge_model"], "upload_order").drop("upload_order")
    keys = ["experience_id", "judge_model"] if replace else ["experience_id", "turn_index", "judge_model"]
    kept = old.select(clean.columns).join(clean.select(*keys).distinct(), keys, "left_anti")
    table = kept.unionByName(clean)
    touched = clean.select("experience_id").distinct()
    return table, trajectory_scores(e.join(touched, "experience_id", "left_semi"), table.join(touched, "experience_id", "left_semi"))


def pool_counts(tables: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in tables.items():
        one = df.agg(F.lit(name).alias("table"), F.count("*").alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


def lineage(ids: DataFrame, edges: DataFrame, updates: DataFrame) -> DataFrame:
    """Parents, children and updates of a set of ids: ``(experience_id, kind, other_id, at)``."""
    i = ids.select("experience_id").distinct()
    up = edges.join(i, edges.child_id == i.experience_id).select("experience_id", F.lit("parent").alias("kind"), F.col("parent_id").alias("other_id"), F.col("created_at").alias("at"))
    down = edges.join(i, edges.parent_id == i.experience_id).select("experience_id", F.lit("child").alias("kind"), F.col("child_id").alias("other_id"), F.col("created_at").alias("at"))
    q = updates.join(i, "experience_id").select("experience_id", F.lit("update").alias("kind"), F.col("update_id").alias("other_id"), F.col("created_at").alias("at"))
    return up.unionByName(down).unionByName(q)


def backfill(e: DataFrame, limit: int) -> DataFrame:
    """The oldest rows still at the first redaction layer, to be given a model's spans."""
    return e.where("sanitization_status = 'layer1_only'").orderBy("created_at", "experience_id").limit(limit)


def cluster_members(members: DataFrame, e: DataFrame) -> DataFrame:
    """Members of clusters by similarity, numbered."""
    from pyspark.sql import Window as W

    live = members.join(e.where(~F.coalesce("revoked", F.lit(False))).select("experience_id", "trajectory_score", "task_type"), "experience_id")
    return live.withColumn("nth", F.row_number().over(W.partitionBy("cluster_id").orderBy(F.desc("similarity"), "experience_id")))


def current_skills(skills: DataFrame, k: int) -> DataFrame:
    return skills.where(F.col("superseded_by").isNull()).orderBy(F.desc("structure_score"), "skill_id").limit(k)
