"""Upkeep of a pool: index maintenance, work for labelling, logs of hits, usage of skills, upload cards and rows, keyphrases, evaluation without own chunks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.operators.access import searchable
from tracelake.operators.review import SUMMARY_MARK, is_task, task_text
from tracelake.operators.terms import STOP, retrieval_text
from tracelake.operators.windows import lacking_rewards, latest

# What makes a part of a keyphrase noise.
NOISY_PARTS = (
    r"\.(?:py|md|csv|json|jsonl|sh|pdf|txt|log|yaml|yml|mp4|mov|tar|tgz|gz)$", r"(?:^|[_-])step[_-]?\d+|checkpoint|ckpt|miniconda|x86_64|linux-x86", r"(?:_exps?|_eval|eval_|latest-linux|content_block_delta|api_error)",
    r"(?:secret|credential|password|username|api[_-]?key|agent[_-]?secret|agent[_-]?name|x-agent|stderr|stdout|proxy)", r"^(?:call_|toolu)", r"^(?=.*\d)(?:area)?[a-z0-9_-]{8,}$", r"^(?=.*[a-z])(?=.*\d)[a-z0-9]{5,10}$",
    r"^[a-f0-9]{7,}$", r"[/\\.]",
)
# Lengths of an upload card's parts.
QUERY_CHARS, STEP_CHARS, OUTCOME_CHARS = 4000, 280, 500


def maintain_index(chunks: DataFrame, e: DataFrame, build: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The chunk table after maintenance, each row with its ``action``: kept, refreshed, provenance or built. Chunks of rows that are not searchable any more are gone.

    chunks: chunk_id, experience_id, session_id, text, search_text; ``build`` makes such rows for the searchable experiences that have none. Missing
    session ids are taken from the experience, and a search text that differs from what its text gives now is made again.
    """
    live = searchable(e).select("experience_id", F.col("session_id").alias("own_session"))
    fresh = retrieval_text(F.col("text"))
    session = F.when(F.coalesce("session_id", F.lit("")) == "", F.col("own_session")).otherwise(F.col("session_id"))
    action = F.when(~fresh.eqNullSafe(F.col("search_text")), "refreshed").when(~session.eqNullSafe(F.col("session_id")), "provenance").otherwise("kept")
    old = chunks.join(live, "experience_id").select("chunk_id", "experience_id", session.alias("session_id"), "text", fresh.alias("search_text"), action.alias("action"))
    missing = searchable(e).join(chunks.select("experience_id"), "experience_id", "left_anti")
    return old.unionByName(build(missing).withColumn("action", F.lit("built")))


def labelling_work(e: DataFrame, turn_rewards: DataFrame, mode: str = "missing_for_judge", judge: str | None = None, limit: int = 100) -> DataFrame:
    """The newest experiences to label: all, those without any turn reward, or those without one of ``judge``. ``annotated``: the judge has been there, only its intent is looked at."""
    if mode not in ("all", "missing", "missing_for_judge"):
        raise ValueError(mode)
    work = e if mode == "all" else e.join(lacking_rewards(e, turn_rewards, judge if mode == "missing_for_judge" else None), "experience_id", "left_semi")
    newest = work.orderBy(F.desc("created_at"), "experience_id").limit(limit).select("experience_id", "created_at")
    seen = turn_rewards.where(F.col("judge_model") == F.lit(judge)).select("experience_id").distinct().withColumn("seen", F.lit(True))
    return newest.join(seen, "experience_id", "left").select("experience_id", "created_at", F.coalesce("seen", F.lit(False)).alias("annotated"))


def hit_logs(hits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The search log (ranks from 0) and the reuse items (ranks from 1) of the hits ``(event_id, viewer_id, query, experience_id, chunk_id, rank, score, similarity)``.

    Of an item that an event holds twice the later rank stays (then the higher score); a missing chunk is the empty one.
    """
    log = hits.select("experience_id", F.col("viewer_id").alias("queried_by"), F.col("query").alias("query_text"), (F.col("rank") - 1).alias("rank"), "similarity", "score")
    items = hits.withColumn("chunk_id", F.coalesce(F.col("chunk_id").cast("string"), F.lit("")))
    items = latest(items, ["event_id", "experience_id", "chunk_id"], "rank", "score", "similarity").select("event_id", "experience_id", "chunk_id", "rank", F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("similarity", F.lit(0.0)).alias("similarity"))
    return log, items


def skill_links(declared: DataFrame, skills: DataFrame) -> DataFrame:
    """Distinct ``(experience_id, skill_id)``: ``name`` is its newest version (then the greatest id), ``name@version`` that one."""
    name, version = F.split_part("declared", F.lit("@"), F.lit(1)), F.when(F.col("declared").contains("@"), F.split_part("declared", F.lit("@"), F.lit(2)))
    d = declared.select("experience_id", name.alias("name"), version.alias("version"))
    newest = latest(skills, ["name"], "created_at", "skill_id").select("name", "skill_id")
    exact = d.where("version IS NOT NULL").join(skills.select("name", "version", "skill_id"), ["name", "version"]).select("experience_id", "skill_id")
    return exact.unionByName(d.where("version IS NULL").join(newest, "name").select("experience_id", "skill_id")).distinct()


def skill_usage(links: DataFrame, e: DataFrame, skills: DataFrame) -> DataFrame:
    """Both directions at once: ``(skill_id, name, experience_id, task_type, created_at)`` of the experiences given (what a viewer may see) and their live skills."""
    live = skills.where(~F.coalesce("revoked", F.lit(False))).select("skill_id", "name")
    return links.join(e.select("experience_id", "task_type", "created_at"), "experience_id").join(live, "skill_id").select("skill_id", "name", "experience_id", "task_type", "created_at")


def without_own(hits: DataFrame, cases: DataFrame, k: int) -> DataFrame:
    """Hits ``(case_id, chunk_id, rank)`` without the chunks ``(case_id, chunk_id)`` that the case itself comes from, ranked anew."""
    from tracelake.operators.ranking import top_k

    return top_k(hits.join(cases.select("case_id", "chunk_id"), ["case_id", "chunk_id"], "left_anti").withColumnRenamed("rank", "raw_rank"), "case_id", k, "raw_rank").drop("raw_rank")


def upload_cards(turns: DataFrame, key: str = "conv_id", clip: int | None = None) -> DataFrame:
    """Card of an upload from turns (key, turn, role, text): the first meaningful user turn, a task summary or else the query's head as intent, steps, outcome.

    ``clip`` is the backfill variant: every part is clipped to so many characters.
    """
    text = F.coalesce("text", F.lit(""))
    summary = F.trim(F.regexp_extract(text, SUMMARY_MARK + r"[:：]?\s*(\S[^\n]*)", 1))
    user, bot = F.col("role") == "user", (F.col("role") == "assistant") & (F.trim(text) != "")
    cut = lambda c, n: F.substring(c, 1, min(n, clip or n))
    t = turns.select(key, "turn", user.alias("user"), bot.alias("bot"), text.alias("t"), task_text(F.col("text")).alias("task"), is_task(F.col("text")).alias("meant"), summary.alias("summary"))
    cards = t.groupBy(key).agg(
        F.min_by("task", F.when(F.col("user") & F.col("meant"), F.col("turn"))).alias("query"), F.max_by("summary", F.when(F.col("bot") & (F.col("summary") != ""), F.col("turn"))).alias("summary"),
        F.transform(F.sort_array(F.collect_list(F.when(F.col("bot"), F.struct("turn", F.substring("t", 1, STEP_CHARS).alias("s"))))), lambda x: cut(x["s"], STEP_CHARS)).alias("steps"),
        F.max_by("t", F.when(F.col("bot"), F.col("turn"))).alias("outcome"),
    )
    query = F.coalesce(F.nullif(cut(F.col("query"), QUERY_CHARS), F.lit("")), F.col("summary"), F.lit("(no user turn)"))
    intent = F.coalesce(F.col("summary"), F.substring(F.trim(F.regexp_replace(query, r"\s+", " ")), 1, 120))
    return cards.select(key, query.alias("query"), intent.alias("intent"), "steps", F.coalesce(F.nullif(cut(F.col("outcome"), OUTCOME_CHARS), F.lit("")), F.lit("(no assistant turn)")).alias("outcome"))


def upload_rows(records: DataFrame, cards: DataFrame, task_type: str, acl: str = "private", sensitivity: str = "medium") -> DataFrame:
    """Rows to upload: records ``(session_id, source, meta map, lineage map)`` with their cards. What ``meta`` names itself wins over the lineage; the model is ``meta``'s."""
    given = F.coalesce("meta", F.create_map().cast("map<string,string>"))
    lineage = F.map_filter(F.coalesce("lineage", F.create_map().cast("map<string,string>")), lambda k, v: v.isNotNull())
    extra = F.map_concat(lineage, F.create_map(F.lit("ingest_source"), F.col("source")))
    meta = F.map_concat(F.map_filter(extra, lambda k, _: ~F.array_contains(F.map_keys(given), k)), given)
    model = F.coalesce(F.try_element_at(given, F.lit("model")), F.try_element_at(given, F.lit("source_turn_model")), F.lit("unknown"))
    own = records.select("session_id", "source", meta.alias("meta"), model.alias("source_model"))
    return own.join(cards, "session_id").select(
        "session_id", "query", "intent", "steps", "outcome", F.lit(task_type).alias("task_type"), "source_model", F.lit(sensitivity).alias("sensitivity"), F.lit(acl).alias("acl"), F.array("source").alias("tags"), "meta",
    )


def keyphrases(
    words: DataFrame, rows: DataFrame, key: str, text: str, rules: list[tuple[str, tuple[str, ...]]], anchors: tuple[str, ...], boost: tuple[str, ...] = (), stop: tuple[str, ...] = STOP, allowed: tuple[str, ...] = (), most: int = 16
) -> DataFrame:
    """``(key, phrases)``: rules whose terms are all there, anchors with their two best partners, neighbouring code terms; valid ones, at most ``most``.

    words: ``(key, term, rank)`` as ``terms.keywords`` gives them. A valid phrase has two parts or more, one of them an anchor, and no noise.
    """
    terms = F.transform(F.sort_array(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"])
    t = rows.select(key, F.lower(F.coalesce(F.col(text), F.lit(""))).alias("low")).join(words.groupBy(key).agg(terms.alias("words")), key)

    def noisy(c: Column) -> Column:
        bad = c.isin(*stop) | (F.length(c) > 48)
        for p in NOISY_PARTS:
            bad = bad | c.rlike(p)
        return F.when(c.isin(*anchors, *boost), False).otherwise(bad)

    def strong(c: Column) -> Column:
        shape = c.isin(*boost) | c.contains("_") | c.rlike("[a-z][0-9]|[0-9][a-z]") | ((F.length(c) >= 7) & ~c.rlike(r"^\p{L}+$"))
        return ~c.isin(*stop) & ~noisy(c) & shape

    none = F.expr("CAST(array() AS array<string>)")
    there = lambda w: F.array_contains("words", w) | F.col("low").contains(w)
    by_rule = F.array_compact(F.array(*(F.when(_all([there(w) for w in need]), phrase) for phrase, need in rules))) if rules else none
    t = t.withColumn("partners", F.filter("words", lambda w: ~w.isin(*anchors) & strong(w)))
    first = F.slice(F.filter("words", lambda w: w.isin(*anchors)), 1, 5)
    by_anchor = F.when(F.size("partners") > 0, F.transform(first, lambda a: F.concat_ws(" ", a, F.array_join(F.slice("partners", 1, 2), " ")))).otherwise(none)
    t = t.withColumn("code", F.filter("words", lambda w: w.contains("_") & strong(w)))
    by_code = F.when(F.size("code") > 1, F.transform(F.slice("code", F.lit(2), F.greatest(F.size("code") - 1, F.lit(0))), lambda w, i: F.concat_ws(" ", F.col("code")[i], w))).otherwise(none)
    valid = lambda p: (F.length(p) <= 120) & (F.size(F.split(p, " ")) >= 2) & F.exists(F.split(p, " "), lambda w: w.isin(*anchors)) & ~F.exists(F.split(p, " "), lambda w: noisy(w) & (~w.isin(*allowed) if allowed else F.lit(True)))
    return t.select(key, F.slice(F.filter(F.array_distinct(F.concat(by_rule, by_anchor, by_code)), valid), 1, most).alias("phrases"))


def _all(tests: list[Column]) -> Column:
    out = F.lit(True)
    for t in tests:
        out = out & t
    return out
