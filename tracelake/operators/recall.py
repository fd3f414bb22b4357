"""Recall for many queries and viewers: candidates, access, the ten-term score, the relevance gate, diverse hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.functions.scores import q_or_score
from tracelake.functions.outcomes import outcome_preference
from tracelake.functions.text import lexical_score, tokens_udf
from tracelake.operators.access import acl_team, searchable
from tracelake.operators.ranking import readable_top_k, staged_top_k, top_k
from tracelake.operators.search import diverse_top_k, vector_top_k

# Weights of the rerank, and how far candidates may fall.
WEIGHTS = {"fts": 0.07, "lexical": 0.15, "vector": 0.20, "quality": 0.02, "action": 0.24, "situation": 0.22, "outcome": 0.10}
FTS_LIMIT = VECTOR_LIMIT = 300
FLOOR, VECTOR_FLOOR = 0.24, 0.34


def acl_search(ranked: DataFrame, readable: DataFrame, k: int) -> DataFrame:
    return readable_top_k(ranked, readable, k)


def lite_search(queries: DataFrame, vectors: DataFrame, rows: DataFrame, viewer_owner: str, viewer_team: str | None, unlocked: bool, k: int) -> DataFrame:
    """By cosine over all searchable rows: own rows and those of the viewer's team first, then, for an unlocked owner, the community's.

    queries: query_id, vector; vectors: experience_id, vector; rows: experiences with their ``owner``.
    """
    live = searchable(rows)
    mine = F.coalesce(F.col("owner") == viewer_owner, F.lit(False))
    community = (F.col("acl") == "public") & (F.coalesce("publish_status", F.lit("private")) == "published")
    team = F.coalesce(acl_team(F.col("acl")) == F.lit(viewer_team), F.lit(False))
    near = lambda which: vector_top_k(queries, vectors.join(live.where(which).select("experience_id"), "experience_id", "left_semi"), k)
    other = near(~mine & community)
    return staged_top_k(near(mine | (team & ~community)), other if unlocked else other.limit(0), k)


def candidates(keyword: DataFrame, vector: DataFrame) -> DataFrame:
    """``(query_id, chunk_id, fts, similarity)``: the union of both candidate sets, each within its limit. Keyword hits may bring their own ``similarity``."""
    own = F.col("similarity") if "similarity" in keyword.columns else F.lit(0.0)
    k = keyword.where(F.col("rank") <= FTS_LIMIT).select("query_id", "chunk_id", F.col("signal").alias("fts"), own.alias("similarity"))
    v = vector.where(F.col("rank") <= VECTOR_LIMIT).select("query_id", "chunk_id", F.lit(0.0).alias("fts"), "similarity")
    return k.unionByName(v).groupBy("query_id", "chunk_id").agg(F.max("fts").alias("fts"), F.max("similarity").alias("similarity"))


def coverage_bonus(n_terms: Column, coverage: Column) -> Column:
    """For queries of three terms or more: how many of them a chunk holds."""
    return F.when(n_terms < 3, 0.0).when(coverage >= 0.5, 0.12).when(coverage >= 0.34, 0.05).when(coverage <= 0.2, -0.10).otherwise(0.0)


def type_bonus(chunk_type: Column, keyword: Column, similarity: Column) -> Column:
    """Units before segments and overviews, unless nothing but a weak similarity speaks for the chunk."""
    weak = (keyword <= 0) & (similarity < 0.2)
    return F.when(weak, 0.0).when(chunk_type.isin("do_unit", "dont_unit"), 0.14).when(chunk_type == "trajectory_segment", 0.03).when(chunk_type == "trajectory_overview", 0.01).otherwise(0.0)


def outcome_bonus(preference: Column, chunk_type: Column) -> Column:
    """Units of the ending that the query asks for, against those of the other."""
    asked = preference.isNotNull() & chunk_type.isin("do_unit", "dont_unit")
    match = (preference == "success") == (chunk_type == "do_unit")
    return F.when(asked & match, 0.12).when(asked, -0.08).otherwise(0.0)


def relevant(score: Column, keyword: Column, coverage: Column, similarity: Column) -> Column:
    """Low scores are no filler; a chunk that shares no word with the query must be near it."""
    return (score >= FLOOR) & ((keyword > 0) | (coverage >= 0.2) | (similarity >= VECTOR_FLOOR))


def scoped(queries: DataFrame, chunks: DataFrame, scope: str = "auto", project_owners: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Queries and chunks with the columns ``READ`` narrowed to a scope.

    ``personal``: own rows and the team's; ``community``: shared rows only; ``auto``: both. ``project``: rows of the owners that ``project_owners`` (``project``, ``owner`` as in ``read_owner``) names for
    the query's ``project``, and nothing else; a query without a project then finds nothing.
    """
    if scope == "auto":
        return queries, chunks
    if scope == "personal":
        return queries.withColumn("read_shared", F.lit(0)), chunks
    if scope == "community":
        return queries.withColumns({"read_owner": F.lit(0).cast("long"), "read_team": F.lit(0).cast("long")}), chunks
    if scope != "project" or project_owners is None:
        raise ValueError("scope is auto, personal, community or, with project_owners, project")
    asks = queries.withColumns({"read_owner": F.lit(0).cast("long"), "read_team": F.coalesce(F.xxhash64("project"), F.lit(0)), "read_shared": F.lit(0)})
    asks = asks.withColumn("read_team", F.when(F.col("project").isNull(), 0).otherwise(F.col("read_team")))
    open_to = project_owners.select(F.xxhash64("project").alias("__project"), F.col("owner").alias("read_owner")).distinct()
    rows = chunks.join(open_to, "read_owner").withColumns({"read_team": F.col("__project"), "read_owner": F.lit(-1).cast("long"), "read_shared": F.lit(0)})
    return asks, rows.drop("__project")


# The lines around a text pack, its excerpts, and what is said when nothing was found.
PACK_HEAD, PACK_FOOT = "【经验池RAG上下文】以下为按权限过滤、chunk 召回后的短上下文。", "使用要求：DO 可模仿；DO NOT 只用于规避；若冲突，以当前代码和用户要求为准。"
PACK_NONE, EXCERPT = "【经验池RAG上下文】未找到可用经验。", 360


def excerpt(text: Column, limit: int = EXCERPT) -> Column:
    """White space drawn together; a longer text is cut and ends in an ellipsis."""
    t = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "), r"^ | $", "")
    return F.when(F.length(t) <= limit, t).otherwise(F.concat(F.regexp_replace(F.substring(t, 1, limit - 1), r" +$", ""), F.lit("…")))


def context_packs(queries: DataFrame, hits: DataFrame, budget: int | None = None) -> DataFrame:
    """One text a query for an agent to read: ``query_id``, ``pack``, ``packed`` (hits in it).

    hits: ``query_id``, ``position`` (1, 2, .. after ``diverse_top_k``), ``source``, ``chunk_type``, ``status``, ``score``, ``similarity``, ``experience_id``, ``turn_start``, ``turn_end``, ``text``. With a ``budget`` of characters for the
    hits' lines, line breaks counted, the pack ends before the first line that does not fit.
    """
    kind, status = F.col("chunk_type"), F.coalesce("status", F.lit(""))
    use = F.when((kind == "do_unit") | (status == "success"), "DO ").when((kind == "dont_unit") | (status == "failure"), "DO NOT ").otherwise("")
    turns = F.when(F.col("turn_start").isNull(), "").when(F.col("turn_end").isNull() | (F.col("turn_end") == F.col("turn_start")), F.concat(F.lit(", turn="), "turn_start")).otherwise(F.concat(F.lit(", turns="), "turn_start", F.lit("-"), "turn_end"))
    line = F.concat(
        F.col("position").cast("string"), F.lit(". ["), use, "source", F.lit(":"), kind, F.lit(", score="), F.format_string("%.2f", F.bround(F.coalesce("score", F.lit(0.0)).cast("double"), 2)), F.lit(", sim="), F.bround(F.col("similarity").cast("double") * 100).cast("long").cast("string"),
        F.lit("%, exp="), F.substring(F.col("experience_id").cast("string"), 1, 8), turns, F.lit("] "), excerpt(F.col("text")),
    )
    lines = hits.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", line.alias("line")))), lambda x: x["line"]).alias("lines"))  # at most k of a query
    if budget is not None:
        fits = F.aggregate("lines", F.struct(F.lit(0).alias("used"), F.lit(0).alias("n")), lambda a, x: F.struct((a["used"] + F.length(x) + 1).alias("used"), F.when(a["used"] + F.length(x) + 1 <= budget, a["n"] + 1).otherwise(a["n"]).alias("n")), lambda a: a["n"])
        lines = lines.select("query_id", F.slice("lines", F.lit(1), fits).alias("lines"))
    out = queries.select("query_id").join(lines, "query_id", "left")
    full = F.concat_ws("\n", F.array(F.lit(PACK_HEAD)), "lines", F.array(F.lit(PACK_FOOT)))
    packed = F.when(F.coalesce(F.size("lines"), F.lit(0)) > 0, F.size("lines")).otherwise(0)
    return out.select("query_id", F.when(packed > 0, full).otherwise(PACK_NONE).alias("pack"), packed.alias("packed"))


def rerank(found: DataFrame, queries: DataFrame, chunks: DataFrame) -> DataFrame:
    """``found`` with a score. chunks: chunk_id, experience_id, session, chunk_type, text, quality; a chunk's labelled lines are its situation, action and outcome."""
    line = lambda name: F.regexp_extract("text", rf"(?m)^{name}: (.*)$", 1)
    c = chunks.withColumn("situation", F.when(line("Situation") == "", F.col("text")).otherwise(line("Situation"))).withColumn("action", F.when(line("Action") == "", F.col("text")).otherwise(line("Action"))).withColumn("ending", line("Outcome"))
    own = found.select("chunk_id").distinct()
    c = c.join(own, "chunk_id").withColumns({f"{x}_terms": tokens_udf(x) for x in ("text", "situation", "action", "ending")})
    x = found.join(queries.select("query_id", F.col("text").alias("q"), tokens_udf("text").alias("q_terms")), "query_id").join(c, "chunk_id")
    for name in ("text", "situation", "action", "ending"):
        x = x.withColumn(f"{name}_match", lexical_score(F.col("q_terms"), F.col(f"{name}_terms")))
    x = x.withColumn("coverage", F.size(F.array_intersect("q_terms", "text_terms")) / F.greatest(F.size("q_terms"), F.lit(1))).withColumn("keyword", F.greatest("fts", "text_match"))
    bonus = outcome_bonus(outcome_preference(F.col("q")), F.col("chunk_type")) + type_bonus(F.col("chunk_type"), F.col("keyword"), F.col("similarity")) + coverage_bonus(F.size("q_terms"), F.col("coverage"))
    score = (
        WEIGHTS["fts"] * F.col("fts") + WEIGHTS["lexical"] * F.col("text_match") + WEIGHTS["vector"] * F.greatest(F.col("similarity"), F.lit(0.0)) + WEIGHTS["quality"] * F.coalesce("quality", F.lit(0.0))
        + WEIGHTS["action"] * F.col("action_match") + WEIGHTS["situation"] * F.col("situation_match") + WEIGHTS["outcome"] * F.col("ending_match") + bonus
    )
    x = x.withColumn("score", F.round(score, 6))
    return x.withColumn("relevant", relevant(F.col("score"), F.col("keyword"), F.col("coverage"), F.col("similarity")))


def recall(keyword: DataFrame, vector: DataFrame, queries: DataFrame, chunks: DataFrame, k: int, gate: bool = True) -> DataFrame:
    """Diverse hits ``(query_id, chunk_id, position)`` of each query."""
    scored = rerank(candidates(keyword, vector), queries, chunks)
    scored = scored.where("relevant") if gate else scored
    near = top_k(scored, "query_id", FTS_LIMIT + VECTOR_LIMIT, F.desc("score"), "chunk_id")
    keys = near.select("query_id", "chunk_id", "experience_id", F.coalesce("session", F.col("experience_id").cast("string")).alias("session"), F.sha1("text").alias("text_key"), F.when(F.col("action") != F.col("text"), F.sha1("action")).alias("action_key"), "score")
    return diverse_top_k(keys, k)


def skill_search(similar: DataFrame, skills: DataFrame, k: int) -> DataFrame:
    """Mixed ranking of skills; visits are invocations and installs."""
    from tracelake.operators.ranking import mixed_scores

    c = similar.join(skills.select("skill_id", q_or_score().alias("q"), (F.col("invoke_count") + F.col("install_count")).alias("visit_count")), "skill_id")
    return top_k(mixed_scores(c).withColumn("score", F.round("score", 6)), "query_id", k, F.desc("score"), "skill_id")


def silver_cases(units: DataFrame, peers: DataFrame, budget: int = 320) -> DataFrame:
    """A query from each unit's labelled lines under a character budget, and how many chunks would answer it."""
    line = lambda name: F.trim(F.regexp_extract("text", rf"(?m)^{name}: (.*)$", 1))
    cut = lambda c, share: F.substring(c, 1, int(budget * share))
    query = F.concat_ws(" ", *(F.when(x != "", x) for x in (cut(line("Situation"), 0.38), cut(line("Action"), 0.24), cut(line("Outcome"), 0.22))))
    return units.withColumn("query", F.substring(query, 1, budget)).where("query <> ''").join(peers, "chunk_id").select(F.concat(F.lit("silver-"), "chunk_id").alias("case_id"), "query", "chunk_id", "peers")
