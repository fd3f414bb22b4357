"""Row-level queries of the parts of recall: endings, bonuses, the gate, scopes and text packs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.functions import outcomes
from tracelake.operators import recall, search
from tracelake.plans.registry import _add, _Roles

_TOOL = "CASE WHEN turn % 3 = 0 THEN 'Bash' WHEN turn % 3 = 1 THEN 'exec_command' ELSE 'web_search' END"
#: Conversation texts are invented prose: every other one gets a line that a tool could have printed.
_SAID = """concat(text, CASE (conv_id * 5 + turn) % 16 WHEN 0 THEN ' Process exited with code 0' WHEN 1 THEN ' process exited with code 137' WHEN 2 THEN ' 3 tests passed' WHEN 3 THEN ' error: no rule' WHEN 4 THEN ' Traceback (most recent call)' WHEN 5 THEN ' HTTP 201 created'
  WHEN 6 THEN ' 已完成' WHEN 7 THEN ' 报错了' WHEN 8 THEN ' it is ok now' WHEN 9 THEN ' tokens done_all' WHEN 10 THEN ' exception raised' WHEN 11 THEN ' <tool_use_error>' WHEN 12 THEN ' failed and fixed' ELSE '' END)"""


def _endings(r: _Roles) -> DataFrame:
    said = r.conversations.select("conv_id", "turn", F.expr(_TOOL).alias("tool"), F.expr(_SAID).alias("said"))
    return said.select("conv_id", "turn", outcomes.outcome_status(F.col("said")).alias("status"), outcomes.outcome_for_tool(F.col("tool"), F.col("said")).alias("tool_status"), outcomes.outcome_preference(F.col("said")).alias("preference"))


_WANTS = {name: "|".join(outcomes.pattern(k, x) for k, x in some) for name, some in (("good", outcomes.WANTS_SUCCESS), ("bad", outcomes.WANTS_FAILURE))}
_add("x13_outcomes", _endings,
     f"""WITH s AS (SELECT conv_id, turn, {_TOOL} AS tool, lower({_SAID}) AS low FROM conversations),
     p AS (SELECT *, {outcomes.duckdb('low', outcomes.TEXT_RULES)} AS status, regexp_matches(low, '{_WANTS["good"]}') AS good, regexp_matches(low, '{_WANTS["bad"]}') AS bad FROM s)
     SELECT conv_id, turn, status, CASE WHEN tool IN ('Bash', 'exec_command') THEN {outcomes.duckdb('low', outcomes.SHELL_RULES)} ELSE status END AS tool_status, CASE WHEN good AND NOT bad THEN 'success' WHEN bad AND NOT good THEN 'failure' END AS preference FROM p""")

_FEATURES = """SELECT l_orderkey * 1000000 + l_partkey * 10 + l_linenumber AS id, l_linenumber AS n_terms, l_partkey % 11 / 10.0 AS coverage, CASE l_suppkey % 6 WHEN 0 THEN 'do_unit' WHEN 1 THEN 'dont_unit' WHEN 2 THEN 'trajectory_segment' WHEN 3 THEN 'trajectory_overview' ELSE 'intent' END AS chunk_type,
  l_partkey % 3 / 4.0 AS keyword, l_orderkey % 50 / 100.0 AS similarity, CASE l_orderkey % 3 WHEN 0 THEN 'success' WHEN 1 THEN 'failure' END AS preference, l_orderkey % 60 / 100.0 AS score FROM lineitem"""


def _bonuses(r: _Roles) -> DataFrame:
    x = r.spark.sql(_FEATURES.replace("FROM lineitem", "FROM {lineitem}"), lineitem=r.lineitem)
    x = x.select("id", "n_terms", "chunk_type", "preference", *(F.col(c).cast("double").alias(c) for c in ("coverage", "keyword", "similarity", "score")))
    return x.select(
        "id", recall.coverage_bonus(F.col("n_terms"), F.col("coverage")).alias("coverage_bonus"), recall.type_bonus(F.col("chunk_type"), F.col("keyword"), F.col("similarity")).alias("type_bonus"), recall.outcome_bonus(F.col("preference"), F.col("chunk_type")).alias("outcome_bonus"),
        recall.relevant(F.col("score"), F.col("keyword"), F.col("coverage"), F.col("similarity")).alias("relevant"),
    )


_add("x9_bonuses", _bonuses,
     f"""WITH x AS ({_FEATURES}) SELECT id, CAST(CASE WHEN n_terms < 3 THEN 0 WHEN coverage >= 0.5 THEN 0.12 WHEN coverage >= 0.34 THEN 0.05 WHEN coverage <= 0.2 THEN -0.10 ELSE 0 END AS DOUBLE) AS coverage_bonus,
     CAST(CASE WHEN keyword <= 0 AND similarity < 0.2 THEN 0 WHEN chunk_type IN ('do_unit', 'dont_unit') THEN 0.14 WHEN chunk_type = 'trajectory_segment' THEN 0.03 WHEN chunk_type = 'trajectory_overview' THEN 0.01 ELSE 0 END AS DOUBLE) AS type_bonus,
     CAST(CASE WHEN preference IS NULL OR chunk_type NOT IN ('do_unit', 'dont_unit') THEN 0 WHEN (preference = 'success') = (chunk_type = 'do_unit') THEN 0.12 ELSE -0.08 END AS DOUBLE) AS outcome_bonus,
     score >= 0.24 AND (keyword > 0 OR coverage >= 0.2 OR similarity >= 0.34) AS relevant FROM x""")

_HITS = """SELECT conv_id AS query_id, turn + 1 AS position, CASE WHEN conv_id % 2 = 0 THEN 'personal' ELSE 'community' END AS source, CASE turn % 4 WHEN 0 THEN 'do_unit' WHEN 1 THEN 'dont_unit' WHEN 2 THEN 'trajectory_segment' ELSE 'intent' END AS chunk_type,
  CASE WHEN turn % 5 = 3 THEN 'success' WHEN turn % 5 = 4 THEN 'failure' END AS status, CAST(conv_id % 4 AS DOUBLE) / 4 AS score, CAST(turn * 8 AS DOUBLE) / 100 AS similarity, concat('exp-', conv_id * 1000003, '-x') AS experience_id,
  CASE WHEN turn % 3 > 0 THEN turn END AS turn_start, CASE WHEN turn % 3 = 2 THEN turn + conv_id % 2 END AS turn_end, text FROM conversations WHERE conv_id % 10 <> 7"""


def _packs(r: _Roles, budget: int | None) -> DataFrame:
    hits = r.spark.sql(_HITS.replace("FROM conversations", "FROM {conversations}"), conversations=r.conversations)
    packs = recall.context_packs(r.conversations.select(F.col("conv_id").alias("query_id")).distinct(), hits, budget)
    return packs.select("query_id", F.md5("pack").alias("pack_md5"), F.length("pack").cast("long").alias("chars"), F.col("packed").cast("long").alias("packed"))


def _packs_sql(budget: int | None) -> str:
    fits = "" if budget is None else f" WHERE used <= {budget}"
    return f"""WITH h AS ({_HITS}), t AS (SELECT *, regexp_replace(regexp_replace(text, '[\\s\\x0B\\x85\\xA0]+', ' ', 'g'), '^ | $', '', 'g') AS one FROM h),
     l AS (SELECT query_id, position, concat(position, '. [', CASE WHEN chunk_type = 'do_unit' OR status = 'success' THEN 'DO ' WHEN chunk_type = 'dont_unit' OR status = 'failure' THEN 'DO NOT ' ELSE '' END, source, ':', chunk_type, ', score=', printf('%.2f', score), ', sim=', CAST(round_even(similarity * 100, 0) AS BIGINT), '%, exp=', left(experience_id, 8),
       CASE WHEN turn_start IS NULL THEN '' WHEN turn_end IS NULL OR turn_end = turn_start THEN concat(', turn=', turn_start) ELSE concat(', turns=', turn_start, '-', turn_end) END, '] ', CASE WHEN length(one) <= 360 THEN one ELSE concat(rtrim(left(one, 359), ' '), '…') END) AS line FROM t),
     u AS (SELECT *, sum(length(line) + 1) OVER (PARTITION BY query_id ORDER BY position) AS used FROM l),
     p AS (SELECT query_id, string_agg(line, chr(10) ORDER BY position) AS lines, count(*) AS n FROM u{fits} GROUP BY query_id),
     f AS (SELECT q.query_id, coalesce(n, 0) AS packed, CASE WHEN n > 0 THEN concat('{recall.PACK_HEAD}', chr(10), lines, chr(10), '{recall.PACK_FOOT}') ELSE '{recall.PACK_NONE}' END AS pack FROM (SELECT DISTINCT conv_id AS query_id FROM conversations) q LEFT JOIN p ON p.query_id = q.query_id)
     SELECT query_id, md5(pack) AS pack_md5, CAST(length(pack) AS BIGINT) AS chars, packed FROM f"""


_add("t20_text_packs", lambda r: _packs(r, None), _packs_sql(None))
_add("t20_budgeted_packs", lambda r: _packs(r, 900), _packs_sql(900))


def _scopes(r: _Roles) -> DataFrame:
    """Every hundredth vector asks all others in each scope; owners, teams and projects go by number."""
    e = r.embeddings.select("vec_id", F.col("embedding").alias("vector"))
    rows = e.select(F.col("vec_id").alias("experience_id"), "vector", (F.col("vec_id") % 7 + 100).alias("read_owner"), F.when(F.col("vec_id") % 3 == 0, F.col("vec_id") % 4 + 10).otherwise(-1).alias("read_team"), (F.col("vec_id") % 5 == 0).cast("int").alias("read_shared"))
    asks = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "vector", (F.floor(F.col("vec_id") / 100) % 7 + 100).alias("read_owner"), (F.floor(F.col("vec_id") / 100) % 4 + 10).alias("read_team"), F.lit(1).alias("read_shared"), F.when(F.col("vec_id") % 300 != 0, F.concat(F.lit("p"), F.floor(F.col("vec_id") / 100) % 2)).alias("project"))
    owners = r.spark.createDataFrame([("p0", 100), ("p0", 103), ("p1", 103), ("p1", 106)], "project string, owner long")
    out = None
    for scope in ("auto", "personal", "community", "project"):
        q, c = recall.scoped(asks, rows, scope, owners)
        found = search.vector_top_k(q, c, 5, skip_self=True, acl=True).select(F.lit(scope).alias("scope"), "query_id", "experience_id", "rank")
        out = found if out is None else out.unionByName(found)
    return out


_add("t20_scopes", _scopes,
     """WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, vec_id % 7 + 100 AS owner, CASE WHEN vec_id % 3 = 0 THEN vec_id % 4 + 10 ELSE -1 END AS team, vec_id % 5 = 0 AS shared FROM embeddings),
     q AS (SELECT vec_id AS query_id, v AS w, vec_id // 100 % 7 + 100 AS me, vec_id // 100 % 4 + 10 AS mine, CASE WHEN vec_id % 300 <> 0 THEN concat('p', vec_id // 100 % 2) END AS project FROM e WHERE vec_id % 100 = 0),
     o(project, owner) AS (VALUES ('p0', 100), ('p0', 103), ('p1', 103), ('p1', 106)),
     x AS (SELECT query_id, vec_id AS experience_id, owner = me OR team = mine AS personal, shared, EXISTS (SELECT 1 FROM o WHERE o.project = q.project AND o.owner = e.owner) AS in_project, round(list_inner_product(v, w) / sqrt(list_inner_product(v, v)) / sqrt(list_inner_product(w, w)), 9) AS s FROM q JOIN e ON vec_id <> query_id),
     a AS (SELECT 'auto' AS scope, * FROM x WHERE personal OR shared UNION ALL SELECT 'personal', * FROM x WHERE personal UNION ALL SELECT 'community', * FROM x WHERE shared UNION ALL SELECT 'project', * FROM x WHERE in_project)
     SELECT * FROM (SELECT scope, query_id, experience_id, CAST(row_number() OVER (PARTITION BY scope, query_id ORDER BY s DESC, experience_id) AS INT) AS rank FROM a) WHERE rank <= 5""")
