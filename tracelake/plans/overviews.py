"""Queries of whole dashboards, with all their columns in the SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracelake.operators import overview, review
from tracelake.plans.catalog import _RUNS
from tracelake.plans.registry import AS_OF, _add

_PARTS = " UNION ALL ".join(f"SELECT '{c}' AS section, CAST({c} AS VARCHAR) AS name, count(*) AS n FROM experiences GROUP BY 2" for c in ("review_status", "task_type", "sensitivity"))
_add("a2_dashboard", lambda r: overview.dashboard(r.experiences, AS_OF),
     f"""WITH t AS (SELECT experience_id, reuse_count FROM experiences WHERE reuse_count > 0 ORDER BY reuse_count DESC, experience_id LIMIT 10)
     SELECT 'total' AS section, CAST(NULL AS VARCHAR) AS name, count(*) AS n FROM experiences UNION ALL {_PARTS} UNION ALL SELECT 'last_7_days', NULL, count(*) FROM experiences WHERE created_at >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY
     UNION ALL SELECT 'top_reused', CAST(experience_id AS VARCHAR), reuse_count FROM t""")
_add("a25_skill_overview", lambda r: overview.skill_overview(r.skills),
     """WITH s AS (SELECT * FROM skills WHERE NOT revoked), t AS (SELECT skill_id, invoke_count FROM s ORDER BY invoke_count DESC, skill_id LIMIT 10)
     SELECT 'total' AS section, CAST(NULL AS VARCHAR) AS name, count(*) AS n FROM s UNION ALL SELECT 'invocations', NULL, CAST(sum(invoke_count) AS BIGINT) FROM s UNION ALL SELECT 'review_status', review_status, count(*) FROM s GROUP BY 2 UNION ALL SELECT 'top_invoked', CAST(skill_id AS VARCHAR), invoke_count FROM t""")
_add("a16_pool_overview", lambda r: overview.pool_overview(r.experiences, r.agents, r.audits),
     """WITH l AS (SELECT * FROM experiences WHERE NOT revoked), t AS (SELECT task_type, count(*) AS n FROM l GROUP BY 1 ORDER BY n DESC, task_type LIMIT 5), p AS (SELECT experience_id FROM experiences WHERE review_status IN ('approved', 'auto_approved', 'edited') AND extraction_status = 'done' AND NOT revoked),
     r AS (SELECT CAST(sum(CAST(payload->>'$.k' AS BIGINT)) AS BIGINT) AS n FROM (SELECT payload FROM audits ORDER BY created_at DESC, audit_id DESC LIMIT 500))
     SELECT 'agents' AS section, CAST(NULL AS VARCHAR) AS name, count(*) AS n FROM agents UNION ALL SELECT 'teams', NULL, count(DISTINCT team) FROM agents
     UNION ALL SELECT 'acl', CASE WHEN acl IN ('public', 'org') THEN 'public' WHEN acl LIKE 'team:_%' THEN 'team' ELSE 'private' END, count(*) FROM l GROUP BY 2 UNION ALL SELECT 'top_tasks', task_type, n FROM t UNION ALL SELECT 'redactions', NULL, n FROM r UNION ALL SELECT 'searchable', NULL, count(*) FROM p""")
_add("a10_timeline", lambda r: overview.timeline(r.reuse_items, r.q_updates, AS_OF),
     f"""WITH c AS (SELECT CAST(feedback_at AS DATE) AS d, count(*) AS n, avg(reward) AS a FROM reuse_items WHERE feedback_at IS NOT NULL GROUP BY 1), u AS (SELECT CAST(created_at AS DATE) AS d, count(*) AS n FROM q_updates GROUP BY 1)
     SELECT CAST(DATE '{AS_OF}' - CAST(i AS INT) AS DATE) AS day, coalesce(c.n, 0) AS feedback, round(a, 6) AS avg_reward, coalesce(u.n, 0) AS q_updates FROM range(14) s(i) LEFT JOIN c ON c.d = DATE '{AS_OF}' - CAST(i AS INT) LEFT JOIN u ON u.d = DATE '{AS_OF}' - CAST(i AS INT)""")
_add("a27_newest_audits", lambda r: overview.newest_audits(r.audits).select("audit_id", F.size("payload").cast("long").alias("keys"), F.col("payload")["k"].alias("k")),
     "SELECT audit_id, CAST(len(json_keys(payload)) AS BIGINT) AS keys, payload->>'$.k' AS k FROM (SELECT * FROM audits ORDER BY created_at DESC, audit_id DESC LIMIT 20)")
_add("j15_audited_lineage", lambda r: overview.audited_lineage(r.experiences, r.edges, r.q_updates, r.audits.withColumn("target_id", F.expr("audit_id * 3"))).groupBy("experience_id", "kind").agg(F.count("*").alias("n"), F.max("at").alias("latest"), F.sum("other_id").alias("others")),
     """WITH x AS (SELECT child_id AS experience_id, 'parent' AS kind, created_at, parent_id AS other FROM edges UNION ALL SELECT parent_id, 'child', created_at, child_id FROM edges UNION ALL SELECT experience_id, 'update', created_at, update_id FROM q_updates UNION ALL SELECT audit_id * 3, 'audit', created_at, audit_id FROM audits)
     SELECT experience_id, kind, count(*) AS n, max(created_at) AS latest, CAST(sum(other) AS BIGINT) AS others FROM x WHERE experience_id IN (SELECT experience_id FROM experiences) GROUP BY 1, 2""")


def _runs(r):
    """As the query of pairs, without the runs of every seventh experience."""
    run = r.lineitem.where("l_orderkey % 7 <> 0").groupBy(F.col("l_orderkey").alias("experience_id"), F.when(F.col("l_linenumber") % 2 == 0, "A").otherwise("B").alias("run"))
    return run.agg(F.max(F.expr("l_partkey % 5")).alias("n_steps"), F.max(F.expr("l_suppkey % 5")).alias("n_tools"), F.count("*").alias("n_decisions"), F.max("l_linenumber").alias("n_pitfalls"), F.max("l_discount").alias("confidence"))


_add("a20_extraction_states", lambda r: overview.extraction_states(r.experiences, review.pick_extraction(_runs(r))).select("experience_id", "chosen", "status"),
     f"""WITH x AS ({_RUNS.replace('FROM lineitem', 'FROM lineitem WHERE l_orderkey % 7 <> 0')}), p AS (SELECT coalesce(a.experience_id, b.experience_id) AS experience_id, a.confidence AS ca, b.confidence AS cb, abs(a.n_steps - b.n_steps) + abs(a.n_tools - b.n_tools) + abs(a.n_decisions - b.n_decisions) + abs(a.n_pitfalls - b.n_pitfalls) AS gap,
     greatest(a.n_steps, b.n_steps) + greatest(a.n_tools, b.n_tools) + greatest(a.n_decisions, b.n_decisions) + greatest(a.n_pitfalls, b.n_pitfalls) AS most FROM (SELECT * FROM x WHERE run = 'A') a FULL JOIN (SELECT * FROM x WHERE run = 'B') b ON a.experience_id = b.experience_id),
     d AS (SELECT *, CASE WHEN ca IS NOT NULL AND cb IS NOT NULL THEN gap / greatest(most, 1) ELSE 0 END AS div FROM p)
     SELECT e.experience_id, CASE WHEN d.experience_id IS NULL THEN NULL WHEN cb IS NULL OR ca >= cb THEN 'A' ELSE 'B' END AS chosen, CASE WHEN d.experience_id IS NULL THEN 'failed' WHEN ca IS NOT NULL AND cb IS NOT NULL AND div >= 0.5 THEN 'unstable' ELSE 'done' END AS status FROM experiences e LEFT JOIN d ON d.experience_id = e.experience_id""")
