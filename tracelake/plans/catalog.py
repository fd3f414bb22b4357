"""The registered queries of the pool operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.functions import embedding, scores
from tracelake.functions import text as tx
from tracelake.functions.constants import DIMS, SEARCHABLE
from tracelake.functions.redaction_rules import REDACTION_RULES, STRICT_RULES
from tracelake.operators import access, aggregates, credit, dedup, ranking, recall, redaction, review, search, terms, turns, units, upkeep, windows
from tracelake.operators.dedup import _cut
from tracelake.plans.registry import AS_OF, ORACLES, QUERIES, _add, _Roles, _rounded
from tracelake.plans.roles import ROLES
from tracelake.streaming import jobs

_Q = " + ".join(f"{w} * q_{d}" for d, w in (("outcome", "0.30"), ("intent", "0.20"), ("execution", "0.20"), ("orchestration", "0.15"), ("expression", "0.15")))
_QS = f"CASE WHEN q_update_count > 0 OR abs({_Q}) > 1e-9 THEN {_Q} ELSE trajectory_score END"
_SHARED = "acl = 'public' AND publish_status = 'published' AND NOT revoked"
_FEEDBACK = """SELECT experience_id, count(DISTINCT event_id) AS event_count, count(*) AS feedback_count, count(*) FILTER (was_used) AS used_count, count(*) FILTER (NOT was_used) AS not_used_count,
  count(*) FILTER (reward > 0) AS positive_count, count(*) FILTER (reward < 0) AS negative_count, avg(reward) AS avg_reward, avg(confidence) AS avg_confidence, max(feedback_at) AS latest_feedback_at
  FROM reuse_items WHERE feedback_at IS NOT NULL GROUP BY experience_id"""

# predicates and access

_add("p1_searchable", lambda r: access.searchable(r.experiences).select("experience_id"), "SELECT experience_id FROM experiences WHERE review_status IN ('approved', 'auto_approved', 'edited') AND extraction_status = 'done' AND NOT revoked")
_add("p2_browse", lambda r: access.browse(r.experiences, review="approved", search="99", limit=50, offset=3).select("experience_id", "created_at"),
     f"SELECT experience_id, created_at FROM experiences WHERE {_SHARED} AND review_status = 'approved' AND (contains(intent_text, '99') OR contains(CAST(experience_id AS VARCHAR), '99')) ORDER BY created_at DESC, experience_id LIMIT 50 OFFSET 3")
_add("p3_distinct_values", lambda r: access.distinct_values(r.experiences, "task_type"), f"SELECT DISTINCT task_type AS value FROM experiences WHERE {_SHARED}")
_add("p4_acl_parse", lambda r: r.experiences.select("experience_id", access.acl_kind(F.col("acl")).alias("kind"), access.acl_team(F.col("acl")).alias("team"), access.ingest_acl(F.col("acl")).alias("ingest"), access.ingest_status(F.lit("human_review"), F.col("acl")).alias("review")),
     """SELECT experience_id, CASE WHEN acl IN ('public', 'org') THEN 'public' WHEN acl LIKE 'team:_%' THEN 'team' ELSE 'private' END AS kind, CASE WHEN acl LIKE 'team:_%' THEN acl[6:] END AS team,
     CASE WHEN acl LIKE 'team:_%' THEN acl ELSE 'private' END AS ingest, CASE WHEN acl LIKE 'team:_%' THEN 'pending' ELSE 'auto_approved' END AS review FROM experiences""")
_add("j5_all_viewers", lambda r: access.visible_counts(r.agents.select(F.col("agent_id").alias("viewer_id")), r.experiences, r.agents),
     """WITH v AS (SELECT agent_id, team, coalesce(nullif(owner, ''), name) AS owner FROM agents), live AS (SELECT * FROM experiences WHERE NOT revoked),
     o AS (SELECT owner, count(*) AS n, sum(experience_id) AS ids FROM v JOIN live e ON e.agent_id = v.agent_id GROUP BY 1), t AS (SELECT acl, count(*) AS n, sum(experience_id) AS ids FROM live GROUP BY 1)
     SELECT v.agent_id AS viewer_id, 'own' AS how, n, CAST(ids AS BIGINT) AS ids FROM v JOIN o ON o.owner = v.owner
     UNION ALL SELECT v.agent_id, 'team', n, CAST(ids AS BIGINT) FROM v JOIN t ON t.acl = 'team:' || v.team
     UNION ALL SELECT NULL, 'shared', count(*), CAST(sum(experience_id) AS BIGINT) FROM live WHERE acl IN ('public', 'org') AND publish_status = 'published'""")
_add("p7_scope", lambda r: access.row_scope(r.experiences.join(r.agents.select("agent_id", access.owner_name(F.col("owner"), F.col("name")).alias("owner")), "agent_id"), "me", "owner-7", True, r.agents.where("owner IN ('owner-8', 'owner-9')").groupBy("owner").agg((F.min("agent_id") % 2 == 0).alias("include_high"))).groupBy("scope").agg(F.count("*").alias("n"), F.sum("experience_id").alias("ids")),
     """WITH g AS (SELECT owner, min(agent_id) % 2 = 0 AS include_high FROM agents WHERE owner IN ('owner-8', 'owner-9') GROUP BY owner), e AS (SELECT e.*, coalesce(nullif(owner, ''), name) AS o FROM experiences e JOIN agents a ON a.agent_id = e.agent_id)
     SELECT CASE WHEN o = 'owner-7' THEN 'personal' WHEN g.owner IS NOT NULL AND (sensitivity <> 'high' OR include_high) THEN 'project' WHEN acl IN ('public', 'org') AND publish_status = 'published' THEN 'community' END AS scope, count(*) AS n, CAST(sum(experience_id) AS BIGINT) AS ids
     FROM e LEFT JOIN g ON g.owner = e.o GROUP BY 1""")
_add("a26_owner_quota", lambda r: access.owner_quota(r.publish_events), "SELECT owner, count(*) FILTER (action = 'publish') AS publish_count, count(*) FILTER (action = 'unpublish') AS unpublished_count, publish_count >= 3 AS unlocked, greatest(0, 3 - publish_count) AS remaining FROM publish_events GROUP BY owner")
_add("j14_cascade", lambda r: access.cascade(r.turn_rewards, r.experiences.where("revoked")).groupBy("experience_id").agg(F.count("*").alias("n")), "SELECT experience_id, count(*) AS n FROM turn_rewards WHERE experience_id NOT IN (SELECT experience_id FROM experiences WHERE revoked) GROUP BY 1")
_add("j14_revoke", lambda r: access.revoke(r.experiences, r.q_updates.select("experience_id")).groupBy("review_status", "revoked").agg(F.count("*").alias("n")),
     "SELECT CASE WHEN experience_id IN (SELECT experience_id FROM q_updates) THEN 'revoked' ELSE review_status END AS review_status, revoked OR experience_id IN (SELECT experience_id FROM q_updates) AS revoked, count(*) AS n FROM experiences GROUP BY 1, 2")
_add("r10_publish", lambda r: access.publish(r.experiences.withColumn("owner", F.col("agent_id") % 10), r.experiences.select(F.expr("experience_id + 5").alias("experience_id"), (F.col("experience_id") % 10).alias("owner")), r.turn_rewards.where("r_outcome = 1").select("experience_id")).groupBy("verdict").agg(F.count("*").alias("n"), F.sum("n_hits").alias("hits")),
     """WITH q AS (SELECT experience_id + 5 AS experience_id, experience_id % 10 AS asked_by FROM experiences), b AS (SELECT experience_id, count(*) AS n_hits FROM turn_rewards WHERE r_outcome = 1 GROUP BY 1)
     SELECT CASE WHEN e.experience_id IS NULL THEN 'not_found' WHEN agent_id % 10 <> asked_by THEN 'not_owner' WHEN revoked THEN 'revoked' WHEN acl = 'public' AND publish_status = 'published' THEN 'already_public' WHEN n_hits > 0 THEN 'strict_check' ELSE 'published' END AS verdict,
     count(*) AS n, CAST(sum(coalesce(n_hits, 0)) AS BIGINT) AS hits FROM q LEFT JOIN experiences e ON e.experience_id = q.experience_id LEFT JOIN b ON b.experience_id = q.experience_id GROUP BY 1""")

# aggregates

_add("a1_q_scalar", lambda r: aggregates.q_table(r.experiences), f"SELECT experience_id, round({_Q}, 6) AS q_scalar, round({_QS}, 6) AS q_shown FROM experiences")
_add("a2_facets", lambda r: aggregates.facet_counts(r.experiences, "review_status", "task_type", "sensitivity"),
     """SELECT NULL AS facet, NULL AS value, count(*) AS n FROM experiences UNION ALL SELECT 'review_status', review_status, count(*) FROM experiences GROUP BY 2
     UNION ALL SELECT 'task_type', task_type, count(*) FROM experiences GROUP BY 2 UNION ALL SELECT 'sensitivity', sensitivity, count(*) FROM experiences GROUP BY 2""")
_add("a3_histogram", lambda r: aggregates.histogram(r.orders, "o_totalprice"),
     """WITH e AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders), c AS (SELECT CAST(least(9, floor((o_totalprice - lo) / ((hi - lo) / 10))) AS INT) AS b, count(*) AS n FROM orders, e GROUP BY 1)
     SELECT CAST(i AS INT) AS bucket, round(lo + i * ((hi - lo) / 10), 6) AS lo, round(lo + (i + 1) * ((hi - lo) / 10), 6) AS hi, coalesce(n, 0) AS n FROM range(10) s(i) JOIN e ON true LEFT JOIN c ON b = i""")
_add("a4_nearest_rank", lambda r: aggregates.nearest_rank(r.orders, "o_totalprice", [10.0, 50.0, 90.0]),
     """WITH s AS (SELECT o_totalprice AS v, row_number() OVER (ORDER BY o_totalprice) - 1 AS i, count(*) OVER () AS n FROM orders)
     SELECT p AS percent, round(v, 6) AS value FROM s, (VALUES (10.0::DOUBLE), (50.0), (90.0)) q(p) WHERE i = round_even(p / 100 * (n - 1), 0)""")
_add("a5_q_buckets", lambda r: aggregates.q_buckets(r.experiences),
     f"WITH c AS (SELECT CAST(floor(round((greatest(-1, least(0.99, {_QS})) + 1) / 0.2, 9)) AS INT) AS b, count(*) AS n FROM experiences GROUP BY 1) SELECT round(i * 0.2::DOUBLE - 1, 1) AS bucket, coalesce(n, 0) AS n FROM range(10) s(i) LEFT JOIN c ON b = i")
_BOARD = f"""WITH f AS ({_FEEDBACK}), b AS (SELECT e.*, coalesce(event_count, 0) AS ec, coalesce(feedback_count, 0) AS fc, coalesce(used_count, 0) AS uc, coalesce(not_used_count, 0) AS nc, coalesce(positive_count, 0) AS pc, coalesce(negative_count, 0) AS gc,
  avg_reward, avg_confidence, latest_feedback_at, {_QS} AS q FROM experiences e LEFT JOIN f ON f.experience_id = e.experience_id)"""
_add("a6_reuse_leaderboard", lambda r: aggregates.reuse_leaderboard(r.experiences, r.reuse_items),
     f"""{_BOARD}, k AS (SELECT *, CASE WHEN fc > 0 THEN uc / fc ELSE 0 END AS rate FROM b WHERE NOT revoked AND NOT superseded), s AS (SELECT *, round(0.45 * rate + 0.25 * CASE WHEN fc > 0 THEN (avg_reward + 1) / 2 ELSE 0 END + 0.20 * (q + 1) / 2 + 0.10 * reuse_count / (reuse_count + 5.0), 9) AS score FROM k)
     SELECT experience_id, task_type, ec AS event_count, fc AS feedback_count, uc AS used_count, nc AS not_used_count, pc AS positive_count, gc AS negative_count, round(avg_reward, 6) AS avg_reward, round(avg_confidence, 6) AS avg_confidence, round(q, 6) AS q_scalar, round(rate, 6) AS reuse_rate, round(score, 6) AS rank_score
     FROM s ORDER BY score DESC, coalesce(latest_feedback_at, created_at) DESC, experience_id LIMIT 20""")
_add("a7_smoothed_leaderboard", lambda r: aggregates.smoothed_leaderboard(r.experiences, r.reuse_items),
     f"""{_BOARD}, k AS (SELECT *, fc / (fc + 5.0::DOUBLE) AS ev, CASE WHEN fc > 0 THEN uc / fc ELSE 0 END AS rate FROM b WHERE NOT revoked), s AS (SELECT *, round(0.45 * ev * (uc + 2.0) / (fc + 4.0) + 0.25 * ev * (fc * (coalesce(avg_reward, 0) + 1) / 2 + 2.0) / (fc + 4.0) + 0.20 * (q + 1) / 2 + 0.10 * reuse_count / (reuse_count + 5.0), 9) AS score FROM k)
     SELECT experience_id, fc AS feedback_count, uc AS used_count, reuse_count, round(rate, 6) AS reuse_rate, round(ev, 6) AS feedback_evidence, round(q, 6) AS q_scalar, round(score, 6) AS rank_score FROM s
     ORDER BY score DESC, round(rate, 9) DESC, round(coalesce(avg_reward, -2), 9) DESC, reuse_count DESC, round(q, 9) DESC, created_at DESC, experience_id LIMIT 20""")
_add("a8_reuse_totals", lambda r: aggregates.reuse_totals(r.reuse_items, r.experiences),
     """SELECT count(DISTINCT event_id) AS recall_events, count(*) AS injected_items, count(feedback_at) AS feedback_items, count(*) FILTER (was_used) AS used_items, count(*) FILTER (NOT was_used) AS not_used_items,
     count(*) FILTER (feedback_at IS NOT NULL AND reward > 0) AS positive_items, count(*) FILTER (feedback_at IS NOT NULL AND reward < 0) AS negative_items, count(*) FILTER (feedback_at IS NOT NULL AND reward = 0) AS neutral_items,
     count(DISTINCT experience_id) FILTER (feedback_at IS NOT NULL) AS experiences_touched, round(avg(reward) FILTER (feedback_at IS NOT NULL), 6) AS avg_reward, round(avg(confidence) FILTER (feedback_at IS NOT NULL), 6) AS avg_confidence, max(feedback_at) AS last_feedback_at
     FROM reuse_items WHERE experience_id IN (SELECT experience_id FROM experiences WHERE NOT revoked)""")
_add("a9_event_summaries", lambda r: aggregates.event_summaries(r.reuse_events, r.reuse_items),
     """WITH p AS (SELECT event_id, count(*) AS item_count, count(feedback_at) AS feedback_count, count(*) FILTER (was_used) AS used_count, avg(reward) FILTER (feedback_at IS NOT NULL) AS avg_reward, max(feedback_at) AS f FROM reuse_items GROUP BY 1)
     SELECT e.event_id, item_count, feedback_count, used_count, round(avg_reward, 6) AS avg_reward FROM reuse_events e JOIN p ON p.event_id = e.event_id ORDER BY coalesce(f, created_at) DESC, e.event_id LIMIT 20""")
_add("a10_feedback_timeline", lambda r: aggregates.day_counts(r.reuse_items.where("feedback_at IS NOT NULL"), "feedback_at", AS_OF, 14, {"avg_reward": F.avg("reward")}),
     f"""WITH c AS (SELECT CAST(feedback_at AS DATE) AS d, count(*) AS n, avg(reward) AS a FROM reuse_items WHERE feedback_at IS NOT NULL GROUP BY 1)
     SELECT CAST(DATE '{AS_OF}' - CAST(i AS INT) AS DATE) AS day, coalesce(n, 0) AS n, round(a, 6) AS avg_reward FROM range(14) s(i) LEFT JOIN c ON d = DATE '{AS_OF}' - CAST(i AS INT)""")
_add("a11_ingestion_days", lambda r: aggregates.day_counts(r.experiences, "created_at", AS_OF, 7),
     f"WITH c AS (SELECT CAST(created_at AS DATE) AS d, count(*) AS n FROM experiences GROUP BY 1) SELECT CAST(DATE '{AS_OF}' - CAST(i AS INT) AS DATE) AS day, coalesce(n, 0) AS n FROM range(7) s(i) LEFT JOIN c ON d = DATE '{AS_OF}' - CAST(i AS INT)")
_USAGE = "count(*) AS calls, count(*) FILTER (ok) AS ok_calls, count(*) FILTER (NOT ok) AS error_calls, CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens, CAST(sum(completion_tokens) AS BIGINT) AS completion_tokens, round(round(sum(prompt_tokens / 1e6 * 0.25 + completion_tokens / 1e6 * 1.25), 9), 4) AS cost_usd FROM usage"
_add("a12_usage", lambda r: aggregates.usage_totals(r.usage, 0.25, 1.25), f"SELECT 'total' AS level, NULL AS name, {_USAGE} UNION ALL SELECT 'kind', kind, {_USAGE} GROUP BY 2 UNION ALL SELECT 'model', model, {_USAGE} GROUP BY 2")
_add("a13_call_cost", lambda r: r.usage.select("usage_id", (F.col("prompt_tokens") * 0.25 + F.col("completion_tokens") * 1.25).alias("cost_micros")), "SELECT usage_id, prompt_tokens * 0.25::DOUBLE + completion_tokens * 1.25::DOUBLE AS cost_micros FROM usage")
_add("a14_cluster_stats", lambda r: aggregates.cluster_stats(r.clusters), "SELECT count(*) AS clusters, count(crystallized_skill_id) AS crystallized, round(avg(member_count), 2) AS avg_members, max(member_count) AS max_members FROM clusters")
_add("a15_pool_stats", lambda r: aggregates.pool_stats(r.experiences), f"SELECT agent_id, count(*) AS total, count(*) FILTER (NOT revoked) AS live, count(*) FILTER (revoked) AS revoked, count(*) FILTER ({_SHARED}) AS published FROM experiences GROUP BY 1")
_add("a15_community_stats", lambda r: aggregates.community_stats(r.experiences, AS_OF), f"SELECT count(*) AS published, count(DISTINCT agent_id) AS contributors, count(*) FILTER (created_at >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY) AS last_7_days FROM experiences WHERE {_SHARED}")
_add("a16_redaction_total", lambda r: aggregates.redaction_total(r.audits), "SELECT CAST(sum(CAST(payload->>'$.k' AS BIGINT)) AS BIGINT) AS redactions FROM (SELECT payload FROM audits ORDER BY created_at DESC, audit_id DESC LIMIT 500)")
_add("a17_turn_reward_summary", lambda r: aggregates.turn_reward_summary(r.turn_rewards),
     f"""SELECT experience_id, count(*) AS n, {', '.join(f'round(round(avg(r_{d}), 9), 3) AS r_{d}' for d in DIMS)}, CAST(round(CAST(round(0.35 * avg(r_outcome) + 0.20 * avg(r_intent) + 0.20 * avg(r_execution) + 0.10 * avg(r_orchestration) + 0.15 * avg(r_expression), 9) AS DECIMAL(18, 9)), 3) AS DOUBLE) AS score,
     round(round(avg(confidence), 9), 3) AS confidence, array_to_string(list_sort(list(DISTINCT judge_model)), ',') AS judges FROM turn_rewards GROUP BY 1""")
_add("a18_trajectory_scores", lambda r: aggregates.trajectory_scores(r.experiences, r.turn_rewards),
     """WITH l AS (SELECT experience_id, arg_max(judge_model, (annotated_at, judge_model)) AS j FROM turn_rewards GROUP BY 1), m AS (SELECT t.experience_id, count(*) AS n, 0.40 * avg(r_outcome) + 0.20 * avg(r_intent) + 0.15 * avg(r_execution) + 0.10 * avg(r_orchestration) + 0.15 * avg(r_expression) AS s
       FROM turn_rewards t JOIN l ON l.experience_id = t.experience_id AND j = judge_model GROUP BY 1),
     k AS (SELECT e.experience_id, n, greatest(-1, least(1, CAST(round(CAST(round(CASE WHEN n IS NOT NULL AND structural_score IS NOT NULL THEN 0.6 * s + 0.4 * structural_score WHEN n IS NOT NULL THEN s ELSE coalesce(structural_score, 0) END, 9) AS DECIMAL(18, 9)), 3) AS DOUBLE))) AS v FROM experiences e LEFT JOIN m ON m.experience_id = e.experience_id)
     SELECT experience_id, v AS trajectory_score, v >= 0 AS is_memory_eligible, v >= 0.4 AS is_sft_eligible, coalesce(n, 0) AS n_turn_rewards FROM k""")
_add("a19_judge_shots", lambda r: aggregates.judge_shots(r.rewards).select("experience_id", *(f"r_{d}" for d in DIMS), "confidence", "variance", "shots"),
     f"""SELECT experience_id, {', '.join(f'round(greatest(-1, least(1, quantile_cont(r_{d}, 0.5))), 6) AS r_{d}' for d in DIMS)}, round(quantile_cont(confidence, 0.5), 6) AS confidence,
     round(({' + '.join(f'coalesce(var_samp(r_{d}), 0)' for d in DIMS)}) / 5, 6) AS variance, count(*) AS shots FROM rewards GROUP BY 1""")
_add("a21_judge_drift", lambda r: aggregates.judge_drift(windows.latest(r.rewards, ["experience_id"], "created_at", "reward_id"), r.experiences.select("experience_id", *(F.col(f"q_{d}").alias(f"r_{d}") for d in DIMS))),
     f"""WITH l AS (SELECT *, row_number() OVER (PARTITION BY experience_id ORDER BY created_at DESC, reward_id DESC) AS rn FROM rewards), d AS (SELECT count(*) AS n_items, {', '.join(f'avg(abs(e.q_{d} - l.r_{d})) AS {d}' for d in DIMS)} FROM l JOIN experiences e ON e.experience_id = l.experience_id WHERE rn = 1)
     SELECT n_items, {', '.join(f'round({d}, 6) AS {d}' for d in DIMS)}, round(({' + '.join(DIMS)}) / 5, 6) AS overall, ({' + '.join(DIMS)}) / 5 > 0.15 AS triggered FROM d""")
_add("a23_contributors", lambda r: aggregates.contributors(r.agents, r.experiences), f"SELECT a.agent_id, team, experiences, last_active FROM agents a JOIN (SELECT agent_id, count(*) AS experiences, max(created_at) AS last_active FROM experiences WHERE {_SHARED} GROUP BY 1) e ON e.agent_id = a.agent_id ORDER BY experiences DESC, last_active DESC, a.agent_id LIMIT 10")
_add("a25_skill_stats", lambda r: aggregates.skill_stats(r.skills), "SELECT review_status, count(*) AS n, CAST(sum(invoke_count) AS BIGINT) AS invocations FROM skills GROUP BY 1")

# joins and windows

_DIMS_R = ", ".join(f"r_{d}" for d in DIMS)
_add("j1_latest_reward", lambda r: windows.with_latest_reward(r.experiences.select("experience_id"), r.rewards).select("experience_id", "reward_id", *(f"r_{d}" for d in DIMS)),
     f"SELECT e.experience_id, reward_id, {_DIMS_R} FROM experiences e LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY experience_id ORDER BY created_at DESC, reward_id DESC) AS rn FROM rewards) l ON l.experience_id = e.experience_id AND rn = 1")
_add("j2_parents_updates", lambda r: windows.with_parents_and_updates(r.experiences, r.edges, r.q_updates).select("experience_id", F.array_join(F.transform("parent_ids", lambda x: x.cast("string")), ",").alias("parents"), "n_updates"),
     """WITH p AS (SELECT child_id, array_to_string(list_sort(list(DISTINCT parent_id)), ',') AS ids FROM edges GROUP BY 1), u AS (SELECT experience_id, count(*) AS n FROM q_updates GROUP BY 1)
     SELECT e.experience_id, coalesce(ids, '') AS parents, coalesce(n, q_update_count) AS n_updates FROM experiences e LEFT JOIN p ON child_id = e.experience_id LEFT JOIN u ON u.experience_id = e.experience_id""")
_add("j3_without_chunks", lambda r: windows.without_chunks(r.experiences, r.chunks).select("experience_id"), "SELECT experience_id FROM experiences WHERE experience_id NOT IN (SELECT experience_id FROM chunks)")
_add("j4_stale_chunks", lambda r: windows.stale_chunks(r.chunks, r.experiences), "SELECT experience_id, count(*) AS n_chunks FROM chunks WHERE experience_id NOT IN (SELECT experience_id FROM experiences WHERE review_status IN ('approved', 'auto_approved', 'edited') AND extraction_status = 'done' AND NOT revoked) GROUP BY 1")
_add("j6_recent_sessions", lambda r: windows.recent_sessions(r.experiences, 40),
     """WITH e AS (SELECT *, coalesce(nullif(parent_session_id, ''), nullif(session_id, ''), CAST(experience_id AS VARCHAR)) AS group_id FROM experiences WHERE NOT revoked),
     g AS (SELECT agent_id, group_id, min(created_at) AS started_at, max(created_at) AS ended_at FROM e GROUP BY 1, 2 ORDER BY ended_at DESC, agent_id, group_id LIMIT 40)
     SELECT e.agent_id, e.group_id, experience_id, started_at, ended_at, CAST(row_number() OVER (PARTITION BY e.agent_id, e.group_id ORDER BY coalesce(source_byte_start, 9223372036854775807), created_at, experience_id) - 1 AS INT) AS seg_index,
     count(*) OVER (PARTITION BY e.agent_id, e.group_id) AS total_segments FROM e JOIN g ON g.agent_id = e.agent_id AND g.group_id = e.group_id""")
_add("j7_visible_clusters", lambda r: windows.visible_clusters(r.clusters, r.membership, r.experiences.where("NOT revoked OR experience_id > 40")),
     """SELECT cluster_id, CASE WHEN seen = member_count THEN label END AS label, seen AS member_count, CASE WHEN seen = member_count THEN crystallized_skill_id END AS crystallized_skill_id
     FROM (SELECT c.*, s.seen FROM clusters c JOIN (SELECT cluster_id, count(*) AS seen FROM membership WHERE experience_id IN (SELECT experience_id FROM experiences WHERE NOT revoked OR experience_id > 40) GROUP BY 1) s ON s.cluster_id = c.cluster_id)""")
_add("j9_resolve_skills", lambda r: windows.resolve_skills(r.skill_uses, r.skills),
     """WITH d AS (SELECT experience_id, split_part(declared, '@', 1) AS name, CASE WHEN contains(declared, '@') THEN split_part(declared, '@', 2) END AS version FROM skill_uses),
     l AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY created_at DESC, skill_id DESC) AS rn FROM skills),
     u AS (SELECT experience_id, skill_id FROM d JOIN skills s ON s.name = d.name AND s.version = d.version UNION ALL SELECT experience_id, skill_id FROM d JOIN l ON l.name = d.name AND rn = 1 WHERE d.version IS NULL)
     SELECT skill_id, count(*) AS invocations, count(DISTINCT experience_id) AS experiences FROM u GROUP BY 1""")
_add("j12_lacking_rewards", lambda r: windows.lacking_rewards(r.experiences, r.turn_rewards, "judge-1"), "SELECT experience_id FROM experiences WHERE experience_id NOT IN (SELECT experience_id FROM turn_rewards WHERE judge_model = 'judge-1')")
_add("n2_collapse_sessions", lambda r: windows.collapse_sessions(r.experiences),
     "SELECT experience_id, agent_id, session_id, session_id <> '' AND row_number() OVER (PARTITION BY agent_id, session_id ORDER BY turn_count DESC, created_at DESC, experience_id DESC) > 1 AS superseded FROM experiences")
_add("n3_last_units", lambda r: windows.last_units(r.chunks, 3, 2, 0.3).select("experience_id", "chunk_id"),
     "SELECT experience_id, chunk_id FROM (SELECT *, row_number() OVER (PARTITION BY experience_id ORDER BY turn_start DESC, chunk_id) AS rn FROM chunks WHERE turn_count >= 2 AND turn_start >= 0.3 * greatest(turn_count - 1, 1)) WHERE rn <= 3")
_add("n4_timeline_sample", lambda r: windows.sample_timeline(r.conversations.withColumn("hot", F.length("text") % 5 == 0), ["conv_id"], "turn", "hot", 4).select("conv_id", "turn"))
_add("n5_n6_turn_pairs", lambda r: windows.pick_pairs(windows.turn_pairs(r.conversations), 2),
     """WITH c AS (SELECT *, max(CASE WHEN role = 'user' AND trim(text) <> '' THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS user_turn FROM conversations),
     p AS (SELECT conv_id, user_turn, min(turn) AS assistant_turn FROM c WHERE role = 'assistant' AND user_turn IS NOT NULL GROUP BY 1, 2), n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY user_turn) - 1 AS i, count(*) OVER (PARTITION BY conv_id) AS k FROM p)
     SELECT conv_id, user_turn, assistant_turn FROM n WHERE k <= 2 OR i IN (0, k - 1)""")
_add("n7_following_text", lambda r: windows.following_text(windows.turn_pairs(r.conversations), r.conversations, 2, 80),
     """WITH c AS (SELECT *, max(CASE WHEN role = 'user' AND trim(text) <> '' THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS user_turn FROM conversations),
     p AS (SELECT conv_id, user_turn, min(turn) AS assistant_turn FROM c WHERE role = 'assistant' AND user_turn IS NOT NULL GROUP BY 1, 2),
     l AS (SELECT p.conv_id, p.user_turn, t.turn, CASE t.role WHEN 'user' THEN 'User: ' ELSE 'Assistant: ' END || left(t.text, 80) AS line, row_number() OVER (PARTITION BY p.conv_id, p.user_turn ORDER BY t.turn) AS rn FROM p JOIN conversations t ON t.conv_id = p.conv_id AND t.turn > assistant_turn AND t.role IN ('user', 'assistant'))
     SELECT p.conv_id, p.user_turn, p.assistant_turn, coalesce(x, '') AS following FROM p LEFT JOIN (SELECT conv_id, user_turn, string_agg(line, chr(10) || chr(10) ORDER BY rn) AS x FROM l WHERE rn <= 2 GROUP BY 1, 2) y ON y.conv_id = p.conv_id AND y.user_turn = p.user_turn""")
_add("n9_z_scores", lambda r: windows.z_scores(r.orders.select("o_orderkey", "o_orderpriority", "o_totalprice"), "o_orderpriority", "o_totalprice"),
     "SELECT o_orderkey, o_orderpriority, round(o_totalprice, 6) AS o_totalprice, round((o_totalprice - avg(o_totalprice) OVER w) / stddev_pop(o_totalprice) OVER w, 6) AS o_totalprice_z FROM orders WINDOW w AS (PARTITION BY o_orderpriority)")
_add("u3_equivalent_chunks", lambda r: ranking.equivalent_chunks(r.chunks).groupBy("chunk_id").agg(F.max("peers").alias("peers")),
     """WITH s AS (SELECT action_signature, count(*) AS n FROM chunks WHERE action_signature <> '' GROUP BY 1), t AS (SELECT chunk_type, search_text, count(*) AS n FROM chunks GROUP BY 1, 2), b AS (SELECT action_signature, chunk_type, search_text, count(*) AS n FROM chunks WHERE action_signature <> '' GROUP BY 1, 2, 3)
     SELECT chunk_id, max(coalesce(s.n, 0) + t.n - coalesce(b.n, 0)) AS peers FROM chunks c LEFT JOIN s ON s.action_signature = c.action_signature JOIN t ON t.chunk_type = c.chunk_type AND t.search_text = c.search_text LEFT JOIN b ON b.action_signature = c.action_signature AND b.chunk_type = c.chunk_type AND b.search_text = c.search_text GROUP BY 1""")

# text, embeddings, search

_add("x1_embeddings", lambda r: embedding.sparse_embeddings(r.conversations.select(F.expr("conv_id * 1000 + turn").alias("id"), "text"), "id", "text"),
     """WITH t AS (SELECT conv_id * 1000 + turn AS id, lower(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) AS s FROM conversations), n AS (SELECT id, CASE WHEN s = '' THEN '<empty>' ELSE rpad(s, greatest(3, length(s)::INT), ' ') END AS s FROM t),
     g AS (SELECT id, sha256(s[i:i + 2]) AS h FROM n, unnest(range(1, length(s) - 1)) u(i)), w AS (SELECT id, CAST(('0x' || h[1:2]) AS INT) AS idx, CASE WHEN CAST(('0x' || h[10:10]) AS INT) % 2 = 1 THEN 1 ELSE -1 END AS sign FROM g)
     SELECT id, idx, CAST(sum(sign) AS BIGINT) AS weight FROM w GROUP BY 1, 2 HAVING sum(sign) <> 0""")
_add("x17_fingerprints", lambda r: turns.fingerprints(r.conversations), "SELECT conv_id, left(sha256(string_agg(role || chr(0) || text || chr(1), '' ORDER BY turn)), 16) AS fingerprint FROM conversations GROUP BY 1")
_add("x4_bm25", lambda r: search.bm25(r.benchmark.select(F.col("item_id").alias("query_id"), "text"), r.documents, 20).select("query_id", "doc_id", "rank", "score"),
     """WITH q AS (SELECT DISTINCT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[a-z0-9一-鿿]{2,}')) AS term FROM benchmark), d AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9一-鿿]{2,}') AS ts FROM documents),
     a AS (SELECT count(*) AS n, avg(len(ts)) AS avg_len FROM d), t AS (SELECT doc_id, len(ts) AS len, unnest(ts) AS term FROM d), p AS (SELECT term, doc_id, any_value(len) AS len, count(*) AS tf FROM t WHERE term IN (SELECT term FROM q) GROUP BY 1, 2), f AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
     s AS (SELECT query_id, doc_id, round(sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg_len))), 6) AS score FROM q JOIN p ON p.term = q.term JOIN f ON f.term = q.term, a GROUP BY 1, 2)
     SELECT query_id, doc_id, CAST(rank AS INT) AS rank, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 20""")
_add("k1_vector_top_k", lambda r: search.vector_top_k(r.embeddings.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")), r.embeddings.select(F.col("vec_id").alias("experience_id"), F.col("embedding").alias("vector")), 10, skip_self=True),
     """WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), s AS (SELECT q.vec_id AS query_id, r.vec_id AS experience_id, round(list_inner_product(q.v, r.v) / sqrt(list_inner_product(q.v, q.v)) / sqrt(list_inner_product(r.v, r.v)), 9) AS s FROM e q, e r WHERE q.vec_id % 100 = 0 AND q.vec_id <> r.vec_id),
     k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, experience_id) AS rank FROM s) SELECT query_id, experience_id, round(s, 6) AS similarity, CAST(rank AS INT) AS rank FROM k WHERE rank <= 10""")
_add("t17_mixed_scores", lambda r: ranking.top_k(ranking.mixed_scores(r.experiences.select(F.col("task_type").alias("query_id"), "experience_id", F.col("structural_score").alias("similarity"), scores.weighted().alias("q"), "visit_count").where("similarity IS NOT NULL")).withColumn("score", F.round("score", 6)), "query_id", 20, F.desc("score"), "experience_id").select("query_id", "experience_id", "score", "rank"),
     f"""WITH c AS (SELECT task_type, experience_id, structural_score AS s, {_Q} AS q, visit_count AS v FROM experiences WHERE structural_score IS NOT NULL), z AS (SELECT task_type AS query_id, experience_id, round(0.55 * (s - avg(s) OVER w) / stddev_pop(s) OVER w + 0.35 * (q - avg(q) OVER w) / stddev_pop(q) OVER w + 0.1 * sqrt(ln(sum(v) OVER w + 1) / greatest(v, 1)), 6) AS score FROM c WINDOW w AS (PARTITION BY task_type))
     SELECT * FROM (SELECT query_id, experience_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, experience_id) AS INT) AS rank FROM z) WHERE rank <= 20""")
_add("t17_hybrid_search", lambda r: _hybrid(r), None)
_add("t25_retrieval_metrics", lambda r: ranking.retrieval_metrics(*_eval(r), (1, 5, 10)), None)

_add("p11_query_signal", lambda r: r.conversations.select("conv_id", "turn", tx.has_signal(F.col("text")).alias("signal"), tx.outcome(F.col("text")).alias("outcome"), tx.title(F.col("text")).alias("title"), tx.bad_title(F.col("text")).alias("bad")), None)
_add("x18_chunk_ids", lambda r: r.conversations.select("conv_id", "turn", tx.chunk_id(F.col("conv_id"), F.col("turn"), F.col("role"), F.col("text")).alias("chunk_id"), tx.token_estimate(F.col("text")).alias("tokens")),
     "SELECT conv_id, turn, 'chk_' || sha1(encode(conv_id || '') || '\\x00'::BLOB || encode(turn || '') || '\\x00'::BLOB || encode(role) || '\\x00'::BLOB || encode(text))[1:24] AS chunk_id, CAST(greatest(1, length(text) // 4) AS INT) AS tokens FROM conversations")
_add("x6_x8_lexical", lambda r: _lexical(r), None)
_add("x22_clip", lambda r: r.conversations.select("conv_id", "turn", turns.head_tail_clip(F.col("text"), 100, "<cut>").alias("clipped")), "SELECT conv_id, turn, CASE WHEN length(text) <= 100 THEN text ELSE left(text, 70) || '<cut>' || right(text, 30) END AS clipped FROM conversations")

# redaction

_add("r1_redact", lambda r: _redacted(r).select("doc_id", F.sha2(F.col("text"), 256).alias("text_sha256"), F.array_join(F.array_sort(F.transform(F.map_entries("redactions"), lambda x: F.concat(x["key"], F.lit(":"), x["value"].cast("string")))), ",").alias("counts"), "is_high"), None)
_add("r2_r6_review_flags", lambda r: redaction.review_flags(r.documents, "doc_id", "text"), None)
_RE2 = {"absolute_system_path": r"(?:^|[^\w/])(?:/(?:etc|var|opt|tmp|private|System|Library|Applications)/[^\s'\":]+)"}
_sql = lambda text: text.replace(chr(39), chr(39) * 2)
_add("r9_strict_check", lambda r: redaction.strict_hits(r.notes, "note_id", "text"),
     " UNION ALL ".join(f"SELECT note_id, '{n}' AS rule, CAST(len(regexp_extract_all(text, '{_sql(_RE2.get(n, p))}')) AS BIGINT) AS n FROM notes WHERE regexp_matches(text, '{_sql(_RE2.get(n, p))}')" for n, p in STRICT_RULES))
_add("r9_strict_findings", lambda r: redaction.strict_findings(r.notes.select("note_id", F.array(F.struct(F.lit("run").alias("name"), F.col("text").alias("input"))).alias("calls")), "note_id", ["calls"]).groupBy("note_id", "rule", "location").agg(F.count("*").alias("n"), F.max(F.length("preview")).cast("long").alias("longest")),
     " UNION ALL ".join(f"SELECT note_id, '{n}' AS rule, 'calls[0].input' AS location, CAST(len(regexp_extract_all(text, '{_sql(p)}')) AS BIGINT) AS n, CAST(list_max(list_transform(regexp_extract_all(text, '{_sql(p)}'), lambda x: least(120, length(x)))) AS BIGINT) AS longest FROM notes WHERE regexp_matches(text, '{_sql(p)}')"
                        for n, p in ((n, _RE2.get(n, p).replace(r"(?:^|[^\w/])", "")) for n, p in STRICT_RULES)))
_SIMPLE = [x for x in REDACTION_RULES if x[0] in ("email", "ipv4", "aws_access_key", "github_token", "home_path")]
_add("r1_simple_rules", lambda r: redaction.redact(r.documents, "text", _SIMPLE, prefixes=()).select("doc_id", F.md5("text").alias("text_md5"), "is_high"),
     "WITH " + ", ".join(f"t{i} AS (SELECT doc_id, high OR ({'true' if x[3] == 'high' else 'false'} AND regexp_matches(text, '{x[1].replace(chr(39), chr(39) * 2)}')) AS high, regexp_replace(text, '{x[1].replace(chr(39), chr(39) * 2)}', '{x[2]}', 'g') AS text FROM {f't{i - 1}' if i else '(SELECT doc_id, false AS high, text FROM documents)'})" for i, x in enumerate(_SIMPLE))
     + f" SELECT doc_id, md5(text) AS text_md5, high AS is_high FROM t{len(_SIMPLE) - 1}")
_add("a22_redaction_audit", lambda r: redaction.audit(_redacted(r), "doc_id")[0], None)

# turns

_add("t1_structural_metrics", lambda r: turns.structural_metrics(r.conversations).select("conv_id", "turn_count", "user_turn_count", "assistant_turn_count", "self_correction_count", "avg_assistant_chars", "max_assistant_chars", "completion_signal", "structural_score"),
     f"""WITH t AS (SELECT *, left(lower(text), 600) AS h FROM conversations), f AS (SELECT *, role = 'assistant' AND ({' OR '.join(f"contains(h, '{p.replace(chr(39), chr(39) * 2)}')" for p in turns.SELF_CORRECTION)}) AS again, role = 'assistant' AND ({' OR '.join(f"contains(h, '{p}')" for p in turns.COMPLETION)}) AS done FROM t),
     m AS (SELECT conv_id, count(*) FILTER (role = 'user') AS u, count(*) FILTER (role = 'assistant') AS a, count(*) FILTER (again) AS sc, round(coalesce(avg(length(text)) FILTER (role = 'assistant'), 0), 1) AS av, coalesce(max(length(text)) FILTER (role = 'assistant'), 0) AS mx, bool_or(done) AS done FROM f GROUP BY 1)
     SELECT conv_id, u + a AS turn_count, u AS user_turn_count, a AS assistant_turn_count, sc AS self_correction_count, av AS avg_assistant_chars, CAST(mx AS INT) AS max_assistant_chars, done AS completion_signal,
     round(CASE WHEN done THEN 0.4 ELSE 0 END - least(0.3, sc / greatest(a, 1) * 0.6) - CASE WHEN a = 0 THEN 0.5 ELSE 0 END, 3) AS structural_score FROM m""")
_add("t2_rule_cards", lambda r: turns.rule_cards(r.conversations).select("conv_id", "query", "intent", F.array_join("steps", "|").alias("steps"), "outcome"),
     """WITH t AS (SELECT *, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS s FROM conversations), f AS (SELECT conv_id, arg_min(s, turn) FILTER (role = 'user') AS q, arg_max(s, turn) FILTER (role = 'assistant') AS o, string_agg(left(s, 280), '|' ORDER BY turn) FILTER (role = 'assistant') AS steps FROM t WHERE s <> '' GROUP BY 1)
     SELECT conv_id, coalesce(q, '(no user turn)') AS query, trim(coalesce(left(q, 120), 'unspecified task')) AS intent, coalesce(steps, '') AS steps, coalesce(left(o, 500), '(no assistant turn)') AS outcome FROM f""")
_add("t3_last_request_cards", lambda r: turns.last_request_cards(r.conversations).select("conv_id", "query", F.array_join("steps", "|").alias("steps")),
     """WITH t AS (SELECT *, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS s FROM conversations), f AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS rn FROM t WHERE s <> '')
     SELECT conv_id, coalesce(arg_max(s, turn) FILTER (role = 'user'), '(no user turn)') AS query, coalesce(string_agg(left(s, 280), '|' ORDER BY turn) FILTER (role = 'assistant' AND rn <= 8), '') AS steps FROM f GROUP BY 1""")
_add("t7_segments", lambda r: turns.segments(r.conversations).select("conv_id", "segment", "turn_start", "turn_end", F.sha2("context", 256).alias("context"), F.array_join("work", "|").alias("work")),
     """WITH t AS (SELECT *, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS s FROM conversations), g AS (SELECT *, sum(CASE WHEN role = 'user' AND length(s) > 3 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS segment FROM t WHERE s <> ''),
     b AS (SELECT conv_id, segment, min(turn) AS turn_start, max(turn) AS turn_end, sha256(arg_min(s, turn)) AS context FROM g WHERE segment > 0 GROUP BY 1, 2),
     d AS (SELECT conv_id, segment, left(s, 120) AS w, min(turn) AS first FROM g WHERE segment > 0 AND role = 'assistant' GROUP BY 1, 2, 3), e AS (SELECT *, row_number() OVER (PARTITION BY conv_id, segment ORDER BY first) AS rn FROM d),
     w AS (SELECT conv_id, segment, string_agg(w, '|' ORDER BY first) AS work FROM e WHERE rn <= 8 GROUP BY 1, 2)
     SELECT b.conv_id, CAST(b.segment AS BIGINT) AS segment, turn_start, turn_end, context, coalesce(work, '') AS work FROM b LEFT JOIN w ON w.conv_id = b.conv_id AND w.segment = b.segment""")
_add("t11_exact_dedup", lambda r: turns.first_by_fingerprint(r.documents.select(F.col("doc_id").alias("experience_id"), F.col("source").alias("agent_id"), F.col("doc_id").alias("created_at"), F.sha2("text", 256).alias("fingerprint"))),
     "SELECT doc_id AS experience_id, min(doc_id) OVER (PARTITION BY source, text) AS kept_id FROM documents")
_add("x24_digest", lambda r: turns.digest(r.conversations, budget=1500).select("conv_id", F.length("digest").cast("long").alias("length"), "left_out"),
     """WITH t AS (SELECT *, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS s FROM conversations), l AS (SELECT *, length('[' || role || '] ' || left(s, 600)) AS n FROM t WHERE s <> ''), u AS (SELECT *, sum(n + 1) OVER (PARTITION BY conv_id ORDER BY turn) AS used FROM l)
     SELECT conv_id, CAST(coalesce(sum(n + 1) FILTER (used <= 1500) - 1, 0) + CASE WHEN count(*) FILTER (used > 1500) > 0 THEN 12 ELSE 0 END AS BIGINT) AS length, count(*) FILTER (used > 1500) AS left_out FROM u GROUP BY 1""")

# credit, feedback, clusters

_FOLD = ", ".join(f"CAST(round(CAST(round(q_{d} * coalesce(keep, 1) + coalesce(g_{d}, 0), 9) AS DECIMAL(18, 9)), 6) AS DOUBLE) AS q_{d}" for d in DIMS)
_GAINS = ", ".join(f"sum(e * r_{d} * rest) AS g_{d}" for d in DIMS)
_add("t14_credit", lambda r: _rounded(credit.apply_credit(r.experiences, r.edges, r.rewards), 9),
     f"""WITH l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY experience_id ORDER BY created_at DESC, reward_id DESC) AS rn FROM rewards) WHERE rn = 1),
     v AS (SELECT parent_id, child_id, d.created_at, 0.2 * confidence AS e, {', '.join(f'l.r_{d}' for d in DIMS)} FROM edges d JOIN l ON l.experience_id = child_id WHERE NOT credit_applied),
     w AS (SELECT *, exp(coalesce(sum(ln(1 - e)) OVER (PARTITION BY parent_id ORDER BY created_at, child_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0)) AS rest FROM v), t AS (SELECT parent_id, count(*) AS n, exp(sum(ln(1 - e))) AS keep, {_GAINS} FROM w GROUP BY 1)
     SELECT x.experience_id, {_FOLD}, coalesce(n, 0) AS updates FROM experiences x LEFT JOIN t ON parent_id = x.experience_id""")
_add("t16_feedback", lambda r: _rounded(credit.apply_feedback(r.experiences, r.reuse_items), 9),
     f"""WITH i AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY event_id, experience_id, chunk_id ORDER BY feedback_at, item_id) AS rn FROM reuse_items WHERE feedback_at IS NOT NULL AND reward IS NOT NULL) WHERE rn = 1),
     c AS (SELECT event_id, experience_id, CASE WHEN reward < -1 THEN -1 WHEN reward > 1 THEN 1 ELSE reward END AS r, CASE WHEN confidence IS NULL THEN 0.35 WHEN confidence < 0 THEN 0 WHEN confidence > 1 THEN 1 ELSE confidence END AS c, was_used IS NULL OR was_used AS used, feedback_at AS seen FROM i),
     p AS (SELECT event_id, experience_id, CASE WHEN sum(c) > 0 THEN sum(r * c) / sum(c) ELSE avg(r) END AS reward, 0.2 * avg(c) AS e, bool_or(used) AS used, max(seen) AS seen FROM c GROUP BY 1, 2),
     w AS (SELECT *, reward AS r_outcome, reward AS r_intent, reward AS r_execution, reward * 0.6 AS r_orchestration, reward * 0.4 AS r_expression, exp(coalesce(sum(ln(1 - e)) OVER (PARTITION BY experience_id ORDER BY seen, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0)) AS rest FROM p),
     t AS (SELECT experience_id, count(*) AS n, count(*) FILTER (used) AS reused, exp(sum(ln(1 - e))) AS keep, {_GAINS} FROM w GROUP BY 1),
     s AS (SELECT experience_id, {', '.join(f'CASE WHEN q_update_count > 0 OR abs({_Q}) > 1e-9 THEN q_{d} ELSE greatest(-1, least(1, trajectory_score)) END AS q_{d}' for d in DIMS)} FROM experiences)
     SELECT s.experience_id, {_FOLD}, n AS updates, reused FROM s JOIN t ON t.experience_id = s.experience_id""")
_add("t22_hit_counts", lambda r: credit.hit_counts(r.reuse_items), "SELECT experience_id, count(DISTINCT event_id) AS visits FROM reuse_items GROUP BY 1")
_add("t13_similar_pairs", lambda r: dedup.similar_pairs(r.embeddings, "label", "vec_id", "embedding", 0.2),
     """WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), s AS (SELECT a.vec_id AS a, b.vec_id AS b, list_inner_product(a.v, b.v) / sqrt(list_inner_product(a.v, a.v)) / sqrt(list_inner_product(b.v, b.v)) AS s FROM e a JOIN e b ON a.label = b.label AND a.vec_id < b.vec_id)
     SELECT a, b, round(s, 6) AS similarity FROM s WHERE round(s, 9) >= 0.2""")
_add("t13_merges", lambda r: dedup.merge_replay(_mergeable(r), r.embeddings.join(r.experiences.select(F.col("experience_id").alias("vec_id"), F.col("review_status").isin(*SEARCHABLE).alias("approved")), "vec_id", "left").select(F.col("vec_id").alias("experience_id"), F.lpad(F.col("vec_id").cast("string"), 12, "0").alias("arrived"), (F.col("vec_id") * 7 % 101).alias("strength"), "approved")), None)
_add("t23_leader_clusters", lambda r: dedup.leader_clusters(r.embeddings.withColumn("batch", F.floor(F.col("vec_id") / 1000)), "batch", "vec_id", "embedding", 0.2), None)
_add("t24_crystallise", lambda r: dedup.crystallise_candidates(r.clusters), "SELECT cluster_id, CASE WHEN crystallized_skill_id IS NULL THEN 'first' ELSE 'again' END AS reason FROM clusters WHERE (crystallized_skill_id IS NULL AND member_count >= 5) OR (crystallized_skill_id IS NOT NULL AND new_since_crystallize >= 3)")
_add("t24_versions", lambda r: dedup.improving_versions(r.skills.withColumn("structure_score", (F.col("skill_id") * 37 % 211).cast("double"))),
     """WITH s AS (SELECT cluster_id, skill_id, created_at, CAST(skill_id * 37 % 211 AS DOUBLE) AS x FROM skills), b AS (SELECT *, max(x) OVER (PARTITION BY cluster_id ORDER BY created_at, skill_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM s), k AS (SELECT * FROM b WHERE best IS NULL OR x > best)
     SELECT cluster_id, skill_id, x AS structure_score, CAST(row_number() OVER w AS INT) AS version, lead(skill_id) OVER w AS superseded_by FROM k WINDOW w AS (PARTITION BY cluster_id ORDER BY created_at, skill_id)""")
_add("x20_reward_classes", lambda r: r.rewards.select("reward_id", *(scores.sign_class(F.col(f"r_{d}")).alias(f"c_{d}") for d in DIMS)), f"SELECT reward_id, {', '.join(f'CAST(sign(r_{d}) AS INT) AS c_{d}' for d in DIMS)} FROM rewards")

# review and upkeep

_add("p10_retrievable_sessions", lambda r: review.retrievable_sessions(r.conversations), None)
_add("p12_p13_labels", lambda r: r.conversations.select("conv_id", "turn", review.bad_title(F.substring("text", 1, 60)).alias("bad"), review.needs_relabel(F.substring("text", 1, 120), F.col("text")).alias("relabel")), None)
_add("p14_orphans", lambda r: review.orphans(r.experiences.withColumn("trajectory_path", F.when(F.col("experience_id") % 5 != 0, F.lit("x")))).select("experience_id"), "SELECT experience_id FROM experiences WHERE experience_id % 5 = 0 AND NOT revoked")
_add("p2b_browse_skills", lambda r: review.browse_skills(r.skills, "approved", "ring", 30).select("skill_id"), "SELECT skill_id FROM skills WHERE NOT revoked AND review_status = 'approved' AND (contains(name, 'ring') OR contains(CAST(skill_id AS VARCHAR), 'ring')) ORDER BY created_at DESC, skill_id LIMIT 30")
_RUNS = "SELECT l_orderkey AS experience_id, CASE WHEN l_linenumber % 2 = 0 THEN 'A' ELSE 'B' END AS run, max(l_partkey % 5) AS n_steps, max(l_suppkey % 5) AS n_tools, count(*) AS n_decisions, max(l_linenumber) AS n_pitfalls, max(l_discount) AS confidence FROM lineitem GROUP BY 1, 2"
_add("a20_extraction_pairs", lambda r: review.pick_extraction(r.lineitem.groupBy(F.col("l_orderkey").alias("experience_id"), F.when(F.col("l_linenumber") % 2 == 0, "A").otherwise("B").alias("run")).agg(F.max(F.expr("l_partkey % 5")).alias("n_steps"), F.max(F.expr("l_suppkey % 5")).alias("n_tools"), F.count("*").alias("n_decisions"), F.max("l_linenumber").alias("n_pitfalls"), F.max("l_discount").alias("confidence"))),
     f"""WITH x AS ({_RUNS}), p AS (SELECT coalesce(a.experience_id, b.experience_id) AS experience_id, a.confidence AS ca, b.confidence AS cb, abs(a.n_steps - b.n_steps) + abs(a.n_tools - b.n_tools) + abs(a.n_decisions - b.n_decisions) + abs(a.n_pitfalls - b.n_pitfalls) AS gap,
     greatest(a.n_steps, b.n_steps) + greatest(a.n_tools, b.n_tools) + greatest(a.n_decisions, b.n_decisions) + greatest(a.n_pitfalls, b.n_pitfalls) AS most FROM (SELECT * FROM x WHERE run = 'A') a FULL JOIN (SELECT * FROM x WHERE run = 'B') b ON a.experience_id = b.experience_id),
     d AS (SELECT *, CASE WHEN ca IS NOT NULL AND cb IS NOT NULL THEN gap / greatest(most, 1) ELSE 0 END AS div FROM p)
     SELECT experience_id, CASE WHEN cb IS NULL OR ca >= cb THEN 'A' ELSE 'B' END AS chosen, round(div, 6) AS divergence, CASE WHEN ca IS NOT NULL AND cb IS NOT NULL AND div >= 0.5 THEN 'unstable' ELSE 'done' END AS status FROM d""")
_add("a27_pool_counts", lambda r: review.pool_counts({n: getattr(r, n) for n in ("agents", "experiences", "edges", "skills")}), "SELECT 'agents' AS \"table\", count(*) AS n FROM agents UNION ALL SELECT 'experiences', count(*) FROM experiences UNION ALL SELECT 'edges', count(*) FROM edges UNION ALL SELECT 'skills', count(*) FROM skills")
_add("j8_cluster_members", lambda r: review.cluster_members(r.membership.withColumn("similarity", (F.expr("(experience_id * 31 + cluster_id) % 1000") / 1000)), r.experiences).where("nth <= 5").select("cluster_id", "experience_id", "similarity", "nth"),
     "SELECT cluster_id, experience_id, round(s, 6) AS similarity, CAST(nth AS INT) AS nth FROM (SELECT cluster_id, m.experience_id, ((m.experience_id * 31 + cluster_id) % 1000) / 1000 AS s, row_number() OVER (PARTITION BY cluster_id ORDER BY ((m.experience_id * 31 + cluster_id) % 1000) DESC, m.experience_id) AS nth FROM membership m JOIN experiences e ON e.experience_id = m.experience_id WHERE NOT revoked) WHERE nth <= 5")
_add("j15_all_lineage", lambda r: review.lineage(r.experiences, r.edges, r.q_updates).groupBy("experience_id", "kind").agg(F.count("*").alias("n"), F.max("at").alias("latest")),
     """WITH x AS (SELECT child_id AS experience_id, 'parent' AS kind, created_at FROM edges UNION ALL SELECT parent_id, 'child', created_at FROM edges UNION ALL SELECT experience_id, 'update', created_at FROM q_updates)
     SELECT experience_id, kind, count(*) AS n, max(created_at) AS latest FROM x WHERE experience_id IN (SELECT experience_id FROM experiences) GROUP BY 1, 2""")
_DECISIONS = """SELECT l_orderkey * 1000000 + l_partkey * 10 + l_linenumber AS decision_id, l_orderkey AS experience_id, CASE WHEN l_suppkey % 2 = 0 THEN o_custkey ELSE -1 END AS actor, CASE l_linenumber % 4 WHEN 0 THEN 'approve' WHEN 1 THEN 'reject' WHEN 2 THEN 'edit' ELSE 'soft_delete' END AS action,
  CASE WHEN l_linenumber = 6 THEN NULL ELSE concat('new ', l_partkey) END AS intent_text, l_shipdate AS decided_at FROM lineitem JOIN orders ON o_orderkey = l_orderkey"""
ROLES["decisions"] = _DECISIONS
_add("t28_decisions", lambda r: review.apply_decisions(r.experiences.withColumn("tags", F.lit(None).cast("array<string>")), r.decisions)[0].select("experience_id", "review_status", "intent_text", "q_update_count", F.size(F.coalesce("tags", F.expr("CAST(array() AS array<string>)"))).alias("n_tags")),
     """WITH o AS (SELECT d.* FROM decisions d JOIN experiences e ON e.experience_id = d.experience_id AND actor = agent_id), l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY experience_id ORDER BY decided_at DESC, decision_id DESC) AS rn FROM o) WHERE rn = 1)
     SELECT e.experience_id, CASE WHEN action = 'approve' THEN 'approved' WHEN action IN ('reject', 'soft_delete') THEN 'rejected' WHEN action = 'edit' AND l.intent_text IS NOT NULL THEN 'edited' ELSE review_status END AS review_status, CASE WHEN action = 'edit' AND l.intent_text IS NOT NULL THEN l.intent_text ELSE e.intent_text END AS intent_text,
     CASE WHEN action = 'edit' AND l.intent_text IS NOT NULL THEN 0 ELSE q_update_count END AS q_update_count, CASE WHEN action = 'soft_delete' THEN 1 ELSE 0 END AS n_tags FROM experiences e LEFT JOIN l ON l.experience_id = e.experience_id""")
_add("t29_upsert_rewards", lambda r: review.upsert_rewards(r.turn_rewards.where("turn_index > 3"), r.turn_rewards.where("turn_index <= 4").withColumn("upload_order", F.col("annotated_at")).withColumns({f"r_{d}": F.col(f"r_{d}").cast("string") for d in DIMS}), r.experiences)[0].groupBy("experience_id").agg(F.count("*").alias("n")),
     """WITH n AS (SELECT DISTINCT experience_id, turn_index, judge_model FROM turn_rewards WHERE turn_index <= 4), o AS (SELECT t.experience_id FROM turn_rewards t ANTI JOIN n ON n.experience_id = t.experience_id AND n.turn_index = t.turn_index AND n.judge_model = t.judge_model WHERE t.turn_index > 3)
     SELECT experience_id, count(*) AS n FROM (SELECT experience_id FROM n UNION ALL SELECT experience_id FROM o) GROUP BY 1""")

# streams

_add("m6_daily_counts", lambda r: jobs.run_to_table(jobs.daily_counts(_stream(r, "orders"), "o_orderdate")), "SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS n FROM orders GROUP BY 1")
_add("m6_trailing_week", lambda r: jobs.run_to_table(jobs.trailing_week(_stream(r, "orders"), "o_orderdate")),
     "WITH d AS (SELECT CAST(o_orderdate AS DATE) AS d, count(*) AS n FROM orders GROUP BY 1) SELECT CAST(d + CAST(i AS INT) AS DATE) AS last_day, CAST(sum(n) AS BIGINT) AS n FROM d, range(7) s(i) GROUP BY 1")

_SESSION_COLUMNS = ("agent_id", "session_id", "experience_id", "turn_count", "created_at")
_add("m3_session_upserts", lambda r: jobs.run_to_table(jobs.session_upserts(_stream_role(r, "experiences", "orders").where("session_id <> ''").select(*(F.col(c).cast("int").alias(c) if c == "turn_count" else F.col(c) for c in _SESSION_COLUMNS))), "append", ["agent_id", "session_id"]),
     """SELECT agent_id, session_id, experience_id, CAST(turn_count AS INT) AS turn_count FROM (SELECT *, row_number() OVER (PARTITION BY agent_id, session_id ORDER BY turn_count DESC, created_at, experience_id) AS rn FROM experiences WHERE session_id <> '') WHERE rn = 1""")
_add("m5_online_q", lambda r: _rounded(jobs.run_to_table(jobs.online_q(_stream_role(r, "rewards", "lineitem")), "update", ["experience_id"]), 9),
     f"""WITH v AS (SELECT *, 0.2 * confidence AS e FROM rewards), w AS (SELECT *, exp(coalesce(sum(ln(1 - e)) OVER (PARTITION BY experience_id ORDER BY created_at, reward_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0)) AS rest FROM v)
     SELECT experience_id, {', '.join(f'CAST(round(CAST(round(sum(e * r_{d} * rest), 9) AS DECIMAL(18, 9)), 6) AS DOUBLE) AS q_{d}' for d in DIMS)}, CAST(count(*) AS INT) AS updates FROM w GROUP BY 1""")
_add("m7_agent_sessions", lambda r: jobs.run_to_table(jobs.agent_sessions(_stream(r, "events").select(F.col("user_id").alias("agent_id"), F.col("ts").alias("created_at")), gap="6 hours")),
     """WITH g AS (SELECT user_id AS agent_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM (SELECT * FROM events)),
     s AS (SELECT *, sum(new) OVER (PARTITION BY agent_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
     SELECT agent_id, min(ts) AS started_at, max(ts) + INTERVAL 6 HOUR AS ended_at, count(*) AS segments FROM s GROUP BY agent_id, k""")

# units, chunks, recall

_add("t8_experience_units", lambda r: units.experience_units(_tool_turns(r)).groupBy("session_id", "status").agg(F.count("*").alias("n")), None)
_add("t9_chunks", lambda r: _chunks(r).select("session_id", "chunk_type", "chunk_id", "tokens"), None)
_add("t6_compaction", lambda r: units.compact(r.conversations.select(F.col("conv_id").cast("string").alias("session_id"), "turn", "role", "text"), 1500, (("assistant", 400), ("user", 300))).groupBy("session_id").agg(F.sum(F.length("text")).alias("chars")), None)
_add("t12_x12_clean_turns", lambda r: r.conversations.select("conv_id", "turn", F.sha2(units.clean_turn(F.col("text")), 256).alias("sha")), None)
_add("t20_recall", lambda r: _recall(r), None)
_add("t18_acl_search", lambda r: recall.acl_search(_similar(r, r.experiences.where(_SHARED).select(F.col("experience_id").alias("doc_id"))).withColumnRenamed("doc_id", "experience_id"), r.experiences.where(_SHARED), 5).select("query_id", "experience_id", "rank"), None)
_add("t19_lite_search", lambda r: recall.lite_search(*_vectors(r), r.experiences.withColumn("owner", F.concat(F.lit("o"), F.col("agent_id") % 4)), "o1", "BUILDING", True, 8).select("query_id", "experience_id", "stage", "rank"), None)

_add("x10_keywords", lambda r: terms.keywords(r.conversations.withColumn("id", F.expr("conv_id * 1000 + turn")), "id", "text", 8), None)
_add("x7_query_terms", lambda r: terms.query_terms(r.benchmark.select(F.col("item_id").alias("query_id"), "text")).select("query_id", F.array_join("terms", " ").alias("terms")), None)
_add("x5_keyword_signal", lambda r: terms.keyword_signal(terms.query_terms(r.benchmark.select(F.col("item_id").alias("query_id"), "text")), r.documents.select(F.col("doc_id").alias("chunk_id"), F.explode(search.tokens(F.col("text"))).alias("term")).groupBy("term", "chunk_id").agg(F.count("*").alias("score"))), None)
_add("x14_low_value", lambda r: r.conversations.select("conv_id", "turn", terms.low_value(F.when(F.col("turn") % 2 == 0, "Read").otherwise("bash"), F.concat(F.lit("command=ls "), F.substring("text", 1, 20)), F.col("text"), F.lit("unknown")).alias("low")), None)
_add("x16_retrieval_text", lambda r: _chunks(r).select("chunk_id", F.sha2(terms.retrieval_text(F.col("text")), 256).alias("sha")), None)
_add("p8_readable_skills", lambda r: terms.readable_skills(r.skills.select("skill_id", (F.col("skill_id") % 50).alias("agent_id"), F.concat(F.lit("o"), F.col("skill_id") % 9).alias("owner"), F.when(F.col("skill_id") % 5 == 0, "public").when(F.col("skill_id") % 5 == 1, "team:x").otherwise("private").alias("acl")), 7, "o3", "x").select("skill_id"),
     "SELECT skill_id FROM skills WHERE skill_id % 5 <= 1 OR skill_id % 50 = 7 OR skill_id % 9 = 3")
_add("j10_missing_dependencies", lambda r: windows.missing_dependencies(r.skills.select("skill_id", "name", F.array("name", F.concat(F.lit("Brand#"), F.col("skill_id") % 31, F.lit("-small ring"))).alias("dependencies"))),
     "WITH d AS (SELECT skill_id, concat('Brand#', skill_id % 31, '-small ring') AS name FROM skills) SELECT skill_id, name FROM d WHERE name NOT IN (SELECT name FROM skills)")
_add("j11_a24_shared_owners", lambda r: windows.visible_owners(r.customer.select((F.col("c_custkey") % 40).alias("project_id"), (F.col("c_custkey") % 90).alias("user_id")).distinct(), r.customer.select((F.col("c_custkey") % 40).alias("project_id"), F.col("c_nationkey").alias("owner"), F.when(F.col("c_acctbal") < 0, F.lit("x")).alias("revoked_at")).distinct()),
     """WITH m AS (SELECT DISTINCT c_custkey % 40 AS project_id, c_custkey % 90 AS user_id FROM customer), g AS (SELECT DISTINCT c_custkey % 40 AS project_id, c_nationkey AS owner FROM customer WHERE c_acctbal >= 0)
     SELECT user_id, count(DISTINCT owner) AS owners, count(DISTINCT m.project_id) AS projects FROM m JOIN g ON g.project_id = m.project_id GROUP BY 1""")
_add("t15_skill_credit", lambda r: _rounded(credit.fold(r.skills.select("skill_id", *(F.lit(0.0).alias(f"q_{d}") for d in DIMS)), r.lineitem.join(windows.latest(r.rewards, ["experience_id"], "created_at", "reward_id"), F.col("l_orderkey") == F.col("experience_id")).select(F.col("l_partkey").alias("skill_id"), "experience_id", "l_linenumber", "confidence", *(f"r_{d}" for d in DIMS)), "skill_id", ["experience_id", "l_linenumber"]), 9),
     f"""WITH l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY experience_id ORDER BY created_at DESC, reward_id DESC) AS rn FROM rewards) WHERE rn = 1), v AS (SELECT l_partkey, experience_id, l_linenumber, 0.2 * confidence AS e, {', '.join(f'l.r_{d}' for d in DIMS)} FROM lineitem JOIN l ON experience_id = l_orderkey),
     w AS (SELECT *, exp(coalesce(sum(ln(1 - e)) OVER (PARTITION BY l_partkey ORDER BY experience_id, l_linenumber ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0)) AS rest FROM v), t AS (SELECT l_partkey, count(*) AS n, exp(sum(ln(1 - e))) AS keep, {_GAINS} FROM w GROUP BY 1),
     x AS (SELECT skill_id, {', '.join(f'0.0::DOUBLE AS q_{d}' for d in DIMS)} FROM skills) SELECT x.skill_id, {_FOLD}, coalesce(n, 0) AS updates FROM x LEFT JOIN t ON l_partkey = x.skill_id""")
_add("r8_spliced_spans", lambda r: redaction.splice(r.conversations.select("conv_id", "turn", "text", F.expr("array(named_struct('start', 2, 'end', 6, 'label', 'name'), named_struct('start', 8, 'end', 9, 'label', IF(turn % 2 = 0, 'secret', 'date')))").alias("spans")), "text", "spans").select("conv_id", "turn", "text", "is_high"),
     "SELECT conv_id, turn, CASE WHEN length(text) >= 9 THEN text[1:2] || '<NAME>' || text[7:8] || CASE WHEN turn % 2 = 0 THEN '<SECRET>' ELSE '<DATE>' END || text[10:] WHEN length(text) >= 6 THEN text[1:2] || '<NAME>' || text[7:] ELSE text END AS text, turn % 2 = 0 AS is_high FROM conversations")


# upkeep

_add("t27_labelling_work", lambda r: upkeep.labelling_work(r.experiences, r.turn_rewards, judge="judge-1"),
     "SELECT experience_id, created_at, false AS annotated FROM experiences e WHERE NOT EXISTS (SELECT 1 FROM turn_rewards t WHERE t.experience_id = e.experience_id AND judge_model = 'judge-1') ORDER BY created_at DESC, experience_id LIMIT 100")
_add("t27_all_work", lambda r: upkeep.labelling_work(r.experiences, r.turn_rewards, "all", "judge-1", 500),
     "SELECT experience_id, created_at, experience_id IN (SELECT experience_id FROM turn_rewards WHERE judge_model = 'judge-1') AS annotated FROM experiences ORDER BY created_at DESC, experience_id LIMIT 500")


def _hits(r: _Roles) -> DataFrame:
    return r.reuse_items.select("event_id", (F.col("event_id") % 7).alias("viewer_id"), F.concat(F.lit("q"), "event_id").alias("query"), "experience_id", (F.col("chunk_id") % 2).alias("chunk_id"), F.col("chunk_id").alias("rank"), F.col("reward").alias("score"), F.col("confidence").alias("similarity"), "item_id")


_add("t22_search_log", lambda r: upkeep.hit_logs(_hits(r))[0],
     "SELECT experience_id, event_id % 7 AS queried_by, concat('q', event_id) AS query_text, chunk_id - 1 AS rank, confidence AS similarity, reward AS score FROM reuse_items")
_add("t22_reuse_items", lambda r: upkeep.hit_logs(_hits(r))[1],
     """SELECT event_id, experience_id, CAST(c AS VARCHAR) AS chunk_id, rank, score, similarity FROM (SELECT event_id, experience_id, chunk_id % 2 AS c, chunk_id AS rank, coalesce(reward, 0) AS score, coalesce(confidence, 0) AS similarity,
     row_number() OVER (PARTITION BY event_id, experience_id, chunk_id % 2 ORDER BY chunk_id DESC, reward DESC, confidence DESC) AS rn FROM reuse_items) WHERE rn = 1""")
_add("j9b_skill_usage", lambda r: upkeep.skill_usage(upkeep.skill_links(r.skill_uses, r.skills), r.experiences.where(_SHARED), r.skills),
     f"""WITH d AS (SELECT DISTINCT experience_id, split_part(declared, '@', 1) AS name, CASE WHEN contains(declared, '@') THEN split_part(declared, '@', 2) END AS version FROM skill_uses),
     w AS (SELECT name, skill_id FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY created_at DESC, skill_id DESC) AS rn FROM skills) WHERE rn = 1),
     l AS (SELECT experience_id, s.skill_id FROM d JOIN skills s ON s.name = d.name AND s.version = d.version UNION SELECT experience_id, w.skill_id FROM d JOIN w ON w.name = d.name WHERE d.version IS NULL)
     SELECT s.skill_id, s.name, e.experience_id, e.task_type, e.created_at FROM l JOIN skills s ON s.skill_id = l.skill_id AND NOT s.revoked JOIN (SELECT * FROM experiences WHERE {_SHARED}) e ON e.experience_id = l.experience_id""")


def _ranked_members(r: _Roles) -> DataFrame:
    from pyspark.sql import Window as W

    return r.membership.select(F.col("cluster_id").alias("case_id"), F.col("experience_id").alias("chunk_id"), F.row_number().over(W.partitionBy("cluster_id").orderBy("experience_id")).alias("rank"))


_add("u4_without_own_chunks", lambda r: upkeep.without_own(_ranked_members(r), r.membership.where("(experience_id + cluster_id) % 3 = 0").select(F.col("cluster_id").alias("case_id"), F.col("experience_id").alias("chunk_id")), 10),
     """SELECT case_id, chunk_id, CAST(rank AS INT) AS rank FROM (SELECT cluster_id AS case_id, experience_id AS chunk_id, row_number() OVER (PARTITION BY cluster_id ORDER BY experience_id) AS rank
     FROM membership WHERE (experience_id + cluster_id) % 3 <> 0) WHERE rank <= 10""")
_add("k4_current_skills", lambda r: review.current_skills(r.skills.withColumn("superseded_by", F.when(F.col("skill_id") % 4 == 0, F.col("skill_id") + 1)), 25).select("skill_id", "structure_score"),
     "SELECT skill_id, structure_score FROM skills WHERE skill_id % 4 <> 0 ORDER BY structure_score DESC, skill_id LIMIT 25")
_add("r7_sanitisation_status", lambda r: r.experiences.select("experience_id", redaction.status(F.col("revoked"), F.col("superseded"), (F.col("experience_id") % 3).cast("int"), F.col("sensitivity")).alias("status")),
     """SELECT experience_id, CASE WHEN revoked THEN 'human_review' WHEN superseded OR (experience_id % 3 > 0 AND NOT (sensitivity = 'low' AND NOT superseded)) THEN 'flagged' ELSE 'done' END AS status FROM experiences""")


def _maintained(r: _Roles) -> DataFrame:
    fresh = F.substring(F.trim(F.regexp_replace("text", r"\s+", " ")), 1, 700)
    old = F.when(F.col("conv_id") % 4 == 0, "old").otherwise(fresh)
    chunks = r.conversations.select(
        F.concat(F.lit("c"), "conv_id", F.lit("-"), "turn").alias("chunk_id"), F.col("conv_id").alias("experience_id"), F.when(F.col("turn") % 3 == 0, "").otherwise(F.concat(F.lit("s"), F.col("turn") % 5)).alias("session_id"), "text", old.alias("search_text"),
    )
    build = lambda e: e.select(F.concat(F.lit("c"), "experience_id", F.lit("-new")).alias("chunk_id"), "experience_id", "session_id", F.col("intent_text").alias("text"), F.col("intent_text").alias("search_text"))
    return upkeep.maintain_index(chunks, r.experiences, build).select("chunk_id", "experience_id", "session_id", F.md5("search_text").alias("search_md5"), "action")


_add("t10_index_maintenance", _maintained,
     r"""WITH live AS (SELECT experience_id, session_id, intent_text FROM experiences WHERE review_status IN ('approved', 'auto_approved', 'edited') AND extraction_status = 'done' AND NOT revoked),
     c AS (SELECT concat('c', conv_id, '-', turn) AS chunk_id, conv_id AS experience_id, CASE WHEN turn % 3 = 0 THEN '' ELSE concat('s', turn % 5) END AS session_id, text, left(trim(regexp_replace(text, '\s+', ' ', 'g')), 700) AS fresh FROM conversations),
     o AS (SELECT chunk_id, c.experience_id, CASE WHEN c.session_id = '' THEN l.session_id ELSE c.session_id END AS session_id, md5(fresh) AS search_md5,
       CASE WHEN c.experience_id % 4 = 0 AND fresh <> 'old' THEN 'refreshed' WHEN c.session_id = '' AND l.session_id <> '' THEN 'provenance' ELSE 'kept' END AS action FROM c JOIN live l ON l.experience_id = c.experience_id)
     SELECT * FROM o UNION ALL SELECT concat('c', experience_id, '-new'), experience_id, session_id, md5(intent_text), 'built' FROM live WHERE experience_id NOT IN (SELECT conv_id FROM conversations)""")
_add("t3b_upload_cards", lambda r: upkeep.upload_cards(r.conversations).select("conv_id", F.md5("query").alias("query_md5"), F.md5("intent").alias("intent_md5"), F.size("steps").alias("n_steps"), F.md5(F.array_join("steps", "|")).alias("steps_md5"), F.md5("outcome").alias("outcome_md5")), None)
_PHRASE_RULES = [("retry after failure", ("error", "retry")), ("index rebuild", ("index", "rebuild"))]
_add("x11_keyphrases", lambda r: upkeep.keyphrases(terms.keywords(_turn_texts(r), "id", "text"), _turn_texts(r), "id", "text", _PHRASE_RULES, ("error", "index", "token", "model")).select("id", F.array_join("phrases", "|").alias("phrases")), None)


def _turn_texts(r: _Roles) -> DataFrame:
    return r.conversations.select(F.expr("conv_id * 1000 + turn").alias("id"), "text")


def _stream(r: _Roles, name: str) -> DataFrame:
    """The table as a stream of files. The pattern stands for one file or a folder of parts; a plain path would have to be a folder."""
    df = r.spark.readStream.schema(getattr(r, name).schema).parquet(f"{r.sf_dir}/{name}*.parquet")
    return df.select(*(F.col(c).cast("timestamp").alias(c) if t == "timestamp_ntz" else F.col(c) for c, t in df.dtypes))


def _stream_role(r: _Roles, name: str, of: str) -> DataFrame:
    """A role over one table, as a stream of that table's files."""
    rows = r.spark.sql(ROLES[name].replace(f"FROM {of}", f"FROM {{{of}}}"), **{of: _stream(r, of)})
    return rows.select(*(F.col(c).cast("double").alias(c) if t.startswith("decimal") else F.col(c) for c, t in rows.dtypes))


def _similar(r: _Roles, only: DataFrame | None = None) -> DataFrame:
    return search.bm25(r.benchmark.select(F.col("item_id").alias("query_id"), "text"), r.documents, 60, only=only)


def _tool_turns(r: _Roles) -> DataFrame:
    """Conversations as sessions with tools: every fourth turn's text is a call, the one after it its result."""
    t = F.col("turn") % 4
    calls = F.when(t == 1, F.array(F.struct(F.concat(F.lit("c"), "turn").alias("id"), F.lit("run").alias("name"), F.col("text").alias("input")))).otherwise(F.expr("CAST(array() AS array<struct<id:string,name:string,input:string>>)"))
    return r.conversations.select(
        F.col("conv_id").cast("string").alias("session_id"), F.col("turn").cast("int"), F.when(t == 1, "assistant").when(t == 2, "tool").otherwise(F.col("role")).alias("role"), "text", calls.alias("tool_calls"),
        F.when(t == 2, F.concat(F.lit("c"), F.col("turn") - 1)).alias("tool_result_for"), ((t == 2) & (F.length("text") % 3 == 0)).alias("is_error"),
    )


def _chunks(r: _Roles) -> DataFrame:
    return units.chunk_table(units.unit_chunks(units.experience_units(_tool_turns(r))), units.card_chunks(turns.rule_cards(r.conversations), "conv_id"), units.segment_chunks(turns.segments(r.conversations)))


def _recall(r: _Roles) -> DataFrame:
    """Every user turn asks, as the agent of its conversation's experience, for the searchable chunks it may read."""
    who = r.agents.select("agent_id", access.owner_name(F.col("owner"), F.col("name")).alias("owner"), "team")
    e = r.experiences.join(who, "agent_id")
    quota = access.owner_quota(r.publish_events).where("unlocked").select("owner", F.lit(1).alias("open"))
    viewers = e.join(quota, "owner", "left").select(F.col("experience_id").alias("conv_id"), F.xxhash64("owner").alias("read_owner"), F.coalesce(F.xxhash64("team"), F.lit(0)).alias("read_team"), F.coalesce("open", F.lit(0)).alias("read_shared"))
    team = access.acl_team(F.col("acl"))
    shared = (F.col("acl") == "public") & (F.col("publish_status") == "published")
    of = access.searchable(e).select(F.col("experience_id").cast("string").alias("session_id"), F.xxhash64("owner").alias("read_owner"), F.when(team.isNull(), -1).otherwise(F.xxhash64(team)).alias("read_team"), shared.cast("int").alias("read_shared"))
    chunks = _cut(_chunks(r).join(of, "session_id").select("chunk_id", F.xxhash64("chunk_id").alias("n"), F.col("session_id").alias("experience_id"), F.col("session_id").alias("session"), "chunk_type", "text", F.lit(0.5).alias("quality"), embedding.embed(F.col("text")).alias("vector"), *search.READ))
    queries = r.conversations.where("role = 'user'").join(viewers, "conv_id")
    queries = _cut(queries.select((F.col("conv_id") * 1_000_000 + F.col("turn")).alias("query_id"), "text", embedding.embed(F.col("text")).alias("vector"), *search.READ))
    near = search.vector_top_k(queries, chunks, recall.VECTOR_LIMIT, row_id="n", acl=True).join(chunks.select("n", "chunk_id"), "n")
    keyword = search.bm25(queries, chunks.select(F.col("n").alias("doc_id"), "text"), recall.FTS_LIMIT).withColumnRenamed("doc_id", "n")
    may = (F.col("v.read_owner") == F.col("c.read_owner")) | (F.col("v.read_team") == F.col("c.read_team")) | ((F.col("v.read_shared") > 0) & (F.col("c.read_shared") > 0))
    keyword = keyword.alias("k").join(queries.alias("v"), "query_id").join(chunks.alias("c"), "n").where(may).select("query_id", "n", "rank", "signal", "chunk_id")
    return recall.recall(search.hit_similarities(keyword, queries, chunks, "n"), near, queries, chunks, 5)


def _mergeable(r: _Roles) -> DataFrame:
    """Vectors of the table as intents and of documents as scripts. The table's vectors are nearly random, so that intents take 0.2."""
    scripts = r.documents.select(F.col("doc_id").alias("vec_id"), embedding.embed(F.col("text")).alias("script"))
    return dedup.mergeable_pairs(_cut(r.embeddings.join(scripts, "vec_id", "left")), "label", "vec_id", "embedding", "script", 0.2)


def _redacted(r: _Roles) -> DataFrame:
    return redaction.redact(r.documents.select("doc_id", "text"), "text")


def _lexical(r: _Roles) -> DataFrame:
    """Scores of each conversation turn against the turn before it in its conversation."""
    from pyspark.sql import Window as W

    t = r.conversations.select("conv_id", "turn", tx.tokens_udf("text").alias("terms"))
    before = F.lag("terms").over(W.partitionBy("conv_id").orderBy("turn"))
    return t.withColumn("query", before).where("query IS NOT NULL").select("conv_id", "turn", tx.lexical_score(F.col("query"), F.col("terms")).alias("score"))


def _vectors(r: _Roles) -> tuple[DataFrame, DataFrame]:
    queries = r.benchmark.select(F.col("item_id").alias("query_id"), embedding.embed(F.col("text")).alias("vector"))
    return queries, search.dealt(r.documents.select("doc_id", "text")).select(F.col("doc_id").alias("experience_id"), embedding.embed(F.col("text")).alias("vector"))


def _hybrid(r: _Roles) -> DataFrame:
    t = search.bm25(r.benchmark.select(F.col("item_id").alias("query_id"), "text"), r.documents, 200)
    return search.hybrid_search(*_vectors(r), t, access.searchable(r.experiences), 10).select("query_id", "experience_id", "score", "rank")


def _eval(r: _Roles) -> tuple[DataFrame, DataFrame]:
    hits = search.bm25(r.benchmark.select(F.col("item_id").alias("query_id"), "text"), r.documents, 20)
    truth = r.benchmark.select(F.col("item_id").alias("case_id"), F.col("text").alias("passage"))
    head = truth.select("case_id", F.explode(F.array_distinct(search.tokens(F.col("passage")))).alias("term"))
    docs = r.documents.select("doc_id", F.explode(F.array_distinct(search.tokens(F.col("text")))).alias("term"))
    share = head.join(docs, "term").groupBy("case_id", "doc_id").agg(F.count("*").alias("n")).join(head.groupBy("case_id").agg(F.count("*").alias("of")), "case_id")
    labels = share.where("n = of").select("case_id", F.col("doc_id").alias("item_id"), F.lit(1.0).alias("grade"))
    return hits.select(F.col("query_id").alias("case_id"), F.col("doc_id").alias("item_id"), "rank"), labels
