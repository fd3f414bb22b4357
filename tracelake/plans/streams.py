"""Queries of streams that keep their state in a stored table, fed in several portions, and of the logs of Q changes."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.functions.constants import DIMS
from tracelake.operators import credit
from tracelake.operators.dedup import shared_folder
from tracelake.plans.catalog import _Q, _SESSION_COLUMNS, _stream
from tracelake.plans.registry import _add, _Roles, _rounded
from tracelake.streaming import jobs, stored

PORTIONS = 4


def _fed(r: _Roles, rows: DataFrame, order: list[str], make: Callable[[str], Callable]) -> str:
    """The folder of a stream's table and log, after the rows have arrived in portions, each with a start of the stream of its own."""
    path = f"{shared_folder(r.spark)}/tracelake/stored-{uuid.uuid4().hex}"
    for stream in stored.arrivals(rows, order, f"{path}/in", PORTIONS):
        stored.run(stream, make(path), f"{path}/checkpoint")
    return path


def _plain(df: DataFrame) -> DataFrame:
    """Without decimals and zoneless timestamps, which the stored tables do not have."""
    return df.select(*(F.col(c).cast("double").alias(c) if t.startswith("decimal") else F.col(c).cast("timestamp").alias(c) if t == "timestamp_ntz" else F.col(c) for c, t in df.dtypes))


def _sessions(r: _Roles) -> DataFrame:
    rows = _plain(r.experiences.select(*_SESSION_COLUMNS)).withColumn("turn_count", F.col("turn_count").cast("int"))
    path = _fed(r, rows, ["created_at", "experience_id"], lambda p: stored.store_sessions(stored.sessions(r.spark, f"{p}/table")))
    return stored.sessions(r.spark, f"{path}/table").read().drop("created_at")


def _uploads(r: _Roles) -> DataFrame:
    print_ = F.when(F.col("doc_id") % 10 != 0, F.md5("text"))
    rows = r.documents.select(F.col("doc_id").alias("experience_id"), F.substring("source", 4, 9).cast("long").alias("agent_id"), print_.alias("fingerprint"), F.timestamp_seconds("doc_id").alias("created_at"))
    path = _fed(r, rows, ["created_at", "experience_id"], lambda p: stored.store_uploads(stored.uploads(r.spark, f"{p}/table"), f"{p}/log"))
    kept = stored.uploads(r.spark, f"{path}/table").read().select("experience_id", F.lit(None).cast("long").alias("duplicate_of"))
    return kept.unionByName(stored.read_log(r.spark, f"{path}/log", "experience_id long, duplicate_of long"))


def _learned(r: _Roles) -> str:
    rows = _plain(r.rewards)
    return _fed(r, rows, ["created_at", "reward_id"], lambda p: stored.learn(stored.learned(r.spark, f"{p}/table"), f"{p}/log"))




def _turns(r: _Roles) -> DataFrame:
    """Conversations strung together by tens, with a task summary here and there."""
    mark = F.when(F.expr("(conv_id + turn) % 23 = 0"), F.concat("text", F.lit("\n[task-summary]: done"))).otherwise(F.col("text"))
    return r.conversations.select(F.concat(F.lit("s"), F.floor(F.col("conv_id") / 10)).alias("session_id"), F.expr("conv_id % 10 * 100 + turn").cast("int").alias("turn"), "role", mark.alias("text"), F.expr("conv_id % 10 * 100 + turn").alias("at"))


def _segments(r: _Roles) -> DataFrame:
    path = _fed(r, _turns(r), ["at", "session_id"], lambda p: stored.store_segments(stored.segments(r.spark, f"{p}/table"), 4, 2500))
    return stored.segments(r.spark, f"{path}/table").read()


def _open_lines(r: _Roles) -> DataFrame:
    kind = F.when(F.col("role") == "user", "task_started").when(F.col("role") == "assistant", F.when((F.col("conv_id") + F.col("turn")) % 3 == 0, "turn_aborted").otherwise("task_complete")).otherwise("other")
    return _stream(r, "conversations").select(F.col("conv_id").cast("string").alias("session_id"), F.col("turn").cast("int").alias("line"), kind.alias("kind"))


def _round(x: str) -> str:
    return f"CAST(round(CAST(round({x}, 9) AS DECIMAL(18, 9)), 6) AS DOUBLE)"


def _log_sql(events: str, order: str, carry: str, start: str) -> str:
    """Q before each event and what it changed, from pairs of events: ``events`` gives experience_id, e, r_* and what ``order`` and ``carry`` name, ``start`` experience_id and q_*."""
    q = ", ".join(f"s_{d} * exp(-before) + coalesce(g_{d}, 0) AS q_{d}" for d in DIMS)
    return f"""w AS (SELECT v.*, {', '.join(f's.q_{d} AS s_{d}' for d in DIMS)}, row_number() OVER o AS nth, sum(-ln(1 - e)) OVER (PARTITION BY v.experience_id ORDER BY {order} ROWS UNBOUNDED PRECEDING) AS t FROM ({events}) v JOIN ({start}) s ON s.experience_id = v.experience_id WINDOW o AS (PARTITION BY v.experience_id ORDER BY {order})),
    a AS (SELECT *, t + ln(1 - e) AS before FROM w),
    g AS (SELECT a.experience_id, a.nth, {', '.join(f'sum(p.e * p.r_{d} * exp(p.t - a.before)) AS g_{d}' for d in DIMS)} FROM a JOIN w p ON p.experience_id = a.experience_id AND p.nth < a.nth GROUP BY 1, 2),
    b AS (SELECT a.*, {q} FROM a LEFT JOIN g ON g.experience_id = a.experience_id AND g.nth = a.nth)
    SELECT experience_id, CAST(nth AS INT) AS nth, {carry}, {', '.join(f'{_round(f"q_{d}")} AS q_{d}' for d in DIMS)}, {', '.join(f'{_round(f"e * (r_{d} - q_{d})")} AS delta_{d}' for d in DIMS)} FROM b"""


def _shown(log: DataFrame, carry: str) -> DataFrame:
    return _rounded(log.select("experience_id", "nth", carry, *(f"q_{d}" for d in DIMS), *(f"delta_{d}" for d in DIMS)), 9)


_QS = ", ".join(f"q_{d}" for d in DIMS)
_RS = ", ".join(f"l.r_{d}" for d in DIMS)

_add("m2_ingest_once", _uploads,
     """WITH x AS (SELECT doc_id AS experience_id, min(CASE WHEN doc_id % 10 <> 0 THEN doc_id END) OVER (PARTITION BY source, text) AS first FROM documents)
     SELECT experience_id, CASE WHEN experience_id % 10 <> 0 AND first < experience_id THEN first END AS duplicate_of FROM x""")
_add("m3_stored_sessions", _sessions,
     "SELECT agent_id, session_id, experience_id, CAST(turn_count AS INT) AS turn_count FROM (SELECT *, row_number() OVER (PARTITION BY agent_id, session_id ORDER BY turn_count DESC, created_at, experience_id) AS rn FROM experiences WHERE session_id <> '') WHERE rn = 1")
_add("t4_growing_segments", _segments,
     """WITH RECURSIVE t AS (SELECT concat('s', conv_id // 10) AS session_id, CAST(conv_id % 10 * 100 + turn AS INT) AS turn, role = 'user' AS starts, (conv_id + turn) % 23 = 0 AS ends, CAST(strlen(text) + CASE WHEN (conv_id + turn) % 23 = 0 THEN 21 ELSE 0 END AS BIGINT) AS size FROM conversations),
     n AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY turn) AS rn FROM t),
     f(session_id, rn, turn, segment, first_turn, turns, bytes, closed) AS (
       SELECT session_id, rn, turn, 1, turn, 1, size, ends OR 1 >= 8 OR size >= 5000 FROM n WHERE rn = 1
       UNION ALL SELECT n.session_id, n.rn, n.turn, f.segment + CASE WHEN fresh THEN 1 ELSE 0 END, CASE WHEN fresh THEN n.turn ELSE f.first_turn END, CASE WHEN fresh THEN 1 ELSE f.turns + 1 END, CASE WHEN fresh THEN n.size ELSE f.bytes + n.size END,
         n.ends OR CASE WHEN fresh THEN 1 ELSE f.turns + 1 END >= 8 OR CASE WHEN fresh THEN n.size ELSE f.bytes + n.size END >= 5000
       FROM (SELECT f.*, f.closed OR (n.starts AND (f.turns >= 4 OR f.bytes >= 2500)) AS fresh FROM f JOIN n ON n.session_id = f.session_id AND n.rn = f.rn + 1) f JOIN n ON n.session_id = f.session_id AND n.rn = f.rn + 1)
     SELECT session_id, CAST(segment AS INT) AS segment, arg_max(first_turn, turn) AS first_turn, max(turn) AS last_turn, CAST(arg_max(turns, turn) AS INT) AS turns, arg_max(bytes, turn) AS bytes, arg_max(closed, turn) AS closed FROM f GROUP BY 1, 2""")
_add("m4_closed_tasks", lambda r: jobs.run_to_table(jobs.closed_tasks(_open_lines(r)), "append"),
     """WITH u AS (SELECT conv_id, turn AS first_line, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS task, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS next FROM conversations WHERE role = 'user'),
     e AS (SELECT u.conv_id, task, first_line, next, min(a.turn) AS ended FROM u LEFT JOIN conversations a ON a.conv_id = u.conv_id AND a.role = 'assistant' AND a.turn > first_line AND (next IS NULL OR a.turn < next) GROUP BY ALL)
     SELECT CAST(conv_id AS VARCHAR) AS session_id, CAST(task AS INT) AS task, CASE WHEN ended IS NULL THEN 'superseded' WHEN (conv_id + ended) % 3 = 0 THEN 'aborted' ELSE 'complete' END AS status, CAST(first_line AS INT) AS first_line, CAST(coalesce(ended, next - 1) AS INT) AS last_line
     FROM e WHERE ended IS NOT NULL OR next IS NOT NULL""")
_add("m5_stored_q", lambda r: _rounded(stored.learned(r.spark, f"{_learned(r)}/table").read(), 9),
     f"""WITH v AS (SELECT *, 0.2 * confidence AS e FROM rewards), w AS (SELECT *, exp(coalesce(sum(ln(1 - e)) OVER (PARTITION BY experience_id ORDER BY created_at, reward_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0)) AS rest FROM v)
     SELECT experience_id, {', '.join(f'{_round(f"sum(e * r_{d} * rest)")} AS q_{d}' for d in DIMS)}, count(*) AS updates FROM w GROUP BY 1""")
_add("t14_credit_log", lambda r: _shown(credit.credit_log(r.experiences, r.edges, r.rewards), "child_id"),
     "WITH l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY experience_id ORDER BY created_at DESC, reward_id DESC) AS rn FROM rewards) WHERE rn = 1), "
     + _log_sql(f"SELECT parent_id AS experience_id, child_id, d.created_at, 0.2 * confidence AS e, {_RS} FROM edges d JOIN l ON l.experience_id = child_id WHERE NOT credit_applied", "v.created_at, child_id", "child_id", f"SELECT experience_id, {_QS} FROM experiences"))
_add("t16_feedback_log", lambda r: _shown(credit.feedback_log(r.experiences, r.reuse_items), "event_id"),
     """WITH i AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY event_id, experience_id, chunk_id ORDER BY feedback_at, item_id) AS rn FROM reuse_items WHERE feedback_at IS NOT NULL AND reward IS NOT NULL) WHERE rn = 1),
     c AS (SELECT event_id, experience_id, CASE WHEN reward < -1 THEN -1 WHEN reward > 1 THEN 1 ELSE reward END AS r, CASE WHEN confidence IS NULL THEN 0.35 WHEN confidence < 0 THEN 0 WHEN confidence > 1 THEN 1 ELSE confidence END AS c, feedback_at AS seen FROM i),
     p AS (SELECT event_id, experience_id, CASE WHEN sum(c) > 0 THEN sum(r * c) / sum(c) ELSE avg(r) END AS reward, 0.2 * avg(c) AS e, max(seen) AS seen FROM c GROUP BY 1, 2), """
     + _log_sql(
         "SELECT experience_id, event_id, seen, e, reward AS r_outcome, reward AS r_intent, reward AS r_execution, reward * 0.6 AS r_orchestration, reward * 0.4 AS r_expression FROM p", "v.seen, event_id", "event_id",
         f"SELECT experience_id, {', '.join(f'CASE WHEN q_update_count > 0 OR abs({_Q}) > 1e-9 THEN q_{d} ELSE greatest(-1, least(1, trajectory_score)) END AS q_{d}' for d in DIMS)} FROM experiences"))
