"""The driver's tables in the roles of a pool. One SQL text a role, which both Spark and the checking database read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

ROLES = {
    "agents": """SELECT c_custkey AS agent_id, concat('agent-', c_custkey) AS name, c_mktsegment AS team,
        CASE WHEN c_nationkey % 5 = 0 THEN NULL ELSE concat('owner-', c_nationkey) END AS owner FROM customer""",
    "experiences": """SELECT o_orderkey AS experience_id, o_custkey AS agent_id, o_orderpriority AS task_type, o_orderdate AS created_at,
        CASE o_orderstatus WHEN 'F' THEN 'approved' WHEN 'O' THEN 'auto_approved' ELSE 'pending' END AS review_status,
        CASE WHEN o_orderkey % 11 = 0 THEN 'failed' ELSE 'done' END AS extraction_status,
        CASE WHEN o_orderkey % 4 = 0 THEN 'private' WHEN o_orderkey % 4 = 1 THEN 'public' WHEN o_orderkey % 4 = 2 THEN 'team:BUILDING' WHEN o_orderkey % 12 = 3 THEN 'org' ELSE 'weird' END AS acl,
        CASE WHEN o_orderkey % 3 = 0 THEN 'private' ELSE 'published' END AS publish_status,
        CASE WHEN o_orderkey % 7 = 0 THEN 'high' WHEN o_orderkey % 7 < 3 THEN 'medium' ELSE 'low' END AS sensitivity,
        o_orderkey % 13 = 0 AS revoked, o_orderkey % 19 = 0 AS superseded, concat('intent ', o_orderkey, ' of ', o_custkey) AS intent_text,
        CAST(CASE WHEN o_orderkey % 8 = 0 THEN 0 ELSE o_orderkey * 7 % 201 - 100 END AS DOUBLE) / 100 AS q_outcome,
        CAST(CASE WHEN o_orderkey % 8 = 0 THEN 0 ELSE o_orderkey * 11 % 201 - 100 END AS DOUBLE) / 100 AS q_intent,
        CAST(CASE WHEN o_orderkey % 8 = 0 THEN 0 ELSE o_orderkey * 13 % 201 - 100 END AS DOUBLE) / 100 AS q_execution,
        CAST(CASE WHEN o_orderkey % 8 = 0 THEN 0 ELSE o_orderkey * 17 % 201 - 100 END AS DOUBLE) / 100 AS q_orchestration,
        CAST(CASE WHEN o_orderkey % 8 = 0 THEN 0 ELSE o_orderkey * 19 % 201 - 100 END AS DOUBLE) / 100 AS q_expression,
        CAST(o_orderkey * 3 % 201 - 100 AS DOUBLE) / 100 AS trajectory_score,
        CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(o_orderkey * 23 % 201 - 100 AS DOUBLE) / 100 END AS structural_score,
        o_orderkey % 4 AS q_update_count, o_orderkey % 97 AS visit_count, o_orderkey % 23 AS reuse_count, o_orderkey % 50 AS turn_count,
        CASE WHEN o_orderkey % 10 = 0 THEN '' ELSE concat('s', o_orderkey % 3) END AS session_id, CASE WHEN o_orderkey % 6 = 0 THEN 'parent' ELSE NULL END AS parent_session_id,
        CASE WHEN o_orderkey % 6 = 1 THEN NULL ELSE o_orderkey % 1000 END AS source_byte_start FROM orders""",
    "reuse_items": """SELECT l_partkey AS event_id, l_orderkey AS experience_id, l_linenumber AS chunk_id, l_orderkey * 1000000 + l_partkey * 10 + l_linenumber AS item_id,
        CASE l_returnflag WHEN 'A' THEN true WHEN 'R' THEN false ELSE NULL END AS was_used, round((l_quantity - 25.5) / 24.5, 3) AS reward, round(1 - 5 * l_discount, 2) AS confidence,
        CASE WHEN l_linestatus = 'F' THEN l_shipdate ELSE NULL END AS feedback_at FROM lineitem""",
    "reuse_events": "SELECT p_partkey AS event_id, CAST('2001-01-01' AS TIMESTAMP) AS created_at, p_brand AS scope FROM part",
    "turn_rewards": """SELECT l_orderkey AS experience_id, l_linenumber AS turn_index, concat('judge-', l_suppkey % 3) AS judge_model, CAST(l_partkey % 3 AS INT) - 1 AS r_outcome, CAST(l_suppkey % 3 AS INT) - 1 AS r_intent,
        CAST((l_partkey + l_suppkey) % 3 AS INT) - 1 AS r_execution, CAST(l_linenumber % 3 AS INT) - 1 AS r_orchestration, CAST(l_orderkey % 3 AS INT) - 1 AS r_expression,
        round(1 - 5 * l_discount, 2) AS confidence, l_shipdate AS annotated_at FROM lineitem""",
    "rewards": """SELECT l_orderkey AS experience_id, l_orderkey * 1000000 + l_partkey * 10 + l_linenumber AS reward_id, l_shipdate AS created_at, round(1 - 5 * l_discount, 2) AS confidence,
        CAST(l_partkey % 21 - 10 AS DOUBLE) / 10 AS r_outcome, CAST(l_suppkey % 21 - 10 AS DOUBLE) / 10 AS r_intent, CAST(l_linenumber % 21 - 3 AS DOUBLE) / 10 AS r_execution,
        CAST((l_partkey + 3) % 21 - 10 AS DOUBLE) / 10 AS r_orchestration, CAST((l_suppkey + 5) % 21 - 10 AS DOUBLE) / 10 AS r_expression FROM lineitem""",
    "edges": """SELECT l_partkey AS parent_id, l_orderkey AS child_id, min(l_shipdate) AS created_at, min(l_linenumber) = 7 AS credit_applied FROM lineitem WHERE l_partkey <> l_orderkey GROUP BY l_partkey, l_orderkey""",
    "q_updates": "SELECT event_id AS update_id, user_id AS experience_id, ts AS created_at FROM events WHERE event_type = 'click'",
    "usage": """SELECT event_id AS usage_id, event_type AS kind, concat('m', user_id % 4) AS model, CAST(floor(value * 100) AS BIGINT) AS prompt_tokens, user_id AS completion_tokens, event_type <> 'error' AS ok, ts AS created_at FROM events""",
    "clusters": """SELECT s_suppkey AS cluster_id, s_name AS label, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE s_suppkey END AS crystallized_skill_id, s_suppkey % 7 AS new_since_crystallize, n AS member_count
        FROM supplier JOIN (SELECT l_suppkey, count(DISTINCT l_orderkey) AS n FROM lineitem GROUP BY l_suppkey) m ON l_suppkey = s_suppkey""",
    "membership": "SELECT DISTINCT l_suppkey AS cluster_id, l_orderkey AS experience_id FROM lineitem",
    "skills": """SELECT p_partkey AS skill_id, concat(p_brand, '-', p_name) AS name, CAST(p_size AS STRING) AS version, p_partkey % 41 AS invoke_count, p_partkey % 7 AS install_count, CASE WHEN p_size % 3 = 0 THEN 'pending' ELSE 'approved' END AS review_status,
        p_retailprice AS created_at, p_size % 5 = 0 AS revoked, p_partkey % 30 AS cluster_id, p_retailprice AS structure_score FROM part""",
    "skill_uses": "SELECT l_orderkey AS experience_id, CASE WHEN l_linenumber % 2 = 0 THEN concat(p_brand, '-', p_name, '@', CAST(p_size AS STRING)) WHEN l_linenumber = 5 THEN 'nobody' ELSE concat(p_brand, '-', p_name) END AS declared FROM lineitem JOIN part ON l_partkey = p_partkey",
    "chunks": "SELECT l_orderkey + l_suppkey * 7 AS experience_id, l_orderkey * 1000000 + l_partkey * 10 + l_linenumber AS chunk_id, l_linenumber AS turn_start, 7 AS turn_count, l_returnflag AS chunk_type, l_partkey AS search_text, CASE WHEN l_suppkey % 4 = 0 THEN '' ELSE concat('a', l_suppkey) END AS action_signature FROM lineitem",
    "publish_events": "SELECT concat('owner-', o_custkey) AS owner, CASE WHEN o_orderkey % 4 = 0 THEN 'unpublish' ELSE 'publish' END AS action FROM orders",
    "notes": """SELECT conv_id * 1000 + turn AS note_id, concat(text, CASE turn % 12 WHEN 0 THEN ' file:///srv/share/a.txt ' WHEN 1 THEN ' https://localhost:8080/x and http://127.0.0.1/y ' WHEN 2 THEN ' http://192.168.1.20/admin ' WHEN 3 THEN ' see /etc/hosts and /var/log/syslog '
        WHEN 4 THEN concat(' C:', chr(92), 'Users', chr(92), 'someone', chr(92), 'notes.txt ') WHEN 5 THEN ' 123e4567-e89b-12d3-a456-426614174000 ' WHEN 6 THEN ' vscode-file://x/y chrome-extension://abcdef/p.html ' ELSE '' END) AS text FROM conversations""",
    "audits": "SELECT event_id AS audit_id, ts AS created_at, props AS payload FROM events",
}


def role(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = ROLES[name]
    words = set(sql.replace(",", " ").replace("(", " ").replace(")", " ").split())
    used = [t for t in TABLES if t in words]
    for t in used:
        sql = sql.replace(f"FROM {t}", f"FROM {{{t}}}").replace(f"JOIN {t}", f"JOIN {{{t}}}")
    return spark.sql(sql, **{t: table(spark, sf_dir, t) for t in used})


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_roles(body: str) -> str:
    """``body`` for the checking database, with the roles it names in front."""
    found: list[str] = []
    for name in ROLES:
        if name in body.replace("(", " ").replace(")", " ").replace(",", " ").split():
            found.append(f"{name} AS ({ROLES[name]})")
    head, sep, rest = body.strip().partition("WITH ")
    if head == "" and rest.startswith("RECURSIVE "):
        return f"WITH RECURSIVE {', '.join([*found, rest.removeprefix('RECURSIVE ')])}"
    if head == "" and sep:
        return f"WITH {', '.join(found)}, {rest}" if found else body
    return f"WITH {', '.join(found)} {body}" if found else body
