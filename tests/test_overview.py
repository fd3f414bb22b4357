from tracelake.operators import overview

E = "experience_id long, review_status string, task_type string, sensitivity string, reuse_count long, created_at timestamp, revoked boolean, acl string, extraction_status string"


def test_pages_of_an_empty_pool(spark):
    none = spark.createDataFrame([], E)
    got = {(r["section"], r["name"]): r["n"] for r in overview.dashboard(none, "2024-01-08").collect()}
    assert got == {("total", None): 0, ("last_7_days", None): 0}
    agents, audits = spark.createDataFrame([], "agent_id long, team string"), spark.createDataFrame([], "audit_id long, created_at timestamp, payload string")
    assert {(r["section"], r["n"]) for r in overview.pool_overview(none, agents, audits).collect()} == {("agents", 0), ("teams", 0), ("redactions", 0), ("searchable", 0)}
    skills = spark.createDataFrame([(1, "approved", 5, None), (2, "pending", 7, True)], "skill_id long, review_status string, invoke_count long, revoked boolean")
    assert {(r["section"], r["name"], r["n"]) for r in overview.skill_overview(skills).collect()} == {("total", None, 1), ("invocations", None, 5), ("review_status", "approved", 1), ("top_invoked", "1", 5)}


def test_audits_that_cannot_be_read(spark):
    rows = spark.createDataFrame([(1, 10, '{"a": "x"}'), (2, 11, "broken"), (3, 11, None)], "audit_id long, t long, payload string").selectExpr("audit_id", "timestamp_seconds(t) AS created_at", "payload")
    assert [(r["audit_id"], r["payload"]) for r in overview.newest_audits(rows, 3).collect()] == [(3, None), (2, None), (1, {"a": "x"})]


def test_a_pair_without_runs_failed(spark):
    e, picked = spark.createDataFrame([(1,), (2,)], "experience_id long"), spark.createDataFrame([(1, "A", "done")], "experience_id long, chosen string, status string")
    assert {(r["experience_id"], r["status"]) for r in overview.extraction_states(e, picked).collect()} == {(1, "done"), (2, "failed")}
