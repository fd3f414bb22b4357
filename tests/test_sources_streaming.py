import json

import pytest
from pyspark.sql import functions as F

from tracelake.functions.constants import DIMS
from tracelake.sources import export as ex
from tracelake.sources import sessions as se
from tracelake.streaming import jobs


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_generic_documents(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"messages": [{"role": "human", "content": "hi"}, {"role": "ai", "content": [{"type": "text", "text": "ok"}, {"type": "tool_use", "id": "t1", "name": "run", "input": {"b": 1, "a": 2}}]},
                                                              {"role": "user", "content": [{"type": "tool_result", "tool_use_id": "t1", "content": "boom", "is_error": True}]}, {"role": "user", "content": " "}]}))
    (tmp_path / "b.json").write_text("not json")
    (tmp_path / "c.json").write_text(json.dumps({"runs": [{"turns": [{"role": "function", "content": "x", "tool_call_id": "q"}]}, {"request": {"body": {"messages": [{"role": "user", "content": "y"}]}}}]}))
    got = {(r["session_id"], r["turn"]): r for r in se.document_turns(se.read_documents(spark, str(tmp_path))).collect()}
    assert [got[k]["role"] for k in sorted(got)] == ["user", "assistant", "tool", "tool", "user"]
    assert got["a", 1]["tool_calls"][0]["input"] == '{"a": 2, "b": 1}' and got["a", 2]["tool_result_for"] == "t1" and got["a", 2]["is_error"]
    assert got["c", 0]["tool_result_for"] == "q"


def event(kind, **payload):
    return json.dumps({"type": kind, "payload": payload})


def log(*kinds):
    return [event("event_msg", type=k) if k.startswith("t") else event("response_item", type="message", role="user", content=[{"text": k}]) for k in kinds]


def test_event_log(spark, tmp_path):
    lines = [event("session_meta"), *log("task_started", "hello", "task_complete", "task_started", "task_started", "again", "turn_aborted", "task_started", "last"),
             event("response_item", type="function_call", call_id="c", name="sh", arguments='{"x":1}'), event("response_item", type="function_call_output", call_id="c", output='{"output":"done"}'), event("response_item", type="reasoning", summary=[{"text": "hm"}])]
    (tmp_path / "s.jsonl").write_text("\n".join(lines))
    read = se.read_lines(spark, str(tmp_path))
    turns = se.event_log_turns(read).orderBy("line").collect()
    assert [(r["role"], r["text"]) for r in turns] == [("user", "hello"), ("user", "again"), ("user", "last"), ("assistant", ""), ("tool", "done"), ("assistant", "hm")]
    tasks = se.task_spans(read).orderBy("task").collect()
    assert [(r["task"], r["status"], r["first_line"], r["last_line"]) for r in tasks] == [(1, "complete", 1, 3), (2, "superseded", 4, 4), (3, "aborted", 5, 7)]
    assert [r["status"] for r in se.task_spans(read, done=False).orderBy("task").collect()][-1] == "open"


def test_split_long_is_stable(spark):
    make = lambda n: spark.createDataFrame([("s", i, "user" if i % 2 == 0 else "assistant", f"t{i}") for i in range(n)], "session_id string, turn int, role string, text string")
    sizes = lambda n: [r["n"] for r in se.split_long(make(n), soft=4).groupBy("segment_id").agg(F.count("*").alias("n")).orderBy("segment_id").collect()]
    assert sizes(10) == [4, 4, 2] and sizes(12) == [4, 4, 4]


def test_detect_source(spark):
    raw = [('{"system": "x"}', "claude"), ('{"meta": {"entrypoint": "cli"}}', "claude"), ('{"segment_index": 2}', "cursor"), ("{}", "unknown"), (None, "unknown")]
    got = se.detect_source(spark.createDataFrame([(r,) for r, _ in raw], "raw string")).collect()
    assert [r["source"] for r in got] == [s for _, s in raw] and got[2]["lineage"] == {"segment_index": "2"}


def test_export_and_read_back(spark, tmp_path):
    df = spark.createDataFrame([("a", "t1", "2024-01-01 10:00:00"), ("b", "t1", "2024-01-02T23:30:00-05:00"), ("c", "t2", "garbage"), ("d", "t2", None)], "experience_id string, task_type string, created_at string")
    ex.export(df, str(tmp_path / "out"))
    back = ex.read_export(spark, str(tmp_path / "out"), columns=["experience_id", "task_type", "date"])
    assert sorted(rows(back)) == [("a", "t1", "2024-01-01"), ("b", "t1", "2024-01-03"), ("c", "t2", "unknown"), ("d", "t2", "unknown")]
    assert rows(ex.read_export(spark, str(tmp_path / "out"), task_type="t1", since="2024-01-02", columns=["experience_id"])) == [("b",)]
    assert "PartitionFilters: [isnotnull" in back.where("task_type = 't1'")._jdf.queryExecution().toString()
    ex.export(df, str(tmp_path / "two"), since="2024-01-02", until="2024-12-31")
    assert rows(ex.read_export(spark, str(tmp_path / "two"), columns=["experience_id"])) == [("b",)]


def test_steps_and_lists(spark):
    df = spark.createDataFrame([('[{"step": "a", "why": "b"}, "plain"]', '["x", "y"]'), ("oops", None)], "s string, l string")
    got = df.select(ex.json_steps("s").alias("s"), ex.json_list("l").alias("l")).collect()
    assert [tuple(x) for x in got[0]["s"]] == [("a", "b", ""), ("plain", "", "")] and list(got[0]["l"]) == ["x", "y"] and list(got[1]["s"]) == list(got[1]["l"]) == []


def test_graded_cases(spark, tmp_path):
    (tmp_path / "g.jsonl").write_text('# note\n{"id": "a", "query": "q1", "relevant_chunks": {"c1": 2, "c2": 0}}\n\n{"q": "q2", "relevant_experience_ids": ["e1", {"id": "e2", "relevance": 3}], "relevant_units": "u1"}\n')
    cases, labels = ex.load_cases(spark, str(tmp_path / "g.jsonl"))
    assert sorted(rows(cases)) == [("a", "q1", "gold"), ("case-4", "q2", "gold")]
    assert sorted(rows(labels)) == [("a", "chunk", "c1", 2.0), ("case-4", "chunk", "u1", 1.0), ("case-4", "experience", "e1", 1.0), ("case-4", "experience", "e2", 3.0)]
    (tmp_path / "bad.jsonl").write_text('{"query": "q"}')
    with pytest.raises(ValueError, match="line 1"):
        ex.load_cases(spark, str(tmp_path / "bad.jsonl"))


def stream(spark, path, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def run(df, spark, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return [tuple(r) for r in spark.table(name).collect()]


def batches(spark, path, schema, *parts):
    for i, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
    return stream(spark, path, schema)


def test_stateful_jobs(spark, tmp_path):
    s = batches(spark, str(tmp_path / "u"), "agent_id long, session_id string, experience_id long, turn_count int, created_at timestamp", [(1, "s", 10, 3, None), (2, "s", 11, 1, None)], [(1, "s", 12, 2, None)], [(1, "s", 13, 9, None)])
    got = run(jobs.session_upserts(s), spark, "upserts")
    assert max((n, e) for a, _, e, n in got if a == 1) == (9, 13) and (2, "s", 11, 1) in got
    t = batches(spark, str(tmp_path / "t"), "session_id string, line int, kind string", [("a", 0, "task_started"), ("a", 1, None)], [("a", 2, "task_complete"), ("a", 3, "task_started")], [("a", 4, "turn_aborted"), ("a", 5, "task_started")])
    assert sorted(r[:3] for r in run(jobs.closed_tasks(t), spark, "tasks")) == [("a", 1, "complete"), ("a", 2, "aborted")]
    fields = "experience_id long, reward_id long, created_at string, confidence double, " + ", ".join(f"r_{d} double" for d in DIMS)
    q = batches(spark, str(tmp_path / "q"), fields, [(1, 1, "a", 1.0, *[1.0] * 5)], [(1, 2, "b", 0.5, *[-1.0] * 5)])
    last = max(run(jobs.online_q(q), spark, "online", "update"), key=lambda r: r[-1])
    assert last[-1] == 2 and last[1] == pytest.approx(0.9 * 0.2 - 0.1)


def test_windows_and_duplicates(spark, tmp_path):
    from datetime import datetime

    day = lambda d, h=0: datetime(2024, 1, d, h)
    schema = "agent_id long, fingerprint string, experience_id long, created_at timestamp"
    s = batches(spark, str(tmp_path / "w"), schema, [(1, "x", 1, day(1)), (1, "x", 2, day(1, 1)), (1, "", 3, day(1, 2)), (1, None, 4, day(1, 3))], [(1, "y", 5, day(9)), (2, "x", 6, day(9))], [(1, "z", 7, day(20))])
    assert sorted(r[2] for r in run(jobs.distinct_uploads(s), spark, "distinct")) in ([1, 3, 4, 5, 6, 7], [2, 3, 4, 5, 6, 7])
    assert {str(d): n for d, n in run(jobs.daily_counts(stream(spark, str(tmp_path / "w"), schema)), spark, "daily")} == {"2024-01-01": 4, "2024-01-09": 2}
    week = {str(d): n for d, n in run(jobs.trailing_week(stream(spark, str(tmp_path / "w"), schema)), spark, "week")}
    assert week["2024-01-07"] == 4 and week["2024-01-09"] == 2
    got = run(jobs.agent_sessions(stream(spark, str(tmp_path / "w"), schema), gap="3 hours"), spark, "agents")
    assert (1, day(1), day(1, 6), 4) in got


def test_ingest_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "s1.json").write_text(json.dumps({"messages": [{"role": "user", "content": "mail bob@example.com"}, {"role": "assistant", "content": "done"}]}))
    q = jobs.ingest(jobs.read_documents(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    cards = spark.read.parquet(str(tmp_path / "out/cards")).collect()
    assert [(r["session_id"], r["query"], r["completion_signal"]) for r in cards] == [("s1", "mail <EMAIL>", True)]


def test_all_schemas_parse_and_read(spark, tmp_path):
    for name, ddl in ex.SCHEMAS.items():
        spark.createDataFrame([], ddl).write.parquet(str(tmp_path / name))
        assert ex.read_pool(spark, str(tmp_path), name).columns


def test_lines_are_numbered_over_splits(spark, tmp_path):
    lines = [f'{{"n": {i}}}' if i % 7 else "" for i in range(400)]
    (tmp_path / "a.jsonl").write_text("\n".join(lines) + "\n")
    (tmp_path / "b.jsonl").write_text("x")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "512")
    try:
        got = se.read_lines(spark, str(tmp_path))
        assert sorted((r["session_id"], r["line"], r["raw"]) for r in got.collect()) == [*(("a", i, x) for i, x in enumerate(lines) if x), ("b", 0, "x")]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
