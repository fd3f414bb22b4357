import pytest
from pyspark.sql import functions as F

from tracelake.functions.constants import DIMS
from tracelake.operators import recall, review, units, windows

CALLS = "session_id string, turn int, role string, text string, tool_calls array<struct<id:string,name:string,input:string>>, tool_result_for string, is_error boolean"


def test_parallel_calls_pair_by_id(spark):
    rows = [("s", 0, "user", "please build the project", [], None, False), ("s", 1, "assistant", "", [("a", "alpha", "{}"), ("b", "beta", "{}")], None, False),
            ("s", 2, "tool", "all tests passed", [], "b", False), ("s", 3, "tool", "fatal error", [], "a", False), ("s", 4, "assistant", "", [("c", "gamma", "x")], None, False),
            ("s", 5, "user", "ok", [], None, False), ("s", 6, "assistant", "", [(None, "delta", "x")], None, False), ("s", 7, "tool", "success", [], None, False)]
    got = {r["tool"]: r for r in units.experience_units(spark.createDataFrame(rows, CALLS)).collect()}
    assert {t: r["status"] for t, r in got.items()} == {"beta": "success", "alpha": "failure", "gamma": "success", "delta": "unknown"}
    assert got["delta"]["context"] == "please build the project" and got["alpha"]["turn_end"] == 3
    chunks = {r["chunk_type"]: r["text"] for r in units.unit_chunks(units.experience_units(spark.createDataFrame(rows[:4], CALLS))).collect()}
    assert "DO NOT" in chunks["dont_unit"] and "Outcome: all tests passed" in chunks["do_unit"]


def test_action_line_hides_secrets_and_paths(spark):
    df = spark.createDataFrame([('{"cmd": "cat /very/long/path/to/file.py", "token": "abc123"}',), (None,)], "p string")
    got = [r[0] for r in df.select(units.action_line(F.lit("sh"), F.col("p"))).collect()]
    assert "file.py" in got[0] and "/very" not in got[0] and "abc123" not in got[0] and got[1] == "Tool sh"


def test_clean_turn(spark):
    cases = [("<objective>do  it</objective> rest", "do it"), ("Chunk ID: 12 Output: hello", "hello"), ("x " + "A" * 700, "x [large blob omitted]"), ("You are Not logged in", ""), (None, ""), ("a", "")]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, t string")
    assert [r[0] for r in df.orderBy("i").select(units.clean_turn(F.col("t"))).collect()] == [w for _, w in cases]


def test_tasks_titles_and_relabels(spark):
    cases = [("ok", False), ("继续", False), ("v2", True), ("go", False), ("<image x>", False), ("<system-reminder>text", False), ("<system-reminder><objective>fix it</objective>", True), ("Fix the parser", True), (None, False), ("!!", False)]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, t string")
    assert [r[0] for r in df.orderBy("i").select(review.is_task(F.col("t"))).collect()] == [w for _, w in cases]
    t = spark.createDataFrame([("Let me see", True), ("Parser fix", False), ("(闲聊)", False), ("Cut off…", True), (None, True)], "l string, w boolean")
    assert all(r[0] == r[1] for r in t.select(review.bad_title(F.col("l")), "w").collect())
    i = spark.createDataFrame([("Build a parser", "Build a parser", True), ("hi there all", "x", True), ("abc", "x", True), ("Parser", "Build it", False), (None, "x", True), ("Parser", None, False)], "i string, q string, w boolean")
    assert all(r[0] == r[1] for r in i.select(review.needs_relabel(F.col("i"), F.col("q")), "w").collect())


def test_upsert_rewards(spark):
    fields = ", ".join(f"r_{d} int" for d in DIMS)
    old = spark.createDataFrame([(1, 0, "j", *[1] * 5, 0.9, "2024-01-01"), (1, 1, "j", *[1] * 5, 0.9, "2024-01-01")], f"experience_id long, turn_index int, judge_model string, {fields}, confidence double, annotated_at string")
    raw = ", ".join(f"r_{d} string" for d in DIMS)
    new = spark.createDataFrame([(1, 0, "j", *["-5"] * 5, "2", "2024-02-01", 1), (1, 0, "j", *["x"] * 5, None, "2024-02-01", 2)], f"experience_id long, turn_index int, judge_model string, {raw}, confidence string, annotated_at string, upload_order int")
    e = spark.createDataFrame([(1, 0.5), (2, 0.1)], "experience_id long, structural_score double")
    table, scores = review.upsert_rewards(old, new, e)
    assert sorted((r["turn_index"], r["r_outcome"], r["confidence"]) for r in table.collect()) == [(0, 0, 0.5), (1, 1, 0.9)]
    assert [(r["experience_id"], r["trajectory_score"]) for r in scores.collect()] == [(1, 0.5)]
    assert review.upsert_rewards(old, new, e, replace=True)[0].count() == 1


def test_compaction_stops_when_it_fits(spark):
    rows = [("s", 0, "tool", "a" * 900), ("s", 1, "tool", "b" * 900), ("s", 2, "assistant", "c" * 900)]
    out = units.compact(spark.createDataFrame(rows, "session_id string, turn int, role string, text string"), 2300, (("tool", 300), ("assistant", 300))).orderBy("turn").collect()
    assert len(out[0]["text"]) < 900 and out[1]["text"] == "b" * 900 and out[2]["text"] == "c" * 900


def test_recall_gate_and_diversity(spark):
    queries = spark.createDataFrame([(1, "parser build error")], "query_id long, text string")
    text = "Situation: parser build error\nAction: run the parser build\nOutcome: success"
    chunks = spark.createDataFrame([("c1", "e1", None, "do_unit", text, 0.5), ("c2", "e2", None, "do_unit", text, 0.4), ("c3", "e3", None, "do_unit", "cooking pasta", 0.9)], "chunk_id string, experience_id string, session string, chunk_type string, text string, quality double")
    kw = spark.createDataFrame([(1, "c1", 1, 1.0), (1, "c2", 2, 0.5)], "query_id long, chunk_id string, rank int, signal double")
    vec = spark.createDataFrame([(1, "c3", 1, 0.2)], "query_id long, chunk_id string, rank int, similarity double")
    assert [(r["chunk_id"], r["position"]) for r in recall.recall(kw, vec, queries, chunks, 5).collect()] == [("c1", 1)]


@pytest.mark.parametrize("n", [1, 2, 3, 5])
def test_pick_pairs_rounds_half_to_even(spark, n):
    for total in (1, 2, 4, 6, 7):
        df = spark.createDataFrame([(1, i, i + 1) for i in range(total)], "conv_id int, user_turn int, assistant_turn int")
        want = sorted({0} if n <= 1 and total > n else range(total) if total <= n else {0, total - 1, *(round(i * (total - 1) / (n - 1)) for i in range(n))})
        assert sorted(r["user_turn"] for r in windows.pick_pairs(df, n).collect()) == want
