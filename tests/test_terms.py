from pyspark.sql import functions as F

from tracelake.operators import terms


def test_keywords(spark):
    df = spark.createDataFrame([(1, "Fix parse_tree in the parser. parse_tree error404; parser you C++ 数据库"), (2, None)], "id int, t string")
    got = {r["term"]: r for r in terms.keywords(df, "id", "t").collect()}
    assert got["parse_tree"]["rank"] == 2 and got["error404"]["rank"] == 1 and "the" not in got and "fix" not in got
    assert {"parse", "tree", "数据库", "数据"} <= set(got)
    assert got["parse_tree"]["score"] == 2 + 8 and got["error404"]["score"] == 1 + 6 + 4


def test_query_terms_rank_and_expand(spark):
    q = spark.createDataFrame([(1, "the parse_tree fails on deadbee abc 数据 building x"), (2, "ok")], "query_id long, text string")
    s = spark.createDataFrame([("building", "compile")], "term string, other string")
    got = {r["query_id"]: list(r["terms"]) for r in terms.query_terms(q, s).collect()}
    assert got == {1: ["parse_tree", "building", "parse", "fails", "tree", "数据", "compile"]}


def test_signal_prefers_all_terms(spark):
    q = spark.createDataFrame([(1, ["a", "b"]), (2, ["a", "z"])], "query_id long, terms array<string>")
    p = spark.createDataFrame([("a", 10, 5.0), ("b", 10, 1.0), ("a", 11, 9.0), ("b", 12, 2.0)], "term string, chunk_id long, score double")
    got = {(r["query_id"], r["chunk_id"]): r["signal"] for r in terms.keyword_signal(q, p).collect()}
    assert got == {(1, 10): 1.0, (2, 11): 1.0, (2, 10): 0.5}


def test_low_value_and_lines(spark):
    rows = [("Read", "x", "text", "unknown", True), ("Read", "x", "Error: gone", "failure", False), ("bash", 'command=git status', "", "unknown", True), ("bash", '{"command": "make all"}', "", "unknown", False), ("WebSearch", "x", "y", "success", True)]
    df = spark.createDataFrame(rows, "t string, a string, o string, s string, w boolean")
    assert all(r[0] == r[1] for r in df.select(terms.low_value(F.col("t"), F.col("a"), F.col("o"), F.col("s")), "w").collect())
    lines = [("Action: sh: run /a/b/c/d.py now", "Action: sh: run <path>/d.py now"), ("Action: Tool sh token=abc rest", "Action tool: sh"), (None, "")]
    df = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(lines)], "i int, l string")
    assert [r[0] for r in df.orderBy("i").select(terms.retrieval_line(F.col("l"))).collect()] == [w for _, w in lines]
    text = "noise\nSituation: a   b\nAction: run x\nOutcome: ok"
    df = spark.createDataFrame([(text,), ("plain  words",)], "t string")
    assert [r[0] for r in df.select(terms.retrieval_text(F.col("t"))).collect()] == ["Situation: a b Action: run x Outcome: ok", "plain words"]
