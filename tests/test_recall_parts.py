import random
import re

import pytest
from pyspark.sql import functions as F

from tracelake.functions import outcomes
from tracelake.operators import recall, terms

BITS = ["<tool_use_error>", "Process exited with code 0", "process exited with code 2", "Traceback", "failed", "not found", "404", "tests passed", "200", "x200", "ok", "token", "okay", "done", "done_all", "完成", "exception", "error:", "error", "fixed works", "é", " ", "\n", "成功 失败", "import ok", "word"]


def status(text, rules):
    low = (text or "").lower()
    for verdict, kind, some in rules:
        for x in some:
            at = low[: outcomes.HEAD] if kind == "head" else low
            tests = {
                "text": x in at, "word": re.search(rf"(?<!\w){re.escape(x)}(?!\w)", at), "code": re.search(re.escape(x) + r"[1-9]", at),
                "head": re.search(rf"(?:^|\s){re.escape(x)}" + ("" if x.endswith(":") else r"(?:\s|:)"), at),
            }
            if tests[kind]:
                return verdict
    return "unknown"


def test_first_rule_that_matches_decides(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice(["bash", "Exec-Command", "exec_command", "web", None]), None if i == 0 else rng.choice(["", " ", "x"]).join(rng.choice(BITS) for _ in range(rng.randrange(4)))) for i in range(400)]
    rows += [(900, "bash", "x " * 700 + "failed: late"), (901, "web", "x " * 700 + "failed: late")]
    df = spark.createDataFrame(rows, "id int, tool string, text string")
    got = {r["id"]: r for r in df.select("id", outcomes.outcome_status(F.col("text")).alias("s"), outcomes.outcome_for_tool(F.col("tool"), F.col("text")).alias("t")).collect()}
    for i, tool, text in rows:
        assert got[i]["s"] == status(text, outcomes.TEXT_RULES), text
        shell = re.sub("[^a-z0-9_]", "", (tool or "").lower()) in outcomes.SHELLS
        assert got[i]["t"] == status(text, outcomes.SHELL_RULES if shell else outcomes.TEXT_RULES), (tool, text)


def test_preference_is_one_of_two(spark):
    rows = [("how was it fixed", "success"), ("tests failed", "failure"), ("fixed after it failed", None), ("", None), (None, None), ("unfixed", None), ("怎么修复失败", "failure"), ("成功", "success")]
    got = spark.createDataFrame([(t,) for t, _ in rows], "t string").select(outcomes.outcome_preference(F.col("t")).alias("p")).collect()
    assert [r["p"] for r in got] == [p for _, p in rows]


def test_packs_equal_a_loop(spark):
    rng = random.Random(5)
    hits = []
    for q in range(12):
        for n in range(rng.randrange(6)):
            text = rng.choice(["", "short", " two \n lines\t", "w" * 360, "w" * 361, ("many words " * 60), "x" * 358 + "  tail", "a b　c"])
            hits.append((q, n + 1, "personal", rng.choice(["do_unit", "dont_unit", "intent"]), rng.choice([None, "success", "failure"]), rng.choice([None, 0.125, 0.5]), rng.choice([0.0, 0.245, 0.999]), "experience-1", rng.choice([None, 4]), rng.choice([None, 4, 9]), text))
    schema = "query_id int, position int, source string, chunk_type string, status string, score double, similarity double, experience_id string, turn_start int, turn_end int, text string"
    df, queries = spark.createDataFrame(hits, schema).repartition(3), spark.createDataFrame([(q,) for q in range(12)], "query_id int")

    def line(h):
        use = "DO " if h[3] == "do_unit" or h[4] == "success" else "DO NOT " if h[3] == "dont_unit" or h[4] == "failure" else ""
        turns = "" if h[8] is None else f", turn={h[8]}" if h[9] in (None, h[8]) else f", turns={h[8]}-{h[9]}"
        text = " ".join(h[10].split())
        text = text if len(text) <= 360 else text[:359].rstrip() + "…"
        return f"{h[1]}. [{use}{h[2]}:{h[3]}, score={h[5] or 0:.2f}, sim={round(h[6] * 100)}%, exp={h[7][:8]}{turns}] {text}"

    for budget in (None, 0, 500, 900):
        got = {r["query_id"]: (r["pack"], r["packed"]) for r in recall.context_packs(queries, df, budget).collect()}
        for q in range(12):
            lines, used = [], 0
            for h in hits:
                if h[0] == q:
                    used += len(line(h)) + 1
                    if budget is not None and used > budget:
                        break
                    lines.append(line(h))
            want = "\n".join([recall.PACK_HEAD, *lines, recall.PACK_FOOT]) if lines else recall.PACK_NONE
            assert got[q] == (want, len(lines))


def test_scopes_are_named(spark):
    q = spark.createDataFrame([(1,)], "query_id long")
    with pytest.raises(ValueError):
        recall.scoped(q, q, "everything")
    with pytest.raises(ValueError):
        recall.scoped(q, q, "project")


def test_queries_are_widened_by_synonyms(spark):
    df = spark.createDataFrame([(1, "recall chunks fastapi"), (2, "检索"), (3, "the")], "query_id long, text string")
    got = {r["query_id"]: r["terms"] for r in terms.query_terms(df).collect()}
    assert got[1] == ["fastapi", "recall", "chunks", "召回", "检索", "切分", "子经验", "片段", "rag"] and got[2] == ["检索", "rag", "召回", "retrieval"] and 3 not in got
    assert {r["query_id"]: r["terms"] for r in terms.query_terms(df, builtin=False).collect()}[2] == ["检索"]
