import json
import random

from pyspark.sql import functions as F

from tracelake.sources import line_records as lr
from tracelake.sources.sessions import read_lines


def block(rng):
    kind = rng.choice(["text", "text", "thinking", "tool_use", "tool_result", "odd", None])
    if kind is None:
        return rng.choice(["plain", 7, None])
    b = {"type": kind}
    if kind == "text":
        b["text"] = rng.choice(["hello", "  ", "", "[Request interrupted by user]", "line\nnext", "é 日"])
    elif kind == "thinking":
        b |= {"thinking": rng.choice(["hm", "", None]), "signature": "xx"}
    elif kind == "tool_use":
        b |= {"id": f"t{rng.randrange(9)}", "name": "run", "input": {"b": 1, "a": [2]}}
    elif kind == "tool_result":
        b |= {"tool_use_id": f"t{rng.randrange(9)}", "is_error": rng.random() < 0.3, "content": rng.choice(["out", "", [{"type": "text", "text": "x"}, {"type": "image"}, {"type": "text", "text": "y"}], {"k": 1}, 5, None])}
    return b


def record(rng, i):
    r = {"type": rng.choice(["user", "assistant", "summary", "system"])}
    if rng.random() < 0.8:
        r["timestamp"] = f"2024-01-01T00:{i // 60:02d}:{i % 60:02d}Z"
    if rng.random() < 0.1:
        r["version"] = rng.choice(["1.0", "1.1", ""])
    if rng.random() < 0.1:
        r["cwd"] = rng.choice(["/a", "/b", ""])
    if rng.random() < 0.95:
        r["message"] = {"content": rng.choice(["typed", " ", [block(rng) for _ in range(rng.randrange(4))], [block(rng) for _ in range(3)], None, {"x": 1}])}
        if rng.random() < 0.5:
            r["message"]["model"] = rng.choice(["m1", "m2", "<synthetic>", ""])
    return rng.choice([json.dumps(r, ensure_ascii=False)] * 12 + ["not json", "", "[1]", "5"])


def dump(x):
    return json.dumps(x, ensure_ascii=False, separators=(",", ":"), sort_keys=True)


def result_text(c):
    if isinstance(c, list):
        return "\n".join(b.get("text", "") for b in c if b.get("type") == "text")
    return c if isinstance(c, str) else dump(c)


def loop(lines):
    """Turns and facts of a session, line by line."""
    turns, facts, per_line = [], {"model": "unknown", "cwd": "", "version": "", "start": "", "end": ""}, {}
    seen = {"version": None, "cwd": None, "model": None}
    for i, raw in enumerate(lines):
        try:
            r = json.loads(raw)
        except ValueError:
            continue
        if not isinstance(r, dict):
            continue
        ts, m = r.get("timestamp", ""), r.get("message") or {}
        if ts:
            facts["start"], facts["end"] = facts["start"] or ts, ts
        for k in ("version", "cwd"):
            if r.get(k):
                facts[k] = seen[k] = r[k]
        if r["type"] == "assistant" and m.get("model") and m["model"] != "<synthetic>":
            facts["model"] = seen["model"] = m["model"]
        per_line[i] = dict(seen)
        content = m.get("content", [])
        blocks = [b for b in content if isinstance(b, dict)] if isinstance(content, list) else []
        text = "\n".join(b["text"] for b in blocks if b["type"] == "text" and b["text"].strip())
        if r["type"] == "assistant":
            turns += [(i, "assistant", lr.THOUGHT + b["thinking"], ts, [], None) for b in blocks if b["type"] == "thinking" and b["thinking"]]
            calls = [(b["id"], b["name"], dump(b["input"])) for b in blocks if b["type"] == "tool_use"]
            if text or calls:
                turns.append((i, "assistant", text, ts, calls, None))
        elif r["type"] == "user" and m.get("model") != "<synthetic>":
            if isinstance(content, str):
                turns += [(i, "user", content, ts, [], None)] if content.strip() else []
                continue
            if text and not text.startswith("[Request interrupted"):
                turns.append((i, "user", text, ts, [], None))
            turns += [(i, "tool", result_text(b["content"]), ts, [], b["tool_use_id"]) for b in blocks if b["type"] == "tool_result"]
    return turns, facts, per_line


def files(tmp_path, sizes):
    rng = random.Random(6)
    sessions = {f"s{k}": [record(rng, i) for i in range(n)] for k, n in enumerate(sizes)}
    for name, lines in sessions.items():
        (tmp_path / f"{name}.jsonl").write_text("\n".join(lines), encoding="utf-8")
    return sessions


def test_records_equal_a_loop_over_split_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(lr, "RUN", 37)
    monkeypatch.setattr(lr.numbered, "__defaults__", (37,))
    monkeypatch.setattr(lr.carried, "__defaults__", (37,))
    sessions = files(tmp_path, [900, 0, 1, 40])
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
    try:
        lines = read_lines(spark, str(tmp_path)).persist()
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 4
        got = lr.turns_with_facts(lines).orderBy("session_id", "turn").collect()
        about = {r["session_id"]: r for r in lr.nested_sessions(lines).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    for name, raw in sessions.items():
        turns, facts, per_line = loop(raw)
        own = [r for r in got if r["session_id"] == name]
        assert [(r["line"], r["role"], r["text"], r["ts"], [tuple(c) for c in r["tool_calls"]], r["tool_result_for"]) for r in own] == turns
        assert [r["turn"] for r in own] == list(range(len(turns)))
        assert [(r["version"], r["cwd"], r["model"]) for r in own] == [(per_line[t[0]]["version"], per_line[t[0]]["cwd"], per_line[t[0]]["model"]) for t in turns]
        if per_line:
            r = about[name]
            assert (r["started_at"], r["ended_at"], r["model"], r["cwd"], r["agent_version"], r["turns"]) == (facts["start"], facts["end"], facts["model"], facts["cwd"], facts["version"], len(turns))
        else:
            assert name not in about


def test_flat_records(spark):
    raw = [
        {"role": "user", "content": "hi", "ts": "1"}, {"type": "assistant", "content": [{"type": "text", "text": "a"}, {"type": "text", "text": ""}, {"type": "tool_use", "id": "q", "name": "run", "input": {"x": 1}}], "timestamp": "2"},
        {"content": [{"type": "tool_result", "tool_use_id": "q", "content": [{"type": "text", "text": "r1"}]}, {"type": "tool_result", "tool_use_id": "z", "content": {"k": 1}}, "plain"]}, {"role": "user", "content": " "}, {"role": "user"},
        {"role": "tool", "content": {"k": [1, 2]}}, {"role": "assistant", "content": [{"type": "tool_use"}]},
    ]
    lines = spark.createDataFrame([("s", i, json.dumps(r)) for i, r in enumerate(raw)] + [("s", 90, "broken"), ("t", 0, None)], "session_id string, line int, raw string")
    got = [(r["turn"], r["line"], r["role"], r["text"], r["ts"], [tuple(c) for c in r["tool_calls"]], r["tool_result_for"]) for r in lr.flat_turns(lines).orderBy("turn").collect()]
    assert got == [
        (0, 0, "user", "hi", "1", [], ""), (1, 1, "assistant", "a", "2", [("q", "run", '{"x":1}')], ""), (2, 2, "user", 'r1\n{"k":1}', "", [], "z"),
        (3, 5, "tool", '{"k":[1,2]}', "", [], ""), (4, 6, "assistant", "", "", [("", "", "{}")], ""),
    ]


def test_one_turn_a_block(spark):
    content = [{"type": "text", "text": "hello"}, {"type": "text", "text": " "}, {"type": "thinking", "thinking": "why", "signature": "s"}, {"type": "tool_use", "id": "abcdefghijklmnop", "name": "run", "input": {"é": 1}},
               {"type": "tool_result", "tool_use_id": "", "is_error": True, "content": [{"type": "text", "text": "x"}, {"type": "image"}, {"type": "other"}]}, {"type": "tool_result", "tool_use_id": "id1", "content": {"k": 1}}, {"type": "image"}, {"type": "video"}, "plain", {}]
    rows = [("s", 4, "assistant", json.dumps(content)), ("s", 1, "user", json.dumps("typed")), ("s", 2, "user", json.dumps(" ")), ("s", 3, "user", "broken"), ("s", 5, "user", None)]
    got = [(r["turn"], r["line"], r["role"], r["text"]) for r in lr.block_turns(spark.createDataFrame(rows, "session_id string, line int, role string, content string")).orderBy("turn").collect()]
    assert got == [
        (0, 1, "user", "typed"), (1, 4, "assistant", "hello"), (2, 4, "assistant", lr.THOUGHT + "why"), (3, 4, "assistant", lr.CALL + 'run  (id=abcdefghijkl)\n\n```json\n{\n  "é": 1\n}\n```'),
        (4, 4, "tool", lr.RESULT + lr.ERROR + "\n\nx\n[image]"), (5, 4, "tool", lr.RESULT + '  (id=id1)\n\n{"k": 1}'), (6, 4, "assistant", lr.PICTURE), (7, 4, "assistant", "[video]"),
    ]


def test_no_lines(spark):
    none = spark.createDataFrame([], "session_id string, line int, raw string")
    assert lr.nested_sessions(none).collect() == [] and lr.turns_with_facts(none).collect() == [] and lr.flat_turns(none).where(F.col("turn") >= 0).collect() == []
