"""Readers of session logs: every format becomes turns (session_id, turn, role, text, tool_calls, tool_result_for, is_error).

Lines are JSON. Fields that may hold several shapes are taken as strings and parsed by shape; unreadable ones give null, never an error.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

TURNS = "session_id string, turn int, role string, text string, tool_calls array<struct<id:string,name:string,input:string>>, tool_result_for string, is_error boolean"

# Where a message list may stand, and other names of the roles.
LIST_KEYS = ("trajectory", "messages", "turns", "history", "conversation", "chat_history", "events")
ROLES = {"human": "user", "ai": "assistant", "bot": "assistant", "agent": "assistant", "function": "tool"}


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """One JSON document a file: ``(session_id, raw)``."""
    return spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+?)(\.[^./]*)?$", 1).alias("session_id"), F.col("value").alias("raw"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines in order: ``(session_id, line, raw)``. Lines of one file are numbered by their place in the file, blank ones too.

    Large files are read in splits: lines are numbered within a split, and splits start where the lines before them end, so no file is one task's or one string.
    """
    name = F.regexp_extract("_metadata.file_path", r"([^/]+?)(\.[^./]*)?$", 1)
    rows = spark.read.option("lineSep", "\n").text(path).select(name.alias("session_id"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("i"), F.col("value").alias("raw"))
    before = W.partitionBy("file").orderBy("split").rowsBetween(W.unboundedPreceding, -1)
    starts = rows.groupBy("file", "split").agg(F.count("*").alias("n")).select("file", "split", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    nth = F.row_number().over(W.partitionBy("file", "split").orderBy("i")) - 1
    return rows.withColumn("nth", nth).join(starts, ["file", "split"]).where(F.trim("raw") != "").select("session_id", (F.col("start") + F.col("nth")).cast("int").alias("line"), "raw")


def _role(value: object) -> str:
    r = str(value or "").lower()
    return ROLES.get(r, r if r in ("user", "assistant", "system", "tool") else "user")


def _messages(doc: object) -> list:
    if isinstance(doc, list):
        return doc
    if not isinstance(doc, dict):
        return []
    for k in LIST_KEYS:
        if isinstance(doc.get(k), list):
            return doc[k]
    body = doc.get("request", {}).get("body", {}) if isinstance(doc.get("request"), dict) else {}
    if isinstance(body, dict) and isinstance(body.get("messages"), list):
        return body["messages"]
    return [m for run in doc.get("runs", []) if isinstance(run, dict) for m in _messages(run)] if isinstance(doc.get("runs"), list) else []


def _text(value: object) -> str:
    if value is None:
        return ""
    return value if isinstance(value, str) else json.dumps(value, ensure_ascii=False, sort_keys=True)


def _call(call: dict) -> dict:
    f = call.get("function") if isinstance(call.get("function"), dict) else {}
    return {"id": _text(call.get("id")) or None, "name": _text(f.get("name") or call.get("name")) or None, "input": _text(f.get("arguments") or call.get("input"))}


def message_turns(message: object) -> list[dict]:
    """The turns of one message: tool results of a block list become turns of their own."""
    if not isinstance(message, dict):
        return []
    role, content = _role(message.get("role") or message.get("type")), message.get("content", message.get("text"))
    calls = [_call(c) for c in message.get("tool_calls") or [] if isinstance(c, dict)]
    parts: list[str] = []
    results: list[dict] = []
    if isinstance(content, list):
        for b in content:
            kind = b.get("type") if isinstance(b, dict) else None
            if isinstance(b, str):
                parts.append(b)
            elif kind in ("text", "input_text", "output_text"):
                parts.append(_text(b.get("text")))
            elif kind == "thinking":
                parts.append(_text(b.get("thinking")))
            elif kind == "tool_use":
                calls.append(_call(b))
            elif kind == "tool_result":
                inner = b.get("content")
                inner = "\n".join(_text(x.get("text") if isinstance(x, dict) else x) for x in inner) if isinstance(inner, list) else _text(inner)
                results.append({"role": "tool", "text": inner, "tool_calls": [], "tool_result_for": _text(b.get("tool_use_id")) or None, "is_error": bool(b.get("is_error"))})
    else:
        parts.append(_text(content))
    text = "\n".join(p for p in parts if p)
    own = {"role": role, "text": text, "tool_calls": calls, "tool_result_for": _text(message.get("tool_call_id") or message.get("tool_result_for")) or None, "is_error": False}
    return ([own] if text.strip() or calls else []) + [r for r in results if r["text"].strip()]


def _flatten(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        out = []
        for session, raw in zip(frame["session_id"], frame["raw"], strict=True):
            try:
                doc = json.loads(raw) if raw else None
            except ValueError:
                doc = None
            turns = [t for m in _messages(doc) for t in message_turns(m)]
            out += [{"session_id": session, "turn": i, **t} for i, t in enumerate(turns)]
        yield pd.DataFrame(out, columns=["session_id", "turn", "role", "text", "tool_calls", "tool_result_for", "is_error"])


def document_turns(documents: DataFrame) -> DataFrame:
    """Turns of documents in any of the known layouts; what cannot be read has none."""
    return documents.select("session_id", "raw").mapInPandas(_flatten, TURNS)


def event_log_turns(lines: DataFrame) -> DataFrame:
    """Turns of an event log: messages, reasoning, function calls and their outputs, one each; other records are left out."""
    p = lambda path: F.get_json_object("raw", f"$.payload.{path}")
    kind = p("type")
    content = F.array_join(F.transform(F.from_json(p("content"), "array<struct<text:string>>"), lambda b: F.coalesce(b["text"], F.lit(""))), "\n")
    summary = F.array_join(F.transform(F.from_json(p("summary"), "array<struct<text:string>>"), lambda b: F.coalesce(b["text"], F.lit(""))), "\n")
    output = F.coalesce(F.get_json_object(p("output"), "$.output"), p("output"))
    call = F.array(F.struct(p("call_id").alias("id"), p("name").alias("name"), F.coalesce(p("arguments"), p("input")).alias("input")))
    is_call, is_out = kind.isin("function_call", "custom_tool_call"), kind.isin("function_call_output", "custom_tool_call_output")
    rows = lines.where(F.get_json_object("raw", "$.type") == "response_item").select(
        "session_id", "line", F.when(kind == "message", p("role")).when(is_out, "tool").when(is_call | (kind == "reasoning"), "assistant").alias("role"),
        F.when(kind == "message", content).when(kind == "reasoning", summary).when(is_out, output).otherwise("").alias("text"),
        F.when(is_call, call).otherwise(F.expr("CAST(array() AS array<struct<id:string,name:string,input:string>>)")).alias("tool_calls"), F.when(is_out, p("call_id")).alias("tool_result_for"),
        F.lit(False).alias("is_error"),
    )
    return rows.where(F.col("role").isNotNull() & ((F.trim("text") != "") | (F.size("tool_calls") > 0)))


def task_spans(lines: DataFrame, done: bool = True) -> DataFrame:
    """Tasks of an event log: task number by running count of starts, status by its first end, superseded if another starts first, open at the end of the log.

    ``done``: leave the unfinished last task out, to be read with the next batch.
    """
    from pyspark.sql import Window as W

    kind = F.get_json_object("raw", "$.payload.type")
    event = F.get_json_object("raw", "$.type") == "event_msg"
    w = W.partitionBy("session_id").orderBy("line")
    x = lines.select("session_id", "line", F.when(event & kind.isin("task_started", "task_complete", "turn_aborted"), kind).alias("kind"))
    x = x.withColumn("task", F.sum(F.when(F.col("kind") == "task_started", 1).otherwise(0)).over(w)).where("task > 0")
    ends = F.col("kind").isin("task_complete", "turn_aborted")
    tasks = x.groupBy("session_id", "task").agg(F.min("line").alias("first_line"), F.max("line").alias("last_line"), F.min_by(F.when(ends, F.col("kind")), F.when(ends, F.col("line"))).alias("end"), F.min(F.when(ends, F.col("line"))).alias("end_line"))
    last = F.col("task") == F.max("task").over(W.partitionBy("session_id"))
    status = F.when(F.col("end") == "task_complete", "complete").when(F.col("end") == "turn_aborted", "aborted").when(last, "open").otherwise("superseded")
    out = tasks.withColumn("status", status).select("session_id", "task", "status", "first_line", F.coalesce("end_line", "last_line").alias("last_line"))
    return out.where("status <> 'open'") if done else out


#: A turn that closes its segment.
SUMMARY_LINE = r"(?im)^\s*\[task-summary\]\s*[:：]"
SEGMENT_STATE = "session_id string, segment int, first_turn int, last_turn int, turns int, bytes long, closed boolean"


def segment_turns(turns: DataFrame, stored: DataFrame | None = None, soft: int = 240, soft_bytes: int = 4 << 20) -> DataFrame:
    """The segment of each turn, with what its segment holds up to it: the columns of ``SEGMENT_STATE`` with ``last_turn`` for the turn.

    A new segment begins before a request worth keeping once the current has ``soft`` turns or ``soft_bytes``, after a turn with a task summary, and after twice those limits. ``stored`` has
    the last segment of sessions that go on (``SEGMENT_STATE``); their new turns continue it, so a session may come in any number of parts. A task reads its
    sessions turn by turn, sorted by Spark, and holds nothing but the current segment's numbers.
    """
    from tracelake.operators.review import is_task

    text = F.coalesce("text", F.lit(""))
    none = [F.lit(None).cast(t).alias(c) for c, t in (("first_turn", "int"), ("turns", "int"), ("bytes", "long"), ("closed", "boolean"))]
    new = turns.select("session_id", F.col("turn").cast("int").alias("turn"), F.lit(None).cast("int").alias("segment"), *none, ((F.col("role") == "user") & is_task(text)).alias("starts"), text.rlike(SUMMARY_LINE).alias("ends"), F.octet_length(text).cast("long").alias("size"))
    if stored is not None:
        known = turns.select("session_id").distinct()
        old = stored.join(known, "session_id", "left_semi").select("session_id", F.lit(-1).alias("turn"), "segment", "first_turn", "turns", "bytes", "closed", F.lit(False).alias("starts"), F.lit(False).alias("ends"), F.lit(0).cast("long").alias("size"))
        new = old.unionByName(new)
    rows = new.repartition("session_id").sortWithinPartitions("session_id", "turn")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, seg, first, n, size, closed = None, 0, 0, 0, 0, True
        for batch in batches:
            out = []
            for session, turn, segment, old_first, turns_, bytes_, closed_, starts, ends, length in batch.itertuples(index=False):
                if session != at:
                    at, seg, n, size, closed = session, 0, 0, 0, True
                if turn == -1:
                    seg, first, n, size, closed = int(segment), int(old_first), int(turns_), int(bytes_), bool(closed_)
                    continue
                if closed or starts and (n >= soft or size >= soft_bytes):
                    seg, first, n, size = seg + 1, turn, 0, 0
                n, size = n + 1, size + int(length)
                closed = bool(ends) or n >= 2 * soft or size >= 2 * soft_bytes
                out.append((session, seg, first, turn, n, size, closed))
            yield pd.DataFrame(out, columns=["session_id", "segment", "first_turn", "last_turn", "turns", "bytes", "closed"])

    return rows.mapInPandas(run, SEGMENT_STATE)


def segments_of(assigned: DataFrame) -> DataFrame:
    """One row a segment of ``segment_turns``, as ``SEGMENT_STATE``."""
    names = [c.split(" ")[0] for c in SEGMENT_STATE.split(", ")]
    return assigned.groupBy("session_id", "segment").agg(F.max_by(F.struct(*names), "last_turn").alias("x")).select("x.*")


def split_long(turns: DataFrame, soft: int = 240, soft_bytes: int = 4 << 20) -> DataFrame:
    """``(session_id, turn, segment_id)`` of long sessions. ``segment_id`` is stable while the session grows."""
    return segment_turns(turns, None, soft, soft_bytes).select("session_id", F.col("last_turn").alias("turn"), F.format_string("seg-%04d", "segment").alias("segment_id"))


def detect_source(records: DataFrame) -> DataFrame:
    """Which tool wrote an extractor's record, and its lineage as a map."""
    g = lambda path: F.get_json_object("raw", path)
    source = F.when(g("$.system").isNotNull() | g("$.meta.entrypoint").isNotNull(), "claude").when(g("$.segment_index").isNotNull() | g("$.meta.segment_index").isNotNull(), "cursor").otherwise("unknown")
    names = ("session_id", "parent_session_id", "segment_index")
    pairs = F.map_filter(F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*(F.coalesce(g(f"$.{n}"), g(f"$.meta.{n}")) for n in names))), lambda _, v: v.isNotNull())
    return records.select("*", source.alias("source"), pairs.alias("lineage"))
