"""Sessions kept as one JSON record a line, in two layouts.

*Nested*: ``type`` is the speaker and ``message`` holds ``model`` and ``content``; ``version``, ``cwd`` and ``timestamp`` stand beside it and hold until another
line says otherwise. *Flat*: ``role`` and ``content`` stand in the record itself. Lines come from ``sessions.read_lines``, numbered over the splits of a file.

Each line is parsed on its own, so a session of any length is any number of tasks. What depends on earlier lines (turn numbers, facts that are carried forward) is
worked out in two steps: within runs of ``RUN`` lines, and over one row a run.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Lines of a session that are ordered in one piece.
RUN = 10_000

# Marks in front of turns, and messages that are no turns.
THOUGHT = "💭 思考\n\n"
CALL, RESULT, ERROR, PICTURE, INNER_PICTURE = "🔧 调用工具: ", "📤 工具返回", " ❌", "🖼️ [图片]", "[image]"
SYNTHETIC, INTERRUPTED = "<synthetic>", "[Request interrupted"

_TURN = "struct<role:string,text:string,tool_calls:array<struct<id:string,name:string,input:string>>,tool_result_for:string>"
_CALLS = "array<struct<id:string,name:string,input:string>>"


def _get(v: Column | str, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, path, kind)


def _is(v: Column, path: str, kind: str) -> Column:
    return F.coalesce(F.schema_of_variant(_get(v, path, "variant")).startswith(kind), F.lit(False))


def _said(text: Column) -> Column:
    """Whether there is anything but white space."""
    return F.coalesce(text.rlike(r"(?U)\S"), F.lit(False))


def _blocks(v: Column, path: str) -> Column:
    """The objects of a list; none where it is no list."""
    none = F.expr("CAST(array() AS array<variant>)")
    return F.filter(F.coalesce(_get(v, path, "array<variant>"), none), lambda b: F.coalesce(F.schema_of_variant(b).startswith("OBJECT"), F.lit(False)))


def _of_kind(blocks: Column, kind: str) -> Column:
    return F.filter(blocks, lambda b: F.coalesce(_get(b, "$.type") == kind, F.lit(False)))


def _turn(role: str | Column, text: Column, calls: Column | None = None, result_for: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    role = F.lit(role) if isinstance(role, str) else role
    return F.struct(role.alias("role"), text.alias("text"), (F.expr(f"CAST(array() AS {_CALLS})") if calls is None else calls).alias("tool_calls"), (none if result_for is None else result_for).alias("tool_result_for"))


def _joined(texts: Column) -> Column:
    return F.array_join(F.filter(texts, _said), "\n")


def _calls(blocks: Column) -> Column:
    each = lambda b: F.struct(F.coalesce(_get(b, "$.id"), F.lit("")).alias("id"), F.coalesce(_get(b, "$.name"), F.lit("")).alias("name"), F.coalesce(_get(b, "$.input"), F.lit("{}")).alias("input"))
    return F.transform(_of_kind(blocks, "tool_use"), each)


def _result_text(b: Column) -> Column:
    """What a tool gave back: the text blocks of a list, a string as it is, else JSON."""
    inner = F.array_join(F.transform(_of_kind(_blocks(b, "$.content"), "text"), lambda x: F.coalesce(_get(x, "$.text"), F.lit(""))), "\n")
    return F.when(_is(b, "$.content", "ARRAY"), inner).when(_get(b, "$.content", "variant").isNull(), "").when(_is(b, "$.content", "VOID"), "null").otherwise(_get(b, "$.content"))


def _parsed(lines: DataFrame) -> DataFrame:
    rows = lines.select("session_id", F.col("line").cast("long").alias("line"), F.try_parse_json("raw").alias("v"))
    return rows.where(F.coalesce(F.schema_of_variant("v").startswith("OBJECT"), F.lit(False)))


def _placed(rows: DataFrame) -> DataFrame:
    """One row a turn of the arrays ``turns``, numbered from 0 in each session."""
    each = rows.select("session_id", "line", "ts", F.posexplode("turns").alias("part", "t")).select("session_id", "line", "part", "ts", "t.*")
    return numbered(each, "session_id", "line", ["line", "part"], "turn").select("session_id", "turn", "line", "role", "text", "ts", "tool_calls", "tool_result_for")


def numbered(rows: DataFrame, key: str, at: str, order: list[str], name: str, run: int = RUN) -> DataFrame:
    """``rows`` with a number from 0 in each ``key``, in the order of ``order``, whose first column is the whole number ``at``. No more than the rows of ``run`` numbers are sorted in one task."""
    rows = rows.withColumn("__run", F.floor(F.col(at) / run))
    before = W.partitionBy(key).orderBy("__run").rowsBetween(W.unboundedPreceding, -1)
    starts = rows.groupBy(key, "__run").agg(F.count("*").alias("__n")).select(key, "__run", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    nth = F.row_number().over(W.partitionBy(key, "__run").orderBy(*order)) - 1
    return rows.withColumn("__nth", nth).join(starts, [key, "__run"]).withColumn(name, (F.col("__start") + F.col("__nth")).cast("long")).drop("__run", "__nth", "__start")


def carried(rows: DataFrame, key: str, at: str, columns: list[str], run: int = RUN) -> DataFrame:
    """``rows`` with each of ``columns`` filled by its last value before, by the whole number ``at``, which no two rows of a ``key`` share."""
    rows = rows.withColumn("__run", F.floor(F.col(at) / run))
    last = rows.groupBy(key, "__run").agg(*(F.max_by(c, F.when(F.col(c).isNotNull(), F.col(at))).alias(f"__{c}") for c in columns))
    before = W.partitionBy(key).orderBy("__run").rowsBetween(W.unboundedPreceding, -1)
    last = last.select(key, "__run", *(F.last(f"__{c}", ignorenulls=True).over(before).alias(f"__{c}") for c in columns))
    here = W.partitionBy(key, "__run").orderBy(at).rowsBetween(W.unboundedPreceding, 0)
    filled = rows.withColumns({c: F.last(c, ignorenulls=True).over(here) for c in columns}).join(last, [key, "__run"])
    return filled.withColumns({c: F.coalesce(c, f"__{c}") for c in columns}).drop("__run", *(f"__{c}" for c in columns))


def nested_turns(lines: DataFrame) -> DataFrame:
    """Turns of nested records: ``session_id``, ``turn``, ``line``, ``role``, ``text``, ``ts``, ``tool_calls``, ``tool_result_for``.

    An assistant's thoughts are turns of their own, before its text and calls; a user's tool results follow the user's text. Synthetic messages, interruptions, blank
    texts, other records and lines that cannot be read give no turn.
    """
    v = F.col("v")
    blocks = _blocks(v, "$.message.content")
    thought = F.transform(F.filter(F.transform(_of_kind(blocks, "thinking"), lambda b: F.coalesce(_get(b, "$.thinking"), F.lit(""))), lambda t: t != ""), lambda t: _turn("assistant", F.concat(F.lit(THOUGHT), t)).cast(_TURN))
    text = _joined(F.transform(_of_kind(blocks, "text"), lambda b: _get(b, "$.text")))
    calls = _calls(blocks)
    spoken = F.when((text != "") | (F.size(calls) > 0), F.array(_turn("assistant", text, calls).cast(_TURN)))
    results = F.transform(_of_kind(blocks, "tool_result"), lambda b: _turn("tool", _result_text(b), None, F.coalesce(_get(b, "$.tool_use_id"), F.lit(""))).cast(_TURN))
    whole = _get(v, "$.message.content")
    asked = F.when(_is(v, "$.message.content", "STRING") & _said(whole), F.array(_turn("user", whole).cast(_TURN))).when((text != "") & ~text.startswith(INTERRUPTED), F.array(_turn("user", text).cast(_TURN)))
    none = F.expr(f"CAST(array() AS array<{_TURN}>)")
    real = F.coalesce(_get(v, "$.message.model"), F.lit("")) != SYNTHETIC
    kind = _get(v, "$.type")
    turns = F.when(kind == "assistant", F.concat(thought, F.coalesce(spoken, none))).when((kind == "user") & real, F.concat(F.coalesce(asked, none), results))
    return _placed(_parsed(lines).select("session_id", "line", F.coalesce(_get(v, "$.timestamp"), F.lit("")).alias("ts"), F.coalesce(turns, none).alias("turns")))


def nested_facts(lines: DataFrame) -> DataFrame:
    """What each readable line says of the session: ``ts``, ``version``, ``cwd``, ``model``; null where it says nothing. Synthetic messages have no model."""
    v = F.col("v")
    some = lambda path: F.when(_get(v, path) != "", _get(v, path))
    model = F.when((_get(v, "$.type") == "assistant") & (_get(v, "$.message.model") != SYNTHETIC), some("$.message.model"))
    return _parsed(lines).select("session_id", "line", some("$.timestamp").alias("ts"), some("$.version").alias("version"), some("$.cwd").alias("cwd"), model.alias("model"))


def nested_sessions(lines: DataFrame) -> DataFrame:
    """One row a session: first and last timestamp, last seen ``model`` (``unknown`` if none), ``cwd`` and ``version``, and the number of turns. Combined on the map side, whatever a session's length."""
    facts = nested_facts(lines)
    seen = lambda pick, c: pick(c, F.when(F.col(c).isNotNull(), F.col("line")))
    about = facts.groupBy("session_id").agg(
        F.coalesce(seen(F.min_by, "ts"), F.lit("")).alias("started_at"), F.coalesce(seen(F.max_by, "ts"), F.lit("")).alias("ended_at"), F.coalesce(seen(F.max_by, "model"), F.lit("unknown")).alias("model"),
        F.coalesce(seen(F.max_by, "cwd"), F.lit("")).alias("cwd"), F.coalesce(seen(F.max_by, "version"), F.lit("")).alias("agent_version"),
    )
    n = nested_turns(lines).groupBy("session_id").agg(F.count("*").alias("turns"))
    return about.join(n, "session_id", "left").withColumn("turns", F.coalesce("turns", F.lit(0)))


def turns_with_facts(lines: DataFrame) -> DataFrame:
    """``nested_turns`` with the model, directory and version that held when each was written: those last seen at its line or before."""
    facts = carried(nested_facts(lines), "session_id", "line", ["version", "cwd", "model"])
    return nested_turns(lines).join(facts.drop("ts"), ["session_id", "line"])


def flat_turns(lines: DataFrame) -> DataFrame:
    """Turns of flat records, one each, as ``nested_turns`` has them: texts and tool results of a block list are joined, a record's last tool result names the call."""
    v = F.col("v")
    blocks = _blocks(v, "$.content")
    texts = F.transform(blocks, lambda b: F.when(_get(b, "$.type") == "text", F.coalesce(_get(b, "$.text"), F.lit(""))).when(_get(b, "$.type") == "tool_result", _result_text(b)).otherwise(""))
    text = F.when(_is(v, "$.content", "ARRAY"), F.array_join(F.filter(texts, lambda t: t != ""), "\n")).otherwise(F.coalesce(_get(v, "$.content"), F.when(_is(v, "$.content", "VOID"), "null"), F.lit("")))
    last = F.coalesce(F.try_element_at(F.transform(_of_kind(blocks, "tool_result"), lambda b: F.coalesce(_get(b, "$.tool_use_id"), F.lit(""))), F.lit(-1)), F.lit(""))
    some = lambda path: F.when(_get(v, path) != "", _get(v, path))
    calls = _calls(blocks)
    turn = F.when(_said(text) | (F.size(calls) > 0), F.array(_turn(F.coalesce(some("$.role"), some("$.type"), F.lit("user")), text, calls, last).cast(_TURN)))
    ts = F.coalesce(_get(v, "$.ts"), _get(v, "$.timestamp"), F.lit(""))
    return _placed(_parsed(lines).select("session_id", "line", ts.alias("ts"), F.coalesce(turn, F.expr(f"CAST(array() AS array<{_TURN}>)")).alias("turns")))


def _marked(role: str, block: object) -> tuple[str, str] | None:
    """The turn of one content block, with its mark."""
    kind = block.get("type") if isinstance(block, dict) else None
    text = lambda k: str(block.get(k) or "")
    named = lambda k: f"  (id={text(k)[:12]})" if text(k) else ""
    if kind == "text":
        return (role, text("text")) if text("text").strip() else None
    if kind == "thinking":
        return (role, THOUGHT + text("thinking")) if text("thinking").strip() else None
    if kind == "tool_use":
        return role, f"{CALL}{block.get('name', '?')}{named('id')}\n\n```json\n{json.dumps(block.get('input'), ensure_ascii=False, indent=2)}\n```"
    if kind == "tool_result":
        inner = block.get("content")
        if isinstance(inner, list):
            shown = {"text": lambda c: str(c.get("text", "")), "image": lambda c: INNER_PICTURE}
            inner = "\n".join(shown[c["type"]](c) for c in inner if isinstance(c, dict) and c.get("type") in shown)
        elif not isinstance(inner, str):
            inner = json.dumps(inner, ensure_ascii=False)
        return "tool", f"{RESULT}{ERROR if block.get('is_error') else ''}{named('tool_use_id')}\n\n{inner}"
    return (role, PICTURE if kind == "image" else f"[{kind}]") if kind else None


def _marked_turns(roles: pd.Series, contents: pd.Series) -> pd.Series:
    out = []
    for role, raw in zip(roles, contents, strict=True):
        try:
            content = json.loads(raw) if raw is not None else None
        except ValueError:
            content = None
        if isinstance(content, str):
            content = [{"type": "text", "text": content}]
        out.append([t for b in content if (t := _marked(role, b))] if isinstance(content, list) else [])
    return pd.Series(out)


def block_turns(messages: DataFrame) -> DataFrame:
    """``(session_id, line, role, content)``, with content a JSON string or list of blocks, to one turn a block: ``session_id``, ``turn``, ``line``, ``role``, ``text``. Tool calls and results become text with marks; what cannot be read has none."""
    marked = F.pandas_udf(_marked_turns, "array<struct<role:string,text:string>>")
    rows = messages.select("session_id", F.col("line").cast("long").alias("line"), F.posexplode(marked("role", "content")).alias("part", "t")).select("session_id", "line", "part", "t.*")
    return numbered(rows, "session_id", "line", ["line", "part"], "turn").select("session_id", "turn", "line", "role", "text")
