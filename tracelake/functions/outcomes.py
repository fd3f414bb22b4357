"""How something ended, by ordered rules: the first that matches decides.

A rule is ``(status, kind, patterns)``. ``text``: any of the patterns stands somewhere; ``word``: with no letter, digit or underscore beside it; ``code``: an exit code other than 0 follows the
pattern; ``head``: as a word of its own near the start, with white space or a colon after it.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The rules for texts, those for what a shell gave back, its names, and the words by which a query asks for one or the other ending.
TEXT_RULES = (
    ("failure", "text", ("<tool_use_error>",)),
    ("success", "text", ("process exited with code 0",)),
    ("failure", "code", ("process exited with code ",)),
    ("failure", "text", ("traceback", "assertionerror", "failed", "failure", "not found", "no such file", "timeout", "timed out", "connection refused", "unauthorized", "forbidden", "404", "401", "403", "500", "报错", "错误", "失败", "未通过", "找不到", "超时")),
    ("success", "text", ("tests passed", "test passed", "process exited with code 0", "1 passed", "passed in", "has been updated", "successfully", "已完成", "测试通过")),
    ("success", "word", ("200", "201", "204")),
    ("success", "word", ("passed", "success", "succeeded", "ok", "done", "fixed", "verified", "updated", "completed")),
    ("success", "text", ("完成", "成功", "通过", "修复")),
    ("failure", "text", ("exception", "error", "错误")),
)
SHELL_RULES = (
    ("failure", "text", ("<tool_use_error>",)),
    ("success", "text", ("process exited with code 0",)),
    ("failure", "code", ("process exited with code ",)),
    ("failure", "head", ("failed", "failure", "assertionerror", "traceback")),
    ("failure", "head", ("error:",)),
    ("success", "text", ("tests passed", "test passed", "1 passed", "passed in", "import ok", "successfully", "已完成", "测试通过")),
)
SHELLS = ("bash", "exec_command")
HEAD = 1200
WANTS_SUCCESS = (("word", ("passed", "success", "successful", "successfully", "succeeded", "fixed", "resolved", "completed", "works")), ("text", ("成功", "通过", "已修复", "已解决", "完成")))
WANTS_FAILURE = (("word", ("failed", "failure", "error", "exception", "traceback", "assertionerror", "timeout", "denied")), ("text", ("失败", "报错", "错误", "异常", "超时", "拒绝")))

_EDGE = r"[^\p{L}\p{N}_]"


def pattern(kind: str, some: tuple[str, ...]) -> str:
    """A rule's pattern, in the form that Java and RE2 share."""
    any_of = "|".join(re.escape(x).replace(r"\ ", " ") for x in some)
    return {"text": f"(?:{any_of})", "word": rf"(?:^|{_EDGE})(?:{any_of})(?:{_EDGE}|$)", "code": f"(?:{any_of})[1-9]", "head": rf"(?:^|\s)(?:{any_of})" + ("" if some[0].endswith(":") else r"(?:\s|:)")}[kind]


def _first(low: Column, rules: tuple) -> Column:
    out = None
    for status, kind, some in rules:
        held = (F.substring(low, 1, HEAD) if kind == "head" else low).rlike(pattern(kind, some))
        out = F.when(held, status) if out is None else out.when(held, status)
    return out.otherwise("unknown")


def _low(text: Column) -> Column:
    return F.lower(F.coalesce(text, F.lit("")))


def outcome_status(text: Column) -> Column:
    """``failure``, ``success`` or ``unknown``; a null text is unknown."""
    return _first(_low(text), TEXT_RULES)


def outcome_for_tool(tool: Column, text: Column) -> Column:
    """The same for a tool's result: what a shell prints is only taken for a failure by its exit code or its first words."""
    shell = F.regexp_replace(_low(tool), "[^a-z0-9_]+", "").isin(*SHELLS)
    return F.when(shell, _first(_low(text), SHELL_RULES)).otherwise(outcome_status(text))


def outcome_preference(query: Column) -> Column:
    """``success`` or ``failure`` if a query asks for one of them only, else null."""
    wants = lambda some: _low(query).rlike("|".join(pattern(k, x) for k, x in some))
    good, bad = wants(WANTS_SUCCESS), wants(WANTS_FAILURE)
    return F.when(good & ~bad, "success").when(bad & ~good, "failure")


def duckdb(low: str, rules: tuple) -> str:
    """The rules as SQL of the checking database."""
    when = " ".join(f"WHEN regexp_matches({f'left({low}, {HEAD})' if kind == 'head' else low}, '{pattern(kind, some)}') THEN '{status}'" for status, kind, some in rules)
    return f"CASE {when} ELSE 'unknown' END"
