"""Queries of the readers of line records, over conversations written as such records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.plans.registry import _add, _Roles
from tracelake.sources import line_records


def _quoted(text: Column) -> Column:
    """A JSON string."""
    whole = F.to_json(F.struct(text.alias("x")))
    return F.substring(whole, F.lit(6), F.length(whole) - 6)


def _lines(r: _Roles) -> DataFrame:
    """Each turn as a nested record; the facts stand in some of them only, some are synthetic or interruptions."""
    c, t = F.col("conv_id"), F.col("turn")
    blocks = lambda *some: F.concat(F.lit("["), F.array_join(F.array_compact(F.array(*some)), ","), F.lit("]"))
    block = lambda **fields: F.to_json(F.struct(*(x.alias(k) for k, x in fields.items())))
    text = block(type=F.lit("text"), text=F.col("text"))
    said = blocks(
        F.when(t % 3 == 1, block(type=F.lit("thinking"), thinking=F.concat(F.lit("about "), c), signature=F.lit("xyz"))), text,
        F.when((c + t) % 4 == 0, block(type=F.lit("tool_use"), id=F.concat(F.lit("t"), t), name=F.lit("run"), input=F.struct(t.alias("n")))),
    )
    result = block(type=F.lit("tool_result"), tool_use_id=F.concat(F.lit("t"), t), content=F.substring("text", 1, 50))
    asked = F.when((c + t) % 6 == 0, blocks(block(type=F.lit("text"), text=F.lit("[Request interrupted by user]")), result)).when((c + t) % 6 == 1, blocks(text)).otherwise(_quoted(F.col("text")))
    model = F.when(F.col("role") == "assistant", F.when((c + t) % 11 == 0, "<synthetic>").otherwise(F.concat(F.lit("m"), (c + t) % 2))).when((c + t) % 13 == 0, "<synthetic>")
    part = lambda name, value, when=F.lit(True): F.when(when & value.isNotNull(), F.concat(F.lit(f'"{name}":'), value))
    message = F.concat(F.lit("{"), F.array_join(F.array_compact(F.array(part("model", _quoted(model), model.isNotNull()), part("content", F.when(F.col("role") == "assistant", said).otherwise(asked)))), ","), F.lit("}"))
    raw = F.array_compact(
        F.array(
            part("type", _quoted(F.col("role"))), part("timestamp", _quoted(F.concat(F.lit("2024-01-01T00:00:"), F.lpad(t.cast("string"), 2, "0"))), (c + t) % 5 != 0),
            part("version", _quoted(F.concat(F.lit("1."), c % 3, F.lit("."), t)), t % 4 == 0), part("cwd", _quoted(F.concat(F.lit("/work/"), c % 7)), (c + t) % 3 == 0), part("message", message),
        )
    )
    return r.conversations.select(F.concat(F.lit("s"), c).alias("session_id"), t.alias("line"), F.concat(F.lit("{"), F.array_join(raw, ","), F.lit("}")).alias("raw"))


_FACTS = """f AS (SELECT *, conv_id + turn AS k, CASE WHEN (conv_id + turn) % 5 <> 0 THEN concat('2024-01-01T00:00:', lpad(CAST(turn AS VARCHAR), 2, '0')) ELSE '' END AS ts,
  CASE WHEN turn % 4 = 0 THEN concat('1.', conv_id % 3, '.', turn) END AS version, CASE WHEN (conv_id + turn) % 3 = 0 THEN concat('/work/', conv_id % 7) END AS cwd,
  CASE WHEN role = 'assistant' AND (conv_id + turn) % 11 <> 0 THEN concat('m', (conv_id + turn) % 2) END AS model FROM conversations),
t AS (
  SELECT conv_id, turn AS line, 0 AS part, 'assistant' AS role, concat('💭 思考', chr(10), chr(10), 'about ', conv_id) AS text, ts, '' AS calls, NULL AS result_for FROM f WHERE role = 'assistant' AND turn % 3 = 1
  UNION ALL SELECT conv_id, turn, 1, 'assistant', text, ts, CASE WHEN k % 4 = 0 THEN concat('t', turn, ' run {"n":', turn, '}') ELSE '' END, NULL FROM f WHERE role = 'assistant'
  UNION ALL SELECT conv_id, turn, 1, 'user', text, ts, '', NULL FROM f WHERE role = 'user' AND k % 13 <> 0 AND k % 6 <> 0
  UNION ALL SELECT conv_id, turn, 2, 'tool', left(text, 50), ts, '', concat('t', turn) FROM f WHERE role = 'user' AND k % 13 <> 0 AND k % 6 = 0)"""

_add("s3d_record_turns", lambda r: line_records.turns_with_facts(_lines(r)).select("session_id", "turn", F.col("line").cast("long").alias("line"), "role", F.md5("text").alias("text_md5"), "ts", F.array_join(F.transform("tool_calls", lambda c: F.concat_ws(" ", c["id"], c["name"], c["input"])), ";").alias("calls"), "tool_result_for", "version", "cwd", "model"),
     f"""WITH {_FACTS}, g AS (SELECT conv_id, turn, last_value(version IGNORE NULLS) OVER w AS version, last_value(cwd IGNORE NULLS) OVER w AS cwd, last_value(model IGNORE NULLS) OVER w AS model FROM f WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
     SELECT concat('s', t.conv_id) AS session_id, row_number() OVER (PARTITION BY t.conv_id ORDER BY line, part) - 1 AS turn, line, role, md5(text) AS text_md5, ts, calls, result_for AS tool_result_for, version, cwd, model FROM t JOIN g ON g.conv_id = t.conv_id AND g.turn = line""")
_add("s3d_sessions", lambda r: line_records.nested_sessions(_lines(r)),
     f"""WITH {_FACTS}, n AS (SELECT conv_id, count(*) AS turns FROM t GROUP BY 1)
     SELECT concat('s', f.conv_id) AS session_id, coalesce(arg_min(ts, turn) FILTER (ts <> ''), '') AS started_at, coalesce(arg_max(ts, turn) FILTER (ts <> ''), '') AS ended_at, coalesce(arg_max(model, turn) FILTER (model IS NOT NULL), 'unknown') AS model,
     coalesce(arg_max(cwd, turn) FILTER (cwd IS NOT NULL), '') AS cwd, coalesce(arg_max(version, turn) FILTER (version IS NOT NULL), '') AS agent_version, coalesce(max(turns), 0) AS turns FROM f LEFT JOIN n ON n.conv_id = f.conv_id GROUP BY f.conv_id""")
_add("s3c_block_turns", lambda r: line_records.block_turns(_lines(r).select("session_id", "line", F.get_json_object("raw", "$.type").alias("role"), F.when(F.get_json_object("raw", "$.message.content").startswith("["), F.get_json_object("raw", "$.message.content")).otherwise(_quoted(F.get_json_object("raw", "$.message.content"))).alias("content")))
     .select("session_id", "turn", F.col("line").cast("long").alias("line"), "role", F.md5("text").alias("text_md5")),
     """WITH f AS (SELECT *, conv_id + turn AS k, chr(10) AS nl FROM conversations), t AS (
     SELECT conv_id, turn, 0 AS part, role, concat('💭 思考', nl, nl, 'about ', conv_id) AS text FROM f WHERE role = 'assistant' AND turn % 3 = 1
     UNION ALL SELECT conv_id, turn, 1, role, text FROM f WHERE role = 'assistant' OR k % 6 <> 0
     UNION ALL SELECT conv_id, turn, 2, role, concat('🔧 调用工具: run  (id=t', turn, ')', nl, nl, '```json', nl, '{', nl, '  "n": ', turn, nl, '}', nl, '```') FROM f WHERE role = 'assistant' AND k % 4 = 0
     UNION ALL SELECT conv_id, turn, 1, role, '[Request interrupted by user]' FROM f WHERE role <> 'assistant' AND k % 6 = 0
     UNION ALL SELECT conv_id, turn, 2, 'tool', concat('📤 工具返回  (id=t', turn, ')', nl, nl, left(text, 50)) FROM f WHERE role <> 'assistant' AND k % 6 = 0)
     SELECT concat('s', conv_id) AS session_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, part) - 1 AS turn, turn AS line, role, md5(text) AS text_md5 FROM t""")
