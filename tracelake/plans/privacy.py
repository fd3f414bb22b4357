"""Queries of redaction inside nested columns, its audit, and the backfill of a model's spans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.operators import backfill, redaction
from tracelake.plans.catalog import _SIMPLE
from tracelake.plans.registry import _add, _Roles

_Q = lambda text: text.replace("'", "''")
_CHAIN = ", ".join(
    f"t{i} AS (SELECT doc_id, {', '.join([*(f'n{j}' for j in range(i)), ''])}CAST(len(regexp_extract_all(text, '{_Q(x[1])}')) AS BIGINT) AS n{i}, regexp_replace(text, '{_Q(x[1])}', '{x[2]}', 'g') AS text FROM {f't{i - 1}' if i else 'documents'})"
    for i, x in enumerate(_SIMPLE)
).replace("(SELECT doc_id, CAST", "(SELECT doc_id, CAST")
_LAST = f"t{len(_SIMPLE) - 1}"


def _trees(r: _Roles) -> DataFrame:
    """Each document as a message with a tool call: its text stands in a block, in an argument and under a structural key."""
    at = F.timestamp_micros(F.col("doc_id") * 1_000_003 + 7)
    message = F.struct(
        F.lit("user").alias("role"), at.alias("at"), F.encode("source", "UTF-8").alias("raw"), F.array(F.struct(F.lit("text").alias("type"), F.col("text").alias("body"), F.col("doc_id").alias("n")), F.lit(None)).alias("blocks"),
        F.create_map(F.lit("argument"), F.col("text"), F.lit("none"), F.lit(None)).alias("input"), F.struct(F.col("text").alias("id")).alias("kept"),
    )
    done = redaction.redact_tree(r.documents.select("doc_id", message.alias("m")), ["m"], _SIMPLE, prefixes=())
    return done.select(
        "doc_id", F.md5(F.col("m.blocks")[0]["body"]).alias("body_md5"), F.md5(F.col("m.input")["argument"]).alias("argument_md5"), F.md5("m.kept.id").alias("kept_md5"), F.unix_micros("m.at").alias("micros"), F.hex("m.raw").alias("raw"),
        F.size("m.blocks").cast("long").alias("n_blocks"), F.col("m.blocks")[1].isNull().alias("last_is_null"), F.aggregate(F.map_values("redactions"), F.lit(0).cast("long"), lambda a, n: a + n).alias("redacted"),
    )


_add("r5_nested_redaction", _trees,
     f"""WITH {_CHAIN} SELECT d.doc_id, md5(t.text) AS body_md5, md5(t.text) AS argument_md5, md5(d.text) AS kept_md5, d.doc_id * 1000003 + 7 AS micros, hex(encode(d.source)) AS raw, CAST(2 AS BIGINT) AS n_blocks, true AS last_is_null,
     2 * ({' + '.join(f'n{i}' for i in range(len(_SIMPLE)))}) AS redacted FROM documents d JOIN {_LAST} t ON t.doc_id = d.doc_id""")


def _simple(r: _Roles) -> DataFrame:
    return redaction.redact(r.documents.select("doc_id", "text"), "text", _SIMPLE, prefixes=())


_EACH = " UNION ALL ".join(f"SELECT doc_id, '{x[0]}' AS category, n{i} AS n FROM {_LAST} WHERE n{i} > 0" for i, x in enumerate(_SIMPLE))
_add("a22_totals", lambda r: redaction.audit(_simple(r), "doc_id")[0], f"WITH {_CHAIN} SELECT category, CAST(sum(n) AS BIGINT) AS n, count(DISTINCT doc_id) AS rows FROM ({_EACH}) GROUP BY category")
_add("a22_offenders", lambda r: redaction.audit(_simple(r), "doc_id")[1], f"WITH {_CHAIN} SELECT doc_id, CAST(sum(n) AS BIGINT) AS n FROM ({_EACH}) GROUP BY doc_id ORDER BY n DESC, doc_id LIMIT 20")

_STATES = """SELECT experience_id, created_at, review_status, acl, revoked, CASE WHEN experience_id % 3 = 0 THEN 'done' ELSE 'layer1_only' END AS sanitization_status FROM experiences"""
_SPANS = """SELECT conv_id AS experience_id, turn, 3 AS "start", 9 AS "end", CASE (conv_id + turn) % 5 WHEN 0 THEN 'secret_key' ELSE 'person' END AS label FROM conversations WHERE turn % 2 = 0
  UNION ALL SELECT conv_id, turn, 12, 15, 'address' FROM conversations WHERE turn % 4 = 0 UNION ALL SELECT conv_id, turn, 100000, 100004, 'person' FROM conversations WHERE turn = 1"""


def _backfilled(r: _Roles) -> tuple[DataFrame, DataFrame, DataFrame]:
    q = lambda sql: sql.replace('"start"', "`start`").replace('"end"', "`end`")
    states = r.spark.sql(_STATES.replace("FROM experiences", "FROM {experiences}"), experiences=r.experiences)
    spans = r.spark.sql(q(_SPANS).replace("FROM conversations", "FROM {conversations}"), conversations=r.conversations)
    turns = r.conversations.select(F.col("conv_id").alias("experience_id"), "turn", "text")
    return backfill.backfill(states, turns, turns.where("experience_id % 7 <> 0").select("experience_id").distinct(), spans)


_BACKFILL = f"""s AS ({_STATES}), sp AS ({_SPANS}), due AS (SELECT * FROM s WHERE sanitization_status = 'layer1_only' AND NOT revoked),
  scan AS (SELECT DISTINCT experience_id FROM due JOIN conversations ON conv_id = experience_id WHERE experience_id % 7 <> 0),
  own AS (SELECT sp.* FROM sp JOIN scan ON scan.experience_id = sp.experience_id),
  h AS (SELECT scan.experience_id, coalesce(bool_or(contains(label, 'secret')), false) AS high, count(label) AS n FROM scan LEFT JOIN own ON own.experience_id = scan.experience_id GROUP BY 1)"""
_add("r11_backfilled_states", lambda r: _backfilled(r)[1].select("experience_id", "sanitization_status", "review_status"),
     f"""WITH {_BACKFILL} SELECT s.experience_id, CASE WHEN h.high THEN 'human_review' WHEN h.experience_id IS NOT NULL OR (due.experience_id IS NOT NULL AND s.experience_id NOT IN (SELECT conv_id FROM conversations)) THEN 'done' ELSE s.sanitization_status END AS sanitization_status,
     CASE WHEN h.experience_id IS NULL THEN s.review_status WHEN h.high AND coalesce(s.acl, 'private') <> 'private' THEN 'pending' ELSE 'auto_approved' END AS review_status
     FROM s LEFT JOIN due ON due.experience_id = s.experience_id LEFT JOIN h ON h.experience_id = s.experience_id""")
_add("r11_backfilled_turns", lambda r: _backfilled(r)[0].select("experience_id", "turn", F.md5("text").alias("text_md5")),
     f"""WITH {_BACKFILL}, t AS (SELECT conv_id AS experience_id, turn, text AS a, conv_id IN (SELECT experience_id FROM scan) AS scanned FROM conversations),
     u AS (SELECT *, CASE WHEN scanned AND turn % 4 = 0 AND length(a) >= 15 THEN concat(left(a, 12), '<ADDRESS>', substring(a, 16)) ELSE a END AS b FROM t)
     SELECT experience_id, turn, md5(CASE WHEN scanned AND turn % 2 = 0 AND length(a) >= 9 THEN concat(left(b, 3), CASE (experience_id + turn) % 5 WHEN 0 THEN '<SECRET_KEY>' ELSE '<PERSON>' END, substring(b, 10)) ELSE b END) AS text_md5 FROM u""")
_add("r11_backfill_audit", lambda r: _backfilled(r)[2].select("target_id", "triggered_high", "review_status", "sanitizer_blocked_review", F.aggregate(F.coalesce(F.map_values("hits"), F.expr("CAST(array() AS array<bigint>)")), F.lit(0).cast("long"), lambda a, n: a + n).alias("hits")),
     f"""WITH {_BACKFILL} SELECT h.experience_id AS target_id, high AS triggered_high, CASE WHEN high AND coalesce(acl, 'private') <> 'private' THEN 'pending' ELSE 'auto_approved' END AS review_status, high AND coalesce(acl, 'private') <> 'private' AS sanitizer_blocked_review, n AS hits FROM h JOIN s ON s.experience_id = h.experience_id""")
