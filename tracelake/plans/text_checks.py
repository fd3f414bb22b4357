"""SQL for registered queries of text functions, built from the same word lists where there are any."""

from __future__ import annotations

import re

from tracelake.functions import text as tx
from tracelake.operators import review, units
from tracelake.plans.catalog import _SHARED
from tracelake.plans.registry import ORACLES
from tracelake.plans.roles import with_roles


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _list(words: tuple[str, ...]) -> str:
    return ", ".join(map(_q, words))


def _any(words: tuple[str, ...], test: str, of: str) -> str:
    return " OR ".join(f"{test}({of}, {_q(w)})" for w in words)


_STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"


def _whole(words: tuple[str, ...]) -> str:
    return _q(r"(^|[^\pL\pN_])(" + "|".join(map(re.escape, words)).replace("\\ ", " ") + r")([^\pL\pN_]|$)")


_TASK = f"""CASE WHEN regexp_matches(t, '(?is)<objective>.*?</objective>') THEN regexp_extract(t, '(?is)<objective>\\s*(.*?)\\s*</objective>', 1) WHEN {_any(review.WRAPPERS, 'starts_with', 'lower(t)')} THEN '' ELSE t END"""

CHECKS = {
    "x14_low_value": f"""WITH c AS (SELECT conv_id, turn, trim(lower(text)) AS o FROM conversations),
      f AS (SELECT *, contains(o, '<tool_use_error>') OR regexp_matches(o, '\\A(error:|failed |failed:|traceback|no such file|file does not exist)') OR contains(left(o, 240), 'permission denied') AS failed FROM c)
      SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN NOT failed ELSE true END AS low FROM f""",
    "t12_x12_clean_turns": f"""WITH a AS (SELECT conv_id, turn, CASE WHEN regexp_matches(text, '(?is)<objective>.*?</objective>') THEN regexp_extract(text, '(?is)<objective>\\s*(.*?)\\s*</objective>', 1) ELSE text END AS t FROM conversations),
      b AS (SELECT conv_id, turn, regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '(?i)\\bChunk ID:\\s*\\S+', ' ', 'g'), '(?i)\\bWall time:\\s*[0-9.]+\\s*seconds?', ' ', 'g'), '(?i)\\bOriginal token count:\\s*\\d+', ' ', 'g'), '(?i)\\b(?:Final output|Output):\\s*', ' ', 'g') AS t FROM a),
      c AS (SELECT conv_id, turn, trim(regexp_replace(regexp_replace(regexp_replace(t, 'data:[^;\\s]+;base64,[A-Za-z0-9+/=]{{80,}}', '[data-url omitted]', 'g'), '[A-Za-z0-9+/=]{{600,}}', '[large blob omitted]', 'g'), '\\s+', ' ', 'g')) AS t FROM b)
      SELECT conv_id, turn, sha256(CASE WHEN length(t) < 2 OR {_any(units.NOTICES, 'contains', 'lower(t)')} THEN '' ELSE t END) AS sha FROM c""",
    "p11_query_signal": f"""WITH c AS (SELECT conv_id, turn, text, lower(text) AS low, regexp_replace(lower(text), '^[\\s[:punct:]]+|[\\s[:punct:]]+$', '', 'g') AS t, regexp_extract(text, '(?m)^\\s*(\\S.*)$', 1) AS first, lower(trim(text)) AS b FROM conversations),
      d AS (SELECT *, regexp_extract(first, '^(.+?[.!?。！？])(\\s|$)', 1) AS sentence FROM c)
      SELECT conv_id, turn, t NOT IN ({_list(tx.ACKNOWLEDGEMENTS)}) AND t <> '' AND (length(t) >= 3 OR (regexp_matches(t, '\\pL') AND regexp_matches(t, '\\d')) OR regexp_matches(t, '[一-鿿]{{2}}')) AS signal,
      CASE WHEN regexp_matches(low, {_whole(tx.FAILURE)}) THEN 'failure' WHEN regexp_matches(low, {_whole(tx.SUCCESS)}) THEN 'success' ELSE 'unknown' END AS outcome,
      left(rtrim(CASE WHEN sentence <> '' THEN sentence ELSE first END, ' '), 70) AS title,
      b = '' OR suffix(b, '...') OR suffix(b, '…') OR starts_with(b, 'http') OR starts_with(b, '```') OR starts_with(b, '<') OR contains(b, chr(10)) AS bad FROM d""",
    "p12_p13_labels": f"""WITH c AS (SELECT conv_id, turn, text, left(text, 60) AS label, lower(trim(left(text, 60))) AS low, {_STRIP.format('left(text, 120)')} AS i, left({_STRIP.format('text')}, 120) AS q FROM conversations)
      SELECT conv_id, turn, CASE WHEN label = '(闲聊)' THEN false ELSE low = '' OR suffix(label, '…') OR suffix(label, '...') OR {_any(review.BAD_PREFIXES, 'starts_with', 'low')} OR {_any(review.BAD_PARTS, 'contains', 'low')} END AS bad,
      length(i) < 4 OR regexp_matches(i, {_q(review.GREETING)}) OR (text <> '' AND trim(regexp_replace(i, '…+$', '')) = trim(regexp_replace(q, '…+$', ''))) AS relabel FROM c""",
    "p10_retrievable_sessions": f"""WITH s AS (SELECT conv_id, role, text, {_STRIP.format('text')} AS t FROM conversations), o AS (SELECT conv_id, role, text, CASE WHEN regexp_matches({_TASK}, '(?i)\\A(?:<image[^>]*>\\s*)+\\z') THEN '' ELSE {_TASK} END AS t FROM s),
      k AS (SELECT *, lower(trim(regexp_replace(t, '[^\\pL\\pM\\pN]+', ' ', 'g'))) AS plain, regexp_replace(t, '\\s+', '', 'g') AS compact FROM o)
      SELECT conv_id, bool_or(CASE WHEN role = 'user' THEN t <> '' AND plain NOT IN ({_list(review.TRIVIAL)}) AND (length(compact) >= 3 OR regexp_matches(compact, '[A-Za-z][0-9]|[0-9][A-Za-z]')) WHEN role = 'assistant' THEN regexp_matches(text, {_q(review.SUMMARY_MARK)}) ELSE false END) AS retrievable FROM k GROUP BY conv_id""",
    # the tables have no ideographs, whose runs are cut otherwise
    "x6_x8_lexical": """WITH r AS (SELECT conv_id, turn, regexp_extract_all(lower(text), '[a-z0-9_+#.-]+') AS r FROM conversations),
      p AS (SELECT conv_id, turn, r, flatten(list_transform(r, lambda x: list_filter(string_split_regex(x, '[_+#.-]+'), lambda y: length(y) > 1))) AS p FROM r),
      t AS (SELECT conv_id, turn, list_distinct(list_concat(list_concat(r, p), flatten(list_transform(list_filter(p, lambda y: length(y) > 8 AND regexp_matches(y, '[0-9]') AND regexp_matches(y, '[a-z]')), lambda y: list_transform(range(1, length(y) - 2), lambda i: y[i:i + 3]))))) AS t FROM p),
      l AS (SELECT *, lag(t) OVER (PARTITION BY conv_id ORDER BY turn) AS q FROM t),
      m AS (SELECT conv_id, turn, len(list_intersect(q, t)) AS o, greatest(len(q), 1) AS nq, greatest(len(t), 1) AS nt FROM l WHERE q IS NOT NULL)
      SELECT conv_id, turn, round(greatest(0, least(1, 0.85 * o / nq + 0.15 * sqrt(o / nt))), 6) AS score FROM m""",
    "t18_acl_search": with_roles(f"""WITH q AS (SELECT DISTINCT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[a-z0-9一-鿿]{{2,}}')) AS term FROM benchmark), d AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9一-鿿]{{2,}}') AS ts FROM documents),
      a AS (SELECT count(*) AS n, avg(len(ts)) AS avg_len FROM d), t AS (SELECT doc_id, len(ts) AS len, unnest(ts) AS term FROM d), p AS (SELECT term, doc_id, any_value(len) AS len, count(*) AS tf FROM t WHERE term IN (SELECT term FROM q) GROUP BY 1, 2), f AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
      s AS (SELECT query_id, doc_id, round(sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg_len))), 6) AS score FROM q JOIN p ON p.term = q.term JOIN f ON f.term = q.term, a GROUP BY 1, 2),
      e AS (SELECT experience_id FROM experiences WHERE {_SHARED})
      SELECT query_id, experience_id, CAST(rank AS INT) AS rank FROM (SELECT query_id, doc_id AS experience_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE doc_id IN (SELECT experience_id FROM e)) WHERE rank <= 5"""),
}
ORACLES.update(CHECKS)
