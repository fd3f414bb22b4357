"""Text functions of retrieval: tokens, terms, titles, outcome words."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that show how something ended.
FAILURE = ("error", "failed", "failure", "exception", "traceback", "fatal", "denied", "not found", "timed out")
SUCCESS = ("success", "succeeded", "passed", "completed", "done", "ok", "fixed", "resolved")
ACKNOWLEDGEMENTS = ("ok", "okay", "yes", "no", "thanks", "thank you", "continue", "go on", "hi", "hello", "好的", "继续", "谢谢", "是的", "你好")
AGENTS = ("claude-code", "codex", "cursor", "hermes", "openclaw")

_MIXED = re.compile(r"[a-z0-9_+#.-]+|[一-鿿]+")


def mixed_tokens(text: str | None) -> list[str]:
    """Identifier runs and their parts, and CJK bigrams and trigrams, in order without repeats."""
    out: dict[str, None] = {}
    for run in _MIXED.findall((text or "").lower()):
        if run[0] >= "一":
            for n in (2, 3):
                for i in range(len(run) - n + 1):
                    out[run[i : i + n]] = None
            if len(run) == 1:
                out[run] = None
            continue
        out[run] = None
        for part in re.split(r"[_+#.\-]+", run):
            if len(part) > 1:
                out[part] = None
            if len(part) > 8 and re.search(r"\d", part) and re.search(r"[a-z]", part):
                for i in range(len(part) - 3):
                    out[part[i : i + 4]] = None
    return list(out)


def tokens_udf(column: str) -> Column:
    import pandas as pd

    return F.pandas_udf(lambda s: pd.Series([mixed_tokens(x) for x in s]), "array<string>")(column)


def lexical_score(query_terms: Column, row_terms: Column) -> Column:
    """0.85 coverage + 0.15 root of precision, clamped; both sides hold distinct terms."""
    overlap = F.size(F.array_intersect(query_terms, row_terms))
    coverage, precision = overlap / F.greatest(F.size(query_terms), F.lit(1)), overlap / F.greatest(F.size(row_terms), F.lit(1))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.85 * coverage + 0.15 * F.sqrt(precision)))


def outcome(text: Column) -> Column:
    """failure, success or unknown, by words; failure wins."""
    low = F.lower(F.coalesce(text, F.lit("")))
    any_of = lambda words: low.rlike(r"(?<![\p{L}\p{N}_])(" + "|".join(map(re.escape, words)) + r")(?![\p{L}\p{N}_])")
    return F.when(any_of(FAILURE), "failure").when(any_of(SUCCESS), "success").otherwise("unknown")


def has_signal(text: Column) -> Column:
    """A query worth a search: not an acknowledgement, at least three characters or a letter with a digit."""
    t = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"^[\s\p{Punct}]+|[\s\p{Punct}]+$", "")
    return ~t.isin(*ACKNOWLEDGEMENTS) & (t != "") & ((F.length(t) >= 3) | (t.rlike(r"\p{L}") & t.rlike(r"\d")) | t.rlike("[一-鿿]{2}"))


def title(text: Column, limit: int = 70) -> Column:
    """The first line with text, up to its first sentence end, clipped."""
    first = F.regexp_extract(F.coalesce(text, F.lit("")), r"(?m)^\s*(\S.*)$", 1)
    sentence = F.regexp_extract(first, r"^(.+?[.!?。！？])(\s|$)", 1)
    return F.substring(F.rtrim(F.when(sentence != "", sentence).otherwise(first)), 1, limit)


def bad_title(text: Column) -> Column:
    t = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    return (t == "") | t.endswith("...") | t.endswith("…") | t.startswith("http") | t.startswith("```") | t.startswith("<") | t.contains("\n")


def agent_type(task_type: Column) -> Column:
    """The first known agent named in a task type."""
    c = F.lit(None).cast("string")
    for name in reversed(AGENTS):
        c = F.when(task_type.contains(name), name).otherwise(c)
    return F.coalesce(c, F.lit("unknown"))


def chunk_id(experience: Column, index: Column, kind: Column, text: Column) -> Column:
    zero = F.unhex(F.lit("00"))
    parts = [x for c in (experience, index, kind, text) for x in (zero, F.encode(c.cast("string"), "UTF-8"))][1:]
    return F.concat(F.lit("chk_"), F.substring(F.sha1(F.concat(*parts)), 1, 24))


def token_estimate(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("int")
