"""Redaction, review flags and the strict check for publication. Rules are data: pass your own list."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StringType, StructType

from tracelake.functions.redaction_rules import CARD_LIKE, EMPLOYEE_PREFIXES, HINTS, PHONE_DIGITS, REDACTION_RULES, REVIEW_RULES, STRICT_RULES

def _java(pattern: str) -> str:
    """The same classes as Python's: Unicode words and digits."""
    return "(?U)" + pattern


def luhn(digits: str) -> bool:
    doubled = [(ord(d) - 48) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
    return sum(x - 9 if x > 9 else x for x in doubled) % 10 == 0


def _card(match: str) -> bool:
    digits = re.sub("[ -]", "", match)
    return digits.isascii() and digits.isdigit() and 13 <= len(digits) <= 19 and luhn(digits)


def _phone(match: str) -> bool:
    return PHONE_DIGITS[0] <= sum(c.isdigit() for c in match) <= PHONE_DIGITS[1]


#: Keys whose values are identifiers or structure; their strings stay as they are.
STRUCTURAL_KEYS = frozenset(("id", "type", "role", "tool_use_id", "tool_call_id", "name", "subtype", "model", "stop_reason", "stop_sequence", "usage", "index"))
#: What the strict check passes over as well.
UNCHECKED_KEYS = STRUCTURAL_KEYS | {"ts", "tool_result_for"}


class Redactor:
    """The rules, compiled; each sees what the earlier ones left. A rule runs only where its cheap hint is met."""

    def __init__(self, rules: list[tuple[str, str, str, str]] = REDACTION_RULES, domains: tuple[str, ...] = (), prefixes: tuple[str, ...] = EMPLOYEE_PREFIXES):
        rules = [*rules, *(("internal_host", rf"(?i)\b(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)*{re.escape(d)}\b", "<INTERNAL_HOST>", "low") for d in domains)]
        if prefixes:
            rules.append(("employee_id", rf"(?i)\b(?:{'|'.join(map(re.escape, prefixes))})[-_]?\d{{4,8}}\b", "<EMP_ID>", "low"))
        self.rules = []
        for name, pattern, placeholder, severity in rules:
            hint = HINTS.get(name) if name != "employee_id" or prefixes == EMPLOYEE_PREFIXES else None
            words = hint if isinstance(hint, tuple) else ()
            quick = re.compile(hint) if isinstance(hint, str) else None
            passes = _card if pattern == "luhn" else _phone if name == "phone_intl" else None
            self.rules.append((name, re.compile(CARD_LIKE if pattern == "luhn" else pattern), placeholder, severity == "high", words, quick, passes))

    def __call__(self, text: str, counts: dict[str, int]) -> tuple[str, bool]:
        """The text left, and whether a rule of high severity matched; what matched is added to ``counts``."""
        high = False
        for name, rx, placeholder, severe, words, quick, passes in self.rules:
            if words and not any(w in text for w in words) or quick and not quick.search(text):
                continue
            if passes is None:
                text, n = rx.subn(placeholder, text)
            else:
                found = [m for m in rx.finditer(text) if passes(m[0])]
                n = len(found)
                for m in reversed(found):
                    text = text[: m.start()] + placeholder + text[m.end() :]
            if n:
                counts[name] = counts.get(name, 0) + n
                high = high or severe
        return text, high

    def tree(self, node, counts: dict[str, int]):
        """Every string of nested lists and objects but those under structural keys."""
        if isinstance(node, str):
            return self(node, counts)
        if isinstance(node, list):
            done = [self.tree(x, counts) for x in node]
            return [x for x, _ in done], any(h for _, h in done)
        if isinstance(node, dict):
            done = {k: (v, False) if k in STRUCTURAL_KEYS else self.tree(v, counts) for k, v in node.items()}
            return {k: x for k, (x, _) in done.items()}, any(h for _, h in done.values())
        return node, False


_REDACTED = "text string, names array<string>, counts array<int>, is_high boolean"


def _redactor(*rules, nested: bool = False):
    """One vectorised pass of all rules over texts, or over JSON texts with ``nested``."""

    def run(texts: pd.Series) -> pd.DataFrame:
        redactor, out = Redactor(*rules), []
        for text in texts:
            counts: dict[str, int] = {}
            high = False
            if text is not None:
                if nested:
                    tree, high = redactor.tree(json.loads(text), counts)
                    text = json.dumps(tree, ensure_ascii=False)
                else:
                    text, high = redactor(text, counts)
            out.append((text, list(counts), list(counts.values()), high))
        return pd.DataFrame(out, columns=["text", "names", "counts", "is_high"])

    return F.pandas_udf(run, _REDACTED)


def _reported(df: DataFrame) -> DataFrame:
    return df.withColumn("redactions", F.map_from_arrays("__r.names", "__r.counts")).withColumn("is_high", F.col("__r.is_high")).drop("__r")


def redact(rows: DataFrame, column: str, rules: list[tuple[str, str, str, str]] = REDACTION_RULES, domains: tuple[str, ...] = (), prefixes: tuple[str, ...] = EMPLOYEE_PREFIXES) -> DataFrame:
    """``rows`` with ``column`` redacted, ``redactions`` (map of category to count) and ``is_high``. Each rule sees what the earlier ones left. Null texts stay null."""
    df = rows.withColumn("__r", _redactor(rules, domains, prefixes)(column)).withColumn(column, F.col("__r.text"))
    return _reported(df)


def _has_text(kind: DataType) -> bool:
    if isinstance(kind, StructType):
        return any(f.name not in STRUCTURAL_KEYS and _has_text(f.dataType) for f in kind)
    if isinstance(kind, ArrayType):
        return _has_text(kind.elementType)
    return _has_text(kind.valueType) if isinstance(kind, MapType) else isinstance(kind, StringType)


def _texts_of(c: Column, kind: DataType) -> Column:
    """The same nesting with its strings alone."""
    if isinstance(kind, StructType):
        return F.when(c.isNotNull(), F.struct(*(_texts_of(c.getField(f.name), f.dataType).alias(f.name) for f in kind if f.name not in STRUCTURAL_KEYS and _has_text(f.dataType))))
    if isinstance(kind, ArrayType):
        return F.transform(c, lambda x: _texts_of(x, kind.elementType))
    return F.transform_values(c, lambda _, v: _texts_of(v, kind.valueType)) if isinstance(kind, MapType) else c


def _put_back(c: Column, texts: Column, kind: DataType) -> Column:
    """``c`` with its strings replaced by those of ``texts``; all else is the value itself."""
    if isinstance(kind, StructType):
        put = lambda f: _put_back(c.getField(f.name), texts.getField(f.name), f.dataType) if f.name not in STRUCTURAL_KEYS and _has_text(f.dataType) else c.getField(f.name)
        return F.when(c.isNotNull(), F.struct(*(put(f).alias(f.name) for f in kind)))
    if isinstance(kind, ArrayType):
        return F.zip_with(c, texts, lambda x, t: _put_back(x, t, kind.elementType)) if _has_text(kind.elementType) else c
    if isinstance(kind, MapType):
        return F.transform_values(c, lambda k, v: _put_back(v, F.element_at(texts, k), kind.valueType)) if _has_text(kind.valueType) else c
    return texts


def redact_tree(rows: DataFrame, columns: list[str], rules: list[tuple[str, str, str, str]] = REDACTION_RULES, domains: tuple[str, ...] = (), prefixes: tuple[str, ...] = EMPLOYEE_PREFIXES) -> DataFrame:
    """``rows`` with every string inside ``columns`` redacted, however deeply nested (tool arguments, results, blocks).

    Only strings go through the rules; times, numbers and binary values stay the very values that they were. Strings under ``STRUCTURAL_KEYS`` stay as well, so that messages
    keep their places. Maps have string keys. Adds ``redactions`` and ``is_high``.
    """
    kinds = {c: rows.schema[c].dataType for c in columns}
    some = {c: kind for c, kind in kinds.items() if _has_text(kind)}
    skeleton = F.struct(*(_texts_of(F.col(c), kind).alias(c) for c, kind in some.items())) if some else F.struct(F.lit(None).cast("string").alias("none"))
    shape = rows.select(skeleton.alias("__s")).schema["__s"].dataType
    df = rows.withColumn("__r", _redactor(rules, domains, prefixes, nested=True)(F.to_json(skeleton)))
    df = df.withColumn("__t", F.from_json("__r.text", shape))
    return _reported(df.withColumns({c: _put_back(F.col(c), F.col("__t").getField(c), kind) for c, kind in some.items()})).drop("__t")


def review_flags(rows: DataFrame, key: str, column: str) -> DataFrame:
    """``(key, rule, n)`` of what a person should look at; nothing is replaced."""
    return _count_rules(rows, key, column, REVIEW_RULES)


def review_findings(rows: DataFrame, key: str, column: str) -> DataFrame:
    """``(key, rule, start, end, snippet)`` of what a person should look at, by code points; a name without what announces it, cards that pass Luhn only."""

    def run(texts: pd.Series) -> pd.Series:
        out, rules = [], [(name, re.compile(p)) for name, p in REVIEW_RULES]
        for text in texts:
            own = []
            for name, rx in rules:
                for m in rx.finditer(text or ""):
                    s, e = m.span(1) if name == "person" else m.span()
                    if name != "card_like" or _card(m[0]):
                        own.append({"rule": name, "start": s, "end": e, "snippet": m.string[s:e]})
            out.append(own)
        return pd.Series(out)

    found = F.pandas_udf(run, "array<struct<rule:string,start:int,end:int,snippet:string>>")
    return rows.select(key, F.explode(found(column)).alias("x")).select(key, "x.*")


def strict_hits(rows: DataFrame, key: str, column: str) -> DataFrame:
    """``(key, rule, n)`` of what may not be public."""
    return _count_rules(rows, key, column, STRICT_RULES)


def strict_findings(rows: DataFrame, key: str, columns: list[str], preview: int = 120) -> DataFrame:
    """``(key, rule, location, snippet, preview)`` of what may not be public in any string of ``columns``; the location is a path like ``calls[2].input``."""

    def run(trees: pd.Series) -> pd.Series:
        rules = [(name, re.compile(p)) for name, p in STRICT_RULES]

        def walk(node, path: str) -> Iterator[dict]:
            if isinstance(node, str):
                for name, rx in rules:
                    for m in rx.finditer(node):
                        yield {"rule": name, "location": path, "snippet": m[0], "preview": m[0][:preview]}
            elif isinstance(node, list):
                for i, x in enumerate(node):
                    yield from walk(x, f"{path}[{i}]")
            elif isinstance(node, dict):
                for k, v in node.items():
                    if k not in UNCHECKED_KEYS:
                        yield from walk(v, f"{path}.{k}" if path else k)

        return pd.Series([list(walk(json.loads(t), "")) for t in trees])

    found = F.pandas_udf(run, "array<struct<rule:string,location:string,snippet:string,preview:string>>")
    return rows.select(key, F.explode(found(F.to_json(F.struct(*columns)))).alias("x")).select(key, "x.*")


def _count_rules(rows: DataFrame, key: str, column: str, rules: list[tuple[str, str]]) -> DataFrame:
    found = F.array(*(F.struct(F.lit(name).alias("rule"), F.regexp_count(F.col(column), F.lit(_java(p))).cast("long").alias("n")) for name, p in rules))
    return rows.select(key, F.explode(F.filter(found, lambda x: x["n"] > 0)).alias("x")).select(key, "x.rule", "x.n")


def status(is_high: Column, changed: Column, n_flags: Column, sensitivity: Column) -> Column:
    """human_review for high findings, flagged for any change or flag, else done; flags of clean rows of low sensitivity are not looked at."""
    flags = F.when((sensitivity == "low") & ~changed, 0).otherwise(F.coalesce(n_flags, F.lit(0)))
    return F.when(is_high, "human_review").when(changed | (flags > 0), "flagged").otherwise("done")


def splice(rows: DataFrame, column: str, spans: str) -> DataFrame:
    """Replace a model's spans (array of start, end, label) by ``<LABEL>``, right to left; a ``secret`` label makes the row high."""

    def run(texts: pd.Series, found: pd.Series) -> pd.Series:
        out = []
        for text, own in zip(texts, found, strict=True):
            end = len(text or "")
            for s in sorted(own if own is not None else [], key=lambda x: -x["start"]):
                if text is not None and 0 <= s["start"] < s["end"] <= end:
                    text = f"{text[: s['start']]}<{s['label'].upper()}>{text[s['end'] :]}"
                    end = s["start"]
            out.append(text)
        return pd.Series(out)

    high = F.coalesce(F.exists(spans, lambda x: F.lower(x["label"]).contains("secret")), F.lit(False))
    return rows.withColumn("is_high", high).withColumn(column, F.pandas_udf(run, "string")(column, spans))


def audit(redacted: DataFrame, key: str, top: int = 20) -> tuple[DataFrame, DataFrame]:
    """Totals by category, and the rows with most redactions."""
    each = redacted.select(key, F.explode("redactions").alias("category", "n"))
    totals = each.groupBy("category").agg(F.sum("n").alias("n"), F.count_distinct(key).alias("rows"))
    worst = each.groupBy(key).agg(F.sum("n").alias("n")).orderBy(F.desc("n"), key).limit(top)
    return totals, worst
