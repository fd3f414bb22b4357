"""Host-level quality rules: failures by host, shrunk by an empirical beta prior, joined back to documents.

Built-in functions only. Text features are made once, in one scan, and kept; what is shuffled is one row a host and task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.llm.scratch import keep, unused

#: Host verdicts are broadcast up to so many hosts (a name, two counts and a rate each); above it the join shuffles.
BROADCAST_HOSTS = 100_000
#: Keys of rejected rows are broadcast up to so many.
BROADCAST_ROWS = 1_000_000

_SPACE = r"[\x20\x09-\x0D]+"
_NONSPACE = r"[^\x20\x09-\x0D]"
_Q = "__quality"


def text_features(df: DataFrame, text: Column) -> DataFrame:
    """Adds the struct ``__quality``: n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words."""
    df = df.withColumn(_Q, F.struct(F.coalesce(text, F.lit("")).alias("t")))
    df = df.withColumn(
        _Q,
        F.struct(
            F.filter(F.split(F.col(f"{_Q}.t"), _SPACE), lambda w: w != "").alias("w"),
            F.filter(F.split(F.col(f"{_Q}.t"), "\n"), lambda x: x.rlike(_NONSPACE)).alias("lines"),
            F.regexp_count(F.col(f"{_Q}.t"), F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        ),
    )
    windows = F.expr(f"transform({_Q}.w, (x, i) -> IF(i + 2 < size({_Q}.w), xxhash64(x, {_Q}.w[i + 1], {_Q}.w[i + 2]), NULL))")
    df = df.withColumn(
        _Q,
        F.struct(
            F.size(f"{_Q}.w").cast("long").alias("n_words"),
            F.length(F.array_join(f"{_Q}.w", "")).cast("long").alias("word_chars"),
            f"{_Q}.n_symbols",
            F.size(f"{_Q}.lines").cast("long").alias("n_lines"),
            (F.size(f"{_Q}.lines") - F.size(F.array_distinct(f"{_Q}.lines"))).cast("long").alias("n_dup_lines"),
            F.array_compact(windows).alias("h"),
        ),
    )
    # windows with their places in order of the hash, only where some window is found twice
    order = F.expr(
        f"IF(size(array_distinct({_Q}.h)) < size({_Q}.h), sort_array(transform({_Q}.h, (x, i) -> named_struct('h', x, 'i', i))),"
        " CAST(array() AS array<struct<h:bigint,i:int>>))"
    )
    df = df.withColumn(_Q, F.struct(*(f"{_Q}.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines")), order.alias("s")))
    repeated = F.expr(
        f"aggregate(sort_array(filter(transform({_Q}.s, (x, j) -> IF((j > 0 AND {_Q}.s[j - 1].h = x.h) OR (j + 1 < size({_Q}.s) AND {_Q}.s[j + 1].h = x.h), x.i, NULL)),"
        " p -> p IS NOT NULL)), named_struct('e', 0, 'n', 0L), (a, p) -> named_struct('e', p + 3, 'n', a.n + 3 - greatest(0, a.e - p)), a -> a.n)"
    )
    return df.withColumn(_Q, F.struct(*(f"{_Q}.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines")), repeated.alias("n_repeat_words")))


def host_quality(
    docs: DataFrame, text_col: str = "text", host_col: str = "source", carry: list[str] | None = None, max_rate: float = 0.5,
    max_symbols: float = 0.1, max_dup_lines: float = 0.3, word_length: tuple[float, float] = (2.0, 15.0),
) -> DataFrame:
    """``carry`` (default: all columns) and the struct ``__quality`` of each row of ``docs``.

    The struct has the text features, ``base_failed`` (under 50 words, or over half of the words in repeated 3-word windows), ``failed`` (that,
    or too many symbols, duplicate lines or odd word lengths), ``host_rate`` and ``kept``. A host's rate of failed documents is shrunk:
    ``(failed + k m) / (rows + k)``, with the mean ``m`` and strength ``k`` of a beta distribution fitted by moments to all hosts' rates. A
    document stays if it has not failed the base rules and its host's rate is at most ``max_rate``.

    Null and empty texts have no words and fail. Null hosts are one host. Repeated rows count each. Empty table: no rows. A column of
    ``docs`` named ``__quality`` is left out; all other names are free.
    """
    carry = [c for c in docs.columns if c.lower() != _Q] if carry is None else carry
    df = text_features(docs.select(*(F.col(f"`{c}`") for c in dict.fromkeys([*carry, host_col, text_col]))), F.col(f"`{text_col}`"))
    q = lambda c: F.col(f"{_Q}.{c}")
    base = (q("n_words") < 50) | (100 * q("n_repeat_words") > 50 * q("n_words"))
    odd = (q("word_chars") < word_length[0] * q("n_words")) | (q("word_chars") > word_length[1] * q("n_words"))
    failed = base | (q("n_symbols") > max_symbols * q("word_chars")) | (q("n_dup_lines") > max_dup_lines * q("n_lines")) | odd
    df = df.withColumn(_Q, F.struct(f"{_Q}.*", base.alias("base_failed"), failed.alias("failed"), F.col(f"`{host_col}`").alias("host")))
    df = keep(df.select(*(F.col(f"`{c}`") for c in carry), _Q), "quality")

    name, rated = unused(df, "__host", "__rate")
    hosts = df.groupBy(F.col(f"{_Q}.host").alias(name)).agg(F.count("*").alias("__n"), F.sum(q("failed").cast("long")).alias("__f"))
    rate = F.col("__f") / F.col("__n")
    prior = hosts.agg(F.avg(rate).alias("m"), F.var_pop(rate).alias("v"), F.count("*").alias("hosts")).first()  # one row
    m, v = prior["m"] or 0.0, prior["v"] or 0.0
    k = max(1.0, min(1e6, m * (1 - m) / v - 1)) if v > 0 else 1e6
    few = prior["hosts"] <= BROADCAST_HOSTS
    hosts = hosts.select(name, ((F.col("__f") + k * m) / (F.col("__n") + k)).alias(rated))
    out = df.join(F.broadcast(hosts) if few else hosts, q("host").eqNullSafe(F.col(name)), "left")
    kept = ~q("base_failed") & (F.col(rated) <= max_rate)
    return out.withColumn(_Q, F.struct(f"{_Q}.*", F.col(rated).alias("host_rate"), kept.alias("kept"))).drop(name, rated)


def keep_good(docs: DataFrame, text_col: str = "text", host_col: str = "source", id_col: str = "doc_id", **rules) -> DataFrame:
    """The rows of ``docs`` that ``host_quality`` keeps, with their own columns. Texts are not written or shuffled if the rejected rows are few.

    Null and empty texts fail by their length and go; null hosts are one host; null ids are taken like others. Rows that are the same in id, text and host have one verdict. An empty table
    stays empty. Columns keep their names, whatever they are.
    """
    key = docs.select(F.col(f"`{id_col}`").alias("__id"), F.xxhash64(F.col(f"`{text_col}`")).alias("__t64"), F.col(f"`{text_col}`").alias("__text"), F.col(f"`{host_col}`").alias("__from"))
    rated = host_quality(key, "__text", "__from", ["__id", "__t64", "__from"], **rules)
    gone = keep(rated.where(f"NOT {_Q}.kept").select("__id", "__t64", "__from").distinct(), "rejected")
    few = gone.count() <= BROADCAST_ROWS
    gone = gone.toDF(*(names := unused(docs, "__id", "__t64", "__from")))
    same = F.col(f"`{id_col}`").eqNullSafe(F.col(names[0])) & (F.xxhash64(F.col(f"`{text_col}`")) == F.col(names[1])) & F.col(f"`{host_col}`").eqNullSafe(F.col(names[2]))
    return docs.join(F.broadcast(gone) if few else gone, same, "left_anti")
