"""Benchmark decontamination: windows of benchmark items looked up by hash, verified as text. Built-in functions only.

A window of a document is only built around an anchor: the longest word of some benchmark window (the first in order among equals). An occurrence of a window
holds its anchor, so none is lost. Anchors and windows are hashed into bitmaps, which are constants of the plan: a text's word costs one bit test, and a
window that is built costs another. What passes both, hardly more than the occurrences, is joined with the windows and compared as text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.llm.scratch import keep, tidy, unused

#: A bitmap has so many bits for each entry, but no more than so many bytes: beyond some million entries more places are tried, with the same result.
BITS_EACH = 16
BITMAP_BYTES = 2**20
#: Up to so many windows are broadcast (about 150 bytes each); above it the join shuffles what passed the bitmaps.
BROADCAST_WINDOWS = 300_000
BROADCAST_ROWS = 1_000_000

_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_AZ = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _words(text: Column) -> Column:
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), *_AZ), _BREAK), lambda w: w != "")


def benchmark_windows(benchmark: DataFrame, item_col: str, text_col: str, width: int) -> DataFrame:
    """``(key, m, anchor, item)`` for each distinct window of each item: its words joined by spaces, how many, its anchor, and the item's id, or null."""
    items = benchmark.select(F.col(f"`{item_col}`").cast("string").alias("item"), _words(F.col(f"`{text_col}`")).alias("w"))
    items = items.withColumn("m", F.least(F.size("w"), F.lit(width))).where("m > 0")
    windows = items.select("item", "m", F.explode(F.expr("transform(sequence(1, size(w) - m + 1), i -> slice(w, i, m))")).alias("w"))
    anchor = F.expr("array_min(transform(w, x -> named_struct('n', -length(x), 'x', x))).x")
    return windows.select(F.array_join("w", " ").alias("key"), "m", anchor.alias("anchor"), "item").distinct()


def bitmap(hashes: DataFrame, count: int) -> bytes:
    """The hashes' bits, seven a byte (so that a byte is a character); at most ``BITMAP_BYTES`` rows reach the driver."""
    size = 64
    while 7 * size < BITS_EACH * count and size < BITMAP_BYTES:
        size *= 2
    at = F.pmod(F.col(hashes.columns[0]), F.lit(7 * size))
    bits = hashes.select((at / 7).cast("int").alias("byte"), F.call_function("shiftleft", F.lit(1), (at % 7).cast("int")).alias("bit"))
    out = bytearray(size)
    for row in bits.groupBy("byte").agg(F.bit_or("bit").alias("bits")).collect():
        out[row["byte"]] = row["bits"]
    return bytes(out)


def in_bitmap(bits: bytes, h: Column) -> Column:
    at = F.pmod(h, F.lit(7 * len(bits)))
    byte = F.ascii(F.substring(F.lit(bits), (at / 7).cast("int") + 1, F.lit(1)).cast("string"))
    return F.call_function("shiftright", byte, (at % 7).cast("int")).bitwiseAND(F.lit(1)) == 1


def _places_of(anchors: bytes, shortest: int) -> Column:
    return F.array_compact(F.transform("w", lambda x, i: F.when((F.length(x) >= shortest) & in_bitmap(anchors, F.xxhash64(x)), i)))


def _with_width(starts: Column, m: int) -> Column:
    return F.transform(starts, lambda s: F.struct(s.alias("at"), F.lit(m).alias("m")))


def find_hits(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, item_col: str, item_text_col: str, width: int) -> DataFrame:
    """One row for each row of ``docs``: ``id``, ``t64`` (hash of the text), ``n_words``, ``spans`` [(at, m)], ``items``."""
    of_items = keep(benchmark_windows(benchmark, item_col, item_text_col, width), "windows-of-items")
    windows = keep(of_items.select("key", "m", "anchor").distinct().withColumn("window", F.monotonically_increasing_id()), "windows")
    about = windows.groupBy("m").agg(F.count("*").alias("n"), F.count_distinct("anchor").alias("anchors"), F.min(F.length("anchor")).alias("shortest")).collect()  # at most `width` rows
    count = sum(x["n"] for x in about)
    df = docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(F.col(f"`{text_col}`")).alias("t64"), _words(F.col(f"`{text_col}`")).alias("w"))
    places = [F.expr("CAST(array() AS array<struct<at:int,m:int>>)")]
    for row in sorted(about, key=lambda x: x["m"]):
        m = row["m"]
        anchors = bitmap(windows.where(F.col("m") == m).select(F.xxhash64("anchor")).distinct(), row["anchors"])
        df = df.withColumn(f"a{m}", _places_of(anchors, row["shortest"]))
        starts = F.expr(f"array_distinct(flatten(transform(a{m}, p -> filter(sequence(p - {m - 1}, p), s -> s >= 0 AND s + {m} <= size(w)))))")
        places.append(_with_width(starts, m))
    known = bitmap(windows.select(F.xxhash64("key", "m")), count)
    df = df.withColumn("places", F.concat(*places))
    tried = F.expr("transform(places, p -> named_struct('at', p.at, 'm', p.m, 'key', array_join(slice(w, p.at + 1, p.m), ' ')))")
    df = df.select("id", "t64", F.size("w").cast("long").alias("n_words"), F.filter(tried, lambda p: in_bitmap(known, F.xxhash64(p["key"], p["m"]))).alias("tried"))
    df = df.select("id", "t64", "n_words", F.posexplode_outer("tried").alias("nth", "p"))
    table = windows.select(F.col("key").alias("k"), F.col("m").alias("km"), "window")
    df = df.join(F.broadcast(table) if count <= BROADCAST_WINDOWS else table, (F.col("p.key") == F.col("k")) & (F.col("p.m") == F.col("km")), "left")
    df = keep(df.where("k IS NOT NULL OR nth IS NULL OR nth = 0").select("id", "t64", "n_words", "nth", "p.at", "p.m", "window"), "hits")
    found = df.groupBy("id", "t64", "n_words").agg(
        F.sum((F.col("nth").isNull() | (F.col("nth") == 0)).cast("int")).alias("rows"),
        F.sort_array(F.collect_set(F.when(F.col("window").isNotNull(), F.struct("at", "m")))).alias("spans"),
    )
    # a window may be of many items: their ids meet the documents that it hits only now
    listed = windows.join(of_items.where("item IS NOT NULL"), ["key", "m"]).select("window", "item")
    hits = df.where("window IS NOT NULL").select("id", "t64", "window").distinct().join(listed, "window").groupBy(F.col("id").alias("of"), F.col("t64").alias("at")).agg(F.sort_array(F.collect_set("item")).alias("items"))
    found = found.join(hits, F.col("id").eqNullSafe(F.col("of")) & (F.col("t64") == F.col("at")), "left").select("id", "t64", "n_words", "rows", "spans", F.coalesce("items", F.array().cast("array<string>")).alias("items"))
    # rows that are the same in id and text were counted together
    return found.withColumn("row", F.explode(F.sequence(F.lit(1), F.col("rows")))).drop("row", "rows")


@tidy
def contamination(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", width: int = 13, share: int = 20
) -> DataFrame:
    """One row a row of ``docs``: id, ``t64``, ``n_words``, ``n_hit`` (words inside benchmark windows), ``items`` found, ``contaminated``, ``spans``.

    Words are runs of a-z (A-Z lower-cased), 0-9 and all beyond ASCII. A window is ``width`` consecutive words of an item, or the whole
    item if it has fewer. Contaminated: some word hit, and ``share`` * n_hit >= n_words. Null and empty texts have no words and no hits;
    null and wordless items have no windows; windows of items without an id hit, but are not in ``items``; an empty benchmark hits nothing; an empty table gives no rows.
    Repeated rows give one row each; other columns are ignored.
    """
    found = find_hits(docs, benchmark, id_col, text_col, item_col, item_text_col, width)
    n_hit = F.expr("aggregate(spans, named_struct('e', 0, 'n', 0L), (a, x) -> named_struct('e', greatest(a.e, x.at + x.m), 'n', a.n + greatest(0, x.at + x.m - greatest(a.e, x.at))), a -> a.n)")
    found = found.withColumn("n_hit", n_hit)
    return found.withColumn("contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words")))


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "documents", id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without contaminated rows (``remove="documents"``), or with the hit words cut out of all texts (``"spans"``).

    A cut takes the words and what follows them up to the next word. Columns stay as they are, whatever their names. Rows with null or empty texts stay, with or without an
    id; rows that are the same in id and text have one verdict; an empty benchmark removes nothing, and an empty table stays empty.
    """
    about = contamination(docs, benchmark, id_col, text_col, **options)
    name, hash_, places = unused(docs, "__id", "__t64", "__spans")
    key = [F.col(f"`{id_col}`").eqNullSafe(F.col(name)), F.xxhash64(F.col(f"`{text_col}`")) == F.col(hash_)]
    if remove == "documents":
        gone = about.where("contaminated").select(F.col("id").alias(name), F.col("t64").alias(hash_)).distinct()
        gone = keep(gone, "contaminated")
        few = gone.count() <= BROADCAST_ROWS
        return docs.join(F.broadcast(gone) if few else gone, key, "left_anti")
    spans = about.where("n_hit > 0").select(F.col("id").alias(name), F.col("t64").alias(hash_), F.col("spans").alias(places)).dropDuplicates([name, hash_])
    word = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    lead = F.regexp_extract(F.col(f"`{text_col}`"), r"\A" + _BREAK.replace(r"\x3A-\x60", r"\x3A-\x40\x5B-\x60"), 0)
    pieces = F.regexp_extract_all(F.col(f"`{text_col}`"), F.lit(word + r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*"), F.lit(0))
    left = F.filter(pieces, lambda x, i: ~F.exists(places, lambda s: (s["at"] <= i) & (i < s["at"] + s["m"])))
    out = docs.join(spans, key, "left")
    cut = F.when(F.col(places).isNull(), F.col(f"`{text_col}`")).otherwise(F.concat(lead, F.array_join(left, "")))
    return out.select(*(cut.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns))
