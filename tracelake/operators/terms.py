"""Keywords, query terms, retrieval texts and keyword signals. Stop words, boosts and synonyms are parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracelake.functions.text import tokens_udf
from tracelake.operators.access import acl_kind, acl_team

STOP = ("the", "and", "for", "with", "this", "that", "from", "your", "you", "assistant", "user")
# Tools whose use says little, and shell commands that only look around.
QUIET_TOOLS = (
    "askuserquestion", "enterplanmode", "exitplanmode", "get_goal", "pushnotification", "schedulewakeup", "taskcreate", "taskget", "tasklist", "taskoutput", "taskstop", "taskupdate", "toolsearch", "webfetch",
    "websearch", "update_plan", "exp_push_latest", "exp_push_file",
)
FILE_TOOLS = ("read", "view_image", "edit", "write")
LOOKING = r"^(?:ls|ll|pwd|wc|du|df|tree|find\s+\S+\s+-name|rg\s+--files|git\s+status|git\s+branch)\b"
LABELS = r"(?i)^(summary|task|situation|outcome|intent|query|pitfalls|key decisions|tools|keywords|keyphrases|action):"


def keywords(rows: DataFrame, key: str, text: str, most: int = 32, stop: tuple[str, ...] = STOP, boost: tuple[str, ...] = ()) -> DataFrame:
    """``(key, term, score, rank)``: whole tokens and their parts, by count (to 5), shape and boosts; ties by first place, then term."""
    token = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[a-z][a-z0-9_+#.-]{2,}|[一-鿿]{2,}"), F.lit(0))
    places = rows.select(key, F.posexplode(F.transform(token, lambda t: F.regexp_replace(t, r"^[._-]+|[._-]+$", ""))).alias("at", "token"))
    parts = F.filter(F.split("token", "[^a-z0-9+#]+"), lambda p: F.length(p) >= 3)
    cjk = F.filter(F.flatten(F.transform(F.sequence(F.lit(2), F.lit(4)), lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("token") - n + 1)), lambda i: F.substring(F.col("token"), i, n)))), lambda g: F.length(g) >= 2)
    out = F.when(F.col("token").rlike("^[一-鿿]"), cjk).otherwise(F.array_union(F.array("token"), F.when(F.size(parts) > 1, parts).otherwise(F.expr("CAST(array() AS array<string>)"))))
    terms = places.select(key, "at", F.explode(F.array_distinct(out)).alias("term"))
    boosted = F.col("term").isin(*boost) if boost else F.lit(False)
    short = F.col("term").rlike("^[a-z]+$") & (F.length("term") < 4) & ~boosted
    terms = terms.where((F.col("term") != "") & (F.length("term") <= 40) & ~F.col("term").isin(*stop) & ~short)
    counts = terms.groupBy(key, "term").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    t = F.col("term")
    points = lambda c, p: F.when(c, p).otherwise(0)
    score = (
        F.least("n", F.lit(5)) + points(boosted, 12) + points(t.contains("_"), 8) + points(t.rlike("[a-z][0-9]|[0-9][a-z]"), 6) + points(t.rlike("error|exception|traceback|assertion|failed|unknown|timeout|404|403|500"), 4)
        + points(t.rlike("[.#+]"), 2) - points(t.rlike("^[a-z]{1,5}$") & ~boosted, 2) + points(t.rlike("^[一-鿿]{3,}"), 2)
    )
    w = W.partitionBy(key).orderBy(F.desc("score"), "first", "term")
    return counts.withColumn("score", score).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).select(key, "term", "score", "rank")


# Words that queries are widened by.
SYNONYMS = {
    "expool": ("经验池", "experience", "pool"), "rag": ("召回", "检索", "chunk", "切分", "子经验"), "recall": ("召回", "检索"), "chunk": ("切分", "子经验", "片段", "rag"), "chunks": ("切分", "子经验", "片段", "rag"),
    "retrieval": ("召回", "检索", "rag"), "rerank": ("重排", "rerank"), "bm25": ("关键词", "检索"), "经验池": ("expool", "experience", "pool"), "召回": ("rag", "检索", "recall"), "检索": ("rag", "召回", "retrieval"),
    "切分": ("chunk", "子经验", "片段"), "子经验": ("chunk", "切分", "片段"), "关键词": ("bm25", "keyword"), "重排": ("rerank",),
}


def query_terms(queries: DataFrame, synonyms: DataFrame | None = None, builtin: bool = True, stop: tuple[str, ...] = STOP, most: int = 32, cap: int = 40) -> DataFrame:
    """``(query_id, terms)``: valid terms, identifiers first, then longer words; then the built-in synonyms of each, and those of ``synonyms`` (``term``, ``other``), to ``cap``."""
    t = queries.select("query_id", F.posexplode(tokens_udf("text")).alias("at", "term"))
    c, n = F.col("term"), F.length("term")
    latin, digit = c.rlike(r"^[\x00-\x7F]+$"), c.rlike("[0-9]")
    mixed = c.rlike("[a-z][0-9]|[0-9][a-z]")
    noise = (digit & (n <= 5)) | c.rlike("^[a-f0-9]{7,}$") | (c.rlike("^[a-z0-9_-]{6,}$") & digit & ~c.contains("_")) | (c.rlike("^[a-z]+$") & (n < 4))
    ok = ~c.isin(*stop) & F.when(latin, ~noise & ((n >= 4) | c.contains("_") | mixed)).otherwise(n >= 2)
    rank = F.when(latin & (c.contains("_") | mixed), 90).when(latin, 70 + F.least(n, F.lit(12))).otherwise(60 + F.least(n, F.lit(4)))
    t = t.where(ok).withColumn("rn", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc(rank), "at"))).where(F.col("rn") <= most).select("query_id", "term", F.col("rn").alias("place"))
    if synonyms is not None:
        more = t.join(synonyms, "term").select("query_id", F.col("other").alias("term"), (F.col("place") + most).alias("place"))
        t = t.unionByName(more).groupBy("query_id", "term").agg(F.min("place").alias("place"))
    terms = F.transform(F.sort_array(F.collect_list(F.struct("place", "term"))), lambda x: x["term"])
    found = t.groupBy("query_id").agg(terms.alias("terms"))
    if builtin:
        known = F.create_map(*(x for word, others in SYNONYMS.items() for x in (F.lit(word), F.array(*map(F.lit, others)))))
        none = F.expr("CAST(array() AS array<string>)")
        wider = F.flatten(F.transform(F.slice("terms", 1, most), lambda term: F.coalesce(F.try_element_at(known, term), none)))
        found = found.withColumn("terms", F.array_distinct(F.concat("terms", wider)))
    return found.select("query_id", F.slice("terms", 1, cap).alias("terms"))


def keyword_signal(terms: DataFrame, postings: DataFrame, most: int = 300, take: int = 24) -> DataFrame:
    """``(query_id, chunk_id, signal)``: chunks with all terms of a query, or, if there is none, with any; by score, then id; 1 - place / hits.

    postings: ``(term, chunk_id, score)``, one row a term and chunk.
    """
    q = terms.select("query_id", F.slice("terms", 1, take).alias("terms")).select("query_id", F.size("terms").alias("of"), F.explode("terms").alias("term"))
    hits = q.join(postings, "term").groupBy("query_id", "of", "chunk_id").agg(F.count("*").alias("n"), F.sum("score").alias("score"))
    whole = F.max(F.col("n") == F.col("of")).over(W.partitionBy("query_id"))
    hits = hits.withColumn("some_whole", whole).where(~F.col("some_whole") | (F.col("n") == F.col("of")))
    w = W.partitionBy("query_id").orderBy(F.desc(F.round("score", 6)), "chunk_id")
    hits = hits.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)
    return hits.withColumn("hits", F.count("*").over(W.partitionBy("query_id"))).select("query_id", "chunk_id", (1 - (F.col("place") - 1) / F.col("hits")).alias("signal"))


def low_value(tool: Column, action: Column, ending: Column, status: Column) -> Column:
    """Actions that teach nothing: plain file access that worked, planning tools, looking around without a result."""
    name, out = F.regexp_replace(F.lower(tool), "[^a-z0-9_]+", ""), F.trim(F.lower(F.coalesce(ending, F.lit(""))))
    failed = out.contains("<tool_use_error>") | out.rlike(r"\A(error:|failed |failed:|traceback|no such file|file does not exist)") | F.substring(out, 1, 240).contains("permission denied")
    command = F.trim(F.coalesce(F.nullif(F.regexp_extract(F.lower(action), r"\bcommand=([^;}\n]+)", 1), F.lit("")), F.regexp_extract(F.lower(action), r'"command"\s*:\s*"([^"]+)"', 1)))
    return (
        (name.isin(*FILE_TOOLS) & ~failed) | name.isin(*QUIET_TOOLS) | ((name == "write_stdin") & (out.contains("process running with session id") | F.lower(action).rlike(r'"chars"\s*:\s*""')))
        | ((name == "bash") & (status == "unknown") & command.rlike(LOOKING))
    )


def retrieval_line(line: Column, limit: int = 360) -> Column:
    """An action for the index: secrets, paths and ids out, clipped; what is still unfit is named by its tool only."""
    c = F.trim(F.regexp_replace(F.coalesce(line, F.lit("")), r"\s+", " "))
    c = F.regexp_replace(c, r"(?i)(secret|password|api[_-]?key|agent[_-]?secret|credential|token)\s*[:=]\s*[^\s,;}]+", "$1=<redacted>")
    c = F.regexp_replace(c, r"(?:[A-Za-z]:)?(?:[/\\][^/\\\s'\"]+){2,}[/\\]([^/\\\s'\"]+)", "<path>/$1")
    c = F.regexp_replace(c, r"(?i)\b(?:[0-9a-f]{12,}|[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12})\b", "<id>")
    c = F.substring(c, 1, limit)
    low = F.lower(c)
    unfit = low.rlike("secret|password|api[_-]?key|credential|token") | (F.regexp_count(c, F.lit("/")) >= 3) | (F.regexp_count(c, F.lit(r"[{}\[\]]")) >= 6)
    tool = F.regexp_extract(c, r"(?i)^action:\s*(?:tool\s+)?([A-Za-z0-9_.:-]+)", 1)
    return F.when(~unfit, c).when(tool != "", F.concat(F.lit("Action tool: "), tool)).otherwise("")


def retrieval_text(text: Column, limit: int = 1000, lines: int = 10) -> Column:
    """The labelled lines of a chunk, or the head of a text without any."""
    kept = F.slice(F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: x.rlike(LABELS)), 1, lines)
    made = F.transform(kept, lambda x: F.when(F.lower(x).startswith("action:"), retrieval_line(x)).otherwise(x))
    plain = F.substring(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " ")), 1, 700)
    return F.substring(F.when(F.size(kept) > 0, F.array_join(F.filter(made, lambda x: x != ""), " ")).otherwise(plain), 1, limit)


def readable_skills(skills: DataFrame, agent_id: int, owner: str, team: str) -> DataFrame:
    """Skills one viewer may read: shared ones, those of the viewer's agents, those of the viewer's team."""
    own = (F.col("agent_id") == agent_id) | (F.col("owner") == owner)
    return skills.where((acl_kind(F.col("acl")) == "public") | own | (acl_team(F.col("acl")) == team))
