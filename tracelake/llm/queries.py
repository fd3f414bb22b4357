"""One query for each operator of this subpackage, over its whole table, and SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm.decontaminate import contamination
from tracelake.llm.jaccard_join import ngram_jaccard_join, ngram_jaccard_link_counts
from tracelake.llm.language_id import identify_languages
from tracelake.llm.lexical_search import ranked_search
from tracelake.llm.licenses import scan_licenses
from tracelake.llm.mixing import mix_sources
from tracelake.llm.phrase_mining import mine_phrases
from tracelake.llm.pii import KINDS, find_personal_data
from tracelake.llm.quality_rules import host_quality
from tracelake.llm.shards import pack_shards
from tracelake.llm.substring_dedup import substring_dedup
from tracelake.llm.token_counts import count_tokens
from tracelake.llm.token_files import token_ids


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(_table(spark, sf_dir, "documents"), budget_share=1.0, entropy=0.95, max_epochs=4.0)
    return mixed.select(F.col("id").alias("doc_id"), "source", "n_tokens", "weight", "budget", "copies", "block", "position")


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(_table(spark, sf_dir, "documents"), shingle=4, percent=85)


def op2_link_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_link_counts(_table(spark, sf_dir, "documents"), shingle=4, percent=85)


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    sha = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), sha.alias("items_sha256"), "contaminated")


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_shards(_table(spark, sf_dir, "documents"), shards=24)


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(_table(spark, sf_dir, "pages"), all_terms=True).withColumnRenamed("id", "page_id")


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal_data(_table(spark, sf_dir, "documents"))
    names = F.array(*(F.lit(k) for k in KINDS))
    digest = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")
    count = lambda i: F.size(F.filter("base", lambda x: x["kind"] == i)).cast("long")
    return found.select(F.col("id").alias("doc_id"), *(count(i).alias(f"n_{k}") for i, k in enumerate(KINDS[:4])), F.sha2(digest("base").cast("binary"), 256).alias("base_sha256"), digest("spans").alias("spans"), F.size("spans").cast("long").alias("n_spans"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(_table(spark, sf_dir, "documents"), with_text=False)


def op8_host_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = host_quality(_table(spark, sf_dir, "documents"), carry=["doc_id"])
    return rated.select("doc_id", *(f"__quality.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = identify_languages(_table(spark, sf_dir, "documents"), with_spans=False)
    return found.select(F.col("id").alias("doc_id"), "held_out", "lang_pred", "score")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op11_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine_phrases(_table(spark, sf_dir, "documents"), least=30, most=2000, covered=80).drop("path_words")


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_ids(_table(spark, sf_dir, "documents"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), k=50)


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP2_SQL = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS v FROM documents),
s AS (
  SELECT DISTINCT doc_id, shingle FROM (
    SELECT doc_id, unnest(CASE WHEN len(v) >= 4 THEN list_transform(range(1, len(v) - 2), lambda i: array_to_string(v[i:i + 3], ' '))
                               WHEN len(v) > 0 THEN [array_to_string(v, ' ')] ELSE [] END) AS shingle FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS both_have FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM pairs JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * both_have >= 85 * (p.n + q.n - both_have)),
reach(x, y) AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(m.y, d.doc_id)) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN (SELECT x, min(y) AS y FROM reach GROUP BY x) m ON m.x = d.doc_id
"""

OP3_SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS v FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS v FROM benchmark),
bw AS (SELECT DISTINCT item, least(len(v), 13) AS m, array_to_string(v[i:i + least(len(v), 13) - 1], ' ') AS k FROM b, unnest(range(1, len(v) - least(len(v), 13) + 2)) u(i) WHERE len(v) > 0),
ms AS (SELECT DISTINCT m FROM bw),
dw AS (SELECT doc_id, m, i, array_to_string(v[i:i + m - 1], ' ') AS k FROM d, ms, unnest(range(1, len(v) - m + 2)) u(i) WHERE len(v) >= m),
h AS (SELECT doc_id, i, dw.m, item FROM dw JOIN bw ON bw.k = dw.k AND bw.m = dw.m),
p AS (SELECT doc_id, count(DISTINCT i + j) AS n_hit FROM h, unnest(range(0, m)) u(j) GROUP BY doc_id),
its AS (SELECT doc_id, count(DISTINCT item) AS n_items, array_to_string(list_sort(list(DISTINCT item) FILTER (WHERE item IS NOT NULL)), ',') AS ids FROM h GROUP BY doc_id)
SELECT d.doc_id, CAST(len(v) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(v) AS contaminated
FROM d LEFT JOIN p ON p.doc_id = d.doc_id LEFT JOIN its ON its.doc_id = d.doc_id
"""

OP7_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS v FROM documents),
x AS (SELECT doc_id, i, md5(array_to_string(v[i:i + 34], ' ')) AS k FROM w, unnest(range(1, len(v) - 33)) u(i) WHERE len(v) >= 35),
y AS (SELECT doc_id, i, count(*) OVER (PARTITION BY k) AS n FROM x),
gone AS (SELECT DISTINCT doc_id, i + j AS i FROM y, unnest(range(0, 35)) u(j) WHERE n > 1),
words AS (SELECT doc_id, i, v[i] AS word FROM w, unnest(range(1, len(v) + 1)) u(i)),
kept AS (SELECT a.doc_id, string_agg(word, ' ' ORDER BY a.i) AS t, count(*) AS n FROM words a ANTI JOIN gone g ON g.doc_id = a.doc_id AND g.i = a.i GROUP BY a.doc_id)
SELECT w.doc_id, CAST(len(v) AS BIGINT) AS n_words, CAST(len(v) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept ON kept.doc_id = w.doc_id
"""

OP8_SQL = r"""
WITH w AS (SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS v FROM documents),
x AS (
  SELECT doc_id, i, array_to_string(v[i:i + 2], ' ') AS k FROM w, unnest(range(1, len(v) - 1)) u(i) WHERE len(v) > 2),
y AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS n FROM x),
r AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM y, unnest([0, 1, 2]) u(j) WHERE n > 1 GROUP BY doc_id),
f AS (
  SELECT w.doc_id, source, CAST(len(v) AS BIGINT) AS n_words, CAST(length(array_to_string(v, '')) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
    CAST(len(list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]'))) AS BIGINT) AS n_lines,
    CAST(len(list_distinct(list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')))) AS BIGINT) AS n_kinds,
    coalesce(r.n, 0) AS n_repeat_words
  FROM w LEFT JOIN r ON r.doc_id = w.doc_id),
g AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f),
h AS (SELECT *, base_failed OR n_symbols > 0.1 * word_chars OR n_lines - n_kinds > 0.3 * n_lines OR word_chars < 2 * n_words OR word_chars > 15 * n_words AS failed FROM g),
hosts AS (SELECT source, count(*) AS n, sum(CASE WHEN failed THEN 1 ELSE 0 END) AS fails FROM h GROUP BY source),
prior AS (SELECT avg(fails / n) AS m, var_pop(fails / n) AS v FROM hosts),
k AS (SELECT m, CASE WHEN v > 0 THEN greatest(1.0, least(1e6, m * (1 - m) / v - 1)) ELSE 1e6 END AS k FROM prior),
rates AS (SELECT source, (fails + k * m) / (n + k) AS rate FROM hosts, k)
SELECT doc_id, n_words, word_chars, n_symbols, n_lines - n_kinds AS n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND rate <= 0.5 AS kept
FROM h LEFT JOIN rates ON h.source IS NOT DISTINCT FROM rates.source
"""

OP11_SQL = rf"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOWER}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
v AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS v FROM p),
f AS (
  SELECT lang, k, array_to_string(v[i:i + k - 1], ' ') AS phrase, count(*) AS a
  FROM v, unnest([1, 2, 3, 4]) t(k), unnest(range(1, len(v) - k + 2)) u(i) WHERE len(v) >= k GROUP BY ALL),
n AS (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE k >= 2 AND a >= 30),
inside AS (SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(a) AS longest FROM c, unnest([2, 3]) t(m), unnest(range(1, k - m + 2)) u(i) WHERE m < k GROUP BY ALL),
left_over AS (SELECT c.* FROM c LEFT JOIN inside i ON i.lang = c.lang AND i.phrase = c.phrase WHERE longest IS NULL OR 100 * CAST(longest AS HUGEINT) < 80 * CAST(a AS HUGEINT)),
cuts AS (
  SELECT c.lang, c.phrase, c.a, s, x.a AS l, y.a AS r, (CAST(2000000 AS HUGEINT) * c.a) // (x.a + y.a) AS score
  FROM left_over c, unnest(range(1, k)) u(s) JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(w[:s], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(w[s + 1:], ' ')),
worst AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, s) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM worst)
SELECT lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM ranked JOIN n USING (lang) WHERE rank <= 2000
"""

OP13_SQL = rf"""
WITH d AS (SELECT doc_id, unnest(regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
tf AS (SELECT doc_id, term, count(*) AS tf FROM d GROUP BY ALL),
n AS (SELECT doc_id, count(*) AS n FROM d GROUP BY doc_id),
whole AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS len FROM n),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, whole GROUP BY term, docs),
m AS (SELECT doc_id, 100 - 50 + (50 * n * docs) // len AS m FROM n, whole),
s AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score FROM q JOIN tf USING (term) JOIN w USING (term) JOIN m USING (doc_id) GROUP BY item_id, doc_id),
r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT * FROM r WHERE rank <= 50
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_source_mixing": op1_source_mixing,
    "op2_ngram_jaccard_join": op2_ngram_jaccard_join,
    "op2_link_counts": op2_link_counts,
    "op3_benchmark_decontamination": op3_benchmark_decontamination,
    "op4_sharding": op4_sharding,
    "op5_license_scan": op5_license_scan,
    "op6_personal_data": op6_personal_data,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_host_quality_rules": op8_host_quality_rules,
    "op9_language_id": op9_language_id,
    "op10_token_counts": op10_token_counts,
    "op11_phrase_mining": op11_phrase_mining,
    "op12_token_files": op12_token_files,
    "op13_ranked_search": op13_ranked_search,
}

ORACLES: dict[str, str] = {
    "op2_ngram_jaccard_join": OP2_SQL,
    "op3_benchmark_decontamination": OP3_SQL,
    "op7_substring_dedup": OP7_SQL,
    "op8_host_quality_rules": OP8_SQL,
    "op11_phrase_mining": OP11_SQL,
    "op13_ranked_search": OP13_SQL,
}
