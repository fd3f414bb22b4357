import os
import random
from collections import Counter

import corpus_pipeline
from tests.llm.test_jaccard_join import brute as brute_components
from tests.llm.test_native_rules import brute_features, brute_hits
from tracelake.llm.decontaminate import decontaminate
from tracelake.llm.quality_rules import host_quality
from tracelake.llm.scratch import keep, shared_dir


def corpus():
    rng = random.Random(11)
    v = [f"word{i}" for i in range(900)]
    line = lambda n: " ".join(rng.choice(v) for _ in range(n))
    items = [(i, line(20)) for i in range(5)]
    rows = [(i, line(rng.choice([60, 90, 200])), "en", "hot" if i % 2 else f"s{i % 5}") for i in range(120)]
    rows += [(200 + i, rows[i][1] + (" tail" if i % 2 else ""), "en", "s1") for i in range(20)]
    rows += [(300 + i, line(40) + " " + items[i % 5][1] + " " + line(40), "en", "s2") for i in range(10)]
    rows += [(400, "too short", "en", "s1"), (401, None, "en", "s1"), (402, "again and " * 60, "en", "s3"), (403, "", None, None), (5, rows[5][1], "en", "s0")]
    return rows, items


def test_pipeline_equals_brute_force(spark, tmp_path):
    rows, items = corpus()
    spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept, after = [r for r in rows], {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        after[name] = docs.collect()
        if name != "sharding":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            docs = spark.createDataFrame(after[name], docs.schema)

    def good(t):
        n, _, _, _, repeated = brute_features(t)
        return n >= 50 and 100 * repeated <= 50 * n

    kept = [r for r in kept if good(r[1])]
    assert Counter(r["doc_id"] for r in after["quality rules"]) == Counter(r[0] for r in kept)
    first = {d for d, _, c in brute_components(sorted({(r[0], r[1]) for r in kept}), 5, 80) if d == c}
    assert Counter(r["doc_id"] for r in after["n-gram Jaccard join"]) == Counter(first)
    text = {r[0]: r[1] for r in kept}
    clean = {d for d, _, _, _, bad in brute_hits([(d, text[d]) for d in first], items) if not bad}
    assert Counter(r["doc_id"] for r in after["benchmark decontamination"]) == Counter(clean)
    mixed = Counter(r["doc_id"] for r in after["source mixing"])
    assert set(mixed) == clean and max(mixed.values()) <= 2
    shards = after["sharding"]
    assert Counter(r["doc_id"] for r in shards) == mixed
    slots = Counter((r["shard"], r["slot"]) for r in shards)
    assert max(slots.values()) == 1 and all(0 <= s < 24 for s, _ in slots)


def test_run_of_empty_documents(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_clashing_names_and_what_is_left(spark, tmp_path):
    rows, items = corpus()
    clash = ["__id", "__t64", "__nth", "__spans", "__copies", "__from", "__text", "__rate", "__host", "__quality", "id", "t64", "of", "at", "window", "rows", "rank", "copies"]
    plain = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    odd = plain.selectExpr("*", *(f"CAST(doc_id AS STRING) AS `{c}`" for c in clash))
    keep(plain, "folder")
    found = []
    for name, docs in (("plain", plain), ("odd", odd)):
        folder = tmp_path / name
        docs.write.parquet(str(folder / "documents.parquet"))
        spark.createDataFrame(items, "item_id long, text string").write.parquet(str(folder / "benchmark.parquet"))
        before = set(os.listdir(f"{shared_dir(spark).removeprefix('file:')}/tracelake"))
        found.append(Counter(tuple(r) for r in corpus_pipeline.run(spark, str(folder)).select("doc_id", "size", "text_crc32").collect()))
        assert len(set(os.listdir(f"{shared_dir(spark).removeprefix('file:')}/tracelake")) - before) == 1  # the result
    assert found[0] == found[1]
    whole = spark.read.parquet(str(tmp_path / "odd" / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, whole, str(tmp_path / "odd")).columns == odd.columns
    cut = decontaminate(whole, spark.createDataFrame(items, "item_id long, text string"), remove="spans")
    assert cut.columns == odd.columns and cut.count() == len(rows)
    assert host_quality(whole).drop("__quality").columns == [c for c in odd.columns if c != "__quality"]
