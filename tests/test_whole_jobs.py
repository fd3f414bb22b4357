"""Search, clustering and access over whole tables: no candidate, batch or id limits."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracelake.operators import access, dedup, recall, search
from tracelake.plans import catalog


def test_hybrid_search_scores_every_searchable_row(spark, monkeypatch):
    monkeypatch.setattr(search, "ROW_BLOCK", 7)
    monkeypatch.setattr(search, "HIT_BLOCK", 2)
    rng = np.random.default_rng(3)
    n, v, q = 150, rng.normal(size=(150, 6)), rng.normal(size=(5, 6))
    own = [(i, float(rng.normal() + 9 * (i % 60 == 59)), int(rng.integers(40))) for i in range(n)]
    hits = [(a, int(d), 1 - r / 6) for a in range(5) for r, d in enumerate(rng.choice(n, 6, replace=False))]
    frame = lambda rows, name: spark.createDataFrame([(i, [float(x) for x in y]) for i, y in enumerate(rows)], f"{name} long, vector array<double>")
    rows = spark.createDataFrame([(i, x, 0.0, 0.0, 0.0, 0.0, c) for i, x, c in own if i % 7], "experience_id long, q_outcome double, q_intent double, q_execution double, q_orchestration double, q_expression double, visit_count long")
    got = [(r["query_id"], r["experience_id"], r["score"]) for r in search.hybrid_search(frame(q, "query_id"), frame(v, "experience_id"), spark.createDataFrame(hits, "query_id long, doc_id long, signal double"), rows, 4).orderBy("query_id", "rank").collect()]
    live = np.array([i for i in range(n) if i % 7])
    z = lambda x: (x - x.mean()) / x.std()
    want = []
    for a in range(5):
        s = 0.7 * (v[live] @ q[a]) / np.linalg.norm(v[live], axis=1) / np.linalg.norm(q[a]) + 0.3 * np.array([dict((d, w) for b, d, w in hits if b == a).get(i, 0.0) for i in live])
        visits = np.array([own[i][2] for i in live])
        score = 0.55 * z(s) + 0.35 * z(np.array([0.3 * own[i][1] for i in live])) + 0.1 * np.sqrt(np.log(visits.sum() + 1) / np.maximum(visits, 1))
        want += [(a, int(live[i]), pytest.approx(score[i], abs=2e-6)) for i in np.lexsort((live, -score.round(6)))[:4]]
    assert got == want


def test_keyword_hits_have_their_cosine_and_viewers_their_rows(spark):
    queries = spark.createDataFrame([(1, [1.0, 0.0], 5, 6, 0), (2, [0.0, 1.0], 7, 0, 1)], "query_id long, vector array<double>, read_owner long, read_team long, read_shared int")
    rows = spark.createDataFrame([(10, [1.0, 1.0], 5, -1, 0), (11, [1.0, 0.0], 9, -1, 0), (12, [3.0, 4.0], 9, 6, 0), (13, [0.0, 2.0], 9, -1, 1)], "n long, vector array<double>, read_owner long, read_team long, read_shared int")
    near = search.vector_top_k(queries, rows, 9, row_id="n", acl=True)
    assert [(r["query_id"], r["n"]) for r in near.orderBy("query_id", "rank").collect()] == [(1, 10), (1, 12), (2, 13)]
    hits = spark.createDataFrame([(1, 12, 1.0), (2, 12, 0.5), (2, 10, 0.25)], "query_id long, n long, signal double")
    assert {(r["query_id"], r["n"], round(r["similarity"], 6)) for r in search.hit_similarities(hits, queries, rows, "n").collect()} == {(1, 12, 0.6), (2, 12, 0.8), (2, 10, 0.707107)}
    keyword = search.hit_similarities(hits, queries, rows, "n").select("query_id", F.col("n").cast("string").alias("chunk_id"), F.lit(1).alias("rank"), "signal", "similarity")
    got = recall.candidates(keyword, keyword.where("false")).where("chunk_id = '12' AND query_id = 1").first()
    assert (got["fts"], round(got["similarity"], 6)) == (1.0, 0.6)


def test_lite_search_ranks_by_cosine(spark):
    rows = [(1, "me", "private", "private"), (2, "you", "public", "published"), (3, "you", "team:T", "private"), (4, "you", "private", "private"), (5, "you", "public", "private"), (6, "me", "public", "published")]
    e = spark.createDataFrame([(*x, "approved", "done", False) for x in rows] + [(7, "me", "private", "private", "approved", "failed", False)], "experience_id long, owner string, acl string, publish_status string, review_status string, extraction_status string, revoked boolean")
    vectors = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(1, 8)], "experience_id long, vector array<double>")
    queries = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, vector array<double>")
    found = lambda unlocked, k: [(r["stage"], r["experience_id"]) for r in recall.lite_search(queries, vectors, e, "me", "T", unlocked, k).orderBy("rank").collect()]
    assert found(True, 9) == [(0, 1), (0, 3), (0, 6), (1, 2)]
    assert found(False, 2) == [(0, 1), (0, 3)]


def test_leader_clusters_carry_centroids_over_blocks(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(8, 6))
    v = np.array([base[rng.integers(8)] + 0.4 * rng.normal(size=6) for _ in range(90)])
    v[11] = v[9]
    want, sums, counts, names = {}, [], [], []
    for i, x in enumerate(v):
        s = [round(float(c @ x / np.linalg.norm(c) / np.linalg.norm(x)), 9) for c in sums]
        at = int(np.argmax(s)) if s else -1
        if at < 0 or s[at] < 0.8:
            at = len(sums)
            sums, counts, names = [*sums, np.zeros(6)], [*counts, 0], [*names, i]
        sums[at], counts[at] = sums[at] + x, counts[at] + 1
        want[i] = names[at]
    df = spark.createDataFrame([(i, i // 10, [float(a) for a in x]) for i, x in enumerate(v)], "id long, block long, v array<double>")
    got = {r["id"]: r["cluster_id"] for r in dedup.leader_clusters(df, "block", "id", "v", 0.8).collect()}
    assert got == want and got[9] == got[11]


def test_merges_need_near_scripts_and_an_approved_partner(spark):
    x, y = [1.0, 0.0], [0.0, 1.0]
    rows = [(1, 0, x, x, False), (2, 0, x, x, True), (3, 0, x, y, True), (4, 0, x, x, None), (5, 0, x, None, True), (6, 0, y, x, True), (7, 1, x, x, True)]
    df = spark.createDataFrame(rows, "id long, block int, intent array<double>, script array<double>, approved boolean")
    pairs = dedup.mergeable_pairs(df, "block", "id", "intent", "script")
    assert sorted((r["a"], r["b"]) for r in pairs.collect()) == [(1, 2), (1, 4), (2, 4)]
    order = df.select(F.col("id").alias("experience_id"), F.lpad(F.col("id").cast("string"), 4, "0").alias("arrived"), F.lit(0).alias("strength"), "approved")
    assert [tuple(r) for r in dedup.merge_replay(pairs, order).collect()] == [(2, 4)]


def test_all_viewers_and_all_lineage(spark):
    sf = "/root/testdata/sf0.001"
    r = catalog._Roles(spark, sf)
    viewers = r.agents.select(F.col("agent_id").alias("viewer_id"))
    want = access.visible_rows(viewers, r.experiences, r.agents).groupBy("viewer_id", "how").agg(F.count("*").alias("n"), F.sum("experience_id").alias("ids")).collect()
    got = catalog.QUERIES["j5_all_viewers"](spark, sf).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, map(tuple, want)))
    assert any(x["viewer_id"] is not None and x["viewer_id"] % 50 for x in got)
    found = {x["experience_id"] for x in catalog.QUERIES["j15_all_lineage"](spark, sf).collect()}
    linked = {x[0] for x in r.edges.select("child_id").union(r.edges.select("parent_id")).union(r.q_updates.select("experience_id")).collect()}
    assert found == linked & {x["experience_id"] for x in r.experiences.collect()} and any(x % 19 for x in found)
