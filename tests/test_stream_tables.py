import math
import random

import pytest
from pyspark.sql import functions as F

from tracelake.functions.constants import ALPHA, DIMS
from tracelake.operators import credit
from tracelake.streaming.tables import KeyedTable

Q = ", ".join(f"q_{d} double" for d in DIMS)
R = ", ".join(f"r_{d} double" for d in DIMS)


def replay(start, events):
    """The log of one key in a plain loop."""
    q, out = list(start), []
    for e in events:
        c = ALPHA * min(1.0, max(0.0, e["confidence"] or 0.0))
        new = [(1 - c) * a + c * e[f"r_{d}"] for a, d in zip(q, DIMS)]
        out.append((e["id"], q, [b - a for a, b in zip(q, new)]))
        q = new
    return out, q


@pytest.mark.parametrize(("n", "confidence"), [(1, 0.5), (7, 0.3), (4000, 1.0), (9000, 0.9), (300, 0.0), (600, 0.001)])
def test_log_equals_a_loop(spark, n, confidence):
    rng = random.Random(n)
    events = [{"experience_id": k, "id": i, "confidence": None if i == 3 else confidence, **{f"r_{d}": rng.uniform(-1, 1) for d in DIMS}} for k in (1, 2) for i in range(n)]
    start = {1: [0.5] * 5, 2: [-0.25] * 5, 3: [0.0] * 5}
    e = spark.createDataFrame([(r["experience_id"], r["id"], r["confidence"], *(r[f"r_{d}"] for d in DIMS)) for r in events] + [(99, 0, 1.0, *[1.0] * 5)], f"experience_id long, id long, confidence double, {R}").repartition(3)
    s = spark.createDataFrame([(k, *v) for k, v in start.items()], f"experience_id long, {Q}")
    got = credit.fold_log(s, e, "experience_id", ["id"], ["id"]).orderBy("experience_id", "nth").collect()
    assert len(got) == 2 * n
    done = {r["experience_id"]: r for r in credit.fold(s, e, "experience_id", ["id"]).collect()}
    for k in (1, 2):
        want, last = replay(start[k], [x for x in events if x["experience_id"] == k])
        own = [r for r in got if r["experience_id"] == k]
        for r, (i, q, delta) in zip(own, want, strict=True):
            assert r["id"] == i
            assert all(math.isclose(r[f"q_{d}"], a, abs_tol=1e-9) and math.isclose(r[f"delta_{d}"], b, abs_tol=1e-9) for d, a, b in zip(DIMS, q, delta))
        assert all(math.isclose(done[k][f"q_{d}"], a, abs_tol=1e-9) for d, a in zip(DIMS, last))


def table(spark, path, parts=8):
    return KeyedTable(spark, str(path), "k long, v long, at long", ["k"], lambda: [F.col("at"), F.col("v")], parts)


def test_same_table_in_one_batch_or_many(spark, tmp_path):
    rng = random.Random(1)
    rows = [(rng.randrange(40), rng.randrange(100), i) for i in range(300)]
    want = sorted({k: (k, v, i) for k, v, i in rows}.values())
    df = lambda x: spark.createDataFrame(x, "k long, v long, at long")
    for name, cuts in (("one", [300]), ("seven", [1, 50, 90, 91, 200, 299, 300])):
        t, first = table(spark, tmp_path / name), 0
        for number, last in enumerate(cuts):
            assert t.merge(df(rows[first:last]), number)
            first = last
        assert sorted(map(tuple, t.read().collect())) == want
        assert not t.merge(df([(1, 1, 10**6)]), len(cuts) - 1)  # replayed
        assert sorted(map(tuple, t.read().collect())) == want
        assert t.clean() >= (len(cuts) > 1)
        assert sorted(map(tuple, t.read().collect())) == want and t.last_commit() == len(cuts) - 1


def test_a_batch_that_failed_is_not_seen(spark, tmp_path, monkeypatch):
    t = table(spark, tmp_path / "t")
    df = lambda x: spark.createDataFrame(x, "k long, v long, at long")
    assert sorted(t.read().collect()) == []
    t.merge(df([(1, 1, 1), (2, 1, 1)]), 0)
    df([(1, 9, 9)]).withColumn("part", F.lit(0)).write.partitionBy("part").parquet(str(tmp_path / "t/data/batch=1"))  # written, not committed
    assert sorted(map(tuple, t.read().collect())) == [(1, 1, 1), (2, 1, 1)]
    assert t.merge(df([(2, 2, 2), (3, 3, 3)]), 1)
    assert sorted(map(tuple, t.read().collect())) == [(1, 1, 1), (2, 2, 2), (3, 3, 3)]
    assert sorted(map(tuple, t.rows_like(df([(3, 0, 0)])).where("k = 3").collect())) == [(3, 3, 3)]
    t.clean()
    assert sorted(map(tuple, t.read().collect())) == [(1, 1, 1), (2, 2, 2), (3, 3, 3)]


def fed(spark, tmp_path, name, rows, order, batches, make):
    from tracelake.streaming import stored

    path, n = str(tmp_path / name), 0
    for stream in stored.arrivals(rows, order, f"{path}/in", batches):
        stored.run(stream, make(path), f"{path}/checkpoint")
        n += 1
    assert n == batches
    return path


def test_sessions_and_uploads_do_not_depend_on_batches(spark, tmp_path):
    from tracelake.streaming import stored

    rng = random.Random(3)
    rows = [(i, rng.randrange(5), rng.choice(["", "a", "b", "c"]), rng.choice([None, "", "f1", "f2", "f3", "f4"]), rng.randrange(9), f"2024-01-{1 + i // 20:02d} 00:00:{i % 20:02d}") for i in range(200)]
    df = spark.createDataFrame(rows, "experience_id long, agent_id long, session_id string, fingerprint string, turn_count int, c string").withColumn("created_at", F.to_timestamp("c")).drop("c")
    best, first, dups = {}, {}, []
    for i, agent, session, print_, turns, _ in rows:
        if session and turns > best.get((agent, session), (0, -1))[1]:
            best[agent, session] = (i, turns)
        if print_:
            if (agent, print_) in first:
                dups.append((i, first[agent, print_]))
            first.setdefault((agent, print_), i)
    for batches in (1, 7):
        path = fed(spark, tmp_path, f"s{batches}", df.select("agent_id", "session_id", "experience_id", "turn_count", "created_at"), ["created_at", "experience_id"], batches, lambda p: stored.store_sessions(stored.sessions(spark, f"{p}/table")))
        assert {(r["agent_id"], r["session_id"]): (r["experience_id"], r["turn_count"]) for r in stored.sessions(spark, f"{path}/table").read().collect()} == best
        path = fed(spark, tmp_path, f"u{batches}", df.select("agent_id", "fingerprint", "experience_id", "created_at"), ["created_at", "experience_id"], batches, lambda p: stored.store_uploads(stored.uploads(spark, f"{p}/table"), f"{p}/log"))
        kept = stored.uploads(spark, f"{path}/table").read().collect()
        assert {(r["agent_id"], r["fingerprint"][3:]): r["experience_id"] for r in kept if r["fingerprint"][:3] == "fp:"} == first
        assert sorted(r["experience_id"] for r in kept if r["fingerprint"][:3] == "id:") == [r[0] for r in rows if not r[3]]
        assert sorted(map(tuple, stored.read_log(spark, f"{path}/log", "experience_id long, duplicate_of long").collect())) == sorted(dups)


def test_learning_goes_on_from_what_is_stored(spark, tmp_path):
    from tracelake.streaming import stored

    rng = random.Random(4)
    rows = [(i, rng.randrange(6), rng.random(), f"2024-01-01 00:{i // 60:02d}:{i % 60:02d}", *(rng.uniform(-1, 1) for _ in DIMS)) for i in range(150)]
    df = spark.createDataFrame(rows, f"reward_id long, experience_id long, confidence double, c string, {R}").withColumn("created_at", F.to_timestamp("c")).drop("c")
    start = spark.createDataFrame([(k, *[0.1 * k] * 5) for k in range(3)], f"experience_id long, {Q}")
    for batches in (1, 7):
        path = fed(spark, tmp_path, f"q{batches}", df, ["created_at", "reward_id"], batches, lambda p: stored.learn(stored.learned(spark, f"{p}/table"), f"{p}/log", start))
        got = {r["experience_id"]: r for r in stored.learned(spark, f"{path}/table").read().collect()}
        log = stored.read_log(spark, f"{path}/log", stored.LEARN_LOG).orderBy("created_at", "reward_id").collect()
        for k in range(6):
            own = [{"id": r[0], "confidence": r[2], **{f"r_{d}": r[4 + i] for i, d in enumerate(DIMS)}} for r in rows if r[1] == k]
            want, last = replay([0.1 * k if k < 3 else 0.0] * 5, own)
            assert got[k]["updates"] == len(own) and all(math.isclose(got[k][f"q_{d}"], a, abs_tol=1e-9) for d, a in zip(DIMS, last))
            mine = [r for r in log if r["experience_id"] == k]
            for r, (i, q, delta) in zip(mine, want, strict=True):
                assert r["reward_id"] == i and all(math.isclose(r[f"delta_{d}"], b, abs_tol=1e-9) for d, b in zip(DIMS, delta))
        before = sorted(map(tuple, stored.learned(spark, f"{path}/table").read().collect()))
        stored.learn(stored.learned(spark, f"{path}/table"), f"{path}/log", start)(df, batches - 1)  # a replayed batch
        assert sorted(map(tuple, stored.learned(spark, f"{path}/table").read().collect())) == before


def test_last_row_of_a_key_counts(spark, tmp_path):
    from tracelake.streaming import jobs

    for i in range(3):
        spark.createDataFrame([(i * 10 + j, j % 2, 0.5, float(i), *[0.4] * 5) for j in range(4)], f"reward_id long, experience_id long, confidence double, at double, {R}").withColumn("created_at", F.timestamp_seconds("at")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    assert sorted((r["experience_id"], r["updates"]) for r in jobs.run_to_table(jobs.online_q(stream), "update", ["experience_id"]).collect()) == [(0, 6), (1, 6)]


def test_any_cut_of_a_session_gives_the_segments_of_the_whole(spark, tmp_path):
    from tracelake.sources import sessions as se
    from tracelake.streaming import stored

    rng = random.Random(9)
    rows = []
    for k in range(4):
        for t in range(rng.choice([1, 30, 60])):
            rows.append((f"s{k}", t, rng.choice(["user", "assistant"]), rng.choice(["ok", "do the next thing", "x" * 70, "[task-summary]: all done", None, "mention of [task-summary]: inside"])))

    def loop(session):
        out, seg, n, size, closed = [], 0, 0, 0, True
        for _, t, role, text in (r for r in rows if r[0] == session):
            task = role == "user" and text not in (None, "ok")
            if closed or task and (n >= 4 or size >= 200):
                seg, n, size = seg + 1, 0, 0
                out.append([session, seg, t, t, 0, 0, False])
            n, size = n + 1, size + len(text or "")
            closed = (text or "").startswith("[task-summary]") or n >= 8 or size >= 400
            out[-1][3:] = [t, n, size, closed]
        return [tuple(x) for x in out]

    want = sorted(x for k in range(4) for x in loop(f"s{k}"))
    df = spark.createDataFrame(rows, "session_id string, turn int, role string, text string")
    assert sorted(map(tuple, se.segments_of(se.segment_turns(df.repartition(3), None, 4, 200)).collect())) == want
    for cuts in ([5], [1, 2, 3, 29, 31]):
        t, number, first = stored.segments(spark, str(tmp_path / str(len(cuts)))), 0, 0
        each = stored.store_segments(t, 4, 200)
        for last in [*cuts, 100]:
            each(df.where((F.col("turn") >= first) & (F.col("turn") < last)), number)
            each(df, number)  # replayed
            first, number = last, number + 1
        assert sorted(map(tuple, t.read().collect())) == want


def test_a_table_of_parts_is_a_stream_and_an_empty_one_gives_no_rows(spark, tmp_path):
    import pyarrow.parquet as pq

    from tracelake.plans import streams  # noqa: F401  it registers m4
    from tracelake.plans.registry import QUERIES
    from tracelake.streaming import jobs

    turns = spark.createDataFrame([(c, t, "user" if t % 2 == 0 else "assistant", "x") for c in range(6) for t in range(4)], "conv_id long, turn long, role string, text string")
    turns.repartition(3, "conv_id").write.parquet(str(tmp_path / "parts" / "conversations.parquet"))
    (tmp_path / "file").mkdir()
    pq.write_table(pq.read_table(tmp_path / "parts" / "conversations.parquet"), tmp_path / "file" / "conversations.parquet")
    got = [sorted(tuple(r) for r in QUERIES["m4_closed_tasks"](spark, str(tmp_path / kind)).collect()) for kind in ("parts", "file")]
    assert got[0] == got[1] and len(got[0]) == 12
    (tmp_path / "none").mkdir()
    nothing = spark.readStream.schema("session_id string, line int, kind string").parquet(str(tmp_path / "none"))
    assert jobs.run_to_table(jobs.closed_tasks(nothing), "append").collect() == []


def test_keys_of_a_group_have_states_of_their_own(spark, tmp_path, monkeypatch):
    from tracelake.streaming import jobs

    monkeypatch.setattr(jobs, "GROUPS", 3)
    rng = random.Random(5)
    ids = [None, *range(40), 2**60 + 1]
    parts = [[(i * 1000 + j, rng.choice(ids), rng.choice([None, 0.0, 0.4, 1.0, 3.0]), float(rng.randrange(50)), *(rng.uniform(-1, 1) for _ in DIMS)) for j in range(150)] for i in range(3)]
    fields = f"reward_id long, experience_id long, confidence double, at double, {', '.join(f'r_{d} double' for d in DIMS)}"
    for part in parts:
        spark.createDataFrame(part, fields).withColumn("created_at", F.timestamp_seconds("at")).coalesce(1).write.mode("append").parquet(str(tmp_path / "q"))
    stream = spark.readStream.schema(spark.read.parquet(str(tmp_path / "q")).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "q"))
    query = jobs.online_q(stream).writeStream.format("memory").queryName("groups").outputMode("update").trigger(availableNow=True).start()
    query.awaitTermination()
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress) <= 6  # one value a group, not a key
    got = {r["experience_id"]: r for r in jobs.run_to_table(jobs.online_q(stream), "update", ["experience_id"]).collect()}
    assert spark.conf.get("spark.sql.streaming.maxBatchesToRetainInMemory") == "2"
    want = {}
    for part in parts:
        for _, k, c, _, *r in sorted(part, key=lambda x: (x[3], x[0])):
            e = ALPHA * min(1.0, max(0.0, c or 0.0))
            q, n = want.get(k, ([0.0] * len(DIMS), 0))
            want[k] = [(1 - e) * a + e * b for a, b in zip(q, r, strict=True)], n + 1
    assert {k: ([r[f"q_{d}"] for d in DIMS], r["updates"]) for k, r in got.items()} == {k: (pytest.approx(q), n) for k, (q, n) in want.items()}


def test_snapshots_and_tasks_of_many_keys_against_loops(spark, tmp_path, monkeypatch):
    from tracelake.streaming import jobs

    monkeypatch.setattr(jobs, "GROUPS", 3)
    rng = random.Random(6)
    parts = [[(rng.choice([None, *range(8)]), rng.choice([None, "a", "b"]), i * 100 + j, rng.choice([None, -2, *range(6)]), rng.randrange(9)) for j in range(90)] for i in range(3)]
    for part in parts:
        spark.createDataFrame(part, "agent_id long, session_id string, experience_id long, turn_count int, at long").withColumn("created_at", F.timestamp_seconds("at")).coalesce(1).write.mode("append").parquet(str(tmp_path / "s"))
    stream = spark.readStream.schema(spark.read.parquet(str(tmp_path / "s")).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "s"))
    got = {tuple(r) for r in jobs.run_to_table(jobs.session_upserts(stream), "append", ["agent_id", "session_id"]).collect()}
    best = {}
    for part in parts:
        for a, s, e, n, _ in sorted(part, key=lambda x: (x[4], x[2])):
            if n is not None and n > best.get((a, s), (0, -1))[1]:
                best[a, s] = e, n
    assert got == {(*k, *v) for k, v in best.items()}
    logs = [[(f"s{k}", i * 5 + j, rng.choice(["task_started", "task_complete", "turn_aborted", None])) for k in range(20) for j in range(5)] for i in range(3)]
    for part in logs:
        spark.createDataFrame(part, "session_id string, line int, kind string").coalesce(1).write.mode("append").parquet(str(tmp_path / "t"))
    lines = spark.readStream.schema("session_id string, line int, kind string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "t"))
    got = sorted(tuple(r) for r in jobs.run_to_table(jobs.closed_tasks(lines), "append").collect())
    want = []
    for k in range(20):
        task, first = 0, -1
        for s, line, kind in (r for part in logs for r in part if r[0] == f"s{k}"):
            if kind == "task_started":
                want += [(s, task, "superseded", first, line - 1)] if first >= 0 else []
                task, first = task + 1, line
            elif kind and first >= 0:
                want.append((s, task, {"task_complete": "complete", "turn_aborted": "aborted"}[kind], first, line))
                first = -1
    assert got == sorted(want)


def test_keys_without_rows_are_forgotten_beside_others_of_their_group():
    import pandas as pd

    from tracelake.streaming import jobs

    class Kept:
        exists, hasTimedOut, get, now, wait = False, False, None, 0, None

        def update(self, value):
            self.exists, self.get = True, value

        def remove(self):
            self.exists, self.get = False, None

        def getCurrentProcessingTimeMs(self):
            return self.now

        def setTimeoutDuration(self, ms):
            self.wait = ms

    def run(rows, state):
        old = dict(zip(state["k"], state["n"]))
        found = pd.DataFrame([(k, old.get(k, 0) + 1) for k in rows["k"]], columns=["k", "n"])
        return found, found

    kept, step = Kept(), jobs._by_group(["k"], run, ["n"], 100)
    feed = lambda *ks: [tuple(r) for f in step((0,), iter([pd.DataFrame({"k": ks, "__group": 0})]), kept) for r in f.itertuples(index=False)]
    assert feed(1, 2) == [(1, 1), (2, 1)] and kept.wait == 100
    kept.now = 60
    assert feed(2) == [(2, 2)] and kept.wait == 40
    kept.now, kept.hasTimedOut = 100, True
    assert list(step((0,), iter([]), kept)) == [] and kept.exists and kept.wait == 60
    kept.now, kept.hasTimedOut = 120, False
    assert feed(1) == [(1, 1)] and feed(2) == [(2, 3)]
    kept.now, kept.hasTimedOut = 500, True
    assert list(step((0,), iter([]), kept)) == [] and not kept.exists


def test_log_of_changes_shuffles_its_events_once(spark, monkeypatch):
    monkeypatch.setattr(credit, "_DECAY", 30.0)  # stretches as short as a double still needs no third
    rng = random.Random(8)
    rows = [(k, i, rng.choice([0.0, 0.5, 1.0]), *(rng.uniform(-1, 1) for _ in DIMS)) for k in range(3) for i in range((500, 3, 150)[k])]
    start = [(k, *(0.1 * (k + 1) for _ in DIMS)) for k in range(3)]
    events = spark.createDataFrame(rows, f"experience_id long, id long, confidence double, {R}")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        log = credit.fold_log(spark.createDataFrame(start, f"experience_id long, {', '.join(f'q_{d} double' for d in DIMS)}"), events, "experience_id", ["id"], ["id"])
        assert log._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange hashpartitioning") == 2  # the events and what they start from
        got = {(r["experience_id"], r["id"]): [r[f"q_{d}"] for d in DIMS] for r in log.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    want = {}
    q = {k: list(x) for k, *x in start}
    for k, i, c, *r in rows:
        want[k, i] = pytest.approx(list(q[k]), abs=1e-9)
        q[k] = [(1 - ALPHA * c) * a + ALPHA * c * b for a, b in zip(q[k], r, strict=True)]
    assert got == want
