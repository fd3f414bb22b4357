import pytest

from tracelake.operators import upkeep


def test_upload_cards_take_the_first_meaningful_request(spark):
    rows = [(1, 0, "user", "ok"), (1, 1, "user", "Please fix the parser in core"), (1, 2, "assistant", "Looking."), (1, 3, "assistant", "Task summary: parser fixed\nDone."), (2, 0, "assistant", ""), (3, 0, "user", None)]
    t = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    got = {r["conv_id"]: r for r in upkeep.upload_cards(t).collect()}
    assert got[1]["query"] == "Please fix the parser in core" and got[1]["intent"] == "parser fixed"
    assert got[1]["steps"] == ["Looking.", "Task summary: parser fixed\nDone."] and got[1]["outcome"].startswith("Task summary")
    assert (got[2]["query"], got[2]["steps"], got[2]["outcome"]) == ("(no user turn)", [], "(no assistant turn)") and got[3]["intent"] == "(no user turn)"
    assert upkeep.upload_cards(t, clip=6).where("conv_id = 1").first()["query"] == "Please"
    assert upkeep.upload_cards(t.limit(0)).count() == 0


def test_upload_rows_carry_lineage_under_meta(spark):
    m = "map<string,string>"
    records = spark.createDataFrame([("a", "cursor", {"model": "m1", "turn_index": "9"}, {"turn_index": "2", "segment_index": "4", "is_subagent": None}), ("b", "unknown", None, None)], f"session_id string, source string, meta {m}, lineage {m}")
    cards = spark.createDataFrame([("a", "q", "i", ["s"], "o"), ("b", "q", "i", [], "o")], "session_id string, query string, intent string, steps array<string>, outcome string")
    got = {r["session_id"]: r for r in upkeep.upload_rows(records, cards, "coding").collect()}
    assert got["a"]["meta"] == {"turn_index": "9", "segment_index": "4", "ingest_source": "cursor", "model": "m1"} and got["a"]["source_model"] == "m1" and got["a"]["tags"] == ["cursor"]
    assert got["b"]["meta"] == {"ingest_source": "unknown"} and got["b"]["source_model"] == "unknown" and got["b"]["acl"] == "private"


def test_keyphrases(spark):
    rows = spark.createDataFrame([(1, "The CACHE index broke: rebuild it"), (2, "nothing"), (3, None)], "id long, text string")
    words = spark.createDataFrame([(1, "index", 1), (1, "cache_key", 2), (1, "load_map", 3), (1, "index_map", 4), (1, "plain", 5), (2, "index", 1), (3, "index", 1)], "id long, term string, rank int")
    rules = [("index rebuild", ("index", "rebuild")), ("index lost", ("index", "lost"))]
    got = {r["id"]: r["phrases"] for r in upkeep.keyphrases(words, rows, "id", "text", rules, ("index", "index_map"), ("cache_key", "load_map", "rebuild")).collect()}
    # two code terms without an anchor are no phrase
    assert got == {1: ["index rebuild", "index cache_key load_map", "index_map cache_key load_map", "load_map index_map"], 2: [], 3: []}


def test_work_and_logs(spark):
    e = spark.createDataFrame([(1, "2024-01-01"), (2, "2024-01-03"), (3, "2024-01-02")], "experience_id long, created_at string")
    r = spark.createDataFrame([(2, "a"), (3, "b")], "experience_id long, judge_model string")
    ids = lambda mode, judge: [(x["experience_id"], x["annotated"]) for x in upkeep.labelling_work(e, r, mode, judge, 2).collect()]
    assert ids("all", "a") == [(2, True), (3, False)] and ids("missing", None) == [(1, False)] and ids("missing_for_judge", "a") == [(3, False), (1, False)]
    with pytest.raises(ValueError):
        upkeep.labelling_work(e, r, "some")
    hits = spark.createDataFrame([(1, 5, "q", 7, None, 1, 0.5, None), (1, 5, "q", 7, None, 2, 0.4, 0.3)], "event_id long, viewer_id long, query string, experience_id long, chunk_id string, rank int, score double, similarity double")
    log, items = upkeep.hit_logs(hits)
    assert sorted(x["rank"] for x in log.collect()) == [0, 1] and [tuple(x) for x in items.collect()] == [(1, 7, "", 2, 0.4, 0.3)]

