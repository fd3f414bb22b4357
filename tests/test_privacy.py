import datetime
import decimal
import random

from pyspark.sql import functions as F

from tracelake.operators import backfill, dedup, redaction


def test_nested_values_stay_what_they_were(spark):
    at = datetime.datetime(2024, 5, 6, 7, 8, 9, 123456)
    mail, clean = "write to bob@example.com", "write to <EMAIL>"
    rows = [
        (1, {"role": mail, "content": [{"type": mail, "text": mail, "at": at, "raw": bytearray(b"bob@example.com\xff")}, None], "n": 2**60, "d": decimal.Decimal("1.10"), "more": {"a": [mail, None], "id": [mail]}}, [mail, None], 3),
        (2, None, None, 4),
        (3, {"role": None, "content": None, "n": None, "d": None, "more": None}, [], 5),
    ]
    schema = "k int, m struct<role:string,content:array<struct<type:string,text:string,at:timestamp,raw:binary>>,n:long,d:decimal(10,2),more:map<string,array<string>>>, list array<string>, number int"
    df = spark.createDataFrame(rows, schema)
    done = redaction.redact_tree(df, ["m", "list", "number"])
    assert dict(done.dtypes)["m"] == dict(df.dtypes)["m"]
    got = {r["k"]: r for r in done.collect()}
    m = got[1]["m"]
    assert m["role"] == mail and m["n"] == 2**60 and m["d"] == decimal.Decimal("1.10") and m["more"] == {"a": [clean, None], "id": [mail]}
    assert [x and (x["type"], x["text"], x["at"], bytes(x["raw"])) for x in m["content"]] == [(mail, clean, at, b"bob@example.com\xff"), None]
    assert got[1]["list"] == [clean, None] and got[1]["redactions"] == {"email": 3}
    assert got[2]["m"] is None and got[2]["list"] is None and got[3]["m"]["content"] is None and got[3]["list"] == [] and got[2]["redactions"] == {}
    assert redaction.redact_tree(df.select("k", "number"), ["number"]).select("number").count() == 3


def test_backfill(spark):
    e = spark.createDataFrame(
        [(1, 5, "layer1_only", "private", "pending", False), (2, 4, "layer1_only", "public", "pending", None), (3, 3, "layer1_only", "public", "pending", False), (4, 2, "layer1_only", "public", "pending", True), (5, 1, "done", "public", "approved", False), (6, 0, "layer1_only", None, "pending", False), (7, 9, "layer1_only", "public", "pending", False)],
        "experience_id int, created_at int, sanitization_status string, acl string, review_status string, revoked boolean",
    )
    turns = spark.createDataFrame([(1, 0, "my key is abc"), (2, 0, "I am Ann Lee"), (2, 1, "fine"), (3, 0, "key xyz"), (5, 0, "Ann"), (7, 0, "late"), (4, 0, "key")], "experience_id int, turn int, text string")
    spans = spark.createDataFrame([(1, 0, 10, 13, "secret"), (2, 0, 5, 8, "person"), (2, 0, 9, 12, "person"), (3, 0, 4, 7, "Secret_Key"), (5, 0, 0, 3, "person"), (7, 0, 0, 4, "person"), (4, 0, 0, 3, "secret")], "experience_id int, turn int, start int, end int, label string")
    scanned = turns.where("experience_id <> 7").select("experience_id")
    text, rows, audit = backfill.backfill(e, turns, scanned, spans)
    assert {(r["experience_id"], r["turn"]): r["text"] for r in text.collect()} == {(1, 0): "my key is <SECRET>", (2, 0): "I am <PERSON> <PERSON>", (2, 1): "fine", (3, 0): "key <SECRET_KEY>", (4, 0): "key", (5, 0): "Ann", (7, 0): "late"}
    assert {r["experience_id"]: (r["sanitization_status"], r["review_status"]) for r in rows.collect()} == {
        1: ("human_review", "auto_approved"), 2: ("done", "auto_approved"), 3: ("human_review", "pending"), 4: ("layer1_only", "pending"), 5: ("done", "approved"), 6: ("done", "pending"), 7: ("layer1_only", "pending")}
    assert {r["target_id"]: (r["hits"], r["sanitizer_blocked_review"]) for r in audit.collect()} == {1: ({"SECRET": 1}, False), 2: ({"PERSON": 2}, False), 3: ({"SECRET_KEY": 1}, True)}
    oldest = backfill.backfill(e, turns, scanned, spans, limit=2)[1]
    assert {r["experience_id"] for r in oldest.where("sanitization_status <> 'layer1_only'").collect()} == {3, 5, 6}


def test_counts_move_along_chains_of_merges(spark):
    rng = random.Random(7)
    n = 120
    own = {i: (rng.randrange(9), rng.randrange(5)) for i in range(n)}
    into = {i: rng.randrange(i + 1, min(n, i + 4)) for i in range(n - 1) if rng.random() < 0.8} | {i: i + 1 for i in range(40, 90)}
    have = {i: list(own[i]) for i in range(n)}
    for i in sorted(into):  # losers hand on in order
        have[into[i]] = [a + b for a, b in zip(have[into[i]], have[i])]
    rows = spark.createDataFrame([(i, v, r if i != 5 else None, "approved", ["t"] if i % 2 else None) for i, (v, r) in own.items()], "experience_id long, visit_count long, reuse_count long, review_status string, tags array<string>")
    if 5 in own:
        lost = own[5][1]
        at = 5
        while True:
            have[at][1] -= lost
            if at not in into:
                break
            at = into[at]
    got = {r["experience_id"]: r for r in dedup.apply_merges(rows, spark.createDataFrame(list(into.items()), "experience_id long, merged_into long")).collect()}
    for i in range(n):
        r = got[i]
        assert [r["visit_count"], r["reuse_count"] or 0] == have[i]
        assert r["review_status"] == ("rejected" if i in into else "approved")
        assert (r["tags"] or []) == (["t"] if i % 2 else []) + ([f"merged_into:{into[i]}"] if i in into else [])
    assert dedup.apply_merges(rows, spark.createDataFrame([], "experience_id long, merged_into long")).where(F.col("review_status") == "approved").count() == n
