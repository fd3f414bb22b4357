import math
import random
import re
from collections import Counter

import pytest

from tracelake.llm.licenses import TEMPLATES, scan_licenses


def terms(s):
    return Counter(re.findall(r"[a-z0-9]+", re.sub("[A-Z]", lambda m: m[0].lower(), s), re.A))


def brute(rows, threshold=0.75):
    lines = {i: [x for x in (t or "").split("\n")] for i, (_, _, t) in enumerate(rows)}
    n = sum(bool(terms(x)) for own in lines.values() for x in own)
    df = Counter(w for own in lines.values() for x in own for w in terms(x))
    known = {w for _, t in TEMPLATES for w in terms(t)}
    idf = lambda w: 1 + math.log((1 + n) / (1 + df[w])) if w in known else 1 + math.log(1 + n)

    def cosine(a, b):
        norm = lambda v: math.sqrt(sum((k * idf(w)) ** 2 for w, k in v.items()))
        dot = sum(k * idf(w) * b[w] * idf(w) for w, k in a.items()) / norm(b)
        return round(dot / norm(a), 9), round(dot, 6)

    own = {}
    for i, x in lines.items():
        found = []
        for name, t in TEMPLATES:
            lines_of = [(-c, k, -d) for k, line in enumerate(x) if terms(line) for c, d in [cosine(terms(line), terms(t))] if c >= threshold]
            if lines_of:
                c, k, d = min(lines_of)
                found.append((d, c, k, name))
        own[i] = (min(found)[3], -min(found)[1], -min(found)[0]) if found else None
    place = {}
    for i, (_, url, _) in enumerate(rows):
        path = re.sub(r"^\w+://", "", re.sub(r"[?#].*", "", url or ""))
        path = path if "/" in path else "/" + path
        place[i] = (path[: path.rindex("/") + 1], path[path.rindex("/") + 1 :])
    dirs = {}
    for i, (d, name) in place.items():
        rank = 0 if re.match(r"(?i)(licen[cs]e|copying|copyright|notice|legal)(\..*)?$", name) else 1 if re.match(r"(?i)(index(\..*)?)?$", name) else None
        if own[i] and rank is not None:
            dirs[d] = min(dirs.get(d, (9,)), (rank, -own[i][2], own[i][0]))
    out = []
    for i, (key, _, _) in enumerate(rows):
        d = place[i][0]
        if own[i]:
            out.append((key, own[i][0], pytest.approx(own[i][1]), "own", d))
            continue
        above = [d[: k + 1] for k, c in enumerate(d) if c == "/"]
        near = max((x for x in above if x in dirs), key=len, default=None)
        out.append((key, dirs[near][2], None, "inherited", near) if near else (key, None, None, None, None))
    return out


def test_equals_brute_force(spark):
    rng = random.Random(7)
    notices = [t for _, t in TEMPLATES] + ["Released under the MIT License by nobody", "the license", "All rights are reserved"]
    rows = []
    for i in range(150):
        body = [" ".join(rng.choice(["word", "the", "software", "é", "License", "x1", "under"]) for _ in range(rng.randrange(12))) for _ in range(rng.randrange(6))]
        if rng.random() < 0.4:
            body.insert(rng.randrange(len(body) + 1), rng.choice(notices))
        d = "/".join(rng.choice("abc") for _ in range(rng.randrange(4)))
        rows.append((i, f"https://h{rng.randrange(3)}.org/{d}{'/' if d else ''}{rng.choice(['LICENSE', 'x.py', 'index.html', '', 'y?license'])}", "\n".join(body)))
    rows += [(900, None, None), (901, "plain", ""), (902, "repo/src/a.py", None), (903, "repo/LICENSE.md", TEMPLATES[2][1]), (903, "repo/LICENSE.md", TEMPLATES[2][1])]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS row", "2 AS license", "3 AS d")
    got = sorted((tuple(r) for r in scan_licenses(df, markup=False).collect()), key=str)
    want = sorted(brute(rows), key=lambda x: str(tuple(getattr(v, "expected", v) for v in x)))
    assert len(got) == len(want)
    for g, w in zip(sorted(got, key=lambda x: (x[0], str(x[1]))), sorted(want, key=lambda x: (x[0], str(x[1]))), strict=True):
        assert g == w
    assert ("repo/", "inherited") in {(r[4], r[3]) for r in got if r[0] == 902}


def test_markup_and_empty(spark):
    df = spark.createDataFrame([(1, "http://a/x", "<p>hi<b>Released under</b> the MIT <script>All rights reserved.</script>"), (2, "http://a/y", "<p>one</p><p>Released under the MIT License.</p>")], "page_id long, url string, html string")
    got = {r["id"]: r["license"] for r in scan_licenses(df).collect()}
    assert got == {1: None, 2: "MIT"}
    assert scan_licenses(df.limit(0)).count() == 0
    assert [r["license"] for r in scan_licenses(df, templates=[]).collect()] == [None, None]
