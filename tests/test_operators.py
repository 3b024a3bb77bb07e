import pytest
from pyspark.sql import functions as F

from spelunka.operators import history as H
from spelunka.operators import hygiene as Y
from spelunka.operators import packing as P
from spelunka.operators import search as S
from spelunka.operators import telemetry as T


def test_greedy_skip(spark):
    df = spark.createDataFrame([(1, 5, "f", 9.0), (2, 9, "f", 8.0), (3, 4, "f", 7.0), (4, 1, "g", 6.0)], "id long, size long, file string, score double")
    order = [F.desc("score"), F.col("id")]
    assert sorted(r.id for r in P.greedy_skip(df, 10, order, "size", "id").collect()) == [1, 3, 4]
    got = {r.id: r.adjusted for r in P.diverse_pack(df, 100, order, "size", "id", "file", "score", per_file=2).collect()}
    assert got == {1: 9.0, 2: 4.0, 4: 6.0}
    assert [r.id for r in P.prefix_pack(df, 13, order, "size").collect()] == [1]


def test_winnow_refuses(spark):
    for bad in (("nope", "eq", 1), ("kind", "matches", "x"), ("kind", "eq", None)):
        with pytest.raises(ValueError):
            S.criterion(*bad)
    df = spark.createDataFrame([(1, "a", ["@x.Route"], 5), (2, "b", [], 9)], "id long, name string, decorators array<string>, cyclomatic int")
    assert [r.id for r in S.winnow(df, [("decorator", "contains", "route")], "complexity").collect()] == [1]
    with pytest.raises(ValueError):
        S.check_regex("(a+)+b")


def test_bm25_formula(spark):
    import math

    docs = spark.createDataFrame([(1, "red bolt red"), (2, "blue bolt"), (3, "green nut ring"), (4, "")], "id long, t string")
    got = {r.id: r.score for r in S.bm25(S.postings(docs, "id", {"t": 1}), "red bolt").collect()}
    n, avgdl = 3, (2 + 2 + 3) / 3
    idf = lambda df: math.log((n - df + 0.5) / (df + 0.5) + 1)
    part = lambda df, tf, dl: idf(df) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))
    assert got[1] == pytest.approx(part(1, 2, 2) + part(2, 1, 2)) and got[2] == pytest.approx(part(2, 1, 2)) and set(got) == {1, 2}


def test_diff_overlay_changes(spark):
    a = spark.createDataFrame([("f", "x", "k", "h1", "s"), ("f", "y", "k", "", "s"), ("f", "z", "k", "h", "s")], "file string, name string, kind string, content_hash string, signature string").withColumn("id", F.col("name"))
    b = spark.createDataFrame([("g", "x", "k", "h2", "s"), ("f", "y", "k", "h", "t"), ("f", "w", "k", "h", "s")], "file string, name string, kind string, content_hash string, signature string").withColumn("id", F.col("name"))
    assert {r.name: r.change for r in H.symbol_diff(a, b).collect()} == {"x": "changed", "y": "changed", "z": "removed", "w": "added"}
    known = spark.createDataFrame([("a", 1, "h"), ("b", 1, "h"), ("c", 1, "h"), ("d", 1, ""), ("e", 1, "h")], "path string, mtime long, hash string")
    found = spark.createDataFrame([("a", 1, "other"), ("b", 2, "h"), ("c", 2, "x"), ("d", 1, "h"), ("f", 1, "h")], "path string, mtime long, hash string")
    assert {r.path: r.state for r in H.detect_changes(known, found).collect()} == {"b": "touched", "c": "changed", "d": "new", "e": "deleted", "f": "new"}
    base = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "file string, v int")
    delta = spark.createDataFrame([("b", 20, "modify"), ("c", None, "delete"), ("d", 4, "add")], "file string, v int, action string")
    assert sorted(map(tuple, H.compose_branch(base, delta).collect())) == [("a", 1), ("b", 20), ("d", 4)]


def test_sessions_boundary(spark):
    rows = [(i, 1, s, 10.0) for i, s in enumerate((0, 30, 61))]
    df = spark.createDataFrame(rows, "event_id long, user long, s long, size double").withColumn("ts", F.timestamp_seconds("s"))
    assert [r.turn for r in T.sessions(df, "user", "size", 15.0).orderBy("event_id").collect()] == [0, 0, 1]


def test_enclosing_and_calls(spark):
    ranges = spark.createDataFrame([("f", 1, 300, "outer"), ("f", 100, 200, "inner"), ("g", 1, 9, "other")], "file string, start long, end long, id string")
    points = spark.createDataFrame([("f", 150), ("f", 250), ("f", 400), ("g", 5)], "file string, pos long")
    assert {(r.file, r.pos): r.id for r in Y.enclosing(points, ranges).collect()} == {("f", 150): "inner", ("f", 250): "outer", ("g", 5): "other"}


def test_dead_code(spark):
    files = spark.createDataFrame([(f,) for f in ("main.py", "lib.py", "orphan.py", "leaf.py", "test_lib.py")], "file string")
    edges = spark.createDataFrame([("main.py", "lib.py"), ("orphan.py", "leaf.py"), ("test_lib.py", "lib.py")], "src string, dst string")
    assert {r.file: r.confidence for r in Y.dead_files(files, edges).collect()} == {"orphan.py": 1.0, "leaf.py": 0.7, "test_lib.py": 0.9}


def test_quality_metrics(spark):
    predicted = spark.createDataFrame([("q", "a", 1), ("q", "b", 2), ("none", "a", 1)], "query string, id string, rank int")
    relevant = spark.createDataFrame([("q", "b"), ("q", "z")], "query string, id string")
    got = {r["query"]: r for r in T.ranking_quality(predicted, relevant).collect()}
    assert got["q"].recall == 0.5 and got["q"].mrr == 0.5 and got["none"].ndcg == 0
    soft = {r["query"]: r for r in T.soft_precision(spark.createDataFrame([("q", "Mod.fn", 1), ("q", "other", 2)], "query string, id string, rank int"), spark.createDataFrame([("q", "fn")], "query string, id string")).collect()}
    assert soft["q"].precision == 0.5 and soft["q"].recall == 1.0


def test_fuzzy_pairs_complete(spark):
    names = ["alpha", "alpah", "beta", "betas", "gamma", "a", "ab", "xyz", "delta force", "delta farce"]
    df = spark.createDataFrame([(n,) for n in names], "name string")

    def grams(s):
        return {s[i : i + 3] for i in range(len(s) - 2)} or {s}

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    want = {(a, b) for a in names for b in names if len(grams(a) & grams(b)) / len(grams(a) | grams(b)) >= 0.4 or edits(a, b) <= 2}
    assert {(r.a, r.b) for r in S.fuzzy_pairs(df, df).collect()} == want


def test_stale_references_complete(spark):
    refs = ["xrinx", "mod.aplhb", "zzzzzzzz", "ring", "bcdefg", "abc"]
    names = ["ring", "xxaanx", "alpha", "bolt", "xcdefx", "abcdexx", "é"]

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    want = {}
    for ref in (r.split(".")[-1] for r in refs):
        if len(ref) > 3 and ref not in names:
            want[ref] = min(((edits(ref, n), n) for n in names if edits(ref, n) <= 3), default=(None, None))[1]
    assert want["xrinx"] == "ring"
    got = Y.stale_references(spark.createDataFrame([(r,) for r in refs], "ref string"), spark.createDataFrame([(n,) for n in names], "name string"))
    assert {r.ref: r.suggestion for r in got.collect()} == want


def test_refactor_plans(spark):
    from spelunka.operators import refactor as R

    lines = spark.createDataFrame([("a.py", 1, "from b import old"), ("b.py", 1, "def old(x):"), ("b.py", 2, "    return helper(x) + older"), ("a.py", 2, "y = old(f(1), 2)"), ("a.py", 3, "'old'"), ("c.py", 1, "old()")], "file string, line int, text string")
    edges = spark.createDataFrame([("a.py", "b.py")], "src string, dst string")
    files = R.affected_files(edges, spark.createDataFrame([("b.py",)], "file string"))
    plan = {(r.file, r.line): (r.kind, r.after) for r in R.rename_plan(lines, files, "old", "new").collect()}
    assert plan == {("a.py", 1): ("import", "from b import new"), ("b.py", 1): ("definition", "def new(x):"), ("a.py", 2): ("usage", "y = new(f(1), 2)")}
    assert [r.arguments for r in R.call_sites(lines, files, "old").collect()] == ["f(1), 2"]
    symbols = spark.createDataFrame([("s", "b.py", "old", 1, 2), ("t", "c.py", "old", 1, 1)], "id string, file string, name string, line int, end_line int")
    imports = spark.createDataFrame([("b.py", "u", ["helper", "unused"])], "file string, specifier string, names array<string>")
    moved = R.move_plan(symbols, lines, imports, "s", "c.py")
    assert moved["body"].count() == 2 and [r.name for r in moved["needed"].collect()] == ["helper"] and [r.id for r in moved["collisions"].collect()] == ["t"]
    table = spark.createDataFrame([("src/long/path.py", i) for i in range(6)] + [("x", 9)], "file string, n int")
    legend, rows = R.compact_table(table, ["file", "n"])
    back = {r.code: r.value for r in legend.collect()}
    got = sorted(tuple(r.row.split("\t")) for r in rows.collect())
    assert sorted((back.get(a, a), int(b)) for a, b in got) == sorted((r.file, r.n) for r in table.collect()) and "@1" in {a for a, _ in got}
