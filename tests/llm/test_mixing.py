import collections
import hashlib

import duckdb
import pytest

from spelunka.llm import mixing


def test_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    got = sorted(tuple(r) for r in mixing.op8_mixing(spark, sf).select("doc_id", "topic", "tokens", "weight", "probability", "sampled").collect())
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = sorted(db.sql(mixing.ORACLE).fetchall())
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert a[:3] == b[:3] and a[5] == b[5] and a[3] == pytest.approx(b[3], abs=2e-9) and a[4] == pytest.approx(b[4], abs=2e-6)


def test_marginals_and_edges(spark):
    docs = [(i, ("x" * (40 + i)) if i % 3 else ("Copyright " * 9), ["en", "fr", None][i % 3], ["a", "a", "a", "b", None][i % 5], 7) for i in range(300)]
    docs += [(None, None, None, None, 7), (5, "", "en", "b", 7), (5, "", "en", "b", 7)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, p int")
    got = mixing.mixed(df).collect()
    assert len(got) == len(docs) and got[0].p == 7
    cells = {(r.source, r.lang, r["__topic"]): r["__weight"] for r in got}
    tokens = collections.Counter()
    for r in got:
        tokens[r.source] += r["__tokens"]
    for source in tokens:
        want = tokens[source] ** 0.7 / sum(v**0.7 for v in tokens.values())
        assert sum(w for k, w in cells.items() if k[0] == source) == pytest.approx(want, rel=0.02)
    spent = sum(r["__p"] * r["__tokens"] for r in got)
    assert spent == pytest.approx(0.7 * sum(r["__tokens"] for r in got), rel=1e-6)
    for r in got:
        u = int(hashlib.md5(str(r.doc_id if r.doc_id is not None else "").encode()).hexdigest()[:8], 16) / 2**32
        assert r["__kept"] == (u < r["__p"])
    assert mixing.mixed(df.limit(0)).count() == 0


def test_converges_and_takes_targets(spark):
    """After the default rounds all three marginals meet given targets; nothing is broadcast."""
    rows = [(s, g, t, (1 + len(s + g + t) * 7 % 5) * (1 + i)) for i, (s, g, t) in enumerate((s, g, t) for s in ("web", "books", "code", "mail") for g in ("en", "de", "fr") for t in ("x", "yy", "zzz"))]
    cells = spark.createDataFrame(rows, "source string, lang string, topic string, tokens long")
    want = {"source": {"web": 0.4, "books": 0.3, "code": 0.2, "mail": 0.1}, "lang": {"en": 0.5, "de": 0.25, "fr": 0.25}, "topic": {"x": 0.2, "yy": 0.3, "zzz": 0.5}}
    targets = {part: spark.createDataFrame(list(shares.items()), f"{part} string, share double") for part, shares in want.items()}
    for most in (mixing.MAX_BROADCAST_CELLS, 0):
        got = mixing.raked(cells, targets, max_broadcast=most).collect()
        for part, shares in want.items():
            sums = collections.Counter()
            for r in got:
                sums[r[part]] += r["weight"]
            assert dict(sums) == pytest.approx(shares, abs=1e-6)
    ratio = {(r.source, r.lang, r.topic): r.weight / r.tokens for r in got}
    assert ratio["web", "en", "x"] * ratio["code", "de", "x"] == pytest.approx(ratio["web", "de", "x"] * ratio["code", "en", "x"])  # fitting keeps odds ratios


def test_clashing_names(spark):
    df = spark.createDataFrame([(i, "word " * (i + 1), "en", "s", 1, 2, 3, 4, 5) for i in range(20)], "doc_id long, text string, lang string, source string, __p int, __s int, __weight int, __cell_source int, `a.b` int")
    got = mixing.mixed(df)
    assert [c for c in got.columns if c in ("__s", "__cell_source", "a.b")] == ["__s", "__cell_source", "a.b"]
    assert all((r["__s"], r["__cell_source"], r["a.b"]) == (2, 4, 5) and 0 <= r["__p"] <= 1 for r in got.collect())
