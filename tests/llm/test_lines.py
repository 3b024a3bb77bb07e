import numpy as np
import pytest
from pyspark.sql import functions as F

from spelunka.llm import lines

BIG = "This line is certainly long enough to count"


def cases():
    rng = np.random.default_rng(5)
    pool = [f"Some shared line number {i} with éü text" for i in range(40)] + ["short", "", "   ", "ééééééééééééééééééé", "éééééééééééééééééééé"]
    docs = [(int(i), "\n".join(rng.choice(pool, rng.integers(0, 12)))) for i in range(60)]
    docs += [(100, None), (101, ""), (None, BIG), (None, BIG), (102, BIG), (103, f"  {BIG.upper()}\t\n{BIG}"), (104, BIG + "\r\n" + BIG), (104, BIG + "\r\n" + BIG), (105, ("x" * 30 + "\n") * 3000), (106, "x" * 30), (107, " " + "x" * 30)]
    return docs


@pytest.mark.parametrize("limit", [lines.MAX_BROADCAST_BYTES, 0])
def test_against_brute_force(spark, limit):
    docs = cases()
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in docs], "doc_id long, text string, row string, shard int")
    found = lines.dedup_lines(df, max_broadcast_bytes=limit, shard_keys=7, salts=3)
    got = found.select("id", "n_lines", "n_dropped", F.sha2(F.coalesce("kept", F.lit("")), 256)).collect()
    order = lambda x: tuple((v is None, v) for v in x)
    assert sorted(map(tuple, got), key=order) == sorted(lines.brute_force(docs), key=order)
    assert sum(r[2] for r in got) > 100


@pytest.mark.parametrize("limit", [lines.MAX_BROADCAST_BYTES, 0])
def test_repeated_rows_are_one_document(spark, limit):
    other = "Another line that is long enough to count"
    docs = [(1, BIG), (1, BIG), (2, BIG), (3, other), (3, other + "\nx"), (4, other), (5, other)]
    found = lines.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), max_broadcast_bytes=limit)
    assert sorted((r.id, r.n_dropped) for r in found.collect()) == [(1, 0), (1, 0), (2, 0), (3, 1), (3, 1), (4, 1), (5, 0)]


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert lines.dedup_lines(df).count() == 0
    assert lines.dedup_lines(df, max_broadcast_bytes=-1).count() == 0


def test_minimal_perfect():
    rng = np.random.default_rng(6)
    for n in (1, 2, 3, 10, 1000, 20000):
        h1, h2 = (rng.integers(0, 2**63, n).astype(np.uint64) for _ in range(2))
        seeds, slots = lines.build_shard(h1, h2)
        assert sorted(slots.tolist()) == list(range(n))
        at = np.argsort(slots)
        row = {"shard": 0, "seeds": seeds.tobytes(), "prints": (h1 ^ lines._mixed(h2, 7))[at].tobytes(), "counts": np.arange(1, n + 1)[at].astype(np.int32).tobytes(), "lasts": np.arange(n)[at].astype(np.int64).tobytes()}
        counts, lasts = lines.Shards([row], 1).probe(h1, h2)
        assert (counts == np.arange(1, n + 1)).all() and (lasts == np.arange(n)).all()
        counts, _ = lines.Shards([row], 1).probe(h2, h1)
        assert not counts.any()


def test_more_copies_for_frequent_keys(spark, monkeypatch):
    monkeypatch.setattr(lines, "ROWS_PER_COPY", 1)
    docs = cases()
    found = lines.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string"), max_broadcast_bytes=0, shard_keys=7, salts=1)
    got = found.select("id", "n_lines", "n_dropped", F.sha2(F.coalesce("kept", F.lit("")), 256)).collect()
    order = lambda x: tuple((v is None, v) for v in x)
    assert sorted(map(tuple, got), key=order) == sorted(lines.brute_force(docs), key=order)
