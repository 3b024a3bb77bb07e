import hashlib
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spelunka.llm import substring


def slow(docs, window=13):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in docs]
    least = {}
    for (i, _), w in zip(docs, words):
        for k in range(len(w) - window + 1) if i is not None else ():
            key = tuple(w[k : k + window])
            least[key] = min(i, least.get(key, i))
    out = []
    for (i, _), w in zip(docs, words):
        gone = set()
        for k in range(len(w) - window + 1) if i is not None else ():
            if least[tuple(w[k : k + window])] < i:
                gone.update(range(k, k + window))
        kept = [x for k, x in enumerate(w) if k not in gone]
        out.append((i, len(w), len(w) - len(kept), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return out


@pytest.mark.parametrize("bucket_bytes,max_cells", [(substring.BUCKET_BYTES, substring.MAX_CELLS), (100, substring.MAX_CELLS), (1000, 0)])
def test_against_brute_force(spark, bucket_bytes, max_cells):
    rng = np.random.default_rng(11)
    some = lambda n: " ".join(rng.choice(["the", "of", "Ée", "x", "word", "and", "zz y", "q1", "r", "s"], n))
    shared = [some(n) for n in (13, 14, 20, 60)]
    docs = [(int(i), some(rng.integers(0, 30)) + "\t\n" + shared[i % 4] + " " + some(rng.integers(0, 15))) for i in rng.permutation(80)]
    docs += [(200, None), (201, ""), (None, shared[3]), (None, shared[3]), (202, shared[0]), (203, shared[0].replace(" ", " \r\n ")), (203, shared[0]), (204, some(12)), (205, "w " * 5000), (206, "w " * 40), (207, shared[1] + " " + shared[1]), (-5, shared[2])]
    df = spark.createDataFrame([(i, t, "clash", 2) for i, t in docs], "doc_id long, text string, row string, at int")
    got = substring.dedup_substrings(df, bucket_bytes=bucket_bytes, max_cells=max_cells).select("id", "n_words", "n_removed", F.sha2("kept", 256)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(slow(docs), key=str)


def test_empty_table(spark):
    assert substring.dedup_substrings(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("max_cells", [substring.MAX_CELLS, 0])
def test_one_window_very_often(spark, max_cells):
    df = spark.createDataFrame([(1, "w " * 200_000), (2, "w " * 200_000), (3, "x " + "w " * 13), (4, "y" * 100_000 + " w" * 12)], "doc_id long, text string")
    got = {r.id: (r.n_words, r.n_removed) for r in substring.dedup_substrings(df, max_cells=max_cells).collect()}
    assert got == {1: (200_000, 0), 2: (200_000, 200_000), 3: (14, 13), 4: (13, 0)}
    part = pa.RecordBatch.from_pydict({"id": [1, 2], "row": [1, 2], "text": ["w " * 200_000] * 2})
    sent = type("Sent", (), {"value": [b"\xff" * 512] * 2})
    rows = pa.Table.from_batches(list(substring._candidates(sent, 4096, 13, 4)([part]))).to_pylist()
    assert sum(len(r["at"]) // 4 for r in rows) == 2  # one entry for the smaller document, and one that is settled


def test_estimates_are_never_low():
    """Of every window: its minimizer is counted at least as often as it occurs."""
    rng = np.random.default_rng(3)
    for letters, n in ((1, 1000), (2, 3000), (3, 3000), (50, 500)):
        words = rng.integers(0, letters, n).astype(str).tolist()
        found = substring.Words(" ".join(words))
        first, keys = substring.window_keys(found.hashes())
        counts, windows = Counter(keys.tolist()), Counter(tuple(words[i : i + 13]) for i in range(n - 12))
        each = np.repeat(keys, np.diff(np.r_[first, n - 12])).tolist()
        assert all(counts[k] >= windows[tuple(words[i : i + 13])] for i, k in enumerate(each))


def test_judged_while_streaming(monkeypatch):
    """Buckets settle again and again; the smallest document comes last."""
    monkeypatch.setattr(substring, "HELD", 10)
    h = np.arange(40, dtype=np.uint64).reshape(-1, 2)
    parts = [b for doc in (9, 7, 7, 8, 3) for b in substring._packed(np.zeros(20, np.int64), h, np.zeros(20, np.int64), np.arange(20), np.array([doc]), np.array([doc * 10]))]
    lost = set()
    for r in (r for b in substring._judge(parts, 4) for r in b.to_pylist()):
        _, ids, rows, at = substring._unpacked(r["h"], r["who"], r["at"], r["ids"], r["rows"], 0)
        assert (rows == ids * 10).all() and (substring.group_of(ids, rows, 4) == r["bucket"]).all()
        lost.update(zip(ids.tolist(), at.tolist()))
    assert lost == {(doc, p) for doc in (7, 8, 9) for p in range(20)}
