"""The pipeline's near-duplicate stage against brute-force Jaccard similarity."""

import numpy as np
import pytest

import corpus_pipeline as C
from spelunka.llm import nearcopies, simhash


def slow_shingles(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def slow_classes(texts):
    sets = [slow_shingles(t) for t in texts]
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if 9 * len(sets[i] & sets[j]) >= 4 * (len(sets[i]) + len(sets[j])) and label[i] != label[j]:
                a, b = sorted((label[i], label[j]))
                label = [a if x == b else x for x in label]
    return label


def cases():
    rng = np.random.default_rng(21)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = [None, "", " \n", "one", "One", "a b c d e", "a b c d e f"]
    for _ in range(60):
        base = rng.choice(vocabulary, rng.integers(60, 300)).tolist()
        texts.append(" ".join(base))
        for _ in range(4):
            edited = list(base)
            for at in rng.integers(0, len(base), rng.integers(1, max(2, len(base) // 30))).tolist():
                edited[at] = str(rng.choice(vocabulary)).upper()
            texts.append(" ".join(edited))
            base = edited if rng.random() < 0.5 else base
    return texts


def test_stage_against_brute_force(spark):
    texts = cases()
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    want = slow_classes(texts)
    assert 60 < len(set(want)) < len(texts) - 100
    assert {r.doc_id for r in C.stage_near_duplicates(spark, docs.repartition(5), "").collect()} == set(want)
    assert C.stage_near_duplicates(spark, docs.limit(0), "").count() == 0


def test_one_row_of_each_class_stays(spark):
    text = lambda k: " ".join(f"{k}w{i}" for i in range(80))
    rows = [(1, text("a")), (1, text("a")), (1, text("a") + " end"), (2, text("a")), (2, text("b")), (3, text("b") + " end"), (4, text("c")), (4, text("d")), (None, text("a")), (None, text("a"))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r.doc_id, r.text.removesuffix(" end")) for r in C.stage_near_duplicates(spark, docs.repartition(4), "").collect()]
    assert sorted(got, key=str) == sorted([(1, text("a")), (2, text("b")), (4, text("c")), (4, text("d")), (None, text("a")), (None, text("a"))], key=str)


def test_similar_at_the_bound():
    sets = [np.arange(8, dtype=np.uint64), np.arange(10, dtype=np.uint64), np.arange(7, dtype=np.uint64), np.arange(100, 110, dtype=np.uint64)]
    assert nearcopies.similar(sets).tolist() == [0, 0, 0, 3]


@pytest.mark.parametrize("block", [nearcopies.BLOCK, 700])
def test_classes_in_blocks(spark, block):
    """Parts in one task and parts split into blocks: chains whose ends are not similar, and one large group."""
    rng = np.random.default_rng(8)
    base = [f"w{i}" for i in rng.integers(0, 900, 120)]
    texts = cases()
    for k in range(60):  # a chain: each differs from the one before in two places
        base = list(base)
        for at in rng.integers(0, 120, 2).tolist():
            base[at] = f"x{k}"
        texts.append(" ".join(base))
    found = nearcopies.classes(spark.createDataFrame([(t,) for t in texts], "text string").repartition(4), block=block).collect()
    root = {r.key: r.root for r in found}
    keys = [int(np.array([nearcopies.key_of(nearcopies.words_of(t))], np.uint64).view(np.int64)[0]) for t in texts]
    got, want = [root.get(k, k) for k in keys], slow_classes(texts)
    assert len(root) == len(found) and {(a, b) for a, b in zip(got, want)} == set(dict(zip(got, want)).items()) == {(a, b) for b, a in dict(zip(want, got)).items()}


def test_index_finds_close_fingerprints(spark):
    """The candidates of op10's index: fingerprints within its bits are in one component."""
    texts = cases()
    edges = nearcopies.index_edges(spark.createDataFrame([(t,) for t in texts], "text string"))
    part = {r.node: r.root for r in simhash.components(edges).collect()}
    keys = np.array([nearcopies.key_of(nearcopies.words_of(t)) for t in texts], np.uint64).view(np.int64).tolist()
    prints = [simhash.fingerprint(t, 5, nearcopies.SEED) for t in texts]
    close = [(a, b) for a in range(len(texts)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 4 and keys[a] != keys[b]]
    assert len(close) > 20 and all(part[keys[a]] == part[keys[b]] for a, b in close)
