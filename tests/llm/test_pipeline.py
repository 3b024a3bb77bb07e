"""The pipeline's stages against plain Python, on a small fixture with nulls, repeats and clashes."""

import hashlib

import numpy as np
import pandas as pd
import pytest

import corpus_pipeline as C
from spelunka.llm import bpe, lines, mixing, toxicity
from tests.llm.test_nearcopies import slow_classes


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    rng = np.random.default_rng(12)
    d = str(tmp_path_factory.mktemp("sf"))
    calm = ["river", "table", "window", "garden", "letter", "music", "stone", "paper", "cloud", "bridge", "orange", "winter"]
    rude = ["wretch", "imbecile", "vermin"]
    texts, toxic = [], []
    for i in range(240):
        words = rng.choice(calm, rng.integers(30, 90)).tolist()
        bad = i % 6 == 0
        for _ in range(8 if bad else 0):
            words.insert(int(rng.integers(0, len(words))), str(rng.choice(rude)))
        text = " ".join(words)
        if i % 5 == 1:
            text += "\nThis boilerplate line stands in very many documents"
        texts.append(text)
        toxic.append(int(bad))
    texts += texts[7:20] + [t + " end" for t in texts[31:40]] + [None, "", "x " * 20000]
    toxic += [0] * (len(texts) - len(toxic))
    ids = list(range(len(texts)))
    docs = pd.DataFrame({"doc_id": pd.array(ids, "Int64"), "text": texts, "lang": ["en", "fr", None] * (len(ids) // 3) + ["en"] * (len(ids) % 3), "source": [f"s{i % 4}" for i in ids], "n_chars": pd.array([len(t or "") for t in texts], "Int64")})
    docs.to_parquet(f"{d}/documents.parquet")
    pd.DataFrame({"doc_id": ids, "quality": 1, "toxic": toxic}).to_parquet(f"{d}/labels.parquet")
    return d


def rows(df):
    return sorted((tuple(r) for r in df.select(*C.COLUMNS).collect()), key=str)


def test_stages(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    before = docs.collect()
    clean = C.stage_toxicity(spark, docs, folder)
    clean.write.parquet(str(tmp_path / "a"))
    clean = spark.read.parquet(str(tmp_path / "a"))
    kept = {r.doc_id for r in clean.collect()}
    wrong = [r.doc_id for r in before if (r.doc_id in kept) == bool(labels[r.doc_id])]
    assert len(wrong) <= 3 and rows(clean) == sorted((tuple(r) for r in before if r.doc_id in kept), key=str)

    deduped = C.stage_lines(spark, clean, folder)
    source = [(r.doc_id, r.text) for r in clean.collect()]
    want = {i: digest for i, _, _, digest in lines.brute_force(source)}
    got = deduped.collect()
    assert {r.doc_id: hashlib.sha256((r.text or "").encode()).hexdigest() for r in got} == want
    assert all(r.n_chars == len(r.text or "") for r in got) and deduped.columns == C.COLUMNS

    near = C.stage_near_duplicates(spark, deduped, folder)
    ordered = sorted(got, key=lambda r: r.doc_id)
    roots = slow_classes([r.text for r in ordered])
    assert {r.doc_id for r in near.collect()} == {ordered[r].doc_id for r in set(roots)}

    mixed = C.stage_mixing(spark, near, folder)
    p = {r.doc_id: r["__p"] for r in mixing.mixed(near).collect()}
    draw = lambda i: int(hashlib.md5(str(i).encode()).hexdigest()[:8], 16) / 2**32
    assert {r.doc_id for r in mixed.collect()} == {i for i in p if draw(i) < p[i]}

    import tiktoken

    path, pattern = bpe.public_vocabulary()
    known = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.load_ranks(path), special_tokens={})
    texts = {r.doc_id: r.text or "" for r in mixed.collect()}
    for r in C.stage_bpe(spark, mixed, folder).collect():
        assert r.n_tokens == len(known.encode_ordinary(texts[r.doc_id]))


def test_scores_equal_plain_python(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = toxicity.learn(toxicity.labelled(docs, spark.read.parquet(f"{folder}/labels.parquet")))
    gains = toxicity.Gains(model["pair"])
    for r in toxicity.with_scores(docs, model).collect():
        z = (toxicity.design(np.array([gains.features(r.text)])) @ model["b"])[0]
        assert r["__score"] == pytest.approx(1 / (1 + np.exp(-np.clip(z, -500, 500)))) and r["__predicted"] == int(r["__score"] >= 0.5)


def test_run_and_empty(spark, folder, tmp_path):
    out = C.run(spark, folder)
    assert out.count() > 20 and set(out.columns) == {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"}
    spark.read.parquet(f"{folder}/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{folder}/labels.parquet").limit(0).write.parquet(str(tmp_path / "labels.parquet"))
    assert C.run(spark, str(tmp_path)).count() == 0
