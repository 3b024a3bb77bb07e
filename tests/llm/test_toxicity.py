from collections import Counter

import numpy as np
import zstandard

from spelunka.llm import toxicity


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    got = toxicity.op2_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").toPandas()
    held = got[got.held_out]
    hit = ((held.predicted == 1) & (held.toxic == 1)).sum()
    precision, recall = hit / max(1, (held.predicted == 1).sum()), hit / (held.toxic == 1).sum()
    print("precision", precision, "recall", recall)
    assert precision > 0.85 and recall > 0.75
    assert ((held.score >= 0.5) == (held.predicted == 1)).all() and held.score.between(0, 1).all()


def test_edges(spark):
    rows = spark.createDataFrame([(i, "you utter fool " * 9 if i % 2 else "a calm and ordinary sentence " * 5, i % 2) for i in range(40)], "id long, text string, toxic int")
    model = toxicity.learn(rows)
    df = spark.createDataFrame([(1, None, "x"), (None, "", "x"), (3, "123", "x"), (4, "you utter fool you utter fool", "x"), (4, "a calm and ordinary sentence", "x"), (5, "z" * 200000, "x")], "doc_id long, text string, id string")
    clashing = toxicity.with_scores(df.selectExpr("*", "1 as __text", "'s' as __score", "2 as `a.b`"), model)
    assert clashing.columns == ["doc_id", "text", "id", "__text", "a.b", "__score", "__predicted"] and {(r["__text"], r["a.b"]) for r in clashing.collect()} == {(1, 2)}
    got = toxicity.with_scores(df, model).collect()
    assert len(got) == 6 and all(0 <= r["__score"] <= 1 for r in got) and got[0].id == "x"
    for only, want in ((rows.where("toxic = 0"), 0), (rows.where("toxic = 1"), 1), (rows.limit(0), 0)):
        assert {r["__predicted"] for r in toxicity.with_scores(df, toxicity.learn(only)).collect()} == {want}
    assert toxicity.with_scores(df.limit(0), model).count() == 0


def test_sample_is_bounded(spark):
    rows = spark.range(20_000).selectExpr("id", "concat('w', id) as text", "cast(id % 2 as int) as toxic")
    for n in (100, 500, 3000):
        found, totals = toxicity._sampled(rows, n)
        counts = {r["toxic"]: r["count"] for r in found.groupBy("toxic").count().collect()}
        assert totals == [10_000, 10_000] and all(0.8 * n <= counts[c] <= n for c in (0, 1))
    assert toxicity._sampled(rows, 20_000)[0].count() == 20_000


def test_learning_against_plain_python(spark):
    """The contrast, the training text, the dictionaries and the regression, again without Spark."""
    rng = np.random.default_rng(5)
    calm, rude = "river stone window garden letter morning silver winter candle harbour".split(), "blockhead scoundrel numbskull".split()
    data = []
    for i in range(300):
        words = rng.choice(calm, 30).tolist()
        if i % 3 == 0:
            words[4:5] = [rude[i // 3 % 3]]
            words[20:21] = [rude[i // 9 % 3]]
        data.append((i, " ".join(words), int(i % 3 == 0)))
    model = toxicity.learn(spark.createDataFrame(data, "id long, text string, toxic int"))
    contexts = {(y, tuple([None, *w, None][j : j + 3])) for _, t, y in data for w in [t.split()] for j in range(len(w))}
    size = [sum(y == c for y, _ in contexts) for c in (0, 1)]
    count = [Counter(), Counter()]
    for y, (_, word, _) in contexts:
        count[y].update({(" " + word + " ")[k : k + 6] for k in range(max(1, len(word) - 3))})
    far = {g for g, n in count[1].items() if n >= max(8, 6e-5 * size[1]) and n / size[1] >= 5 * (count[0][g] + 1) / size[0]}
    covered = Counter(" " + word + " " for y, (_, word, _) in contexts if y and all((" " + word + " ")[k : k + 6] in far for k in range(len(word) - 3)))
    assert set(covered) == {f" {w} " for w in rude}
    toxic = zstandard.train_dictionary(2048, toxicity._repeated([(w.encode(), n) for w, n in covered.items()]), k=32, d=8, level=3).as_bytes()
    assert model["pair"][1].endswith(toxic) and model["f1"] == 1.0 and not any(w.encode() in model["pair"][0] for w in rude)
    features = []
    for _, text, _ in data:
        words = text.split()
        gains = []
        for k in range(0, 30, 8):
            window = "".join(" " + w for w in words[k : k + 8]).encode()
            sizes = [len(zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False, write_dict_id=False).compress(window)) for d in model["pair"]]
            gains.append(sizes[0] - sizes[1])
        features.append((sum(gains), sum(g for g in gains if g > 0), max(gains), 30))
    x, y = toxicity.design(np.array(features, float)), np.array([y for _, _, y in data], float)

    def loss(b):
        z = x @ b
        return np.logaddexp(0, z).sum() - y @ z + 0.5 * (b[1:] @ b[1:]) + 0.5e-6 * b[0] ** 2

    b = toxicity.fit_logistic(x, y, np.ones(300))
    assert all(loss(b) <= loss(b + step) + 1e-9 for step in 0.01 * rng.standard_normal((200, len(b))))
    got = toxicity.with_scores(spark.createDataFrame(data, "id long, text string, toxic int"), model).collect()
    want = 1 / (1 + np.exp(-(x @ model["b"])))
    assert np.allclose([r["__score"] for r in sorted(got)], want) and [r["__predicted"] for r in sorted(got)] == [y for _, _, y in data]
    assert np.allclose(model["b"][1:], b[1:], atol=1e-6)


def test_stretches():
    good = frozenset(toxicity.grams(b" fool")) & {b" fool "}
    assert toxicity.stretches(b" fool", good) == [b" fool "]
    assert toxicity.stretches(b" fools", good) == []
    z = np.array([3.0, 2.0, 1.0, 0.0])
    assert toxicity.best_threshold(z, np.array([1.0, 1, 0, 0]), np.ones(4)) == 1.5
