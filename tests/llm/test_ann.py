import numpy as np
import pytest

from spelunka.llm import ann


def brute(rows, k=5, every=50):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and len(v) == 16 and all(x is not None and np.isfinite(x) for x in v) and any(x for x in v)]
    ids = np.array([i for i, _ in good])
    x = np.array([v for _, v in good])
    x /= np.linalg.norm(x, axis=1)[:, None]
    out = {}
    for q in np.flatnonzero(ids % every == 0):
        s = x @ x[q]
        order = sorted((j for j in range(len(ids)) if ids[j] != ids[q]), key=lambda j: (-round(s[j], 9), ids[j]))[:k]
        out[int(ids[q])] = [(int(ids[j]), s[j]) for j in order]
    return out


def rows():
    rng = np.random.default_rng(9)
    centres = rng.standard_normal((20, 16))
    data = [(i, (centres[i % 20] + 0.3 * rng.standard_normal(16)).tolist()) for i in range(1500)]
    same = centres[0].tolist()
    data += [(i, same) for i in range(1500, 2200)]
    data += [(3000, None), (3050, [0.0] * 16), (3100, [None] * 16), (3150, [float("nan")] * 16), (3200, [1.0] * 3), (None, same), (3250, [float("inf")] + [1.0] * 15)]
    return data


def test_recall_and_ties(spark):
    data = rows()
    df = spark.createDataFrame([(i, v, "clash", 1) for i, v in data], "vec_id long, embedding array<float>, cid string, id int")
    want = brute([(i, v and [np.float32(x) if x is not None else None for x in v]) for i, v in data])
    vector, got = {i: v for i, v in data if i is not None}, {}
    for r in ann.nearest(df).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(got) == set(want)
    hits = total = 0
    for q, answers in want.items():
        mine = sorted(got[q])
        assert [r for r, _, _ in mine] == list(range(1, 6))
        hits += len({i for i, _ in answers} & {i for _, i, _ in mine})
        x = np.array([np.float32(v) for v in vector[q]], float)
        for _, i, score in mine:
            y = np.array([np.float32(v) for v in vector[i]], float)
            assert abs(score - x @ y / np.linalg.norm(x) / np.linalg.norm(y)) < 1e-12
        total += 5
        if 1500 <= q < 2200:
            assert [i for _, i, _ in mine] == [i for i in range(1500, 1507) if i != q][:5]
    assert hits / total >= 0.95


def test_small_and_empty(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0])], "vec_id long, embedding array<double>")
    assert [(r.rank, r.vec_id) for r in sorted(ann.nearest(df).collect())] == [(1, 2), (2, 1)]
    assert ann.nearest(df.limit(0)).count() == 0


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_recall_on_embeddings(spark, sf):
    """The query's own table and parameters; scores against double-precision cosines."""
    table = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").toPandas()
    x, ids = np.array(table["embedding"].tolist(), float), table["vec_id"].to_numpy()
    x /= np.linalg.norm(x, axis=1)[:, None]
    place, hits, total = {int(i): k for k, i in enumerate(ids)}, 0, 0
    got = {}
    for r in ann.op6_ann(spark, f"/root/testdata/{sf}").collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(got) == {int(i) for i in ids if i % 50 == 0}
    for q, mine in got.items():
        score = x @ x[place[q]]
        score[place[q]] = -np.inf
        best = set(ids[np.argsort(-score)[:5]].tolist())
        hits, total = hits + len(best & {i for _, i, _ in mine}), total + len(best)
        assert sorted(mine) == sorted(mine, key=lambda m: (-m[2], m[1])) and all(abs(s - score[place[i]]) < 1e-12 for _, i, s in mine)
    print(sf, "recall", hits / total)
    assert hits / total >= 0.9


def test_sizes_do_not_matter(spark):
    """Components whose squares under- or overflow; leaves split into many parts."""
    tiny, huge = [1e-200, 2e-200], [1e200, 2e200]
    df = spark.createDataFrame([(0, tiny), (50, huge), (1, [1.0, 2.0]), (2, [2.0, 1.0]), (3, [5e-324, 0.0])], "vec_id long, embedding array<double>")
    got = {q: [(r.vec_id, round(r.score, 12)) for r in sorted(ann.nearest(df).collect()) if r.query_id == q] for q in (0, 50)}
    low = round(5**-0.5, 12)
    assert got == {0: [(1, 1.0), (50, 1.0), (2, 0.8), (3, low)], 50: [(0, 1.0), (1, 1.0), (2, 0.8), (3, low)]}
    many = spark.createDataFrame(rows(), "vec_id long, embedding array<float>")
    one, split = (sorted(map(tuple, ann.nearest(many, part_rows=p).collect())) for p in (1 << 14, 1))
    assert [r[:3] for r in one] == [r[:3] for r in split]
