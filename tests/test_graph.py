import random

from spelunka.operators import graph as G


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "src string, dst string")


def start(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "node string")


def test_bfs_and_risk(spark):
    chain = edges(spark, [("a", "b"), ("b", "c"), ("c", "d"), ("a", "a")])
    levels = G.bfs(chain, start(spark, "a"), 3)
    assert sorted(map(tuple, levels.collect())) == [("b", 1), ("c", 2), ("d", 3)]
    risk = G.blast_risk(levels).first()
    assert risk.affected == 3 and abs(risk.risk - round((1 + 2**-0.7 + 3**-0.7) / 3, 4)) < 1e-9
    cycle = edges(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("d", "a")])
    assert G.bfs(cycle, start(spark, "a"), 50).count() == 2
    assert {r.node: "".join(r.path) for r in G.paths(cycle, start(spark, "d"), 5).collect()} == {"a": "da", "b": "dab", "c": "dabc"}


def test_pagerank_mass(spark):
    e = edges(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("d", "a")])
    ranks = {r.node: r["rank"] for r in G.pagerank(e, start(spark, "a", "b", "c", "d", "lonely")).collect()}
    assert abs(sum(ranks.values()) - 1) < 1e-6 and min(ranks.values()) > 0 and ranks["a"] > ranks["d"]
    assert G.pagerank(e.limit(0)).count() == 0


def test_components_against_brute_force(spark):
    rng = random.Random(3)
    pairs = [(f"n{rng.randrange(30):02d}", f"n{rng.randrange(30):02d}") for _ in range(38)]
    nodes = sorted({x for p in pairs if p[0] != p[1] for x in p})
    reach = {n: {n} for n in nodes}
    for _ in nodes:
        for a, b in pairs:
            if a != b:
                for n in nodes:
                    if a in reach[n]:
                        reach[n].add(b)
    strong = {n: min(m for m in nodes if m in reach[n] and n in reach[m]) for n in nodes if sum(m in reach[n] and n in reach[m] for m in nodes) > 1}
    assert {r.node: r.component for r in G.strong_components(edges(spark, pairs)).collect()} == strong
    weak = {n: n for n in nodes}
    for _ in nodes:
        for a, b in pairs:
            if a != b:
                weak[a] = weak[b] = min(weak[a], weak[b])
    assert {r.node: r.component for r in G.components(edges(spark, pairs)).collect()} == weak


def test_plates(spark):
    clique = lambda xs: [(a, b, 1.0) for i, a in enumerate(xs) for b in xs[i + 1 :]]
    pairs = spark.createDataFrame(clique([1, 2, 3, 4]) + clique([5, 6, 7, 8]) + [(4, 5, 0.05)], "a long, b long, weight double")
    labels = {r.node: r.label for r in G.label_propagation(pairs).collect()}
    assert len(set(labels.values())) == 2 and len({labels[n] for n in (1, 2, 3, 4)}) == 1
    found = {r.label: r for r in G.plates(G.label_propagation(pairs), pairs).collect()}
    assert {r.size for r in found.values()} == {4} and all(abs(r.cohesion - 1) < 1e-9 for r in found.values())


def test_hierarchy_and_diagram(spark):
    classes = spark.createDataFrame([("A",), ("B",), ("C",)], "name string")
    bases = spark.createDataFrame([("B", "A"), ("C", "B"), ("A", "External")], "child string, base string")
    up, down = G.hierarchy(classes, bases, "B")
    assert sorted(map(tuple, up.collect())) == [("A", 1, False), ("External", 2, True)] and [r.node for r in down.collect()] == ["C"]
    text = G.mermaid(G.prune(edges(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("x", "a")]), 3))
    assert text.count("-->") == 3 and "x" not in text
