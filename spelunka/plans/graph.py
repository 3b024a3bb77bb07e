"""Graph queries: the nation trade graph, conversation turns as calls, parts as a class tree."""

from __future__ import annotations

from pyspark.sql import functions as F

from spelunka.operators import graph as G
from spelunka.plans.base import EDGES_SQL, SYMBOLS_SQL, edges, query, symbols, table

NODES = "nodes AS (SELECT n_nationkey AS node FROM nation)"
DEGREES = f"{EDGES_SQL}, {NODES}, deg AS (SELECT node, (SELECT count(*) FROM edges WHERE dst = node) AS fan_in, (SELECT count(*) FROM edges WHERE src = node) AS fan_out FROM nodes)"


def nation_nodes(spark, sf):
    return table(spark, sf, "nation").select(F.col("n_nationkey").alias("node"))


def start(spark, sf):
    """The least nation that another one imports."""
    return edges(spark, sf).agg(F.min("dst").alias("node"))


@query("degree_counts", f"WITH {DEGREES} SELECT * FROM deg WHERE fan_in + fan_out > 0")
def degree_counts(spark, sf):
    return G.degrees(edges(spark, sf))


@query("importer_counts", "SELECT p_brand AS dst, count(*) AS importers, round(0.3 * ln(1 + count(*)), 6) AS bonus FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand")
def importer_counts(spark, sf):
    parts = table(spark, sf, "part")
    per_part = table(spark, sf, "lineitem").groupBy("l_partkey").count()  # counts per part before names come in
    raw = per_part.join(parts, F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("p_brand").alias("dst")).agg(F.sum("count").alias("importers"))
    owners = parts.select(F.col("p_brand").alias("dst")).distinct()
    return raw.join(owners, "dst", "left_semi").withColumn("bonus", F.round(0.3 * F.log1p("importers"), 6))


COUPLING = f"{DEGREES}, coup AS (SELECT *, round(fan_out::DOUBLE / nullif(fan_in + fan_out, 0), 4) AS instability FROM deg)"


@query("coupling_instability", f"WITH {COUPLING} SELECT *, CASE WHEN instability IS NULL THEN 'isolated' WHEN instability <= 0.3 THEN 'stable' WHEN instability <= 0.7 THEN 'neutral' ELSE 'unstable' END AS assessment FROM coup")
def coupling_instability(spark, sf):
    return G.coupling(edges(spark, sf), nation_nodes(spark, sf))


@query("unstable_modules", f"WITH {COUPLING} SELECT count(*) AS modules, count(*) FILTER (WHERE instability > 0.7) AS unstable FROM coup")
def unstable_modules(spark, sf):
    c = G.coupling(edges(spark, sf), nation_nodes(spark, sf))
    return c.agg(F.count("*").alias("modules"), F.count_if(F.col("instability") > 0.7).alias("unstable"))


def _pagerank_sql(rounds):
    parts = [EDGES_SQL, NODES, "n AS (SELECT count(*) AS n FROM nodes)", "outs AS (SELECT src, count(*) AS o FROM edges GROUP BY src)", "r0 AS MATERIALIZED (SELECT node, 1.0::DOUBLE / (SELECT n FROM n) AS rank FROM nodes)"]
    for k in range(1, rounds + 1):
        p = f"r{k - 1}"
        parts.append(
            f"r{k} AS MATERIALIZED (SELECT node, 0.15 / (SELECT n FROM n) + 0.85 * (SELECT coalesce(sum(rank), 0) FROM {p} WHERE node NOT IN (SELECT src FROM outs)) / (SELECT n FROM n) + 0.85 * coalesce((SELECT sum(x.rank / o.o) FROM edges e JOIN {p} x ON x.node = e.src JOIN outs o ON o.src = e.src WHERE e.dst = m.node), 0) AS rank FROM {p} m)"
        )
    return ",\n".join(parts)


@query("pagerank_k20", f"WITH {_pagerank_sql(20)} SELECT node, round(rank, 6) AS rank FROM r20")
def pagerank_k20(spark, sf):
    return G.pagerank(edges(spark, sf), nation_nodes(spark, sf), rounds=20, tolerance=0.0).select("node", F.round("rank", 6).alias("rank"))


@query("symbol_importance", f"WITH {_pagerank_sql(20)}, best AS (SELECT s_nationkey AS node, s_suppkey AS id, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS k FROM supplier) SELECT node AS file, id, round(rank, 6) AS importance FROM r20 JOIN best USING (node) WHERE k = 1 ORDER BY rank DESC, node LIMIT 15")
def symbol_importance(spark, sf):
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("file"), F.lit("function").alias("kind"), F.col("s_acctbal").alias("byte_length"))
    best = G.representative(s, ["class", "function"]).select("file", "id")
    ranks = G.pagerank(edges(spark, sf), nation_nodes(spark, sf), rounds=20, tolerance=0.0)
    found = ranks.join(best, ranks["node"] == best["file"]).orderBy(F.desc("rank"), "node").limit(15)
    return found.select("file", "id", F.round("rank", 6).alias("importance"))


LEVELS = "walk AS (SELECT min(dst) AS node, 0 AS d FROM edges UNION SELECT dst, d + 1 FROM walk JOIN {e} ON src = node WHERE d < {n}), levels AS (SELECT node, min(d) AS depth FROM walk GROUP BY node)"


def _levels(n, extra=EDGES_SQL, e="edges"):
    return f"RECURSIVE {extra}, {LEVELS.format(e=e, n=n)}"


BACK = EDGES_SQL + ", back AS (SELECT dst AS src, src AS dst FROM edges)"
BOTH = BACK + ", und AS (SELECT src, dst FROM edges UNION SELECT src, dst FROM back)"


@query("bfs_depth3", f"WITH {_levels(3, BACK, 'back')} SELECT node, depth FROM levels WHERE depth > 0")
def bfs_depth3(spark, sf):
    return G.bfs(G.reverse(edges(spark, sf)), start(spark, sf), 3)


@query("dependency_edges", f"WITH {_levels(2)} SELECT src, dst, depth AS level FROM edges JOIN levels ON node = src WHERE depth < 2")
def dependency_edges(spark, sf):
    return G.neighbourhood(edges(spark, sf), start(spark, sf), 2)


@query("dependency_edges_both", f"WITH {_levels(1, BOTH, 'und')} SELECT src, dst, depth AS level FROM und JOIN levels ON node = src WHERE depth < 1")
def dependency_edges_both(spark, sf):
    return G.neighbourhood(edges(spark, sf), start(spark, sf), 1, "both")


@query("blast_risk", f"WITH {_levels(3, BACK, 'back')} SELECT coalesce(sum(n), 0)::BIGINT AS affected, round(coalesce(sum(n * pow(depth, -0.7)) / nullif(sum(n), 0), 0), 4) AS risk FROM (SELECT depth, count(*) AS n FROM levels WHERE depth > 0 GROUP BY depth)")
def blast_risk(spark, sf):
    return G.blast_risk(G.bfs(G.reverse(edges(spark, sf)), start(spark, sf), 3))


@query("reachable_set", f"WITH {_levels(30, BOTH, 'und')} SELECT node FROM levels")
def reachable_set(spark, sf):
    return G.reachable(G.both_ways(edges(spark, sf)), start(spark, sf))


@query("impact_paths", f"WITH RECURSIVE {BACK}, walk AS (SELECT min(dst) AS node, 0 AS d, [min(dst)] AS path FROM edges UNION ALL SELECT dst, d + 1, list_append(path, dst) FROM walk JOIN back ON src = node WHERE d < 4 AND NOT list_contains(path, dst)), best AS (SELECT node, min(d) AS depth FROM walk GROUP BY node) SELECT node, depth, array_to_string((SELECT min(path) FROM walk w WHERE w.node = b.node AND w.d = b.depth), '>') AS path FROM best b WHERE depth > 0")
def impact_paths(spark, sf):
    return G.paths(G.reverse(edges(spark, sf)), start(spark, sf), 4).select("node", "depth", F.array_join(F.col("path").cast("array<string>"), ">").alias("path"))


@query("scc_members", f"WITH RECURSIVE {EDGES_SQL}, r AS (SELECT src, dst FROM edges UNION SELECT r.src, e.dst FROM r JOIN edges e ON r.dst = e.src) SELECT a.src AS node, min(a.dst) AS component FROM r a JOIN r b ON a.src = b.dst AND a.dst = b.src GROUP BY a.src HAVING count(*) > 1")
def scc_members(spark, sf):
    return G.strong_components(edges(spark, sf))


@query("weak_components", f"WITH RECURSIVE {BOTH}, r AS (SELECT node AS src, node AS dst FROM (SELECT DISTINCT src AS node FROM und) UNION SELECT r.src, u.dst FROM r JOIN und u ON r.dst = u.src) SELECT src AS node, min(dst) AS component FROM r GROUP BY src")
def weak_components(spark, sf):
    return G.components(edges(spark, sf))


def turns(spark, sf):
    c = table(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("node"), "turn")
    return c.distinct()


@query("call_hierarchy", "WITH t AS (SELECT DISTINCT conv_id * 1000 + turn AS node, turn FROM conversations) SELECT a.node - a.turn AS gateway, a.node, a.turn AS depth FROM t a WHERE a.turn <= 8 AND (SELECT count(*) FROM t b WHERE b.node BETWEEN a.node - a.turn AND a.node) = a.turn + 1")
def call_hierarchy(spark, sf):
    t = turns(spark, sf)
    calls = t.select(F.col("node").alias("src"), (F.col("node") + 1).alias("dst")).join(t.select(F.col("node").alias("dst")), "dst", "left_semi").select("src", "dst")
    return G.signal_chains(t.where("turn = 0").select("node"), calls, 8).select("gateway", "node", F.col("depth").cast("long").alias("depth"))


def tree(spark, sf):
    return table(spark, sf, "part").select(F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("child"), F.concat(F.lit("P"), F.floor(F.col("p_partkey") / 2 - 1).cast("string")).alias("base"))


TREE = "tree AS (SELECT 'P' || p_partkey AS child, 'P' || floor(p_partkey / 2 - 1)::BIGINT AS base FROM part)"


@query("class_ancestors", f"WITH RECURSIVE {TREE}, w AS (SELECT 'P150' AS node, 0 AS depth UNION ALL SELECT base, depth + 1 FROM w JOIN tree ON child = node WHERE depth < 50) SELECT node, depth, node NOT IN (SELECT child FROM tree) AS external FROM w WHERE depth > 0")
def class_ancestors(spark, sf):
    t = tree(spark, sf)
    return G.hierarchy(t.select(F.col("child").alias("name")), t, "P150")[0]


@query("class_descendants", f"WITH RECURSIVE {TREE}, w AS (SELECT 'P3' AS node, 0 AS depth UNION ALL SELECT child, depth + 1 FROM w JOIN tree ON base = node WHERE depth < 50) SELECT node, depth FROM w WHERE depth > 0")
def class_descendants(spark, sf):
    t = tree(spark, sf)
    return G.hierarchy(t.select(F.col("child").alias("name")), t, "P3")[1]


STRUCT = "structural AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b, count(*) AS n FROM edges GROUP BY ALL)"
CO = "{name} AS (SELECT x.item AS a, y.item AS b, count(*) AS n FROM {name}_m x JOIN {name}_m y ON x.g = y.g AND x.item < y.item WHERE x.g IN (SELECT g FROM {name}_m GROUP BY g HAVING count(*) BETWEEN 2 AND {most}) GROUP BY ALL)"
BEHAVE = "behavioral_m AS (SELECT DISTINCT dst AS g, src AS item FROM edges), " + CO.format(name="behavioral", most=30)
TEMPORAL = "temporal_m AS (SELECT DISTINCT o_orderdate AS g, c_nationkey AS item FROM orders JOIN customer ON o_custkey = c_custkey), " + CO.format(name="temporal", most=20)


@query("structural_edges", f"WITH {EDGES_SQL}, {STRUCT} SELECT * FROM structural")
def structural_edges(spark, sf):
    return G.structural_signal(edges(spark, sf))


@query("behavioral_edges", f"WITH {EDGES_SQL}, {BEHAVE} SELECT * FROM behavioral")
def behavioral_edges(spark, sf):
    return G.group_pairs(edges(spark, sf), "dst", "src", 30)


def order_nations(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    return table(spark, sf, "orders").select("o_orderdate", "o_custkey").join(c, F.col("o_custkey") == F.col("c_custkey"))


@query("co_change_pairs", f"WITH {TEMPORAL} SELECT * FROM temporal")
def co_change_pairs(spark, sf):
    return G.group_pairs(order_nations(spark, sf), "o_orderdate", "c_nationkey", 20)


FUSE = f"""{EDGES_SQL}, {STRUCT}, {BEHAVE}, {TEMPORAL}, fused AS (SELECT a, b, sum(w) AS weight FROM (
 SELECT a, b, 0.4 * n / (SELECT max(n) FROM structural) AS w FROM structural UNION ALL SELECT a, b, 0.3 * n / (SELECT max(n) FROM behavioral) FROM behavioral
 UNION ALL SELECT a, b, 0.3 * n / (SELECT max(n) FROM temporal) FROM temporal) GROUP BY ALL HAVING sum(w) > 0.01)"""


def fused(spark, sf):
    e = G.kept(edges(spark, sf))
    return G.fuse_signals({"structural": G.structural_signal(e), "behavioral": G.group_pairs(e, "dst", "src", 30), "temporal": G.group_pairs(order_nations(spark, sf), "o_orderdate", "c_nationkey", 20)})


@query("fused_edges", f"WITH {FUSE} SELECT a, b, round(weight, 6) AS weight FROM fused")
def fused_edges(spark, sf):
    return fused(spark, sf).select("a", "b", F.round("weight", 6).alias("weight"))


@query("tectonic_plates")
def tectonic_plates(spark, sf):
    pairs = G.kept(fused(spark, sf))
    return G.plates(G.label_propagation(pairs), pairs).select("label", "size", "anchor", F.round("cohesion", 6).alias("cohesion"), F.round("coupling", 6).alias("coupling"))


@query("cross_repo_map", "SELECT DISTINCT c_nationkey AS from_repo, (substr(p_brand, 7)::INTEGER - 1) AS to_repo, p_brand AS package FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey WHERE c_nationkey <> substr(p_brand, 7)::INTEGER - 1")
def cross_repo_map(spark, sf):
    pairs = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey").join(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    uses = pairs.select("o_custkey", "l_partkey").join(table(spark, sf, "part").select("p_partkey", F.col("p_brand").alias("package")), F.col("l_partkey") == F.col("p_partkey"))
    named = uses.join(table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("from_repo")), F.col("o_custkey") == F.col("c_custkey"))
    to = (F.substring("package", 7, 10).cast("int") - 1).alias("to_repo")
    return named.select("from_repo", to, "package").where("from_repo <> to_repo").distinct()


@query("related_symbols", f"WITH {SYMBOLS_SQL}, t AS (SELECT file AS tf, string_split(name, ' ') AS tt FROM symbols WHERE id = 10), imp AS (SELECT DISTINCT kind AS src, file AS dst FROM symbols WHERE cyclomatic > 45), shared AS (SELECT DISTINCT dst AS file FROM imp WHERE src IN (SELECT src FROM imp, t WHERE dst = tf)), s AS (SELECT id, name, file, CASE WHEN file = tf THEN 3.0 WHEN file IN (SELECT file FROM shared) THEN 1.5 ELSE 0.0 END + 0.5 * len(list_intersect(list_distinct(string_split(name, ' ')), tt)) AS score FROM symbols, t WHERE id <> 10) SELECT id, name, file, score::DOUBLE AS score FROM s WHERE score > 0 ORDER BY score DESC, id LIMIT 50")
def related_symbols(spark, sf):
    s = symbols(spark, sf)
    imports = s.where("cyclomatic > 45").select(F.col("kind").alias("src"), F.col("file").alias("dst")).distinct()
    return G.related(s, imports, 10)


@query("importers_flagged", f"WITH {EDGES_SQL} SELECT dst AS file, src AS importer, n AS strength, src IN (SELECT dst FROM edges) AS has_importers FROM edges")
def importers_flagged(spark, sf):
    e = G.kept(edges(spark, sf))
    flags = e.select(F.col("dst").alias("importer")).distinct().withColumn("flag", F.lit(True))
    return e.select(F.col("dst").alias("file"), F.col("src").alias("importer"), F.col("n").alias("strength")).join(flags, "importer", "left").select("file", "importer", "strength", F.coalesce("flag", F.lit(False)).alias("has_importers"))


@query("shared_importers", f"WITH {EDGES_SQL} SELECT x.dst AS a, y.dst AS b, count(*) AS n FROM edges x JOIN edges y ON x.src = y.src AND x.dst < y.dst GROUP BY ALL")
def shared_importers(spark, sf):
    return G.group_pairs(edges(spark, sf), "src", "dst")


@query("text_mentions", "SELECT doc_id, len(regexp_extract_all(text, '\\b[Ll]icense\\b')) AS references FROM documents WHERE regexp_matches(text, '\\b[Ll]icense\\b')")
def text_mentions(spark, sf):
    d = table(spark, sf, "documents")
    n = F.size(F.regexp_extract_all("text", F.lit(r"\b[Ll]icense\b"), F.lit(0))).cast("long")
    return d.select("doc_id", n.alias("references")).where(F.col("references") > 0)
