"""Graph operators on edge tables (src, dst).

Frontier loops keep each level in the checkpoint folder: the plan of a level never holds the plans of those before it.
Levels, ranks and labels stay distributed; the driver sees counts only.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

DAMPING, TOLERANCE, ROUNDS = 0.85, 1e-6, 100
SIGNALS = {"structural": 0.4, "behavioral": 0.3, "temporal": 0.3}


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a folder of our own only where none is set and all of Spark is in this process."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if context._jsc.sc().getCheckpointDir().isEmpty():
        if not folder:
            if not context.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            import tempfile

            folder = tempfile.mkdtemp(prefix="spelunka-graph-")
        context.setCheckpointDir(folder)
    return folder or context._jsc.sc().getCheckpointDir().get()


def kept(df: DataFrame) -> DataFrame:
    """df, computed once, in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def simple(edges: DataFrame) -> DataFrame:
    """Distinct edges without self loops."""
    return edges.select("src", "dst").where("src <> dst").distinct()


def reverse(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").unionByName(reverse(edges)).distinct()


def nodes_of(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """node, fan_in, fan_out over simple edges, in one aggregation."""
    e = simple(edges)
    ends = e.select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("dst").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("x"))
    return ends.groupBy(F.col("x.node").alias("node")).agg(F.sum("x.i").alias("fan_in"), F.sum("x.o").alias("fan_out"))


def importer_counts(imports: DataFrame, owners: DataFrame) -> DataFrame:
    """dst, count of raw import rows (repeats and self imports count) into files that own symbols."""
    return imports.join(owners.select(F.col("file").alias("dst")).distinct(), "dst", "left_semi").groupBy("dst").agg(F.count("*").alias("importers"))


def instability(fan_in: Column, fan_out: Column) -> Column:
    return F.round(fan_out / F.nullif(fan_in + fan_out, F.lit(0)), 4)


def stability(value: Column) -> Column:
    return F.when(value.isNull(), "isolated").when(value <= 0.3, "stable").when(value <= 0.7, "neutral").otherwise("unstable")


def coupling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, fan_in, fan_out, instability, assessment for every node, isolated ones too."""
    d = nodes.select("node").distinct().join(degrees(edges), "node", "left").fillna(0, ["fan_in", "fan_out"])
    return d.withColumn("instability", instability(F.col("fan_in"), F.col("fan_out"))).withColumn("assessment", stability(F.col("instability")))


def bfs(edges: DataFrame, start: DataFrame, depth: int | None = None) -> DataFrame:
    """node, depth: least number of edges from start (column node), without start itself, up to depth or as far as it goes."""
    edges = kept(simple(edges))
    seen = kept(start.select("node").distinct().withColumn("depth", F.lit(0)))
    front = seen.select("node")
    for d in count(1) if depth is None else range(1, depth + 1):
        new = kept(edges.join(front, edges["src"] == front["node"], "left_semi").select(F.col("dst").alias("node")).distinct().join(seen.select("node"), "node", "left_anti"))
        if new.isEmpty():
            break
        seen = kept(seen.unionByName(new.withColumn("depth", F.lit(d))))
        front = new
    return seen.where("depth > 0")


def reachable(edges: DataFrame, start: DataFrame) -> DataFrame:
    """node: everything start reaches, start included."""
    return bfs(edges, start).select("node").unionByName(start.select("node")).distinct()


def neighbourhood(edges: DataFrame, start: DataFrame, depth: int, direction: str = "imports") -> DataFrame:
    """Edges out of nodes at a level below depth, edges to nodes already seen included: src, dst, level."""
    walk = {"imports": edges, "importers": reverse(edges), "both": both_ways(edges)}[direction]
    levels = bfs(walk, start, depth).unionByName(start.select("node").withColumn("depth", F.lit(0)))
    e = simple(walk)
    return e.join(levels.where(F.col("depth") < depth), e["src"] == levels["node"]).select("src", "dst", F.col("depth").alias("level"))


def paths(edges: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """node, depth, path: to each node the shortest path from start, of these the least in order of its nodes."""
    edges = kept(simple(edges))
    seen = kept(start.select("node").distinct().select("node", F.lit(0).alias("depth"), F.array("node").alias("path")))
    front = seen
    for d in range(1, depth + 1):
        step = front.join(edges, front["node"] == edges["src"]).select(F.col("dst").alias("node"), F.concat("path", F.array("dst")).alias("path"))
        new = kept(step.join(seen.select("node"), "node", "left_anti").groupBy("node").agg(F.min("path").alias("path")).select("node", F.lit(d).alias("depth"), "path"))
        if new.isEmpty():
            break
        seen = kept(seen.unionByName(new))
        front = new
    return seen.where("depth > 0")


def pagerank(edges: DataFrame, nodes: DataFrame | None = None, rounds: int = ROUNDS, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """node, rank: uniform start, dangling mass spread over all; ends after rounds, or once the change sums to at most tolerance."""
    e = simple(edges)
    all_nodes = kept(nodes_of(e) if nodes is None else nodes.select("node").distinct())
    n = all_nodes.count()
    if not n:
        return all_nodes.withColumn("rank", F.lit(0.0))
    out = e.groupBy("src").agg(F.count("*").alias("out"))
    e = kept(e.join(out, "src").select("src", "dst", (F.lit(1.0) / F.col("out")).alias("share")))
    ranks = kept(all_nodes.join(out.select(F.col("src").alias("node"), "out"), "node", "left").select("node", F.col("out").isNull().alias("dangling"), F.lit(1.0 / n).alias("rank")))
    lost = ranks.where("dangling").agg(F.sum("rank")).first()[0] or 0.0
    for _ in range(rounds):
        base = (1 - damping) / n + damping * lost / n
        got = ranks.join(e, ranks["node"] == e["src"]).groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("rank") * F.col("share")).alias("got"))
        new = kept(ranks.join(got, "node", "left").select("node", "dangling", (F.lit(base) + damping * F.coalesce("got", F.lit(0.0))).alias("rank"), F.col("rank").alias("old")))
        # One small job a round: the change, and the dangling mass that the next round spreads.
        change, lost = new.agg(F.sum(F.abs(F.col("rank") - F.col("old"))), F.coalesce(F.sum(F.when(F.col("dangling"), F.col("rank"))), F.lit(0.0))).first()
        ranks = new.drop("old")
        if change <= tolerance:
            break
    return ranks.select("node", "rank")


def components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """node, component: weakly connected, named by the least node; labels jump along labels, so rounds grow with log size."""
    e = kept(both_ways(simple(edges)))
    label = kept((nodes_of(e) if nodes is None else nodes.select("node").distinct()).select("node", F.col("node").alias("component")))
    while True:
        near = e.join(label, e["src"] == label["node"]).groupBy(F.col("dst").alias("node")).agg(F.min("component").alias("near"))
        step = label.join(near, "node", "left").select("node", F.col("component").alias("was"), F.least("component", "near").alias("component"))
        up = step.select(F.col("node").alias("component"), F.col("component").alias("above"))
        new = kept(step.join(up, "component", "left").select("node", "was", F.least("component", "above").alias("component")))
        if new.where("was <> component").isEmpty():
            return new.select("node", "component")
        label = kept(new.select("node", "component"))


def strong_components(edges: DataFrame) -> DataFrame:
    """node, component (least node) of strongly connected sets of more than one node.

    Nodes without in- or out-edges are trimmed; then each round colours nodes with the largest node that reaches them and
    takes, inside each colour, what reaches its root backwards. Only frontiers and labels are joined, never the closure.
    """
    left = kept(simple(edges))
    found = None
    while not left.isEmpty():
        while True:  # trim
            inner = left.select(F.col("dst").alias("node")).distinct().intersect(left.select(F.col("src").alias("node")).distinct())
            cut = kept(left.join(inner.withColumnRenamed("node", "src"), "src", "left_semi").join(inner.withColumnRenamed("node", "dst"), "dst", "left_semi").select("src", "dst"))
            if cut.count() == left.count():
                break
            left = cut
        if left.isEmpty():
            break
        colour = kept(nodes_of(left).select("node", F.col("node").alias("colour")))
        while True:  # the largest node that reaches each one
            near = left.join(colour, left["src"] == colour["node"]).groupBy(F.col("dst").alias("node")).agg(F.max("colour").alias("near"))
            new = kept(colour.join(near, "node", "left").select("node", F.col("colour").alias("was"), F.greatest("colour", "near").alias("colour")))
            done = new.where("was <> colour").isEmpty()
            colour = new.select("node", "colour")
            if done:
                break
        a, b = colour.select(F.col("node").alias("src"), F.col("colour").alias("ca")), colour.select(F.col("node").alias("dst"), F.col("colour").alias("cb"))
        inside = kept(left.join(a, "src").join(b, "dst").where("ca = cb").select("src", "dst", F.col("ca").alias("colour")))
        back = kept(colour.where("node = colour").select("node", "colour"))
        front = back
        while True:  # backwards from each root within its colour
            step = inside.join(front.select(F.col("node").alias("dst"), "colour"), ["dst", "colour"]).select(F.col("src").alias("node"), "colour").distinct()
            front = kept(step.join(back, ["node", "colour"], "left_anti"))
            if front.isEmpty():
                break
            back = kept(back.unionByName(front))
        found = back if found is None else found.unionByName(back)
        gone = back.select("node")
        left = kept(left.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti").select("src", "dst"))
    if found is None:
        return edges.select(F.col("src").alias("node"), F.col("src").alias("component")).limit(0)
    sized = found.groupBy("colour").agg(F.count("*").alias("n"), F.min("node").alias("component")).where("n > 1")
    return found.join(sized, "colour").select("node", "component")


def blast_risk(levels: DataFrame, files: int | None = None) -> DataFrame:
    """One row: affected files by depth weighted with depth to the power -0.7, over their number."""
    per = levels.groupBy("depth").agg(F.count("*").alias("n"))
    weighted = F.sum(F.col("n") * F.pow(F.col("depth").cast("double"), F.lit(-0.7)))
    return per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("affected"), F.round(F.coalesce(weighted / F.nullif(F.sum("n"), F.lit(0)), F.lit(0.0)), 4).alias("risk"))


def mentions(contents: DataFrame, name: str, text: str = "content") -> DataFrame:
    """contents with references, the whole-word occurrences of name."""
    import re

    return contents.withColumn("references", F.size(F.regexp_extract_all(F.col(text), F.lit(rf"\b{re.escape(name)}\b"), F.lit(0))))


# -- coupling signals and plates ------------------------------------------------------------------------------------------


def structural_signal(edges: DataFrame) -> DataFrame:
    """a, b, n: edges either way between two nodes (1 or 2)."""
    return simple(edges).groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.count("*").alias("n"))


def group_pairs(members: DataFrame, group: str, item: str, most: int | None = None) -> DataFrame:
    """a, b, n: groups that hold both items. With most, groups of more items say nothing and are left out before pairing:
    a bound that some measures (behavioural coupling: 30) have by definition."""
    m = members.select(group, item).distinct()
    if most is not None:
        sized = m.groupBy(group).agg(F.count("*").alias("size")).where(F.col("size") <= most)
        m = m.join(sized.select(group), group, "left_semi")
    pair = m.select(group, F.col(item).alias("a")).join(m.select(group, F.col(item).alias("b")), group).where("a < b")
    return pair.groupBy("a", "b").agg(F.count("*").alias("n"))


def fuse_signals(signals: dict[str, DataFrame], weights: dict[str, float] | None = None, floor: float = 0.01) -> DataFrame:
    """a, b, weight: each signal over its own maximum, weighted and added; weak pairs go."""
    weights = SIGNALS | (weights or {})
    out = None
    for name, df in signals.items():
        part = df.join(F.broadcast(df.agg(F.max("n").alias("top")))).select("a", "b", (F.lit(weights[name]) * F.col("n") / F.col("top")).alias("w"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("a", "b").agg(F.sum("w").alias("weight")).where(F.col("weight") > floor)


def label_propagation(pairs: DataFrame, rounds: int = 50) -> DataFrame:
    """node, label: synchronous; a node keeps its label unless another has more weight around it, ties to the least label."""
    e = kept(pairs.select(F.col("a").alias("src"), F.col("b").alias("dst"), "weight").unionByName(pairs.select(F.col("b").alias("src"), F.col("a").alias("dst"), "weight")))
    label = kept(nodes_of(e).select("node", F.col("node").alias("label")))
    for _ in range(rounds):
        votes = e.join(label, e["src"] == label["node"]).groupBy(F.col("dst").alias("node"), "label").agg(F.sum("weight").alias("w"))
        own = label.select("node", "label", F.lit(1e-9).alias("w"))  # damping: a node's own label wins ties
        best = votes.unionByName(own).groupBy("node", "label").agg(F.sum("w").alias("w")).groupBy("node").agg(F.min_by("label", F.struct(-F.round("w", 9), "label")).alias("label"))
        new = kept(best.join(label.withColumnRenamed("label", "was"), "node"))
        done = new.where("label <> was").isEmpty()
        label = new.select("node", "label")
        if done:
            break
    return label


def plates(labels: DataFrame, pairs: DataFrame) -> DataFrame:
    """For each label: size, anchor (largest weight inside), cohesion, weight to other plates."""
    a, b = labels.select(F.col("node").alias("a"), F.col("label").alias("la")), labels.select(F.col("node").alias("b"), F.col("label").alias("lb"))
    e = pairs.join(a, "a").join(b, "b")
    inside = e.where("la = lb")
    weight = inside.groupBy(F.col("la").alias("label")).agg(F.sum("weight").alias("inner"))
    ends = inside.select(F.col("la").alias("label"), F.explode(F.array("a", "b")).alias("node"), "weight").groupBy("label", "node").agg(F.sum("weight").alias("w"))
    anchor = ends.groupBy("label").agg(F.max_by("node", F.struct(F.round("w", 9), -F.col("node"))).alias("anchor"))
    outer = e.where("la <> lb").select(F.explode(F.array("la", "lb")).alias("label"), "weight").groupBy("label").agg(F.sum("weight").alias("coupling"))
    size = labels.groupBy("label").agg(F.count("*").alias("size"))
    most = F.col("size") * (F.col("size") - 1) / 2
    return size.join(weight, "label", "left").join(anchor, "label", "left").join(outer, "label", "left").select("label", "size", "anchor", F.coalesce(F.col("inner") / F.nullif(most, F.lit(0.0)), F.lit(0.0)).alias("cohesion"), F.coalesce("coupling", F.lit(0.0)).alias("coupling"))


def majority_directory(path: Column) -> Column:
    """The directory a path counts for: its first two segments if it has three or more, else its first."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) >= 3, F.array_join(F.slice(parts, 1, 2), "/")).when(F.size(parts) == 2, parts[0]).otherwise("")


def related(symbols: DataFrame, edges: DataFrame, target_id, k: int = 50) -> DataFrame:
    """id, score of symbols near one: 3 in its file, else 1.5 for a shared importer; half a point for each shared name token."""
    from spelunka.functions import text as X

    one = F.broadcast(symbols.where(F.col("id") == F.lit(target_id)).select(F.col("file").alias("tf"), X.split_tokens(F.col("name")).alias("tt")).limit(1))
    target_file = one.select(F.col("tf").alias("dst"))
    importers = edges.join(target_file, "dst", "left_semi").select("src").distinct()
    shared = edges.join(importers, "src", "left_semi").select(F.col("dst").alias("file")).distinct().withColumn("shared", F.lit(True))
    base = F.when(F.col("file") == F.col("tf"), 3.0).when(F.col("shared"), 1.5).otherwise(0.0)
    tokens = F.size(F.array_intersect(F.array_distinct(X.split_tokens(F.col("name"))), "tt"))
    found = symbols.where(F.col("id") != F.lit(target_id)).join(one).join(shared, "file", "left").withColumn("score", base + 0.5 * tokens).where("score > 0")
    return found.select("id", "name", "file", "score").orderBy(F.desc("score"), "id").limit(k)


def representative(symbols: DataFrame, kinds: list[str]) -> DataFrame:
    """One symbol a file: the best kind, then the longest, then the least id."""
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, kinds)), F.col("kind")), F.lit(0))
    rank = F.when(rank == 0, len(kinds) + 1).otherwise(rank)
    w = Window.partitionBy("file").orderBy(rank, F.desc("byte_length"), "id")
    return symbols.withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__k")


def hierarchy(classes: DataFrame, bases: DataFrame, name: str, depth: int = 50) -> tuple[DataFrame, DataFrame]:
    """Ancestors and descendants (node, depth) of a class: bases(child, base) by name; names without a class are external."""
    spark: SparkSession = classes.sparkSession
    start = spark.createDataFrame([(name,)], "node string")
    up = bases.select(F.col("child").alias("src"), F.col("base").alias("dst"))
    known = classes.select(F.col("name").alias("node")).distinct().withColumn("known", F.lit(True))
    ancestors = bfs(up, start, depth).join(known, "node", "left").select("node", "depth", F.col("known").isNull().alias("external"))
    return ancestors, bfs(reverse(up), start, depth)


def signal_chains(gateways: DataFrame, calls: DataFrame, depth: int = 8) -> DataFrame:
    """gateway, node, depth: what each gateway (column node) reaches along calls, all gateways in one frontier."""
    calls = kept(simple(calls))
    seen = kept(gateways.select(F.col("node").alias("gateway"), "node", F.lit(0).alias("depth")))
    front = seen
    for d in range(1, depth + 1):
        step = front.join(calls, front["node"] == calls["src"]).select("gateway", F.col("dst").alias("node")).distinct()
        new = kept(step.join(seen.select("gateway", "node"), ["gateway", "node"], "left_anti").withColumn("depth", F.lit(d)))
        if new.isEmpty():
            break
        seen = kept(seen.unionByName(new))
        front = new
    return seen


def prune(edges: DataFrame, most: int, keep: set | None = None, drawable: int = 5_000) -> list[tuple]:
    """Edges of at most `most` nodes, for drawing: leaves go first, then the lowest degrees. While there are more than
    drawable nodes this happens on DataFrames, leaves in rounds and then all but the drawable nodes of most edges; the rest
    is done on the driver."""
    keep = keep or set()
    e = kept(edges.select("src", "dst").distinct())
    ends = lambda d: d.select(F.explode(F.array("src", "dst")).alias("node")).groupBy("node").agg(F.count("*").alias("n"))
    among = lambda d, nodes: d.join(nodes.select(F.col("node").alias("src")), "src", "left_semi").join(nodes.select(F.col("node").alias("dst")), "dst", "left_semi")
    while (size := (degree := ends(e)).count()) > drawable:
        inner = kept(degree.where((F.col("n") > 1) | F.col("node").isin(list(keep))))
        if inner.count() == size or inner.count() < drawable:
            inner = degree.orderBy(F.desc(F.col("node").isin(list(keep))), F.desc("n"), "node").limit(drawable)
        e = kept(among(e, inner).select("src", "dst"))
    rows = {(r.src, r.dst) for r in e.collect()}
    while True:
        degree = {}
        for a, b in rows:
            degree[a] = degree.get(a, 0) + 1
            degree[b] = degree.get(b, 0) + 1
        if len(degree) <= most:
            return sorted(rows)
        loose = [x for x in degree if degree[x] <= 1 and x not in keep] or [min((x for x in degree if x not in keep), key=lambda x: (degree[x], str(x)), default=None)]
        if loose == [None]:
            return sorted(rows)
        drop = set(loose)
        rows = {(a, b) for a, b in rows if a not in drop and b not in drop}


def mermaid(edges: list[tuple], direction: str = "LR") -> str:
    """A Mermaid flowchart of edges."""
    names = sorted({str(x) for e in edges for x in e})
    ident = {n: f"n{i}" for i, n in enumerate(names)}
    label = lambda n: n.replace('"', "'")
    return "\n".join([f"flowchart {direction}", *(f'  {ident[n]}["{label(n)}"]' for n in names), *(f"  {ident[str(a)]} --> {ident[str(b)]}" for a, b in edges)])
