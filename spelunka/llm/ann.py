"""Approximate nearest neighbours: a forest of random-projection trees with one priority queue over all trees.

The forest is fitted on a sample of at most ``sample_rows`` vectors, chosen by a hash of the id; each tree has about
``leaves`` leaves, split at the median of the projection on the difference of two random vectors. Its size depends on these
parameters and the dimension only. All vectors are indexed: each is dealt to its leaf in every tree.

A query walks all trees through one queue, ordered by the squared distance to the nearest planes crossed, and visits
leaves until their shares of the sample sum to ``visit``. How many trees are searched (of TREES) and how far is measured on
the sample: the cheapest forest and the smallest sum with which ``recall`` of the true neighbours, inside the sample, of at
most PROBES sampled vectors are found. Neighbours are nearer among all rows than in the sample, so this errs to the safe
side, at any number of rows: a table without structure is read widely, a clustered one in few leaves.

A leaf's vectors are split by a hash into parts of about ``part_rows``; a task holds one part, and the queries that visit
the leaf stream past it. Exact cosines are computed in blocks; the best of all leaves are the answer.

Vectors are scaled by a power of two before anything is multiplied, so very large and very small ones neither over- nor
underflow, and cosines don't change. Vectors equal in every component are one vector with the few smallest of its ids, so
a vector that very many rows share fills no leaf.

Defined results: null vectors, zero ones, those with null or non-finite components, rows with a null id and vectors not
of the most frequent dimension take no part. A query whose id occurs in several rows is answered once for each distinct
vector of it. An empty table gives no rows. Columns other than the two named are not read.
"""

from __future__ import annotations

from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spelunka.llm.common import column, durable

NEIGHBOURS = 5
TREES, LEAVES, SAMPLE_ROWS = (2, 4, 8), 128, 32_768
RECALL, PROBES = 0.97, 400
TREE_COST = 0.05  # a further tree copies all vectors once more: worth it if it saves this share of the reading
PART_ROWS = 16_384
BLOCK = 1024


class Forest:
    """trees: lists of nodes (plane, offset, left, right) or (leaf number, share of the sample)."""

    def __init__(self, sample: np.ndarray, trees: int = max(TREES), leaves: int = LEAVES, seed: int = 0):
        rng = np.random.default_rng(seed)
        least = max(16, len(sample) // leaves)
        self.planes, self.offsets, self.trees = [], [], []
        for _ in range(trees):
            nodes: list = []
            stack = [(np.arange(len(sample)), None, 0)]
            count = 0
            while stack:
                rows, parent, side = stack.pop()
                k = len(nodes)
                if parent is not None:
                    nodes[parent][1 + side] = k
                split = None
                if len(rows) > 1.5 * least:
                    for _ in range(8):  # copies may give no plane
                        a, b = sample[rng.choice(rows, 2, replace=False)]
                        w = a - b
                        if (size := np.linalg.norm(w)) > 1e-12:
                            p = sample[rows] @ (w / size)
                            t = float(np.median(p))
                            if (low := p < t).any() and not low.all():
                                split = w / size, t, low
                                break
                if split is None:
                    nodes.append((count, len(rows) / max(1, len(sample))))
                    count += 1
                else:
                    nodes.append([len(self.planes), None, None])
                    self.planes.append(split[0])
                    self.offsets.append(split[1])
                    stack += [(rows[~split[2]], k, 1), (rows[split[2]], k, 0)]
            self.trees.append(nodes)
        self.planes = np.array(self.planes).reshape(len(self.planes), sample.shape[1])
        self.offsets = np.array(self.offsets)

    def margins(self, x: np.ndarray) -> np.ndarray:
        return x @ self.planes.T - self.offsets

    def leaves_of(self, x: np.ndarray) -> list[np.ndarray]:
        """For each tree, the leaf of each row of x."""
        m, out = self.margins(x), []
        for nodes in self.trees:
            leaf = np.zeros(len(x), np.int32)
            stack = [(0, np.arange(len(x)))]
            while stack:
                k, rows = stack.pop()
                node = nodes[k]
                if isinstance(node, tuple):
                    leaf[rows] = node[0]
                elif len(rows):
                    low = m[rows, node[0]] < 0
                    stack += [(node[1], rows[low]), (node[2], rows[~low])]
            out.append(leaf)
        return out

    def visits(self, margins: np.ndarray, visit: float) -> list[tuple[int, int, float]]:
        """(tree, leaf, shares before it) in the order of the shared queue, until the leaves' shares sum to visit."""
        m = margins.tolist()
        heap = [(0.0, t, 0) for t in range(len(self.trees))]
        out, total = [], 0.0
        while heap and (total < visit or len(out) < len(self.trees)):
            far, t, k = heappop(heap)
            node = self.trees[t][k]
            while isinstance(node, list):
                d = m[node[0]]
                near, other = (node[1], node[2]) if d < 0 else (node[2], node[1])
                heappush(heap, (far + d * d, t, other))
                node = self.trees[t][near]
            out.append((t, node[0], total))
            total += node[1]
        return out

    def first(self, trees: int) -> Forest:
        """The forest of the first trees only."""
        out = object.__new__(Forest)
        out.planes, out.offsets, out.trees = self.planes, self.offsets, self.trees[:trees]
        return out

    def reach(self, leaves: list[np.ndarray], margins: np.ndarray, near: np.ndarray, recall: float) -> float:
        """The least sum of shares with which that recall is met. leaves: of the sample's vectors, for each tree; margins and
        near (true neighbours, as places in the sample): of some of them."""
        costs = []
        for m, theirs in zip(margins, near):
            before = {(t, leaf): cost for t, leaf, cost in self.visits(m, np.inf)}
            costs += [min(before[t, int(leaf[x])] for t, leaf in zip(range(len(self.trees)), leaves)) for x in theirs.tolist()]
        costs.sort()
        return float(np.nextafter(costs[min(len(costs) - 1, int(np.ceil(recall * len(costs))))], np.inf))


def true_neighbours(sample: np.ndarray, asked: np.ndarray, neighbours: int) -> np.ndarray:
    """Places of the nearest others of some of the sample, in blocks."""
    k, out = min(neighbours, len(sample) - 1), []
    for i in range(0, len(asked), 32):
        near = sample[asked[i : i + 32]] @ sample.T
        near[np.arange(len(near)), asked[i : i + 32]] = -np.inf
        out.append(np.argpartition(-near, k - 1, axis=1)[:, :k])
    return np.concatenate(out)


def fitted(sample: np.ndarray, neighbours: int, recall: float = RECALL, trees: tuple[int, ...] = TREES, leaves: int = LEAVES, probes: int = PROBES) -> tuple[Forest, float]:
    """The cheapest forest of those numbers of trees, and how far to visit it."""
    whole = Forest(sample, max(trees), leaves)
    if len(sample) < 2:
        return whole, float(max(trees))
    asked = np.arange(0, len(sample), max(1, -(-len(sample) // probes)))
    near, margins = true_neighbours(sample, asked, neighbours), whole.margins(sample[asked])
    parts = [whole.leaves_of(sample[i : i + BLOCK]) for i in range(0, len(sample), BLOCK)]
    of = [np.concatenate(x) for x in zip(*parts)]
    found = [(part, part.reach(of, margins, near, recall)) for part in map(whole.first, sorted(trees))]
    return min(found, key=lambda c: c[1] + TREE_COST * len(c[0].trees))


def _matrix(values) -> np.ndarray:
    """The vectors, each scaled by a power of two so that its largest component is between a half and one."""
    x = np.array([np.frombuffer(v, np.float64) for v in values])
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None]) if len(x) else x


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _router(forest, visit: float, parts: int):
    """kind 0: vectors, to one part of their leaf of each tree; kind 1: queries, to all parts of each leaf visited."""

    def out(tree, leaf, part, kind, ids, vectors):
        return pa.RecordBatch.from_arrays([pa.array(tree, pa.int32()), pa.array(leaf, pa.int32()), pa.array(part, pa.int32()), pa.array(np.full(len(ids), kind, np.int32)), pa.array(ids, pa.int64()), pa.array(vectors, pa.binary())], ["tree", "leaf", "part", "kind", "id", "v"])

    def work(batches):
        known = forest.value
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(at, BLOCK)
                ids, asks, packed = (column(batch, c).to_pylist() for c in ("cid", "asks", "v"))
                x = _unit(_matrix(packed))
                part = (np.array(ids, np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % parts  # an odd multiplier
                for t, leaf in enumerate(known.leaves_of(x)):
                    yield out([t] * len(ids), leaf, part, 0, ids, packed)
                asking = [i for i, a in enumerate(asks) if a]
                for a in range(0, len(asking), 64):
                    some = asking[a : a + 64]
                    for i, m in zip(some, known.margins(x[some])):
                        seen = [(t, leaf, p) for t, leaf, _ in known.visits(m, visit) for p in range(parts)]
                        yield out(*zip(*seen), 1, [ids[i]] * len(seen), [packed[i]] * len(seen))

    return work


def _searcher(keep: int):
    """Rows come sorted by tree, leaf, part and kind: the vectors of a part first, then the queries that visit it."""

    def best(queries, x, names, y, sizes):
        k = min(keep, len(names))
        score = (x @ y.T) / (np.linalg.norm(x, axis=1)[:, None] * sizes)
        if len(names) > k:
            worst = -np.partition(-score, k - 1, axis=1)[:, k - 1 : k]
            q, c = np.nonzero(score >= worst)  # ties stay, all of them
        else:
            q, c = np.nonzero(np.ones(score.shape, bool))
        order = np.lexsort((names[c], -score[q, c], q))
        q, c = q[order], c[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        q, c = q[place < k], c[place < k]
        return pa.RecordBatch.from_arrays([pa.array(queries[q]), pa.array(names[c]), pa.array(score[q, c])], ["qid", "cid", "score"])

    def work(batches):
        place, held, ready = None, [], None
        for whole in batches:
            keys = [column(whole, c).to_numpy(zero_copy_only=False) for c in ("tree", "leaf", "part", "kind")]
            cuts = np.r_[0, np.flatnonzero(np.any([np.diff(k) != 0 for k in keys], axis=0)) + 1, whole.num_rows]
            for a, b in zip(cuts[:-1], cuts[1:]):
                if a == b:
                    continue
                if (now := tuple(int(k[a]) for k in keys[:3])) != place:
                    place, held, ready = now, [], None
                part = whole.slice(a, b - a)
                ids, vectors = column(part, "id").to_numpy(zero_copy_only=False), _matrix(column(part, "v").to_pylist())
                if keys[3][a] == 0:
                    held.append((ids, vectors))
                    continue
                if not held:
                    continue
                if ready is None:
                    y = np.concatenate([v for _, v in held])
                    ready = np.concatenate([i for i, _ in held]), y, np.linalg.norm(y, axis=1)
                for i in range(0, len(ids), 256):
                    yield best(ids[i : i + 256], vectors[i : i + 256], *ready)

    return work


def usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id, v (the components as doubles) and a 128-bit key of the vector, of those rows that take part."""
    v = F.col(vector_col).cast("array<double>")
    rows = df.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull())
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("v", lambda x: x != 0)
    rows = rows.where(fine)
    common = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1)
    rows = rows.join(F.broadcast(common.select("n")), F.size("v") == F.col("n"), "left_semi")  # one row
    plain = F.transform("v", lambda x: x + F.lit(0.0))  # -0.0 becomes 0.0
    return rows.select("id", plain.alias("v"), F.xxhash64(plain).alias("k1"), F.xxhash64(F.lit(1), plain).alias("k2"))


def nearest(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 50, neighbours: int = NEIGHBOURS, recall: float = RECALL, trees: tuple[int, ...] = TREES, leaves: int = LEAVES, sample_rows: int = SAMPLE_ROWS, part_rows: int = PART_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: for each id divisible by ``every`` its nearest others found, by cosine."""
    spark = df.sparkSession
    rows = usable(df, id_col, vector_col)
    keep = neighbours + 1  # one of them may be the query itself
    by_vector = Window.partitionBy("k1", "k2")
    few = rows.select("id", "k1", "k2", "v").distinct().withColumn("n", F.row_number().over(by_vector.orderBy("id"))).where(F.col("n") <= keep)
    asked = rows.where(F.pmod("id", F.lit(every)) == 0).select(F.col("id").alias("query_id"), "k1", "k2").distinct()
    unique = few.groupBy("k1", "k2").agg(F.min("id").alias("cid"), F.min_by("v", "id").alias("v"), F.array_sort(F.collect_list("id")).alias("ids"))
    asks = asked.select("k1", "k2").distinct().withColumn("asks", F.lit(True))
    unique = durable(unique.join(asks, ["k1", "k2"], "left"))
    pack = unique.select("cid", "asks", "v").mapInArrow(_packer, "cid long, asks boolean, v binary")
    n = unique.count()
    share = min(1.0, sample_rows * 0.95 / max(1, n))
    chosen = pack.where(F.pmod(F.xxhash64("cid"), F.lit(1 << 20)) < F.lit(int(share * (1 << 20)) + 1)).select("v").limit(sample_rows).toPandas()["v"]
    if not len(chosen):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    fit, visit = fitted(_unit(_matrix(chosen)), neighbours, recall, trees, leaves)
    forest, parts = spark.sparkContext.broadcast(fit), max(1, -(-n // (leaves * part_rows)))
    routed = pack.mapInArrow(_router(forest, visit, parts), "tree int, leaf int, part int, kind int, id long, v binary")
    found = routed.repartition("tree", "leaf", "part").sortWithinPartitions("tree", "leaf", "part", "kind").mapInArrow(_searcher(keep), "qid long, cid long, score double")
    best = found.groupBy("qid", "cid").agg(F.max("score").alias("score"))
    best = best.withColumn("n", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "cid"))).where(F.col("n") <= keep).drop("n")
    names = unique.select("cid", "ids", "k1", "k2")
    answers = best.join(names.select("cid", "ids"), "cid").select("qid", "score", F.explode("ids").alias("vec_id"))
    # The query's own vector and the ids it serves: each query row takes the answers of its vector, without itself.
    answers = answers.withColumn("n", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "vec_id"))).where(F.col("n") <= keep).drop("n")
    mine = asked.join(names.select(F.col("cid").alias("qid"), "k1", "k2"), ["k1", "k2"]).select("query_id", "qid")
    paired = mine.join(answers, "qid").where("query_id <> vec_id")
    rank = F.row_number().over(Window.partitionBy("query_id", "qid").orderBy(F.desc("score"), "vec_id"))
    return paired.withColumn("rank", rank).where(F.col("rank") <= neighbours).select("query_id", "rank", "vec_id", "score")


def _packer(batches):
    for batch in batches:
        v = column(batch, "v")
        flat, sizes = v.flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.diff(v.offsets.to_numpy())
        ends = np.cumsum(sizes)
        yield pa.RecordBatch.from_arrays([column(batch, "cid"), column(batch, "asks"), pa.array([flat[e - s : e].tobytes() for s, e in zip(sizes, ends)], pa.binary())], ["cid", "asks", "v"])


def op6_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest others of every 50th row of embeddings."""
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
