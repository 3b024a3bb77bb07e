"""SimHash near-dedup over a Gray-order hierarchical index.

Fingerprints: 64 majority bits of the XXH64 of a text's word shingles.

Index: a link of at most b differing bits leaves one of b + 1 chunks of the fingerprint unchanged. For each chunk, the
distinct fingerprints are rotated so that the chunk leads, and dealt by its value: that value is the pattern of a top
node, shared by all below it, and the unit that is dealt over the cluster. Below a top node fingerprints stand in Gray
rank order, where neighbours tend to differ in few bits. Runs of them form nodes, runs of nodes form upper nodes; each
node keeps the mask and pattern of those bits that all its fingerprints share and its parent's don't. A search goes down
from the top node, adds up the differences between the query and each node's pattern, and prunes the whole group once
the sum exceeds b. All fingerprints of a top node are searched together by vector.

A task emits for each top node a spanning forest of the links that it found, not the links; connected components of
these edges come from alternating large-star and small-star steps on DataFrames, each kept in the shared folder.

Defined results: a text with no words (or null) has fingerprint zero, linked like any other; repeated rows give a row
each; a component's id is its smallest id that is not null (null if all are); an empty table gives no rows. Columns other
than the two named are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spelunka.llm.common import column, documents, durable, hot_join, slices

WORDS, BITS, SEED = 4, 4, 42
FANOUT = 8
FRONTIER = 1 << 22


# -- fingerprints -------------------------------------------------------------------------------------------------------


def fingerprint(text: str | None, words: int = WORDS, seed: int = SEED) -> int:
    from xxhash import xxh64_digest

    tokens = (text or "").encode().lower().split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    n = max(1, len(tokens) - words + 1)
    if n == 1:
        hashes = xxh64_digest(joined, seed)
    else:
        sizes = np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1
        starts = np.r_[0, np.cumsum(sizes)[:-1]]
        ends = (starts[words - 1 :] + sizes[words - 1 :] - 1).tolist()
        hashes = b"".join([xxh64_digest(joined[a:b], seed) for a, b in zip(starts[:n].tolist(), ends)])
    rows = np.frombuffer(hashes, np.uint8).reshape(n, 8)
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        counts += np.unpackbits(rows[at : at + (1 << 16)], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


def _fingerprinter(words: int, seed: int):
    def work(batches):
        for batch in slices(batches):
            found = np.array([fingerprint(t, words, seed) for t in column(batch, "text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([column(batch, "id"), pa.array(found.view(np.int64))], ["id", "fp"])

    return work


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, seed: int = SEED) -> DataFrame:
    """id and fp, the fingerprint's bits as a long."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_fingerprinter(words, seed), "id long, fp long")


# -- the index ----------------------------------------------------------------------------------------------------------


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Place of each 64-bit code in the reflected Gray sequence."""
    for s in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> np.uint64(s))
    return x


def gray_code(rank: np.ndarray) -> np.ndarray:
    return rank ^ (rank >> np.uint64(1))


def chunk_edges(bits: int) -> list[int]:
    """First bit, from the top, of each of bits + 1 chunks, and 64."""
    n = min(64, bits + 1)
    return [round(64 * i / n) for i in range(n + 1)]


def rotate(x: np.ndarray, left: int) -> np.ndarray:
    return x if left % 64 == 0 else (x << np.uint64(left)) | (x >> np.uint64(64 - left))


def _dealer(bits: int):
    edges = chunk_edges(bits)

    def work(batches):
        for batch in batches:
            fp = column(batch, "fp").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            for t in range(len(edges) - 1):
                turned = rotate(fp, edges[t])
                top = (turned >> np.uint64(64 - (edges[t + 1] - edges[t]))).astype(np.int64)
                rank = gray_rank(turned) ^ np.uint64(1 << 63)  # as a long, in unsigned order
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(fp), t, np.int32)), pa.array(top), pa.array(rank.view(np.int64))], ["t", "top", "rank"])

    return work


class Index:
    """The hierarchy over fingerprints x, in Gray order within groups that are contiguous."""

    def __init__(self, x: np.ndarray, group: np.ndarray):
        #: levels[0] are the fingerprints; of each level: group, first child, end of children, bits that are all one, all zero.
        starts = np.arange(len(x))
        self.levels = [(group, starts, starts + 1, x, ~x)]
        while True:
            g, _, _, one, zero = self.levels[-1]
            first = np.r_[True, g[1:] != g[:-1]]
            if first.all():
                break
            at = np.flatnonzero(first)
            place = np.arange(len(g)) - np.repeat(at, np.diff(np.r_[at, len(g)]))
            a = np.flatnonzero(place % FANOUT == 0)
            self.levels.append((g[a], a, np.r_[a[1:], len(g)], np.bitwise_and.reduceat(one, a), np.bitwise_and.reduceat(zero, a)))
        # Factor: a node keeps those shared bits that its parent doesn't have.
        self.masks = [None] * len(self.levels)
        above = np.zeros(len(self.levels[-1][0]), np.uint64)
        for k in range(len(self.levels) - 1, -1, -1):
            _, a, b, one, zero = self.levels[k]
            shared = one | zero
            self.masks[k] = shared & ~above
            above = np.repeat(shared, b - a) if k else shared

    def search(self, x: np.ndarray, queries: np.ndarray, bits: int):
        """Links (query, later fingerprint) of those queries, as places in x."""
        top = len(self.levels) - 1
        g, _, _, one, _ = self.levels[top]
        own = np.searchsorted(g, self.levels[0][0][queries])
        q, node = queries, own
        acc = np.bitwise_count((x[q] ^ one[node]) & self.masks[top][node]).astype(np.int64)
        for k in range(top, 0, -1):
            _, a, b, _, _ = self.levels[k]
            n = b[node] - a[node]
            q, acc = np.repeat(q, n), np.repeat(acc, n)
            ends = np.cumsum(n)
            node = np.arange(len(q)) - np.repeat(ends - n, n) + np.repeat(a[node], n)
            _, _, _, one, _ = self.levels[k - 1]
            acc += np.bitwise_count((x[q] ^ one[node]) & self.masks[k - 1][node])
            keep = acc <= bits
            q, node, acc = q[keep], node[keep], acc[keep]
        later = node > q
        return q[later], node[later]


def forest(x: np.ndarray, group: np.ndarray, bits: int) -> np.ndarray:
    """For each fingerprint the place of the first one of its component, as far as its own group tells."""
    label = np.arange(len(x))
    if len(x) < 2:
        return label
    index = Index(x, group)
    sizes = np.bincount(group)[group] if len(group) else group
    cost = np.cumsum(sizes)
    at = 0
    while at < len(x):
        stop = max(at + 1, int(np.searchsorted(cost, (cost[at - 1] if at else 0) + FRONTIER, "right")))
        a, b = index.search(x, np.arange(at, stop), bits)
        while len(a):
            ra, rb = label[a], label[b]
            low = np.minimum(ra, rb)
            before = label.copy()
            np.minimum.at(label, ra, low)
            np.minimum.at(label, rb, low)
            while True:
                up = label[label]
                if (up == label).all():
                    break
                label = up
            if (label == before).all():
                break
            apart = label[a] != label[b]
            a, b = a[apart], b[apart]
        at = stop
    return label


def _linker(bits: int):
    edges = chunk_edges(bits)

    def links(t: int, rank: np.ndarray):
        x = gray_code(rank.view(np.uint64) ^ np.uint64(1 << 63))
        top = x >> np.uint64(64 - (edges[t + 1] - edges[t]))
        group = np.cumsum(np.r_[0, (top[1:] != top[:-1]).astype(np.int64)])
        label = forest(x, group, bits)
        linked = np.flatnonzero(label != np.arange(len(x)))
        fp = rotate(x, 64 - edges[t])
        return pa.RecordBatch.from_arrays([pa.array(fp[linked].view(np.int64)), pa.array(fp[label[linked]].view(np.int64))], ["a", "b"])

    def work(batches):
        """Rows come sorted by table and rank; whole top nodes are taken together."""
        held: list = []  # of the top node that may go on in the next batch
        for batch in batches:
            t, top, rank = (column(batch, c).to_numpy(zero_copy_only=False) for c in ("t", "top", "rank"))
            cut = np.flatnonzero((t[1:] != t[:-1]) | (top[1:] != top[:-1])) + 1
            parts = np.r_[0, cut, len(t)]
            key = (int(t[0]), int(top[0])) if len(t) else None
            if held and key is not None and held[0] != key:
                yield links(held[0][0], np.concatenate(held[1:]))
                held = []
            if len(cut) == 0:
                if len(t):
                    held = held or [key]
                    held.append(rank)
                continue
            if held:
                yield links(held[0][0], np.concatenate([*held[1:], rank[: cut[0]]]))
                parts = parts[1:]
            whole = t[parts[0] : parts[-2]]
            for a, b in zip(*(lambda e: (e[:-1], e[1:]))(np.r_[0, np.flatnonzero(whole[1:] != whole[:-1]) + 1, len(whole)] + parts[0])):
                if b > a:
                    yield links(int(t[a]), rank[a:b])
            held = [(int(t[-1]), int(top[-1])), rank[parts[-2] :]]
        if held:
            yield links(held[0][0], np.concatenate(held[1:]))

    return work


def link_edges(fps: DataFrame, bits: int = BITS) -> DataFrame:
    """Edges a, b between distinct fingerprints (column fp) that join whatever is linked by at most that many differing bits."""
    dealt = fps.select("fp").mapInArrow(_dealer(bits), "t int, top long, rank long")
    return dealt.repartition("t", "top").sortWithinPartitions("t", "rank").mapInArrow(_linker(bits), "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """node, root (the least node of its component) of every node of edges (a, b): alternating large-star and small-star."""
    now = durable(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        now = durable(small.where("u <> v").distinct())
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(seen) == mark:
            break
        mark = tuple(seen)
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, bits: int = BITS, seed: int = SEED) -> DataFrame:
    """id, fp (long) and component_id of each row of df."""
    found = durable(fingerprints(df, id_col, text_col, words, seed))
    fps = durable(found.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("rows")))
    roots = components(link_edges(fps, bits))
    classed = durable(fps.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", "rows", F.coalesce("root", "fp").alias("root")))
    smallest = durable(classed.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n")))
    of_fp = durable(hot_join(classed, smallest, "root").select("fp", "component_id", F.col("rows").alias("n")))
    return hot_join(found, of_fp, "fp").select("id", "fp", "component_id")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of documents: its fingerprint and near-duplicate class."""
    found = near_duplicates(documents(spark, sf_dir))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
