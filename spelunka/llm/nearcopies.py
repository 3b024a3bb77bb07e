"""Near copies by exact shingle similarity: op10's index and MinHash bands propose, the shingle sets decide.

Two texts are near copies if the Jaccard similarity of their sets of word shingles is at least ``similarity``.

1. A text's key is the hash of its words; texts of equal words are one from here on. Candidates are of two kinds: links of
   the Gray-order index of simhash.py between fingerprints of the same shingles, and MinHash buckets. On 64-bit SimHash
   fingerprints a similarity of 0.8 is about ten differing bits, give or take three, and an index that must find twenty has
   chunks of three bits and compares all pairs; so the index finds the closest copies, and ``BANDS`` bands of ``ROWS``
   minima of the shingles' hashes the rest. A pair of similarity s shares no band with probability
   (1 - s ** ROWS) ** BANDS: 3e-6 at 0.8, less above. Connected components of the candidates are parts.
2. A part whose sets fit ``block`` shingles is settled in one task, which walks through the graph of the similarities that
   reach the bound; each text found leaves those still to be compared, so that m near copies take about m comparisons.
3. A larger part is split into blocks by hash. All its texts are compared with its first one, block by block; what is not
   similar to that (in a group of near copies: little) is compared with the whole part, one pair of blocks in a task. A
   task holds two blocks at most, and emits a spanning forest of its links. No pair is left out.

Defined results: shingles and words are those of simhash.py (a text of fewer words is one shingle; null, empty and blank
texts are alike); being a near copy carries over along chains. Columns other than the text are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spelunka.llm import simhash
from spelunka.llm.common import column, durable, slices

WORDS, SIMILARITY = 5, 0.8
BANDS, ROWS, SEED = 32, 5, 42
BLOCK = 1 << 20  # shingles that a task takes at a time
MAX_BROADCAST_PARTS = 100_000
_rng = np.random.default_rng(SEED)
FACTORS = _rng.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
SHIFTS = _rng.integers(0, 1 << 63, BANDS * ROWS, np.uint64)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def key_of(tokens: list[bytes]) -> int:
    from xxhash import xxh3_64_intdigest

    return xxh3_64_intdigest(b" ".join(tokens))


def shingles(tokens: list[bytes], words: int = WORDS, seed: int = SEED) -> np.ndarray:
    """The distinct hashes of a text's shingles."""
    from xxhash import xxh64_intdigest

    joined = b" ".join(tokens)
    if len(tokens) <= words:
        return np.array([xxh64_intdigest(joined, seed)], np.uint64)
    sizes = np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1
    ends = np.cumsum(sizes)
    starts = (ends - sizes)[: len(tokens) - words + 1].tolist()
    return np.unique(np.array([xxh64_intdigest(joined[a:b], seed) for a, b in zip(starts, (ends[words - 1 :] - 1).tolist())], np.uint64))


def buckets(found: np.ndarray) -> np.ndarray:
    """One hash for each band."""
    from xxhash import xxh3_64_intdigest

    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), 512):
        np.minimum(least, (found[at : at + 512, None] * FACTORS + SHIFTS).min(axis=0), out=least)
    data, size = least.tobytes(), 8 * ROWS
    return np.array([xxh3_64_intdigest(data[k * size : (k + 1) * size], k) for k in range(BANDS)], np.uint64)


def with_key(df: DataFrame, text_col: str = "text") -> DataFrame:
    """df, all its columns as they are, and __key."""
    from pyspark.sql import types as T

    place = len(df.columns)

    def work(batches):
        for batch in slices(batches, "__text"):
            keys = np.array([key_of(words_of(t)) for t in column(batch, "__text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:place], pa.array(keys.view(np.int64))], [*batch.schema.names[:place], "__key"])

    return df.withColumn("__text", F.col(text_col)).mapInArrow(work, T.StructType([*df.schema.fields, T.StructField("__key", T.LongType())]))


def _banded(words: int):
    def work(batches):
        for batch in slices(batches):
            keys, found = [], []
            for text in column(batch, "text").to_pylist():
                tokens = words_of(text)
                keys.append(key_of(tokens))
                found.append(buckets(shingles(tokens, words)))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64)), pa.array(np.repeat(np.array(keys, np.uint64), BANDS).view(np.int64))], ["bucket", "key"])

    return work


def _chained(batches):
    """Rows come sorted by bucket; each key is linked to the first of its bucket."""
    last, first = None, None
    for batch in batches:
        bucket, key = (column(batch, c).to_numpy(zero_copy_only=False) for c in ("bucket", "key"))
        if not len(bucket):
            continue
        new = np.r_[last is None or bucket[0] != last, bucket[1:] != bucket[:-1]]
        at = np.maximum.accumulate(np.where(new, np.arange(len(key)), -1))
        head = np.where(at >= 0, key[at], 0 if first is None else first)
        last, first = bucket[-1], head[-1]
        keep = head != key
        yield pa.RecordBatch.from_arrays([pa.array(key[keep]), pa.array(head[keep])], ["a", "b"])


def similar(sets: list[np.ndarray], similarity: float = SIMILARITY) -> np.ndarray:
    """For each set the place of the first one of its class: exact components of the pairs that reach the similarity."""
    bounds = np.cumsum([0, *map(len, sets)])
    values, ids = np.unique(np.concatenate(sets), return_inverse=True)
    of = [ids[a:b] for a, b in zip(bounds[:-1], bounds[1:])]
    label, mark = np.full(len(sets), -1), np.zeros(len(values), bool)
    left = np.arange(len(sets))
    while len(left):
        seed, left = left[0], left[1:]
        label[seed] = seed
        queue, flat = [seed], None
        while queue and len(left):
            at = queue.pop()
            if flat is None:
                flat = np.concatenate([of[k] for k in left])
                sizes = np.array([len(of[k]) for k in left])
                starts = np.cumsum(sizes) - sizes
            mark[of[at]] = True
            both = np.add.reduceat(mark[flat], starts, dtype=np.int64)
            mark[of[at]] = False
            near = both / (sizes + len(of[at]) - both) >= similarity
            if near.any():
                label[left[near]] = seed
                queue += left[near].tolist()
                left, flat = left[~near], None
    return label


def _verified(similarity: float):
    def work(table: pa.Table) -> pa.Table:
        table = table.sort_by("key")
        keys = table.column("key").to_numpy()
        label = similar([np.frombuffer(x.as_py(), np.uint64) for x in table.column("shingles")], similarity)
        return pa.table({"a": pa.array(keys), "b": pa.array(keys[label])})

    return work


def _set_of(words: int):
    def work(batches):
        for batch in slices(batches):
            found = [shingles(words_of(t), words) for t in column(batch, "text").to_pylist()]
            yield pa.RecordBatch.from_arrays([column(batch, "key"), column(batch, "part"), pa.array([x.tobytes() for x in found], pa.binary()), pa.array(list(map(len, found)), pa.int64())], ["key", "part", "shingles", "n"])

    return work


def _like_first(similarity: float):
    """Whether each set is similar to its part's first one."""

    def work(batches):
        for batch in batches:
            near = []
            for x, y in zip(column(batch, "shingles").to_pylist(), column(batch, "first").to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                near.append(both / (len(x) + len(y) - both) >= similarity)
            yield pa.RecordBatch.from_arrays([*(column(batch, c) for c in ("key", "part", "shingles", "n", "pivot")), pa.array(near, pa.bool_())], ["key", "part", "shingles", "n", "pivot", "near"])

    return work


def _crossed(similarity: float):
    """A spanning forest of the links between the texts of one block that are left, and another block."""

    def work(table: pa.Table) -> pa.Table:
        keys, left = table.column("key").to_numpy(), table.column("left").to_numpy(zero_copy_only=False)
        sets = [np.frombuffer(x.as_py(), np.uint64) for x in table.column("shingles")]
        values, ids = np.unique(np.concatenate(sets), return_inverse=True)
        bounds = np.cumsum([0, *map(len, sets)])
        mine, theirs = np.flatnonzero(left), np.flatnonzero(~left)
        edges: list = []
        if len(mine) and len(theirs):
            flat = np.concatenate([ids[bounds[k] : bounds[k + 1]] for k in theirs])
            sizes = np.array([len(sets[k]) for k in theirs])
            starts, mark, root = np.cumsum(sizes) - sizes, np.zeros(len(values), bool), {}

            def find(k):
                while root.get(k, k) != k:
                    root[k] = k = root.get(root[k], root[k])
                return k

            for k in mine.tolist():
                own = ids[bounds[k] : bounds[k + 1]]
                mark[own] = True
                both = np.add.reduceat(mark[flat], starts, dtype=np.int64)
                mark[own] = False
                for x in keys[theirs[both / (sizes + len(own) - both) >= similarity]].tolist():
                    a, b = find(int(keys[k])), find(x)
                    if a != b:
                        root[a] = b
                        edges.append((int(keys[k]), x))
        return pa.table({"a": pa.array([a for a, _ in edges], pa.int64()), "b": pa.array([b for _, b in edges], pa.int64())})

    return work


def _printed(words: int):
    def work(batches):
        for batch in slices(batches):
            texts = column(batch, "text").to_pylist()
            keys = np.array([key_of(words_of(t)) for t in texts], np.uint64)
            fps = np.array([simhash.fingerprint(t, words, SEED) for t in texts], np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(fps.view(np.int64))], ["key", "fp"])

    return work


def index_edges(texts: DataFrame, words: int = WORDS, bits: int = simhash.BITS) -> DataFrame:
    """Candidates a, b (keys) by the Gray-order index: texts of one fingerprint, or of fingerprints within those bits."""
    prints = durable(texts.mapInArrow(_printed(words), "key long, fp long").distinct())
    least = durable(prints.groupBy("fp").agg(F.min("key").alias("least")))
    same = prints.join(least, "fp").where("key <> least").select(F.col("key").alias("a"), F.col("least").alias("b"))
    links = simhash.link_edges(least, bits)
    named = lambda c: least.select(F.col("fp").alias(c), F.col("least").alias(f"{c}_key"))
    return same.unionByName(links.join(named("a"), "a").join(named("b"), "b").select(F.col("a_key").alias("a"), F.col("b_key").alias("b")))


def bucket_edges(texts: DataFrame, words: int = WORDS) -> DataFrame:
    """Candidates a, b (keys) by MinHash: each key of a bucket and the bucket's first."""
    banded = texts.mapInArrow(_banded(words), "bucket long, key long").distinct()
    return banded.repartition("bucket").sortWithinPartitions("bucket", "key").mapInArrow(_chained, "a long, b long")


def _known(df: DataFrame) -> DataFrame:
    """df, kept, and broadcast if it has been counted to be small."""
    df = durable(df)
    return F.broadcast(df) if df.count() <= MAX_BROADCAST_PARTS else df


def verified_edges(members: DataFrame, similarity: float = SIMILARITY, block: int = BLOCK) -> DataFrame:
    """a, b: a spanning forest of the similar pairs inside each part of members (key, part, shingles, n)."""
    sizes = members.groupBy("part").agg(F.ceil(F.sum("n") / block).cast("int").alias("blocks"), F.min("key").alias("pivot"))
    marked = members.join(_known(sizes.where("blocks > 1")), "part", "left")
    found = marked.where("blocks is null").select("key", "part", "shingles").groupBy("part").applyInArrow(_verified(similarity), "a long, b long")
    large = durable(marked.where("blocks is not null"))
    if large.isEmpty():
        return found
    in_block = lambda of: F.pmod(F.xxhash64("key"), F.col(of)).cast("int")
    first = large.where("key = pivot").select("part", F.col("shingles").alias("first"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("j"))
    judged = durable(large.withColumn("j", in_block("blocks")).join(first, ["part", "j"]).select("key", "part", "shingles", "n", "pivot", "first").mapInArrow(_like_first(similarity), "key long, part long, shingles binary, n long, pivot long, near boolean"))
    found = found.unionByName(judged.where("near").select(F.col("key").alias("a"), F.col("pivot").alias("b")))
    rest = judged.where("not near")
    counts = _known(rest.groupBy("part").agg(F.ceil(F.sum("n") / block).cast("int").alias("rows")).join(sizes.select("part", "blocks"), "part"))
    mine = rest.join(counts, "part").withColumn("i", in_block("rows")).select("part", "i", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("j"), "key", "shingles", F.lit(True).alias("left"))
    theirs = judged.join(counts, "part").withColumn("j", in_block("blocks")).select("part", F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("i"), "j", "key", "shingles", F.lit(False).alias("left"))
    return found.unionByName(mine.unionByName(theirs).groupBy("part", "i", "j").applyInArrow(_crossed(similarity), "a long, b long"))


def classes(df: DataFrame, text_col: str = "text", words: int = WORDS, similarity: float = SIMILARITY, block: int = BLOCK) -> DataFrame:
    """key and root (the least key of its class) of the texts that have near copies; other texts are not named."""
    texts = df.select(F.col(text_col).alias("text"))
    together = simhash.components(index_edges(texts, words).unionByName(bucket_edges(texts, words))).select(F.col("node").alias("key"), F.col("root").alias("part"))
    members = with_key(texts).withColumnRenamed("__key", "key").join(together, "key").dropDuplicates(["key"]).select("key", "part", "text")
    members = durable(members.mapInArrow(_set_of(words), "key long, part long, shingles binary, n long"))
    return simhash.components(verified_edges(members, similarity, block)).select(F.col("node").alias("key"), "root")
