"""Line dedup: a sharded minimal perfect hash over distinct line hashes; documents probe its arrays.

1. Tasks hash the keys of their lines (128 bits) and emit each with the ids that hold it. Distinct pairs of hash and id
   are counted by hash, with the largest id. Only keys in enough documents remain.
2. The remaining hashes are dealt to shards. Each shard becomes a minimal perfect hash: displacements of its buckets, and
   arrays of a 64-bit fingerprint, the count and the largest id, one entry a key, no gaps.
3. Documents compute the same hashes and look them up in the arrays. If the arrays of all shards together are at most
   ``max_broadcast_bytes``, known from the count before anything is sent, they go to every task. Beyond that, line hashes
   go to the shards instead: a shard's arrays are copied to ``salts`` tasks, to more where its keys are in very many
   documents (one for each ROWS_PER_COPY), hashes stream past them, and the positions to drop come back to their documents.

Keys are equal where both 64-bit halves of the hash are. A probe compares one 64-bit fingerprint mixed from both halves,
so of 2**64 lines that no key equals one is mistaken for one.

Defined results: a null or empty text is one empty line, which is never long enough to drop. A document counts once for
a key however often it holds it, and repeated rows of an id are one document. All rows of the largest id keep the line.
Rows with a null id are never changed, and count for no key. Within the document that keeps a key, all its occurrences
stay. Columns other than the two named are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spelunka.llm.common import MAX_HOT_KEYS, column, documents, durable, slices

MIN_LENGTH, MIN_DOCUMENTS = 20, 3
SHARD_KEYS = 1 << 15
MAX_BROADCAST_BYTES = 64 << 20
SALTS, ROWS_PER_COPY = 8, 500_000
_MASK = (1 << 64) - 1


def line_key(line: bytes) -> bytes:
    """A UTF-8 line stripped of ASCII white space at both ends, with A-Z in lower case."""
    return line.strip().lower()


def long_enough(key: bytes, least: int) -> bool:
    return len(key) >= least and (len(key) >= 4 * least or len(key.decode()) >= least)


def key_hash(key: bytes) -> tuple[int, int]:
    h = xxhash.xxh3_128_intdigest(key)
    return h >> 64, h & _MASK


def _signed(values) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64))


def _holders(least: int):
    """Each key and the document that holds it, once a slice."""

    def work(batches):
        for batch in slices(batches):
            found: set[tuple[int, int, int]] = set()
            for doc, text in zip(column(batch, "id").to_pylist(), column(batch, "text").to_pylist()):
                if doc is None or not text:
                    continue
                found.update((*key_hash(k), doc) for k in {k for k in map(line_key, text.encode().split(b"\n")) if long_enough(k, least)})
            if found:
                h1, h2, ids = zip(*found)
                yield pa.RecordBatch.from_arrays([_signed(h1), _signed(h2), pa.array(ids, pa.int64())], ["h1", "h2", "id"])

    return work


# -- minimal perfect hashes ---------------------------------------------------------------------------------------------


def _mixed(h: np.ndarray, seed) -> np.ndarray:
    """A well spread function of a 64-bit hash and a seed (the finaliser of MurmurHash3; fixed multipliers)."""
    with np.errstate(over="ignore"):
        x = h ^ (np.asarray(seed).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> np.uint64(33))


def build_shard(h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(displacements of the buckets, slot of each key): a minimal perfect hash of distinct pairs of 64-bit hashes.

    Buckets of about three keys are placed from the largest down: the least seed that sends all keys of a bucket to free
    slots. Buckets of one key take what is left; their displacement is -1 minus the slot itself.
    """
    n = len(h1)
    buckets = max(1, (n + 2) // 3)
    of = (h1 % np.uint64(buckets)).astype(np.int64)
    sizes = np.bincount(of, minlength=buckets)
    order = np.argsort(of, kind="stable")
    starts = np.r_[0, np.cumsum(sizes)]
    seeds, slots, taken = np.zeros(buckets, np.int64), np.zeros(n, np.int64), np.zeros(n, bool)
    step = np.arange(1, 65)
    for b in np.argsort(-sizes, kind="stable").tolist():
        if sizes[b] < 2:
            break
        keys = order[starts[b] : starts[b + 1]]
        first = 0
        while True:
            tried = (_mixed(h2[keys][None, :], (first + step)[:, None]) % np.uint64(n)).astype(np.int64)
            good = ~taken[tried].any(axis=1)
            sort = np.sort(tried, axis=1)
            good &= (sort[:, 1:] != sort[:, :-1]).all(axis=1)
            if good.any():
                k = int(np.argmax(good))
                seeds[b], slots[keys] = first + step[k], tried[k]
                taken[tried[k]] = True
                break
            first += 64
    free = np.flatnonzero(~taken)
    single = np.flatnonzero(sizes == 1)
    keys = order[starts[single]]
    slots[keys] = free
    seeds[single] = -1 - free
    return seeds.astype(np.int32), slots


class Shards:
    """The arrays of some shards, probed by vector."""

    def __init__(self, rows: list, shards: int):
        self.shards = shards
        of = {r["shard"]: r for r in rows}
        parts = [[np.frombuffer(of[s][k], t) if s in of else np.zeros(0, t) for s in range(shards)] for k, t in (("seeds", np.int32), ("prints", np.uint64), ("counts", np.int32), ("lasts", np.int64))]
        self.buckets, self.keys = (np.array([len(x) for x in p], np.int64) for p in parts[:2])
        self.bucket_from, self.key_from = (np.r_[0, np.cumsum(x)[:-1]] for x in (self.buckets, self.keys))
        self.seeds, self.prints, self.counts, self.lasts = map(np.concatenate, parts)

    def probe(self, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(count, largest id) of each line; count 0 where the line is not in the index."""
        counts, lasts = np.zeros(len(h1), np.int64), np.zeros(len(h1), np.int64)
        shard = shard_of(h1, self.shards)
        ok = np.flatnonzero(self.keys[shard] > 0)
        if len(ok):
            s, a, b = shard[ok], h1[ok], h2[ok]
            seed = self.seeds[self.bucket_from[s] + (a % self.buckets[s].astype(np.uint64)).astype(np.int64)].astype(np.int64)
            slot = np.where(seed < 0, -1 - seed, (_mixed(b, np.maximum(seed, 0)) % self.keys[s].astype(np.uint64)).astype(np.int64))
            at = self.key_from[s] + slot
            same = self.prints[at] == (a ^ _mixed(b, 7))
            counts[ok], lasts[ok] = np.where(same, self.counts[at], 0), np.where(same, self.lasts[at], 0)
        return counts, lasts


def shard_of(h1: np.ndarray, shards: int) -> np.ndarray:
    return (_mixed(h1, 1) % np.uint64(shards)).astype(np.int64)


def _builder(pdf):
    import pandas as pd

    h1, h2 = (pdf[c].to_numpy(np.int64).view(np.uint64) for c in ("h1", "h2"))
    seeds, slots = build_shard(h1, h2)
    at = np.argsort(slots)
    return pd.DataFrame(
        {
            "shard": [int(pdf["shard"].iloc[0])],
            "seeds": [seeds.tobytes()],
            "prints": [(h1 ^ _mixed(h2, 7))[at].tobytes()],
            "counts": [np.minimum(pdf["n"].to_numpy(np.int64)[at], 2**31 - 1).astype(np.int32).tobytes()],
            "lasts": [pdf["last"].to_numpy(np.int64)[at].tobytes()],
        }
    )


def _shard_column(shards: int):
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("long")
    def shard(h1):
        import pandas as pd

        return pd.Series(shard_of(h1.to_numpy(np.int64).view(np.uint64), shards))

    return shard


# -- documents ----------------------------------------------------------------------------------------------------------


def _hashed_lines(batch, least: int):
    """Lines of each document of a batch; document, line and two hashes of those lines that are long enough."""
    split, doc, line, h1, h2 = [], [], [], [], []
    for i, text in enumerate(column(batch, "text").to_pylist()):
        lines = (text or "").encode().split(b"\n")
        split.append(lines)
        for j, x in enumerate(lines):
            if len(x) >= least and long_enough(k := line_key(x), least):
                a, b = key_hash(k)
                doc.append(i)
                line.append(j)
                h1.append(a)
                h2.append(b)
    return split, np.array(doc, np.int64), np.array(line, np.int64), np.array(h1, np.uint64), np.array(h2, np.uint64)


def _emit(batch, split, dropped: dict[int, set]):
    kept = [b"\n".join(x for j, x in enumerate(lines) if j not in dropped[i]) if i in dropped else b"\n".join(lines) for i, lines in enumerate(split)]
    null = [not column(batch, "text")[i].is_valid and i not in dropped for i in range(len(split))]
    carried = [c for c in batch.schema.names if c.startswith(CARRIED)]
    return pa.RecordBatch.from_arrays(
        [column(batch, "id"), pa.array([len(x) for x in split], pa.int64()), pa.array([len(dropped.get(i, ())) for i in range(len(split))], pa.int64()), pa.array([None if z else k.decode() for k, z in zip(kept, null)], pa.string()), *(column(batch, c) for c in carried)],
        ["id", "n_lines", "n_dropped", "kept", *carried],
    )


OUT = "id long, n_lines long, n_dropped long, kept string"
CARRIED = "__carried_"


def _prober(arrays, least: int, shards: int):
    def work(batches):
        index = Shards(arrays.value, shards)
        for batch in slices(batches):
            split, doc, line, h1, h2 = _hashed_lines(batch, least)
            dropped: dict[int, set] = {}
            if len(doc):
                counts, lasts = index.probe(h1, h2)
                ids = column(batch, "id")
                own, known = ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_valid().to_numpy(zero_copy_only=False)
                for k in np.flatnonzero((counts > 0) & (lasts != own[doc]) & known[doc]).tolist():
                    dropped.setdefault(int(doc[k]), set()).add(int(line[k]))
            yield _emit(batch, split, dropped)

    return work


def _line_rows(least: int):
    def work(batches):
        for batch in slices(batches):
            _, doc, line, h1, h2 = _hashed_lines(batch, least)
            ids = column(batch, "id")
            keep = ids.is_valid().to_numpy(zero_copy_only=False)[doc] if len(doc) else np.zeros(0, bool)
            doc, line, h1, h2 = doc[keep], line[keep], h1[keep], h2[keep]
            if len(doc):
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(doc)), column(batch, "row").take(pa.array(doc)), pa.array(line), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), pa.array(shard_of(h1, 1 << 62))], ["id", "row", "line", "h1", "h2", "spread"])

    return work


def _streamed(batches):
    """Arrays of a shard come first, then the lines dealt to it."""
    held = None
    for batch in batches:
        rows = batch.to_pydict()
        pending: list[int] = []

        def flush():
            if pending and held is not None:
                h1, h2, ids = (np.array([rows[c][i] for i in pending], np.int64) for c in ("h1", "h2", "id"))
                counts, lasts = held.probe(h1.view(np.uint64), h2.view(np.uint64))
                hit = [pending[k] for k in np.flatnonzero((counts > 0) & (lasts != ids)).tolist()]
                if hit:
                    return pa.RecordBatch.from_arrays([pa.array([rows["id"][i] for i in hit], pa.int64()), pa.array([rows["row"][i] for i in hit], pa.binary()), pa.array([rows["line"][i] for i in hit], pa.int64())], ["id", "row", "line"])
            return None

        for i in range(batch.num_rows):
            if rows["seeds"][i] is not None:
                if (out := flush()) is not None:
                    yield out
                pending = []
                held = _One({k: rows[k][i] for k in ("seeds", "prints", "counts", "lasts")})
                current = (rows["shard"][i], rows["salt"][i])
            elif held is not None and (rows["shard"][i], rows["salt"][i]) == current:
                pending.append(i)
        if (out := flush()) is not None:
            yield out


class _One(Shards):
    """One shard alone: every line probes it."""

    def __init__(self, row: dict):
        super().__init__([{"shard": 0, **row}], 1)


def _joiner(least: int):
    def work(batches):
        for batch in slices(batches):
            split = [(t or "").encode().split(b"\n") for t in column(batch, "text").to_pylist()]
            lists = column(batch, "lines").to_pylist()
            yield _emit(batch, split, {i: set(x) for i, x in enumerate(lists) if x})

    return work


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH, min_documents: int = MIN_DOCUMENTS, max_broadcast_bytes: int = MAX_BROADCAST_BYTES, salts: int = SALTS, shard_keys: int = SHARD_KEYS, carry: list[str] = ()) -> DataFrame:
    """id, n_lines (before dropping), n_dropped, kept (the text that is left; null where the text was null), and the columns to carry, in that order."""
    spark = df.sparkSession
    names = {c: f"{CARRIED}{i}" for i, c in enumerate(carry)}
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), *(F.col(c).alias(x) for c, x in names.items()))
    out = T.StructType([*T.StructType.fromDDL(OUT).fields, *(T.StructField(x, rows.schema[x].dataType) for x in names.values())])
    back = lambda d: d.select("id", "n_lines", "n_dropped", "kept", *(F.col(x).alias(c) for c, x in names.items()))
    held = rows.select("id", "text").mapInArrow(_holders(min_length), "h1 long, h2 long, id long").distinct()
    shared = durable(held.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.max("id").alias("last")).where(F.col("n") >= min_documents))
    keys = shared.count()
    shards = max(1, -(-keys // shard_keys))
    built = shared.withColumn("shard", _shard_column(shards)("h1")).groupBy("shard").applyInPandas(_builder, "shard long, seeds binary, prints binary, counts binary, lasts binary")
    if keys * 24 <= max_broadcast_bytes:  # eight bytes each of fingerprint and id, four of count, under two of displacements
        arrays = spark.sparkContext.broadcast([r.asDict() for r in built.collect()])
        return back(rows.mapInArrow(_prober(arrays, min_length, shards), out))
    rows = rows.withColumn("row", F.unhex(F.md5(F.coalesce("text", F.lit("")))))  # with the id, it tells rows apart where they differ
    lines = rows.select("id", "text", "row").mapInArrow(_line_rows(min_length), "id long, row binary, line long, h1 long, h2 long, spread long").dropDuplicates(["id", "row", "line"])
    often = shared.withColumn("shard", _shard_column(shards)("h1")).groupBy("shard").agg(F.ceil(F.sum("n") / ROWS_PER_COPY).alias("copies")).where(F.col("copies") > salts)
    often = durable(often)  # a row for each ROWS_PER_COPY * salts lines at most
    often = F.broadcast(often) if often.count() <= MAX_HOT_KEYS else often
    spread = lambda df: df.join(often, "shard", "left").withColumn("copies", F.coalesce("copies", F.lit(salts)))
    lines = spread(lines.withColumn("shard", _shard_column(shards)("h1")).drop("spread")).withColumn("salt", F.pmod(F.xxhash64("id", "row"), F.col("copies"))).drop("copies")
    copies = spread(built).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1))).drop("copies")
    both = copies.unionByName(lines, allowMissingColumns=True).repartition("shard", "salt").sortWithinPartitions("shard", "salt", F.col("seeds").isNull())
    dropped = both.mapInArrow(_streamed, "id long, row binary, line long").groupBy("id", "row").agg(F.collect_list("line").alias("lines"))
    joined = rows.alias("r").join(dropped.alias("d"), (F.col("r.id") == F.col("d.id")) & (F.col("r.row") == F.col("d.row")), "left").select("r.*", "d.lines").drop("row")
    return back(joined.mapInArrow(_joiner(min_length), out))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of documents without the lines that later documents repeat."""
    found = dedup_lines(documents(spark, sf_dir))
    return found.select(F.col("id").alias("doc_id"), "n_lines", "n_dropped", F.sha2(F.coalesce("kept", F.lit("")), 256).alias("kept_sha256"))


#: The same in DuckDB.
ORACLE = r"""WITH l AS (SELECT doc_id, unnest(t) AS line, generate_subscripts(t, 1) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS t FROM documents)),
k AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
h AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
f AS (SELECT k.doc_id, line, i, coalesce(last <> k.doc_id, false) AS gone FROM k LEFT JOIN h USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256 FROM f GROUP BY doc_id"""


def brute_force(docs: list[tuple[int | None, str | None]], min_length: int = MIN_LENGTH, min_documents: int = MIN_DOCUMENTS) -> list[tuple]:
    """The same by plain dictionaries, for tests: (id, n_lines, n_dropped, digest) in input order."""
    holders: dict[str, list[int]] = {}
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(fold)
    for doc, text in docs:
        for k in {key(x) for x in (text or "").split("\n")} if doc is not None else ():
            holders.setdefault(k, []).append(doc)
    out = []
    for doc, text in docs:
        lines = (text or "").split("\n")
        kept = [x for x in lines if doc is None or len(k := key(x)) < min_length or len(holders[k]) < min_documents or max(holders[k]) == doc]
        out.append((doc, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return out
