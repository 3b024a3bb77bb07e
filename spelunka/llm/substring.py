"""Substring dedup: windows of words, a count-min prefilter, and exact groups of what it lets pass.

Pass 1, the sketch. A window's key is its minimizer: the least hash of the runs of six words inside it, the last such run
of several. Equal windows have equal keys. A stretch is a run of windows whose minimizer stands at one place; no two
windows of a stretch are equal, so a key is counted once for each stretch, and its estimate is never below the number of
times that any of its windows occurs, with a fifth of the entries. Tasks emit sparse sketches: for each shard of each row
of the sketch, the cells that they hit and how often. Sketches merge by addition, shard by shard.

The sketch has CELLS_PER_BYTE cells for each byte of text. Up to ``max_cells`` it is sent to every task as one bit a cell.
Beyond that it stays in shards: packed stretches stream past copies of their shard, ``salts`` of them, and come back to
their documents as the numbers of the stretches to look at. Both ways let the same kind of windows pass; results are equal.

Pass 2. A window whose key is estimated to occur once is unique, and nothing more happens to it. Every other window is
emitted with a 128-bit hash of its words (equality of windows is equality of these hashes), once a document: a task first
settles what its own documents repeat and keeps a window for the smallest of them, so that a passage that very many
documents hold sends one entry a block of text. Entries are packed and dealt to buckets by the hash; a bucket keeps each
window's smallest document while the others stream by and lose it. Buckets grow in number, not in size.

Defined results: null and empty texts have no words; a document of fewer than ``window`` words loses none. Documents with
a null id neither lose words nor take part. Repeated rows of an id are one document: they lose the same words, and none to
each other. Windows that repeat only inside one document stay. Columns other than the two named are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spelunka.llm.common import column, documents, slices

WINDOW, GRAM = 13, 6
ROWS = 2
CELLS_PER_BYTE = 0.25
SHARD_CELLS = 1 << 20
MAX_CELLS = 1 << 29
SALTS = 8
BUCKET_BYTES = 4 << 20  # bytes of text for each bucket of pass 2
HELD = 1 << 18  # entries that a task holds before it settles them
SLICE = 1 << 20  # bytes of text that a task's Python side works on at a time
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)  # odd multipliers
_CHUNK_WORDS, _LONG_WORD = 1 << 16, 256


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _M1
    x = (x ^ (x >> np.uint64(29))) * _M2
    return x ^ (x >> np.uint64(32))


class Words:
    """The words of a text, joined by single spaces, and where each starts and ends."""

    def __init__(self, text: str):
        self.joined = b" ".join(text.encode().split())
        data = np.frombuffer(self.joined, np.uint8)
        spaces = np.flatnonzero(data == 32)
        self.starts, self.ends = np.r_[0, spaces + 1], np.r_[spaces, len(data)]
        self.n = len(self.starts) if len(data) else 0

    def hashes(self) -> np.ndarray:
        """A 64-bit polynomial hash of each word, some words at a time; long words by xxHash."""
        from xxhash import xxh3_64_intdigest

        data, out = np.frombuffer(self.joined, np.uint8), np.zeros(self.n, np.uint64)
        powers = np.multiply.accumulate(np.r_[np.uint64(1), np.full(_LONG_WORD - 1, _M1)])
        for at in range(0, self.n, _CHUNK_WORDS):
            starts, ends = self.starts[at : at + _CHUNK_WORDS], self.ends[at : at + _CHUNK_WORDS]
            sizes = ends - starts
            short = np.flatnonzero(sizes <= _LONG_WORD)
            if len(short):
                n, first = sizes[short], np.cumsum(sizes[short]) - sizes[short]
                place = np.arange(int(n.sum())) - np.repeat(first, n)
                letters = data[np.repeat(starts[short], n) + place].astype(np.uint64) + np.uint64(1)
                out[at + short] = np.add.reduceat(letters * powers[place], first)
            for k in np.flatnonzero(sizes > _LONG_WORD).tolist():
                out[at + k] = xxh3_64_intdigest(self.joined[starts[k] : ends[k]])
        return _mix(out)

    def digests(self, at: np.ndarray, window: int) -> np.ndarray:
        """(windows, 2): 128 bits of each window's words."""
        from xxhash import xxh3_128_digest

        joined = self.joined
        found = b"".join([xxh3_128_digest(joined[a:b]) for a, b in zip(self.starts[at].tolist(), self.ends[at + window - 1].tolist())])
        return np.frombuffer(found, "<u8").reshape(-1, 2)


def window_keys(hashes: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """For a document's windows, given the hashes of its words: where each stretch of windows begins, and its key."""
    gram = min(GRAM, window)
    n = len(hashes) - gram + 1
    grams = hashes[:n].copy()
    for j in range(1, gram):
        grams *= _M2
        grams += hashes[j : j + n]
    grams = _mix(grams)
    span, at, least, done = window - gram + 1, np.arange(n, dtype=np.int32), grams, 1
    while done < span:  # the last least place among 2, 4, ... grams
        step = min(done, span - done)
        a, b = least[: len(least) - step], least[step:]
        later = b <= a
        at = np.where(later, at[step:], at[: len(at) - step])
        least = np.where(later, b, a)
        done += step
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    return first, least[first]


def _windows(text: str | None, window: int):
    """(words, first window of each stretch, keys) of a text, or None where it has no window."""
    words = Words(text) if text else None
    return (words, *window_keys(words.hashes(), window)) if words and words.n >= window else None


# -- the sketch ---------------------------------------------------------------------------------------------------------


def sketch_cells(total_bytes: int) -> int:
    """Cells of a row of the sketch: a power of two that follows the bytes of text."""
    cells = 1 << 12
    while cells < total_bytes * CELLS_PER_BYTE / ROWS:
        cells *= 2
    return cells


def shard_of(keys: np.ndarray, cells: int) -> np.ndarray:
    """The shard of each key; both rows of a key's cells lie in it."""
    return (_mix(keys + _M2) >> np.uint64(32)).astype(np.int64) & (max(1, cells // SHARD_CELLS) - 1)


def cell_of(keys: np.ndarray, row: int, cells: int) -> np.ndarray:
    """The cell of each key inside its shard, in a row of the sketch."""
    return (_mix(keys + np.uint64((row + 2) * int(_M2) % 2**64)) & np.uint64(min(cells, SHARD_CELLS) - 1)).astype(np.int64)


def _sketcher(cells: int, window: int):
    size = min(cells, SHARD_CELLS)

    def emit(keys: list[np.ndarray]):
        every = np.concatenate(keys)
        shard = shard_of(every, cells) * size
        for row in range(ROWS):
            at, counts = np.unique(shard + cell_of(every, row, cells), return_counts=True)
            some, cut = np.unique(at // size, return_index=True)
            cut = np.r_[cut, len(at)].tolist()
            pack = [zlib.compress(np.diff(at[a:b], prepend=s * size).astype(np.uint32).tobytes(), 1) for s, a, b in zip(some.tolist(), cut, cut[1:])]
            many = [zlib.compress(np.minimum(counts[a:b], 2**32 - 1).astype(np.uint32).tobytes(), 1) for a, b in zip(cut, cut[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(some * ROWS + row), pa.array(pack, pa.binary()), pa.array(many, pa.binary())], ["shard", "at", "counts"])

    def work(batches):
        held, n = [], 0
        for batch in slices(batches, size=SLICE):
            for doc, text in zip(column(batch, "id").to_pylist(), column(batch, "text").to_pylist()):
                if doc is not None and (found := _windows(text, window)):
                    held.append(found[2])
                    n += len(held[-1])
            if n > HELD:
                yield from emit(held)
                held, n = [], 0
        if held:
            yield from emit(held)

    return work


def _merger(cells: int):
    size = min(cells, SHARD_CELLS)

    def done(shard, sums):
        return pa.RecordBatch.from_arrays([pa.array([shard // ROWS], pa.int64()), pa.array([shard % ROWS], pa.int32()), pa.array([np.packbits(sums >= 2).tobytes()], pa.binary())], ["shard", "line", "bits"])

    def work(batches):
        """Rows come sorted by shard."""
        shard, sums = None, None
        for batch in batches:
            for s, at, counts in zip(*(column(batch, c).to_pylist() for c in ("shard", "at", "counts"))):
                if s != shard:
                    if sums is not None:
                        yield done(shard, sums)
                    shard, sums = s, np.zeros(size, np.uint64)
                places = np.cumsum(np.frombuffer(zlib.decompress(at), np.uint32), dtype=np.int64)
                sums[places] += np.frombuffer(zlib.decompress(counts), np.uint32)
        if sums is not None:
            yield done(shard, sums)

    return work


def sketch(rows: DataFrame, cells: int, window: int) -> DataFrame:
    """shard, line (row of the sketch) and bits: which cells were hit more than once."""
    partial = rows.select("id", "text").mapInArrow(_sketcher(cells, window), "shard long, at binary, counts binary")
    return partial.repartition("shard").sortWithinPartitions("shard").mapInArrow(_merger(cells), "shard long, line int, bits binary")


class Sketch:
    """What the merged sketch says of keys. bits: one byte string for each row, all its shards in order."""

    def __init__(self, bits: list[bytes], cells: int, one_shard: bool = False):
        self.cells, self.one, self.bits = cells, one_shard, [np.frombuffer(b, np.uint8) for b in bits]

    def repeated(self, keys: np.ndarray) -> np.ndarray:
        """Which keys are estimated to occur more than once."""
        found = np.ones(len(keys), bool)
        base = np.int64(0) if self.one else shard_of(keys, self.cells) * min(self.cells, SHARD_CELLS)
        for row in range(ROWS):
            at = base + cell_of(keys, row, self.cells)
            found &= (self.bits[row][at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)
        return found


def assembled(found: list, cells: int) -> list[bytes]:
    size = min(cells, SHARD_CELLS) // 8
    out = [bytearray(cells // 8) for _ in range(ROWS)]
    for shard, row, bits in found:
        out[row][shard * size : (shard + 1) * size] = bits
    return [bytes(x) for x in out]


# -- packed entries -----------------------------------------------------------------------------------------------------

PACKED = "bucket long, h binary, who binary, at binary, ids binary, rows binary"


def _packed(bucket, h, who, at, ids, rows):
    """One row for each bucket: the entries' hashes, documents and places; documents are named by place in ids and rows."""
    order = np.lexsort((at, who, bucket))
    bucket, h, who, at = bucket[order], h[order], who[order], at[order]
    some, cut = np.unique(bucket, return_index=True)
    out: list[list] = [[], [], [], [], []]
    for a, b in zip(cut.tolist(), np.r_[cut[1:], len(bucket)].tolist()):
        docs, w = np.unique(who[a:b], return_inverse=True)
        for part, value in zip(out, (h[a:b], np.diff(w, prepend=0).astype(np.int32), at[a:b].astype(np.int32), ids[docs], rows[docs])):
            part.append(np.ascontiguousarray(value).tobytes())
    for a in range(0, len(some), 4096):
        yield pa.RecordBatch.from_arrays([pa.array(some[a : a + 4096].astype(np.int64)), *(pa.array(x[a : a + 4096], pa.binary()) for x in out)], ["bucket", "h", "who", "at", "ids", "rows"])


def _unpacked(h, who, at, ids, rows, width: int):
    w = np.cumsum(np.frombuffer(who, np.int32))
    return np.frombuffer(h, np.uint64).reshape(len(w), width), np.frombuffer(ids, np.int64)[w], np.frombuffer(rows, np.int64)[w], np.frombuffer(at, np.int32)


def _by_document(ids, rows, at):
    """id, row and the places of each document, packed."""
    order = np.lexsort((at, rows, ids))
    ids, rows, at = ids[order], rows[order], at[order]
    cut = np.flatnonzero(np.r_[True, (ids[1:] != ids[:-1]) | (rows[1:] != rows[:-1])])
    places = [at[a:b].astype(np.int32).tobytes() for a, b in zip(cut.tolist(), np.r_[cut[1:], len(at)].tolist())]
    for a in range(0, len(cut), 4096):
        k = cut[a : a + 4096]
        yield pa.RecordBatch.from_arrays([pa.array(ids[k]), pa.array(rows[k]), pa.array(places[a : a + 4096], pa.binary())], ["id", "row", "places"])


def settled(h, ids, rows, at):
    """(order, gone, kept) of entries: gone where a smaller document has the window; kept, once a document row, where none has."""
    order = np.lexsort((at, rows, ids, h[:, 1], h[:, 0]))
    h, ids, rows = h[order], ids[order], rows[order]
    new = np.r_[True, (h[1:] != h[:-1]).any(axis=1)]
    first = ids[np.flatnonzero(new)][np.cumsum(new) - 1]
    again = np.r_[False, ~new[1:] & (ids[1:] == ids[:-1]) & (rows[1:] == rows[:-1])]
    return order, (ids > first) & ~again, (ids == first) & ~again


# -- the routed sketch --------------------------------------------------------------------------------------------------


def _stretcher(cells: int, window: int, salts: int):
    """Packed stretches of each document: key, and the stretch's number as place."""

    def emit(held, ids, rows):
        keys, who, at = (np.concatenate([x[k] for x in held]) for k in range(3))
        bucket = shard_of(keys, cells) * salts + int(np.bitwise_xor.reduce(keys) % np.uint64(salts))
        yield from _packed(bucket, keys[:, None], who, at, np.array(ids, np.int64), np.array(rows, np.int64))

    def work(batches):
        held, ids, rows, n = [], [], [], 0
        for batch in slices(batches, size=SLICE):
            for doc, row, text in zip(*(column(batch, c).to_pylist() for c in ("id", "row", "text"))):
                if doc is not None and (found := _windows(text, window)):
                    keys = found[2]
                    held.append((keys, np.full(len(keys), len(ids)), np.arange(len(keys))))
                    ids.append(doc)
                    rows.append(row)
                    n += len(keys)
            if n > HELD:
                yield from emit(held, ids, rows)
                held, ids, rows, n = [], [], [], 0
        if held:
            yield from emit(held, ids, rows)

    return work


def _filterer(cells: int):
    """A shard's bits come first, one row for each row of the sketch; then the packed stretches dealt to that copy of it."""

    def work(batches):
        bucket, bits = None, {}
        for batch in batches:
            for b, line, bit, h, who, at, ids, rows in zip(*(column(batch, c).to_pylist() for c in ("bucket", "line", "bits", "h", "who", "at", "ids", "rows"))):
                if b != bucket:
                    bucket, bits = b, {}
                if bit is not None:
                    bits[line] = bit
                elif len(bits) == ROWS:
                    keys, i, r, place = _unpacked(h, who, at, ids, rows, 1)
                    again = Sketch([bits[k] for k in range(ROWS)], cells, one_shard=True).repeated(keys[:, 0])
                    if again.any():
                        yield from _by_document(i[again], r[again], place[again])

    return work


def routed(rows: DataFrame, merged: DataFrame, cells: int, window: int, salts: int) -> DataFrame:
    """id, row and the packed numbers of the stretches that the sketch estimates to be repeated."""
    copies = merged.select(F.explode(F.sequence(F.col("shard") * salts, F.col("shard") * salts + salts - 1)).alias("bucket"), "line", "bits")
    both = copies.unionByName(rows.mapInArrow(_stretcher(cells, window, salts), PACKED), allowMissingColumns=True)
    found = both.repartition("bucket").sortWithinPartitions("bucket", F.col("bits").isNull()).mapInArrow(_filterer(cells), "id long, row long, places binary")
    return found.groupBy("id", "row").agg(F.collect_set("places").alias("stretches"))


# -- pass 2 -------------------------------------------------------------------------------------------------------------


def _candidates(sent, cells: int, window: int, buckets: int):
    """Packed entries of windows that may be repeated. Rows that are settled here have no hashes."""
    shift = np.uint64(64 - max(1, buckets - 1).bit_length())

    def emit(held, ids, rows):
        ids, rows = np.array(ids, np.int64), np.array(rows, np.int64)
        h, who, at = (np.concatenate([x[k] for x in held]) for k in range(3))
        order, gone, kept = settled(h, ids[who], rows[who], np.abs(at))
        lost, kept = order[gone], order[kept]
        if len(lost):
            docs = who[lost]
            for batch in _packed(docs % buckets, np.zeros((len(lost), 0), np.uint64), docs, at[lost], ids, rows):
                yield batch
        yield from _packed((h[kept, 0] >> shift).astype(np.int64), h[kept], who[kept], at[kept], ids, rows)

    def work(batches):
        known = Sketch(sent.value, cells) if sent else None
        held, ids, rows, seen, n = [], [], [], set(), 0
        for batch in slices(batches, size=SLICE):
            given = [None] * batch.num_rows if known else column(batch, "stretches").to_pylist()
            for doc, row, text, some in zip(*(column(batch, c).to_pylist() for c in ("id", "row", "text")), given):
                if doc is None or (doc, row) in seen or (known is None and not some) or not (found := _windows(text, window)):
                    continue
                words, first, keys = found
                if known:
                    again = known.repeated(keys)
                else:
                    again = np.zeros(len(keys), bool)
                    again[np.concatenate([np.frombuffer(x, np.int32) for x in some])] = True
                if not again.any():
                    continue
                at = np.flatnonzero(np.repeat(again, np.diff(np.r_[first, words.n - window + 1])))
                h, at = once(words.digests(at, window), at)
                held.append((h, np.full(len(at), len(ids)), at))
                seen.add((doc, row))
                ids.append(doc)
                rows.append(row)
                n += len(at)
            if n > HELD:
                yield from emit(held, ids, rows)
                held, ids, rows, seen, n = [], [], [], set(), 0
        if held:
            yield from emit(held, ids, rows)

    return work


def once(h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each window of a document once, at its first place; -1 minus that place if it has several."""
    if len(np.unique(h[:, 0])) == len(h):
        return h, at
    order = np.lexsort((at, h[:, 1], h[:, 0]))
    first = np.flatnonzero(np.r_[True, (h[order][1:] != h[order][:-1]).any(axis=1)])
    several = np.diff(np.r_[first, len(h)]) > 1
    kept = order[first]
    return h[kept], np.where(several, -1 - at[kept], at[kept])


def group_of(ids: np.ndarray, rows: np.ndarray, groups: int) -> np.ndarray:
    """The group of documents that a row belongs to; with_group says the same in columns."""
    return (ids ^ rows) % groups


def with_group(rows: DataFrame, groups: int) -> DataFrame:
    return rows.withColumn("bucket", F.pmod(F.coalesce("id", F.lit(0)).bitwiseXOR(F.col("row")), F.lit(groups)))


def _judge(batches, groups: int):
    """Rows come sorted by bucket. Packed, by group of documents: the places of the windows that a smaller document has."""
    bucket, state, fresh, n = None, None, [], 0
    lost: list = []
    size = 0

    def settle():
        """The smallest documents' entries of all that came in; the rest is lost."""
        nonlocal state, fresh, n, size
        parts = ([state] if state else []) + fresh
        h, ids, rows, at = (np.concatenate([x[k] for x in parts]) for k in range(4))
        order, gone, kept = settled(h, ids, rows, at)
        out, stay = order[gone], order[kept]
        if len(out):
            lost.append((ids[out], rows[out], at[out]))
            size += len(out)
        state, fresh, n = (h[stay], ids[stay], rows[stay], at[stay]), [], 0

    def flush():
        nonlocal lost, size
        if lost:
            ids, rows, at = (np.concatenate([x[k] for x in lost]) for k in range(3))
            order = np.lexsort((rows, ids))
            ids, rows, at = ids[order], rows[order], at[order]
            new = np.r_[True, (ids[1:] != ids[:-1]) | (rows[1:] != rows[:-1])]
            yield from _packed(group_of(ids, rows, groups), np.zeros((len(ids), 0), np.uint64), np.cumsum(new) - 1, at, ids[new], rows[new])
        lost, size = [], 0

    for batch in batches:
        for b, h, who, at, ids, rows in zip(*(column(batch, c).to_pylist() for c in ("bucket", "h", "who", "at", "ids", "rows"))):
            if b != bucket:
                if fresh:
                    settle()
                bucket, state = b, None
            part = _unpacked(h, who, at, ids, rows, 2 if h else 0) if h else (None, *_settled_rows(who, at, ids, rows))
            if h:
                fresh.append(part)
                n += len(part[1])
                if n > HELD:
                    settle()
            else:
                lost.append(part[1:])
                size += len(part[1])
            if size > 2 * HELD:
                yield from flush()
    if fresh:
        settle()
    yield from flush()


def _settled_rows(who, at, ids, rows):
    w = np.cumsum(np.frombuffer(who, np.int32))
    return np.frombuffer(ids, np.int64)[w], np.frombuffer(rows, np.int64)[w], np.frombuffer(at, np.int32)


def _everywhere(words: list[bytes], place: int, window: int) -> list[int]:
    """All places of the window at that place."""
    want, first = words[place : place + window], words[place]
    out, at = [], -1
    while True:
        try:
            at = words.index(first, at + 1)
        except ValueError:
            return out
        if words[at : at + window] == want:
            out.append(at)


def _cutter(window: int):
    """Rows come sorted by bucket: what its documents lose, then their texts."""

    def cut(text: str | None, lists: list[np.ndarray] | None):
        words = text.encode().split() if text else []
        n = len(words)
        if lists:
            at = np.unique(np.concatenate(lists)).astype(np.int64)
            many = [k for p in (-1 - at[at < 0]).tolist() for k in _everywhere(words, p, window)]
            at = np.unique(np.r_[at[at >= 0], np.array(many, np.int64)])
            edge = np.zeros(n + 1, np.int64)
            edge[at] += 1
            edge[at + window] -= 1
            keep = np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()
            words = [words[k] for k in keep]
        return n, n - len(words), b" ".join(words).decode()

    def work(batches):
        bucket, lost = None, {}
        for batch in slices(batches, size=SLICE):
            made = []
            for b, doc, row, text, who, at, ids, rows in zip(*(column(batch, c).to_pylist() for c in ("bucket", "id", "row", "text", "who", "at", "ids", "rows"))):
                if b != bucket:
                    bucket, lost = b, {}
                if who is None:
                    made.append((doc, *cut(text, lost.get((doc, row)) if doc is not None else None)))
                    continue
                w, at = np.cumsum(np.frombuffer(who, np.int32)), np.frombuffer(at, np.int32)
                edges = np.searchsorted(w, np.arange(len(ids) // 8 + 1)).tolist()
                for key, a, z in zip(zip(np.frombuffer(ids, np.int64).tolist(), np.frombuffer(rows, np.int64).tolist()), edges, edges[1:]):
                    lost.setdefault(key, []).append(at[a:z])
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*made), (pa.int64(), pa.int64(), pa.int64(), pa.string()))], ["id", "n_words", "n_removed", "kept"])

    return work


def repeated_windows(rows: DataFrame, total_bytes: int, window: int, buckets: int, max_cells: int = MAX_CELLS, salts: int = SALTS) -> DataFrame:
    """The windows of rows (id, text, row) that also start in a smaller document: packed, by group of documents."""
    spark, cells = rows.sparkSession, sketch_cells(total_bytes)
    merged = sketch(rows, cells, window)
    if cells * ROWS <= max_cells:
        sent, asked = spark.sparkContext.broadcast(assembled(merged.collect(), cells)), rows
    else:
        same = (F.col("r.id") == F.col("o.id")) & (F.col("r.row") == F.col("o.row"))
        sent, asked = None, rows.alias("r").join(routed(rows, merged, cells, window, salts).alias("o"), same).select("r.id", "r.row", "r.text", "o.stretches")
    found = asked.mapInArrow(_candidates(sent, cells, window, buckets), PACKED)
    return found.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(lambda batches: _judge(batches, buckets), PACKED).drop("h")


def dedup_substrings(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, max_cells: int = MAX_CELLS, salts: int = SALTS, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """id, n_words, n_removed, kept (the words that are left, joined by one space)."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).withColumn("row", F.xxhash64("text"))  # tells apart rows of one id
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = 1 << max(0, (total // bucket_bytes).bit_length())
    both = with_group(rows, buckets).unionByName(repeated_windows(rows, total, window, buckets, max_cells, salts), allowMissingColumns=True)
    ready = both.repartition("bucket").sortWithinPartitions("bucket", F.col("who").isNull())
    return ready.mapInArrow(_cutter(window), "id long, n_words long, n_removed long, kept string")


def op5_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of documents without the words of windows that smaller documents hold too."""
    found = dedup_substrings(documents(spark, sf_dir))
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


#: The same in DuckDB.
ORACLE = r"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
k AS (SELECT *, string_agg(word, ' ') OVER span AS k, count(*) OVER span AS n FROM p WINDOW span AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING)),
m AS (SELECT k, min(doc_id) AS first FROM k WHERE n = 13 GROUP BY k),
r AS (SELECT k.doc_id, k.i, k.word, coalesce(k.n = 13 AND m.first < k.doc_id, false)::INTEGER AS hit FROM k LEFT JOIN m USING (k)),
c AS (SELECT doc_id, i, word, max(hit) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) AS gone FROM r),
g AS (SELECT doc_id, count(*) FILTER (WHERE gone = 1) AS n_removed, sha256(coalesce(string_agg(word, ' ' ORDER BY i) FILTER (WHERE gone = 0), '')) AS kept FROM c GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0) AS n_removed, coalesce(kept, sha256('')) AS kept_sha256 FROM d LEFT JOIN g USING (doc_id)"""
