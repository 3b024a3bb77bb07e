"""Byte-level BPE encoding and decoding by merge replay over the distinct words of the whole corpus.

1. Tasks split their texts into words (matches of the split pattern). A block is some documents of a task, up to BLOCK_BYTES
   of text; its distinct words are numbered, the most frequent first, and its documents become lists of these numbers.
   Blocks are shuffled once, to where their ids will come, and read there twice. The words go to shards by their hash.
2. Each shard gathers its words from all blocks and takes each distinct one once. Their bytes lie in one linked array of
   symbols, with an inverted index from token pair (named by the rank of the merge that joins it) to the positions where
   that pair stands. Merges are replayed in rank order: a merge visits only the positions in its index entry, and
   re-indexes only the two neighbours that it touches. No word is replayed twice in the corpus.
3. The ids of a block's words go back to the block, with the words' numbers, and its documents' ids are gathered from
   them. Texts themselves never move. Decoding gathers the tokens' bytes in the same way.

Shards are as many as keep each at about SHARD_BYTES of words, by the bytes of text, which are counted first.

Defined results: a null or empty text has no tokens and decodes to no bytes; texts of any length are encoded whole; rows
with null ids keep a null id; repeated rows give a row each; an empty table gives no rows. Columns other than the two
named are not read.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spelunka.llm.common import column, documents, slices

BLOCK_ROWS, BLOCK_BYTES = 1 << 14, 8 << 20
WORDS_SHARE = 0.2  # about how much of a block's text its distinct words are; only the number of shards follows it
SHARD_BYTES = 2 << 20
PACK_BYTES = 1 << 20


def load_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a base64 token and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class MergeReplay:
    """Encodes many words together."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.pairs: dict[int, int] = {}

    def _rank(self, a: int, b: int) -> int:
        """The rank of the merge of two tokens, or -1."""
        key = a << 32 | b
        rank = self.pairs.get(key)
        if rank is None:
            rank = self.pairs[key] = self.ranks.get(self.bytes_of[a] + self.bytes_of[b], -1)
        return rank

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """For each word, not empty, its ids as little-endian unsigned 32-bit integers."""
        out: list = [self.ranks.get(w) for w in words]  # a word that is itself a token is that token
        rest = [i for i, rank in enumerate(out) if rank is None]
        for i, rank in enumerate(out):
            if rank is not None:
                out[i] = rank.to_bytes(4, "little")
        if not rest:
            return out
        text = np.frombuffer(b"".join(words[i] for i in rest), np.uint8)
        ends = np.cumsum([len(words[i]) for i in rest])
        first = self.of_byte[text]
        after = np.arange(1, len(text) + 1)
        after[ends - 1] = -1
        before = np.arange(-1, len(text) - 1)
        before[np.r_[0, ends[:-1]]] = -1
        # The index of the first pairs, by vector: the rank of each pair of bytes in use, then positions grouped by rank.
        codes = text[:-1].astype(np.int64) << 8 | text[1:]
        used, where = np.unique(codes, return_inverse=True)
        known = np.array([self._rank(int(self.of_byte[c >> 8]), int(self.of_byte[c & 255])) for c in used], np.int64)
        standing = known[where] if len(used) else np.zeros(0, np.int64)
        live = np.flatnonzero((standing >= 0) & (after[:-1] >= 0))
        order = live[np.argsort(standing[live], kind="stable")]
        heads, starts = np.unique(standing[order], return_index=True)
        index = {int(r): part.tolist() for r, part in zip(heads, np.split(order, starts[1:]))} if len(heads) else {}
        symbol, nxt, prv = first.tolist(), after.tolist(), before.tolist()
        self._replay(symbol, nxt, prv, index)
        ids = np.array(symbol, np.int64)
        starts = np.r_[0, ends[:-1]]
        alive = ids >= 0
        counts = np.add.reduceat(alive.astype(np.int64), starts)
        packed = ids[alive].astype("<u4").tobytes()
        at = 0
        for i, n in zip(rest, (counts * 4).tolist()):
            out[i] = packed[at : at + n]
            at += n
        return out

    def _replay(self, symbol: list[int], nxt: list[int], prv: list[int], index: dict[int, list[int]]) -> None:
        """Applies the merges in rank order; a swallowed symbol becomes -1."""
        rank_of, pairs = self._rank, self.pairs
        heap = list(index)
        heapify(heap)
        while heap:
            rank = heappop(heap)
            todo = index.pop(rank)
            todo.sort()  # leftmost first, as within a word
            for done, p in enumerate(todo, 1):
                q = nxt[p]
                if q < 0 or symbol[p] < 0 or pairs.get(symbol[p] << 32 | symbol[q]) != rank:
                    continue  # a neighbour has changed since
                n, o = nxt[q], prv[p]
                symbol[p], symbol[q], nxt[p] = rank, -1, n
                if n >= 0:
                    prv[n] = p
                    r = rank_of(rank, symbol[n])
                    if r >= 0:
                        if r in index:
                            index[r].append(p)
                        else:
                            index[r] = [p]
                            heappush(heap, r)
                if o >= 0:
                    r = rank_of(symbol[o], rank)
                    if r >= 0:
                        if r in index:
                            index[r].append(o)
                        else:
                            index[r] = [o]
                            heappush(heap, r)
                if heap and heap[0] < rank and done < len(todo):  # a new pair goes first: the rest of this merge waits
                    if rank in index:
                        index[rank] += todo[done:]
                    else:
                        index[rank] = todo[done:]
                        heappush(heap, rank)
                    break


@lru_cache(maxsize=2)
def _replayer(path: str) -> MergeReplay:
    return MergeReplay(load_ranks(path))


# -- blocks -------------------------------------------------------------------------------------------------------------

BLOCKS = "block long, words binary, sizes binary, ids binary, null binary, counts binary, numbers binary"


def _pack(x: np.ndarray | bytes) -> bytes:
    """Compressed; numbers as unsigned 32-bit ones, all their low bytes first."""
    return zstandard.compress(x if isinstance(x, bytes) else np.ascontiguousarray(x, np.uint32).view(np.uint8).reshape(-1, 4).T.tobytes(), 3)


def _unpack(x: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(x), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view(np.uint32).reshape(-1)


def _cut(words: bytes, sizes: np.ndarray) -> list[bytes]:
    ends = np.cumsum(sizes, dtype=np.int64).tolist()
    return [words[a:b] for a, b in zip([0, *ends], ends)]


def _binary(**columns) -> pa.RecordBatch:
    """Numbers as longs, the rest as bytes."""
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64() if isinstance(x[0], int) else pa.binary()) for x in columns.values()], list(columns))


def _blocker(pattern: str):
    """One row for each block: its distinct words, the most frequent first, and its documents as numbers of words."""

    def work(batches):
        import regex
        from pyspark import TaskContext

        words_of, n = regex.compile(pattern).findall, 0
        for batch in slices(batches, rows=BLOCK_ROWS, size=BLOCK_BYTES):
            split = [words_of(text) if text else [] for text in column(batch, "text").to_pylist()]
            known = sorted(set().union(*split))
            number = dict(zip(known, range(len(known)))).__getitem__
            counts = np.fromiter(map(len, split), np.int64, len(split))
            numbers = np.fromiter((k for words in split for k in map(number, words)), np.int64, int(counts.sum()))
            order = np.argsort(-np.bincount(numbers, minlength=len(known)), kind="stable")
            place = np.empty(len(known), np.int64)
            place[order] = np.arange(len(known))
            packed = [known[k].encode() for k in order.tolist()]
            ids = column(batch, "id")
            yield _binary(
                block=[TaskContext.get().partitionId() << 32 | n], words=[_pack(b"".join(packed))], sizes=[_pack(np.fromiter(map(len, packed), np.uint32, len(packed)))],
                ids=[ids.fill_null(0).to_numpy(zero_copy_only=False).tobytes()], null=[np.packbits(ids.is_null().to_numpy(zero_copy_only=False)).tobytes()],
                counts=[_pack(counts)], numbers=[_pack(place[numbers])],
            )
            n += 1

    return work


def _dealer(shards: int):
    """The words of each block and their numbers, by shard."""

    def work(batches):
        from xxhash import xxh3_64_intdigest

        for batch in batches:
            for block, words, sizes in zip(*(column(batch, c).to_pylist() for c in ("block", "words", "sizes"))):
                each = _cut(zstandard.decompress(words), _unpack(sizes))
                shard = (np.fromiter(map(xxh3_64_intdigest, each), np.uint64, len(each)) % np.uint64(shards)).astype(np.int64)
                order = np.argsort(shard, kind="stable")
                some, cut = np.unique(shard[order], return_index=True)
                for s, part in zip(some.tolist(), np.split(order, cut[1:])):
                    own = [each[k] for k in part.tolist()]
                    yield _binary(block=[block], shard=[s], words=[_pack(b"".join(own))], sizes=[_pack(np.fromiter(map(len, own), np.uint32, len(own)))], which=[_pack(np.diff(part, prepend=0))])

    return work


def _replayed(path: str):
    """Rows come sorted by shard: for each block, how many ids each of its words has, and the ids."""

    def answers(asked):
        replay = _replayer(path)
        lists = [_cut(zstandard.decompress(words), _unpack(sizes)) for _, words, sizes, _ in asked]
        new = list(dict.fromkeys(w for words in lists for w in words))
        get = dict(zip(new, replay.encode_words(new))).__getitem__
        for (block, _, _, which), words in zip(asked, lists):
            found = list(map(get, words))
            yield _binary(block=[block], which=[which], lengths=[_pack(np.fromiter(map(len, found), np.int64, len(found)) // 4)], tokens=[_pack(np.frombuffer(b"".join(found), "<u4"))])

    def work(batches):
        shard, asked = None, []
        for batch in batches:
            for s, *one in zip(*(column(batch, c).to_pylist() for c in ("shard", "block", "words", "sizes", "which"))):
                if s != shard:
                    yield from answers(asked)
                    shard, asked = s, []
                asked.append(one)
        yield from answers(asked)

    return work


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... for sizes[0] numbers, then on with starts[1]."""
    ends = np.cumsum(sizes)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


class Decoder:
    """The bytes of all tokens, one after another."""

    def __init__(self, ranks: dict[bytes, int]):
        top = max(ranks.values()) + 1
        sizes = np.zeros(top, np.int64)
        for token, rank in ranks.items():
            sizes[rank] = len(token)
        self.sizes, self.starts = sizes, np.cumsum(sizes) - sizes
        self.bytes = np.frombuffer(b"".join(token for token, _ in sorted(ranks.items(), key=lambda x: x[1])), np.uint8)

    def decode(self, ids: np.ndarray) -> bytes:
        parts = (ids[i : i + (1 << 20)].astype(np.int64) for i in range(0, len(ids), 1 << 20))
        return b"".join(self.bytes[ranges(self.starts[x], self.sizes[x])].tobytes() for x in parts)


@lru_cache(maxsize=2)
def _decoder(path: str) -> Decoder:
    return Decoder(load_ranks(path))


def _gatherer(path: str):
    """id, ids and decoded bytes of each document of a block, given what its words' shards reply."""

    def work(batches):
        decoder = _decoder(path)
        def out(rows):
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(), pa.binary(), pa.binary()))], ["id", "ids", "decoded"])

        for batch in batches:
            for replies, ids, null, counts, numbers in zip(*(column(batch, c).to_pylist() for c in ("replies", "ids", "null", "counts", "numbers"))):
                held = [[_unpack(r[c]) for c in ("which", "lengths", "tokens")] for r in replies or []]
                which, lengths, every = (np.concatenate(x).astype(np.int64) for x in zip(*((np.cumsum(w), n, t) for w, n, t in held))) if held else [np.zeros(0, np.int64)] * 3
                size, start = np.zeros(len(which), np.int64), np.zeros(len(which), np.int64)
                size[which], start[which] = lengths, np.cumsum(lengths) - lengths
                ids, counts, numbers = np.frombuffer(ids, np.int64), _unpack(counts).astype(np.int64), _unpack(numbers)
                null = np.unpackbits(np.frombuffer(null, np.uint8), count=len(ids)).astype(bool)
                ends, rows, made = np.cumsum(counts), [], 0
                for k, (a, b) in enumerate(zip((ends - counts).tolist(), ends.tolist())):
                    words = numbers[a:b]
                    found = every[ranges(start[words], size[words])]
                    text = decoder.decode(found)
                    rows.append((None if null[k] else int(ids[k]), found.astype("<u4").tobytes(), text))
                    made += len(text) + 4 * len(found)
                    if made > 8 * PACK_BYTES:
                        yield out(rows)
                        rows, made = [], 0
                if rows:
                    yield out(rows)

    return work


def encode_texts(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """id, ids (binary) and decoded (binary, from the ids) of each whole text."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-int(total * WORDS_SHARE) // shard_bytes))
    blocks = rows.mapInArrow(_blocker(pattern), BLOCKS).repartition("block")
    # All columns go to both readers, so that Spark sees one and the same shuffle.
    dealt = blocks.mapInArrow(_dealer(shards), "block long, shard long, words binary, sizes binary, which binary")
    replies = dealt.repartition("shard").sortWithinPartitions("shard").mapInArrow(_replayed(path), "block long, which binary, lengths binary, tokens binary")
    gathered = replies.groupBy("block").agg(F.collect_list(F.struct("which", "lengths", "tokens")).alias("replies"))
    return blocks.join(gathered, "block", "left").mapInArrow(_gatherer(path), "id long, ids binary, decoded binary")


def digests(encoded: DataFrame) -> DataFrame:
    return encoded.select(
        F.col("id").alias("doc_id"),
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def public_vocabulary() -> tuple[str, str]:
    """Path of the rank file and the split pattern."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of documents, encoded and decoded."""
    return digests(encode_texts(documents(spark, sf_dir), *public_vocabulary()))
