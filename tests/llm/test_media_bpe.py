import hashlib
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import types as T

from spelunka.llm import bpe, media

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("id", T.StringType()), T.StructField("media", T.StringType())])
TEXTS = [None, "", "a", "x" * 64, "é\n" * 500, "Hello  world!!  don't 123\t\t\nend ", "aaaaaaaaaaaaaaaaaaa" * 50, "日本語 text 🎉🎉 \x1c\x85 ok", "word " * 20000, "word " * 20000]


def docs(spark):
    return spark.createDataFrame([(i if i != 2 else None, t, "clash", "clash") for i, t in enumerate(TEXTS)], DOCS)


def test_png_round_trip_and_damage():
    rng = np.random.default_rng(1)
    for rows in (1, 2, 31, 33, 400):
        for data in (rng.integers(0, 256, rows * 64, np.uint8).tobytes(), bytes(rows * 64), bytes(range(64)) * rows):
            png = media.encode_png(data)
            assert media.decode_png(png).tobytes() == data
    for at in range(8, len(png), 7):
        bad = bytearray(png)
        bad[at] ^= 1
        with pytest.raises(media.MediaError):
            media.decode_png(bytes(bad))
    with pytest.raises(media.MediaError):
        media.decode_png(png[:-3])


def test_all_filters():
    rng = np.random.default_rng(2)
    pixels = rng.integers(0, 256, (40, 16), dtype=np.uint8)
    kinds = rng.integers(0, 5, 40).astype(np.uint8)
    rows = np.zeros_like(pixels)
    big = pixels.astype(int)
    for y in range(40):
        for x in range(16):
            a = big[y, x - 1] if x else 0
            b = big[y - 1, x] if y else 0
            c = big[y - 1, x - 1] if x and y else 0
            p = a + b - c
            paeth = min((a, b, c), key=lambda v: abs(p - v))
            rows[y, x] = (big[y, x] - (0, a, b, (a + b) // 2, paeth)[kinds[y]]) % 256
    assert (media.unfilter(kinds, rows) == pixels).all()


def test_media_query(spark):
    got = {r.doc_id: r for r in media.media_features(media.store_texts(docs(spark))).withColumnRenamed("id", "doc_id").collect()}
    assert len(got) == len(TEXTS)
    for i, t in enumerate(TEXTS):
        r, data = got[i if i != 2 else None], (t or "").encode()
        padded = data + bytes(64 - len(data) % 64 if len(data) % 64 or not data else 0)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
        assert len(r.hash) == 8
    assert got[8].hash == got[9].hash and got[8].media_sha256 == got[9].media_sha256
    assert media.media_features(media.store_texts(docs(spark).limit(0))).count() == 0


def slow_hash(pixels):
    """Area averages of 32 x 32 fields, sums of cosines one by one, bits against the median."""
    h, w = pixels.shape

    def shares(n, k):  # of n cells, what lies in the k-th of 32 equal parts
        a, b = k * n / 32, (k + 1) * n / 32
        return [(i, min(b, i + 1) - max(a, i)) for i in range(int(a), min(n, math.ceil(b))) if min(b, i + 1) > max(a, i)]

    field = [[sum(p * q * float(pixels[i, j]) for i, p in shares(h, y) for j, q in shares(w, x)) * 32 * 32 / (h * w) for x in range(32)] for y in range(32)]
    cosine = [[math.cos(math.pi * u * (x + 0.5) / 32) for x in range(32)] for u in range(8)]
    low = [round(sum(field[y][x] * cosine[u][y] * cosine[v][x] for y in range(32) for x in range(32)), 6) for u in range(8) for v in range(8)]
    middle = sorted(low)
    middle = (middle[31] + middle[32]) / 2
    bits = [x > middle for x in low]
    return bytes(sum(bits[8 * i + j] << (7 - j) for j in range(8)) for i in range(8))


def test_features_against_brute_force(spark):
    rng = np.random.default_rng(4)
    for rows in (1, 2, 31, 45, 130):
        pixels = rng.integers(0, 256, (rows, 64), dtype=np.uint8)
        assert media.cosine_hash(pixels) == slow_hash(pixels)
    for r in media.media_features(media.store_texts(docs(spark))).join(media.store_texts(docs(spark)).select("id", "media"), "id").collect():
        assert r.media_sha256 == hashlib.sha256(r.media).hexdigest() and r.media_bytes == len(r.media)
        assert r.hash == slow_hash(media.decode_png(bytes(r.media))) or r.n_bytes > 50_000


def test_bpe_equals_tiktoken(spark):
    import tiktoken

    path, pattern = bpe.public_vocabulary()
    known = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.load_ranks(path), special_tokens={})
    got = {r.doc_id: r for r in bpe.digests(bpe.encode_texts(docs(spark), path, pattern)).collect()}
    for i, t in enumerate(TEXTS):
        ids = known.encode_ordinary(t or "")
        r = got[i if i != 2 else None]
        assert r.n_tokens == len(ids), t[:50]
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert bpe.encode_texts(docs(spark).limit(0), path, pattern).count() == 0


def test_bpe_random_words():
    import tiktoken

    path, pattern = bpe.public_vocabulary()
    ranks = bpe.load_ranks(path)
    known = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("abehilnorst"), rng.integers(1, 30))) for _ in range(3000)] + ["é" * 9, "ß日" * 5]
    got = bpe.MergeReplay(ranks).encode_words([w.encode() for w in words])
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [known.encode_ordinary(w) for w in words]
