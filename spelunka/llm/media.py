"""Media columns: binary columns of PNG images, read back with checksum tests, and cosine-transform hashes.

A payload is stored as an 8-bit grey PNG: signature, IHDR, IDAT chunks of one zlib stream, IEND. Each chunk carries a
CRC-32 that the reader tests; the zlib stream carries an Adler-32 that zlib tests. Rows are filtered before compression
and unfiltered with numpy after it. The feature is the sign pattern of the low frequencies of a two-dimensional cosine
transform of the image, shrunk to 32 x 32.

Defined results: a null or empty text is one row of 64 zero bytes; texts of any length are stored whole; equal texts
give equal stored bytes and features; rows with null ids keep a null id; an empty table gives no rows. Input columns
other than the two named are not read, so clashing names do no harm.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spelunka.llm.common import column, documents, slices

# Fixed values of the PNG format.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
WIDTH = 64
CHUNK = 1 << 16
NONE, SUB, UP, AVERAGE, PAETH = range(5)


class MediaError(ValueError):
    """Stored bytes that are no whole, undamaged image."""


def pad(data: bytes, multiple: int = WIDTH) -> bytes:
    """data with zero bytes appended up to a positive multiple."""
    return data + bytes(-len(data) % multiple if data else multiple)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))


def encode_png(payload: bytes, width: int = WIDTH, level: int = 1) -> bytes:
    """An 8-bit grey PNG whose samples are payload, a positive multiple of width bytes.

    One filter (none, sub or up) serves the whole image: the one with the least sum of absolute differences over at
    most 64 evenly spaced rows; ties go to the simpler one. The choice affects only size, never the samples.
    """
    rows = np.frombuffer(payload, np.uint8).reshape(-1, width)
    probe = np.unique(np.linspace(0, len(rows) - 1, 64).astype(np.int64))
    here, above = rows[probe], np.where(probe[:, None] > 0, rows[probe - 1], 0).astype(np.uint8)
    left = np.zeros_like(here)
    left[:, 1:] = here[:, :-1]
    cost = [int(np.abs((here - x).view(np.int8).astype(np.int64)).sum()) for x in (np.uint8(0), left, above)]
    kind = cost.index(min(cost))
    out = np.empty((len(rows), width + 1), np.uint8)
    out[:, 0] = kind
    out[:, 1:] = rows
    if kind == SUB:
        out[:, 2:] -= rows[:, :-1]
    elif kind == UP:
        out[1:, 1:] -= rows[:-1]
    stream = zlib.compress(out.tobytes(), level)
    return b"".join(
        [SIGNATURE, _chunk(b"IHDR", struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0))]
        + [_chunk(b"IDAT", stream[i : i + CHUNK]) for i in range(0, len(stream), CHUNK)]
        + [_chunk(b"IEND", b"")]
    )


def chunks(data: bytes):
    """(kind, content) of each chunk; MediaError where a length or checksum is wrong."""
    if data[:8] != SIGNATURE:
        raise MediaError("no PNG signature")
    at = 8
    while at < len(data):
        if at + 12 > len(data):
            raise MediaError("cut off chunk")
        (n,) = struct.unpack_from(">I", data, at)
        if at + 12 + n > len(data):
            raise MediaError("cut off chunk")
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + n]
        if zlib.crc32(body, zlib.crc32(kind)) != struct.unpack_from(">I", data, at + 8 + n)[0]:
            raise MediaError(f"wrong checksum of {kind!r}")
        yield kind, body
        at += 12 + n
        if kind == b"IEND":
            return
    raise MediaError("no end chunk")


def unfilter(kinds: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Undo PNG's row filters for one byte a pixel: runs of rows of one kind are undone together."""
    h, w = rows.shape
    out = np.empty_like(rows)
    edges = np.flatnonzero(np.diff(kinds)) + 1
    for a, b in zip(np.r_[0, edges], np.r_[edges, h]):
        kind, prior = kinds[a], out[a - 1] if a else np.zeros(w, np.uint8)
        if kind == NONE:
            out[a:b] = rows[a:b]
        elif kind == SUB:
            np.add.accumulate(rows[a:b], axis=1, dtype=np.uint8, out=out[a:b])
        elif kind == UP:
            np.add.accumulate(rows[a:b], axis=0, dtype=np.uint8, out=out[a:b])
            out[a:b] += prior
        elif kind in (AVERAGE, PAETH):
            for y in range(a, b):
                up = out[y - 1].tolist() if y else [0] * w
                left = corner = 0
                line = []
                for x, v in enumerate(rows[y].tolist()):
                    if kind == AVERAGE:
                        guess = (left + up[x]) >> 1
                    else:
                        p = left + up[x] - corner
                        near = (abs(p - left), abs(p - up[x]), abs(p - corner))
                        guess = left if near[0] <= near[1] and near[0] <= near[2] else up[x] if near[1] <= near[2] else corner
                    left, corner = (v + guess) & 255, up[x]
                    line.append(left)
                out[y] = line
        else:
            raise MediaError(f"unknown filter {kind}")
    return out


def decode_png(data: bytes) -> np.ndarray:
    """The samples (height, width) of an 8-bit grey PNG; every checksum is tested."""
    header, parts = None, []
    for kind, body in chunks(data):
        if kind == b"IHDR":
            header = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            parts.append(body)
        elif kind != b"IEND" and not kind[0] & 32:
            raise MediaError(f"unknown critical chunk {kind!r}")
    if header is None or header[2:] != (8, 0, 0, 0, 0) or 0 in header[:2]:
        raise MediaError("not an 8-bit grey image without interlace")
    width, height = header[:2]
    inflate = zlib.decompressobj()
    try:
        raw = inflate.decompress(b"".join(parts), height * (width + 1) + 1)
    except zlib.error as e:
        raise MediaError(str(e)) from e
    if len(raw) != height * (width + 1) or not inflate.eof:
        raise MediaError("wrong amount of image data")
    both = np.frombuffer(raw, np.uint8).reshape(height, width + 1)
    return unfilter(both[:, 0], both[:, 1:])


def _shrunk(pixels: np.ndarray, size: int) -> np.ndarray:
    """Box averages of the rows: (size, width), with fractional borders."""
    h = len(pixels)
    total = np.zeros((h + 1, pixels.shape[1]))
    np.cumsum(pixels, axis=0, dtype=np.float64, out=total[1:])
    at = np.arange(size + 1) * (h / size)
    low = np.minimum(at.astype(np.int64), h - 1)
    return np.diff(total[low] + (at - low)[:, None] * (total[low + 1] - total[low]), axis=0) * (size / h)


_SMALL, _LOW = 32, 8
_COSINES = np.cos(np.pi / _SMALL * (np.arange(_SMALL) + 0.5)[None, :] * np.arange(_LOW)[:, None])


def cosine_hash(pixels: np.ndarray) -> bytes:
    """Eight bytes: which of the 8 x 8 lowest frequencies of the image, shrunk to 32 x 32, exceed their median."""
    small = _shrunk(_shrunk(pixels, _SMALL).T, _SMALL).T
    low = np.round(_COSINES @ small @ _COSINES.T, 6).ravel()
    return np.packbits(low > np.median(low)).tobytes()


def _store(batches):
    for batch in slices(batches):
        sizes, media = [], []
        for text in column(batch, "text").to_pylist():
            data = (text or "").encode()
            sizes.append(len(data))
            media.append(encode_png(pad(data)))
        yield pa.RecordBatch.from_arrays([column(batch, "id"), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], ["id", "n_bytes", "media"])


def store_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes (unpadded) and media, the PNG of each whole text in UTF-8."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_store, "id long, n_bytes long, media binary")


def _features(batches):
    for batch in slices(batches, "media"):
        digests, sizes, tails, hashes = [], [], [], []
        for data in column(batch, "media").to_pylist():
            pixels = decode_png(data)
            payload = pixels.tobytes()
            sizes.append(len(payload))
            digests.append(hashlib.sha256(payload).hexdigest())
            tails.append(zlib.crc32(payload[-64:]))
            hashes.append(cosine_hash(pixels))
        arrays = [column(batch, "id"), column(batch, "n_bytes"), pa.array(sizes, pa.int64()), pa.array(digests), pa.array(tails, pa.int64()), column(batch, "media_bytes"), column(batch, "media_sha256"), pa.array(hashes, pa.binary())]
        yield pa.RecordBatch.from_arrays(arrays, ["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "hash"])


def media_features(stored: DataFrame) -> DataFrame:
    """Reads each media value of store_texts back; checksums of the samples, and the hash as a binary column."""
    rows = stored.withColumns({"media_bytes": F.octet_length("media").cast("long"), "media_sha256": F.sha2("media", 256)})
    return rows.mapInArrow(_features, "id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, hash binary")


def op1_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of documents, stored as PNG and read back."""
    found = media_features(store_texts(documents(spark, sf_dir)))
    return found.select(F.col("id").alias("doc_id"), "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", F.concat(F.lit("dct"), F.lower(F.hex("hash"))).alias("feature"))
