"""WARC archives: written with one record a page, read back by boundary-chain verification.

Writing: among pages of equal payloads of at least ``min_revisit`` bytes, the largest page id is a response record and
the others are revisit records that refer to it. The groups are found on (id, digest) alone, and dealt to ``SALTS`` parts
of each digest; payloads move once, by page id. So a payload that very many pages share makes no large partition. Records
are strings, written by Spark's text writer with CRLF ends, compressed by gzip: any file system will do, and a lost task is
written again. Pages are written by classes of size, each with as many records a file as fit ``file_bytes``; a page beyond
that has a file of its own. Offsets are those of the uncompressed archive.

Reading: tasks search each file for the magic line and take every hit as a candidate record; they emit its offset, the
offset of its successor (after header, block and the two closing line ends) and what the header and block say. Per file,
pointer jumping from offset 0 over these links marks the candidates that can be reached; the others lie inside payloads
and go. A chain that does not end at the file's end is an error.

Defined results: a null or empty payload is an empty block; repeated rows give a record each, and all rows of the largest
page id are responses; rows with a null id are always responses. Control characters in an URL are written as %20. An
empty table gives no records. Columns other than those named are not read.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spelunka.llm.common import durable, ensure_checkpoint_dir

MAGIC = b"WARC/1.1\r\n"
MIN_REVISIT = 1000
FILE_BYTES = 64 << 20
SALTS = 32
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


class WarcError(ValueError):
    """A file whose records don't chain from its start to its end, or name pages by what is no id."""


def _rows(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    html = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url"), html.alias("html"))
    return rows.withColumn("n", F.octet_length("html"))


def revisits(rows: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """id, digest and refers_to of those rows (id, html, n) whose payload a larger page has too."""
    narrow = rows.where((F.col("n") >= min_revisit) & F.col("id").isNotNull()).select("id", F.sha1(F.col("html").cast("binary")).alias("digest"))
    groups = narrow.groupBy("digest").agg(F.max("id").alias("refers_to"), F.min("id").alias("least")).where("least < refers_to").drop("least")
    groups = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return narrow.withColumn("salt", F.pmod(F.hash("id"), F.lit(SALTS))).join(groups, ["digest", "salt"]).where("id < refers_to").select("id", "digest", "refers_to").distinct()


def records(rows: DataFrame, again: DataFrame) -> DataFrame:
    """One column, record: the whole record of each row (id, url, html, n), without its last line end. again: from revisits()."""
    rows = rows.withColumn("digest", F.sha1(F.col("html").cast("binary")))
    both = rows.alias("r").join(again.alias("v"), (F.col("r.id") == F.col("v.id")) & (F.col("r.digest") == F.col("v.digest")), "left").select("r.*", "v.refers_to")
    uri = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    revisit = F.col("refers_to").isNotNull()
    return both.select(
        F.concat(
            F.lit("WARC/1.1\r\nWARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
            F.lit("\r\nWARC-Record-ID: "), uri(F.col("id")),
            F.lit("\r\nWARC-Date: 2024-01-01T00:00:00Z\r\nWARC-Target-URI: "), F.regexp_replace("url", r"[\x00-\x20\x7f]", "%20"),
            F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("digest"),
            F.lit("\r\nX-Payload-Length: "), F.col("n").cast("string"),
            F.when(revisit, F.concat(F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: "), uri(F.col("refers_to")))).otherwise(""),
            F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "),
            (F.lit(len(HTTP)) + F.when(revisit, 0).otherwise(F.col("n"))).cast("string"),
            F.lit("\r\n\r\n" + HTTP), F.when(revisit, "").otherwise(F.col("html")), F.lit("\r\n"),
        ).alias("record")
    )


def size_classes(largest: int, file_bytes: int = FILE_BYTES) -> list[tuple[int, int, int]]:
    """(from, to, records a file) of payload sizes, up to the largest: records of a class fit file_bytes together, or are alone."""
    out, low = [], 0
    for per_file in (2048, 128, 8, 1):
        high = file_bytes // per_file if per_file > 1 else largest + 1
        out.append((low, high, per_file))
        low = high
    return [c for c in out if c[0] <= largest]


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_revisit: int = MIN_REVISIT, file_bytes: int = FILE_BYTES) -> None:
    rows = _rows(pages, id_col, url_col, html_col)
    classes = size_classes(rows.agg(F.max("n")).first()[0] or 0, file_bytes)
    again = revisits(rows, min_revisit)
    if len(classes) > 1:
        again = durable(again)
    for low, high, per_file in classes:
        some = rows if len(classes) == 1 else rows.where((F.col("n") >= low) & (F.col("n") < high))
        records(some, again).write.mode("append").option("lineSep", "\r\n").option("maxRecordsPerFile", per_file).option("compression", "gzip").text(folder)


def _field(head: bytes, name: bytes) -> bytes | None:
    m = re.search(rb"(?im)^" + name + rb":[ \t]*([^\r\n]*)", head)
    return m and m[1].strip()


def _number(value: bytes | None) -> int | None:
    """A 64-bit number, bare or as a page's URI."""
    m = value and re.fullmatch(rb"(?:<urn:page:)?(-?\d{1,19})>?", value)
    return n if m and -(1 << 63) <= (n := int(m[1])) < 1 << 63 else None


def _named(value: bytes | None) -> bool:
    """Whether that is a page's id, or the null one."""
    return value == b"<urn:page:null>" or _number(value) is not None


def candidates(content: bytes) -> list[dict]:
    """Every place of the magic line, taken as a record: its offset, its successor (-1: no whole record) and its fields."""
    out, at, size = [], content.find(MAGIC), len(content)
    while at >= 0:
        row = {"at": at, "next": -1}
        end = content.find(b"\r\n\r\n", at)
        head = content[at:end] if end >= 0 else b""
        length = _field(head, b"Content-Length") if head else None
        if length and length.isdigit():
            block, stop = end + 4, end + 4 + int(length)
            if stop + 4 <= size and content[stop : stop + 4] == b"\r\n\r\n":
                row["next"] = stop + 4
                body = content.find(b"\r\n\r\n", block, stop)
                payload = content[body + 4 : stop] if body >= 0 else content[block:stop]
                kind = (_field(head, b"WARC-Type") or b"").decode("utf-8", "replace")
                said = (_field(head, b"WARC-Payload-Digest") or b"").decode("utf-8", "replace").removeprefix("sha1:")
                own = hashlib.sha1(payload).hexdigest()
                revisit = kind == "revisit"
                row |= {
                    "id": _number(_field(head, b"WARC-Record-ID")), "kind": kind, "digest": said if revisit else own, "sound": revisit or said == own,
                    "payload_bytes": _number(_field(head, b"X-Payload-Length")) if revisit else len(payload),
                    "refers_to": _number(_field(head, b"WARC-Refers-To")) if revisit else None,
                    "named": _named(_field(head, b"WARC-Record-ID")) and (not revisit or _number(_field(head, b"WARC-Refers-To")) is not None),
                    "url": (_field(head, b"WARC-Target-URI") or b"").decode("utf-8", "replace"),
                }
        out.append(row)
        at = content.find(MAGIC, at + 1)
    return out


#: named is for the candidates alone: whether the page ids parse.
FIELDS = [("path", pa.string()), ("size", pa.int64()), ("at", pa.int64()), ("next", pa.int64()), ("id", pa.int64()), ("kind", pa.string()), ("digest", pa.string()), ("sound", pa.bool_()), ("payload_bytes", pa.int64()), ("refers_to", pa.int64()), ("url", pa.string()), ("named", pa.bool_())]
SCHEMA = "path string, size long, at long, next long, id long, kind string, digest string, sound boolean, payload_bytes long, refers_to long, url string"


def unpacked(content: bytes) -> bytes:
    """The archive in a file: gzip, in one member or many, or plain."""
    return gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content


def _scan(batches):
    for batch in batches:
        for i in range(batch.num_rows):
            path, content = batch.column(0)[i].as_py(), unpacked(batch.column(1)[i].as_py())
            found = [r | {"path": path, "size": len(content)} for r in candidates(content)]
            if content and (not found or found[0]["at"] != 0):
                found.insert(0, {"path": path, "size": len(content), "at": 0, "next": -1})
            for start in range(0, len(found), 4096):
                part = found[start : start + 4096]
                yield pa.RecordBatch.from_arrays([pa.array([r.get(name) for r in part], kind) for name, kind in FIELDS], [name for name, _ in FIELDS])


def reachable(at: np.ndarray, nxt: np.ndarray, size: int) -> np.ndarray:
    """Which offsets (sorted, the first 0) the chain from 0 reaches: pointer jumping, doubling the jump each round."""
    n = len(at)
    to = np.searchsorted(at, nxt)  # n stands for the file's end, n + 1 for a broken link
    to = np.where(nxt == size, n, np.where((nxt >= 0) & (to < n) & (at[np.minimum(to, n - 1)] == nxt), to, n + 1))
    to = np.r_[to, n, n + 1]
    seen = np.zeros(n + 2, bool)
    seen[0] = True
    jump = to
    while True:
        before = seen.sum()
        seen[jump[seen]] = True
        jump = jump[jump]
        if seen.sum() == before:
            break
    if seen[n + 1] or not seen[n]:
        raise WarcError("the records don't chain from the file's start to its end")
    return seen[:n]


def _chain(table: pa.Table) -> pa.Table:
    """The reachable records of a file. Arrow throughout: pandas would turn ids beside nulls into doubles."""
    table = table.sort_by("at")
    path = table.column("path")[0].as_py()
    try:
        seen = reachable(table.column("at").to_numpy(), table.column("next").to_numpy(), table.column("size")[0].as_py())
    except WarcError as e:
        raise WarcError(f"{path}: {e}") from None
    table = table.filter(pa.array(seen))
    if not all(table.column("named").to_pylist()):
        at = table.column("at")[table.column("named").to_pylist().index(False)]
        raise WarcError(f"{path}: the record at {at} has no valid page id")
    return table.drop_columns(["named"])


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """The true records of all files in folder, one row each: path, size (of the file), at, next, id, kind, digest, sound (the payload has the digest that the header names), payload_bytes, refers_to, url."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).select("path", "content")
    return files.mapInArrow(_scan, SCHEMA + ", named boolean").groupBy("path").applyInArrow(_chain, SCHEMA)


def remove_folder(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def archived(pages: DataFrame, **columns) -> DataFrame:
    """pages, written to archives in the shared folder and read back; the archives are removed once their records' fields are safe."""
    spark = pages.sparkSession
    folder = f"{ensure_checkpoint_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(pages, folder, **columns)
    found = durable(read_archives(spark, folder))
    remove_folder(spark, folder)
    return found


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of pages, through an archive and back."""
    found = archived(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    whole = F.when(F.col("sound"), F.col("digest")).otherwise(F.raise_error(F.concat(F.lit("damaged payload in "), F.col("path"))).cast("string"))
    return found.select(F.col("id").alias("page_id"), "payload_bytes", whole.alias("payload_digest"), F.col("kind").alias("record_type"), "refers_to")


#: The same in DuckDB.
ORACLE = """WITH p AS (SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS last FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, sha1(html) AS payload_digest, CASE WHEN n >= 1000 AND page_id < last THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN n >= 1000 AND page_id < last THEN last END AS refers_to FROM m"""
