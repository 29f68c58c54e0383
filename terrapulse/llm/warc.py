"""WARC archives: writing with revisits of equal payloads, and reading by boundary-chain verification.

Writing: payloads are digested in the JVM; of equal payloads the one with the smallest id is the response and the others revisit it.
The text sink writes each record as one row that ends in the record terminator, so files are committed like any other Spark output.

Reading: each archive is scanned by a task that finds every place where a record header parses, with the offset that its
Content-Length makes its successor. A payload may hold such places too; pointer jumping (doubling) from the file's start over these
links tells the records that the chain reaches, and only those are kept. A chain never leaves its file, so the jumps are made in arrays of the task that
has scanned it, and nothing is shuffled. A chain that breaks off (a truncated or damaged file) raises, unless ``strict`` is off, which keeps the
records before the break.

Null payloads count as empty; null urls are written as an empty target. Null ids are written as empty and come back as null; they're never
revisited. Each of repeated rows becomes a record; repeated rows of the smallest id are all responses. An empty table gives an empty archive. A file is read
whole by one task, as gzip streams can't be split, so ``rows_a_file`` bounds what a task holds; payloads of any length are written and read whole.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrapulse.llm.common import materialize, remove, scratch

MAGIC, END, CRLF = b"WARC/1.1\r\n", b"\r\n\r\n", "\r\n"
#: Payload rows a file, so that an archive stays small enough to be read whole by one task.
FILE_ROWS = 1024
#: Compressed bytes that are handed to a gzip member at once.
CHUNK = 1 << 16
HEADER = re.compile(rb"WARC/1\.[01]\r\n((?:[A-Za-z-]+: ?[^\r\n]*\r\n)+)\r\n")


def base32_sha1(data: Column) -> Column:
    """Bare upper-case base32 of the SHA-1, inside codegen: 40 bits at a time to eight digits."""
    digest = F.sha1(data)
    digits = [F.lpad(F.conv(F.substring(digest, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*digits), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def typed(pages: DataFrame, id_col: str, payload_col: str, url_col: str | None, least_bytes: int = 0) -> DataFrame:
    """id, url, payload, bytes, digest, refers_to (null: a response) for each row."""
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    url = F.lit("") if url_col is None else F.coalesce(F.regexp_replace(F.col(url_col).cast("string"), r"[\r\n]", ""), F.lit(""))
    one = pages.select(F.col(id_col).cast("long").alias("id"), url.alias("url"), payload.alias("payload"))
    one = one.withColumn("bytes", F.octet_length("payload").cast("long")).withColumn("digest", base32_sha1(F.col("payload")))
    keys = one.where(F.col("bytes") >= least_bytes).groupBy("digest", "bytes").agg(F.min("id").alias("first"), F.count("*").alias("times"))
    # Only what several rows share is written; the join then has exchanges on both sides, so that a payload which many rows share is split.
    keys = materialize(pages.sparkSession, keys.where("times > 1 and first is not null").drop("times"), "warc-keys")
    return one.join(keys, ["digest", "bytes"], "left").select("id", "url", "payload", "bytes", "digest", F.col("first").alias("refers_to"))


def write(pages: DataFrame, path: str, id_col: str = "page_id", payload_col: str = "html", url_col: str | None = "url", least_bytes: int = 0, compression: str = "gzip", rows_a_file: int = FILE_ROWS) -> None:
    """Write one record for each row of ``pages`` to archives under ``path``."""
    rows = typed(pages, id_col, payload_col, url_col, least_bytes)
    rows = rows.withColumn("revisit", F.col("refers_to").isNotNull() & (F.col("id").isNull() | (F.col("id") != F.col("refers_to"))))
    body = F.when(F.col("revisit"), "").otherwise(F.col("payload"))
    head = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(F.col("revisit"), "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: <urn:page:"), F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(">")),
        F.concat(F.lit("WARC-Target-URI: "), F.col("url")),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")),
        F.concat(F.lit("WARC-Payload-Length: "), F.col("bytes").cast("string")),
        F.when(F.col("revisit"), F.concat(F.lit("WARC-Refers-To: <urn:page:"), F.col("refers_to").cast("string"), F.lit(">"))),
        F.concat(F.lit("Content-Length: "), F.octet_length(body).cast("string")),
    ]
    record = F.concat(F.concat_ws(CRLF, *head), F.lit(END.decode()), body)
    out = rows.select(record.alias("value"))
    out.write.option("lineSep", END.decode()).option("compression", compression).option("maxRecordsPerFile", rows_a_file).text(path)


def inflate(data: memoryview) -> bytes:
    """All gzip members of ``data``, one after another; zeros may pad the end."""
    out, at = [], 0
    while at < len(data):
        member = zlib.decompressobj(47)
        while not member.eof:
            if at >= len(data):
                raise zlib.error("incomplete or truncated stream")
            part = data[at : at + CHUNK]
            out.append(member.decompress(part))
            at += len(part) - len(member.unused_data)
        out.append(member.flush())
        if at < len(data) and data[at] == 0 and not bytes(data[at:]).strip(b"\0"):
            break
    return b"".join(out)


def candidates(content: bytes) -> Iterator[tuple[int, int, bytes, int, int]]:
    """Offset, successor, header block, payload start and end of every place where a record header parses."""
    for m in HEADER.finditer(content):
        length = re.search(rb"(?im)^Content-Length: ?(\d{1,18})\r?$", m[1])
        if length:
            end = m.end() + int(length[1])
            yield m.start(), end + len(END), m[1], m.end(), end


LINK = T.StructType([T.StructField(n, t) for n, t in (("file", T.StringType()), ("at", T.LongType()), ("next", T.LongType()), ("size", T.LongType()), ("id", T.LongType()), ("url", T.StringType()), ("bytes", T.LongType()), ("digest", T.StringType()), ("record_type", T.StringType()), ("refers_to", T.LongType()), ("sound", T.BooleanType()), ("reached", T.BooleanType()))])


def links(spark: SparkSession, path: str, pattern: str = "part-*") -> DataFrame:
    """One row for each candidate record of the archives under ``path`` whose names match ``pattern``, and whether its file's chain reaches it."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "content")

    def number(header: dict, key: bytes) -> int | None:
        return int(m[1]) if (m := re.search(rb"(\d+)>?$", header.get(key, b""))) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, content in zip(b["path"], b["content"]):
                view = content.as_buffer()
                data = inflate(memoryview(view)) if bytes(memoryview(view)[:2]) == b"\x1f\x8b" else view.to_pybytes()
                rows = []
                for at, after, head, start, end in candidates(data):
                    h = dict(re.findall(rb"([A-Za-z-]+): ?([^\r\n]*)\r\n", head))
                    kind = h.get(b"WARC-Type", b"").decode("utf-8", "replace")
                    payload = memoryview(data)[start:end]
                    said = h.get(b"WARC-Payload-Digest", b"").decode("ascii", "replace").removeprefix("sha1:")
                    sound = end + len(END) <= len(data) and data[end : end + len(END)] == END
                    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode() if kind == "response" and sound else said
                    size = len(payload) if kind == "response" else number(h, b"WARC-Payload-Length")
                    rows.append((file.as_py(), at, after, len(data), number(h, b"WARC-Record-ID"), h.get(b"WARC-Target-URI", b"").decode("utf-8", "replace"), size, digest, kind, number(h, b"WARC-Refers-To"), sound and digest == said))
                if data and not rows:  # so that a file without any record is seen to be damaged
                    rows.append((file.as_py(), -1, -1, len(data), None, None, None, None, None, None, False))
                columns = list(zip(*rows)) or [[]] * (len(LINK) - 1)
                columns.append(reachable(np.array(columns[1], np.int64), np.array(columns[2], np.int64)))
                kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.bool_(), pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], LINK.names)

    return files.mapInArrow(run, LINK)


def reachable(at: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Which of the places ``at``, in order, the chain of successors from offset 0 reaches, by pointer jumping.

    Round r knows the successor 2 ** r records on; what is reached doubles every round. A successor that is no place ends the chain.
    """
    n = len(at)
    jump = np.append(np.searchsorted(at, after), n)
    jump[:-1][at[np.minimum(jump[:-1], max(n - 1, 0))] != after] = n
    reached = np.append(at == 0, False)
    while True:
        more = reached.copy()
        more[jump[reached]] = True
        if (more == reached).all():
            return reached[:-1]
        reached, jump = more, jump[jump]


def read(spark: SparkSession, path: str, strict: bool = True, pattern: str = "part-*") -> DataFrame:
    """id, url, bytes, digest, record_type, refers_to of every record in the archives under ``path`` whose names match ``pattern``."""
    nodes = materialize(spark, links(spark, path, pattern), "warc-links")
    kept = nodes.where("reached")
    if strict:
        ends = nodes.groupBy("file").agg(F.max(F.when(F.col("reached"), F.col("next"))).alias("end"), F.max("size").alias("size"), F.min(~F.col("reached") | F.col("sound")).alias("sound"))
        bad = ends.where("end is null or end <> size or not sound").limit(1).collect()
        if bad:
            raise ValueError(f"a chain of records breaks off in {bad[0]['file']}")
    else:
        kept = kept.where("sound")
    return kept.select("id", "url", "bytes", "digest", "record_type", "refers_to")


def round_trip(pages: DataFrame) -> DataFrame:
    """The contract's columns: write an archive of ``pages``, then read it back."""
    spark = pages.sparkSession
    path = scratch(spark, "warc")
    write(pages, path)
    out = read(spark, path)
    remove(spark, path)  # what was read of it has been written
    return out.select(F.col("id").alias("page_id"), F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", "refers_to")


ORACLE = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages
), d AS (
  SELECT page_id, payload_bytes::BIGINT AS payload_bytes, h,
    array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      (((('0x' || substr(h, (10 * (i // 8) + 1)::INT, 10))::BIGINT) >> (35 - 5 * (i % 8))::INT) & 31)::INT + 1, 1) FOR i IN range(32)], '') AS payload_digest
  FROM p
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN page_id = min(page_id) OVER (PARTITION BY h, payload_bytes) THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = min(page_id) OVER (PARTITION BY h, payload_bytes) THEN NULL ELSE min(page_id) OVER (PARTITION BY h, payload_bytes) END AS refers_to
FROM d
"""
