"""WARC archives with a Zstandard dictionary: writer and reader.

Each archive holds at most ``ARCHIVE_BYTES`` of records. Its dictionary is built from its own records, embedded in a
leading skippable frame, and every record is compressed as a frame of its own. Of records with equal payloads of at
least ``least`` bytes, that with the smallest page_id is a response, and the others revisit it.

A revisit has no payload; the HTTP headers of its block keep the full payload's length, and the record's digest is
that of the full payload. Files are named anew by each attempt of a task, and only those in the written manifest
count, so lost executors and repeated tasks leave no wrong file in the result.

Defined cases: a null html is an empty payload; a null url has no target URI; line ends in urls are percent-encoded.
Rows with equal page_id and payload as the response are responses too (with one record ID; it is made of the page_id). Null page_ids come after all others: such a row
revisits any row that has an id, and is a response where none has. An empty table gives no archives and no rows. Only
the three named columns are used.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bit_map, bounded_batches, drop_shuffles_early, hot_join, in_map, work_dir, written
from .files import open_out, read_whole

ARCHIVE_BYTES = 24_000_000
DICTIONARY_BYTES = 65_536
#: Bytes of records, evenly spaced over an archive, from which its dictionary is built. Affects sizes only.
TRAINING_BYTES = 4_000_000
SKIPPABLE = 0x184D2A5D
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def plan(pages: DataFrame, least: int = 100, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, html, digest, n_bytes, response (the page_id that a revisit refers to, else null).

    What revisits what is decided on ids and digests alone. A map of the revisits' ids and digests tells of most rows that
    they are none; only the rest is shuffled with its payload, by page_id, of which none holds many rows, so payloads
    don't meet in one task for being equal. That costs one more scan of the pages."""
    c = lambda name: F.col(f"`{name}`")
    rows = pages.select(c(id_col).cast("long").alias("page_id"), c(url_col).alias("url"), F.coalesce(c(html_col), F.lit("")).alias("html"))
    rows = rows.select("*", F.sha2("html", 256).alias("digest"), F.octet_length("html").cast("long").alias("n_bytes"))
    slim = written(rows.where(F.col("n_bytes") >= least).select("page_id", "digest"), "warc-digests")
    firsts = slim.groupBy("digest").agg(F.min("page_id").alias("response"), F.count(F.lit(1)).alias("n")).where("n > 1 AND response IS NOT NULL")
    told = hot_join(slim, firsts, ["digest"], "n", ["response"], slim.count(), F.coalesce(F.col("page_id").cast("string"), F.lit("")))
    revisits = told.where(~F.col("page_id").eqNullSafe(F.col("response")) & F.col("response").isNotNull()).distinct()
    revisits = written(revisits.select(F.col("page_id").alias("id"), F.col("digest").alias("of"), "response"), "warc-revisits")
    keys = written(bit_map(revisits.select(F.xxhash64("id", "of").alias("key")), "key"), "warc-map")
    told, may = in_map(rows, keys, F.xxhash64("page_id", "digest"))
    told = told.select(*rows.columns, F.coalesce(may, F.lit(False)).alias("may"))
    some = told.where("may").join(revisits.hint("merge"), F.col("page_id").eqNullSafe(F.col("id")) & (F.col("digest") == F.col("of")), "left")
    return some.select(*rows.columns, "response").unionByName(told.where("NOT may").select(*rows.columns, F.lit(None).cast("long").alias("response")))


def record(row: dict) -> bytes:
    """One WARC record."""
    payload = row["html"].encode("utf-8")
    revisit = row["response"] is not None
    name = lambda x: f"<urn:x-page:{'' if x is None else x}>"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", name(row["page_id"])), ("WARC-Date", DATE)]
    if row["url"] is not None:
        head.append(("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", row["url"])))
    head.append(("WARC-Payload-Digest", f"sha256:{row['digest']}"))
    if revisit:
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", name(row["response"]))]
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode("utf-8") + b"\r\n" + block + b"\r\n\r\n"


def dictionary(records: list[bytes]) -> bytes:
    """A dictionary from records spread evenly over an archive; their own content where they are too few to train on."""
    step = max(1, sum(map(len, records)) // TRAINING_BYTES)
    samples = records[::step]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=200, d=8).as_bytes()
    except (zstandard.ZstdError, MemoryError):
        return b"".join(samples)[:DICTIONARY_BYTES]


def archive(records: list[bytes]) -> bytes:
    """The bytes of one archive: skippable frame with the dictionary, then each record as a frame."""
    words = dictionary(records)
    press = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(words), write_checksum=True)
    return struct.pack("<II", SKIPPABLE, len(words)) + words + b"".join(map(press.compress, records))


def records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of each record of an archive."""
    magic, size = struct.unpack_from("<II", data)
    if magic != SKIPPABLE:
        raise ValueError("no dictionary frame")
    press = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[8 : 8 + size]))
    with press.stream_reader(io.BytesIO(data[8 + size :]), read_across_frames=True) as raw:
        stream = io.BufferedReader(raw, 1 << 20)
        while stream.readline():
            head = {}
            while (line := stream.readline()) != b"\r\n":
                k, _, v = line.decode("utf-8").rstrip("\r\n").partition(": ")
                head[k] = v
            yield head, stream.read(int(head["Content-Length"]))
            stream.read(4)


def write(planned: DataFrame, folder: str) -> DataFrame:
    """Writes the archives of planned rows; returns their manifest, itself a table in the folder."""
    bounded_batches(planned.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        size = 0

        def flush() -> pa.RecordBatch:
            path = f"{folder}/pages-{uuid.uuid4().hex}.warc.zst"
            data = archive(held)
            with open_out(path) as out:
                out.write(data)
            return pa.RecordBatch.from_pydict({"path": [path], "n_records": [len(held)], "n_bytes": [len(data)]})

        for batch in batches:
            for row in batch.to_pylist():
                held.append(record(row))
                size += len(held[-1])
                if size >= ARCHIVE_BYTES:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    planned.mapInArrow(run, "path string, n_records long, n_bytes long").write.parquet(f"{folder}/manifest")
    return planned.sparkSession.read.parquet(f"{folder}/manifest")


def read(manifest: DataFrame) -> DataFrame:
    """From the archives alone: page_id, url, payload (null for revisits), payload_bytes, payload_digest, record_type, refers_to."""

    def number(name: str | None) -> int | None:
        digits = name[len("<urn:x-page:") : -1] if name else ""
        return int(digits) if digits else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows = []
                for head, block in records(read_whole(path)):
                    http, _, payload = block.partition(b"\r\n\r\n")
                    revisit = head["WARC-Type"] == "revisit"
                    length = int(re.search(rb"Content-Length: (\d+)", http)[1])
                    digest = head["WARC-Payload-Digest"].removeprefix("sha256:")
                    if not revisit and (len(payload) != length or hashlib.sha256(payload).hexdigest() != digest):
                        raise ValueError(f"damaged record {head['WARC-Record-ID']} in {path}")
                    rows.append({"page_id": number(head["WARC-Record-ID"]), "url": head.get("WARC-Target-URI"), "payload": None if revisit else payload, "payload_bytes": length, "payload_digest": digest, "record_type": head["WARC-Type"], "refers_to": number(head.get("WARC-Refers-To"))})
                    if len(rows) == 256:
                        yield pa.RecordBatch.from_pylist(rows, kinds)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, kinds)

    size = manifest.agg(F.count(F.lit(1)).alias("n"), F.sum("n_bytes").alias("b")).first()
    tasks = min(size["n"], max(manifest.sparkSession.sparkContext.defaultParallelism, (size["b"] or 0) // ARCHIVE_BYTES))
    paths = manifest.select("path").repartition(max(1, tasks))
    return paths.mapInArrow(run, "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    drop_shuffles_early(spark)
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    back = read(write(plan(pages), work_dir(spark, "warc")))
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def oracle() -> str:
    """DuckDB SQL for ``query``."""
    return """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT *, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY d) ELSE page_id END AS first FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, d AS payload_digest,
  CASE WHEN page_id IS DISTINCT FROM first AND first IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM f"""
