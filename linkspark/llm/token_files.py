"""Token-id files: ids of all documents in ascending doc_id order, canonical Huffman coded from global counts.

``write`` encodes documents with the tokenizers library, ends each with an id, and writes files of about ``FILE_IDS`` ids;
``read`` reads them back. The ids are encoded once, kept packed in the shared folder while all of them are
counted, and then coded with the one code that the global counts give.

A file: magic, header length, header (JSON), code lengths by id (zlib), doc_ids and their token counts (int64), a
flag for null doc_ids, the bit offset of every block of ids (the checkpoints), and the bit stream. Each file can be
decoded by itself, and each of its blocks too.

Files are written under names of their own for every attempt of a task, and only those in the written manifest count,
so a lost executor or a repeated task leaves no wrong file in the result.

Defined cases: a null or empty text has the end id alone; documents with a null doc_id come first; rows with equal
doc_ids are all kept, ordered by a hash of their text, and equal rows as they come. The strings of added tokens in a
text become those tokens, as in the library. An empty table gives no files and no rows. Only the two named columns are
used. Texts are used whole.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import huffman
from .common import bounded_batches, delete_dir, drop_shuffles_early, work_dir
from .files import open_out, read_whole
from .pieces import Encoder

MAGIC = b"LSTOK1\n"


#: Ids in one slice of the counts that a task gives, and about how many are in one file. A file is held whole by the
#: task that codes or reads it; a longer document has one of its own.
SLICE, FILE_IDS = 4096, 1 << 23
_MADE = ["path", "part", "seq", "n_docs", "n_ids", "slice", "counts"]


def _byte_characters() -> dict[int, str]:
    """The character that byte-level vocabularies write for each byte: itself if printable, else one from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


@lru_cache(maxsize=2)
def encoder(path: str):
    """From an array of texts to the packed ids of each, as the library encodes them without special tokens around.

    Where the file's pre-tokenizer is byte-level with the usual pattern, distinct pieces go straight to the library's
    model; texts with the string of an added token, which the library takes out first, and all texts of other files go
    through the library whole."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    layout = json.loads(tokenizer.to_str())
    before = layout["pre_tokenizer"] or {}

    def whole(texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    if layout["normalizer"] is not None or before.get("type") != "ByteLevel" or not before.get("use_regex") or before.get("add_prefix_space"):
        return lambda texts: pa.array([whole([t])[0] if t else b"" for t in texts.to_pylist()], pa.binary())
    model, characters = tokenizer.model, _byte_characters()

    def encode(new: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        made = [model.tokenize(p.decode("latin-1").translate(characters)) for p in new]
        sizes = np.fromiter(map(len, made), np.int64, len(made))
        return np.fromiter((t.id for one in made for t in one), "<u4", int(sizes.sum())), sizes

    by_pieces = Encoder(encode)
    added = [t.content for t in tokenizer.get_added_tokens_decoder().values()]

    def run(texts: pa.Array) -> pa.Array:
        has = np.zeros(len(texts), bool)
        for a in added:
            has |= pc.match_substring(texts.fill_null(""), a).to_numpy(zero_copy_only=False)
        if not has.any():
            return by_pieces.texts(texts)
        out = by_pieces.texts(pc.if_else(pa.array(has), "", texts)).to_pylist()
        for i in np.flatnonzero(has).tolist():
            out[i] = whole([texts[i].as_py()])[0]
        return pa.array(out, pa.binary())

    return run


def _encode_task(folder: str, tokenizer: str, end_id: int, file_ids: int):
    """Writes the packed ids of a partition's documents, about ``file_ids`` to a file; a row for each file (path, part, seq,
    n_docs, n_ids) and for each slice of the partition's counts by id (slice, counts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, end = TaskContext.get().partitionId(), np.array([end_id], "<u4")
        counts, press, out, files = np.zeros(1 << 16, np.int64), zstandard.ZstdCompressor(level=1), None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                files.append([f"{folder}/ids-{part:06d}-{len(files):06d}-{uuid.uuid4().hex}", len(files), 0, 0])
                out = open_out(files[-1][0])
            packed = encoder(tokenizer)(batch.column(1))
            ends = np.frombuffer(packed.buffers()[1], np.int32)[packed.offset : packed.offset + len(packed) + 1].astype(np.int64) // 4
            held = packed.buffers()[2]
            ids = np.frombuffer(held, "<u4")[ends[0] : ends[-1]] if held and held.size else np.zeros(0, "<u4")
            ids = np.insert(ids, ends[1:] - ends[0], end)
            seen = np.bincount(ids)
            if len(seen) > len(counts):
                counts = np.pad(counts, (0, len(seen) - len(counts)))
            counts[: len(seen)] += seen
            small = ids.astype("<u2") if len(seen) <= 1 << 16 else ids
            frame = press.compress(small.tobytes())
            head = json.dumps({"docs": batch.column(0).to_pylist(), "lengths": (np.diff(ends) + 1).tolist(), "bytes": small.itemsize, "size": len(frame)}).encode()
            out.write(struct.pack("<I", len(head)) + head + frame)
            files[-1][2] += batch.num_rows
            files[-1][3] += len(ids)
            if files[-1][3] >= file_ids:
                out.close()
                out = None
        if out:
            out.close()
        if files:
            counts = np.pad(counts, (0, -len(counts) % SLICE)).reshape(-1, SLICE)
            used = np.flatnonzero(counts.any(axis=1))
            path, seq, docs, ids = zip(*files, strict=True)
            gone = lambda n, kind: pa.nulls(n, kind)
            yield pa.RecordBatch.from_arrays([pa.array(path), pa.array([part] * len(files), pa.int32()), pa.array(seq, pa.int32()), pa.array(docs, pa.int64()), pa.array(ids, pa.int64()), gone(len(files), pa.int64()), gone(len(files), pa.binary())], names=_MADE)
            m = len(used)
            yield pa.RecordBatch.from_arrays([gone(m, pa.string()), gone(m, pa.int32()), gone(m, pa.int32()), gone(m, pa.int64()), gone(m, pa.int64()), pa.array(used, pa.int64()), pa.array([c.tobytes() for c in counts[used]], pa.binary())], names=_MADE)

    return run


def _packed(data: bytes) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """Doc_ids, token counts and ids of each batch that ``_encode_task`` wrote."""
    at, press = 0, zstandard.ZstdDecompressor()
    while at < len(data):
        (n,) = struct.unpack_from("<I", data, at)
        head = json.loads(data[at + 4 : at + 4 + n])
        at += 4 + n
        ids = np.frombuffer(press.decompress(data[at : at + head["size"]]), f"<u{head['bytes']}")
        at += head["size"]
        yield head["docs"], np.array(head["lengths"], np.int64), ids


def _code_task(folder: str, lengths: np.ndarray):
    """Codes the files that ``_encode_task`` wrote; a row for each: path, part, start, n_docs, n_ids, n_bytes."""
    table = zlib.compress(lengths.tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = huffman.canonical(lengths)
        for batch in batches:
            for row in batch.to_pylist():
                docs, counts, ids = [], [], []
                for d, c, i in _packed(read_whole(row["path"])):
                    docs += d
                    counts.append(c)
                    ids.append(i.astype(np.uint16 if i.itemsize == 2 else np.uint32))
                stream, points = huffman.encode(np.concatenate(ids), lengths, codes)
                arrays = [np.array([d or 0 for d in docs], "<i8"), np.concatenate(counts).astype("<i8"), np.array([d is None for d in docs], np.uint8), points.astype("<u8")]
                head = json.dumps({"start": row["start"], "n_docs": row["n_docs"], "n_ids": row["n_ids"], "block": huffman.BLOCK, "table": len(table), "stream": len(stream)}).encode()
                path = f"{folder}/tokens-{row['part']:06d}-{uuid.uuid4().hex}.lstok"
                with open_out(path) as out:
                    for piece in (MAGIC, struct.pack("<I", len(head)), head, table, *[a.tobytes() for a in arrays], stream):
                        out.write(piece)
                yield pa.RecordBatch.from_pydict({"path": [path], "part": pa.array([row["part"]], pa.int32()), "start": [row["start"]], "n_docs": [row["n_docs"]], "n_ids": [row["n_ids"]], "n_bytes": [len(stream)]})

    return run


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", file_ids: int = FILE_IDS) -> DataFrame:
    """Writes the files and returns their manifest, itself a table in the folder."""
    spark = docs.sparkSession
    bounded_batches(spark)
    drop_shuffles_early(spark)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # A null or repeated doc_id may hold many rows: its rows are dealt out by the hash of their text, equal ones by number.
    rows = rows.withColumns({"h": F.xxhash64("text"), "no": F.monotonically_increasing_id()})
    order = [F.col("doc_id").asc_nulls_first(), F.col("h").asc(), F.col("no").asc()]
    ordered = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("doc_id", "text")
    made = ordered.mapInArrow(_encode_task(f"{folder}/ids", tokenizer, end_id, file_ids), "path string, part int, seq int, n_docs long, n_ids long, slice long, counts binary")
    made.write.parquet(f"{folder}/ids-manifest")
    made = spark.read.parquet(f"{folder}/ids-manifest")

    def add(key, table):
        total = sum(np.frombuffer(x, np.int64) for x in table.column("counts").to_pylist())
        return pa.table({"slice": [key[0].as_py()], "counts": pa.array([total.tobytes()], pa.binary())})

    # Counts by id: as large as the vocabulary.
    slices = {r["slice"]: np.frombuffer(r["counts"], np.int64) for r in made.where("slice IS NOT NULL").select("slice", "counts").groupBy("slice").applyInArrow(add, "slice long, counts binary").collect()}
    by_id = np.concatenate([slices.get(i, np.zeros(SLICE, np.int64)) for i in range(max(slices, default=0) + 1)])
    # A row for each file, of FILE_IDS ids or so.
    start, starts = 0, []
    for r in made.where("path IS NOT NULL").select("path", "part", "seq", "n_docs", "n_ids").orderBy("part", "seq").collect():
        starts.append((r["path"], len(starts), start, r["n_docs"], r["n_ids"]))
        start += r["n_ids"]
    listed = spark.createDataFrame(starts, "path string, part int, start long, n_docs long, n_ids long").repartition(max(1, len(starts)))
    coded = listed.mapInArrow(_code_task(f"{folder}/tokens", huffman.code_lengths(by_id)), "path string, part int, start long, n_docs long, n_ids long, n_bytes long")
    coded.write.parquet(f"{folder}/manifest")
    delete_dir(spark, f"{folder}/ids")
    return spark.read.parquet(f"{folder}/manifest")


def read_file(data: bytes) -> tuple[list, np.ndarray, np.ndarray, int]:
    """doc_ids, token counts and ids of a file, and the number of ids in the files before it."""
    if data[: len(MAGIC)] != MAGIC:
        raise ValueError("not a token file")
    at = len(MAGIC)
    (n,) = struct.unpack_from("<I", data, at)
    head = json.loads(data[at + 4 : at + 4 + n])
    at += 4 + n

    def take(size: int) -> bytes:
        nonlocal at
        at += size
        return data[at - size : at]

    lengths = np.frombuffer(zlib.decompress(take(head["table"])), np.uint8)
    docs, counts = np.frombuffer(take(8 * head["n_docs"]), "<i8"), np.frombuffer(take(8 * head["n_docs"]), "<i8")
    null = np.frombuffer(take(head["n_docs"]), np.uint8)
    points = np.frombuffer(take(8 * -(-head["n_ids"] // head["block"])), "<u8")
    ids = huffman.decode(take(head["stream"]), points, head["n_ids"], lengths, head["block"])
    return [None if x else d for d, x in zip(docs.tolist(), null.tolist(), strict=True)], counts, ids, head["start"]


def read(manifest: DataFrame) -> DataFrame:
    """From the files alone: doc_id, start, n_tokens, and the ids as little-endian unsigned 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                docs, counts, ids, start = read_file(read_whole(path))
                ends = np.cumsum(counts)
                raw = memoryview(ids.astype("<u4").tobytes())
                for a in range(0, len(docs), 512):
                    part = slice(a, a + 512)
                    packed = [bytes(raw[4 * (e - c) : 4 * e]) for c, e in zip(counts[part].tolist(), ends[part].tolist(), strict=True)]
                    yield pa.RecordBatch.from_pydict({"doc_id": pa.array(docs[part], pa.int64()), "start": pa.array(start + ends[part] - counts[part]), "n_tokens": pa.array(counts[part]), "token_ids": pa.array(packed, pa.binary())})

    paths = manifest.select("path", "part").repartitionByRange(max(1, manifest.count()), "part").select("path")
    return paths.mapInArrow(run, "doc_id long, start long, n_tokens long, token_ids binary")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    back = read(write(docs, work_dir(spark, "token-files"), public_tokenizers.path("byte_bpe_50k.json")))
    return back.select("doc_id", "start", "n_tokens", F.crc32("token_ids").alias("ids_crc32"))
