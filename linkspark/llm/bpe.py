"""Byte-level BPE encoding and decoding by a rank file.

A piece (a match of the pattern) that is a token itself is that token. Any other piece is merged with a segment tree
over its byte positions whose leaves are the ranks of neighbouring pairs; the root is the leftmost pair of the
least rank. A merge changes three leaves (the pair's own, its successor's and its predecessor's), each by one path of
point updates, so a piece of n bytes takes O(n log n). Pieces of up to ``TOGETHER`` bytes are merged many at a time,
as rows of one array of trees; longer ones one by one.

``pieces`` cuts texts by the pattern, gives each distinct piece of a batch once, and remembers pieces from batch to
batch. This changes no result.

Defined cases: a null or empty text has no ids; no ids decode to empty bytes. Repeated rows are encoded alike. An empty
table gives an empty table. Extra columns pass through; where one has the name of a new column, the new one gets a
number behind its name. Texts are used whole; a very long piece costs O(n log n).
"""

from __future__ import annotations

import base64
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, free, fresh
from .pieces import Encoder, packed

TOGETHER = 64
NONE = np.int64(2**31 - 1)


class Ranks:
    """A rank file: token bytes by id, ids by bytes, and the rank of every pair of tokens whose bytes make a token."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.size = max(self.ranks.values()) + 1
        self.bytes = [b""] * self.size
        for token, rank in self.ranks.items():
            self.bytes[rank] = token
        self.tokens = pa.array(self.bytes, pa.binary())
        self.of_byte = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = {}
        for token, rank in self.ranks.items():
            for i in range(1, len(token)):
                a, b = self.ranks.get(token[:i]), self.ranks.get(token[i:])
                if a is not None and b is not None:
                    pairs[a * self.size + b] = rank
        self.pairs = pairs
        self.keys = np.array(sorted(pairs), np.int64)
        self.values = np.array([pairs[k] for k in self.keys.tolist()], np.int64)

    def pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.values[at], NONE)


def merge_one(piece: bytes, r: Ranks) -> list[int]:
    """The ids of one piece, by a segment tree in plain lists."""
    n = len(piece)
    size = 1 << max(0, (n - 1).bit_length())
    ids = [int(r.of_byte[b]) for b in piece]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    none = (int(NONE), 0)
    tree = [none] * (2 * size)

    def leaf(i: int) -> tuple[int, int]:
        rank = r.pairs.get(ids[i] * r.size + ids[after[i]]) if after[i] < n else None
        return none if rank is None else (rank, i)

    for i in range(n):
        tree[size + i] = leaf(i)
    for k in range(size - 1, 0, -1):
        tree[k] = min(tree[2 * k], tree[2 * k + 1])

    def update(i: int, value: tuple[int, int]) -> None:
        k = size + i
        tree[k] = value
        k >>= 1
        while k:
            tree[k] = min(tree[2 * k], tree[2 * k + 1])
            k >>= 1

    while n > 1 and tree[1] is not none:
        rank, i = tree[1]
        gone = after[i]
        ids[i], after[i] = rank, after[gone]
        if after[i] < n:
            before[after[i]] = i
        update(gone, none)
        update(i, leaf(i))
        if before[i] >= 0:
            update(before[i], leaf(before[i]))
    out, i = [], 0
    while i < n:
        out.append(ids[i])
        i = after[i]
    return out


def _merge_rows(pieces: list[bytes], size: int, r: Ranks) -> tuple[np.ndarray, np.ndarray]:
    """As ``merge_many``, of pieces of up to ``size`` bytes, a power of two: one row of every array for each piece."""
    m = len(pieces)
    lengths = np.fromiter(map(len, pieces), np.int64, m)
    raw = np.frombuffer(b"".join(p.ljust(size, b"\0") for p in pieces), np.uint8).reshape(m, size)
    ids = r.of_byte[raw]
    here = np.arange(size)
    ids[here >= lengths[:, None]] = -1
    after = np.tile(here + 1, (m, 1))
    before = np.tile(here - 1, (m, 1))
    tree = np.full((m, 2 * size), NONE * size, np.int64)  # rank * size + position; NONE sorts last
    pair = r.pair_ranks(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(m, size - 1)
    pair[here[1:] >= lengths[:, None]] = NONE
    tree[:, size : 2 * size - 1] = np.where(pair == NONE, NONE * size, pair * size + here[:-1])
    for k in range(size - 1, 0, -1):
        tree[:, k] = np.minimum(tree[:, 2 * k], tree[:, 2 * k + 1])
    top = NONE * size
    live = np.flatnonzero(tree[:, 1] < top)
    while len(live):
        root = tree[live, 1]
        at = root % size
        gone = after[live, at]
        nxt = after[live, gone]
        ids[live, at] = root // size
        ids[live, gone] = -1
        after[live, at] = nxt
        inside = nxt < lengths[live]
        before[live[inside], nxt[inside]] = at[inside]
        prev = before[live, at]
        right = np.full(len(live), NONE, np.int64)
        right[inside] = r.pair_ranks(ids[live[inside], at[inside]], ids[live[inside], nxt[inside]])
        tree[live, size + gone] = top
        tree[live, size + at] = np.where(right == NONE, top, right * size + at)
        led = prev >= 0
        rows, p = live[led], prev[led]
        left = r.pair_ranks(ids[rows, p], ids[rows, at[led]])
        tree[rows, size + p] = np.where(left == NONE, top, left * size + p)
        for of, leaf in ((live, gone), (live, at), (rows, p)):
            k = (leaf + size) >> 1
            while k[0:1].any():
                tree[of, k] = np.minimum(tree[of, 2 * k], tree[of, 2 * k + 1])
                k >>= 1
        live = live[tree[live, 1] < top]
    kept = ids >= 0
    return ids[kept].astype("<u4"), kept.sum(axis=1)


def merge_many(pieces: list[bytes], r: Ranks) -> tuple[np.ndarray, np.ndarray]:
    """The ids of pieces, one after the other, and how many each has."""
    lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
    whole = np.fromiter(map(r.ranks.get, pieces, repeat(-1)), np.int64, len(pieces))
    places, made = [np.flatnonzero(whole >= 0)], [(whole[whole >= 0].astype("<u4"), np.ones(int((whole >= 0).sum()), np.int64))]
    size = 2
    while size <= TOGETHER:
        group = np.flatnonzero((whole < 0) & (lengths <= size) & ((lengths > size // 2) | (size == 2)))
        for i in range(0, len(group), 8_000):
            places.append(group[i : i + 8_000])
            made.append(_merge_rows([pieces[k] for k in places[-1].tolist()], size, r))
        size *= 2
    for k in np.flatnonzero((whole < 0) & (lengths > TOGETHER)).tolist():
        places.append(np.array([k]))
        one = np.array(merge_one(pieces[k], r), "<u4")
        made.append((one, np.array([len(one)])))
    ids, sizes, place = np.concatenate([m[0] for m in made]), np.concatenate([m[1] for m in made]), np.concatenate(places)
    # Back into the order of the pieces.
    order = np.empty(len(place), np.int64)
    order[place] = np.arange(len(place))
    first = np.cumsum(sizes) - sizes
    n = sizes[order]
    at = np.repeat(first[order] - (np.cumsum(n) - n), n) + np.arange(n.sum())
    return ids[at], n


@lru_cache(maxsize=4)
def ranks(path: str) -> Ranks:
    """One per worker and file."""
    return Ranks(path)


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One per worker and file."""
    r = ranks(path)
    return Encoder(lambda new: merge_many(new, r))


def decoded(ids: pa.Array, r: Ranks) -> pa.Array:
    """The bytes that packed ids stand for."""
    offsets = np.frombuffer(ids.buffers()[1], np.int32)[ids.offset : ids.offset + len(ids) + 1].astype(np.int64) // 4
    held = ids.buffers()[2]
    flat = np.frombuffer(held, "<u4")[offsets[0] : offsets[-1]] if held and held.size else np.zeros(0, "<u4")
    out = r.tokens.take(pa.array(flat.astype(np.int64)))
    ends = np.frombuffer(out.buffers()[1], np.int32)[: len(out) + 1].astype(np.int64) if len(out) else np.zeros(1, np.int64)
    return packed(ends[offsets - offsets[0]], out.buffers()[2] or pa.py_buffer(b""))


def encode(text: Column, path: str) -> Column:
    """Ids as binary: little-endian unsigned 32-bit integers, one after the other."""

    @F.arrow_udf("binary")
    def ids(texts: pa.Array) -> pa.Array:
        return encoder(path).texts(texts)

    return ids(text)


def decode(ids: Column, path: str) -> Column:
    """The bytes that ids (as from ``encode``) stand for."""

    @F.arrow_udf("binary")
    def text(held: pa.Array) -> pa.Array:
        return decoded(held.fill_null(b""), ranks(path))

    return text(ids)


def encode_decode(df: DataFrame, text_col: str = "text", path: str | None = None, ids_col: str = "token_ids", decoded_col: str = "decoded") -> DataFrame:
    """df's rows with two columns more, the ids and what they decode to (both binary), under the given names or, where df
    has those already, ``free`` ones. Both are made in one pass; ``encode`` followed by ``decode`` would encode twice."""
    import public_tokenizers

    path = path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    bounded_batches(df.sparkSession)
    both = "struct<ids:binary,decoded:binary>"

    @F.arrow_udf(both)
    def run(texts: pa.Array) -> pa.Array:
        ids = encoder(path).texts(texts)
        return pa.StructArray.from_arrays([ids, decoded(ids, ranks(path))], ["ids", "decoded"])

    held = fresh(df, "both")
    out = df.withColumn(held, run(F.col(f"`{text_col}`")))
    for name, part in ((ids_col, "ids"), (decoded_col, "decoded")):
        out = out.withColumn(free(df, name), F.col(held)[part])
    return out.drop(held)


def digest(df: DataFrame) -> DataFrame:
    """doc_id, n_tokens, and the digests of the ids and of the decoded bytes."""
    both = encode_decode(df.select("doc_id", "text"))
    return both.select(
        "doc_id",
        F.shiftright(F.octet_length("token_ids"), 2).cast("long").alias("n_tokens"),
        F.sha2("token_ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(spark.read.parquet(f"{sf_dir}/documents.parquet"))
