"""N-gram Jaccard join with adaptive multi-match prefixes.

A document's set holds its distinct 3-word shingles (64-bit hashes; sets are named by 64 bits too, so that two of 10^8
different sets share a name by a chance of 1 in 3,000). Documents with equal sets form a class, and only classes are
compared. Shingles are ordered rarest first, by estimates from two sketches of all documents, of fixed size: how often
a shingle is to be expected from the shares of its words, which stays as sharp at any size of the corpus, and how far
its own count stands out from that of other shingles. Both are rounded on the driver, so all tasks order alike. A class of n shingles
that is to reach the threshold t shares at least o = ceil(t n) of them with a partner, so their first n - o + k
shingles have at least k in common, for any k. Each class takes the k of the least estimated cost: postings read, and
pairs expected to share k prefix shingles by chance and so to be verified. A pair must share at least the smaller k.

Prefix shingles are posted; the classes of one are parted by size where no two of them could be linked across. Those of
one class alone are dropped, and those with the same classes are merged. What remains are buckets of classes. A bucket is dealt out in blocks of at most ``2 * CHUNK`` classes, so no task needs a
whole bucket. A pair belongs to the first bucket that both classes are in. Each block is gone through twice: by the
prefixes and a bit map of each class alone, to find which classes have candidates there, and then with the shingles of
those classes, to verify. The bit maps rule out only pairs that can't be linked.
A block gives link counts by class and a spanning forest of its links, never its pairs. Components come from the
forests by alternating large-star and small-star steps.

Defined cases: a document without words or text has an empty set, is linked with nothing and is its own component.
A class's component is the smallest doc_id reached; rows with equal doc_ids are all kept. Documents with a null doc_id
count as copies and links; a component of such documents alone has a null id. Empty tables give empty tables. Only
the two named columns are used. Texts are used whole. No pair, candidate or partner is dropped or capped.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bit_map, bounded_batches, discard, drop_shuffles_early, fresh, hot_join, in_map, written

WORDS_IN_SHINGLE = 3
THRESHOLD = 90  # per cent
CHUNK = 128
#: Bins of either sketch, the slices that tasks send them in, and how many levels of an estimate make a factor of 2.
SKETCH_BITS, SKETCH_SLICES, LEVELS = 18, 16, 16
#: Bounds of the bits (as powers of two) by which pairs are told apart before their shingles are fetched.
LEAST_BITS, MOST_BITS = 9, 16
#: Bounds of the matches asked for; a set with an overlap of 1 can but ask for 1.
LEAST_MATCHES, MOST_MATCHES = 2, 6
#: A bucket's name: how rare its classes are (the largest first) over so many bits of a shingle's hash. Buckets whose
#: names meet become one, which costs comparisons and loses nothing.
NAME_BITS, MOST_DF = 44, (1 << 19) - 1
#: Bits of the map of wanted doc_ids, by which most texts are passed over when shingles are fetched.
WANTED_BITS = 23
#: Costs in the estimate: to read a posting, and to verify a pair.
POSTING_COST, VERIFY_COST = 1.0, 50.0
#: A token with more postings than this isn't merged with others of the same classes, which takes all of them at once.
MERGE_LIMIT = 100_000
WORDS = 300_000

_hashes: dict[bytes, int] = {}
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def word_hashes(text: str | None) -> np.ndarray:
    """The hashes of a text's words: runs of bytes other than space and U+0009..U+000D."""
    words = text.encode("utf-8", "replace").lower().split() if text else []  # bytes.lower and split are ASCII's
    if not words:
        return np.zeros(0, np.uint64)
    if len(_hashes) > WORDS:
        _hashes.clear()
    for w in set(words).difference(_hashes):
        _hashes[w] = xxhash.xxh3_64_intdigest(w)
    return np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))


def windows(h: np.ndarray, size: int = WORDS_IN_SHINGLE) -> np.ndarray:
    """The hash of each run of ``size`` words, or of all words if there are fewer."""
    size = min(size, len(h))
    mixed = np.full(len(h) - size + 1 if size else 0, np.uint64(size), np.uint64)
    for i in range(size):
        mixed = (mixed ^ h[i : len(h) - size + 1 + i]) * _A
        mixed ^= mixed >> np.uint64(29)
        mixed = mixed * _B + _C
    return mixed ^ mixed >> np.uint64(32)


def shingles(text: str | None, size: int = WORDS_IN_SHINGLE) -> np.ndarray:
    """The hashes of a text's distinct shingles, sorted."""
    return np.unique(windows(word_hashes(text), size))


def class_of(s: np.ndarray) -> int:
    """A signed 64-bit name for a set."""
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes(), seed=len(s)))))


def bitmap(s: np.ndarray) -> bytes:
    """A set as bits, a power of two of them and about as many as it has elements: each element turns one over. Two such
    maps differ in no more bits than the sets differ in elements."""
    size = 1 << min(MOST_BITS, max(LEAST_BITS, (len(s) - 1).bit_length()))
    return np.packbits((np.bincount((s & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1).astype(bool)).tobytes()


def least_overlap(n: int, percent: int) -> int:
    return -(-n * percent // 100)


def _bin(s: np.ndarray) -> np.ndarray:
    return (s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def levels(words: np.ndarray, sets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """From the sketches of words and of shingles: levels by bin whose sum over a shingle's words is that of its expected
    count, and levels by bin of how far a shingle's own count stands out."""
    total, usual = max(int(words.sum()), 1), float(np.median(sets))
    share = np.log2(np.maximum(words, 1)) - np.log2(total) * (size - 1) / size
    own = np.maximum(sets - usual, 1)
    return np.rint(LEVELS * share).astype(np.int32), np.rint(LEVELS * np.log2(own)).astype(np.int32)


def weighed(text: str | None, by_word: np.ndarray, by_bin: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """A text's distinct shingles, sorted, and the level of each."""
    h = word_hashes(text)
    s, at = np.unique(windows(h, size), return_index=True)
    of_word = by_word[_bin(h)]
    expected = sum((of_word[at + i] for i in range(min(size, len(h)))), np.zeros(len(at), np.int32))
    return s, np.maximum(expected, by_bin[_bin(s)])


def prefix(s: np.ndarray, level: np.ndarray, docs: int, percent: int) -> tuple[int, np.ndarray]:
    """How many matches a set asks for, and its prefix of that many shingles more than n - o."""
    n = len(s)
    o = least_overlap(n, percent)
    most = min(MOST_MATCHES, o)
    order = np.lexsort((s, level))[: n - o + most]
    others = np.cumsum(np.exp2(level[order] / LEVELS))  # postings of other documents
    best, cost = 1, math.inf
    for k in range(min(LEAST_MATCHES, most), most + 1):
        total = float(others[n - o + k - 1])
        met = total / max(docs, 1)  # shared prefix shingles expected with another document
        term = math.exp(-min(met, 700.0))
        below = 0.0
        for i in range(k):
            below += term
            term *= met / (i + 1)
        c = POSTING_COST * (total + n - o + k) + VERIFY_COST * docs * max(0.0, 1 - below)
        if c < cost:
            best, cost = k, c
    return best, s[order[: n - o + best]]


def _measure(size: int):
    """doc_id, row, n and class of each document; at the end, the partition's sketches in slices: those of shingles first,
    then those of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros((2, 1 << SKETCH_BITS), np.int64)
        for b in batches:
            words = [word_hashes(t) for t in b.column(2).to_pylist()]
            sets = [np.unique(windows(h, size)) for h in words]
            for i, of in enumerate((sets, words)):
                bins = _bin(np.concatenate(of)) if of else np.zeros(0, np.int64)
                sketch[i] += np.bincount(bins, minlength=1 << SKETCH_BITS)
            yield pa.RecordBatch.from_pydict({"doc_id": b.column(0), "row": b.column(1), "n": pa.array([len(s) for s in sets], pa.int64()), "cls": pa.array([class_of(s) for s in sets], pa.int64()), "slice": pa.nulls(len(sets), pa.int32()), "counts": pa.nulls(len(sets), pa.binary())})
        if sketch.any():
            parts = np.split(sketch.ravel(), 2 * SKETCH_SLICES)
            none = pa.nulls(len(parts), pa.int64())
            yield pa.RecordBatch.from_pydict({"doc_id": none, "row": none, "n": none, "cls": none, "slice": pa.array(range(len(parts)), pa.int32()), "counts": pa.array([p.tobytes() for p in parts], pa.binary())})

    return run


def _sum_sketches(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The sketches of all documents, of shingles and of words. Their size is fixed."""

    def add(key, table):
        total = sum(np.frombuffer(x, np.int64) for x in table.column("counts").to_pylist())
        return pa.table({"slice": pa.array([key[0].as_py()], pa.int32()), "counts": pa.array([total.tobytes()], pa.binary())})

    out = np.zeros(2 << SKETCH_BITS, np.int64)
    width = len(out) // (2 * SKETCH_SLICES)
    for r in rows.where("slice IS NOT NULL").select("slice", "counts").groupBy("slice").applyInArrow(add, "slice int, counts binary").collect():
        out[r["slice"] * width : (r["slice"] + 1) * width] = np.frombuffer(r["counts"], np.int64)
    return out[: 1 << SKETCH_BITS], out[1 << SKETCH_BITS :]


def _prefixes(words: np.ndarray, sets: np.ndarray, docs: int, percent: int, size: int, spark: SparkSession):
    """cls, n, k, tokens and bits of each class that a task meets; of copies, it gives the first alone."""
    sent = spark.sparkContext.broadcast(levels(words, sets, size))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_word, by_bin = sent.value
        met: set[int] = set()
        for b in batches:
            rows = []
            for text in b.column(0).to_pylist():
                s, level = weighed(text, by_word, by_bin, size)
                cls = class_of(s)
                if len(s) and cls not in met:
                    met.add(cls)
                    k, tokens = prefix(s, level, docs, percent)
                    rows.append((cls, len(s), k, tokens.astype(np.int64), bitmap(s)))
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), kinds, strict=True)], names=["cls", "n", "k", "tokens", "bits"])

    return run


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, pa.Table]]:
    """Consecutive rows that agree in the first ``keys`` columns, as tables."""
    key, held = None, []
    for b in batches:
        if not b.num_rows:
            continue
        columns = [b.column(i).to_numpy(zero_copy_only=False) for i in range(keys)]
        change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
        for s, e in zip([0, *change.tolist()], [*change.tolist(), b.num_rows], strict=True):
            now = tuple(c[s] for c in columns)
            if now != key:
                if held:
                    yield key, pa.Table.from_batches(held)
                key, held = now, []
            held.append(b.slice(s, e - s))
    if held:
        yield key, pa.Table.from_batches(held)


def _postings(percent: int):
    """From sorted (token, n, cls), in which rows may recur: (cls, token, df, sig) of groups of two classes or more. A group has the
    classes of a token each of which could be linked with the next by its size; it is named by token and least size.
    sig is alike for groups of the same classes. Rows of a very large group go on as they come, with a df that tells so."""

    def mixed(c: np.ndarray, seed: int = 0) -> np.ndarray:
        c = c.astype(np.uint64) + np.uint64(seed)
        return (c * _A) ^ (c >> np.uint64(31))

    def out(name: np.ndarray, c: np.ndarray, first: np.ndarray, common: int | None) -> pa.RecordBatch | None:
        """Whole groups, by where they begin; common: the name of a group met before that is very large."""
        if not len(c):
            return None
        size = np.diff(np.append(first, len(c)))
        sig = np.bitwise_xor.reduceat(mixed(c), first).astype(np.int64)
        over = size > MERGE_LIMIT
        if common is not None:
            over |= name == common
        df, sig = np.where(over, MERGE_LIMIT + 1, size), np.where(over, name, sig)
        keep = np.repeat((size > 1) | over, size)
        return pa.RecordBatch.from_pydict({"cls": c[keep], "token": np.repeat(name, size)[keep], "df": np.repeat(df, size)[keep].astype(np.int64), "sig": np.repeat(sig, size)[keep]})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * 3
        last, common = None, None  # the last row and the name of a group that was passed on before its end
        for b in _and_end(batches):
            t, n, c = (np.concatenate((h, x)) for h, x in zip(held, b, strict=True)) if b else held
            if not len(t):
                continue
            other = np.append(True, (t[1:] != t[:-1]) | (c[1:] != c[:-1]))
            other[0] = last is None or (last[0], last[2]) != (t[0], c[0])
            if not other.all():
                t, n, c = t[other], n[other], c[other]
                if not len(t):
                    held = [t, n, c]
                    continue
            new = np.append(True, (t[1:] != t[:-1]) | (100 * n[:-1] < percent * n[1:]))
            if last is not None:
                new[0] = last[0] != t[0] or 100 * last[1] < percent * n[0]
            first = np.flatnonzero(np.append(True, new[1:]))
            name = mixed(t[first], 1).astype(np.int64) ^ n[first] * 0x5851F42D4C957F2D
            if not new[0]:
                name[0] = common
            stop = len(first) if b is None else len(first) - 1  # the last group may go on in the next batch
            end = first[stop] if stop < len(first) else len(t)
            if stop < len(first) and len(t) - end > MERGE_LIMIT:
                stop, end = len(first), len(t)
            made = out(name[:stop], c[:end], first[:stop], common if not new[0] else None)
            if made and made.num_rows:
                yield made
            if b is not None and end == len(t):
                last, common = (t[-1], n[-1], c[-1]), int(name[-1])
            elif end:
                last, common = None, None
            held = [t[end:], n[end:], c[end:]]

    return run


def _and_end(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray] | None]:
    """The columns of each batch that isn't empty, then None."""
    for b in batches:
        if b.num_rows:
            yield [c.to_numpy() for c in b.columns]
    yield None


def _sparse(lists: list[np.ndarray], weights: list[np.ndarray] | None = None) -> Iterator[np.ndarray]:
    """Rows as dense columns, a slice of columns at a time; columns of one row alone are left out."""
    flat = np.concatenate(lists)
    if not len(flat):
        return
    row = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    names, number, count = np.unique(flat, return_inverse=True, return_counts=True)
    keep = count[number] > 1
    row, number = row[keep], number[keep]
    w = np.concatenate(weights)[keep] if weights is not None else np.ones(len(row))
    used, number = np.unique(number, return_inverse=True)
    width = max(1, 8_000_000 // max(1, len(lists)))
    for a in range(0, len(used), width):
        part = (number >= a) & (number < a + width)
        m = np.zeros((len(lists), min(width, len(used) - a)), np.float32)
        m[row[part], number[part] - a] = w[part]
        yield m


def _may_link(b: dict, ok: np.ndarray, percent: int) -> np.ndarray:
    """ok without the pairs that differ in too many bits to be linked. The larger map is folded to the smaller's size."""
    x, y = np.nonzero(ok)
    size = np.array([len(m) for m in b["bits"]])
    least = np.minimum(size[x], size[y])
    for width in np.unique(least).tolist():
        own = np.flatnonzero(least == width)
        rows = np.unique(np.concatenate((x[own], y[own])))
        maps = np.zeros((len(size), width), np.uint8)
        for i in rows.tolist():
            maps[i] = np.bitwise_xor.reduce(np.frombuffer(b["bits"][i], np.uint8).reshape(-1, width), axis=0)
        for at in range(0, len(own), max(1, (8 << 20) // width)):
            part = own[at : at + max(1, (8 << 20) // width)]
            differ = np.bitwise_count(maps[x[part]] ^ maps[y[part]]).sum(axis=1, dtype=np.int64)
            n = b["n"].astype(np.int64)
            far = differ * (100 + percent) > (n[x[part]] + n[y[part]]) * (100 - percent)
            ok[x[part][far], y[part][far]] = False
    return ok


def _candidates(b: dict, bucket: int, diagonal: bool, percent: int) -> np.ndarray:
    """Pairs (as a matrix) of a block whose first common bucket is this one, and that share enough to be verified."""
    return _may_link(b, _sharing(b, bucket, diagonal, percent), percent)


def _sharing(b: dict, bucket: int, diagonal: bool, percent: int) -> np.ndarray:
    n, k, side = b["n"], b["k"], b["side"]
    m = len(n)
    ok = 100 * np.minimum(n[:, None], n[None, :]) >= percent * np.maximum(n[:, None], n[None, :])
    ok &= np.triu(np.ones((m, m), bool), 1) if diagonal else side[:, None] < side[None, :]
    if m <= 12:
        keys = [dict(zip(x.tolist(), t.tolist(), strict=True)) for x, t in zip(b["keys"], b["times"], strict=True)]
        for x, y in zip(*np.nonzero(ok), strict=True):
            common = keys[x].keys() & keys[y].keys()
            ok[x, y] = min(common) == bucket and sum(keys[x][c] for c in common) >= min(k[x], k[y])
        return ok
    shared, earlier = np.zeros((m, m), np.float32), np.zeros((m, m), np.float32)
    for x in _sparse(b["keys"], b["times"]):
        shared += x @ (x > 0).T.astype(np.float32)
    for x in _sparse([c[c < bucket] for c in b["keys"]]):
        earlier += x @ x.T
    return ok & (earlier == 0) & (shared >= np.minimum(k[:, None], k[None, :]))


def _block(table: pa.Table, i: int) -> dict:
    out = {name: table.column(name).to_numpy() for name in ("cls", "n", "k")}
    out["bits"] = table.column("bits").to_pylist()
    out["side"] = (table.column("chunk").to_numpy() != i).astype(np.int8)
    for name in ("keys", "times"):
        lists = table.column(name).combine_chunks()
        ends = lists.offsets.to_numpy()[1:-1] - lists.offsets[0].as_py()
        out[name] = np.split(lists.flatten().to_numpy(), ends)
    return out


def _needed(percent: int):
    """From the blocks, sorted by (bucket, i, j): those rows that have a candidate in their block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for (bucket, i, j), table in _groups(batches, 3):
            if table.num_rows < 2:
                continue
            ok = _candidates(_block(table, i), bucket, i == j, percent)
            some = np.flatnonzero(ok.any(axis=0) | ok.any(axis=1))
            if len(some):
                held.append(table.take(pa.array(some)))
                rows += len(some)
                if rows > 4096:
                    yield from pa.concat_tables(held).combine_chunks().to_batches()
                    held, rows = [], 0
        if held:
            yield from pa.concat_tables(held).combine_chunks().to_batches()

    return run


def _forest(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Links that join parts not joined before."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        p, q = find(x), find(y)
        if p != q:
            parent[p] = q
            out.append((x, y))
    return out


def _verify(percent: int):
    """From the needed rows with their shingles: (cls, links, null) and (cls, null, other) rows, both few per block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (bucket, i, j), table in _groups(batches, 3):
            b = _block(table, i)
            ok = _candidates(b, bucket, i == j, percent)
            if not ok.any():
                continue
            sets = [np.frombuffer(x, np.uint64) for x in table.column("shingles").to_pylist()]
            common = np.zeros(ok.shape, np.float32)
            for x in _sparse(sets):
                common += x @ x.T
            n = b["n"].astype(np.int64)
            common = np.rint(common).astype(np.int64)
            linked = ok & (100 * common >= percent * (n[:, None] + n[None, :] - common))
            if not linked.any():
                continue
            copies = table.column("copies").to_numpy()
            both = linked | linked.T
            links = both @ copies
            some = np.flatnonzero(links)
            x, y = np.nonzero(linked)
            edges = _forest(b["cls"][x], b["cls"][y])
            yield pa.RecordBatch.from_pydict({"cls": pa.array([*b["cls"][some].tolist(), *[e[0] for e in edges]], pa.int64()), "links": pa.array([*links[some].tolist(), *[None] * len(edges)], pa.int64()), "other": pa.array([*[None] * len(some), *[e[1] for e in edges]], pa.int64())})

    return run


def _wanted_map(ids: DataFrame) -> np.ndarray:
    """A bit map of fixed size in which every wanted doc_id's place is set."""

    def fill(key, table):
        bits = np.zeros(1 << WANTED_BITS >> 4, bool)
        bits[table.column("place").to_numpy()] = True
        return pa.table({"slice": pa.array([key[0].as_py()], pa.int32()), "bits": pa.array([np.packbits(bits).tobytes()], pa.binary())})

    place = F.shiftrightunsigned(F.xxhash64("doc_id"), 64 - WANTED_BITS)
    rows = ids.select((place / (1 << WANTED_BITS >> 4)).cast("int").alias("slice"), (place % (1 << WANTED_BITS >> 4)).cast("int").alias("place")).distinct()
    out = np.zeros((16, 1 << WANTED_BITS >> 7), np.uint8)
    for r in rows.groupBy("slice").applyInArrow(fill, "slice int, bits binary").collect():
        out[r["slice"]] = np.frombuffer(r["bits"], np.uint8)
    return np.unpackbits(out.ravel()).astype(bool)


def _shingle_bytes(size: int, wanted: np.ndarray, spark: SparkSession):
    """(doc_id, cls, shingles) of the texts whose doc_id may be wanted."""
    sent = spark.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = b.filter(pa.array(sent.value[b.column(2).to_numpy()]))
            if b.num_rows:
                sets = [shingles(t, size) for t in b.column(1).to_pylist()]
                yield pa.RecordBatch.from_pydict({"doc_id": b.column(0), "cls": pa.array([class_of(x) for x in sets], pa.int64()), "shingles": pa.array([x.tobytes() for x in sets], pa.binary())})

    return run


def components(edges: DataFrame) -> DataFrame:
    """(cls, root) of every class in a link (a, b): alternating large-star and small-star steps. A class with very many
    links is not one task's: least neighbours are aggregated before the shuffle and joined back by ``hot_join``."""

    def told(links: DataFrame, least: DataFrame) -> DataFrame:
        return hot_join(links, least, ["u"], "n", ["m"], links.count(), F.col("v").cast("string"))

    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct().checkpoint()
    before = None
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count(F.lit(1)).alias("n"))
        large = told(both, least).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct().checkpoint()
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        small = told(large, low).select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).where("u != v").distinct()
        e = small.checkpoint()
        now = tuple(e.agg(F.count(F.lit(1)), F.sum(F.hash("u", "v").cast("long")), F.countDistinct("v")).first())
        if now == before:
            break
        before = now
    return e.select(F.col("u").alias("cls"), F.col("v").alias("root"))


def _row(id_col: str, text_col: str) -> Column:
    """A name for what a row says: alike for rows of one doc_id and text."""
    return F.xxhash64(F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`"))


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = THRESHOLD, size: int = WORDS_IN_SHINGLE) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links."""
    return _rows(docs, id_col, text_col, percent, size).select("doc_id", "n_shingles", "component_id", "n_links")


def _rows(docs: DataFrame, id_col: str, text_col: str, percent: int, size: int) -> DataFrame:
    """As ``join``, with row and root, the component's class; root is null for documents without words."""
    spark = docs.sparkSession
    bounded_batches(spark)
    drop_shuffles_early(spark)
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    named = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), _row(id_col, text_col).alias("row"), F.col(f"`{text_col}`").alias("text"))
    measured = written(named.mapInArrow(_measure(size), "doc_id long, row long, n long, cls long, slice int, counts binary"), "join-sets")
    members = measured.where("slice IS NULL").select("doc_id", "row", "n", "cls")
    (of_sets, of_words), total = _sum_sketches(measured), members.count()
    prefixes = written(texts.select("text").mapInArrow(_prefixes(of_words, of_sets, total, percent, size, spark), "cls long, n long, k int, tokens array<long>, bits binary"), "join-prefixes")
    classes = written(members.where("n > 0").groupBy("cls", "n").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("rep")), "join-classes")
    postings = prefixes.select(F.explode("tokens").alias("token"), "n", "cls").repartition("token").sortWithinPartitions("token", "n", "cls")
    posted = postings.mapInArrow(_postings(percent), "cls long, token long, df long, sig long")
    merged = posted.groupBy("cls", "df", "sig").agg(F.min("token").alias("token"), F.least(F.count(F.lit(1)), F.lit(MOST_MATCHES)).cast("byte").alias("times"))
    rarity = F.lit(MOST_DF).cast("long") - F.least("df", F.lit(MOST_DF).cast("long"))
    name = F.shiftleft(rarity, NAME_BITS).bitwiseOR(F.col("token").bitwiseAND((1 << NAME_BITS) - 1))
    named = merged.groupBy("cls", name.alias("bucket")).agg(F.max("times").alias("times"))
    keys = named.groupBy("cls").agg(F.sort_array(F.collect_list(F.struct("bucket", "times"))).alias("x"), F.sum("times").alias("met"))
    # Every partner of a class asks for as many matches as this at least, so classes that meet fewer have none.
    least = F.least(F.lit(LEAST_MATCHES), F.ceil(F.ceil(F.col("n") * percent / 100) * percent / 100))
    own = prefixes.groupBy("cls").agg(F.first("n").cast("int").alias("n"), F.first("k").cast("byte").alias("k"), F.first("bits").alias("bits"))
    held = own.join(keys, "cls").where(F.col("met") >= least)
    held = written(held.select("cls", "n", "k", "bits", F.col("x.bucket").alias("keys"), F.col("x.times").alias("times")), "join-keys")
    # A bucket of two classes has all their common shingles but those in larger buckets, which come first: if it is
    # their first, what they share there is all they share, and must be enough by itself.
    each = held.select(F.explode(F.arrays_zip("keys", "times")).alias("x"), "cls", "n", "k", "bits", "keys", "times")
    df = F.lit(MOST_DF) - F.shiftrightunsigned(F.col("x.keys"), NAME_BITS)
    enough = F.least(F.lit(LEAST_MATCHES), F.ceil(F.ceil(F.col("n") * percent / 100) * percent / 100))
    bucket = each.select(F.col("x.keys").alias("bucket"), df.alias("df"), "cls", "n", "k", "bits", "keys", "times", ((df > 2) | (F.col("x.times") >= enough)).alias("live")).where("live").drop("live")
    known = bucket.where(F.col("df") <= MERGE_LIMIT).withColumn("chunks", F.ceil(F.col("df") / CHUNK).cast("int"))
    # Of very common shingles the df is but a lower bound, so their classes are counted.
    common = bucket.where(F.col("df") > MERGE_LIMIT)
    sizes = common.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).select("bucket", "size", F.ceil(F.col("size") / CHUNK).cast("int").alias("chunks"))
    dealt = known.unionByName(hot_join(common, sizes, ["bucket"], "size", ["chunks"], total, F.col("cls").cast("string")))
    dealt = dealt.withColumn("chunk", F.pmod(F.xxhash64("cls"), F.col("chunks")).cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    blocks = dealt.select("bucket", F.least("chunk", "with").alias("i"), F.greatest("chunk", "with").alias("j"), "cls", "chunk", "n", "k", "bits", "keys", "times")
    kinds = "bucket long, i int, j int, cls long, chunk int, n int, k byte, bits binary, keys array<long>, times array<byte>"
    needed = written(blocks.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j").mapInArrow(_needed(percent), kinds), "join-needed")
    # One text for each class that has a candidate.
    bounded_batches(spark)
    wanted = written(needed.select("cls").distinct().join(classes.select("cls", "copies", F.col("rep").alias("doc_id")), "cls"), "join-wanted")
    place = F.shiftrightunsigned(F.xxhash64("doc_id"), 64 - WANTED_BITS).cast("int")
    fetched = texts.select("doc_id", "text", place.alias("place")).mapInArrow(_shingle_bytes(size, _wanted_map(wanted), spark), "doc_id long, cls long, shingles binary")
    # Rows may share a doc_id and differ in text; those of the class are alike. One exchange by class serves all three.
    text_of = fetched.withColumnRenamed("doc_id", "from").join(wanted, "cls").where(F.col("from").eqNullSafe(F.col("doc_id"))).groupBy("cls").agg(F.first("shingles").alias("shingles"), F.first("copies").alias("copies"))
    ready = needed.join(text_of, "cls").select("bucket", "i", "j", "cls", "chunk", "n", "k", "copies", "bits", "keys", "times", "shingles")
    results = written(ready.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j").mapInArrow(_verify(percent), "cls long, links long, other long"), "join-links")
    degree = results.where("links IS NOT NULL").groupBy("cls").agg(F.sum("links").alias("links"))
    roots = components(results.where("other IS NOT NULL").select(F.col("cls").alias("a"), F.col("other").alias("b")))
    rooted = classes.select("cls", "n", "copies", "rep").join(roots, "cls", "left").withColumn("root", F.coalesce("root", F.col("cls")))
    least = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    table = written(rooted.join(least, "root").join(degree, "cls", "left").select("cls", "copies", "root", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "join-components")
    discard(prefixes, classes, held, needed, wanted, results)
    full = members.where("n > 0")
    joined = hot_join(full, table, ["cls"], "copies", ["root", "component_id", "n_links"], total, F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    alone = members.where("n = 0").select("doc_id", "row", "n", "cls", F.lit(None).cast("long").alias("root"), F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("n_links"))
    return joined.unionByName(alone).withColumnRenamed("n", "n_shingles")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component, with docs' own columns: that of the smallest doc_id (null only if there is none), of
    rows with that id the one whose text has the smallest hash, and one of equal rows. Texts without words all stay."""
    found = written(_rows(docs, id_col, text_col, THRESHOLD, WORDS_IN_SHINGLE).where("n_links > 0").select("root", "doc_id", "row"), "join-linked")
    first = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("x")).select(F.col("x.row").alias("row"))
    name, mine, lost = fresh(docs, "row"), fresh(docs, "linked"), fresh(docs, "lost")
    gone = written(found.select("row").distinct().join(first.hint("merge"), "row", "left_anti").select(F.col("row").alias(lost)), "join-lost")
    # Rows without a link stay as they are. Of the others, equal ones meet after a first choice in each task.
    told, may = in_map(docs.withColumn(name, _row(id_col, text_col)), written(bit_map(found, "row"), "join-map"), F.col(name))
    words = F.coalesce(F.col(f"`{text_col}`"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    told = told.select(*docs.columns, name, (may & words).alias(mine))
    discard(found)
    linked = told.where(F.col(mine)).dropDuplicates([name]).join(gone.hint("merge"), F.col(name) == F.col(lost), "left_anti")
    return linked.unionByName(told.where(~F.col(mine))).select(*[F.col(f"`{c}`") for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(spark.read.parquet(f"{sf_dir}/documents.parquet"))
