"""Benchmark decontamination by an FM-index over each shard of training documents.

A shard is a bounded run of documents within a task. Words are mapped to the benchmark's vocabulary; any other word
separates, and runs shorter than the shortest window are left out, since no window can lie in them. Over what is
left an FM-index is built; every distinct window is searched backwards through wavelet-tree ranks, its occurrences
are located by sampled suffix positions, and the spans they cover are merged into removal spans.

A window is ``size`` consecutive words of a benchmark item; an item of fewer words, but not none, is one window.

The benchmark is read in blocks of at most ``BLOCK_CHARS`` characters (the bound of what is shipped to the tasks),
and each block is searched in all documents; a single item longer than that makes a block of its own.

Defined cases: a null or empty text has no words, no hits and isn't contaminated; null benchmark texts have no
windows, and an item with a null id counts for hits but isn't listed. Repeated rows are judged one by one; repeated
item ids count once. Empty tables give empty results or no hits. Extra columns pass through; the result is one struct
column, named by the caller. Texts are used whole.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, free, fresh, with_field, written
from .fm_index import FMIndex

WINDOW = 13
BLOCK_CHARS = 16_000_000
SHARD_WORDS = 1_000_000
#: Bytes of words stay (A-Z lowered), others become spaces: words are [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ of the lowered text.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))

KIND = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()),
        T.StructField("items", T.ArrayType(T.StringType())),
        T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
    ]
)
_ARROW = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])


def split_words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(_TABLE).split() if text else []


class Windows:
    """The distinct windows of a block of items, as arrays of vocabulary numbers by length."""

    def __init__(self, items: list[tuple[str | None, str | None]], size: int):
        self.vocab: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set] = defaultdict(set)
        for item, text in items:
            ids = [self.vocab.setdefault(w, len(self.vocab) + 1) for w in split_words(text)]
            for i in range(max(1, len(ids) - size + 1) if ids else 0):
                owners[tuple(ids[i : i + size])].add(item)
        lengths = sorted({len(w) for w in owners})
        self.least = min(lengths, default=0)
        self.by_length = [(np.array(ws, np.int64), [sorted(x for x in owners[w] if x is not None) for w in ws]) for k in lengths for ws in [[w for w in owners if len(w) == k]]]


def search_shard(docs: list[list[bytes]], windows: Windows) -> list[tuple[list[tuple[int, int]], set[str]]]:
    """For each document (a list of words), the merged spans [start, end) of words hit, and the items found."""
    out: list = [([], set()) for _ in docs]
    get = windows.vocab.get
    lengths = np.fromiter(map(len, docs), np.int64, len(docs))
    total = int(lengths.sum())
    if not total or not windows.least:
        return out
    seq = np.zeros(total + len(docs), np.int64)  # each document ends with a separator
    firsts = np.concatenate(([0], np.cumsum(lengths + 1)))
    for words, at in zip(docs, firsts, strict=False):
        seq[at : at + len(words)] = np.fromiter((get(w, 0) for w in words), np.int64, len(words))
    known = seq > 0
    edges = np.flatnonzero(np.diff(np.concatenate(([0], known.view(np.int8), [0]))))
    begin, end = edges[::2], edges[1::2]
    long = end - begin >= windows.least
    begin, end = begin[long], end[long]
    if not len(begin):
        return out
    sizes = end - begin + 1  # with the separator after each run
    places = np.repeat(begin - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) + np.arange(sizes.sum())
    text = seq[places]
    index = FMIndex(text, len(windows.vocab))
    covered = np.zeros(len(seq) + 1, np.int64)
    found: list[tuple[np.ndarray, int, np.ndarray, list]] = []
    for patterns, owners in windows.by_length:
        lo, hi = index.search(patterns)
        hits = np.flatnonzero(hi > lo)
        if not len(hits):
            continue
        n = (hi - lo)[hits]
        rows = np.repeat(lo[hits] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        at = places[index.locate(rows)]
        np.add.at(covered, at, 1)
        np.add.at(covered, at + patterns.shape[1], -1)
        found.append((at, patterns.shape[1], np.repeat(hits, n), owners))
    for at, _, which, owners in found:
        pairs = np.unique(np.stack((np.searchsorted(firsts, at, "right") - 1, which)), axis=1)
        for d, w in pairs.T.tolist():
            out[d][1].update(owners[w])
    edges = np.flatnonzero(np.diff(np.concatenate(([0], (np.cumsum(covered) > 0).view(np.int8), [0]))))
    for s, e in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
        d = int(np.searchsorted(firsts, s, "right")) - 1
        out[d][0].append((s - int(firsts[d]), e - int(firsts[d])))
    return out


def _merged(a: list[tuple[int, int]], b: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s, e in sorted([*a, *b]):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def _task(windows: Windows, text_col: str, out_col: str, previous: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        docs: list[list[bytes]] = []
        n = 0

        def flush():
            results, k = search_shard(docs, windows), 0
            for b in held:
                rows = []
                before = b.column(b.schema.get_field_index(out_col)).to_pylist() if previous else [None] * b.num_rows
                for old in before:
                    spans, items = results[k]
                    if old:
                        spans = _merged(spans, [(x["start"], x["end"]) for x in old["spans"]])
                        items = items | set(old["items"])
                    rows.append({"n_words": len(docs[k]), "n_hit": sum(e - s for s, e in spans), "items": sorted(items), "spans": [{"start": s, "end": e} for s, e in spans]})
                    k += 1
                keep = [i for i, f in enumerate(b.schema) if f.name != out_col or not previous]
                yield pa.RecordBatch.from_arrays([*[b.column(i) for i in keep], pa.array(rows, _ARROW)], names=[*[b.schema.field(i).name for i in keep], out_col])

        for batch in batches:
            held.append(batch)
            for text in batch.column(batch.schema.get_field_index(text_col)).to_pylist():
                docs.append(split_words(text))
                n += len(docs[-1])
            if n >= SHARD_WORDS:
                yield from flush()
                held, docs, n = [], [], 0
        yield from flush()

    return run


def _blocks(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[list[tuple[str | None, str | None]]]:
    """The items in blocks of at most BLOCK_CHARS characters, fetched one block at a time."""
    rows = benchmark.select(F.col(f"`{item_col}`").cast("string"), F.col(f"`{text_col}`"))
    block, chars = [], 0
    for item, text in rows.toLocalIterator():
        if block and chars + len(text or "") > BLOCK_CHARS:
            yield block
            block, chars = [], 0
        block.append((item, text))
        chars += len(text or "")
    if block:
        yield block


def annotate(df: DataFrame, benchmark: DataFrame, out: str, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", size: int = WINDOW) -> DataFrame:
    """df with a struct column ``out``: n_words, n_hit, items, spans (of words, end exclusive). Where df has a column of
    that name, the new one gets a number behind its name."""
    bounded_batches(df.sparkSession)
    out = free(df, out)
    schema = with_field(df.schema, out, KIND)
    result, previous = df, False
    for block in _blocks(benchmark, item_col, item_text_col):
        if previous:  # written, so that the driver holds one block at a time
            result = written(result, "decontaminate-blocks")
        result = result.mapInArrow(_task(Windows(block, size), text_col, out, previous), schema)
        previous = True
    return result if previous else df.mapInArrow(_task(Windows([], size), text_col, out, False), schema)


def contaminated(c: Column) -> Column:
    return (c["n_hit"] > 0) & (20 * c["n_hit"] >= c["n_words"])


def clean(df: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of df that aren't contaminated, with df's own columns."""
    c = fresh(df, "hits")
    return annotate(df, benchmark, c, text_col).where(~contaminated(F.col(c))).select(*[F.col(f"`{x}`") for x in df.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    c = F.col("__hits")
    return annotate(docs, benchmark, "__hits").select(
        "doc_id",
        c["n_words"].alias("n_words"),
        c["n_hit"].alias("n_hit"),
        F.size(c["items"]).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(c["items"]), ","), 256).alias("items_sha256"),
        contaminated(c).alias("contaminated"),
    )


def oracle() -> str:
    """DuckDB SQL for ``query``: windows joined by their words."""
    words = r"regexp_extract_all(translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""
WITH b AS (SELECT item_id, {words.format("text")} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id::VARCHAR AS item_id, list_slice(w, i, i + 12) AS win FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS i FROM b WHERE len(w) > 0)),
ls AS (SELECT DISTINCT len(win) AS k FROM bw),
d AS (SELECT doc_id, {words.format("text")} AS w FROM documents),
dw AS (SELECT doc_id, k, i, list_slice(w, i, i + k - 1) AS win FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ls WHERE len(w) >= k)),
o AS (SELECT DISTINCT doc_id, i, k, item_id FROM dw JOIN bw USING (win)),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT doc_id, i, k FROM o)) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id COLLATE "C") AS items FROM (SELECT DISTINCT doc_id, item_id FROM o) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN it USING (doc_id)"""
