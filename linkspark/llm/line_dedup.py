"""Line dedup by a log-template tree.

A line's tokens are its words; a token with a digit is a variable field, written ``<*>``. Where more than half of the
tokens would be fields (rows of numbers), the line stands for itself: it is compared by its own text alone. The tree is
of fixed depth: by the number of tokens, then by the first ``DEPTH`` tokens. In a leaf, the places behind these are cut
into at most ``PARTS`` parts, and two lines are of one template when they agree in all places but those of one or two
parts, these parts are at most 1 - ``SIMILAR`` of all places, and enough of the tokens in which they agree are fixed
(``LEAST_FIXED`` and half of all at least). A template is a component of such links; places that differ in it are
variable fields. So what is one template depends on the lines alone, not on their order or on who meets whom, and a
link is one equal key: the hash of a line without the parts.

A template recurs when lines of it occur in ``LEAST_DOCS`` documents or more; of lines of ``LONG_TOKENS`` tokens or
more, which are no mere formulas, two documents (``LONG_DOCS``) suffice. Its lines are dropped from all documents
but the one of the smallest doc_id, so one occurrence of everything stays. Lines of fewer than ``LEAST_TOKENS`` tokens
are left alone.

Identical lines are counted before the shuffle, so a line in a third of all documents costs one row per task; joins
back to the documents go by ``hot_join``. A leaf of up to ``BLOCK_LINES`` distinct lines is one task's. A larger one is dealt out in
blocks; each finds its own components, and blocks are linked through the keys, of which a block gives each once for a
component. The result is the same at every size of block.

Defined cases: a null text stays null, an empty text stays empty; a text whose lines are all dropped becomes empty,
and its row stays. A line repeated within one document counts once for it; such repeats are dropped or kept together.
Rows with equal doc_ids count as one document. Null doc_ids count as one document too, and never are the one that
keeps a template. Empty tables give empty tables. Extra columns pass through. Texts are used whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bit_map, bounded_batches, discard, drop_shuffles_early, fresh, hot_join, in_map, let, written
from .ngram_join import components

DEPTH = 3
SIMILAR = 0.75
LEAST_FIXED = 5
LEAST_DOCS = 3
LONG_DOCS = 2
LONG_TOKENS = 20
LEAST_TOKENS = 3
FIELD = "<*>"
#: Parts of the places behind the leading tokens.
PARTS = 8
#: Distinct lines of a leaf that one task compares at once; beyond it, a leaf is dealt out. Affects no result.
BLOCK_LINES = 20_000
#: Up to so many lines are compared pair by pair, more by their keys.
FEW = 24


def _squeezed(line: Column) -> Column:
    return F.trim(F.when(line.rlike(r"\s\s|[^\S ]"), F.regexp_replace(line, r"\s+", " ")).otherwise(line))


def masked(line: Column) -> Column:
    """The line with variable fields for tokens that hold a digit, and single spaces; without fields where they would be
    more than half of the tokens. Only lines that need it are rewritten."""
    fields = F.regexp_replace(line, r"(?<!\S)\S*?\d\S*", FIELD)
    most = lambda x: 2 * (F.length(x) - F.length(F.replace(x, F.lit(FIELD), F.lit("")))) > len(FIELD) * n_tokens(x)
    return F.when(line.rlike(r"\d"), let(_squeezed(fields), lambda x: F.when(most(x), _squeezed(line)).otherwise(x))).otherwise(let(line, _squeezed))


def n_tokens(line: Column) -> Column:
    """The number of tokens of a masked line."""
    return F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))) + 1


def occurrences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, row (a hash of id and text), at, line (masked), n (tokens), h and g (hashes of n and line), leaf (a hash)
    of lines with enough tokens, written once for all that follows."""
    i, t = F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`")
    # Masked before the lines are dealt out, so that a filter on the result doesn't do it again.
    lines = docs.select(i.alias("doc_id"), _row(id_col, text_col).alias("row"), F.posexplode(F.transform(F.split(t, "\n", -1), lambda x: masked(x))).alias("at", "line"))
    lines = lines.withColumn("n", n_tokens(F.col("line"))).where(F.col("n") >= LEAST_TOKENS)
    return written(lines.select("*", F.xxhash64("n", "line").alias("h"), F.xxhash64("line", "n").alias("g"), F.xxhash64("n", _lead()).alias("leaf")), "line-occurrences")


def _lead() -> Column:
    return F.substring_index("line", " ", DEPTH)


def _row(id_col: str, text_col: str) -> Column:
    return F.xxhash64(F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`"))


@lru_cache(maxsize=4096)
def plan(width: int) -> tuple[list[int], list[tuple[int, ...]], int]:
    """Of lines of so many tokens: where their parts begin and end, the sets of parts in which two lines of a template may
    differ, and how many fixed tokens they must agree in."""
    rest = width - DEPTH
    parts = min(PARTS, max(rest, 0))
    bounds = [DEPTH + rest * i // parts for i in range(parts + 1)] if parts else [width]
    most = math.floor((1 - SIMILAR) * width + 1e-9)
    size = lambda i: bounds[i + 1] - bounds[i]
    sets: list[tuple[int, ...]] = [(i, j) for i in range(parts) for j in range(i + 1, parts) if size(i) + size(j) <= most]
    sets += [(i,) for i in range(parts) if size(i) <= most and not any(i in s for s in sets)]
    return bounds, sets, max(LEAST_FIXED, -(-width // 2))


def is_fixed(token: str) -> bool:
    return token != FIELD and not any(c.isdigit() for c in token)


def line_keys(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Of the lines of a leaf: a key for each set of parts, which two lines have in common just if they differ in no other part, and
    whether it counts."""
    words = [x.split(" ") for x in lines]
    bounds, sets, need = plan(len(words[0]))
    known: dict[str, tuple[int, bool]] = {}
    for w in words:
        for t in w:
            if t not in known:
                known[t] = (xxhash.xxh3_64_intdigest(t), is_fixed(t))
    grid = np.array([[known[t][0] for t in w] for w in words], dtype=np.uint64)
    fixed = np.array([[known[t][1] for t in w] for w in words], dtype=np.int64)

    def mixed(x: np.ndarray) -> np.ndarray:
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        return x ^ (x >> np.uint64(29))

    part = []
    for i, (a, b) in enumerate(zip(bounds, bounds[1:])):
        h = np.full(len(lines), i + 1, dtype=np.uint64)
        for p in range(a, b):
            h = mixed(h * np.uint64(0xD6E8FEB86659FD93) + grid[:, p])
        part.append(h)
    lead = np.uint64(xxhash.xxh3_64_intdigest(f"{len(words[0])} " + " ".join(words[0][:DEPTH])))
    total, count = np.sum(part, axis=0, dtype=np.uint64) if part else np.zeros(len(lines), np.uint64), fixed.sum(axis=1)
    keys, counts = np.empty((len(lines), len(sets)), np.uint64), np.empty((len(lines), len(sets)), bool)
    for k, s in enumerate(sets):
        without = np.sum([part[i] for i in s], axis=0, dtype=np.uint64)
        keys[:, k] = mixed((total - without) ^ (lead + np.uint64(k + 1)))
        counts[:, k] = count - sum(fixed[:, bounds[i] : bounds[i + 1]].sum(axis=1) for i in s) >= need
    return keys, counts


def _by_pairs(lines: list[str]) -> list[int]:
    """Of few lines: the number of the first line of each one's component."""
    words = [x.split(" ") for x in lines]
    bounds, sets, need = plan(len(words[0]))
    spans = list(zip(bounds, bounds[1:]))
    parts = [[w[a:b] for a, b in spans] for w in words]
    fixed = [[sum(map(is_fixed, p)) for p in own] for own in parts]
    total = [sum(f) + sum(map(is_fixed, w[:DEPTH])) for f, w in zip(fixed, words)]
    root = list(range(len(lines)))

    def top(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(lines)):
        for j in range(i):
            differ = [k for k, (x, y) in enumerate(zip(parts[i], parts[j])) if x != y]
            if len(differ) <= 2 and any(all(k in s for k in differ) and total[i] - sum(fixed[i][k] for k in s) >= need for s in sets):
                a, b = top(i), top(j)
                root[max(a, b)] = min(a, b)
    return [top(i) for i in range(len(lines))]


def _by_keys(keys: np.ndarray, counts: np.ndarray) -> list[int]:
    """The same from keys: each line takes the least number of all that share a key with it, until nothing changes."""
    root = np.arange(len(keys))
    groups = []
    for k in range(keys.shape[1]):
        at = np.flatnonzero(counts[:, k])
        if len(at) > 1:
            found = np.unique(keys[at, k], return_inverse=True)[1]
            groups.append((at, found, found.max() + 1))
    while True:
        before = root.copy()
        for at, found, n in groups:
            least = np.full(n, len(root))
            np.minimum.at(least, found, root[at])
            root[at] = least[found]
        if (before == root).all():
            return root.tolist()


def templates(lines: list[str], made: tuple[np.ndarray, np.ndarray] | None = None) -> list[tuple[str, list[int]]]:
    """The templates of a leaf's distinct lines, all of one token count and one lead: each with the numbers of its lines.
    made: the lines' keys, if they are at hand."""
    if len(lines) == 1 or not plan(lines[0].count(" ") + 1)[1]:
        return [(x, [i]) for i, x in enumerate(lines)]
    roots = _by_pairs(lines) if len(lines) <= FEW and made is None else _by_keys(*(made or line_keys(lines)))
    members: dict[int, list[int]] = {}
    for i, r in enumerate(roots):
        members.setdefault(r, []).append(i)
    out = []
    for own in members.values():
        columns = zip(*(lines[i].split(" ") for i in own)) if len(own) > 1 else [(t,) for t in lines[own[0]].split(" ")]
        out.append((" ".join(c[0] if all(t == c[0] for t in c) else FIELD for c in columns), own))
    return out


def _least(n: int, least_docs: int) -> int:
    return min(LONG_DOCS, least_docs) if n >= LONG_TOKENS else least_docs


def _leaves(least_docs: int):
    """From (n, lead, block, whole, line, docs) sorted by the first three: (line, docs, template, least, keys) of the lines of a leaf or block,
    with the number of documents that their template needs to recur. Of whole leaves only lines of templates that may
    recur, and no keys."""
    kind = pa.schema([("line", pa.string()), ("docs", pa.int64()), ("template", pa.string()), ("least", pa.int32()), ("own", pa.int64()), ("keys", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, whole, lines, docs = None, True, [], []
        out: list[tuple] = []

        def close() -> None:
            if not lines:
                return
            least = _least(key[0], least_docs)
            if whole:
                if sum(docs) >= least:
                    for name, own in templates(lines):
                        n = sum(docs[i] for i in own)
                        if n >= least:
                            out.extend((lines[i], docs[i], named(name, own), least, n, None) for i in own)
                return
            keys, counts = line_keys(lines)
            signed = keys.view(np.int64)
            for name, own in templates(lines, (keys, counts)):
                n = sum(docs[i] for i in own)
                out.extend((lines[i], docs[i], named(name, own), least, n, signed[i][counts[i]].tolist()) for i in own)

        def named(name: str, own: list[int]) -> str:
            """A name that no other template has: patterns of two may be alike."""
            return name if len(own) == 1 else f"{min(lines[i] for i in own)}\n{name}"

        def made() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), kind, strict=True)], schema=kind)
            out.clear()
            return batch

        for b in batches:
            for n, lead, block, all_, line, d in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if (n, lead, block) != key:
                    close()
                    key, whole, lines, docs = (n, lead, block), all_, [], []
                lines.append(line)
                docs.append(d)
            if len(out) >= 1000:
                yield made()
        close()
        if out:
            yield made()

    return run


def recurring(found: DataFrame, least_docs: int = LEAST_DOCS, block_lines: int = BLOCK_LINES) -> DataFrame:
    """From occurrences in leaves that may have a template: line, docs (occurrences, which are no fewer than documents),
    template (a name for it) and least."""
    spark = found.sparkSession
    each = found.select("leaf", F.xxhash64("line").alias("h")).groupBy("leaf", "h").agg(F.count(F.lit(1)).alias("n"))
    large = written(each.groupBy("leaf").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("n")).where(F.col("c") > block_lines), "line-leaves")
    several = not large.isEmpty()
    lines = found.select("n", "line", "leaf", F.lit(1).cast("long").alias("docs"))
    if several:
        lines = hot_join(lines, large.withColumnRenamed("n", "rows"), ["leaf"], "rows", ["c"], found.count(), F.xxhash64("line").cast("string"))
        block = F.coalesce(F.pmod(F.xxhash64("line", F.lit(0)), F.ceil(F.col("c") / block_lines)), F.lit(0)).cast("int")
        lines = lines.withColumns({"block": block, "whole": F.col("c").isNull()})
    else:
        lines = lines.withColumns({"block": F.lit(0), "whole": F.lit(True)})
    counted = lines.groupBy("n", "leaf", "block", "whole", "line").agg(F.sum("docs").alias("docs"))
    rows = counted.select(F.col("n").cast("int").alias("n"), _lead().alias("lead"), "block", "whole", "line", "docs")
    kinds = "line string, docs long, template string, least int, own long, keys array<long>"
    made = rows.repartition("n", "lead", "block").sortWithinPartitions("n", "lead", "block").mapInArrow(_leaves(least_docs), kinds)
    if not several:
        return made.select("line", "docs", "template", "least")
    made = written(made.withColumn("c", F.xxhash64("template")), "line-blocks")
    # A block has each key for one of its components only, so a key has as many rows as there are blocks at most.
    keyed = made.where("keys IS NOT NULL").select("c", F.explode("keys").alias("key")).distinct()
    least = keyed.groupBy("key").agg(F.min("c").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    edges = keyed.join(least, "key").where("c != first").select(F.col("c").alias("a"), F.col("first").alias("b"))
    roots = components(edges).select(F.col("cls").alias("c"), "root")
    roots = roots.unionByName(roots.select(F.col("root").alias("c"), "root").distinct())
    joined = made.join(roots, "c", "left").where((F.col("root").isNotNull()) | (F.col("own") >= 2))
    return joined.select("line", "docs", F.coalesce("root", "c").cast("string").alias("template"), "least")


def dropped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_docs: int = LEAST_DOCS, block_lines: int = BLOCK_LINES) -> DataFrame:
    """doc_id, row, and the places (an array) of the lines that go."""
    spark = docs.sparkSession
    bounded_batches(spark)
    drop_shuffles_early(spark)
    every = occurrences(docs, id_col, text_col)
    # Leaves of a single occurrence have no template; most lines of prose are in such.
    leaves = every.groupBy("leaf").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") >= min(least_docs, LONG_DOCS))
    joined, may = in_map(every, written(bit_map(leaves, "leaf"), "line-map"), F.col("leaf"))
    live = joined.where(may).select(*every.columns)
    found = written(recurring(live.select("n", "line", "leaf"), least_docs, block_lines), "line-templates")
    n = (F.length("line") - F.length(F.replace("line", F.lit(" "), F.lit(""))) + 1).alias("n")
    keyed = found.select("line", n, "docs", "template", "least").select(F.xxhash64("n", "line").alias("h"), F.xxhash64("line", "n").alias("g"), "docs", F.xxhash64("template").alias("t"), F.xxhash64("template", F.lit(1)).alias("u"), "least")
    spread = F.concat_ws(":", F.col("row").cast("string"), F.col("at").cast("string"))
    total = found.agg(F.sum("docs")).first()[0] or 0
    matched = written(hot_join(live.select("doc_id", "row", "at", "h", "g"), keyed, ["h", "g"], "docs", ["t", "u", "least"], total, spread).where("t IS NOT NULL").select("doc_id", "row", "at", "t", "u", "least"), "line-matches")
    # Documents by template: a row for each document first, then counts of those rows.
    by_doc = matched.groupBy("t", "u", "doc_id").agg(F.count(F.lit(1)).alias("n"), F.first("least").alias("least"))
    kept = by_doc.groupBy("t", "u").agg(F.count(F.lit(1)).alias("docs"), F.min("doc_id").alias("keeper"), F.sum("n").alias("n"), F.first("least").alias("least")).where(F.col("docs") >= F.col("least"))
    judged = hot_join(matched.drop("least"), kept.withColumn("recurs", F.lit(True)), ["t", "u"], "n", ["keeper", "recurs"], total, spread)
    gone = judged.where(F.col("recurs") & ~F.col("doc_id").eqNullSafe(F.col("keeper")))
    out = written(gone.groupBy("doc_id", "row").agg(F.array_sort(F.collect_set("at")).alias("gone")), "line-drops")
    discard(every, found, matched)
    return out


def drop_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_docs: int = LEAST_DOCS, n_lines: str | None = None, n_dropped: str | None = None) -> DataFrame:
    """docs with recurring lines dropped from the text; on request, two more columns with the counts of lines."""
    gone, row, mine, doc = (fresh(docs, f"line_{x}") for x in ("gone", "row", "of", "doc"))
    drops = dropped(docs, id_col, text_col, least_docs).select(F.col("row").alias(mine), F.col("doc_id").alias(doc), F.col("gone").alias(gone))
    i, t = F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`")
    # Only documents that may lose a line are shuffled to be joined with what goes.
    told, may = in_map(docs.withColumn(row, _row(id_col, text_col)), written(bit_map(drops, mine), "line-map"), F.col(row))
    told = told.select(*docs.columns, row, may.alias(mine))
    joined = told.where(F.col(mine)).drop(mine).join(drops.hint("merge"), (F.col(row) == F.col(mine)) & i.eqNullSafe(F.col(doc)), "left")
    same = told.where(~F.col(mine)).withColumn(gone, F.lit(None).cast("array<int>"))
    every = joined.select(*docs.columns, gone).unionByName(same.select(*docs.columns, gone))
    lines = F.split(t, "\n", -1)
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(gone))
    kept = let(lines, lambda x: F.array_join(F.transform(left, lambda k: F.get(x, k)), "\n"))
    text = F.when(F.col(gone).isNull(), t).otherwise(kept)
    more = [F.coalesce(F.size(lines), F.lit(0)).cast("long").alias(n_lines)] if n_lines else []
    more += [F.coalesce(F.size(gone), F.lit(0)).cast("long").alias(n_dropped)] if n_dropped else []
    return every.select(*[text.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns], *more)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return drop_lines(docs, n_lines="n_lines", n_dropped="n_dropped")
