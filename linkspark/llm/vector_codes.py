"""Vector codes: integer vectors cut into parts, each named by the nearest entry of its part's codebook.

Components become integers (floor(SCALE * x)). Codebooks are fitted in rounds: every part goes to its nearest entry
(squared Euclidean distance, ties to the lower index), then each entry becomes the componentwise floor of its parts'
mean. Tasks return sums by (part, entry, position), so what reaches the driver is as large as the codebooks, whatever
the number of vectors.

Nearest entries are screened by one float32 matrix product a part. For integers x, c of s components, |c|^2 - 2 x.c
orders the entries; the product's error is at most g |x| |c| with g = (s + 2) u / (1 - (s + 2) u), u = 2^-24 (two
roundings to float32, s of the sum in any order), so each entry has an interval that surely holds its true value.
Entries whose intervals overlap the best one's are evaluated again in int64, and ties go to the lower index.

Defined cases: vectors that are null, empty, or hold a null or non-finite component are dropped; others must have one
length, a multiple of the number of parts (ValueError). The codebooks start from the smallest ids, a null id after all
others, equal ids by their vectors; fewer vectors than entries give fewer entries, none an empty result. Components
beyond 2^26 leave int64 for whole numbers without bounds, so results stay exact; an error beyond 2^63 - 1 is given as
2^63 - 1. Repeated rows count as often as they stand. Only the named columns are used.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, hot_join, written

SCALE, PARTS, ENTRIES, ROUNDS = 256, 16, 64, 2
#: Below this magnitude, squared differences of vectors of up to 2^8 components a part stay within int64.
SMALL = 1 << 26
#: Sums travel as limbs of so many bits, which holds float32's range times SCALE.
LIMB, LIMBS = 40, 4
LONG = (1 << 63) - 1


def whole(column: pa.Array, scale: int = SCALE) -> np.ndarray:
    """A list column's vectors, all of one length and finite, as a matrix of floor(scale * x): int64, or Python
    integers where a component is too large."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    made = np.floor(flat * scale)
    made = made.astype(np.int64) if not len(made) or np.abs(made).max() < SMALL else np.array([int(v) for v in made], dtype=object)
    return made.reshape(len(column), -1)


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The index of the nearest entry of book for each row of x, the squared distance to it, and how many entries had
    to be evaluated exactly. Both hold integers."""
    n, s = x.shape
    kind = np.int64 if x.dtype != object and book.dtype != object and s <= 256 else object
    x, book = x.astype(kind), book.astype(kind)
    norm = (book * book).sum(axis=1)
    with np.errstate(over="ignore", invalid="ignore"):
        product = x.astype(np.float32) @ book.astype(np.float32).T
        length = np.sqrt((x * x).sum(axis=1).astype(np.float64)) if s else np.zeros(n)
        u = 2.0**-24
        g = (s + 2) * u / (1 - (s + 2) * u)
        norm64 = norm.astype(np.float64)
        score = norm64[None, :] - 2.0 * product.astype(np.float64)
        # Twice the product's error; float64's own roundings (of the norm, the lengths and the difference) are far
        # smaller, and have 2^-48 of the magnitudes.
        error = 2.0 * g * length[:, None] * np.sqrt(norm64)[None, :]
        error = error * (1 + 2.0**-40) + 2.0**-48 * (norm64[None, :] + 2.0 * length[:, None] * np.sqrt(norm64)[None, :])
        known = np.isfinite(product)  # beyond float32's range nothing is known of an entry, so it stays
        best = np.where(known, score + error, np.inf).min(axis=1)
        open_ = ~known | ~(score - error > best[:, None])
    row, entry = np.nonzero(open_)
    exact = ((x[row] - book[entry]) ** 2).sum(axis=1)
    # Entries rise within a row, so the first of a row's least distances is that of the lowest index.
    starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else np.zeros(0, dtype=np.int64)
    least = np.minimum.reduceat(exact, starts) if len(row) else exact
    first = np.flatnonzero(exact == np.repeat(least, np.diff(np.r_[starts, len(row)])))
    _, at = np.unique(row[first], return_index=True)
    return entry[first[at]], exact[first[at]], len(row)


def finite(df: DataFrame, vector: str) -> DataFrame:
    """df without rows whose vector is null, empty, or holds null or non-finite components."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return df.where(F.col(vector).isNotNull() & (F.size(vector) > 0) & ~F.exists(vector, bad))


def _limbs(value: int) -> list[int]:
    """value = sum of limb i times 2^(LIMB i); the last limb bears the sign."""
    out = []
    for _ in range(LIMBS - 1):
        out.append(value & ((1 << LIMB) - 1))
        value >>= LIMB
    return [*out, value]


def _sums(batches: Iterator[pa.RecordBatch], books: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """A task's sums and counts by part, entry and position."""
    parts, entries, width = len(books), len(books[0]), books[0].shape[1]
    total, count = np.zeros((parts, entries, width), dtype=object), np.zeros((parts, entries), dtype=np.int64)
    for batch in batches:
        x = whole(batch.column(0))
        for p in range(parts) if len(x) else ():
            part = x[:, p * width : (p + 1) * width]
            code, _, _ = nearest(part, books[p])
            order = np.argsort(code, kind="stable")
            used, at = np.unique(code[order], return_index=True)
            total[p, used] += np.add.reduceat(part[order], at, axis=0).astype(object)
            count[p] += np.bincount(code, minlength=entries)
    p, e, j = (a.ravel() for a in np.indices((parts, entries, width)))
    keep = count[p, e] > 0
    p, e, j = p[keep], e[keep], j[keep]
    limbs = np.array([_limbs(int(v)) for v in total[p, e, j]], dtype=np.int64).reshape(-1, LIMBS)
    names = ["p", "e", "j", "n", *[f"s{i}" for i in range(LIMBS)]]
    yield pa.RecordBatch.from_arrays([pa.array(a.astype(np.int64)) for a in (p, e, j, count[p, e], *limbs.T)], names)


def fit(df: DataFrame, id_col: str, vector: str, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> list[np.ndarray]:
    """The codebook of each part, as a matrix of whole numbers; none for a table without vectors. df: as ``finite`` leaves it."""
    first = df.select(id_col, vector).orderBy(F.col(id_col).asc_nulls_last(), F.col(vector)).limit(entries).collect()
    if not first:
        return []
    low, high = df.agg(F.min(F.size(vector)), F.max(F.size(vector))).first()
    if low != high or low % parts:
        raise ValueError(f"vectors must have one length, a multiple of {parts}; they have {low} to {high} components")
    start = whole(pa.array([r[1] for r in first], pa.list_(pa.float64())))
    width = low // parts
    books = [start[:, p * width : (p + 1) * width].copy() for p in range(parts)]
    schema = ", ".join(f"{c} long" for c in ["p", "e", "j", "n", *[f"s{i}" for i in range(LIMBS)]])
    for _ in range(rounds):
        now = books
        made = df.select(vector).mapInArrow(lambda batches: _sums(batches, now), schema)
        made = made.groupBy("p", "e", "j").agg(F.sum("n").alias("n"), *[F.sum(f"s{i}").alias(f"s{i}") for i in range(LIMBS)]).collect()
        books = [b.astype(object) for b in books]
        for r in made:
            books[r["p"]][r["e"], r["j"]] = sum(r[f"s{i}"] << (LIMB * i) for i in range(LIMBS)) // r["n"]
        books = [b.astype(np.int64) if not b.size or max(abs(int(v)) for v in b.ravel()) < SMALL else b for b in books]
    return books


def digest(books: list[np.ndarray]) -> str:
    """Of all entries' components in decimal, by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(str(int(v)) for b in books for v in b.ravel()).encode()).hexdigest()


def encode(df: DataFrame, books: list[np.ndarray], id_col: str, vector: str, others: tuple[str, ...] = ()) -> DataFrame:
    """Of each vector: its id, the columns others, ``code`` (two hex digits a part) and ``error``. df: as ``finite`` leaves it."""
    spark = df.sparkSession
    bounded_batches(spark)
    rest = df.select(F.col(id_col).alias("id"), *others, F.col(vector).alias("vector"))
    kinds = [f for f in rest.schema.fields if f.name != "vector"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kinds) + ", code string, error long"
    if not books:
        return spark.createDataFrame([], schema)
    width = books[0].shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = whole(batch.column(batch.num_columns - 1))
            error, codes = np.zeros(len(x), dtype=object), np.zeros((len(x), len(books)), dtype=np.uint8)
            for p, book in enumerate(books) if len(x) else ():
                codes[:, p], far, _ = nearest(x[:, p * width : (p + 1) * width], book)
                error += far.astype(object)
            code = pa.array([c.tobytes().hex() for c in codes], pa.string())
            error = pa.array([min(int(v), LONG) for v in error], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], code, error], [*batch.schema.names[:-1], "code", "error"])

    return rest.mapInArrow(run, schema)


def compress(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", label: str = "label", entries: int = ENTRIES) -> DataFrame:
    """A row for each vector: id, code, error, label_error (sum over its label) and the codebooks' digest."""
    bounded_batches(df.sparkSession)
    kept = finite(df, vector)
    books = fit(kept, id_col, vector, entries=entries)
    coded = written(encode(kept.select(F.col(id_col), F.col(vector), F.col(label).alias("label")), books, id_col, vector, ("label",)), "vector-codes")
    # Labels by their text, nulls by a text that no label has: a null key would find nothing.
    coded = coded.withColumn("key", F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit("")))
    sums = coded.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("error").cast("decimal(38,0)")).alias("label_error"))
    sums = sums.withColumn("label_error", F.least("label_error", F.lit(LONG).cast("decimal(38,0)")).cast("long"))
    made = hot_join(coded, sums, ["key"], "n", ["label_error"], coded.count(), F.coalesce(F.col("id").cast("string"), F.col("code")))
    return made.select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def oracle() -> str:
    """The same in whole numbers, which doubles hold exactly here; a distance and its entry make one number to be least."""
    ip = lambda a, b: f"list_inner_product({a}, {b})"

    def assigned(book: str) -> str:
        d = f"{ip('v.x', 'v.x')} - 2 * {ip('v.x', 'c.x')} + {ip('c.x', 'c.x')}"
        return f"SELECT v.rid, v.p, any_value(v.x) AS x, min(({d})::BIGINT * {ENTRIES} + c.e) AS best FROM parts v JOIN {book} c ON v.p = c.p GROUP BY v.rid, v.p"

    steps = ""
    for i in range(ROUNDS):
        steps += f"""a{i} AS MATERIALIZED ({assigned(f"c{i}")}),
        m{i} AS (SELECT p, best % {ENTRIES} AS e, j, floor(sum(x[j]) / count(*))::DOUBLE AS m FROM a{i}, (SELECT unnest(range(1, (SELECT any_value(len(x)) + 1 FROM parts))) AS j) GROUP BY ALL),
        l{i} AS (SELECT p, e, list(m ORDER BY j) AS x FROM m{i} GROUP BY p, e),
        c{i + 1} AS MATERIALIZED (SELECT c.p, c.e, coalesce(l.x, c.x) AS x FROM c{i} c LEFT JOIN l{i} l USING (p, e)),
        """
    return f"""
    WITH whole AS (
        SELECT vec_id, label, row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS rid, list_transform(embedding, lambda x: floor({SCALE} * x)::DOUBLE) AS w
        FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ), parts AS MATERIALIZED (
        SELECT rid, p, w[p * (len(w) // {PARTS}) + 1 : (p + 1) * (len(w) // {PARTS})] AS x FROM whole, (SELECT unnest(range({PARTS})) AS p)
    ), c0 AS (SELECT p, rid - 1 AS e, x FROM parts WHERE rid <= {ENTRIES}),
    {steps} last AS (SELECT rid, string_agg(printf('%02x', best % {ENTRIES}), '' ORDER BY p) AS code, sum(best // {ENTRIES})::BIGINT AS error FROM ({assigned(f"c{ROUNDS}")}) GROUP BY rid),
    books AS (SELECT sha256(string_agg(v::BIGINT::VARCHAR, ',' ORDER BY p, e, j)) AS h FROM (SELECT p, e, unnest(x) AS v, generate_subscripts(x, 1) AS j FROM c{ROUNDS}))
    SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, h AS codebooks_sha256 FROM last JOIN whole USING (rid), books
    """
