"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text: its words, pairs of neighbours, and pairs with one word between, each hashed to 40 bits and taken
once. Per-coordinate learning rates and L1 sparsity leave weights of few features, which are broadcast for scoring.
The model is fitted in one task on at most ``SAMPLE`` labelled rows (the bound is this parameter; which rows is
decided by a hash of doc_id, so alike at every size), in hash order, ``EPOCHS`` times over.

Defined cases: a null or empty text has no features and gets the score of the bias alone; with no labelled rows, or
labels of one kind, the bias is the smoothed share of label 1 and no feature has a weight. Labels that are neither 0
nor 1 are left out; of repeated labels of a document the greatest counts, of repeated texts the least. A null doc_id
is scored, never learnt from. An empty table gives an empty table. Only the named columns are used. Texts are whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches
from .decontaminate import split_words

SAMPLE = 12_000
EPOCHS = 5
BITS = 40
ALPHA, BETA, L1, L2 = 3.0, 1.0, 8.0, 0.0
#: A feature is learnt if it occurs in so many documents of the sample.
LEAST_DOCS = 3
#: Words whose hashes a worker remembers.
WORDS = 500_000

_hashes: dict[bytes, int] = {}


def _word_hashes(words: list[bytes]) -> np.ndarray:
    if len(_hashes) > WORDS:
        _hashes.clear()
    for w in set(words).difference(_hashes):
        _hashes[w] = xxhash.xxh3_64_intdigest(w)
    return np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))


def features(text: str | None) -> np.ndarray:
    """Hashed features of a text, in order of occurrence, repeats included."""
    h = _word_hashes(split_words(text))
    a, b, c = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
    mixed = np.concatenate((h * a, (h[:-1] * b) ^ (h[1:] * c), ((h[:-2] * c) ^ (h[2:] * b)) + a))
    mixed ^= mixed >> np.uint64(29)
    return (mixed * b) >> np.uint64(64 - BITS)


def fit(docs: list[np.ndarray], labels: list[int], epochs: int = EPOCHS) -> tuple[float, np.ndarray, np.ndarray]:
    """Bias, features and their weights. docs: distinct features of each document."""
    share = (sum(labels) + 1) / (len(labels) + 2)
    bias = math.log(share / (1 - share))
    if len(set(labels)) < 2:
        return bias, np.zeros(0, np.uint64), np.zeros(0)
    seen = np.zeros(1 << 24, np.uint32)  # how many documents have a feature, or more where hashes meet
    for d in docs:
        np.add.at(seen, d & np.uint64(0xFFFFFF), 1)
    docs = [d[seen[d & np.uint64(0xFFFFFF)] >= LEAST_DOCS] for d in docs]
    names, numbers = np.unique(np.concatenate(docs), return_inverse=True)
    rows = np.split(numbers, np.cumsum([len(d) for d in docs])[:-1])
    z, n = np.zeros(len(names)), np.zeros(len(names))
    bz, bn = -bias * BETA / ALPHA, 0.0

    def weights(zi: np.ndarray, ni: np.ndarray) -> np.ndarray:
        return np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(ni)) / ALPHA + L2))

    for _ in range(epochs):
        for row, label in zip(rows, labels, strict=True):
            zi, ni = z[row], n[row]
            w = weights(zi, ni)
            bias = -bz / ((BETA + math.sqrt(bn)) / ALPHA)
            g = 1 / (1 + math.exp(-max(-35.0, min(35.0, bias + float(w.sum()))))) - label
            root = np.sqrt(ni + g * g)
            z[row] = zi + g - (root - np.sqrt(ni)) / ALPHA * w
            n[row] = ni + g * g
            bz += g - (math.sqrt(bn + g * g) - math.sqrt(bn)) / ALPHA * bias
            bn += g * g
    w = weights(z, n)
    bias = -bz / ((BETA + math.sqrt(bn)) / ALPHA)
    return bias, names[w != 0], w[w != 0]


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> tuple[float, np.ndarray, np.ndarray]:
    """Fits the model on a bounded sample of the labelled rows that aren't held out."""
    named = labels.select(F.col(f"`{id_col}`").alias("i"), F.col(f"`{label}`").cast("int").alias("y"))
    named = named.where(F.col("y").isin(0, 1) & F.col("i").isNotNull() & ~held_out(F.col("i"))).groupBy("i").agg(F.max("y").alias("y"))
    chosen = named.withColumn("o", F.xxhash64("i")).orderBy("o", "i").limit(sample)  # at most ``sample`` rows are broadcast
    texts = docs.select(F.col(f"`{id_col}`").alias("i"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("t")).join(F.broadcast(chosen), "i")
    one = texts.groupBy("i", "y", "o").agg(F.min("t").alias("t")).repartition(1).sortWithinPartitions("o", "i").select("y", "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, ys = [], []
        for batch in batches:
            ys += batch.column(0).to_pylist()
            found += [np.unique(features(t)) for t in batch.column(1).to_pylist()]
        bias, names, weights = fit(found, ys)
        yield pa.RecordBatch.from_pydict({"bias": [bias], "names": pa.array([names.astype("<u8").tobytes()], pa.binary()), "weights": pa.array([weights.astype("<f8").tobytes()], pa.binary())})

    made = one.mapInArrow(run, "bias double, names binary, weights binary").collect()
    if not made:  # no labelled rows
        return fit([], [])
    return made[0]["bias"], np.frombuffer(made[0]["names"], "<u8"), np.frombuffer(made[0]["weights"], "<f8")


class Scorer:
    """Scores texts by the weights; a bitmap of the features' low bits spares most lookups."""

    def __init__(self, bias: float, names: np.ndarray, weights: np.ndarray):
        self.bias, self.names, self.weights = bias, names, weights
        self.low = np.zeros(1 << 22, bool)
        self.low[(names & np.uint64(0x3FFFFF)).astype(np.int64)] = True

    def score(self, text: str | None) -> float:
        total = self.bias
        if len(self.names):
            f = features(text)
            f = np.unique(f[self.low[(f & np.uint64(0x3FFFFF)).astype(np.int64)]])
            at = np.minimum(np.searchsorted(self.names, f), len(self.names) - 1)
            total += float(self.weights[at[self.names[at] == f]].sum())
        return 1 / (1 + math.exp(-max(-35.0, min(35.0, total))))


def score(text: Column, model: tuple[float, np.ndarray, np.ndarray], spark: SparkSession) -> Column:
    """The probability of label 1, as a column."""
    sent, made = spark.sparkContext.broadcast(model), []

    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        if not made:
            made.append(Scorer(*sent.value))
        return pd.Series([made[0].score(t) for t in texts], dtype="float64")

    return run(text)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score(F.coalesce("text", F.lit("")), model, spark).alias("score"))
    return scored.select("*", (F.col("score") >= 0.5).cast("int").alias("predicted"))
