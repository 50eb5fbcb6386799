"""Quality classifier: hierarchical empirical Bayes over documents, paths and hosts.

A logistic regression over the measures of ``quality_rules`` gives each document's evidence. Its probabilities are
summed by host and by path within host through grouped aggregation. A host's posterior mean shrinks toward the global
mean, a path's toward its host's. How much documents, paths and hosts vary is fitted by the method of moments of a
nested model: the spread of paths within hosts is freed of the documents' noise, that of hosts of the documents' noise
and of their paths' spread. So sparse sites hardly move, and where groups differ by no more than chance, none does. A
site's posterior holds all its documents, the one that it shifts among them: that one's weight is 1 / (n + prior). A document's score is its evidence shifted by how far
its path's posterior lies from the global mean, in log-odds, by ``MOST_SHIFT`` at most (a parameter).

The regression is fitted on at most ``SAMPLE`` labelled rows (the bound is this parameter; the rows are chosen by a
hash of doc_id); all sums and posteriors cover all documents.

Defined cases: null and empty texts have measures of 0; a null host or path is the empty name; without labels of both
kinds the evidence is the log-odds of the smoothed share of label 1. Of repeated labels of a document the least
counts. Repeated documents are scored one by one. An empty table gives an empty table. Only the named columns are
used. Texts are used whole. A host may hold any share of all rows: sums are taken before the shuffle, and the join
back broadcasts hot keys, which are fewer than ``HOT_SHARE``.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import quality_rules as rules
from .common import hot_join, written
from .toxicity import held_out

SAMPLE = 20_000
#: How far a site may move a document, in log-odds; a parameter of ``classify``, None for no bound.
MOST_SHIFT = 2.0


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host and first path segment of a URL, for tables that have URLs."""
    return F.coalesce(F.lower(F.try_parse_url(url, F.lit("HOST"))), F.lit("")), F.coalesce(F.regexp_extract(url, r"^[a-zA-Z]+://[^/]*/([^/?#]*)", 1), F.lit(""))


def vector(c: Column) -> list[Column]:
    """What the regression sees of a document: bounded ratios, and which rules of the table hold."""
    ratio = {k: f(c) for k, f in rules.RATIOS.items()}
    out = [F.log1p(ratio["n_words"]) / 10, F.least(ratio["mean_word_chars"], F.lit(30.0)) / 10]
    out += [F.least(ratio[k], F.lit(2.0)) for k in ("symbols_per_word", "marks_per_word", "stop_word_share", "dup_line_share", "dup_char_share", "repeat_word_share")]
    return out + [rules.compile_rules(c, [r]).cast("double") for r in rules.RULES]


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Weights of a logistic regression, the bias last, by Newton's method with a ridge on all but the bias."""
    share = (y.sum() + 1) / (len(y) + 2)
    w = np.zeros(x.shape[1] + 1)
    w[-1] = math.log(share / (1 - share))
    if len(set(y.tolist())) < 2:
        return w
    x = np.hstack((x, np.ones((len(x), 1))))
    penalty = np.diag([*[ridge] * (x.shape[1] - 1), 1e-6])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def variances(n: float, paths: float, hosts: float, within: float, between_paths: float, between_hosts: float, p2: float, p2_host: float, h2: float) -> tuple[float, float, float]:
    """The variances of documents within paths, of paths within hosts and of hosts, none below 0, by the method of moments:
    each sum of squares less what the lower levels lead one to expect of it. n: documents; within, between_paths,
    between_hosts: sums of squares around path, host and global means, by documents; p2: sum of squared path sizes,
    p2_host: the same over the size of their host, h2: sum of squared host sizes."""
    noise = within / (n - paths) if n > paths else 0.0
    path = max(0.0, between_paths - (paths - hosts) * noise) / (n - p2_host) if n - p2_host > 1e-9 else 0.0
    host = max(0.0, between_hosts - (hosts - 1) * noise - path * (p2_host - p2 / n)) / (n - h2 / n) if n and n - h2 / n > 1e-9 else 0.0
    return noise, path, host


def _shrunk(prior: Column, mean: Column, own: float, noise: Column) -> Column:
    """prior moved toward mean by own, the variance of what mean stands for, over it and the variance of mean around it."""
    return prior if own <= 0 else prior + own / (own + noise) * (mean - prior)


def _logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(p / (1 - p))


def classify(docs: DataFrame, labels: DataFrame, host: Column, path: Column, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, most_shift: float | None = MOST_SHIFT) -> DataFrame:
    """doc_id, held_out, evidence, host_posterior, path_posterior, score, predicted."""
    c = F.col("__c")
    measured = rules.measure(docs.select(F.col(f"`{id_col}`").alias("doc_id"), host.alias("host"), path.alias("path"), F.col(f"`{text_col}`").alias("__t")), "__t", "__c")
    rows = written(measured.select("doc_id", F.coalesce("host", F.lit("")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), F.array(*vector(c)).alias("x")), "quality-measures")
    known = labels.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{label}`").cast("int").alias("y"))
    known = known.where(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("y").alias("y"))
    chosen = known.withColumn("o", F.xxhash64("doc_id")).orderBy("o", "doc_id").limit(sample)  # at most ``sample`` rows are broadcast
    seen = rows.select("doc_id", "x").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(F.min("x").alias("x")).select("x", "y").collect()
    n = len(rules.RATIOS) + len(rules.RULES)
    w = fit(np.array([r["x"] for r in seen], float).reshape(len(seen), n), np.array([r["y"] for r in seen], float))
    evidence = sum((F.get("x", F.lit(i)) * float(w[i]) for i in range(n)), F.lit(float(w[-1])))
    scored = rows.select("doc_id", "host", "path", evidence.alias("evidence")).withColumn("p", 1 / (1 + F.exp(-F.col("evidence"))))
    by_path = scored.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum("p").alias("s"), F.sum(F.col("p") ** 2).alias("q"))
    by_path = written(by_path, "quality-paths")
    by_host = by_path.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("s").alias("hs"), F.sum(F.col("n") ** 2).alias("p2"))
    # One row each: sums over sites.
    g = by_path.agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum(F.col("s") ** 2 / F.col("n")).alias("m"), F.count(F.lit(1)).alias("paths")).first()
    h = by_host.agg(F.sum(F.col("hs") ** 2 / F.col("hn")).alias("m"), F.count(F.lit(1)).alias("hosts"), F.sum("p2").alias("p2"), F.sum(F.col("p2") / F.col("hn")).alias("p2_host"), F.sum(F.col("hn") ** 2).alias("h2")).first()
    total = g["n"] or 0
    mean = min(1 - 1e-6, max(1e-6, g["s"] / total)) if total else 0.5
    noise, of_path, of_host = 0.0, 0.0, 0.0
    if total:
        squares = max(0.0, g["q"] - g["m"]), max(0.0, g["m"] - h["m"]), max(0.0, h["m"] - g["s"] ** 2 / total)
        noise, of_path, of_host = variances(total, g["paths"], h["hosts"], *squares, h["p2"], h["p2_host"], h["h2"])
    around = of_path * F.col("p2") / F.col("hn") ** 2 + noise / F.col("hn")
    hosts = by_host.select("host", _shrunk(F.lit(mean), F.col("hs") / F.col("hn"), of_host, around).alias("host_posterior"))
    paths = by_path.join(hosts, "host")
    paths = paths.select("host", "path", "n", "host_posterior", _shrunk(F.col("host_posterior"), F.col("s") / F.col("n"), of_path, F.lit(noise) / F.col("n")).alias("path_posterior"))
    joined = hot_join(scored.select("doc_id", "host", "path", "evidence"), paths, ["host", "path"], "n", ["host_posterior", "path_posterior"], total, F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    shift = _logit(F.col("path_posterior")) - math.log(mean / (1 - mean))
    if most_shift is not None:
        shift = F.least(F.greatest(shift, F.lit(-most_shift)), F.lit(most_shift))
    out = joined.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "evidence", "host_posterior", "path_posterior", (1 / (1 + F.exp(-(F.col("evidence") + shift)))).alias("score"))
    return out.select("*", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over ``documents``: a document's source is its host, and its language the path within it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    out = classify(docs, labels, F.col("source"), F.col("lang"))
    return out.select("*", (F.col("predicted") == 1).alias("kept"))
