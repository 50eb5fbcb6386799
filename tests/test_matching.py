"""Joins on what pairs must share, and the best-match search, against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from linkspark.functions import similarity as sim
from linkspark.operators import linkage as lk
from linkspark.operators import pairing, search

RNG = random.Random(8)
WORDS = ["".join(RNG.choice("abcdeé") for _ in range(RNG.randint(1, 6))) for _ in range(50)] + ["ibn"] * 25 + ["al", "ß", "字字", "o'c"]


def name():
    return " ".join(RNG.choice(WORDS) for _ in range(RNG.randint(1, 4)))


def typo(text):
    k = RNG.randrange(len(text))
    return text[:k] + RNG.choice(["", "x", "a"]) + text[k + 1 :]


@pytest.fixture(scope="module")
def tables(spark):
    """Names of which a third have one token, copies, typos, empty ones, and a long one."""
    targets = [name() for _ in range(120)] + ["ibn", "ibn ibn", " ".join(WORDS[:40])]
    names = [name() for _ in range(60)] + [typo(t) for t in targets[:60]] + targets[60:90] + ["ibn", "", "-", "zzz", "ibn " + " ".join(WORDS[:40])]
    raw = spark.createDataFrame([(i, 0, n) for i, n in enumerate(names)], "rec int, ord int, raw string")
    variants = spark.createDataFrame([(f"u{i:03}", "lat", 0, t) for i, t in enumerate(targets)], "uri string, script string, ord int, variant string")
    return lk.candidates(raw).cache(), lk.targets(variants).cache()


def all_pairs(cands, made):
    left = cands.select("cand").distinct().select("cand", sim.processed_tokens(F.col("cand")).alias("c"), lk.tokens(F.col("cand")).alias("ct"))
    return left.crossJoin(made.select("uri", "proc", "toks")).withColumn("raw", sim.token_set_ratio_of(F.col("c"), F.col("proc"))).collect()


@pytest.mark.parametrize("split", [pairing.SPLIT, 15])
@pytest.mark.parametrize("threshold", [0.9, 0.8, 0.5])
@pytest.mark.parametrize("weighted", [True, False])
def test_score_pairs_loses_none(tables, split, threshold, weighted, monkeypatch):
    monkeypatch.setattr(pairing, "SPLIT", split)
    cands, made = tables
    idf = lk.idf_weights(made)
    got = {(r["cand"], r["uri"]): (r["raw"], round(r["comb"], 9), round(r["rare"], 9)) for r in lk.score_pairs(cands, made, idf, threshold, 15.0, 0.3, 2.0, weighted).collect()}
    weight, expected = {r["token"]: r["idf"] for r in idf.collect()}, {}
    for r in all_pairs(cands, made):
        shared = [weight[t] for t in set(r["ct"]) & set(r["toks"])] if weighted else []
        comb, rare = sum(shared), sum(x for x in shared if x >= 2.0)
        if (shared or not weighted) and r["raw"] * (1 + min(comb / 15, 0.3) if weighted else 1) >= threshold * 100:
            expected[r["cand"], r["uri"]] = (r["raw"], round(comb, 9), round(rare, 9))
    assert got == expected and len(got) > 40


def test_no_pairs_of_all_with_all(tables, spark):
    cands, made = tables
    plan = lk.score_pairs(cands, made, lk.idf_weights(made), 0.8, 15.0, 0.3, 2.0, False)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and not any("Join" in line and "Cross" in line and "__t" not in line and "agg" in line for line in plan.splitlines())


@pytest.mark.parametrize("blocks", [(10**9, 10**9), (150, 90)])
def test_best_matches(tables, blocks):
    """The best of all targets, in blocks of any size; few pairs are evaluated."""
    cands, made = tables
    queries = cands.select(F.col("cand").alias("text"), F.lit("lat").alias("script")).union(cands.limit(1).select(F.lit("ibn zzz"), F.lit("ara")))
    got = {r["text"]: (r["score"], r["uri"], r["scored"]) for r in search.best_matches(queries, made.select("uri", "script", "norm"), *blocks).collect()}
    expected, pairs = {}, all_pairs(cands, made)
    for r in pairs:
        best = expected.get(r["cand"])
        if r["raw"] > 0 and (best is None or (-r["raw"], r["uri"]) < (-best[0], best[1])):
            expected[r["cand"]] = (r["raw"], r["uri"])
    assert {k: v[:2] for k, v in got.items()} == expected
    if blocks[0] > 1000:
        assert sum(v[2] for v in got.values()) < len(pairs) / 4


def test_raw_matches(spark):
    """Both scripts; any variant counts by itself; no token needs to be shared."""
    raw = lambda rows: spark.createDataFrame(rows, "rec string, script string, raw string")
    variants = spark.createDataFrame([("a1", "lat", "Tabari"), ("a1", "ara", "الطبري"), ("a2", "lat", "Nadim")], "uri string, script string, variant string")
    titles = spark.createDataFrame([("b1", "lat", "Tarikh"), ("b1", "lat", "Annals of prophets"), ("b2", "lat", "Fihrist"), ("b1", "ara", "تاريخ")], "uri string, script string, variant string")
    books = spark.createDataFrame([("b1", "a1"), ("b2", "a2")], "uri string, author_uri string")
    authors_raw = raw([("r1", "lat", "Tabary"), ("r2", "ara", "الطبري"), ("r3", "lat", "الطبري"), ("r4", "lat", "Nadim")])
    titles_raw = raw([("r1", "lat", "Annals of prophet"), ("r2", "ara", "تاريخ"), ("r3", "lat", "Tarikh"), ("r4", "lat", "Tarikh")])
    got = lk.raw_matches(authors_raw, variants, titles_raw, titles, books, 0.8, 0.8).collect()
    assert sorted((r["rec"], r["book"], r["author"]) for r in got) == [("r1", "b1", "a1"), ("r2", "b1", "a1")]
