"""Pairs are scored where the join finds them: none is shuffled, and titles meet only within a matched author."""

import pytest
from pyspark.sql import functions as F

from linkspark.operators import evaluate as ev
from linkspark.operators import linkage as lk


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def written(df, path):
    df.write.parquet(str(path))
    return df.sparkSession.read.parquet(str(path))


@pytest.fixture(scope="module")
def sides(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("sides")
    raw = spark.createDataFrame([(1, 0, "anna berg"), (2, 0, "berg anna"), (3, 0, "anna bergen"), (4, 0, "otto")], "rec int, ord int, raw string")
    variants = spark.createDataFrame([("u1", "lat", 0, "Anna Berg"), ("u2", "lat", 0, "Anna Bergson"), ("u3", "lat", 0, "Otto")], "uri string, script string, ord int, variant string")
    return written(raw, at / "raw"), written(variants, at / "variants")


def test_no_scored_pair_is_shuffled(sides):
    """F8, F9: links may be many more than records, so nothing is exchanged or joined after the ratio."""
    links = lk.title_stage(*sides)
    above = plan(links).split("ArrowEvalPython")
    assert len(above) == 2 and "Exchange" not in above[0] and "Join" not in above[0]
    assert {(r["rec"], r["uri"]) for r in links.collect()} >= {(1, "u1"), (2, "u1"), (3, "u1"), (3, "u2"), (4, "u3")}


def test_records_of_several_candidates_keep_the_best(spark, sides):
    raw = sides[0].union(spark.createDataFrame([(1, 1, "anna bergson")], sides[0].schema))
    got = {(r["rec"], r["uri"]): r["score"] for r in lk.title_stage(raw, sides[1]).collect()}
    alone = {(r["rec"], r["uri"]): r["score"] for r in lk.title_stage(sides[0], sides[1]).collect()}
    assert len(got) == len(set(got)) and got[1, "u1"] == alone[1, "u1"] and got[1, "u2"] >= alone[3, "u2"]


def test_titles_meet_within_an_author(spark, tmp_path):
    """the author is a part of every join that forms pairs of titles."""
    raw = lambda rows: spark.createDataFrame(rows, "rec int, script string, raw string")
    variants = lambda rows: spark.createDataFrame(rows, "uri string, script string, variant string")
    books = spark.createDataFrame([("b1", "a1"), ("b2", "a2"), ("b3", None)], "uri string, author_uri string")
    made = lk.raw_matches(raw([(1, "lat", "Lund"), (2, "lat", "Oslo")]), variants([("a1", "lat", "Lund"), ("a2", "lat", "Bergen")]), raw([(1, "lat", "anna"), (2, "lat", "anna")]), variants([("b1", "lat", "anna"), ("b2", "lat", "anna"), ("b3", "lat", "anna")]), books, 0.8, 0.8, keep=lambda df, name: written(df, tmp_path / name))
    joins = [line for line in plan(made).splitlines() if "Join" in line and "__kl_at" in line and "author" in line]
    assert len(joins) >= 2
    assert [(r["rec"], r["book"], r["author"]) for r in made.collect()] == [(1, "b1", "a1")]


def test_sweep_takes_marked_hits(spark):
    """pairs that carry their hit give what those joined with the truth give."""
    scored = spark.createDataFrame([(1, "x", 0.9, 0.7), (1, "y", 0.7, 0.9), (1, "z", 0.9, 0.9), (2, "x", 0.8, 0.8), (3, "q", 0.9, 0.9)], "rec int, book string, author_score double, title_score double")
    truth = spark.createDataFrame([(1, "x"), (1, "y"), (2, "x"), (3, "r")], "rec int, book string")
    grid = spark.createDataFrame([(a, t) for a in (0.7, 0.9) for t in (0.7, 0.9)], "author_threshold double, title_threshold double")
    marked = scored.withColumn("hit", F.concat("rec", "book").isin("1x", "1y", "2x"))
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(ev.sweep(marked, truth, grid)) == rows(ev.sweep(scored, truth, grid))
    assert "hit" in ev.boosted(scored.selectExpr("rec", "book", "author_score author_raw", "0d author_rare", "title_score title_raw", "0d title_comb", "true hit"), spark.createDataFrame([("n", 1.0, 0.0, 1.0, 0.0)], "label string, author_scale double, author_boost double, title_scale double, title_boost double")).columns
