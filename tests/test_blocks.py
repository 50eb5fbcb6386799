"""Pairs scored in blocks give what pairs scored one by one give, in pieces and tasks of any size."""

import random

import pytest
from pyspark.sql import functions as F

from linkspark.config import LinkConfig
from linkspark.operators import blocks, pairing
from linkspark.operators import linkage as lk
from linkspark.plans import match_catalog

CONFIG = LinkConfig(title_threshold=0.75)


def names(seed, many):
    rng = random.Random(seed)
    syllables = ["an", "na", "jo", "el", "ma", "ri", "ʿa", "ström"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 3)))
    odd = ["jr", "j.", "o'an", "", "a-b", "x" * 70, " ".join(["an", "el", "jo", "ma", "na", "ri", "elan"]), "anna annaan " + "berg" * 30, "ż anna"]
    return [rng.choice(odd) if rng.random() < 0.1 else " ".join(word() for _ in range(rng.randint(1, 3))) for _ in range(many)]


@pytest.fixture(scope="module")
def sides(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("blocks")

    def written(rows, schema, name):
        spark.createDataFrame(rows, schema).write.parquet(str(at / name))
        return spark.read.parquet(str(at / name))

    raw = [(i, 0, n) for i, n in enumerate(names(1, 300) + ["anna"] * 20)]
    variants = [(f"u{i}", "lat", 0, n) for i, n in enumerate(names(2, 200) + ["Anna"] * 9)]
    return written(raw, "rec long, ord int, raw string", "raw"), written(variants, "uri string, script string, ord int, variant string", "variants")


@pytest.fixture(params=["whole", "pieces"])
def cut(request, monkeypatch):
    if request.param == "pieces":
        for name, value in (("SHARE", 4), ("PIECE", 7), ("TASK", 20_000), ("CHUNK", 50), ("MASKS", 4000)):
            monkeypatch.setattr(blocks, name, value)


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_links(sides, cut):
    """also records of several candidates, and books of two scripts."""
    expected = rows(lk.title_stage(*sides, CONFIG))
    assert rows(blocks.title_links(*sides, CONFIG)) == expected and len(expected) > 500
    raw = sides[0].union(sides[0].selectExpr("rec + 1", "1", "raw"))
    variants = sides[1].union(sides[1].where("uri < 'u3'").selectExpr("uri", "'ara'", "1", "reverse(variant)"))
    assert rows(blocks.title_links(raw, variants, CONFIG)) == rows(lk.title_stage(raw, variants, CONFIG))


def test_linked_records(sides, cut):
    """F2."""
    for threshold in (0.75, 0.99, 1.2):
        config = LinkConfig(title_threshold=threshold)
        assert rows(blocks.linked_records(*sides, config)) == rows(lk.title_stage(*sides, config).select("rec").distinct())


def test_counts(sides, cut):
    """pairs are counted, not listed."""
    made, cands = lk.targets(sides[1]), lk.candidates(sides[0]).withColumn("w", F.col("rec") % 3)
    idf = lk.idf_weights(made)
    own = blocks.classes(cands.groupBy("cand", "w").agg(F.count(F.lit(1)).alias("n")), ["cand"], F.struct("w", "n"))
    got = blocks.by_token(own, made, idf, 0.6, 20.0, 0.4, "counts").groupBy("w", "raw", F.round("comb", 6)).agg(F.sum("n"))
    each = lk.score_pairs(cands, made, idf, 0.6, 20.0, 0.4, 3.5, carry=("rec", "w"))
    assert rows(got) == rows(each.groupBy("w", "raw", F.round("comb", 6)).count())


def test_raw_matches(sides, cut):
    """F3."""
    titles, variants = sides[0].selectExpr("rec", "'lat' script", "raw"), sides[1].select("uri", "script", "variant")
    cities = ["lund", "lunde", "oslo", "bergen"]
    city = lambda c: F.element_at(F.array(*[F.lit(x) for x in cities]), (F.col(c) % 4 + 1).cast("int"))
    authors = titles.select("rec", "script", city("rec").alias("raw"))
    books = variants.withColumn("n", F.expr("cast(substr(uri, 2) as int)")).select("uri", city("n").alias("author_uri"))
    known = titles.sparkSession.createDataFrame([(c, "lat", c) for c in cities], "uri string, script string, variant string")
    sides_ = (authors, known, titles, variants, books, 0.85, 0.8)
    expected = rows(lk.raw_matches(*sides_))
    assert rows(blocks.raw_matches(*sides_).select("rec", "book", "author", "author_score", "title_score")) == expected and len(expected) > 100


def test_queries_take_blocks(spark, monkeypatch):
    """No pair of clients goes through the join of tokens with tokens."""

    def refused(*_, **__):
        raise AssertionError("pairs one by one")

    monkeypatch.setattr(pairing, "sharing", refused)
    for name in ("name_links", "links_by_source", "raw_match"):
        assert match_catalog.QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0
