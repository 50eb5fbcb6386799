from pyspark.sql import functions as F

from linkspark.config import LinkConfig
from linkspark.operators import candidates as cd
from linkspark.operators import evaluate as ev
from linkspark.operators import linkage as lk
from linkspark.operators import merge, sampling, segment, stats

AUTHORS = [("0001Waqidi", ["Waqidi", "Muhammad ibn Waqidi"]), ("0002Tabari", ["Tabari", "Ibn Jarir Tabari"]), ("0003Nadim", ["Nadim", "Ibn Nadim"]), ("0004Sina", ["Ibn Sina"])]
BOOKS = [("0001Waqidi.Maghazi", "0001Waqidi", "Kitab Maghazi"), ("0002Tabari.Tarikh", "0002Tabari", "Tarikh Rusul"), ("0003Nadim.Fihrist", "0003Nadim", "Fihrist"), ("0004Sina.Shifa", "0004Sina", "Shifa")]
RECORDS = [("m1", ["Waqidi", "Kitab Maghazi"]), ("m2", ["Ibn Nadim", "unknown work"]), ("m3", ["Fihrist"]), ("m4", ["nothing here"]), ("m5", ["Tabari", "Tarikh Rusul", "Waqidi", "Kitab Maghazi"])]


def run(spark):
    raw = spark.createDataFrame([(r, i, c) for r, cs in RECORDS for i, c in enumerate(cs)], "rec string, ord int, raw string")
    variants = spark.createDataFrame([(u, "lat", i, v) for u, vs in AUTHORS for i, v in enumerate(vs)], "uri string, script string, ord int, variant string")
    books = spark.createDataFrame([(u, a) for u, a, _ in BOOKS], "uri string, author_uri string")
    titles = spark.createDataFrame([(u, "lat", 0, t) for u, _, t in BOOKS], "uri string, script string, ord int, variant string")
    return lk.link(lk.Linkage(raw=raw, author_variants=variants, book_variants=titles, books=books, config=LinkConfig(rare_idf=1.0, creator_fields=False)))


def test_tiers(spark):
    made = run(spark)
    assert {r["rec"]: r["tier"] for r in made.tiers.collect()} == {"m1": "high_confidence", "m2": "author_only", "m3": "title_only", "m4": "unmatched", "m5": "high_confidence"}
    strict = {r["rec"]: r["tier"] for r in lk.cli_tiers(made.raw, made.authors, made.titles, made.combined).collect()}
    assert strict["m2"] == "unmatched" and strict["m3"] == "title_only"
    assert {r["book"] for r in made.combined.where("rec = 'm5'").collect()} == {"0001Waqidi.Maghazi", "0002Tabari.Tarikh"}


def test_metrics_and_pareto(spark):
    found = spark.createDataFrame([("a", "x", 1.0, 1), ("a", "y", 0.9, 2), ("b", "z", 1.0, 1), ("n", "x", 1.0, 1)], "rec string, book string, score double, rank int")
    truth = spark.createDataFrame([("a", "x"), ("b", "w"), ("c", "v"), ("n", None), ("k", None)], "rec string, book string")
    m = ev.pair_metrics(found, truth).first()
    assert (m["tp"], m["fp"], m["fn"], m["tn"]) == (1, 3, 2, 1)
    assert ev.found_any_metrics(found, truth).first()["recall"] == 1 / 3
    results = spark.createDataFrame([(1, 0.9, 0.95), (2, 0.8, 1.0), (3, 0.8, 0.95), (4, 1.0, 0.5)], "id int, precision double, recall double")
    assert sorted(r["id"] for r in ev.pareto(results, ["id"]).collect()) == [1, 2]


def test_culling_and_index(spark):
    books = spark.createDataFrame([("b1", "a1", ["kitab tabari", "tarikh"]), ("b2", "zz", ["kitab"])], "uri string, author_uri string, title_ara array<string>")
    variants = spark.createDataFrame([("a1", "Tabari")], "uri string, variant string")
    assert {r["uri"]: r["title_ara"] for r in cd.cull_author_tokens(books, variants).collect()} == {"b1": ["kitab", "tarikh"], "b2": ["kitab"]}


def test_merging(spark):
    left = spark.createDataFrame([(1, "", 0), (2, "x", 5)], "k int, a string, n int")
    right = spark.createDataFrame([(1, "y", 7), (2, "z", 8)], "k int, a string, n int")
    assert sorted(map(tuple, merge.first_filled(left, right, "k").collect())) == [(1, "y", 7), (2, "x", 5)]
    assert sorted(map(tuple, merge.upsert(left, right.where("k = 1"), "k").collect())) == [(1, "y", 7), (2, "x", 5)]


def test_chronology_and_samples(spark):
    years = spark.createDataFrame([(100,), (101,), (199,), (200,), (250,)], "year int")
    assert {r["bin_start"]: r["count"] for r in stats.chronology(years).where("count > 0").collect()} == {100: 2, 200: 1}
    df = spark.range(100).select(F.col("id"), (F.col("id") % 3).alias("s"))
    got = sampling.stratified(df, ["s"], 30, "id")
    assert got.count() == 30 and got.select("s").distinct().count() == 3


def test_segments(spark):
    df = spark.createDataFrame([(["Contient: Kitab al-Tarikh. Copie de Ali ibn Ahmad non datée"],)], "d array<string>")
    none = F.array().cast("array<string>")
    got = df.select(segment.segment(F.col("d"), none, {"copie de": "copy"}, {"non datée"}, 250, 1).alias("s")).first()["s"]
    assert [(x["segment"], x["label"]) for x in got] == [("Contient: Kitab al-Tarikh.", "copy"), ("Ali ibn Ahmad", "copy")]
    whole = df.select(segment.segment(F.col("d"), none).alias("s")).first()["s"]
    assert len(whole) == 1 and whole[0]["label"] is None
