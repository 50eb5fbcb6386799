"""Settings, manifests and trails of runs, reviewed phrases of any number, conversion tables, and the commands for them."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from linkspark import cli, config
from linkspark.functions import text as tx
from linkspark.operators import candidates, merge, segment, stats, survey
from linkspark.sources import records, sinks
from linkspark.streaming import incremental

DC = """<record><oai_dc:dc xmlns:oai_dc="http://www.openarchives.org/OAI/2.0/oai_dc/" xmlns:dc="http://purl.org/dc/elements/1.1/">
<dc:title>{}</dc:title><dc:creator>Ibn Sīnā. Auteur du texte</dc:creator><dc:description>{}</dc:description></oai_dc:dc></record>"""


def test_settings_by_field():
    made = config.survey_settings({"survey": {"max_n": 3, "other": 1}, "boilerplate": {"fields": {"creator": {"min_doc_freq_pct": 7}, "title": None}}, "parsing": {"max_desc_len": 80, "overwrite_existing": True}})
    assert (made.max_n, made.keep_abbrev_dots, made.max_desc_len) == (3, True, 80)
    assert made.fields == {"creator": config.FieldBoilerplate("freq_only", 7.0, 1.1), "title": config.FieldBoilerplate("full", 5.0, 1.1)}


def test_settings_of_older_files():
    made = config.survey_settings({"boilerplate": {"min_doc_freq_pct": 3}})
    assert made.fields["description"] == config.FieldBoilerplate("full", 3.0, 1.1)
    assert made.fields["creator"] == config.field_defaults()["creator"]
    assert config.survey_settings({}) == config.SurveyConfig()
    with pytest.raises(ValueError, match="unknown way"):
        config.survey_settings({"boilerplate": {"fields": {"title": {"mode": "some"}}}})


def test_manifest_comes_last(spark, tmp_path):
    at = str(tmp_path)
    sinks.begin_run(spark, at)
    assert sinks.manifest(spark, at).count() == 0
    groups = spark.createDataFrame([("b", 2), (None, 1), ("z", 4)], "name string, records long")
    sinks.finish_run(at, "first", groups, ("a_a", "b"), {"x": "y"}, {})
    row = sinks.manifest(spark, at).first()
    assert row["records"] == 7 and row["results"] == {"a_a": 0, "b": 2, "": 1, "z": 4} and row["outputs"] == {"x": "y"} and row["settings"] is None
    assert [r[0] for r in spark.read.text(f"{at}/summary-text").collect()] == ["Records: 7", "a a: 0", "b: 2", ": 1", "z: 4"]
    sinks.begin_run(spark, at)
    assert sinks.manifest(spark, at).count() == 0


def test_manifest_of_nothing(spark, tmp_path):
    sinks.finish_run(str(tmp_path), "none", spark.createDataFrame([], "name string, records long"), (), {}, {})
    row = sinks.manifest(spark, str(tmp_path)).first()
    assert row["records"] == 0 and not row["results"]


def test_trail(spark, tmp_path):
    for stage, data in (("build", "first"), ("sample", "x"), ("apply_review", "y"), ("build", "third")):
        sinks.log_run(spark, str(tmp_path), stage, data=data)
    assert {(r["stage"], r["settings"]["data"]) for r in sinks.last_runs(spark, str(tmp_path)).collect()} == {("build", "third"), ("sample", "x")}
    sinks.log_run(spark, str(tmp_path), "apply_review", data="z")
    assert sinks.last_runs(spark, str(tmp_path)).count() == 3


def test_sets_of_any_size_agree_with_one_set(spark):
    rng = random.Random(3)
    words = ["copie", "Lieu", "de", "la", "date", "sans", "Nom", "du", "manuscrit", "relié"]
    line = lambda: " ".join(rng.choice(words) for _ in range(rng.randrange(14)))
    rows = [(i, [line() for _ in range(rng.randrange(4))] if i % 9 else None, [line()] if i % 4 else None) for i in range(120)]
    signals = {"lieu de": "agent:copyist", "date du manuscrit": "date:copy", "la date": "date:copy"}
    plain = {"copie sans", "de la", "Nom du", "sans la date de", "du manuscrit"}
    df = spark.createDataFrame(rows, "id long, d array<string>, t array<string>")
    one = {r["id"]: r["s"] for r in df.select("id", segment.segment(F.col("d"), F.col("t"), signals, plain).alias("s")).collect()}
    phrases = spark.createDataFrame([*signals.items(), *[(p, None) for p in plain], ("lieu de", "z"), (None, None), ("", None)], "ngram string, signal_type string")
    for size in (segment.TERM_CHARS, 20):
        made = segment.segment_by_sets(df, "id", "d", "t", phrases, phrase_chars=size)
        assert made.columns == ["id", "d", "t", "segments"]
        assert {r["id"]: r["segments"] for r in made.collect()} == one
    assert any(x["label"] for s in one.values() for x in s)
    none = segment.segment_by_sets(df, "id", "d", "t", phrases.limit(0))
    assert none.exceptAll(df.withColumn("segments", segment.segment(F.col("d"), F.col("t")))).count() == 0 == none.count() - 120


def test_curated_formats(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"boilerplate": [{"ngram": "a b", "field": "format"}, "c d", {"ngram": "e f"}, {"field": "x"}],\n "signals": [{"ngram": "lieu de", "field": "description", "signal_type": "agent:copyist"}]}')
    (tmp_path / "b.json").write_text('["g h", "c d"]')
    got = {tuple(r) for r in records.curated_phrases(spark, str(tmp_path)).collect()}
    assert got == {("format", "a b", None), ("description", "c d", None), ("description", "e f", None), ("description", "g h", None), ("description", "lieu de", "agent:copyist")}


def test_boilerplate_over(spark):
    rows = spark.createDataFrame([("t", "a b", 5, 5), ("t", "c d", 8, 5), ("t", "e f", 1, 1), ("t", "g h", 0, 0)], "field string, ngram string, term_freq long, doc_freq long")
    assert [r["ngram"] for r in survey.boilerplate_over(rows, 50).collect()] == ["a b"]
    assert survey.boilerplate_over(rows, 0).count() == 0


def test_top_ngrams(spark):
    rows = spark.createDataFrame([("t", 2, w, i % 3, i % 5, float(i)) for i, w in enumerate("abcdef")], "field string, n int, ngram string, doc_freq long, term_freq long, tfidf double")
    got = {(r["ranking"], r["place"]): r["ngram"] for r in survey.top_ngrams(rows, 2).collect()}
    assert got == {("doc_freq", 1): "c", ("doc_freq", 2): "f", ("term_freq", 1): "e", ("term_freq", 2): "d", ("tfidf", 1): "f", ("tfidf", 2): "e"}


def test_conversion_table_and_back(spark, tmp_path):
    texts = spark.createDataFrame([("šaḫš",), (None,), ("ʿ",)], "text string")
    made = survey.conversion_table(survey.characters(texts))
    assert [tuple(r) for r in made.limit(1).collect()] == [("š", "U+0161", "LATIN SMALL LETTER S WITH CARON", "Ll", "", "Frequency: 2")]
    filled = made.withColumn("equivalent", F.when(F.col("character") == "š", "sh").when(F.col("character") == "ʿ", "ʿ").otherwise(""))
    sinks.write_csv(filled, str(tmp_path / "c"))
    table = records.conversions(spark, str(tmp_path / "c"))
    assert table == {"š": "sh", "ḫ": "", "ʿ": "ʿ"}
    assert texts.select(tx.convert(F.col("text"), table)).first()[0] == "shash"


def test_known(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c"), (1, "d")], "k int, v string")
    assert sorted(r["v"] for r in merge.known(rows, spark.createDataFrame([(1,), (1,), (None,)], "k int"), "k").collect()) == ["a", "d"]


def test_two_new_files_of_one_name(spark, tmp_path):
    for name in ("x", "y"):
        (tmp_path / "in" / name).mkdir(parents=True)
        (tmp_path / "in" / name / "OAI_1.xml").write_text(DC.format(name, "d"), encoding="utf-8")
    parse = lambda f: records.manuscripts(records.dublin_core(f)).select("record_id", "title_lat")
    incremental.follow_files(spark, str(tmp_path / "in"), str(tmp_path / "store"), str(tmp_path / "seen"), parse, "record_id").awaitTermination()
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "store")).collect()] == [("OAI_1", ["x"])]


def test_commands(spark, tmp_path):
    data = tmp_path / "xml"
    data.mkdir()
    for i in range(6):
        (data / f"OAI_{i}.xml").write_text(DC.format(f"Kitāb {i}", f"Copie anonyme sans date numéro {i}x relié"), encoding="utf-8")
    (data / "bad.xml").write_text("<record>", encoding="utf-8")
    (tmp_path / "c.yml").write_text("boilerplate:\n  fields:\n    description: {mode: full, min_doc_freq_pct: 50}\n", encoding="utf-8")
    (tmp_path / "p.json").write_text('["anonyme sans"]', encoding="utf-8")
    go = lambda *a: cli.main([str(x) for x in a], spark)
    go("survey", "--data", data, "--out", tmp_path / "s", "--config", tmp_path / "c.yml")
    run = sinks.manifest(spark, str(tmp_path / "s")).first()
    assert run["results"] == {"parsed": 6, "failed": 1} and "description" in run["settings"]["fields"]
    review = spark.read.option("header", "true").csv(str(tmp_path / "s/review"))
    assert {r["source_field"] for r in review.collect()} == {"description"} and "anonyme sans" in {r["ngram"] for r in review.collect()}
    go("show-survey", "--out", tmp_path / "s", "--top", 2)
    read = lambda out: {r["record_id"]: r["description_candidates_lat"] for r in spark.read.parquet(f"{out}/records").collect()}
    go("parse-xml", "--data", data, "--out", tmp_path / "r", "--phrases", tmp_path / "p.json")
    assert read(tmp_path / "r")["OAI_1"] == ["Copie", "date numéro 1x relié"]
    go("parse-xml", "--data", data, "--out", tmp_path / "v", "--survey", tmp_path / "s")
    assert read(tmp_path / "v")["OAI_1"] != ["Copie anonyme sans date numéro 1x relié"]
    (data / "OAI_7.xml").write_text(DC.format("Kitāb 7", "Copie"), encoding="utf-8")
    (data / "worse.xml").write_text("<", encoding="utf-8")
    go("parse-xml", "--data", data, "--out", tmp_path / "r", "--phrases", tmp_path / "p.json", "--update")
    assert len(read(tmp_path / "r")) == 7 and spark.read.parquet(str(tmp_path / "r/errors")).count() == 2
    assert spark.read.json(str(tmp_path / "r/meta")).first()["parse_errors"] == 2
    go("conversion-table", "--records", tmp_path / "r", "--out", tmp_path / "t")
    assert {"ā", "é", "ī"} <= set(records.conversions(spark, str(tmp_path / "t")))


def test_counts_of_hot_keys(spark):
    rows = [(("hot" if i % 3 == 0 else f"u{i % 500}") if i % 11 else None, i % 7 if i % 13 else None) for i in range(3000)]
    got = stats.with_counts(spark.createDataFrame(rows, "uri string, rec long")).collect()
    whole = [r for r in rows if None not in r]
    # Rows without a record are counted nowhere, and rows without a book are gone before records are counted.
    per_uri, per_rec = Counter(u for u, _ in whole), Counter(r for _, r in whole)
    assert Counter(map(tuple, got)) == Counter((r, u, per_uri[u], per_rec[r]) for u, r in whole)


def test_members_in_parts(spark):
    rows = spark.range(5000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("author_uri"), F.col("id").alias("uri"))
    for part in (None, F.floor(F.col("uri") / 100)):
        made = candidates.books_by_author(rows.union(rows), part).where("author_uri = 'hot'").collect()
        assert len(made) > 40 and sorted(x for r in made for x in r["books"]) == list(range(0, 5000, 3))
