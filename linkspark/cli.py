"""Command line: parse catalogues, survey them, apply a review, sample, link, and report on links."""

from __future__ import annotations

import argparse
import datetime
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import LinkConfig, SurveyConfig, load_yaml, read_yaml, snapshot, survey_settings
from .functions import text as tx
from .operators import candidates as cd
from .operators import linkage as lk
from .operators import evaluate, merge, sampling, segment, stats, survey
from .sources import bindings, records, sinks
from .streaming import incremental

FIELDS = ("title", "creator", "contributor", "description", "subject", "coverage", "format", "source")


def elements(parsed: DataFrame) -> DataFrame:
    """(rec, field, ord, text) of parsed Dublin Core files."""
    each = F.explode(F.flatten(F.array(*[F.transform(f, _numbered(f)) for f in FIELDS])))
    return parsed.where("has_dc").select(F.col("stem").alias("rec"), each.alias("e")).select("rec", "e.field", "e.ord", "e.text")


def _numbered(field: str):
    return lambda x, i: F.struct(F.lit(field).alias("field"), i.alias("ord"), x.alias("text"))


def phrases(spark: SparkSession, a: argparse.Namespace) -> DataFrame | None:
    """field, ngram, signal_type of reviewed phrases, of any number: from a curated file, as ``apply-review`` wrote
    them, or all n-grams of a survey above its limits."""
    if a.phrases:
        return records.curated_phrases(spark, a.phrases)
    if a.review:
        signals = spark.read.schema("field string, ngram string, signal_type string").json(f"{a.review}/signals")
        return signals.unionByName(spark.read.schema("field string, ngram string").json(f"{a.review}/boilerplate"), allowMissingColumns=True)
    if a.survey:
        records_n = spark.read.schema("records long").json(f"{a.survey}/records").first()[0]
        return survey.boilerplate_over(spark.read.parquet(f"{a.survey}/ngrams"), records_n).withColumn("signal_type", F.lit(None).cast("string"))
    return None


def parse_xml(spark: SparkSession, a: argparse.Namespace) -> None:
    settings = survey_settings(read_yaml(a.config)) if a.config else SurveyConfig()
    files = records.xml_files(spark, a.data)
    if a.update:  # what is stored isn't parsed again
        old = spark.read.parquet(f"{a.out}/records")
        files = merge.unseen(files, old.select(F.col("record_id").alias("stem")), "stem")
    parsed = records.dublin_core(files)
    found, limits = phrases(spark, a), (settings.max_desc_len, settings.min_desc_tokens)
    if found is None:
        rows = records.manuscripts(parsed, segments=segment.segment(F.col("description"), F.col("title"), None, None, *limits))
    else:
        rows = records.manuscripts(segment.segment_by_sets(parsed, "path", "description", "title", found.where("field = 'description'"), *limits), segments=F.col("segments"))
    if a.update:
        incremental.update(old, rows, "record_id").write.mode("append").parquet(f"{a.out}/records")
        errors = merge.unseen(records.parse_errors(parsed), spark.read.parquet(f"{a.out}/errors"), "path")
        sinks.describe_store(spark, a.out, errors, mode="append", data=a.data)
    else:
        sinks.write_store(rows, a.out, records.parse_errors(parsed), data=a.data)


def parse_corpus(spark: SparkSession, a: argparse.Namespace) -> None:
    entries = records.key_values(spark, a.data)
    books, authors = records.books(entries), records.authors(entries)
    if a.listing:
        rows = records.listing(spark, a.listing)
        keep = lambda df, full: df.select(*df.columns, *[F.lit(None).cast(t).alias(c) for c, t in full.dtypes if c not in df.columns])
        books = merge.first_filled(keep(records.listed_books(rows), books), books, "uri")
        authors = merge.first_filled(keep(records.listed_authors(rows), authors), authors, "uri", ("death_year_ah", "wikidata_id"))
    sinks.write_store(merge.attach_links(books, records.versions(entries)), f"{a.out}/books", data=a.data)
    sinks.write_store(authors, f"{a.out}/authors", data=a.data)


def run_survey(spark: SparkSession, a: argparse.Namespace) -> None:
    settings = survey_settings(read_yaml(a.config)) if a.config else SurveyConfig()
    sinks.begin_run(spark, a.out)
    parsed = records.dublin_core(records.xml_files(spark, a.data))
    elements(parsed).write.mode("overwrite").parquet(f"{a.out}/elements")
    found = spark.read.parquet(f"{a.out}/elements")
    survey.ngram_counts(found, a.max_n or settings.max_n, lambda x: tx.tokens_lat(x, settings.keep_abbrev_dots)).write.mode("overwrite").parquet(f"{a.out}/counts")
    counts, n = spark.read.parquet(f"{a.out}/counts"), found.select("rec").distinct().count()
    spark.createDataFrame([(n,)], "records long").coalesce(1).write.mode("overwrite").json(f"{a.out}/records")
    survey.coverage(found, n).write.mode("overwrite").json(f"{a.out}/summary")
    survey.tfidf(counts, found).write.mode("overwrite").parquet(f"{a.out}/ngrams")
    limits = spark.createDataFrame([(f, x.strategy, x.min_doc_freq_pct, x.max_repeats_per_doc) for f, x in settings.fields.items()], "field string, strategy string, min_doc_freq_pct double, max_repeats_per_doc double")
    suggested = survey.suggest_boilerplate(counts, found, limits)
    sinks.write_csv(suggested.withColumnRenamed("field", "source_field").withColumns({"keep": F.lit(""), "signal_type": F.lit("")}), f"{a.out}/review")
    sinks.write_csv(survey.conversion_table(survey.characters(found)), f"{a.out}/conversions")
    sinks.log_run(spark, f"{a.out}/runs", "build", data=a.data, **snapshot(settings))
    outcome = parsed.groupBy(F.when(F.col("error").isNull(), "parsed").otherwise("failed").alias("name")).agg(F.count(F.lit(1)).alias("records"))
    sinks.finish_run(a.out, "survey", outcome, ("parsed", "failed"), {k: f"{a.out}/{k}" for k in ("summary", "ngrams", "review", "conversions")}, {"data": a.data, **snapshot(settings)})


def conversion_table(spark: SparkSession, a: argparse.Namespace) -> None:
    """From the text fields of parsed records, of any catalogue."""
    rows = spark.read.parquet(f"{a.records}/records")
    kinds = {"string": lambda c: F.array(c), "array<string>": F.col}
    texts = [F.coalesce(kinds[t](c), F.array().cast("array<string>")) for c, t in rows.dtypes if t in kinds and c not in ("record_id", "catalogue_url", "gallica_url")]
    each = rows.select(F.explode(F.concat(*texts)).alias("text"))
    sinks.write_csv(survey.conversion_table(survey.characters(each)), a.out)


def show_survey(spark: SparkSession, a: argparse.Namespace) -> None:
    sinks.manifest(spark, a.out).select("run", "finished_at", "records", "results").show(truncate=False)
    spark.read.json(f"{a.out}/summary").orderBy(F.desc("records_present")).show(truncate=False)
    survey.top_ngrams(spark.read.parquet(f"{a.out}/ngrams"), a.top).orderBy("field", "n", "ranking", "place").show(10_000, truncate=False)


def apply_review(spark: SparkSession, a: argparse.Namespace) -> None:
    boilerplate, signals = sinks.apply_review(spark.read.option("header", "true").csv(f"{a.out}/review"))
    boilerplate.write.mode("overwrite").json(f"{a.out}/boilerplate")
    signals.write.mode("overwrite").json(f"{a.out}/signals")
    sinks.log_run(spark, f"{a.out}/runs", "apply_review")


def sample(spark: SparkSession, a: argparse.Namespace) -> None:
    rows = spark.read.parquet(f"{a.records}/records")
    strata = ["completeness", "subject_class", "period", "kind", "richness"]
    chosen = sampling.stratified(sampling.manuscript_strata(rows.where(~sampling.is_quran(rows))), strata, a.size, "record_id", a.seed)
    chosen.drop(*strata).write.mode("overwrite").parquet(f"{a.out}/records")


def link(spark: SparkSession, a: argparse.Namespace) -> None:
    rows = spark.read.parquet(f"{a.records}/records")
    books, authors = spark.read.parquet(f"{a.corpus}/books/records"), spark.read.parquet(f"{a.corpus}/authors/records")
    config = load_yaml(LinkConfig, a.config, a.section) if a.config else LinkConfig()
    variants = cd.author_variants(authors)
    if config.cull_author_tokens:
        books = cd.cull_author_tokens(books, variants)
    raw = cd.record_candidates(rows).select(F.col("record_id").alias("rec"), "ord", "raw")
    creators = rows.select(F.col("record_id").alias("rec"), F.explode(F.concat("creator_lat", "creator_ara")).alias("raw"))
    sinks.begin_run(spark, a.out)
    run = lk.link(lk.Linkage(raw, variants, cd.book_variants(books), books.select("uri", "author_uri"), creators, config, folder=f"{a.out}/stages"))
    everyone = rows.select(F.col("record_id").alias("rec"))
    tiers = lk.cli_tiers(everyone, run.authors, run.titles, run.combined) if a.strict else lk.classify(everyone, run.authors, run.titles, run.combined)
    sinks.write_tiers(tiers, run.combined, a.out)
    told = spark.read.json(f"{a.out}/summary").select(F.col("tier").alias("name"), "records")
    sinks.finish_run(a.out, a.run_id or str(uuid.uuid4()), told, lk.TIERS, {k: f"{a.out}/{k}" for k in ("matches", "summary", "stages")}, {"records": a.records, "corpus": a.corpus, **snapshot(config)})


def enrich(spark: SparkSession, a: argparse.Namespace) -> None:
    authors = spark.read.parquet(f"{a.corpus}/authors/records")
    made = bindings.enrich_authors(spark, authors, f"{a.out}/bindings", a.date, endpoint=a.endpoint, agent=a.agent, delay=a.delay)
    sinks.write_store(made.select(*authors.columns, *[c for c in made.columns if c not in authors.columns]), f"{a.out}/authors", data=a.corpus)


def sweep(spark: SparkSession, a: argparse.Namespace) -> None:
    """All pairs of the given thresholds, from the scores that ``link`` stored; the thresholds of its own run are the least."""
    books = spark.read.parquet(f"{a.corpus}/books/records").select(F.col("uri").alias("book"), "author_uri")
    titles = spark.read.parquet(f"{a.matches}/stages/titles").select("rec", F.col("uri").alias("book"), F.col("score").alias("title_score"))
    authors = spark.read.parquet(f"{a.matches}/stages/authors").select("rec", F.col("uri").alias("author_uri"), F.col("score").alias("author_score"))
    scored = titles.join(books, "book").join(authors, ["rec", "author_uri"])
    grid = spark.createDataFrame([(x, y) for x in a.authors for y in a.titles], "author_threshold double, title_threshold double")
    made = evaluate.sweep(scored, records.truth(spark, a.truth), grid)
    sinks.write_csv(made.orderBy("author_threshold", "title_threshold"), a.out)


def report(spark: SparkSession, a: argparse.Namespace) -> None:
    pairs = spark.read.json(f"{a.out}/matches").select("rec", F.explode("matches.book").alias("uri"))
    stats.unique_counts(pairs).show()
    stats.chronology(pairs.select(F.left("uri", F.lit(4)).cast("int").alias("year"))).show()
    sinks.write_csv(stats.with_counts(stats.drop_over(pairs, a.limit, a.outliers)), f"{a.out}/pairs")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="linkspark", description=__doc__)
    commands = p.add_subparsers(required=True)

    def add(name: str, f, *options: tuple) -> None:
        c = commands.add_parser(name)
        c.set_defaults(run=f)
        for flag, settings in options:
            c.add_argument(flag, **settings)

    need, out = {"required": True}, ("--out", {"required": True})
    add("parse-xml", parse_xml, ("--data", need), out, ("--update", {"action": "store_true"}), ("--review", {"help": "folder of apply-review"}), ("--phrases", {"help": "JSON file of reviewed phrases"}), ("--survey", {"help": "folder of a survey, all of whose frequent n-grams are boilerplate"}), ("--config", {"help": "YAML file of settings"}))
    add("parse-corpus", parse_corpus, ("--data", need), out, ("--listing", {}))
    add("survey", run_survey, ("--data", need), out, ("--max-n", {"type": int}), ("--config", {"help": "YAML file of settings"}))
    add("show-survey", show_survey, out, ("--top", {"type": int, "default": 20}))
    add("conversion-table", conversion_table, ("--records", need), out)
    add("apply-review", apply_review, out)
    add("sample", sample, ("--records", need), out, ("--size", {"type": int, "default": 500}), ("--seed", {"type": int, "default": 42}))
    add("link", link, ("--records", need), ("--corpus", need), out, ("--strict", {"action": "store_true"}), ("--config", {"help": "YAML file of settings"}), ("--section", {"help": "its section"}), ("--run-id", {}))
    add("enrich", enrich, ("--corpus", need), out, ("--endpoint", {"default": bindings.ENDPOINT}), ("--agent", {"default": "linkspark"}), ("--delay", {"type": float, "default": bindings.DELAY}), ("--date", {"default": str(datetime.date.today())}))
    steps = {"type": float, "nargs": "+", "default": [0.70, 0.75, 0.80, 0.85, 0.90]}
    add("sweep", sweep, ("--matches", need), ("--corpus", need), ("--truth", need), out, ("--authors", steps), ("--titles", steps))
    add("report", report, out, ("--limit", {"type": int, "default": 40}), ("--outliers", {"action": "store_true"}))
    return p


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(arguments)
    a.run(spark or SparkSession.builder.appName("linkspark").getOrCreate(), a)


if __name__ == "__main__":
    main()
