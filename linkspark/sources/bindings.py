"""Bindings of a knowledge base's entities, fetched from a SPARQL endpoint by a data source of Spark's Python interface.

Each partition is one request for up to ``BATCH`` ids; a failed request is tried again after a growing delay. If it
fails for good, its ids are rows with an error, so that one bad batch doesn't lose the others. Ids that are stored
already are not asked for again: an interrupted run goes on where it stopped.
"""

from __future__ import annotations

import json
import time
import urllib.parse
import urllib.request
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Ids of a request, seconds between requests and to wait for one, and where to ask.
BATCH, DELAY, TIMEOUT, TRIES = 400, 2.0, 60.0, 3
ENDPOINT = "https://query.wikidata.org/sparql"
#: Ids handed to one read through its options; more are read in as many rounds as they need, each stored before the next.
ROUND = 40_000
SCHEMA = "qid string, label_ar string, label_en string, aliases_ar string, aliases_en string, death_date string, error string"


def sparql(ids: list[str]) -> str:
    """One row an entity: a label and all other names in two languages, and a date of death."""
    wanted = " ".join(f"wd:{i}" for i in ids)
    label = lambda lang: f'OPTIONAL {{ ?e rdfs:label ?label_{lang} . FILTER(LANG(?label_{lang}) = "{lang}") }}'
    other = lambda lang: f'OPTIONAL {{ ?e skos:altLabel ?alias_{lang} . FILTER(LANG(?alias_{lang}) = "{lang}") }}'
    chosen = " ".join(f'(SAMPLE(?label_{x}) AS ?one_{x}) (GROUP_CONCAT(DISTINCT ?alias_{x}; SEPARATOR="||") AS ?all_{x})' for x in ("ar", "en"))
    return f"SELECT ?e {chosen} (SAMPLE(?died) AS ?death) WHERE {{ VALUES ?e {{ {wanted} }} {label('ar')} {label('en')} {other('ar')} {other('en')} OPTIONAL {{ ?e wdt:P570 ?died }} }} GROUP BY ?e"


def ask(endpoint: str, ids: list[str], agent: str, timeout: float) -> list[tuple]:
    """The endpoint's answer as rows of SCHEMA; ids that it doesn't know have none."""
    body = urllib.parse.urlencode({"query": sparql(ids), "format": "json"}).encode()
    heads = {"User-Agent": agent, "Accept": "application/sparql-results+json", "Content-Type": "application/x-www-form-urlencoded"}
    with urllib.request.urlopen(urllib.request.Request(endpoint, body, heads, method="POST"), timeout=timeout) as answer:
        found = json.loads(answer.read())["results"]["bindings"]
    value = lambda row, name: row.get(name, {}).get("value") or None
    return [(value(r, "e").rsplit("/", 1)[-1], *(value(r, n) for n in ("one_ar", "one_en", "all_ar", "all_en", "death")), None) for r in found if value(r, "e")]


class Batch(InputPartition):
    def __init__(self, number: int, ids: list[str]):
        self.number, self.ids = number, ids


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.ids = json.loads(options.get("ids", "[]"))
        self.endpoint, self.agent = options.get("endpoint", ENDPOINT), options.get("agent", "linkspark")
        self.batch, self.tries = int(options.get("batch", BATCH)), int(options.get("tries", TRIES))
        self.delay, self.timeout = float(options.get("delay", DELAY)), float(options.get("timeout", TIMEOUT))

    def partitions(self) -> list[Batch]:
        return [Batch(k, self.ids[k : k + self.batch]) for k in range(0, len(self.ids), self.batch)] or [Batch(0, [])]

    def read(self, partition: Batch) -> Iterator[tuple]:
        if not partition.ids:
            return
        for k in range(self.tries):
            time.sleep(self.delay * (2**k if k else min(partition.number, 1)))
            try:
                yield from ask(self.endpoint, partition.ids, self.agent, self.timeout)
                return
            except (OSError, ValueError, KeyError) as e:
                why = f"{type(e).__name__}: {e}"
        yield from ((i, None, None, None, None, None, why) for i in partition.ids)


class Bindings(DataSource):
    """``spark.read.format("bindings").option("ids", JSON list)``; options: endpoint, agent, batch, delay, timeout, tries."""

    @classmethod
    def name(cls) -> str:
        return "bindings"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options)


def fetch(spark: SparkSession, ids: DataFrame, stored: str, **options) -> DataFrame:
    """The bindings of ids (a column qid) as stored in the folder ``stored``, after those that aren't there yet were fetched.
    Ids of failed requests are not stored as known, so the next run asks again; their errors are in ``stored``-errors."""
    spark.dataSource.register(Bindings)
    wanted = ids.select("qid").where(F.col("qid").rlike(r"^Q\d+$")).distinct()
    spark.createDataFrame([], SCHEMA).drop("error").write.mode("append").parquet(stored)
    spark.createDataFrame([], "qid string, error string").write.mode("overwrite").parquet(f"{stored}-errors")
    while True:
        have = spark.read.parquet(stored).select("qid").union(spark.read.parquet(f"{stored}-errors").select("qid"))
        new = [r[0] for r in wanted.join(have, "qid", "left_anti").orderBy("qid").limit(ROUND).collect()]
        if not new:
            return spark.read.parquet(stored)
        reader = spark.read.format("bindings").option("ids", json.dumps(new))
        for k, v in options.items():
            reader = reader.option(k, str(v))
        got = reader.load().persist()
        # Ids without an answer are known to have none: a row of nulls says so.
        none = spark.createDataFrame([(i,) for i in new], "qid string").join(got.select("qid"), "qid", "left_anti")
        got.where("error IS NULL").drop("error").unionByName(none, allowMissingColumns=True).write.mode("append").parquet(stored)
        got.where("error IS NOT NULL").select("qid", "error").write.mode("append").parquet(f"{stored}-errors")
        got.unpersist()


def enrich_authors(spark: SparkSession, authors: DataFrame, stored: str, fetched_at: str, **options) -> DataFrame:
    """authors (with wikidata_id) with what the endpoint says of them; those whose request failed have its error."""
    from ..operators import merge

    got = fetch(spark, authors.select(F.col("wikidata_id").alias("qid")), stored, **options)
    known = got.where(F.coalesce("label_ar", "label_en", "aliases_ar", "aliases_en", "death_date").isNotNull())
    errors = spark.read.parquet(f"{stored}-errors").select(F.col("qid").alias("wikidata_id"), F.col("error").alias("__why")).dropDuplicates(["wikidata_id"])
    made = merge.enrich(authors, known, fetched_at).join(errors, "wikidata_id", "left")
    return made.withColumn("wd_error", F.coalesce("__why", "wd_error")).drop("__why")
