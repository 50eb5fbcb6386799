"""Writers: stores with a table about them, tier tables, reviews, exports and an audit trail of runs."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA_VERSION = 1


def write_store(rows: DataFrame, path: str, errors: DataFrame | None = None, **about: str) -> None:
    """Rows as Parquet in ``path/records``, parse errors beside them, and one row about the store."""
    spark = rows.sparkSession
    rows.write.mode("overwrite").parquet(f"{path}/records")
    describe_store(spark, path, errors, **about)


def describe_store(spark: SparkSession, path: str, errors: DataFrame | None = None, mode: str = "overwrite", **about: str) -> None:
    """Parse errors beside a store's records, in place of or (mode ``append``) after earlier ones, and one row about the store."""
    if errors is not None:
        errors.write.mode(mode).parquet(f"{path}/errors")
    count = spark.read.parquet(f"{path}/records").count()
    meta = [(SCHEMA_VERSION, count, 0 if errors is None else spark.read.parquet(f"{path}/errors").count(), datetime.now(UTC).isoformat(), dict(about))]
    spark.createDataFrame(meta, "schema_version int, records long, parse_errors long, generated_at string, about map<string,string>").coalesce(1).write.mode("overwrite").json(f"{path}/meta")


def write_tiers(tiers: DataFrame, matches: DataFrame, path: str) -> None:
    """A folder for each tier, with records and their matches in order; and counts by tier."""
    nested = matches.groupBy("rec").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "book", "score"))), lambda m: F.struct(m["book"].alias("book"), m["score"].alias("score"))).alias("matches"))
    tiers.join(nested, "rec", "left").write.mode("overwrite").partitionBy("tier").json(f"{path}/matches")
    tiers.groupBy("tier").agg(F.count(F.lit(1)).alias("records")).coalesce(1).write.mode("overwrite").json(f"{path}/summary")


#: A run's manifest: one row, written last, or none while the run isn't finished.
MANIFEST = "run string, finished_at string, records long, results map<string,long>, outputs map<string,string>, settings map<string,string>"


def begin_run(spark: SparkSession, path: str) -> None:
    """Empties the manifest of an earlier run, so that its results, while they are replaced, don't pass for whole."""
    spark.createDataFrame([], MANIFEST).write.mode("overwrite").json(f"{path}/manifest")


def finish_run(path: str, run: str, groups: DataFrame, names: tuple[str, ...], outputs: dict[str, str], settings: dict[str, str]) -> None:
    """A summary in words and, last of all, the manifest. groups: (name, records), a few rows; ``names`` are told in
    this order even where they have no records, and any others after them."""
    spark = groups.sparkSession
    order = F.array(*map(F.lit, names))
    listed = spark.createDataFrame([(n,) for n in names], "name string").join(groups.groupBy("name").agg(F.sum("records").alias("records")), "name", "full")
    results = F.sort_array(F.collect_list(F.struct(F.when(F.array_contains(order, F.col("name")), F.array_position(order, F.col("name"))).otherwise(len(names) + 1).alias("at"), F.coalesce("name", F.lit("")).alias("name"), F.coalesce("records", F.lit(0)).alias("n"))))
    told = listed.agg(results.alias("r")).select(F.transform("r", lambda x: F.struct(x["name"].alias("key"), x["n"].alias("value"))).alias("r"), F.aggregate("r", F.lit(0).cast("long"), lambda a, x: a + x["n"]).alias("records"))
    lines = F.concat(F.array(F.concat(F.lit("Records: "), F.col("records").cast("string"))), F.transform("r", lambda x: F.concat(F.replace(x["key"], F.lit("_"), F.lit(" ")), F.lit(": "), x["value"].cast("string"))))
    told.select(F.array_join(lines, "\n").alias("value")).coalesce(1).write.mode("overwrite").text(f"{path}/summary-text")
    texts = lambda m: F.map_from_entries(F.array(*[F.struct(F.lit(k), F.lit(str(v))) for k, v in sorted(m.items())])) if m else F.lit(None).cast("map<string,string>")
    row = told.select(F.lit(run).alias("run"), F.lit(datetime.now(UTC).isoformat()).alias("finished_at"), "records", F.map_from_entries("r").alias("results"), texts(outputs).alias("outputs"), texts(settings).alias("settings"))
    row.coalesce(1).write.mode("overwrite").json(f"{path}/manifest")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """The manifest of a finished run; no rows for one that was begun only."""
    return spark.read.schema(MANIFEST).json(f"{path}/manifest")


def write_csv(rows: DataFrame, path: str) -> None:
    """One CSV table with a header; lists are joined with bars."""
    flat = [F.array_join(F.transform(c, lambda x: x.cast("string")), "|").alias(c) if t.startswith("array") else F.col(c) for c, t in rows.dtypes]
    rows.select(*flat).write.mode("overwrite").option("header", "true").csv(path)


def apply_review(review: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Boilerplate (ngram, field) and signals (ngram, field, signal_type) from a reviewed table with a keep column."""
    kept = review.where(F.lower("keep").isin("yes", "y", "true", "1"))
    typed = F.trim(F.coalesce("signal_type", F.lit(""))) != ""
    return kept.where(~typed).select("ngram", F.col("source_field").alias("field")), kept.where(typed).select("ngram", F.col("source_field").alias("field"), "signal_type")


def log_run(spark: SparkSession, path: str, stage: str, **settings: str) -> None:
    """Append a run to the audit trail."""
    spark.createDataFrame([(datetime.now(UTC).isoformat(), stage, {k: str(v) for k, v in settings.items()})], "at string, stage string, settings map<string,string>").coalesce(1).write.mode("append").json(path)


def log_runs(runs: DataFrame, path: str) -> None:
    """Append many runs, as those of another trail: (at, stage, settings) and any columns that name a catalogue."""
    runs.write.mode("append").json(path)


def last_runs(spark: SparkSession, path: str, of: str | None = None) -> DataFrame:
    """The latest run of each stage; a new ``build`` makes any earlier ``apply_review`` void. With ``of``, the column
    that names a catalogue, each catalogue has its own; a null one is a catalogue too."""
    own = [of] if of else []
    runs = spark.read.schema(", ".join(["at string, stage string, settings map<string,string>", *[f"`{c}` string" for c in own]])).json(path)
    stages = runs.groupBy(*own).agg(F.max(F.when(F.col("stage") == "build", F.col("at"))).alias("built"))
    latest = runs.groupBy(*own, "stage").agg(F.max_by(F.struct("at", "settings"), "at").alias("r")).select(*own, "stage", "r.*")
    void = (F.col("stage") == "apply_review") & (F.col("at") < F.col("built"))
    joined = latest.join(stages.withColumnRenamed(of, "__of"), F.col(of).eqNullSafe(F.col("__of")), "left").drop("__of") if of else latest.crossJoin(F.broadcast(stages))  # stages is one row
    return joined.where(~F.coalesce(void, F.lit(False))).drop("built")
