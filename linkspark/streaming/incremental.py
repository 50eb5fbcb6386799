"""Incremental updates: files that arrive are parsed once, and new rows are added to a store."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import merge


def update(stored: DataFrame, arrived: DataFrame, key: str) -> DataFrame:
    """Rows of arrived whose key isn't stored, each key once (that of the least row)."""
    new = merge.unseen(arrived, stored, key)
    others = [c for c in new.columns if c != key]
    return new.groupBy(key).agg(F.min(F.struct(*others)).alias("s")).select(key, "s.*")


def follow_files(spark: SparkSession, folder: str, store: str, checkpoint: str, parse: Callable[[DataFrame], DataFrame], key: str, pattern: str = "*.xml") -> StreamingQuery:
    """A streaming query that parses each new file and appends rows with new keys to a Parquet store, each key
    once, also where two files of a batch have it. Which files were seen is kept in the checkpoint; a batch that is repeated after a failure adds nothing twice, since its keys are
    stored then."""
    files = spark.readStream.format("text").option("wholetext", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    path = F.col("_metadata.file_path")
    named = files.select(path.alias("path"), F.regexp_extract(path, r"([^/]+)\.[^./]+$", 1).alias("stem"), "value")

    def add(batch: DataFrame, _: int) -> None:
        rows = parse(batch)
        try:
            old = batch.sparkSession.read.schema(rows.schema).parquet(store)
        except Exception as e:  # the store does not exist yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            old = batch.sparkSession.createDataFrame([], rows.schema)
        update(old, rows, key).write.mode("append").parquet(store)

    return named.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Counts and sums of events by type and window, with a watermark for late ones; for streams and tables alike."""
    marked = events.withWatermark("ts", late) if events.isStreaming else events
    return marked.groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")
