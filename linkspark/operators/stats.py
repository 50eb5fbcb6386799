"""Statistics of linked pairs (uri, rec)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .linkage import by_record


def unique_counts(pairs: DataFrame) -> DataFrame:
    return pairs.agg(F.count_distinct("uri").alias("books"), F.count_distinct(F.substring_index("uri", ".", 1)).alias("authors"))


def chronology(years: DataFrame, year: str = "year", width: int = 100, until: int = 1400) -> DataFrame:
    """bin_start, count: years y with start < y <= start + width - 1; multiples of the width fall in no bin."""
    bins = years.sparkSession.range(0, until, width).select(F.col("id").cast("int").alias("bin_start"))
    counts = years.where(F.pmod(F.col(year), F.lit(width)) != 0).groupBy((F.floor(F.col(year) / width) * width).cast("int").alias("bin_start")).agg(F.count(F.lit(1)).alias("c"))
    return bins.join(counts, "bin_start", "left").select("bin_start", F.coalesce("c", F.lit(0)).alias("count"))


def counts_by(pairs: DataFrame, key: str, value: str, name: str) -> DataFrame:
    return pairs.groupBy(key).agg(F.count(value).alias(name))


#: A key is hot with more than 1/SHARE of all rows, so there are fewer hot keys than this.
SHARE = 256


def counted(rows: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """rows with ``name``, how many filled ``value`` their key has; rows without a key are left out. Counts of hot keys are
    broadcast, so their rows stay where they are; only rows of other keys meet others of their key."""
    per = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(value).alias(name), F.count(F.lit(1)).alias("__n"))
    total = per.agg(F.sum("__n").alias("__total"))  # one row
    told = per.crossJoin(F.broadcast(total)).withColumn("__hot", F.col("__n") * SHARE > F.col("__total")).drop("__n", "__total")
    hot = F.broadcast(told.where("__hot").drop("__hot"))
    served = rows.join(hot, key)
    rest = rows.join(hot, key, "left_anti").join(told.where("NOT __hot").drop("__hot"), key)
    return served.unionByName(rest)


def with_counts(pairs: DataFrame) -> DataFrame:
    """pairs with records per uri and uris per record."""
    return counted(counted(pairs, "uri", "rec", "records_per_uri"), "rec", "uri", "uris_per_record")


def outliers(counts: DataFrame, value: str, limit: float = 3.0) -> DataFrame:
    """Rows whose z-score (population deviation) is beyond the limit."""
    m = counts.agg(F.avg(value).alias("__m"), F.stddev_pop(value).alias("__s"))
    z = (F.col(value) - F.col("__m")) / F.col("__s")
    return counts.crossJoin(F.broadcast(m)).where((F.col("__s") > 0) & (F.abs(z) > limit)).select(*counts.columns, z.alias("z_score"))  # m is one row


def drop_over(pairs: DataFrame, limit: int = 40, and_outliers: bool = False) -> DataFrame:
    """pairs without uris of more than ``limit`` records, and on request without outliers."""
    per = counts_by(pairs, "uri", "rec", "n")
    gone = per.where(F.col("n") > limit).select("uri")
    if and_outliers:
        gone = gone.union(outliers(per, "n").select("uri")).distinct()
    return pairs.join(gone, "uri", "left_anti")


def drop_keyword(pairs: DataFrame, records: DataFrame, keyword: str, titles: str = "titles") -> DataFrame:
    """pairs without records of which a title has the keyword, in any case."""
    has: Column = F.exists(F.coalesce(F.col(titles), F.array().cast("array<string>")), lambda t: F.contains(F.lower(t), F.lit(keyword.lower())))
    return pairs.join(records.where(has).select("rec"), "rec", "left_anti")


def tier_counts(tiers: DataFrame) -> DataFrame:
    return tiers.groupBy("tier").agg(F.count(F.lit(1)).alias("records"))


def first_matches(found: DataFrame, n: int, rows: int | None = None) -> DataFrame:
    """The n best matches of each record. A report, hence limited. rows: how many found are, for dealing them by record."""
    found = found if rows is None else by_record(found, rows)
    return found.withColumn("k", F.row_number().over(Window.partitionBy("rec").orderBy(F.desc("score"), "book"))).where(F.col("k") <= n).drop("k")
