"""Order over a whole table without a window that has one partition: rows go to ranges of the key, each range is worked
on by itself, and what lies before it is known from one row a range."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Ranges of a table, and rows looked at to choose where they begin. Both affect the balance of work only.
RANGES, LOOKED_AT = 200, 20_000


def bounds(df: DataFrame, key: str, ranges: int = RANGES) -> list[Any]:
    """Where ranges of roughly equal size begin, but for the first one: fewer than ``ranges`` values."""
    some = df.select(key).where(F.col(key).isNotNull())
    rows = some.count()
    looked = sorted(r[0] for r in some.sample(min(1.0, 1.5 * LOOKED_AT / max(rows, 1)), seed=7).limit(2 * LOOKED_AT).collect())
    return sorted({looked[len(looked) * i // ranges] for i in range(1, ranges)}) if looked else []


def range_of(key: str, at: list[Any]) -> Column:
    """The number of a row's range; null keys come before all."""
    return F.when(F.col(key).isNull(), -1).otherwise(F.size(F.filter(F.array(*[F.lit(b) for b in at]), lambda b: b <= F.col(key))) if at else F.lit(0))


def running(df: DataFrame, key: str, weight: str, ranges: int = RANGES) -> DataFrame:
    """df with ``before``, the sum of weight over all rows of smaller keys, and ``total``, over all rows. Keys are distinct."""
    ranged = df.withColumn("__range", range_of(key, bounds(df, key, ranges)))
    sums = ranged.groupBy("__range").agg(F.sum(weight).alias("__sum"))  # a row for each range
    offsets = sums.select("__range", F.coalesce(F.sum("__sum").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__offset"), F.sum("__sum").over(Window.partitionBy()).alias("total"))
    own = F.coalesce(F.sum(weight).over(Window.partitionBy("__range").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return ranged.join(F.broadcast(offsets), "__range").withColumn("before", F.col("__offset") + own).drop("__range", "__offset")
