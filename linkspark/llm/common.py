"""What the operators of this package share: working folders, materialised tables, bounded batches, skew-safe joins."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows and bytes of one Arrow batch, whichever is reached first. Texts may be long, so the bytes are what bounds a
#: Python worker's memory. All operators ask for the same, so it doesn't matter which asked last.
BATCH_ROWS, BATCH_BYTES = 4096, 2 << 20
#: A key is hot when it holds more than 1/HOT_SHARE of all rows; hence there are fewer than HOT_SHARE hot keys,
#: which is the proven bound of what ``hot_join`` broadcasts.
HOT_SHARE = 256
#: Bits of the maps by which rows are told that surely have no partner: 8 MB to broadcast.
MAP_BITS = 1 << 26


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a local master (tests) gets
    a temporary folder, and a cluster an error, since no folder of the driver's own would do there."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        base = getattr(spark.sparkContext, "_linkspark_dir", None)
        if not base and not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if not base:
            base = "file://" + tempfile.mkdtemp(prefix="linkspark-")
            spark.sparkContext._linkspark_dir = base
            spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Lists of the paths of tables made within ``collected``, the innermost last.
_OPEN: list[list[str]] = []


@contextmanager
def collected() -> Iterator[list[str]]:
    """The paths of all tables that ``written`` makes inside, for who knows when nothing refers to them any more."""
    paths: list[str] = []
    _OPEN.append(paths)
    try:
        yield paths
    finally:
        _OPEN.remove(paths)


def written(df: DataFrame, name: str) -> DataFrame:
    """df written as a table in the shared folder and read again, which cuts its lineage."""
    spark = df.sparkSession
    path = work_dir(spark, name)
    for paths in _OPEN:
        paths.append(path)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._linkspark_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables made by ``written`` that nothing refers to any more."""
    for t in tables:
        delete_dir(t.sparkSession, t._linkspark_path)


def delete_dir(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared store through Hadoop's own file system client."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def bounded_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small, so that a Python worker's memory doesn't depend on Spark's defaults."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def drop_shuffles_early(spark: SparkSession) -> None:
    """Let Spark delete an execution's shuffle files as it ends, not when the driver next collects garbage."""
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def fresh(df: DataFrame, base: str) -> str:
    """A column name that df doesn't have (names are compared without case, as Spark does)."""
    taken, name, i = {c.lower() for c in df.columns}, f"__{base}", 0
    while name.lower() in taken:
        i += 1
        name = f"__{base}{i}"
    return name


def free(df: DataFrame, name: str) -> str:
    """name, or where df has a column of that name already, name with the least number that makes it new."""
    taken, out, i = {c.lower() for c in df.columns}, name, 0
    while out.lower() in taken:
        i += 1
        out = f"{name}_{i}"
    return out


def let(value: Column, body) -> Column:
    """body(value) with value computed once per row: a lambda variable is bound to it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def with_field(schema: T.StructType, name: str, kind: T.DataType) -> T.StructType:
    """schema with one more column; schema itself is left alone."""
    return T.StructType([*schema.fields, T.StructField(name, kind, True)])


def _place(key: Column) -> Column:
    return F.pmod(key, F.lit(MAP_BITS))


def bit_map(keys: DataFrame, key: str) -> DataFrame:
    """A map of fixed size (``MAP_BITS``) of a column of 64-bit hashes, in rows (part, bits) of 4 KB."""
    at = _place(F.col(key))
    parts = keys.select(F.shiftright(at, 15).alias("part"), at.bitwiseAND(32767).alias("at"))
    return parts.groupBy("part").agg(F.bitmap_construct_agg("at").alias("bits"))


def in_map(rows: DataFrame, made: DataFrame, key: Column) -> tuple[DataFrame, Column]:
    """rows joined with a broadcast ``bit_map``, and whether a row's key may be in it: null or false if it isn't for sure.
    Maps that are nearly full let everything pass, which costs work and loses nothing."""
    part, bits = fresh(rows, "map_part"), fresh(rows, "map_bits")
    joined = rows.join(F.broadcast(made.select(F.col("part").alias(part), F.col("bits").alias(bits))), F.shiftright(_place(key), 15) == F.col(part), "left")
    at = _place(key).bitwiseAND(32767).cast("int")
    byte = F.conv(F.hex(F.substring(F.col(bits), F.shiftright(at, 3) + 1, F.lit(1))), 16, 10).cast("int")
    return joined, F.col(bits).isNotNull() & (F.pmod(F.call_function("shiftright", byte, at.bitwiseAND(7)), F.lit(2)) == 1)


def hot_join(rows: DataFrame, table: DataFrame, keys: list[str], n: str, values: list[str], total: int, spread: Column) -> DataFrame:
    """rows left-joined with table on keys, where a key may hold a third of all rows.

    table has one row for each key, with the number ``n`` of rows it holds. Keys above total / HOT_SHARE are fewer
    than HOT_SHARE, so they are broadcast; no other key holds more than total / HOT_SHARE rows, so an ordinary
    shuffled join serves the rest. ``spread``: a string column, different from row to row, which is part of the second
    join's key for rows already served, so that they are dealt evenly. A null key finds nothing.
    """
    least = total // HOT_SHARE
    hot = table.where(F.col(n) > least).select(*keys, F.lit(True).alias("__hot"), *[F.col(v).alias(f"__hot_{v}") for v in values])
    rest = table.where(F.col(n) <= least)
    first = rows.join(F.broadcast(hot), keys, "left")
    # Both sides' marks are made of columns: the optimizer would turn an equation with a constant into a filter, and
    # then deal rows out by the keys alone.
    mark = F.when(F.col("__hot"), F.concat(F.lit("hot:"), spread)).otherwise(F.lit(""))
    none = F.substring(F.col(n).cast("string"), 1, 0)
    second = rest.select(*keys, none.alias("__spread"), *[F.col(v).alias(f"__rest_{v}") for v in values])
    joined = first.withColumn("__spread", mark).join(second, [*keys, "__spread"], "left")
    return joined.select(*rows.columns, *[F.coalesce(F.col(f"__hot_{v}"), F.col(f"__rest_{v}")).alias(v) for v in values])
