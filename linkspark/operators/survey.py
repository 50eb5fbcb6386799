"""Surveys of a catalogue: n-grams, field coverage, boilerplate and special characters."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as tx
from . import ranks


#: Characters of the texts whose n-grams one task counts; a longer record is a task's by itself.
TASK_CHARS = 2_000_000


def _dealt(elements: DataFrame) -> DataFrame:
    """Elements in tasks of ``TASK_CHARS`` characters on average. Without it Spark makes tasks of equal shuffled bytes,
    and n-grams take many times the memory of their text. As many partitions are what later shuffles begin with, before
    Spark puts small ones together."""
    spark = elements.sparkSession
    chars = elements.agg(F.sum(F.length("text"))).first()[0] or 0
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-chars // TASK_CHARS))
    first = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    spark.conf.set(first, str(max(tasks, int(spark.conf.get(first, None) or 0))))
    return elements.repartition(tasks, "rec", "field")


def ngram_counts(elements: DataFrame, max_n: int = 4, tokens=tx.tokens_lat) -> DataFrame:
    """field, n, ngram, term_freq, doc_freq from (rec, field, ord, text). A record's elements are joined in order;
    n-grams do not cross from one record to the next."""
    joined = _dealt(elements).groupBy("rec", "field").agg(F.sort_array(F.collect_list(F.struct("ord", "text"))).alias("e"))
    words = joined.select("rec", "field", tokens(F.array_join(F.transform("e", lambda x: x["text"]), " ")).alias("w"))
    # A record's places of an n-gram, and once each that it has: one aggregate by n-gram, none by record.
    sized = lambda n, grams, tf, df: F.transform(grams, lambda g: F.struct(F.lit(n).alias("n"), g.alias("ngram"), F.lit(tf).alias("tf"), F.lit(df).alias("df")))
    each = F.flatten(F.array(*[sized(n, made, *k) for n in range(2, max_n + 1) for made, k in ((tx.ngrams(F.col("w"), n), (1, 0)), (F.array_distinct(tx.ngrams(F.col("w"), n)), (0, 1)))]))
    grams = words.select("field", F.inline(each))
    return grams.groupBy("field", "n", "ngram").agg(F.sum("tf").alias("term_freq"), F.sum("df").alias("doc_freq"))


def ngram_counts_across(elements: DataFrame, max_n: int = 4, tokens=tx.tokens_lat, ranges: int = ranks.RANGES) -> DataFrame:
    """As ``ngram_counts``, but term_freq is that of all records of a field as one sequence, in the order of rec: n-grams
    that begin in one record and end in a later one count too. doc_freq is by record still.

    Records go to ranges of rec. What follows a record's last tokens are the first tokens of later records; those are in
    its range, but for the last records of a range: these are worked out from the first and the last few records of every
    range, a table as small as the number of ranges."""
    edge = max_n - 1
    joined = elements.groupBy("rec", "field").agg(F.sort_array(F.collect_list(F.struct("ord", "text"))).alias("e"))
    words = joined.select("rec", "field", tokens(F.array_join(F.transform("e", lambda x: x["text"]), " ")).alias("w")).where(F.size("w") > 0)
    ends = words.select("rec", "field", F.slice("w", 1, edge).alias("head"), F.slice("w", F.greatest(F.size("w") - edge + 1, F.lit(1)), F.lit(edge)).alias("tail"))
    ranged = ends.withColumn("range", ranks.range_of("rec", ranks.bounds(elements, "rec", ranges)))
    inside = Window.partitionBy("field", "range").orderBy("rec")
    placed = ranged.withColumn("left", F.count(F.lit(1)).over(Window.partitionBy("field", "range")) - F.row_number().over(inside)).withColumn("place", F.row_number().over(inside))
    follow = lambda w: F.flatten(F.filter(F.array(*[F.lead("head", k).over(w) for k in range(1, edge + 1)]), lambda x: x.isNotNull()))
    far = placed.withColumn("next", follow(inside)).where(F.col("left") >= edge)
    few = placed.where((F.col("left") < edge) | (F.col("place") <= edge))
    near = few.withColumn("next", follow(Window.partitionBy("field").orderBy("range", "rec"))).where(F.col("left") < edge)

    def crossing(n: int) -> Column:
        t, after = F.col("tail"), F.col("next")
        whole = F.concat(F.slice(t, F.greatest(F.size(t) - n + 2, F.lit(1)), F.lit(n - 1)), F.slice(after, 1, n - 1))
        return F.transform(tx.ngrams(whole, n), lambda g: F.struct(F.lit(n).alias("n"), g.alias("ngram")))

    grams = far.unionByName(near).select("field", F.inline(F.flatten(F.array(*[crossing(n) for n in range(2, max_n + 1)])))).groupBy("field", "n", "ngram").agg(F.count(F.lit(1)).alias("more"))
    own = ngram_counts(elements, max_n, tokens)
    every = own.join(grams, ["field", "n", "ngram"], "full")
    return every.select("field", "n", "ngram", (F.coalesce("term_freq", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("term_freq"), F.coalesce("doc_freq", F.lit(0)).alias("doc_freq"))


def tfidf(counts: DataFrame, elements: DataFrame) -> DataFrame:
    """counts with tfidf = tf ln(N / df), N the number of records."""
    n = elements.agg(F.count_distinct("rec").alias("records"))
    return counts.crossJoin(F.broadcast(n)).withColumn("tfidf", F.round(F.col("term_freq") * F.log(F.col("records") / F.col("doc_freq")), 3)).drop("records")  # n is one row


def suggest_boilerplate(counts: DataFrame, elements: DataFrame, settings: DataFrame) -> DataFrame:
    """field, ngram, n, doc_freq_pct, repeats_per_doc of n-grams that meet their field's settings:
    (field, strategy, min_doc_freq_pct, max_repeats_per_doc), a row for each field."""
    n = elements.agg(F.count_distinct("rec").alias("records"))
    rated = counts.crossJoin(F.broadcast(n)).withColumns({"doc_freq_pct": F.round(100 * F.col("doc_freq") / F.col("records"), 2), "repeats_per_doc": F.round(F.col("term_freq") / F.col("doc_freq"), 3)})
    fit = rated.join(F.broadcast(settings), "field").where((F.col("doc_freq_pct") >= F.col("min_doc_freq_pct")) & ((F.col("strategy") == "freq_only") | (F.col("repeats_per_doc") <= F.col("max_repeats_per_doc"))))
    return fit.dropDuplicates(["field", "ngram"]).select("field", "ngram", "n", "doc_freq_pct", "repeats_per_doc")


def boilerplate_over(vocabulary: DataFrame, records: int | Column, min_doc_freq_pct: float = 5.0, max_repeats_per_doc: float = 1.4) -> DataFrame:
    """field, ngram of a stored vocabulary (field, ngram, term_freq, doc_freq) that is frequent, and not repeated within
    records: boilerplate without a review, for trying out limits. No records, no boilerplate."""
    n = F.lit(records) if isinstance(records, int) else records
    frequent = 100 * F.col("doc_freq") >= min_doc_freq_pct * n
    single = F.col("term_freq") <= max_repeats_per_doc * F.col("doc_freq")
    return vocabulary.where((n > 0) & (F.col("doc_freq") > 0) & frequent & single).select("field", "ngram").distinct()


#: Rankings of a report on n-grams.
RANKINGS = ("doc_freq", "term_freq", "tfidf")


def top_ngrams(rated: DataFrame, most: int = 20) -> DataFrame:
    """ranking, field, n, place, ngram, doc_freq, term_freq, tfidf: the first n-grams of each field and length by each
    ranking; ties by ngram. A report, hence limited; each task cuts its own rows before they are shuffled."""
    each = rated.select("field", "n", "ngram", *RANKINGS, F.explode(F.array(*[F.struct(F.lit(r).alias("ranking"), F.col(r).cast("double").alias("by")) for r in RANKINGS])).alias("r")).select("*", "r.*").drop("r")
    order = Window.partitionBy("ranking", "field", "n").orderBy(F.desc("by"), "ngram")
    return each.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).select("ranking", "field", "n", "place", "ngram", *RANKINGS)


def coverage(elements: DataFrame, records: int | Column) -> DataFrame:
    """Per field: records that have it, their share, elements per record, and the share of elements by script."""
    by_rec = elements.groupBy("field", "rec").agg(F.count(F.lit(1)).alias("c"), *[F.sum(F.when(x, 1).otherwise(0)).alias(k) for k, x in _scripts(F.col("text")).items()])
    out = by_rec.groupBy("field").agg(F.count(F.lit(1)).alias("records_present"), F.min("c").alias("min_per_record"), F.max("c").alias("max_per_record"), F.avg("c").alias("a"), F.sum("c").alias("total"), *[F.sum(k).alias(k) for k in _scripts(F.lit(""))])
    pct = lambda k, of: F.round(100 * F.col(k) / of, 2)
    return out.select("field", "records_present", pct("records_present", F.lit(records) if isinstance(records, int) else records).alias("coverage_pct"), (F.col("max_per_record") == 1).alias("always_single"), "min_per_record", "max_per_record", F.round("a", 3).alias("avg_per_record"), *[pct(k, F.col("total")).alias(f"{k}_pct") for k in _scripts(F.lit(""))])


def _scripts(x: Column) -> dict[str, Column]:
    x = F.coalesce(x, F.lit(""))
    a, b = tx.has_arabic(x), tx.has_latin(x)
    return {"arabic_only": a & ~b, "latin_only": b & ~a, "mixed": a & b, "empty": ~a & ~b}


def samples(elements: DataFrame, n: int = 5, chars: int = 140) -> DataFrame:
    """field, samples: the first values of each field, shortened. A report, hence limited."""
    short = elements.select("field", F.struct("rec", "ord", F.left("text", F.lit(chars)).alias("text")).alias("s"))
    few = short.withColumn("k", F.row_number().over(Window.partitionBy("field").orderBy("s"))).where(F.col("k") <= n)
    return few.groupBy("field").agg(F.transform(F.sort_array(F.collect_list("s")), lambda s: s["text"]).alias("samples"))


def characters(texts: DataFrame, column: str = "text") -> DataFrame:
    """character, code, count of characters outside ASCII."""
    each = texts.select(F.explode(F.split(F.regexp_replace(column, r"[\x00-\x7F]+", ""), "")).alias("character")).where("character != ''")
    counted = each.groupBy("character").agg(F.count(F.lit(1)).alias("count"))
    return counted.select("character", F.concat(F.lit("U+"), F.lpad(F.hex(F.ascii("character")), 4, "0")).alias("code"), "count")


def character_names(inventory: DataFrame) -> DataFrame:
    """The inventory with Unicode names and categories. Its rows are as many as there are characters, at most 1.1 million."""
    @F.pandas_udf("name string, category string")
    def known(c: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"name": [unicodedata.name(x, "") for x in c], "category": [unicodedata.category(x) for x in c]})

    return inventory.withColumn("u", known("character")).select("*", "u.name", "u.category").drop("u")


def conversion_table(inventory: DataFrame) -> DataFrame:
    """A table to be filled in by hand, the most frequent characters first: what each is written as in the corpus goes
    into ``equivalent`` (itself to keep it, nothing to drop it)."""
    named = character_names(inventory)
    return named.orderBy(F.desc("count"), "character").select(
        "character", F.col("code").alias("unicode_code"), F.when(F.col("name") == "", "UNKNOWN").otherwise(F.col("name")).alias("unicode_name"), "category",
        F.lit("").alias("equivalent"), F.concat(F.lit("Frequency: "), F.col("count").cast("string")).alias("notes"),
    )
