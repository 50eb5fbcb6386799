"""Merging of tables that describe the same things."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def filled(c: Column, kind: T.DataType) -> Column:
    """The value, null if it is empty: an empty text or list, or 0."""
    if isinstance(kind, T.StringType):
        return F.when(c != "", c)
    if isinstance(kind, (T.ArrayType, T.MapType)):
        return F.when(F.size(c) > 0, c)
    return F.when(c != 0, c) if isinstance(kind, T.NumericType) else c


def first_filled(left: DataFrame, right: DataFrame, key: str, prefer_right: tuple[str, ...] = ()) -> DataFrame:
    """left's rows; each other column is left's value if filled, else right's (or the other way round)."""
    kinds = {f.name: f.dataType for f in left.schema}
    common = [c for c in right.columns if c != key and c in kinds]
    joined = left.join(right.select(key, *[F.col(c).alias(f"__{c}") for c in common]), key, "left")

    def value(c: str) -> Column:
        a, b = filled(F.col(c), kinds[c]), filled(F.col(f"__{c}"), kinds[c])
        return (F.coalesce(b, a) if c in prefer_right else F.coalesce(a, b)).alias(c)

    return joined.select(*[value(c) if c in common else F.col(c) for c in left.columns])


def first_wins(rows: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """One row for each key: that which comes first in the given order."""
    return rows.groupBy(key).agg(F.min_by(F.struct(*columns), order).alias("s")).select(key, "s.*")


def preserve(new: DataFrame, old: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """new, whose given columns keep old's values where those aren't null."""
    joined = new.join(old.select(key, *[F.col(c).alias(f"__{c}") for c in columns]), key, "left")
    return joined.select(*[F.coalesce(f"__{c}", c).alias(c) if c in columns else F.col(c) for c in new.columns])


def attach_links(books: DataFrame, versions: DataFrame) -> DataFrame:
    """books with the links of all their versions, in order, each once."""
    links = versions.select("book_uri", F.explode("links").alias("l")).groupBy("book_uri").agg(F.sort_array(F.collect_set("l")).alias("version_links"))
    return books.drop("version_links").join(links, books.uri == links.book_uri, "left").drop("book_uri").withColumn("version_links", F.coalesce("version_links", F.array().cast("array<string>")))


def enrich(authors: DataFrame, bindings: DataFrame, fetched_at: str) -> DataFrame:
    """authors with labels, aliases and years from fetched bindings (qid, label_ar, label_en, aliases_ar, aliases_en,
    death_date), joined on wikidata_id. An author whose id has no binding gets an error note."""
    from ..functions import text as tx

    got = bindings.select(F.col("qid").alias("wikidata_id"), F.col("label_ar").alias("wd_label_ar"), F.col("label_en").alias("wd_label_en"), tx.alias_parts(F.col("aliases_ar")).alias("wd_aliases_ar"), tx.alias_parts(F.col("aliases_en")).alias("wd_aliases_en"), tx.iso_year(F.col("death_date")).alias("wd_death_year"), F.lit(True).alias("__got")).dropDuplicates(["wikidata_id"])
    names = ["wd_label_ar", "wd_label_en", "wd_aliases_ar", "wd_aliases_en", "wd_death_year"]
    joined = authors.drop(*names, "wd_fetched_at", "wd_error").join(got, "wikidata_id", "left")
    has = F.col("wikidata_id").isNotNull()
    return joined.withColumns({"wd_fetched_at": F.when(F.col("__got"), F.lit(fetched_at)), "wd_error": F.when(has & F.col("__got").isNull(), F.lit("not found"))}).drop("__got")


def unseen(rows: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """rows whose key isn't stored yet."""
    return rows.join(stored.select(key), key, "left_anti")


def known(rows: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """rows whose key stored has. Its keys are told apart first, so that one with many rows there is met once."""
    return rows.join(stored.select(key).distinct(), key, "left_semi")


def upsert(stored: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """stored with new's rows in place of, or beside, its own."""
    return stored.join(new.select(key), key, "left_anti").unionByName(new)


def set_counts(found: DataFrame, truth: DataFrame) -> DataFrame:
    """How many pairs are in both tables, and in either alone."""
    a, b = found.select("rec", "book").distinct(), truth.select("rec", "book").distinct()
    joined = a.withColumn("a", F.lit(1)).join(b.withColumn("b", F.lit(1)), ["rec", "book"], "full")
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return joined.agg(count(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("both"), count(F.col("b").isNull()).alias("found_only"), count(F.col("a").isNull()).alias("truth_only"))
