"""Deterministic samples: by a hash of the id, whole or by strata; and the strata of manuscripts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Words by which subjects are told apart, in this order.
SUBJECTS = {
    "historiography": ("histoire", "histoire.", "biography", "biographie", "généalogie", "genealogy", "tabaqat"),
    "religious": ("qur", "coran", "hadith", "tafsir", "fiqh", "droit", "théologie", "jurisprudence", "sharia", "shariah"),
    "sciences": ("science", "astronomie", "médecin", "medicine", "mathématique", "mathematics", "géographie", "geography"),
    "language": ("langue", "language", "grammaire", "grammar", "linguistique", "littérature", "literature", "poésie", "poetry"),
}


def order_key(id_col: str, seed: int) -> Column:
    return F.xxhash64(F.col(id_col), F.lit(seed))


def simple(df: DataFrame, n: int, id_col: str, seed: int = 42, key: Column | None = None) -> DataFrame:
    """n rows, by the order of a hash."""
    k = order_key(id_col, seed) if key is None else key
    return df.orderBy(k, id_col).limit(n)


def stratified(df: DataFrame, strata: list[str], n: int, id_col: str, seed: int = 42, key: Column | None = None) -> DataFrame:
    """About n rows in proportion to the strata, one at least of each, then cut or filled up to n exactly (or all)."""
    k = order_key(id_col, seed) if key is None else key
    sizes = df.groupBy(*strata).agg(F.count(F.lit(1)).alias("__size"))
    total = df.agg(F.count(F.lit(1)).alias("__total"))
    quota = sizes.crossJoin(F.broadcast(total)).withColumn("__quota", F.least("__size", F.greatest(F.lit(1), F.round(F.col("__size") / F.col("__total") * n))))  # total is one row
    within = Window.partitionBy(*strata).orderBy("__key", id_col)
    # No stratum gives more than n rows, so Spark keeps the first n of each before it shuffles.
    ranked = df.withColumn("__key", k).withColumn("__rank", F.row_number().over(within)).where(F.col("__rank") <= n)
    joined = ranked.join(quota, strata)
    # Those within their quota come first, then the rest, each by the hash.
    return joined.orderBy(F.when(F.col("__rank") <= F.col("__quota"), 0).otherwise(1), "__key", id_col).limit(n).select(*df.columns)


def manuscript_strata(records: DataFrame) -> DataFrame:
    """records with completeness, subject_class, period, kind and richness."""
    n = lambda *cs: sum((F.coalesce(F.size(c), F.lit(0)) for c in cs[1:]), F.coalesce(F.size(cs[0]), F.lit(0)))
    n_c, n_t = n("creator_lat", "creator_ara"), n("title_lat", "title_ara")
    subject = F.lit("other")
    has = lambda words: F.exists(F.coalesce("subject", F.array().cast("array<string>")), lambda s: F.greatest(*[F.contains(F.lower(s), F.lit(w)) for w in words]))
    for name, words in reversed(SUBJECTS.items()):
        subject = F.when(has(words), name).otherwise(subject)
    y = F.col("date_from")
    return records.withColumns({
        "completeness": F.when((n_c > 0) & (n_t > 0), "both").when(n_c > 0, "author_only").when(n_t > 0, "title_only").otherwise("sparse"),
        "subject_class": subject,
        "period": F.when(y.isNull(), "unknown").when(y < 900, "early").when(y < 1200, "medieval").otherwise("late"),
        "kind": F.when(F.col("is_composite"), "composite").otherwise("single_author"),
        "richness": F.when((n_c >= 3) | (n_t >= 2) | (n("description_lat") >= 5), "rich").when((n_c >= 1) | (n_t >= 1) | (n("description_lat") >= 2), "moderate").otherwise("sparse"),
    })


def is_quran(records: DataFrame, keywords: tuple[str, ...] = ("coran", "qurʾān", "quran")) -> Column:
    lat = F.exists("title_lat", lambda t: F.greatest(*[F.contains(F.lower(t), F.lit(k)) for k in keywords]))
    return F.coalesce(lat, F.lit(False)) | F.coalesce(F.exists("title_ara", lambda t: F.contains(t, F.lit("القرآن")) | F.contains(t, F.lit("الفرقان"))), F.lit(False))
