"""Tables of scores for a look at each decision of a linkage: by book and stage, by final match, and against a truth.

run: a ``Linkage`` with results; truth: (rec, book), book null where none is expected; books: (book, author_uri,
book_title, author_name); creators: (rec, has_creator_lat, has_creator_ara). Scores have four digits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .linkage import Linkage, by_record


def _four(c: str, name: str | None = None) -> Column:
    return F.round(c, 4).alias(name or c)


def author_scores(run: Linkage, truth: DataFrame, books: DataFrame, creators: DataFrame) -> DataFrame:
    """Every book that any stage came across for a record of the truth, its expected one, and all books of its authors. Tables with a row for each
    record are small as files but not in memory, so none of them is broadcast."""
    many = truth.count()
    by = lambda df, *more: by_record(df, many, *more).hint("merge")
    wanted = truth.select("rec", F.col("book").alias("expected_book")).distinct()
    titles = run.titles.select("rec", F.col("uri").alias("book"), F.col("score").alias("title_score"))
    authors = run.authors.select("rec", F.col("uri").alias("author_uri"), "raw", "idf_score", F.col("score").alias("final"))
    finals = run.combined.select("rec", "book", F.col("score").alias("combined_score"))
    owned = authors.join(books.select("book", "author_uri"), "author_uri").select("rec", "book")
    met = titles.select("rec", "book").union(finals.select("rec", "book")).union(wanted.where("expected_book IS NOT NULL").select("rec", "expected_book")).union(owned)
    met = by_record(met, many, "book").distinct().join(by(titles, "book"), ["rec", "book"], "left").join(by(finals, "book"), ["rec", "book"], "left").join(books, "book")
    rows = by_record(met, many, "author_uri").join(by(authors, "author_uri"), ["rec", "author_uri"], "left")
    rows = by_record(rows, many).join(by(wanted), "rec").join(by(creators), "rec", "left")
    return rows.select(
        F.col("rec").alias("record_id"), "expected_book", F.col("book").alias("book_uri"), F.left("book_title", F.lit(50)).alias("book_title"), "author_uri", F.left("author_name", F.lit(40)).alias("author_name"),
        _four("raw", "score_raw"), _four("idf_score", "score_idf"), _four("final", "score_final"),
        F.coalesce(F.col("idf_score") > F.col("raw"), F.lit(False)).alias("idf_boosted"), F.coalesce(F.abs(F.col("final") - F.col("idf_score")) > 1e-6, F.lit(False)).alias("creator_reweighted"),
        _four("title_score"), _four("combined_score"), F.col("final").isNotNull().alias("in_stage1"), F.col("title_score").isNotNull().alias("in_stage2"), F.col("combined_score").isNotNull().alias("in_stage3"),
        F.col("book").eqNullSafe(F.col("expected_book")).alias("is_expected"), *[F.coalesce(c, F.lit(False)).alias(c) for c in ("has_creator_lat", "has_creator_ara")],
    )


def combined_scores(run: Linkage, truth: DataFrame, books: DataFrame, creators: DataFrame) -> DataFrame:
    """Every final match of a record of the truth, with the author's score before and after boosts and reweighting."""
    wanted = truth.select("rec", F.col("book").alias("expected_uri")).distinct()
    authors = run.authors.select("rec", F.col("uri").alias("author"), F.col("raw"), F.col("score").alias("post"))
    rows = run.combined.join(wanted, "rec").join(authors, ["rec", "author"], "left").join(books.select("book", "author_name"), "book", "left").join(creators, "rec", "left")
    return rows.select(
        F.col("rec").alias("record_id"), "expected_uri", F.col("book").alias("matched_uri"), F.col("book").eqNullSafe(F.col("expected_uri")).alias("is_correct"), "rank", F.col("author").alias("author_uri"),
        F.left("author_name", F.lit(40)).alias("author_name"), _four("raw", "author_score_pre"), _four("post", "author_score_post"), *[F.coalesce(c, F.lit(False)).alias(c) for c in ("has_creator_lat", "has_creator_ara")], _four("title_score"), _four("score", "combined_score"),
    )


def validation(run: Linkage, truth: DataFrame) -> DataFrame:
    """Every final match of a record of the truth against all the books that are expected for it."""
    many = truth.count()
    wanted = by_record(truth.select("rec", "book"), many).groupBy("rec").agg(F.array_sort(F.collect_set("book")).alias("books"))
    counted = by_record(run.combined, many).withColumn("num_matches_for_record", F.count(F.lit(1)).over(Window.partitionBy("rec")))
    rows = counted.join(wanted, "rec")
    return rows.select(
        F.col("rec").alias("record_id"), F.array_join("books", "|").alias("expected_book"), F.col("book").alias("winning_match"), F.array_contains("books", F.col("book")).alias("is_expected_match"), (F.size("books") == 0).alias("is_null_expected"),
        F.col("author").alias("author_uri"), _four("author_score"), _four("title_score"), _four("score", "combined_score"), "num_matches_for_record",
    )
