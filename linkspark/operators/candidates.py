"""Candidate construction: the strings of a record, an author or a book that are compared."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx


def _strings(*columns: Column) -> Column:
    return F.filter(F.array(*columns), lambda x: x.isNotNull() & (x != ""))


def _list(c: Column) -> Column:
    return F.coalesce(c, F.array().cast("array<string>"))


def record_candidates(records: DataFrame, purpose: str = "all") -> DataFrame:
    """record_id, script, ord, raw: creators, contributors, title parts and description candidates, each value once per
    script. purpose ``title``: titles and description candidates only."""
    def of(s: str) -> Column:
        titles = F.flatten(F.transform(_list(F.col(f"title_{s}")), tx.title_parts))
        names = [_list(F.col(f"creator_{s}")), _list(F.col(f"contributor_{s}"))] if purpose != "title" else []
        return F.array_distinct(F.filter(F.concat(*names, titles, _list(F.col(f"description_candidates_{s}"))), lambda x: x != ""))

    rows = [records.select("record_id", F.lit(s).alias("script"), F.posexplode(of(s)).alias("ord", "raw")) for s in ("lat", "ara")]
    return rows[0].unionByName(rows[1])


def author_variants(authors: DataFrame, with_arabic_names: bool = False) -> DataFrame:
    """uri, script, ord, variant. Arabic name parts are used only on request."""
    parts = ("shuhra", "ism", "kunya", "laqab", "nasab", "nisba")
    lat = F.concat(_strings(F.col("name_slug"), F.col("wd_label_en")), _list(F.col("wd_aliases_en")), _strings(*[F.col(f"name_{p}_lat") for p in parts]))
    ara = F.concat(_strings(F.col("wd_label_ar")), _list(F.col("wd_aliases_ar")), *([_strings(*[F.col(f"name_{p}_ara") for p in parts])] if with_arabic_names else []))
    rows = [authors.select("uri", F.lit(s).alias("script"), F.posexplode(v).alias("ord", "variant")) for s, v in (("lat", lat), ("ara", ara))]
    return rows[0].unionByName(rows[1])


def book_variants(books: DataFrame) -> DataFrame:
    """uri, script, ord, variant: the parts of the titles."""
    rows = [books.select("uri", F.lit(s).alias("script"), F.posexplode(_list(F.col(f"title_{s}"))).alias("ord", "variant")) for s in ("lat", "ara")]
    return rows[0].unionByName(rows[1]).where("variant != ''")


def candidate_uses(candidates: DataFrame, rec: str = "record_id", raw: str = "raw", table: bool = True) -> DataFrame:
    """cand_norm, rec: one row for each use of a normalised candidate, so no candidate's records meet in one row."""
    normal = candidates.select(F.col(rec).alias("rec"), tx.normalize_for_matching(F.col(raw), table=table).alias("cand_norm"))
    return normal.where("cand_norm != ''").select("cand_norm", "rec").distinct()


def fanout(uses: DataFrame) -> DataFrame:
    """How many candidates there are, and how many uses of them; counted before the shuffle."""
    by_candidate = uses.groupBy("cand_norm").agg(F.count(F.lit(1)).alias("n"))
    return by_candidate.agg(F.count(F.lit(1)).alias("candidates"), F.sum("n").alias("uses"))


#: Parts into which the members of a key are dealt by their names; or give a column that limits a part by itself.
PARTS = 1024


def members(rows: DataFrame, key: str, of: str, name: str, part: Column | None = None) -> DataFrame:
    """key, part, and the list ``name`` of the distinct ``of``: a row for each part of a key's members, not one for all, so
    a key that a third of all rows has is many rows in many tasks. Keys of few members have few parts."""
    dealt = rows.select(F.col(key), (F.pmod(F.xxhash64(of), F.lit(PARTS)) if part is None else part).alias("part"), F.col(of).alias("__of"))
    return dealt.groupBy(key, "part").agg(F.sort_array(F.collect_set("__of")).alias(name))


def candidate_index(candidates: DataFrame, rec: str = "record_id", raw: str = "raw", table: bool = True, part: Column | None = None) -> DataFrame:
    """cand_norm, part, rec_ids: which records have a normalised candidate, in parts. part: a column of rec."""
    return members(candidate_uses(candidates, rec, raw, table), "cand_norm", "rec", "rec_ids", part)


def without_candidates(index: DataFrame, gone: DataFrame) -> DataFrame:
    return index.join(gone.select("cand_norm"), "cand_norm", "left_anti")


def books_by_author(books: DataFrame, part: Column | None = None) -> DataFrame:
    """author_uri, part, books: in parts, as an author of unknown books has many."""
    return members(books, "author_uri", "uri", "books", part)


def cull_author_tokens(books: DataFrame, variants: DataFrame, column: str = "title_ara") -> DataFrame:
    """books whose title parts have lost the tokens of their author's names. A part from which nothing is removed
    stays as it was; one that loses tokens is replaced by its normalised rest."""
    tokens = variants.select(F.col("uri").alias("author_uri"), F.explode(F.split(tx.normalize_for_matching(F.col("variant"), is_corpus=True), " ")).alias("t"))
    by_author = tokens.where("t != ''").groupBy("author_uri").agg(F.collect_set("t").alias("__names"))

    def culled(part: Column) -> Column:
        words = F.split(tx.normalize_for_matching(part, is_corpus=True), " ")
        left = F.filter(words, lambda w: ~F.array_contains(F.col("__names"), w))
        return F.when(F.size(left) < F.size(words), F.array_join(left, " ")).otherwise(part)

    joined = books.join(by_author, "author_uri", "left")
    return joined.withColumn(column, F.when(F.col("__names").isNull(), F.col(column)).otherwise(F.transform(column, culled))).select(*books.columns)


def plain_candidates(rows: DataFrame, lat: list[Column], ara: list[Column], strategy: str = "fuzzy") -> DataFrame:
    """uri, script, ord, cand: the named values of each row in the older normalisation, each once for a script, without empty ones.
    lat, ara: the columns (texts or lists of texts) in order."""

    def of(columns: list[Column], script: str) -> Column:
        made = F.transform(F.filter(F.concat(*columns), lambda x: x.isNotNull() & (x != "")), lambda x: tx.legacy_normalize(x, script, strategy))
        return F.array_distinct(F.filter(made, lambda x: x != ""))

    each = [rows.select("uri", F.lit(s).alias("script"), F.posexplode(of(c, s)).alias("ord", "cand")) for s, c in (("lat", lat), ("ara", ara)) if c]
    return each[0] if len(each) == 1 else each[0].unionByName(each[1])


def plain_book_candidates(books: DataFrame, strategy: str = "fuzzy") -> DataFrame:
    """Of books with one title a script: the titles, and the slug of the URI where there is no Latin title."""
    slug = F.when(F.coalesce("title_lat", F.lit("")) == "", F.col("title_slug"))
    return plain_candidates(books, [F.array("title_lat"), F.array(slug)], [F.array("title_ara")], strategy)


def plain_author_candidates(authors: DataFrame, strategy: str = "fuzzy") -> DataFrame:
    """Of authors: the slug, labels, aliases and the six parts of a name, in this order."""
    parts = lambda s: F.array(*[F.col(f"name_{p}_{s}") for p in ("shuhra", "ism", "kunya", "laqab", "nasab", "nisba")])
    return plain_candidates(authors, [F.array("name_slug", "wd_label_en"), _list(F.col("wd_aliases_en")), parts("lat")], [parts("ara"), F.array("wd_label_ar"), _list(F.col("wd_aliases_ar"))], strategy)
