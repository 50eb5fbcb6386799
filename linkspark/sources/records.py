"""Readers of catalogue sources: Dublin Core XML, key/value metadata files, corpus listings, CSV tables and stores."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as tx
from ..operators import merge

DC = ("title", "creator", "contributor", "description", "format", "subject", "coverage", "language", "identifier", "relation", "source", "date", "type")


def xml_files(spark: SparkSession, folder: str, pattern: str = "*.xml") -> DataFrame:
    """path, stem, value: one row for each file, found at any depth."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(folder, wholetext=True)
    path = F.col("_metadata.file_path")
    return files.select(path.alias("path"), F.regexp_extract(path, r"([^/]+)\.[^./]+$", 1).alias("stem"), "value")


_PARSED = "struct<error:string,has_dc:boolean," + ",".join(f"{n}:array<string>" for n in DC) + ">"


def _parse(files: pa.Array) -> pa.Array:
    """One pass over each file: the texts of its Dublin Core elements by local name, or why it can't be parsed."""
    from xml.etree import ElementTree

    local = lambda tag: tag.rpartition("}")[2] if isinstance(tag, str) else ""
    out = []
    for value in files.to_pylist():
        row: dict = {"error": None, "has_dc": False} | {n: [] for n in DC}
        try:
            root = ElementTree.fromstring((value or "").lstrip("\ufeff"))
        except (ElementTree.ParseError, ValueError) as e:
            out.append(row | {"error": f"not well-formed: {e}"})
            continue
        for dc in (x for x in root.iter() if local(x.tag) == "dc"):
            for x in dc:
                row["has_dc"] = True
                if (name := local(x.tag)) in row and name in DC and x.text and x.text.strip():
                    row[name].append(x.text.strip())
        out.append(row if row["has_dc"] else row | {"error": "no Dublin Core element"})
    return pa.array(out, pa.struct([("error", pa.string()), ("has_dc", pa.bool_()), *[(n, pa.list_(pa.string())) for n in DC]]))


def dublin_core(files: DataFrame) -> DataFrame:
    """path, stem, error, has_dc and an array of trimmed, non-empty texts for each element. A file that can't be parsed,
    or has no Dublin Core, is a row with its error and empty arrays."""
    parsed = files.select("path", "stem", F.arrow_udf(_parse, _PARSED)(F.col("value")).alias("p"))
    return parsed.select("path", "stem", F.col("p.error").alias("error"), F.col("p.has_dc").alias("has_dc"), *[F.transform(F.col(f"p.{n}"), tx.repair_c1).alias(n) for n in DC])


def parse_errors(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("error").isNotNull()).select("path", "error")


def manuscripts(parsed: DataFrame, composite_min_creators: int = 2, segments: Column | None = None) -> DataFrame:
    """Records of manuscripts from ``dublin_core``. segments: a column of array<struct<segment, label>> over the
    descriptions; by default, whole descriptions that are short enough."""
    from ..operators import segment as sg

    rows = parsed.where("has_dc").withColumns({"creator": F.transform("creator", tx.clean_creator), "contributor": F.transform("contributor", tx.clean_creator)})
    rows = rows.withColumn("__segments", sg.segment(F.col("description"), F.col("title")) if segments is None else segments)
    lat_ara: dict[str, Column] = {}
    for c in ("title", "creator", "description", "contributor"):
        lat_ara[f"{c}_lat"], lat_ara[f"{c}_ara"] = tx.split_scripts(F.col(c))
    for s, keep in (("lat", lambda x: ~tx.has_arabic(x["segment"])), ("ara", lambda x: tx.has_arabic(x["segment"]))):
        own = F.filter("__segments", keep)
        lat_ara[f"description_candidates_{s}"] = F.transform(own, lambda x: x["segment"])
        lat_ara[f"description_candidate_labels_{s}"] = F.transform(own, lambda x: x["label"])
    raw_date = F.get("date", F.lit(0))
    first, last = tx.date_range(raw_date)
    catalogue = F.get(F.filter("relation", lambda r: F.contains(r, F.lit("archivesetmanuscrits"))), F.lit(0))
    out = rows.select(
        F.col("stem").alias("record_id"),
        F.get("identifier", F.lit(0)).alias("gallica_url"),
        catalogue.alias("catalogue_url"),
        *[v.alias(k) for k, v in lat_ara.items()],
        F.col("format").alias("format_raw"),
        "subject",
        "coverage",
        "language",
        tx.shelfmark(F.get("source", F.lit(0))).alias("shelfmark"),
        raw_date.alias("copy_date_raw"),
        first.alias("date_from"),
        last.alias("date_to"),
    )
    some = lambda *cs: (F.size(F.concat(*cs)) > 0).cast("int")
    signals = some("creator_lat", "creator_ara") + some("title_lat", "title_ara") + some("description_lat", "description_ara") + some("contributor_lat", "contributor_ara") + some("subject") + some("coverage") + F.col("date_from").isNotNull().cast("int")
    return out.withColumns({"is_composite": F.size("creator_lat") >= composite_min_creators, "signal_count": signals})


def key_values(spark: SparkSession, folder: str, pattern: str = "*.yml") -> DataFrame:
    """path, stem, kind (author, book or version, by the dots in the name) and entries: array<struct<key, value>> in
    file order. Lines that begin with four spaces continue the value before them."""
    return entries_of(xml_files(spark, folder, pattern).withColumn("stem", F.regexp_extract("path", r"([^/]+)\.yml$", 1)))


def entries_of(files: DataFrame) -> DataFrame:
    """As ``key_values``, from (path, stem, value)."""
    dots = F.size(F.split("stem", r"\.")) - 1
    lines = F.split(F.regexp_replace(F.regexp_replace("value", "\r", ""), r"\n {4,}\s*", " "), "\n")
    entry = r"^(\d+#[A-Z]+#[A-Z]+(?:#[A-Z]*)*?)#*:\s*(.*)$"
    pairs = F.transform(F.filter(lines, lambda x: x.rlike(entry)), lambda x: F.struct(F.regexp_extract(x, entry, 1).alias("key"), F.trim(F.regexp_extract(x, entry, 2)).alias("value")))
    return files.select("path", "stem", F.when(dots == 0, "author").when(dots == 1, "book").otherwise("version").alias("kind"), pairs.alias("entries"))


def lookup(*fragments: str) -> Column:
    """The value of the first entry whose key has all fragments; null if it is a template text."""
    def fits(e: Column) -> Column:
        out = F.lit(True)
        for f in fragments:
            out = out & F.contains(e["key"], F.lit(f))
        return out

    return tx.filled_in(F.get(F.filter("entries", fits), F.lit(0))["value"])


def _external(pattern: str) -> Column:
    return F.nullif(F.regexp_extract(F.coalesce(lookup("EXTID"), F.lit("")), pattern, 1), F.lit(""))


def authors(entries: DataFrame) -> DataFrame:
    year, slug, _ = tx.uri_parts(F.col("uri"))
    rows = entries.where("kind = 'author'").withColumn("uri", F.coalesce(lookup("URI"), F.col("stem")))
    names = [lookup(p.upper(), "AR").alias(f"name_{p}_lat") for p in ("shuhra", "ism", "kunya", "laqab", "nasab", "nisba")]
    arabic = [F.lit(None).cast("string").alias(f"name_{p}_ara") for p in ("shuhra", "ism", "kunya", "laqab", "nasab", "nisba")]
    empty = F.lit(None).cast("array<string>")
    return rows.select("uri", year.alias("death_year_ah"), slug.alias("name_slug"), *names, *arabic, _external(r"wikidata@(Q\d+)").alias("wikidata_id"), F.lit(None).cast("string").alias("wd_label_ar"), F.lit(None).cast("string").alias("wd_label_en"), empty.alias("wd_aliases_ar"), empty.alias("wd_aliases_en"), F.lit(None).cast("int").alias("wd_death_year"), F.lit(None).cast("string").alias("wd_fetched_at"), F.lit(None).cast("string").alias("wd_error"))


def books(entries: DataFrame) -> DataFrame:
    year, slug, title = tx.uri_parts(F.col("uri"))
    rows = entries.where("kind = 'book'").withColumn("uri", F.coalesce(lookup("URI"), F.col("stem")))
    parts = lambda c: F.when(c.isNotNull(), tx.title_parts(c))
    return rows.select("uri", F.substring_index("uri", ".", 1).alias("author_uri"), year.alias("death_year_ah"), slug.alias("author_slug"), title.alias("title_slug"), parts(lookup("TITLEA", "AR")).alias("title_lat"), F.lit(None).cast("array<string>").alias("title_ara"), _external(r"wikidata@(Q\d+)").alias("wikidata_id"), _external(r"viaf@(\d+)").alias("viaf_id"))


def versions(entries: DataFrame) -> DataFrame:
    linked = F.filter("entries", lambda e: e["key"].rlike("LINKS|BASED|COLLATED"))
    urls = F.flatten(F.transform(linked, lambda e: F.regexp_extract_all(e["value"], F.lit(r"https?://\S+"), F.lit(0))))
    rows = entries.where("kind = 'version'").withColumn("uri", F.coalesce(lookup("URI"), F.col("stem")))
    return rows.select("uri", F.substring_index("uri", ".", 2).alias("book_uri"), urls.alias("links"))


LISTING = T.StructType([T.StructField(n, T.StringType()) for n in ("version_uri", "language", "author_ar", "author_lat", "author_lat_shuhra", "book", "title_ar", "title_lat", "tags")])


def listing(spark: SparkSession, path: str) -> DataFrame:
    """A corpus listing (one row per version), with author_uri, book_uri and the row order: files by their paths, a file's
    parts by their offsets, and the rows of a part, which one task reads, as they are read."""
    rows = spark.read.schema(LISTING).option("header", "true").csv(path, sep="\t", quote="")
    rows = rows.withColumn("row_no", F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("row")))
    book = F.coalesce(tx.blank_to_null(F.col("book")), F.substring_index("version_uri", ".", 2))
    return rows.withColumns({"book_uri": book, "author_uri": F.substring_index(book, ".", 1)})


def listed_books(rows: DataFrame) -> DataFrame:
    """Books of a listing, each as its first version has it."""
    first = merge.first_wins(rows, "book_uri", "row_no", ["author_uri", "title_lat", "title_ar"])
    year, slug, title = tx.uri_parts(F.col("book_uri"))
    parts = lambda c: F.when(tx.blank_to_null(F.col(c)).isNotNull(), tx.metadata_parts(F.col(c)))
    return first.select(F.col("book_uri").alias("uri"), "author_uri", year.alias("death_year_ah"), slug.alias("author_slug"), title.alias("title_slug"), parts("title_lat").alias("title_lat"), parts("title_ar").alias("title_ara"))


def listed_authors(rows: DataFrame) -> DataFrame:
    first = merge.first_wins(rows, "author_uri", "row_no", ["author_lat", "author_lat_shuhra", "author_ar"])
    year, slug, _ = tx.uri_parts(F.col("author_uri"))
    return first.select(F.col("author_uri").alias("uri"), year.alias("death_year_ah"), slug.alias("name_slug"), tx.blank_to_null(F.col("author_lat_shuhra")).alias("name_shuhra_lat"), tx.blank_to_null(F.col("author_ar")).alias("name_shuhra_ara"))


def json_store(spark: SparkSession, path: str, name: str, kind: T.StructType) -> DataFrame:
    """Rows of a store ``{"_meta": ..., name: {id: record}}``; unknown shapes fail."""
    schema = T.StructType([T.StructField(name, T.MapType(T.StringType(), kind))])
    return spark.read.schema(schema).option("multiLine", "true").option("mode", "FAILFAST").json(path).select(F.explode(name).alias("id", "r")).select("r.*")


def csv_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A CSV table with a header; a byte order mark at its start does no harm."""
    return spark.read.schema(schema).option("header", "true").option("enforceSchema", "true").option("encoding", "UTF-8").csv(path)


CONVERSIONS = T.StructType([T.StructField(n, T.StringType()) for n in ("character", "unicode_code", "unicode_name", "category", "equivalent", "notes")])


def conversions(spark: SparkSession, path: str) -> dict[str, str]:
    """A conversion table that was filled in: characters and what they become, for ``text.convert``. It has a row for each
    character, so its size is bounded by their number; of rows for one character the least text counts."""
    rows = csv_table(spark, path, CONVERSIONS).where("character IS NOT NULL AND length(character) = 1")
    return {r[0]: r[1] for r in rows.groupBy("character").agg(F.min(F.coalesce(F.trim("equivalent"), F.lit("")))).collect()}


def curated_phrases(spark: SparkSession, path: str) -> DataFrame:
    """field, ngram, signal_type (null for boilerplate) of reviewed phrases: JSON files ``{"boilerplate": [...], "signals":
    [...]}`` whose entries are objects or, in older files, texts; or, older still, a list of texts. A phrase without
    a field is the description's. Signals of no type are boilerplate. An entry without a phrase is left out."""
    return phrases_of(spark.read.text(path, wholetext=True))


def phrases_of(contents: DataFrame) -> DataFrame:
    """``curated_phrases`` of files' contents: value."""
    value = F.trim("value")
    listed = F.from_json(value, "array<string>")
    parts = F.from_json(value, "boilerplate array<string>, signals array<struct<ngram:string,field:string,signal_type:string>>")
    files = contents.select(F.when(value.startswith("["), listed).otherwise(parts["boilerplate"]).alias("plain"), F.when(~value.startswith("["), parts["signals"]).alias("signals"))
    entry = F.when(F.col("e").startswith("{"), F.from_json("e", "ngram string, field string")).otherwise(F.struct(F.col("e").alias("ngram"), F.lit(None).cast("string").alias("field")))
    plain = files.select(F.explode("plain").alias("e")).select(entry.alias("e")).select("e.field", "e.ngram", F.lit(None).cast("string").alias("signal_type"))
    signals = files.select(F.explode("signals").alias("e")).select("e.field", "e.ngram", tx.blank_to_null(F.col("e.signal_type")).alias("signal_type"))
    return plain.union(signals).where("ngram IS NOT NULL AND ngram != ''").select(F.coalesce("field", F.lit("description")).alias("field"), "ngram", "signal_type").distinct()


def truth(spark: SparkSession, path: str) -> DataFrame:
    """rec, book from a JSON list of pairs; book is null where no match is expected."""
    pairs = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "array<array<string>>")).alias("p"))
    return pairs.select(F.get("p", F.lit(1)).alias("rec"), F.nullif(F.get("p", F.lit(0)), F.lit("null")).alias("book"))
