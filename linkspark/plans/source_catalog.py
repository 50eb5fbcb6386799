"""Registered queries of sources, sinks, catalogue fields and candidates, each with DuckDB's SQL.

The sources' formats are made from whole tables: text formats as columns where the reader takes file contents, and as
files in the shared folder (``spark.checkpoint.dir``) where the file scan itself is asked for.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import candidates as cd
from ..operators import merge, ranks, segment, survey
from ..sources import id_maps, records, sinks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return register


def table(s: SparkSession, d: str, name: str) -> DataFrame:
    return s.read.parquet(f"{d}/{name}.parquet")


def folder(s: SparkSession, name: str) -> str:
    """A new folder in the shared one; with a local master and none set, a temporary one."""
    base = s.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not s.sparkContext.master.startswith("local") or s.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a shared folder")
        base = "file://" + tempfile.mkdtemp(prefix="linkspark-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _phone(key: str) -> Column:
    return F.concat(F.lit("T"), F.col(key).cast("string"))


def joined(c: str | Column) -> Column:
    return F.array_join(c, "|")


# Dublin Core files: the scan of files, elements, errors and the fields of a record

XML = "<r xmlns:oai_dc='o' xmlns:dc='d'><oai_dc:dc>{}</oai_dc:dc></r>"


def _escaped(c: str | Column) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


def _element(name: str, c: str | Column) -> Column:
    return F.concat(F.lit(f"<dc:{name}> "), _escaped(c), F.lit(f" </dc:{name}>"))


def _xml(s: SparkSession, d: str) -> DataFrame:
    """A catalogue of customers; every 50th file is cut short, and every 70th has no Dublin Core."""
    c = table(s, d, "customer")
    year = (1500 + F.col("c_custkey") % 400).cast("string")
    body = F.concat(
        _element("title", F.concat("c_name", F.lit(". part "), "c_mktsegment", F.lit("."))),
        _element("creator", F.concat(F.lit("\u008a"), "c_name", F.lit(" (1833?-1898). Copiste"))),
        F.when(F.col("c_custkey") % 3 == 0, _element("creator", F.lit("عبد الله"))).otherwise(F.lit("<dc:creator> </dc:creator>")),
        _element("contributor", F.concat(_phone("c_custkey"), F.lit(". Traducteur"))),
        F.when(F.col("c_custkey") % 2 == 0, _element("description", "c_mktsegment")).otherwise(F.lit("")),
        _element("source", F.concat(F.lit("Lib. Dept. Ms "), F.col("c_custkey").cast("string"))),
        _element("date", F.when(F.col("c_custkey") % 4 == 0, F.lit("vers 1300")).when(F.col("c_custkey") % 4 == 1, year).otherwise(F.concat(year, F.lit("-1999")))),
        _element("identifier", F.concat(F.lit("http://example.org/"), F.col("c_custkey").cast("string"))),
        _element("relation", F.concat(F.lit("see http://archivesetmanuscrits.example/"), F.col("c_custkey").cast("string"))),
        _element("subject", "c_mktsegment"),
    )
    head, tail = (F.lit(x) for x in XML.split("{}"))
    whole = F.when(F.col("c_custkey") % 50 == 0, F.concat(head, body)).when(F.col("c_custkey") % 70 == 0, F.lit("<r><x>y</x></r>")).otherwise(F.concat(F.lit("﻿"), head, body, tail))
    return c.select(F.concat(F.lit("mem/"), F.col("c_custkey").cast("string")).alias("path"), F.col("c_custkey").cast("string").alias("stem"), whole.alias("value"))


GOOD = "c_custkey % 50 <> 0 AND c_custkey % 70 <> 0"


@query(f"SELECT c_custkey::VARCHAR AS stem, CASE WHEN c_custkey % 50 = 0 THEN 'not well-formed' ELSE 'no Dublin Core element' END AS error FROM customer WHERE NOT ({GOOD})")
def xml_errors(s, d):
    bad = records.parse_errors(records.dublin_core(_xml(s, d)))
    return bad.select(F.substring_index("path", "/", -1).alias("stem"), F.substring_index("error", ":", 1).alias("error"))


@query(f"""SELECT c_custkey::VARCHAR AS stem, c_name || '. part ' || c_mktsegment || '.' AS title,
  'Š' || c_name || ' (1833?-1898). Copiste' || CASE WHEN c_custkey % 3 = 0 THEN '|عبد الله' ELSE '' END AS creator, 'T' || c_custkey || '. Traducteur' AS contributor FROM customer WHERE {GOOD}""")
def dc_elements(s, d):
    parsed = records.dublin_core(_xml(s, d)).where("has_dc")
    return parsed.select("stem", joined("title").alias("title"), joined("creator").alias("creator"), joined("contributor").alias("contributor"))


@query(f"""SELECT c_custkey::VARCHAR AS record_id, 'Š' || c_name AS creator_lat, CASE WHEN c_custkey % 3 = 0 THEN 'عبد الله' ELSE '' END AS creator_ara,
  'T' || c_custkey AS contributor_lat, 'Ms ' || c_custkey AS shelfmark, 'see http://archivesetmanuscrits.example/' || c_custkey AS catalogue_url, 'http://example.org/' || c_custkey AS gallica_url,
  CASE WHEN c_custkey % 4 <> 0 THEN (1500 + c_custkey % 400)::INT END AS date_from, CASE c_custkey % 4 WHEN 0 THEN NULL WHEN 1 THEN (1500 + c_custkey % 400)::INT ELSE 1999 END AS date_to,
  FALSE AS is_composite, (4 + (c_custkey % 4 <> 0)::INT + (c_custkey % 2 = 0)::INT)::INT AS signal_count FROM customer WHERE {GOOD}""")
def manuscript_fields(s, d):
    rows = records.manuscripts(records.dublin_core(_xml(s, d)))
    return rows.select("record_id", joined("creator_lat").alias("creator_lat"), joined("creator_ara").alias("creator_ara"), joined("contributor_lat").alias("contributor_lat"), "shelfmark", "catalogue_url", "gallica_url", "date_from", "date_to", "is_composite", "signal_count")


@query("SELECT n_nationkey::VARCHAR AS stem, n_name AS title FROM nation")
def xml_scan(s, d):
    at = folder(s, "xml")
    head, tail = XML.split("{}")
    n = table(s, d, "nation").select(F.col("n_nationkey").alias("stem"), F.concat(F.lit(head), _element("title", "n_name"), F.lit(tail)).alias("value"))
    n.write.partitionBy("stem").text(at)
    files = records.xml_files(s, at, "*.txt").withColumn("stem", F.regexp_extract("path", "stem=([0-9]+)", 1))
    return records.dublin_core(files).select("stem", joined("title").alias("title"))


@query(f"""SELECT c_custkey::VARCHAR AS rec, script, raw FROM (
  SELECT c_custkey, 'lat' AS script, unnest(['Š' || c_name, 'T' || c_custkey, c_name, 'part ' || c_mktsegment]) AS raw FROM customer WHERE {GOOD}
  UNION ALL SELECT c_custkey, 'ara', 'عبد الله' FROM customer WHERE {GOOD} AND c_custkey % 3 = 0)""")
def record_candidates(s, d):
    rows = records.manuscripts(records.dublin_core(_xml(s, d)), segments=F.lit(None).cast("array<struct<segment:string,label:string>>"))
    return cd.record_candidates(rows).select(F.col("record_id").alias("rec"), "script", "raw")


# Key/value metadata


def _entries(s: SparkSession, d: str, kind: str) -> DataFrame:
    """A file of each supplier: of its author, book or version."""
    t = table(s, d, "supplier")
    key = F.col("s_suppkey")
    author = F.concat(F.lpad((key % 1500).cast("string"), 4, "0"), F.lit("Abu"), key.cast("string"))
    stem = {"author": author, "book": F.concat(author, F.lit(".Kitab")), "version": F.concat(author, F.lit(".Kitab.V1-ara1"))}[kind]
    lines = {
        "author": [F.concat(F.lit("00#AUTH#URI######: "), stem), F.concat(F.lit("10#AUTH#ISM####AR: "), F.when(key % 2 == 0, F.lit("Fulān")).otherwise(F.col("s_name"))), F.concat(F.lit("10#AUTH#NISBA##AR: al-"), _phone("s_suppkey"), F.lit("\n    goes on")), F.concat(F.lit("70#AUTH#EXTID####: wikidata@Q"), key.cast("string"), F.lit(", src@keyword"))],
        "book": [F.concat(F.lit("00#BOOK#URI######: "), stem), F.concat(F.lit("10#BOOK#TITLEA#AR: "), "s_name", F.lit(". Second part.")), F.concat(F.lit("30#BOOK#EXTID####: viaf@"), key.cast("string")), F.lit("10#BOOK#TITLEA#AR: later")],
        "version": [F.concat(F.lit("00#VERS#URI######: "), stem), F.concat(F.lit("80#VERS#LINKS####: https://example.org/"), key.cast("string"), F.lit(" and http://b.org/x y")), F.lit("80#VERS#BASED####: https://c.org"), F.lit("90#VERS#COMMENT##: https://example.org/no")],
    }[kind]
    return records.entries_of(t.select(F.lit("x").alias("path"), stem.alias("stem"), F.concat_ws("\n", *lines).alias("value")))


URI = "lpad((s_suppkey % 1500)::VARCHAR, 4, '0') || 'Abu' || s_suppkey"


@query(f"""SELECT {URI} AS uri, (s_suppkey % 1500)::INT AS death_year_ah, 'Abu' || s_suppkey AS name_slug, CASE WHEN s_suppkey % 2 = 1 THEN s_name END AS name_ism_lat,
  'al-' || 'T' || s_suppkey || ' goes on' AS name_nisba_lat, NULL::VARCHAR AS wikidata_id FROM supplier""")
def yml_authors(s, d):
    return records.authors(_entries(s, d, "author")).select("uri", "death_year_ah", "name_slug", "name_ism_lat", "name_nisba_lat", "wikidata_id")


@query(f"SELECT {URI} || '.Kitab' AS uri, {URI} AS author_uri, 'Kitab' AS title_slug, s_name || '|Second part' AS title_lat, s_suppkey::VARCHAR AS viaf_id FROM supplier")
def yml_books(s, d):
    return records.books(_entries(s, d, "book")).select("uri", "author_uri", "title_slug", joined("title_lat").alias("title_lat"), "viaf_id")


@query(f"SELECT {URI} || '.Kitab.V1-ara1' AS uri, {URI} || '.Kitab' AS book_uri, 'https://example.org/' || s_suppkey || '|http://b.org/x|https://c.org' AS links FROM supplier")
def yml_versions(s, d):
    return records.versions(_entries(s, d, "version")).select("uri", "book_uri", joined("links").alias("links"))


@query(f"""SELECT uri, script, variant FROM (SELECT {URI} AS uri, 'lat' AS script, unnest(CASE WHEN s_suppkey % 2 = 1 THEN ['Abu' || s_suppkey, s_name, 'al-' || 'T' || s_suppkey || ' goes on'] ELSE ['Abu' || s_suppkey, 'al-' || 'T' || s_suppkey || ' goes on'] END) AS variant FROM supplier)
UNION ALL SELECT uri, 'lat', unnest([s_name, 'Second part']) FROM (SELECT {URI} || '.Kitab' AS uri, s_name FROM supplier)""")
def variants(s, d):
    authors = cd.author_variants(records.authors(_entries(s, d, "author")))
    return authors.unionByName(cd.book_variants(records.books(_entries(s, d, "book")))).select("uri", "script", "variant")


# Listings, stores and tables


@query("SELECT 'A' || (s_suppkey % 40) || '.B' AS uri, 'A' || (s_suppkey % 40) AS author_uri, arg_min(s_name, s_suppkey) || '|second' AS title_lat FROM supplier GROUP BY ALL")
def listing(s, d):
    at = folder(s, "listing")
    book = F.concat(F.lit("A"), (F.col("s_suppkey") % 40).cast("string"), F.lit(".B"))
    empty = F.lit("")
    rows = table(s, d, "supplier").repartitionByRange(4, "s_suppkey").sortWithinPartitions("s_suppkey").select(F.concat(book, F.lit(".v"), F.col("s_suppkey").cast("string")).alias("version_uri"), F.lit("ara").alias("language"), empty.alias("author_ar"), F.lit("x").alias("author_lat"), empty.alias("author_lat_shuhra"), empty.alias("book"), empty.alias("title_ar"), F.concat("s_name", F.lit(" :: second")).alias("title_lat"), empty.alias("tags"))
    rows.write.option("header", "true").option("emptyValue", "").csv(at, sep="\t")  # files that several tasks write, in order
    return records.listed_books(records.listing(s, at)).select("uri", "author_uri", joined("title_lat").alias("title_lat"))


@query("SELECT n_nationkey::VARCHAR AS id, n_name AS name FROM nation")
def json_store(s, d):
    at = folder(s, "store")
    rows = table(s, d, "nation").select(F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("name"))
    whole = rows.agg(F.map_from_entries(F.collect_list(F.struct("id", F.struct("id", "name")))).alias("records"))  # a store of 25 records is one JSON text
    whole.select(F.to_json(F.struct(F.lit(1).alias("_meta"), "records"))).coalesce(1).write.text(at)
    kind = records.T.StructType([records.T.StructField("id", records.T.StringType()), records.T.StructField("name", records.T.StringType())])
    return records.json_store(s, at, "records", kind)


@query("SELECT client_id::VARCHAR AS id, name, city FROM clients")
def id_map_store(s, d):
    """Stores of ids and records in eight parts, written by several tasks and read by byte ranges."""
    at, line = folder(s, "id-map"), lambda k, o, v: (k.alias("k"), F.lit(o).alias("o"), v.alias("value"))
    key = F.col("client_id").cast("string")
    rows = table(s, d, "clients").select(*line(F.pmod(F.xxhash64(key), F.lit(8)), 1, F.concat(F.to_json(key_map := F.create_map(key, F.struct("name", "city"))).substr(F.lit(2), F.length(F.to_json(key_map)) - 2), F.lit(","))))
    parts = s.range(8)
    every = rows.union(parts.select(*line(F.col("id"), 0, F.lit('{"_meta": {"version": 1}, "records": {')))).union(parts.select(*line(F.col("id"), 2, F.lit('"": {}}}'))))
    every.repartition(8, "k").sortWithinPartitions("k", "o").select("value").write.text(at)
    kind = records.T.StructType([records.T.StructField("name", records.T.StringType()), records.T.StructField("city", records.T.StringType())])
    return id_maps.id_map(s, at, "records", kind).where("id != ''")


@query("SELECT c_custkey AS key, c_name AS name FROM customer")
def csv_table(s, d):
    """Files of several tasks, each with a byte order mark before its header."""
    at = folder(s, "csv")
    table(s, d, "customer").select(F.col("c_custkey").alias("\ufeffkey"), F.col("c_name").alias("name")).repartition(4).write.option("header", "true").csv(at)
    kinds = records.T.StructType([records.T.StructField("key", records.T.LongType()), records.T.StructField("name", records.T.StringType())])
    return records.csv_table(s, at, kinds)


@query(f"SELECT 1 AS schema_version, sum(({GOOD})::INT)::BIGINT AS records, sum((NOT ({GOOD}))::INT)::BIGINT AS parse_errors FROM customer")
def store_about(s, d):
    at, parsed = folder(s, "records"), records.dublin_core(_xml(s, d))
    sinks.write_store(records.manuscripts(parsed), at, records.parse_errors(parsed), data="customer")
    return s.read.schema("schema_version int, records long, parse_errors long").json(f"{at}/meta")


@query("SELECT c_custkey AS rec, c_mktsegment AS tier, CASE WHEN c_custkey % 2 = 0 THEN 'b' || c_nationkey || ' a' ELSE '' END AS books FROM customer")
def tier_files(s, d):
    at, c = folder(s, "tiers"), table(s, d, "customer")
    tiers = c.select(F.col("c_custkey").alias("rec"), F.col("c_mktsegment").alias("tier"))
    two = F.explode(F.array(F.struct(F.lit(2).alias("rank"), F.lit("a").alias("book")), F.struct(F.lit(1).alias("rank"), F.concat(F.lit("b"), F.col("c_nationkey").cast("string")).alias("book"))))
    matches = c.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("rec"), two.alias("m")).select("rec", "m.*", F.lit(0.5).alias("score"))
    sinks.write_tiers(tiers, matches, at)
    back = s.read.schema("rec long, tier string, matches array<struct<book:string,score:double>>").json(f"{at}/matches")
    return back.select("rec", "tier", F.coalesce(F.array_join("matches.book", " "), F.lit("")).alias("books"))


@query("SELECT c_custkey::VARCHAR AS rec, c_mktsegment || '|' || 'T' || c_custkey AS names FROM customer")
def pair_csv(s, d):
    at = folder(s, "pairs")
    sinks.write_csv(table(s, d, "customer").select(F.col("c_custkey").alias("rec"), F.array("c_mktsegment", _phone("c_custkey")).alias("names")), at)
    return s.read.option("header", "true").csv(at)


@query("""SELECT p_name AS ngram, 'title' AS field, CASE WHEN p_partkey % 6 = 0 THEN 'owner' END AS signal_type FROM part WHERE p_partkey % 2 = 0""")
def apply_review(s, d):
    p = table(s, d, "part")
    keep = F.when(F.col("p_partkey") % 2 == 0, F.element_at(F.array(*map(F.lit, ("Yes", "y", "TRUE", "1"))), (F.col("p_partkey") % 4 + 1).cast("int"))).otherwise(F.lit("no"))
    review = p.select(F.col("p_name").alias("ngram"), F.lit("title").alias("source_field"), keep.alias("keep"), F.when(F.col("p_partkey") % 6 == 0, F.lit("owner")).otherwise(F.lit(" ")).alias("signal_type"))
    plain, signals = sinks.apply_review(review)
    return plain.withColumn("signal_type", F.lit(None).cast("string")).unionByName(signals)


@query("""WITH r AS (SELECT client_id::VARCHAR AS catalogue, CASE op WHEN 'I' THEN 'build' WHEN 'D' THEN 'sample' ELSE 'apply_review' END AS stage, max(coalesce(strftime(valid_at, '%Y-%m-%d %H:%M:%S'), '') || ' ' || lpad(change_id::VARCHAR, 12, '0')) AS run_at FROM client_changes WHERE op IS NOT NULL AND change_id IS NOT NULL GROUP BY ALL)
SELECT catalogue, stage, run_at, 'run ' || run_at AS data FROM r WHERE NOT (stage = 'apply_review' AND coalesce(run_at < (SELECT b.run_at FROM r b WHERE b.stage = 'build' AND b.catalogue IS NOT DISTINCT FROM r.catalogue), false))""")
def run_log(s, d):
    """Every client has a trail, its changes are the runs."""
    at, c = folder(s, "runs"), table(s, d, "client_changes").where("op IS NOT NULL AND change_id IS NOT NULL")
    when = F.concat(F.coalesce(F.date_format("valid_at", "yyyy-MM-dd HH:mm:ss"), F.lit("")), F.lit(" "), F.lpad(F.col("change_id").cast("string"), 12, "0"))
    stage = F.when(F.col("op") == "I", "build").when(F.col("op") == "D", "sample").otherwise("apply_review")
    sinks.log_runs(c.select(F.col("client_id").cast("string").alias("catalogue"), stage.alias("stage"), when.alias("at"), F.create_map(F.lit("data"), F.concat(F.lit("run "), when)).alias("settings")), at)
    return sinks.last_runs(s, at, "catalogue").select("catalogue", "stage", F.col("at").alias("run_at"), F.col("settings")["data"].alias("data"))


@query("""WITH t AS (SELECT coalesce(segment, '') AS name, count(*) AS n FROM clients GROUP BY ALL UNION ALL SELECT 'unmatched', 0)
SELECT name, n AS records, (SELECT count(*) FROM clients) AS total, 'clients' AS run, 0.9::VARCHAR AS threshold FROM t""")
def run_manifest(s, d):
    """The tiers of a run with their matches, then its manifest, from which the counts are read back."""
    at, c = folder(s, "run"), table(s, d, "clients")
    sinks.begin_run(s, at)
    tiers = c.select(F.monotonically_increasing_id().alias("rec"), F.coalesce("segment", F.lit("")).alias("tier"))
    sinks.write_tiers(tiers, s.createDataFrame([], "rec long, rank int, book string, score double"), at)
    told = s.read.schema("tier string, records long").json(f"{at}/summary").select(F.coalesce("tier", F.lit("")).alias("name"), "records")
    sinks.finish_run(at, "clients", told, ("unmatched",), {"matches": f"{at}/matches"}, {"threshold": "0.9"})
    return sinks.manifest(s, at).select(F.explode("results").alias("name", "records"), F.col("records").alias("total"), "run", F.col("settings")["threshold"].alias("threshold"))


@query("""WITH c AS (SELECT unnest(regexp_extract_all(name, '[^\x00-\x7F]')) AS character FROM clients)
SELECT character, printf('U+%04X', unicode(character)) AS unicode_code, 'Frequency: ' || count(*) AS notes FROM c GROUP BY character""")
def conversion_csv(s, d):
    """The table of all special characters of names, to be filled in by hand, read back from its file."""
    at = folder(s, "conversions")
    sinks.write_csv(survey.conversion_table(survey.characters(table(s, d, "clients"), "name")), at)
    return records.csv_table(s, at, records.CONVERSIONS).select("character", "unicode_code", "notes")


@query("SELECT * FROM clients WHERE client_id IN (SELECT client_id FROM sales)")
def semi_join(s, d):
    return merge.known(table(s, d, "clients"), table(s, d, "sales"), "client_id")


@query("""SELECT 'description' AS field, ngram, signal_type FROM (SELECT DISTINCT text AS ngram, CASE WHEN item_id % 3 = 0 THEN 'date:copy' END AS signal_type FROM (SELECT text, dense_rank() OVER (ORDER BY text) AS item_id FROM (SELECT DISTINCT name AS text FROM items WHERE name <> '')))""")
def curated_phrases(s, d):
    """Reviewed phrases in the formats of three times, a file for each part of the items: objects and signals, texts within an object, a list."""
    at = folder(s, "curated")
    ranked = table(s, d, "items").where("name != ''").select(F.col("name").alias("ngram")).distinct()
    n = ranks.running(ranked.withColumn("one", F.lit(1)), "ngram", "one").select("ngram", (F.col("before") + 1).alias("k"))
    plain = n.where("k % 3 != 0")
    listed = plain.where("k % 3 = 1").groupBy(F.floor(F.col("k") / 300)).agg(F.to_json(F.collect_list("ngram")).alias("value")).select("value")
    texts = plain.where("k % 3 = 2").select(F.to_json(F.struct(F.array("ngram").alias("boilerplate"))).alias("value"))
    signals = n.where("k % 3 = 0").select(F.to_json(F.struct(F.array(F.struct("ngram", F.lit("description").alias("field"), F.lit("date:copy").alias("signal_type"))).alias("signals"))).alias("value"))
    return records.phrases_of(listed.union(texts).union(signals))


# Text functions over whole texts

#: Latin letters to Arabic ones, so that the documents give Arabic texts.
LETTERS, ARABIC = "abcdefghij", "ابتثجحخدذر"


@query(f"""SELECT doc_id, md5(array_to_string(list_filter(regexp_extract_all(translate(text, '{LETTERS}', '{ARABIC}'), '[{tx.ARABIC}]+|\\p{{Nd}}+'), lambda t: NOT regexp_matches(t, '^\\p{{Nd}}') OR length(t) >= 2), ' ')) AS tokens FROM documents""")
def tok_ara(s, d):
    return table(s, d, "documents").select("doc_id", F.md5(F.array_join(tx.tokens_ara(F.translate("text", LETTERS, ARABIC)), " ")).alias("tokens"))


@query("SELECT p_partkey, translate(translate(p_name, 'aeio', 'ʻ‘ʼ`'), 'ʻ‘ʼ`', 'ʿʿʿʿ') AS one FROM part")
def one_ayn(s, d):
    return table(s, d, "part").select("p_partkey", tx.one_ayn(F.translate("p_name", "aeio", "ʻ‘ʼ`")).alias("one"))


@query("""SELECT p_partkey, trim(regexp_replace(lower(replace(replace(replace(replace(replace(p_name, 'h', 'kh'), 's', 'sh'), 'g', 'gh'), 'd', 'dh'), 'q', 'q')), '\\s+', ' ', 'g')) AS made FROM part""")
def convert_marks(s, d):
    """Letters with marks that the conversion table maps, to one letter or two."""
    return table(s, d, "part").select("p_partkey", tx.convert(F.translate("p_name", "hsgdqtaiu", "ḫšǧḏḳṭāīū")).alias("made"))


@query("""SELECT c_custkey, c_name || CASE WHEN c_custkey % 2 = 0 THEN ' X' ELSE '' END AS clean, CASE WHEN c_custkey % 5 <> 0 THEN (1000 + c_custkey % 900)::INT END AS first,
  CASE c_custkey % 5 WHEN 0 THEN NULL WHEN 1 THEN (1000 + c_custkey % 900)::INT ELSE 1950 END AS last, 'Ms ' || c_custkey AS mark FROM customer""")
def catalogue_values(s, d):
    c, key = table(s, d, "customer"), F.col("c_custkey")
    name = F.concat("c_name", F.when(key % 2 == 0, F.lit(" (9999?–0001) X,. Relieur")).otherwise(F.lit(" (1200). copiste")))
    year = (1000 + key % 900).cast("string")
    first, last = tx.date_range(F.when(key % 5 == 0, F.lit("s.d.")).when(key % 5 == 1, F.concat(year, F.lit("?"))).otherwise(F.concat(year, F.lit("-1950 ca"))))
    return c.select("c_custkey", tx.clean_creator(name).alias("clean"), first.alias("first"), last.alias("last"), tx.shelfmark(F.concat(F.lit("Lib. Dept.  Ms "), key.cast("string"), F.lit(" "))).alias("mark"))


@query("""SELECT c_custkey, c_name || '|' || 'T' || c_custkey AS parts, 'T' || c_custkey || '|' || c_name AS aliases, CASE WHEN c_custkey % 3 <> 0 THEN c_custkey::INT END AS year, c_name || '|two' AS titles,
  CASE WHEN c_custkey % 2 = 0 THEN c_name END AS filled FROM customer""")
def metadata_values(s, d):
    c, key = table(s, d, "customer"), F.col("c_custkey").cast("string")
    return c.select(
        "c_custkey",
        joined(tx.metadata_parts(F.concat(F.lit(" "), "c_name", F.lit(" :: ¶ "), _phone("c_custkey")))).alias("parts"),
        joined(tx.alias_parts(F.concat(_phone("c_custkey"), F.lit("|| "), "c_name", F.lit(" ||||"), _phone("c_custkey")))).alias("aliases"),
        tx.iso_year(F.when(F.col("c_custkey") % 3 == 0, F.lit("-12")).otherwise(F.concat(F.lit("+"), key, F.lit("-01-01T00:00:00Z")))).alias("year"),
        joined(tx.title_parts(F.concat("c_name", F.lit(". two.. ")))).alias("titles"),
        tx.filled_in(F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("  "), "c_name")).otherwise(F.concat("c_name", F.lit(" permalink x")))).alias("filled"),
    )


@query("SELECT p_partkey, replace(lower(p_name), 'c', 'ayn') AS fuzzy, lower(p_name) AS plain, p_name AS raw FROM part")
def legacy_forms(s, d):
    name = F.col("p_name")
    return table(s, d, "part").select("p_partkey", tx.legacy_normalize(name, "lat").alias("fuzzy"), tx.legacy_normalize(name, "lat", "embedding").alias("plain"), tx.legacy_normalize(name, "lat", "raw").alias("raw"))


@query("""SELECT item_id, len(l) AS n_candidates, array_to_string(l, '|') AS candidates FROM (SELECT item_id, list_filter(string_split(text, '. '), lambda x: length(x) <= 60 AND trim(x) <> '' AND x <> string_split(text, '. ')[1]) AS l FROM (SELECT item_id, text FROM benchmark))""")
def whole_descriptions(s, d):
    """Without phrases, descriptions that are short enough and not among the titles are candidates."""
    parts = F.split("text", r"\. ")
    made = segment.segment(parts, F.slice(parts, 1, 1), most_chars=60)
    return table(s, d, "benchmark").select("item_id", F.size(made).cast("long").alias("n_candidates"), joined(F.transform(made, lambda x: x["segment"])).alias("candidates"))
