from linkspark.sources import records, sinks
from linkspark.streaming import incremental

XML = """<?xml version="1.0" encoding="UTF-8"?><record><metadata><oai_dc:dc xmlns:oai_dc="http://www.openarchives.org/OAI/2.0/oai_dc/" xmlns:dc="http://purl.org/dc/elements/1.1/">
<dc:identifier>http://example.org/1</dc:identifier><dc:title>Anwār al-tanzīl</dc:title><dc:creator>ʿAbd Allāh. Auteur du texte</dc:creator><dc:creator>عبد الله. Auteur du texte</dc:creator>
<dc:description>Copie anonyme</dc:description><dc:source>Bibliothèque. Arabe 631</dc:source><dc:date>1501-1600</dc:date></oai_dc:dc></metadata></record>"""
BOOK = """00#BOOK#URI######: 0685NasirDinBaydawi.AnwarTanzil
10#BOOK#TITLEA#AR: Kitāb al-Muʾallif
30#BOOK#EXTID####: wikidata@Q12, viaf@34
90#BOOK#COMMENT##: first line
    goes on
"""
VERSION = "00#VERS#URI######: 0685NasirDinBaydawi.AnwarTanzil.X1-ara1\n80#VERS#LINKS####: https://example.org/a, permalink\n90#VERS#COMMENT##: https://example.org/no\n"


def test_xml(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "OAI_1.xml").write_text(XML, encoding="utf-8")
    (tmp_path / "OAI_2.xml").write_text("<record/>", encoding="utf-8")
    (tmp_path / "OAI_3.xml").write_text(XML[:-30], encoding="utf-8")
    parsed = records.dublin_core(records.xml_files(spark, str(tmp_path)))
    errors = {r["path"].rpartition("/")[2]: r["error"] for r in records.parse_errors(parsed).collect()}
    assert errors["OAI_2.xml"] == "no Dublin Core element" and errors["OAI_3.xml"].startswith("not well-formed") and len(errors) == 2
    row = records.manuscripts(parsed).first()
    assert row["record_id"] == "OAI_1" and row["creator_lat"] == ["ʿAbd Allāh"] and row["creator_ara"] == ["عبد الله"]
    assert (row["date_from"], row["date_to"], row["shelfmark"], row["is_composite"]) == (1501, 1600, "Arabe 631", False)


def test_key_values(spark, tmp_path):
    (tmp_path / "0685NasirDinBaydawi.AnwarTanzil.yml").write_text(BOOK, encoding="utf-8")
    (tmp_path / "0685NasirDinBaydawi.AnwarTanzil.X1-ara1.yml").write_text(VERSION, encoding="utf-8")
    entries = records.key_values(spark, str(tmp_path))
    book = records.books(entries).first()
    assert (book["uri"], book["title_lat"], book["wikidata_id"], book["viaf_id"], book["death_year_ah"]) == ("0685NasirDinBaydawi.AnwarTanzil", None, "Q12", "34", 685)
    version = records.versions(entries).first()
    assert version["book_uri"] == "0685NasirDinBaydawi.AnwarTanzil" and version["links"] == ["https://example.org/a,"]


def test_listing_and_store(spark, tmp_path):
    header = "version_uri\tlanguage\tauthor_ar\tauthor_lat\tauthor_lat_shuhra\tbook\ttitle_ar\ttitle_lat\ttags\n"
    (tmp_path / "l.tsv").write_text(header + "0001A.B.v1\tara\t\tA\tAbu A\t0001A.B\t\tOne :: Two\t\n0001A.B.v2\tara\t\tA\tother\t0001A.B\t\tThree\t\n", encoding="utf-8")
    rows = records.listing(spark, str(tmp_path / "l.tsv"))
    assert records.listed_books(rows).first()["title_lat"] == ["One", "Two"]
    assert records.listed_authors(rows).first()["name_shuhra_lat"] == "Abu A"
    sinks.write_store(rows, str(tmp_path / "store"), about="x")
    assert spark.read.json(str(tmp_path / "store/meta")).first()["records"] == 2


def test_follow_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "OAI_1.xml").write_text(XML, encoding="utf-8")

    def go():
        q = incremental.follow_files(spark, str(tmp_path / "in"), str(tmp_path / "store"), str(tmp_path / "seen"), lambda f: records.manuscripts(records.dublin_core(f)).select("record_id", "date_from"), "record_id")
        q.awaitTermination()

    go()
    (tmp_path / "in" / "OAI_2.xml").write_text(XML, encoding="utf-8")
    go()
    assert sorted(r["record_id"] for r in spark.read.parquet(str(tmp_path / "store")).collect()) == ["OAI_1", "OAI_2"]
