from linkspark import cli

XML = """<record><oai_dc:dc xmlns:oai_dc="http://www.openarchives.org/OAI/2.0/oai_dc/" xmlns:dc="http://purl.org/dc/elements/1.1/">
<dc:title>Anwār al-tanzīl</dc:title><dc:creator>Nasir Din Baydawi. Auteur du texte</dc:creator><dc:description>Copie anonyme sans date</dc:description></oai_dc:dc></record>"""


def test_end_to_end(spark, tmp_path):
    data, corpus = tmp_path / "xml", tmp_path / "yml"
    data.mkdir()
    corpus.mkdir()
    (data / "OAI_1.xml").write_text(XML, encoding="utf-8")
    (corpus / "0685NasirDinBaydawi.yml").write_text("00#AUTH#URI######: 0685NasirDinBaydawi\n", encoding="utf-8")
    (corpus / "0685NasirDinBaydawi.AnwarTanzil.yml").write_text("00#BOOK#URI######: 0685NasirDinBaydawi.AnwarTanzil\n10#BOOK#TITLEA#AR: Anwār al-tanzīl\n", encoding="utf-8")
    (corpus / "0999Other.Work.yml").write_text("00#BOOK#URI######: 0999Other.Work\n10#BOOK#TITLEA#AR: Another title\n", encoding="utf-8")
    go = lambda *a: cli.main([str(x) for x in a], spark)
    go("parse-xml", "--data", data, "--out", tmp_path / "r")
    go("parse-corpus", "--data", corpus, "--out", tmp_path / "c")
    go("survey", "--data", data, "--out", tmp_path / "s")
    go("link", "--records", tmp_path / "r", "--corpus", tmp_path / "c", "--out", tmp_path / "m")
    found = spark.read.json(str(tmp_path / "m/matches")).first()
    assert found["tier"] == "high_confidence" and found["matches"][0]["book"] == "0685NasirDinBaydawi.AnwarTanzil"
    assert spark.read.json(str(tmp_path / "s/summary")).count() == 3
    truth = tmp_path / "truth.json"
    truth.write_text('[["OAI_1", "0685NasirDinBaydawi.AnwarTanzil"]]' if spark.read.json(str(tmp_path / "m/matches")).first()["rec"] == "0685NasirDinBaydawi.AnwarTanzil" else '[["0685NasirDinBaydawi.AnwarTanzil", "%s"]]' % found["rec"], encoding="utf-8")
    go("sweep", "--matches", tmp_path / "m", "--corpus", tmp_path / "c", "--truth", truth, "--out", tmp_path / "w", "--authors", "0.8", "0.9", "--titles", "0.85", "9")
    rows = spark.read.option("header", "true").csv(str(tmp_path / "w")).collect()
    assert {(r["author_threshold"], r["title_threshold"], r["correct"], r["recall"]) for r in rows} == {("0.8", "0.85", "1", "1.0"), ("0.9", "0.85", "1", "1.0")}
