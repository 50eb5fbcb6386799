import unicodedata

from pyspark.sql import functions as F

from linkspark.functions import text as tx


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first()["y"]


def test_camel_and_slugs(spark):
    assert one(spark, "NasirDinBaydawi", tx.split_camel) == ["Nasir", "Din", "Baydawi"]
    assert one(spark, "CamrIbnKulthum", tx.slug_tokens) == ["ʿamr", "ibn", "kulthum"]
    assert one(spark, "MacrifaWaAdab", tx.slug_tokens) == ["maʿrifa", "wa", "adab"]


def test_normalisation(spark):
    assert one(spark, "Kitab al-Ṭabarī", tx.normalize_for_matching) == "kitab al tabari"
    assert one(spark, "Anwār al-tanzīl", tx.normalize_for_matching) == "anwar al tanzil"
    assert one(spark, "0685IbnCali", lambda x: tx.normalize_for_matching(x, camel=True, is_corpus=True)) == "ibn ʿali"
    assert one(spark, "Šaʾm", tx.normalize_for_matching) == "sam"
    assert one(spark, "šāh", tx.normalize_for_matching) == "shah"


def test_fold_equals_unicode(spark):
    text = "".join(chr(c) for c in [*range(0xC0, 0x250), *range(0x600, 0x6FF), *range(0x1E00, 0x1EFF)])
    expected = unicodedata.normalize("NFC", "".join(c for c in unicodedata.normalize("NFD", text) if unicodedata.category(c) != "Mn"))
    assert one(spark, text, tx.fold_accents) == expected


def test_tokens(spark):
    assert one(spark, "Ms. a Kitāb 12 3 b.", tx.tokens_lat) == ["ms", "kitāb", "12"]
    assert one(spark, "Ms. a fol.x b.", lambda x: tx.tokens_lat(x, True)) == ["ms.", "fol", "b."]
    assert one(spark, "كتاب 1 12", tx.tokens_ara) == ["كتاب", "12"]
    spans = one(spark, "The kitāb, 1501", lambda x: tx.token_spans(x))
    assert [(s["token"], s["start"], s["end"]) for s in spans] == [("the", 0, 3), ("kitāb", 4, 9), ("1501", 11, 15)]
    assert one(spark, "a b c", lambda x: tx.ngrams(F.split(x, " "), 2)) == ["a b", "b c"]
    assert one(spark, "a", lambda x: tx.ngrams(F.split(x, " "), 2)) == []


def test_catalogue_values(spark):
    assert one(spark, "ʿAbd Allāh (1833?-1898). Copiste", tx.clean_creator) == "ʿAbd Allāh"
    assert one(spark, "Bibliothèque. Département. Arabe 631", tx.shelfmark) == "Arabe 631"
    assert one(spark, "1501-1600", lambda x: F.array(*tx.date_range(x))) == [1501, 1600]
    assert one(spark, "0685NasirDinBaydawi.AnwarTanzil", lambda x: F.array(*[c.cast("string") for c in tx.uri_parts(x)])) == ["685", "NasirDinBaydawi", "AnwarTanzil"]
    assert one(spark, "Abū Fulān", tx.filled_in) is None
    assert one(spark, " x ", tx.filled_in) == "x"
    assert one(spark, "+0786-01-01", tx.iso_year) == 786
    assert one(spark, "-0020-01-01", tx.iso_year) is None
    assert one(spark, "a::b ¶ ", tx.metadata_parts) == ["a", "b"]
    assert one(spark, "a|| b||a", tx.alias_parts) == ["a", "b"]
    assert one(spark, "One. Two.", tx.title_parts) == ["One", "Two"]
    assert one(spark, "\u008aa\u009a", tx.repair_c1) == "Šaš"
