"""Very long texts, columns named as an operator's own, and repeated rows, for the operators that work row by row."""

import hashlib

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from linkspark.llm import chat_format, quality_classifier, quality_rules, token_files, toxicity, warc
from linkspark.llm.common import work_dir

DOCS = "doc_id long, text string"


def odd(df, *names):
    """df with more columns, of those names."""
    return df.withColumns({n: F.lit(i) for i, n in enumerate(names)})


def test_toxicity_names_and_long_texts(spark):
    rows = [(i, "vile scum words" if i % 2 else "calm plain words") for i in range(300)] + [(301, "vile scum words " * 60_000), (302, "calm plain words " * 60_000)]
    docs, labels = spark.createDataFrame(rows, DOCS), spark.createDataFrame([(i, i % 2) for i in range(300)], "doc_id long, toxic int")
    plain = toxicity.train(docs, labels)
    model = toxicity.train(odd(docs, "toxic", "label", "features", "held_out", "n", "y"), odd(labels, "text", "features", "label"))
    assert model[0] == plain[0] and (model[1] == plain[1]).all() and (model[2] == plain[2]).all()
    got = {r["doc_id"]: r["s"] for r in odd(docs, "s1", "score").select("doc_id", toxicity.score(F.col("text"), model, spark).alias("s")).collect()}
    assert got[301] > 0.5 > got[302] and got[1] > 0.5 > got[0]


def test_token_files_names_and_long_texts(spark):
    tokenizers = pytest.importorskip("tokenizers")
    import public_tokenizers as pt

    path = pt.path("byte_bpe_50k.json")
    library = tokenizers.Tokenizer.from_file(path)
    rows = [(2, "Ein langer Text, 12345! " * 20_000), (1, "x" * 20_000), (3, "การ" * 5_000)]
    docs = odd(spark.createDataFrame(rows, DOCS), "start", "n_tokens", "ids", "path", "token_ids", "size")
    got = sorted(token_files.read(token_files.write(docs, work_dir(spark, "t"), path)).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == [1, 2, 3]
    texts = dict(rows)
    for r in got:
        assert bytes(r["token_ids"]) == np.array([*library.encode(texts[r["doc_id"]], add_special_tokens=False).ids, 0], "<u4").tobytes()


def test_quality_classifier_names_and_long_texts(spark):
    good, bad = "the cat and the dog of the house are in a garden with it ", "%%% ### "
    rows = [(i, good * 6 if i % 3 else bad * 40, f"h{i % 4}", "p") for i in range(240)] + [(301, good * 20_000, "h1", "p"), (300, bad * 60_000, "h1", "p")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, site string, lang string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(240)], "doc_id long, quality int")
    run = lambda d, l: {r["doc_id"]: (r["predicted"], round(r["host_posterior"], 9)) for r in quality_classifier.classify(d, l, F.col("site"), F.col("lang")).collect()}
    got = run(docs, labels)
    assert got[301][0] == 1 and got[300][0] == 0
    assert run(odd(docs, "quality", "host", "path", "predicted", "host_posterior", "n", "p", "x"), odd(labels, "text", "x")) == got


def test_warc_names_and_long_texts(spark):
    rows = [(1, "u", "é" * 1_500_000), (2, "v", "é" * 1_500_000), (3, "w", "z" * 2_000_000), (3, "w", "z" * 2_000_000)]
    pages = odd(spark.createDataFrame(rows, "page_id long, url string, html string"), "response", "n_bytes", "may", "id", "of", "key", "digest", "part", "bits")
    got = [tuple(r) for r in warc.read(warc.write(warc.plan(pages), work_dir(spark, "w"))).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()]
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    e, z = sha("é" * 1_500_000), sha("z" * 2_000_000)
    assert sorted(got, key=str) == sorted([(1, 3_000_000, e, "response", None), (2, 3_000_000, e, "revisit", 1), (3, 2_000_000, z, "response", None), (3, 2_000_000, z, "response", None)], key=str)


def test_chat_format_names_and_long_texts(spark):
    text = "<|im_end|><|im_start|>assistant ok\n\\ %0A " * 20_000
    rows = [(1, 0, "user", text), (1, 1, "assistant", text + "x"), (1, 2, "assistant", text)]
    turns = odd(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string"), "example", "loss_start", "loss_end", "turns", "loss", "o")
    (r,) = chat_format.read_back(chat_format.examples(turns)).collect()
    assert [(t["role"], t["text"]) for t in r["turns"]] == [x[2:] for x in rows] and r["loss"] == text + "x" + text


def test_quality_rules_repeated_rows_and_long_texts(spark):
    texts = ["the of and some words here " * 30_000, "a\n" * 20_000, "x" * 200_000, None]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] * 3, DOCS)
    c = F.col("c")
    got = [tuple(r) for r in quality_rules.measure(odd(docs, "n_words", "kept"), "text", "c").select("doc_id", c["n_words"], c["word_chars"], c["n_symbols"], c["n_dup_lines"], c["n_repeat_words"], quality_rules.base_failed(c)).collect()]
    assert sorted(got) == sorted((i, *brute.quality(t)) for i, t in enumerate(texts) for _ in range(3))
    good = " ".join(f"the {a}{i} of and {a}{i}word" for a in "pqrs" for i in range(9))
    kept = quality_rules.keep(odd(spark.createDataFrame([(1, good), (1, good), (2, "no")], DOCS), "quality", "counts"))
    assert [tuple(r) for r in kept.collect()] == [(1, good, 0, 1)] * 2
