"""Work on long texts that grows with the text, not with its square; rows of many texts go one at a time."""

import time
import tracemalloc

import pyarrow as pa
from pyspark.sql import functions as F

from linkspark.functions import text as tx
from linkspark.operators import segment


def test_token_spans_of_a_long_text(spark):
    """200,000 tokens; a fold that copies what it has so far would copy 2 * 10^10 structs."""
    df = spark.createDataFrame([(1, "Ab c12, " * 100_000), (2, None), (3, "")], "i int, text string")
    spans, start = tx.token_spans(F.col("text")), time.time()
    got = {r["i"]: (r["n"], r["last"]) for r in df.select("i", F.size(spans).alias("n"), F.try_element_at(spans, F.lit(-1)).alias("last")).collect()}
    assert got[1] == (200_000, ("12", 799_996, 799_998)) and got[3] == (0, None) and got[2][1] is None
    assert time.time() - start < 60


def test_token_spans_by_kind(spark):
    text = "İx L. fol.y ٣ ٣٤ كتاب 7 𝔸b"
    row = spark.createDataFrame([(text,)], "x string").select(F.lower("x").alias("low"), tx.token_spans(F.col("x"), "lat", True).alias("a"), tx.token_spans(F.col("x"), "ara").alias("b")).first()
    assert [s["token"] for s in row["a"]] == ["l.", "fol", "٣٤"] and all(row["low"][s["start"] : s["end"]] == s["token"] for s in row["a"])
    assert [s["token"] for s in row["b"]] == ["٣٤", "كتاب"]


def test_rows_one_at_a_time():
    """A batch of 300 rows of long texts takes no more memory than a few of them."""
    texts = pa.array([["some words of a text " * 500]] * 300)
    tracemalloc.start()
    for texts_, low in segment._rows(texts, texts):
        segment.segments(texts_, segment._spans(low), {"words of": "x"}, {"a text"}, set(), 250, 1)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 4_000_000
