from pathlib import Path

import brute
from pyspark.sql import functions as F

from linkspark.llm import bpe, common

WORDS = "the of and in to it is was for on that with alpha beta gamma delta".split()


def test_pipeline(spark, tmp_path):
    import random

    import corpus_pipeline

    rng = random.Random(1)
    text = lambda n: " ".join(rng.choice(WORDS) + str(rng.choice(["", "x", "y", "z"])) for _ in range(n))
    bench = text(40)
    rows = [(i, text(80)) for i in range(30)] + [(50, "too short"), (51, "%%% ###" * 40), (52, None)] + [(60, bench + " " + text(30))]
    rows += [(i, rows[0][1] + "\nsame closing line here") for i in (70, 71)] + [(80, text(60) + "\nsame closing line here")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, bench)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, str(tmp_path))
        assert kept.columns == docs.columns
    ids = {r["doc_id"] for r in kept.collect()}
    assert ids == {*range(30), 70, 80} and brute.contamination(rows[33][1], [(1, bench)])[1] >= 40
    assert kept.where("doc_id = 80").first()["text"].count("\n") == 0
    assert kept.where(F.col("n_chars") != F.length("text")).count() == 0
    shared = Path(common.shared_dir(spark).removeprefix("file://"))
    before = {p.name for p in shared.iterdir()}
    got = corpus_pipeline.run(spark, str(tmp_path)).orderBy("doc_id").collect()
    # Spark's own checkpoints have names without a prefix.
    assert [n.rsplit("-", 1)[0] for n in {p.name for p in shared.iterdir()} - before if n.startswith(("stage-", "line-", "join-"))] == ["stage-decontamination"]
    assert got == bpe.digest(kept).orderBy("doc_id").collect()


def test_stages_defined_cases(spark, tmp_path):
    """Every stage on an empty table, and on null and repeated ids, null texts, and columns named as the operators' own."""
    import corpus_pipeline

    text = " ".join(f"the w{i} of x{i}" for i in range(30))
    rows = [(None, text), (None, text), (1, text + " and more"), (1, None), (2, ""), (3, " ".join(f"the y{i} of z{i}" for i in range(30)))]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    for c in ("__kept", "__row", "__gone", "__line_gone", "__linked", "__lost", "__map_bits", "__hits", "__counts", "token_ids", "decoded", "cls", "leaf", "dropped"):
        docs = docs.withColumn(c, F.lit(c))
    spark.createDataFrame([("b", "quite another text")], "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        made, empty = stage(spark, docs, str(tmp_path)), stage(spark, docs.where("false"), str(tmp_path))
        assert empty.count() == 0 and (name == "byte-level BPE" or made.columns == empty.columns == docs.columns), name
        got = made.collect()
        if name == "quality rules":
            assert sorted(str(r["doc_id"]) for r in got) == ["1", "3", "None", "None"]
        elif name == "n-gram join":
            assert sorted(str((r["doc_id"], r["text"] in (None, ""))) for r in got) == ["(1, False)", "(1, True)", "(2, True)", "(3, False)"]
        elif name in ("decontamination", "byte-level BPE"):
            assert len(got) == len(rows)
        if "__kept" in made.columns:
            assert all(r["__kept"] == "__kept" and r["leaf"] == "leaf" for r in got)
