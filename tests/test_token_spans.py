"""The registered token_spans covers all documents, also those without a token."""


def test_token_spans_over_documents(spark, tmp_path):
    from linkspark.plans import catalog

    rows = [(1, "two words"), (2, ""), (3, None), (4, "three plain words")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(9, "other")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {r["doc_id"]: (r["n"], r["last_end"]) for r in catalog.QUERIES["token_spans"](spark, str(tmp_path)).collect()}
    assert set(got) == {1, 2, 3, 4} and got[1] == (2, 9) and got[4] == (3, 17) and got[2] == (0, None), got
