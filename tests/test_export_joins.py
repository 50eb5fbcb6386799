"""the export of author scores broadcasts no table that has a row for each record."""

from pyspark.sql import functions as F

from linkspark.operators import exports
from linkspark.operators import linkage as lk


def test_no_records_are_broadcast(spark, tmp_path):
    n = spark.range(500).withColumnRenamed("id", "rec")
    name = F.concat(F.lit("b"), (F.col("rec") % 5).cast("string"))

    def written(df, at):
        df.write.parquet(str(tmp_path / at))
        return spark.read.parquet(str(tmp_path / at))

    authors = written(n.selectExpr("rec", "'a' uri", "1.0d raw", "1.1d idf_score", "1.2d score"), "authors")
    titles = written(n.where("rec % 2 = 0").select("rec", name.alias("uri"), F.lit(0.9).alias("score")), "titles")
    combined = written(n.where("rec % 4 = 0").select("rec", name.alias("book"), F.lit(1.0).alias("score")), "combined")
    truth = written(n.select("rec", F.when(F.col("rec") % 3 > 0, name).alias("book")), "truth")
    creators = written(n.where("rec % 2 = 1").selectExpr("rec", "true has_creator_lat", "false has_creator_ara"), "creators")
    books = written(spark.createDataFrame([(f"b{i}", "a" if i < 2 else "c", f"t{i}", "n") for i in range(5)], "book string, author_uri string, book_title string, author_name string"), "books")
    made = exports.author_scores(lk.Linkage(None, None, None, None, authors=authors, titles=titles, combined=combined), truth, books, creators)
    plan = made._jdf.queryExecution().executedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join" in line]
    assert len(joins) == 7 and all("SortMergeJoin" in line or "rec#" not in line for line in joins)
    got = {(r["record_id"], r["book_uri"]): r for r in made.collect()}
    of = lambda i: {"b0", "b1"} | ({f"b{i % 5}"} if i % 2 == 0 or i % 3 else set())
    assert set(got) == {(i, b) for i in range(500) for b in of(i)} and made.count() == len(got)
    r = got[4, "b4"]
    assert (r["expected_book"], r["in_stage1"], r["in_stage2"], r["in_stage3"], r["is_expected"], r["has_creator_lat"]) == ("b4", False, True, True, True, False)
    assert got[4, "b0"]["score_final"] == 1.2 and got[7, "b0"]["has_creator_lat"] and got[3, "b1"]["expected_book"] is None
