"""Rows that meet by record are dealt into more tasks where there are more candidates, and the links stay the same."""

from linkspark.operators import linkage as lk


def test_more_candidates_more_tasks(spark, monkeypatch):
    names = ["red bolt", "hot ring", "blue nut", "green washer"]
    raw = spark.createDataFrame([(i, o, x) for i in range(60) for o, x in enumerate((names[i % 4], names[i % 4].split()[0]))], "rec int, ord int, raw string")
    books = spark.createDataFrame([(x, "lat", 0, x) for x in names], "uri string, script string, ord int, variant string")
    creators = raw.where("ord = 1").select("rec", "raw")
    few = {name: sorted(map(tuple, df.collect())) for name, df in (("titles", lk.title_stage(raw, books)), ("authors", lk.author_stage(raw, books, creators)))}
    monkeypatch.setattr(lk, "ROWS", 2, raising=False)
    titles, authors = lk.title_stage(raw, books), lk.author_stage(raw, books, creators)
    assert titles.rdd.getNumPartitions() == 60 and authors.rdd.getNumPartitions() == 60
    assert {"titles": sorted(map(tuple, titles.collect())), "authors": sorted(map(tuple, authors.collect()))} == few and few["titles"]
