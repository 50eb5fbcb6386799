"""N-grams are counted in tasks of bounded size, by one aggregate; settings by field don't put a field into one task."""

from linkspark.operators import survey


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_tasks_grow_with_the_text(spark, monkeypatch):
    monkeypatch.setattr(survey, "TASK_CHARS", 500)
    rows = [(r, f, o, f"aa bb aa bb ww {'zz ' * (r % 3)}") for r in range(60) for f in "td" for o in range(2)]
    df = spark.createDataFrame(rows, "rec int, field string, ord int, text string")
    first = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    try:
        assert survey._dealt(df).rdd.getNumPartitions() > 4
        counts = survey.ngram_counts(df)
        assert "REPARTITION_BY_NUM" in _plan(counts)
        # By record, field and n-gram nothing is aggregated: that would hold all n-grams of a task at once.
        assert not any("HashAggregate" in x and "rec#" in x and "ngram#" in x for x in _plan(counts).splitlines())
        got = {(r["field"], r["ngram"]): (r["term_freq"], r["doc_freq"]) for r in counts.collect()}
        assert got["t", "aa bb"] == (240, 60) and got["d", "zz aa"] == (40, 40) and got["t", "bb aa bb"] == (120, 60)
    finally:
        spark.conf.unset(first)


def test_settings_are_broadcast(spark):
    """No shuffle by field, whose few values would put all n-grams of a field into one task."""
    df = spark.createDataFrame([(1, "t", 0, "aa bb cc"), (2, "t", 0, "aa bb")], "rec int, field string, ord int, text string")
    settings = spark.createDataFrame([("t", "freq_only", 60.0, 1.0)], "field string, strategy string, min_doc_freq_pct double, max_repeats_per_doc double")
    found = survey.suggest_boilerplate(survey.ngram_counts(df), df, settings)
    assert not any("hashpartitioning(field#" in x and "ngram" not in x and "rec#" not in x for x in _plan(found).splitlines())
    assert [r["ngram"] for r in found.collect()] == ["aa bb"]
