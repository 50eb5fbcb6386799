"""What follows a linkage is dealt by record into tasks of bounded rows, and gives what plain counting gives."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from linkspark.operators import evaluate as ev
from linkspark.operators import exports, stats
from linkspark.operators import linkage as lk

FOUND = "rec int, book string, author string, author_score double, title_score double, score double, rank int"


@pytest.fixture
def tasks_of_ten(monkeypatch):
    monkeypatch.setattr(lk, "ROWS", 10)


@pytest.fixture(scope="module")
def sides(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("dealt")
    found = [(r, f"b{k}", "a", 0.8 + k / 10, 0.9, 1.0 - k / 10, k + 1) for r in range(200) for k in range(r % 3)] + [(None, "b0", "a", 1.0, 1.0, 1.0, 1), (5, None, "a", 1.0, 1.0, 0.5, 9)]
    truth = [(r, f"b{r % 2}" if r % 7 else None) for r in range(200)] + [(1, "b0"), (1, "b0"), (None, "b0"), (None, None), (900, "b1")]
    spark.createDataFrame(found, FOUND).write.parquet(str(at / "found"))
    spark.createDataFrame(truth, "rec int, book string").write.parquet(str(at / "truth"))
    return found, truth, spark.read.parquet(str(at / "found")), spark.read.parquet(str(at / "truth"))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def dealt_only(df, tasks):
    """Rows of records meet in so many tasks, and nowhere else."""
    by_rec = [line for line in plan(df).splitlines() if re.search(r"Exchange hashpartitioning\(.*\brec#", line)]
    return by_rec and all(f", {tasks}), REPARTITION_BY_NUM" in line for line in by_rec)


def test_metrics_by_record(sides, tasks_of_ten):
    """F24, F25, F26."""
    found, truth, f, t = sides
    for metrics in (ev.pair_metrics, ev.candidate_metrics, ev.found_any_metrics):
        assert dealt_only(metrics(f, t), 21) and "Join" not in plan(metrics(f, t))
    wanted = {r: {b for q, b in truth if q == r and b is not None} for r, _ in truth}
    got = {r: [b for q, b, *_ in found if q == r and q is not None] for r in wanted}
    hits = {r: sum(b in wanted[r] for b in got[r]) for r in wanted}
    m = ev.pair_metrics(f, t).first()
    assert (m["tp"], m["fp"]) == (sum(hits.values()), sum(len(got[r]) - hits[r] for r in wanted))
    assert (m["fn"], m["tn"]) == (sum(len(wanted[r]) - hits[r] for r in wanted), sum(not wanted[r] and not got[r] for r in wanted))
    judged = [r for r in wanted if wanted[r]]
    m = ev.found_any_metrics(f, t).first()
    assert (m["correct"], m["matched"], m["records"]) == (sum(hits[r] > 0 for r in judged), sum(len(got[r]) for r in judged), len(judged))


def test_metrics_by_setting(spark, sides):
    """A setting that returns nothing for a record has the record all the same."""
    f, t = sides[2:]
    both = f.withColumn("s", F.lit("x")).union(f.where("rank = 1").withColumn("s", F.lit("y")))
    rows = {r["s"]: r for r in ev.pair_metrics(both, t, ["s"]).collect()}
    for s, alone in (("x", f), ("y", f.where("rank = 1"))):
        assert tuple(rows[s])[1:] == tuple(ev.pair_metrics(alone, t).first())


def test_sweep_by_record(spark, sides, tasks_of_ten):
    """F21, F22."""
    found, truth, f, t = sides
    grid = spark.createDataFrame([(a, 0.9) for a in (0.8, 0.9)], "author_threshold double, title_threshold double")
    made = ev.sweep(f, t, grid)
    assert dealt_only(made, 21)
    judged = {r for r, b in truth if b is not None}
    for row in made.collect():
        kept = [(r, b) for r, b, _, a, _, _, _ in found if r in judged and r is not None and a >= row["author_threshold"]]
        right = [x for x in kept if x in set(truth) and x[1] is not None]
        assert (row["matched"], row["extra"], row["correct"], row["records"]) == (len(kept), len(kept) - len(right), len({r for r, _ in right}), len(judged))


def test_validation_by_record(sides, tasks_of_ten):
    """F19."""
    found, truth, f, t = sides
    made = exports.validation(lk.Linkage(None, None, None, None, combined=f), t)
    assert dealt_only(made, 21)
    counts = Counter(r for r, *_ in found)
    rows = made.collect()
    assert len(rows) == sum(r is not None for r, *_ in found) and all(r["num_matches_for_record"] == counts[r["record_id"]] for r in rows)


def test_first_matches_by_record(sides, tasks_of_ten):
    """F20."""
    f = sides[2].where("rec IS NOT NULL")
    made = stats.first_matches(f, 1, f.count())
    assert dealt_only(made, -(-f.count() // 10))
    assert sorted(map(tuple, made.collect())) == sorted(map(tuple, stats.first_matches(f, 1).collect()))


def test_carried_records_are_dealt(spark, monkeypatch, tmp_path):
    """rows that carry a candidate's records are as long at any size, and their tasks as large."""
    monkeypatch.setattr(lk, "PARTS", 1)
    monkeypatch.setattr(lk, "SHARE", 10)
    monkeypatch.setattr(lk, "ROWS", 50)
    seen = []
    sharing = lk.pairing.sharing

    def watched(left, *more):
        seen.append((left.select(F.max(F.size("x.own"))).first()[0], plan(left)))
        return sharing(left, *more)

    monkeypatch.setattr(lk.pairing, "sharing", watched)
    spark.range(400).selectExpr("cast(id AS int) AS rec", "0 AS ord", "'anna berg' AS raw").write.parquet(str(tmp_path / "raw"))
    raw = spark.read.parquet(str(tmp_path / "raw"))
    variants = spark.createDataFrame([("u1", "lat", 0, "Anna Berg")], "uri string, script string, ord int, variant string")
    assert lk.title_stage(raw, variants).count() == 400
    assert seen[0][0] <= 40
    dealt = [line for line in seen[0][1].splitlines() if re.search(r"Exchange hashpartitioning\(.*\bpart#", line)]
    assert dealt and all(", 8), REPARTITION_BY_NUM" in line for line in dealt)
