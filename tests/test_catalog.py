"""The entry points: queries give stable results, and agree with their SQL at the smallest size where it is at hand."""

import math
import os

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations clicks sales sale_lines clients client_changes vendors items stamps".split()
ENGINE = sorted(__import__("linkspark.plans.catalog", fromlist=["x"]).QUERIES)

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


def value(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    return round(float(v), 5) if isinstance(v, float) else int(v) if isinstance(v, (bool, int)) else str(v)


def rows(columns, found):
    return sorted((tuple(value(v) for v in r) for r in found), key=lambda r: tuple(str(x) for x in r))


SOURCES = sorted(n for m in ("source_catalog", "match_catalog") for n in __import__(f"linkspark.plans.{m}", fromlist=["x"]).ORACLES)


@pytest.mark.parametrize("name", [*SOURCES, "norm_match", "tok_lat", "ngram_tfidf", "field_coverage", "candidate_fanout", "token_idf", "token_set_ratio", "combined_match", "eval_pairs", "pareto", "first_wins", "outliers", "chrono_bins", "strat_sample", "detect_relations"])
def test_agrees_with_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got = entry.queries()[name](spark, DATA)
    columns = sorted(got.columns)
    expected = con.sql(f"SELECT {', '.join(columns)} FROM ({entry.oracle_sql()[name]})").fetchall()
    assert rows(columns, got.select(*columns).collect()) == rows(columns, expected)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_names():
    assert set(ENGINE) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
