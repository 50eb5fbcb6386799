"""Operators over a whole table's order, sweeps, terms, listings and fetched bindings."""

import json
import random
import threading
from collections import Counter
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.parse import parse_qs

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkspark.operators import evaluate as ev
from linkspark.operators import ranks, segment, survey
from linkspark.sources import bindings, id_maps, records

RNG = random.Random(6)


@pytest.mark.parametrize("ranges", [1, 3, 50])
def test_running(spark, ranges):
    rows = [(k, RNG.randint(0, 5)) for k in RNG.sample(range(-50, 50), 60)]
    for kind, key in (("int", lambda k: k), ("string", lambda k: f"k{k:+03}é")):
        df = spark.createDataFrame([(key(k), w) for k, w in rows], f"k {kind}, w int").repartition(4)
        got = {r["k"]: (r["before"], r["total"]) for r in ranks.running(df, "k", "w", ranges).collect()}
        assert got == {key(k): (sum(x for q, x in rows if key(q) < key(k)), sum(x for _, x in rows)) for k, _ in rows}


def test_idf_percentiles(spark):
    values = [RNG.choice([0.5, 1.5, 2.5, 3.25, 7.0]) for _ in range(83)]
    df = spark.createDataFrame([(v,) for v in values], "idf double")
    got = {r["percent"]: r["idf"] for r in ev.idf_percentiles(df, ranges=4).collect()}
    assert got == {p: sorted(values)[83 * p // 100] for p in (10, 25, 50, 75, 90, 95, 99)}
    assert {r["threshold"]: r["tokens"] for r in ev.idf_over(df, (1.5, 9.0)).collect()} == {1.5: sum(v >= 1.5 for v in values), 9.0: 0}


@pytest.mark.parametrize("ranges", [1, 2, 9, 200])
def test_ngrams_across_records(spark, ranges):
    """Records of no, one and many tokens; the counts are those of one long sequence, however it is cut."""
    text = lambda: " ".join(RNG.choice(["aa", "bb", "cc"]) for _ in range(RNG.choice([0, 0, 1, 1, 2, 3, 12])))
    rows = [(r, f, o, text()) for r in range(60) for f in ("t", "d") for o in range(RNG.randint(0, 2))] + [(99, "x", 0, "aa")]
    df = spark.createDataFrame(rows, "rec int, field string, ord int, text string").repartition(3)
    got = {(r["field"], r["ngram"]): (r["term_freq"], r["doc_freq"]) for r in survey.ngram_counts_across(df, ranges=ranges).collect()}
    tf, df_ = Counter(), Counter()
    for f in ("t", "d", "x"):
        whole = []
        for rec in sorted({r[0] for r in rows}):
            own = [w for r in sorted(rows) if r[0] == rec and r[1] == f for w in r[3].split()]
            whole += own
            df_.update({(f, " ".join(own[i : i + n])) for n in (2, 3, 4) for i in range(len(own) - n + 1)})
        tf.update((f, " ".join(whole[i : i + n])) for n in (2, 3, 4) for i in range(len(whole) - n + 1))
    assert got == {k: (c, df_[k]) for k, c in tf.items()}


def test_sweep(spark):
    """Several expected books, ties at thresholds, records without any: each setting as if worked out by itself."""
    score = lambda: RNG.choice([0.5, 0.7, 0.75, 0.8, 0.85, 0.9, 1.1])
    scored = [(v, r, b, score(), score()) for v in "xy" for r in range(40) for b in RNG.sample("abcdefgh", RNG.randint(0, 6))]
    truth = [(r, b) for r in range(40) for b in (RNG.sample("abcdefgh", RNG.randint(1, 4)) if r % 4 else [None])] + [(77, "a")]
    grid = [(a, t) for a in (0.7, 0.8, 0.9, 2.0) for t in (0.6, 0.85, 1.0)]
    got = ev.sweep(spark.createDataFrame(scored, "v string, rec int, book string, author_score double, title_score double"), spark.createDataFrame(truth, "rec int, book string"), spark.createDataFrame(grid, "author_threshold double, title_threshold double"), "v").collect()
    wanted = {r: {b for q, b in truth if q == r} for r, _ in truth}
    judged = [r for r, b in wanted.items() if b != {None}]
    expected = {}
    for v in "xy":
        for a, t in grid:
            found = [(r, b) for w, r, b, x, y in scored if w == v and r in judged and x >= a and y >= t]
            if found:
                expected[v, a, t] = (len({r for r, b in found if b in wanted[r]}), len(found), sum(b not in wanted[r] for r, b in found), len(judged))
    assert {(r["v"], r["author_threshold"], r["title_threshold"]): (r["correct"], r["matched"], r["extra"], r["records"]) for r in got} == expected


@pytest.mark.parametrize("chars", [10**6, 40])
def test_relations(spark, chars):
    """Terms within terms, without case and overlaps, in one pass or several; more terms than any driver-side list."""
    rows = [(1, "d", "Copied BY the same; copied by"), (2, "n", "aaaa copied"), (3, "d", None), (4, "d", "")]
    terms = [("copy", "copied by", None), ("copy", "Copied", "d"), ("a", "aa", None), ("a", "", None), *[("z", f"no such term {i}", None) for i in range(300 if chars > 40 else 3)]]
    found = segment.relations(spark.createDataFrame(rows, "rec int, field string, text string"), spark.createDataFrame(terms, "relation_type string, term string, field string"), 3, 4, chars)
    got = sorted((r["rec"], r["term"], r["at"], r["context"]) for r in found.collect())
    assert got == [(1, "Copied", 0, "Copied BY"), (1, "Copied", 20, "e; copied by"), (1, "copied by", 0, "Copied BY the"), (1, "copied by", 20, "e; copied by"), (2, "aa", 0, "aaaa c"), (2, "aa", 2, "aaaa cop")]


def test_relations_without_a_cross_join(spark):
    terms = spark.range(20_000).select(F.lit("t").alias("relation_type"), F.concat(F.lit("word"), "id").alias("term"), F.lit(None).cast("string").alias("field"))
    found = segment.relations(spark.createDataFrame([(1, "d", "word19999 and word7")], "rec int, field string, text string"), terms)
    assert "Cartesian" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(r["term"] for r in found.collect()) == ["word1", "word19", "word199", "word1999", "word19999", "word7"]


def test_listing_of_several_files(spark, tmp_path):
    """The first version wins by path and offset, whichever file is larger and read first."""
    head = "\t".join(["version_uri", "language", "author_ar", "author_lat", "author_lat_shuhra", "book", "title_ar", "title_lat", "tags"])
    line = lambda v, t: "\t".join([v, "ara", "", "", "", "0001A.B", "", t, ""])
    (tmp_path / "a.tsv").write_text(head + "\n" + line("0001A.B.v0", "First") + "\n", encoding="utf-8")
    (tmp_path / "b.tsv").write_text("\n".join([head, *[line(f"0001A.B.v{i}", "Second") for i in range(1, 5001)]]) + "\n", encoding="utf-8")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("128m", "20000"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            (book,) = records.listed_books(records.listing(spark, str(tmp_path))).collect()
            assert book["title_lat"] == ["First"]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


@pytest.mark.parametrize("indent", [None, 1])
@pytest.mark.parametrize("size", ["128m", "2000", "90"])
def test_id_map_by_ranges(spark, tmp_path, indent, size):
    """Braces, quotes and escapes in ids and texts, other sections, records that cross ranges and fill several."""
    word = lambda n=12: "".join(RNG.choice('ab{}[]"\\,: \n\té字}') for _ in range(RNG.randint(0, n)))
    kept = {word() + str(i): {"title": word(400 if i == 7 else 12), "list": [word() for _ in range(RNG.randint(0, 3))], "sub": {"a": word()}} for i in range(60)}
    store = {"_meta": {"records": {"x": {"title": "no"}}, "n": [1, {"q": "}"}]}, "records": kept, "other": {"z": {"title": "no"}}, "list": [{"a": {}}]}
    for i in range(2):
        (tmp_path / f"{i}.json").write_text(json.dumps(store if i else {"records": {}}, indent=indent), encoding="utf-8")
    kind = T.StructType([T.StructField("title", T.StringType()), T.StructField("list", T.ArrayType(T.StringType())), T.StructField("sub", T.StructType([T.StructField("a", T.StringType())]))])
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        got = {r["id"]: {"title": r["title"], "list": r["list"], "sub": {"a": r["sub"]["a"]}} for r in id_maps.id_map(spark, str(tmp_path), "records", kind).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == kept


class Stub(BaseHTTPRequestHandler):
    asked: list = []
    broken: set = set()

    def do_POST(self):
        query = parse_qs(self.rfile.read(int(self.headers["Content-Length"])).decode())["query"][0]
        ids = [x[3:] for x in query.split("{")[2].split("}")[0].split()]
        Stub.asked.append(ids)
        if Stub.broken & set(ids):
            self.send_error(500)
            return
        value = lambda v: {"value": v}
        rows = [{"e": value(f"http://x/entity/{i}"), "one_en": value(f"Name {i}"), "all_en": value("A||B"), "death": value("1286-01-01T00:00:00Z")} for i in ids if i != "Q3"]
        body = json.dumps({"results": {"bindings": rows}}).encode()
        self.send_response(200)
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *a):
        pass


def test_bindings(spark, tmp_path):
    """A partition a batch; unknown ids and failed batches are told apart; a second run asks for failed ids alone."""
    server = HTTPServer(("127.0.0.1", 0), Stub)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        authors = spark.createDataFrame([(f"a{i}", f"Q{i}") for i in range(1, 10)] + [("none", None), ("odd", "x} DROP")], "uri string, wikidata_id string")
        for c in ("wd_label_ar", "wd_label_en", "wd_aliases_ar", "wd_aliases_en", "wd_death_year", "wd_fetched_at", "wd_error"):
            authors = authors.withColumn(c, F.lit(None).cast("string"))
        go = lambda: {r["uri"]: r for r in bindings.enrich_authors(spark, authors, str(tmp_path / "b"), "2024", endpoint=f"http://127.0.0.1:{server.server_port}", batch=4, delay=0.01, tries=2).collect()}
        Stub.broken = {"Q6"}
        first = go()
        assert first["a1"]["wd_label_en"] == "Name Q1" and first["a1"]["wd_death_year"] == 1286 and first["a3"]["wd_error"] == "not found"
        assert "500" in first["a6"]["wd_error"] and "500" in first["a5"]["wd_error"] and first["none"]["wd_error"] is None
        assert max(map(len, Stub.asked)) <= 4 and not any("x" in i for ids in Stub.asked for i in ids)
        Stub.broken, Stub.asked = set(), []
        second = go()
        assert sorted(i for ids in Stub.asked for i in ids) == ["Q5", "Q6", "Q7", "Q8"] and second["a6"]["wd_label_en"] == "Name Q6" and second["a3"]["wd_error"] == "not found"
    finally:
        server.shutdown()
