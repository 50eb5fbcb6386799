"""Golden records, vector codes and HTML extraction against plain versions."""

import datetime as dt
import hashlib
import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from linkspark.llm import golden_record, html_extract, vector_codes
from linkspark.llm.html_text import blocks, parted

CLIENTS = "client_id long, master_id long, source string, updated_at timestamp_ntz, name string, email string, city string, nation_id int, segment string, balance double"


def client_rows():
    rng = random.Random(3)
    day = lambda: dt.datetime(2024, 1, 1) + dt.timedelta(days=rng.choice([0, 1, 30, 31, 60, 90]), microseconds=rng.choice([0, 0, 1]))
    rows = []
    for i in range(900):
        master = 1 if i % 3 == 0 else rng.choice([None, i, i - 1, i // 2])
        rows.append((
            i, master, rng.choice(["crm", "web", "store", "partner", None, "fax", " "]), rng.choice([None, day(), day(), day()]),
            rng.choice([None, "", " \t", "Ann Lee", "Änn Lee", "A. Lee", "字" * 4 + " Lee"]), rng.choice([None, "", "a@x.org", "b@x.org ", "\x0b"]),
            rng.choice([None, "Ulm", "\u0085"]), rng.choice([None, 1, 2]), rng.choice([None, None, "retail", "export"]), rng.choice([None, -0.005, 1.005, 12.3, float("inf"), 1e3]),
        ))
    rows += rows[:40] + [(None, None, "web", None, "x", None, None, None, None, None), (None, None, None, day(), None, None, None, 3, None, 7.0), (None, 1, "web", day(), "Nobody", None, None, None, None, None)]
    rows += [(5000 + i, 5000, None, None, None, None, None, None, None, None) for i in range(3)]
    return rows


def by_sql(rows):
    con = duckdb.connect()
    con.execute("CREATE TABLE clients (client_id BIGINT, master_id BIGINT, source VARCHAR, updated_at TIMESTAMP, name VARCHAR, email VARCHAR, city VARCHAR, nation_id INT, segment VARCHAR, balance DOUBLE)")
    if rows:
        con.executemany("INSERT INTO clients VALUES (?,?,?,?,?,?,?,?,?,?)", rows)
    made = con.sql(golden_record.oracle())
    return made.columns, made.fetchall()


@pytest.mark.parametrize("partitions", [1, 7, 60])
def test_golden_record(spark, partitions):
    """One cluster holds a third of the rows and spans many partitions; ties, blanks, nulls and repeated rows."""
    rows = client_rows()
    columns, expected = by_sql(rows)
    made = golden_record.golden(spark.createDataFrame(rows, CLIENTS).repartition(5).withColumn("trust", F.lit(9)).withColumn("part", F.lit(9)), partitions)
    assert sorted(made.columns) == sorted(columns)
    assert sorted(map(tuple, made.select(*columns).collect()), key=repr) == sorted(expected, key=repr)


def test_golden_record_of_nothing(spark):
    assert golden_record.golden(spark.createDataFrame([], CLIENTS), 3).collect() == []


def test_driver_gets_two_rows_a_partition(spark, monkeypatch):
    """What the scan gets doesn't grow with the rows."""
    seen = []
    monkeypatch.setattr(golden_record, "winners", lambda parts, f=golden_record.winners: seen.append(len(parts)) or f(parts))
    for times in (1, 4):
        rows = spark.createDataFrame(client_rows(), CLIENTS)
        golden_record.golden(rows.unionAll(rows) if times > 1 else rows, 6).collect()
    assert all(n <= 12 for n in seen)


def plain_codes(rows, parts, entries, rounds):
    """Whole numbers of Python throughout."""
    kept = [(i, [math.floor(256 * float(np.float32(x))) for x in v], lab) for i, v, lab in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not kept:
        return [], ""
    width = len(kept[0][1]) // parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(v, p) for _, v, _ in kept[:entries]] for p in range(parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, c)), e) for e, c in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for _, v, _ in kept:
                groups.setdefault(near(cut(v, p), books[p])[1], []).append(cut(v, p))
            books[p] = [[sum(c) // len(groups[e]) for c in zip(*groups[e])] if e in groups else old for e, old in enumerate(books[p])]
    out, sums = [], {}
    for i, v, lab in kept:
        found = [near(cut(v, p), books[p]) for p in range(parts)]
        error = sum(d for d, _ in found)
        sums[lab] = sums.get(lab, 0) + error
        out.append((i, "".join(f"{e:02x}" for _, e in found), error, lab))
    text = ",".join(str(x) for b in books for c in b for x in c)
    return [(i, code, min(e, 2**63 - 1), min(sums[lab], 2**63 - 1)) for i, code, e, lab in out], hashlib.sha256(text.encode()).hexdigest()


def vector_rows(scale):
    rng = random.Random(7)
    make = lambda: [rng.choice([0.0, -0.0039, 0.25, rng.uniform(-1, 1)]) * scale for _ in range(32)]
    one = make()
    rows = [(rng.choice([i, i // 2]), one if i % 3 == 0 else make(), rng.choice([None, 1, 2])) for i in range(150)]
    return rows + [(None, make(), 1), (None, None, 1), (900, [], 1), (901, [None] + one[1:], 1), (902, [float("nan")] + one[1:], 2), (903, [float("inf")] + one[1:], None)]


@pytest.mark.parametrize("scale", [1.0, 1e5, 1e12, 1e30])
def test_vector_codes(spark, scale):
    """Copies and ties, broken vectors, ids that repeat or are null, and components far beyond int64's squares."""
    rows = vector_rows(scale)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(4).withColumn("code", F.lit("x")).withColumn("vector", F.lit(1))
    made = vector_codes.compress(df, entries=16)
    expected, digest = plain_codes(rows, vector_codes.PARTS, 16, vector_codes.ROUNDS)
    got = made.collect()
    assert sorted(((r[0], r[1], r[2], r[3]) for r in got), key=repr) == sorted(expected, key=repr)
    assert {r["codebooks_sha256"] for r in got} == {digest}


def test_vector_codes_few_and_none(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert vector_codes.compress(spark.createDataFrame([], schema)).collect() == []
    assert vector_codes.compress(spark.createDataFrame([(1, None, 1)], schema)).collect() == []
    (r,) = vector_codes.compress(spark.createDataFrame([(1, [0.5] * 16, None)], schema)).collect()
    assert (r["code"], r["error"], r["label_error"]) == ("00" * 16, 0, 0)
    with pytest.raises(ValueError):
        vector_codes.compress(spark.createDataFrame([(1, [0.5] * 16, None), (2, [0.5] * 15, None)], schema))


def test_screening_is_rigorous():
    """Nearly equal distances of large numbers, which float32 can't tell apart; few entries are evaluated twice where it can."""
    rng = np.random.default_rng(1)
    for top in (3, 300, 1 << 20, 1 << 25):
        x, book = rng.integers(-top, top, (400, 4)), rng.integers(-top, top, (64, 4))
        book[32:40] = book[:8]
        book[40:48] = book[:8] + rng.integers(-1, 2, (8, 4))
        code, far, n = vector_codes.nearest(x, book)
        d = ((x[:, None, :] - book[None, :, :]) ** 2).sum(axis=2)
        assert (code == d.argmin(axis=1)).all() and (far == d.min(axis=1)).all()
        assert n >= 400 and (top > 300 or n < 400 * 12)


@pytest.mark.parametrize(
    "html, main, other",
    [
        (None, None, []),
        ("plain &amp; simple\n text", None, ["plain & simple text"]),
        ("<article><h1>A&nbsp;b</h1><p><b>One<br><p>Two</p></article><footer>&copy; f", ["A b", "One", "Two"], ["© f"]),
        ("<nav><ul><li>m<li>n</ul></nav><div class=ad>x</div><main><p>t</p><form><p>mail<button>go</button></form></main>", ["t"], ["m", "n", "x", "mail", "go"]),
        ("<form id=all><article>in<aside>s</aside> out</article></form>", ["in", "out"], ["s"]),
        ("<article>a<section id=comments><article>c</article></section></article><p>after", ["a"], ["c", "after"]),
        ("<article class='post has-sidebar'>x<!-- no <p>no --><script>if (a<b) '</p>'</script>y<style>p{}</style></article>", ["xy"], []),
        ("<header>h</header><article><header>t</header><p>u<footer>v</footer></article>", ["t", "u"], ["h", "v"]),
        ("<div role=main>m<div class='cookie-notice'>n</div></div>", ["m"], ["n"]),
        ("<p>a < b & c &lt; d <i>e</p></i><p title='>'>f <a href=", None, ["a < b & c < d e", "f"]),
        ("<textarea>t</textarea><title>t</title><noscript>n</noscript>left<template>x</template>", None, ["left"]),
        ("<article>" + "<b>" * 5000 + "deep" + "<p>" * 5000 + "</article>end", ["deep"], ["end"]),
    ],
)
def test_blocks(html, main, other):
    got, open_, chrome = parted(html)
    assert (got, open_ + chrome if got is None or not open_ else chrome + open_) == (main, other)
    assert [t for _, t in blocks(html or "") if t != " ".join(t.split()) or not t] == []


def test_suffixes():
    rng = random.Random(2)
    tokens = np.array([rng.randrange(3) for _ in range(200)], dtype=np.uint64)
    order, rank = html_extract.suffixes(tokens, 8)
    held = [tuple(tokens[i : i + 8]) for i in range(200)]
    assert [held[i] for i in order] == sorted(held)
    assert all((rank[i] == rank[j]) == (held[i] == held[j]) for i in range(0, 200, 7) for j in range(200))
    assert len(html_extract.windows(tokens, 1, 8)) == 193 and len(html_extract.windows(tokens[:7], 1, 8)) == 0


def page_rows():
    rng = random.Random(4)
    words = lambda n: " ".join(rng.choice("abcdefghijklm") + str(rng.randrange(90)) for _ in range(n))
    menu, notice, legal = words(12), words(30), words(9)
    rows = []
    for i in range(60):
        host = "one.org" if i % 3 else "two.org"
        body = "".join(f"<p>{words(rng.randint(1, 30))}</p>" for _ in range(rng.randint(1, 5)))
        bar = "".join(f"<p>{w}</p>" for w in menu.split(" "))
        rows.append((i, f"https://{host}/{i}", f"<div>{bar}</div>{body}<div>{notice if host == 'one.org' else words(9)}</div><p>{legal} {words(3)}</p>"))
    rows += [(100 + i, "https://one.org/copy", rows[1][2]) for i in range(20)]  # copies of one page
    rows += [(200, "http://ONE.org:80/x", f"<article><p>{notice}</p><p>{menu}</p></article>"), (201, "http://three.org", f"<nav>{legal}</nav>{words(20)}"), (202, "http://three.org", f"<p>{legal}")]
    return rows + [(300, None, None), (301, None, ""), (None, "x://[", "<p>hm"), (302, "http://one.org", "<p>" + words(60_000)), (0, rows[0][1], rows[0][2])]


def plain_texts(rows, long):
    """Every window of every host in one dictionary."""
    seen = {}
    for _, url, html in rows:
        main, open_, chrome = parted(html)
        t = html_extract.stream([*open_, *chrome])
        for k in range(len(t) - long + 1):
            seen.setdefault((html_extract.site(url), *t[k : k + long]), set()).add(tuple(open_ if main is None else main))
    out = []
    for i, url, html in rows:
        main, open_, _ = parted(html)
        t = html_extract.stream(open_)
        covered = {j for k in range(len(t) - long + 1) if len(seen[(html_extract.site(url), *t[k : k + long])]) > 1 for j in range(k, k + long)}
        left, at = [], 0
        for b in open_:
            n = len(b.split(" "))
            if not covered.issuperset(range(at, at + n)):
                left.append(b)
            at += n + 1
        text = "\n\n".join(left if main is None else main)
        out.append((i, url, text, len(text)))
    return out


@pytest.mark.parametrize("slab", [html_extract.SLAB, 100])
def test_html_extract(spark, slab, monkeypatch):
    """Menus, notices and legal lines that repeat on a host go, in slabs of any size; copies of a page stay whole; articles stay as they are."""
    monkeypatch.setattr(html_extract, "SLAB", slab)
    rows = page_rows()
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(6).withColumn("key", F.lit(1)).withColumn("text", F.lit("t"))
    got = sorted(map(tuple, html_extract.extract(df).collect()), key=repr)
    expected = plain_texts(rows, html_extract.LONG)
    assert got == sorted(expected, key=repr)
    kept = {i: text for i, _, text, _ in expected}
    assert kept[1] == kept[100] != "" and rows[1][2].count("<p>") > kept[1].count("\n\n") + 1 and kept[200].count("\n\n") == 1 and kept[202] == ""


def test_html_extract_of_nothing(spark):
    made = html_extract.extract(spark.createDataFrame([], "page_id long, url string, html string"))
    assert made.columns == ["page_id", "url", "text", "n_chars"] and made.collect() == []
