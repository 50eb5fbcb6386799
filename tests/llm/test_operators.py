"""The ten operators against plain versions, on small fixtures with nulls, empty and long texts, ties and odd columns."""

import hashlib
import re
import zlib

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from linkspark.llm import bpe, chat_format, common, decontaminate, fm_index, huffman, line_dedup, ngram_join, pieces, quality_classifier, quality_rules, token_files, toxicity, warc
from linkspark.llm.common import hot_join, work_dir

DOCS = "doc_id long, text string"


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame(texts, DOCS).repartition(5).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def test_hot_join(spark):
    rows = spark.range(3000).select(F.when(F.col("id") < 1000, 0).otherwise(F.col("id")).alias("k"), F.col("id").alias("r"))
    table = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where("k % 2 = 0").withColumn("v", F.col("k") + 1)
    got = {r["r"]: r["v"] for r in hot_join(rows, table, ["k"], "n", ["v"], 3000, F.col("r").cast("string")).collect()}
    assert len(got) == 3000 and all(got[i] == (1 if i < 1000 else i + 1 if i % 2 == 0 else None) for i in range(3000))


def test_hot_join_deals_served_rows_out(spark):
    """The salt is a part of the second join's key: rows of a hot key don't meet in one task."""
    rows = spark.range(3000).select(F.when(F.col("id") < 1000, 0).otherwise(F.col("id")).alias("k"), F.col("id").alias("r"))
    table = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n")).withColumn("v", F.col("k") + 1)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = hot_join(rows, table, ["k"], "n", ["v"], 3000, F.col("r").cast("string"))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    (join,) = re.findall(r"SortMergeJoin \[(.*?)\], \[(.*?)\]", plan)
    assert all("__spread" in side for side in join) and "(__spread" not in plan
    assert len(re.findall(r"Exchange hashpartitioning\(k#\d+L?, __spread", plan)) == 2


def test_line_dedup(docs, none, texts):
    made = line_dedup.drop_lines(docs.withColumn("extra", F.lit(1)).withColumn("__gone1", F.lit(2)))
    assert made.columns == ["doc_id", "text", "extra", "__gone1"]
    got = {r["doc_id"]: r["text"] for r in made.collect()}
    expected = brute.lines(texts, line_dedup.LEAST_TOKENS)
    assert all(got[d] == expected[d, t] for d, t in texts) and sum(expected[d, t] != t for d, t in texts) > 30
    assert line_dedup.drop_lines(none).count() == 0


def test_line_dedup_names_and_ids(spark):
    """Columns named as the operator's own; null and repeated doc_ids; repeated rows; null texts."""
    line = "the very same line stands in all of these"
    rows = [(2, f"{line}\nown two"), (2, f"{line}\nown two"), (2, f"other\n{line}"), (None, f"{line}\nnone"), (None, None), (5, line), (7, line), (8, None)]
    docs = spark.createDataFrame(rows, DOCS)
    for c in ("__gone", "__row", "__doc", "__line_gone", "__line_row", "__line_of", "__map_part", "at", "line", "n", "leaf", "row", "h"):
        docs = docs.withColumn(c, F.lit(c))
    made = line_dedup.drop_lines(docs, n_dropped="dropped").collect()
    assert sorted((str(r["doc_id"]), str(r["text"]), r["dropped"]) for r in made) == sorted([("2", f"{line}\nown two", 0)] * 2 + [("2", f"other\n{line}", 0), ("None", "none", 1), ("None", "None", 0), ("5", "", 1), ("7", "", 1), ("8", "None", 0)])
    assert all(r["__gone"] == "__gone" and r["leaf"] == "leaf" for r in made)


def test_line_blocks(spark):
    """A leaf that is dealt out in blocks gives the templates that it would give as a whole."""
    lines = [f"one and two {a}{b} went home again by {c}" for a in "abcdefgh" for b in "abcdefgh" for c in ("car", "bus", "air")] + ["one and two are not like any other line here"]
    rows = [(i, x) for i, x in enumerate(lines)]
    docs = spark.createDataFrame(rows, DOCS)
    for block in (20, 20_000):
        gone = {r["doc_id"] for r in line_dedup.dropped(docs, block_lines=block).collect()}
        assert gone == set(range(1, 192)), block


def test_line_templates():
    lines = [f"user {n} has left the room again" for n in ("ann", "bob", "cy")] + ["an entirely different line with seven tokens"]
    names = {name: own for name, own in line_dedup.templates(lines)}
    assert names == {"user <*> has left the room again": [0, 1, 2], "an entirely different line with seven tokens": [3]}


def test_bpe(spark, docs, none, texts):
    tiktoken = pytest.importorskip("tiktoken")
    import public_tokenizers as pt

    r = bpe.ranks(pt.path("byte_bpe_multi_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=pt.PATTERN, mergeable_ranks=r.ranks, special_tokens={})
    got = {x["doc_id"]: x for x in bpe.digest(docs).collect()}
    for d, t in texts:
        ids = np.array(library.encode_ordinary(t or ""), "<u4").tobytes()
        assert (got[d]["n_tokens"], got[d]["ids_sha256"], got[d]["decoded_sha256"]) == (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
    assert bpe.digest(none).count() == 0
    clash = bpe.encode_decode(docs.where("doc_id < 3").select("doc_id", "text", F.lit(1).alias("decoded"), F.lit(2).alias("Token_IDs"), F.lit(3).alias("__both")))
    assert clash.columns == ["doc_id", "text", "decoded", "Token_IDs", "__both", "token_ids_1", "decoded_1"]
    assert all((x["decoded"], x["Token_IDs"], x["__both"], bytes(x["decoded_1"]).decode()) == (1, 2, 3, x["text"]) for x in clash.collect())
    twice = [x["ids_sha256"] for x in bpe.digest(docs.unionByName(docs).where("doc_id = 206")).collect()]
    assert twice == [got[206]["ids_sha256"]] * 2
    both = docs.select("text", bpe.encode(F.col("text"), pt.path("byte_bpe_multi_50k.tiktoken")).alias("i")).select("text", bpe.decode(F.col("i"), pt.path("byte_bpe_multi_50k.tiktoken")).alias("d"))
    assert all(bytes(x["d"]).decode() == (x["text"] or "") for x in both.collect())
    long = "abcde" * 3000
    assert bpe.merge_one(long.encode(), r) == library.encode_ordinary(long)


def test_ngram_join(spark, docs, none, texts):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["n_links"]) for r in ngram_join.join(docs).collect()}
    assert got == brute.jaccard(texts)
    assert ngram_join.join(none).count() == 0
    kept = ngram_join.keep_one(docs.withColumn("n", F.lit(0)))
    assert kept.columns == ["doc_id", "text", "n"]
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(d for d, x in got.items() if x[1] == d)


def test_ngram_join_ties(spark):
    rows = [(1, "a b c d"), (1, "a b c d"), (None, "a b c d"), (2, "x y z w"), (1, "other words stand here")]
    got = ngram_join.join(spark.createDataFrame(rows, DOCS))
    assert got.count() == 5 and {r["component_id"] for r in got.collect()} == {1, 2}


def test_keep_one(spark):
    """One row of each component: repeated rows, null ids, ids with several texts, and columns named as the operator's own."""
    a, b = "a b c d e f g h", "p q r s t u v w"
    rows = [(4, a), (4, a), (3, a), (None, a), (None, b), (None, b), (9, None), (9, ""), (None, " "), (5, "z y x w"), (5, "one two three four")]
    docs = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit(c) for c in ("__kept", "__row", "__rows", "row", "rows", "cls", "n", "root")})
    made = ngram_join.keep_one(docs)
    assert made.columns == docs.columns
    assert sorted((str(r["doc_id"]), str(r["text"]), r["__kept"]) for r in made.collect()) == sorted((str(d), str(t), "__kept") for d, t in [rows[2], rows[4], *rows[6:]])
    assert ngram_join.keep_one(docs.where("false")).count() == 0


def test_components(spark):
    """Paths, hubs of many links and double links."""
    rng = np.random.default_rng(8)
    links = [(i, i + 1) for i in range(40)] + [(1000, i) for i in range(1001, 1400)] + [(5000, 5000), (6001, 6000), (6000, 6001)] + [(2000 + int(a), 2000 + int(b)) for a, b in rng.integers(0, 60, (40, 2))]
    got = {r["cls"]: r["root"] for r in ngram_join.components(spark.createDataFrame(links, "a long, b long")).collect()}
    parent = {x: x for e in links for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        p, q = find(a), find(b)
        parent[max(p, q)] = min(p, q)
    assert got == {x: find(x) for x in parent if find(x) != x}


def test_blocks_of_the_join(spark, monkeypatch):
    """Groups of near copies larger than a block, and a token of more classes than are merged."""
    rng = np.random.default_rng(6)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(120):
        w = list(base)
        w[rng.integers(0, 60)] = f"x{i % 50}"
        rows.append((i, " ".join(w[: 60 - i % 2])))
    rows += [(200 + i, " ".join(rng.choice(base, 30))) for i in range(30)]
    want = brute.jaccard(rows)
    for limit in (100_000, 20):
        monkeypatch.setattr(ngram_join, "CHUNK", 8)
        monkeypatch.setattr(ngram_join, "MERGE_LIMIT", limit)
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["n_links"]) for r in ngram_join.join(spark.createDataFrame(rows, DOCS)).collect()}
        assert got == want


def test_toxicity(spark):
    rows = [(i, ("some plain words stand here number%d " % (i % 50)) + ("idiot scum" if i % 4 == 0 else "friend")) for i in range(400)] + [(900, None), (901, ""), (None, "x")]
    docs = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)] + [(3, None), (7, 2)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    got = docs.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("h"), toxicity.score(F.coalesce("text", F.lit("")), model, spark).alias("s")).collect()
    held = [r for r in got if r["h"] and r["doc_id"] is not None and r["doc_id"] < 400]
    assert held and all((r["s"] >= 0.5) == (r["doc_id"] % 4 == 0) for r in held)
    assert all(r["h"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got if r["doc_id"] is not None)
    assert all(0 <= r["s"] <= 1 for r in got) and len(got) == len(rows)
    bias, names, _ = toxicity.train(docs, labels.where("false"))
    assert not len(names) and bias == 0


def test_toxicity_against_plain_version():
    rng = np.random.default_rng(9)
    docs = [np.unique(rng.zipf(1.3, 40) % 300).astype(np.uint64) for _ in range(300)]
    labels = [int((7 in d) ^ (rng.random() < 0.1)) for d in docs]
    bias, names, weights = toxicity.fit(docs, labels)
    want_bias, want = brute.ftrl([d.tolist() for d in docs], labels, toxicity.EPOCHS, toxicity.ALPHA, toxicity.BETA, toxicity.L1, toxicity.LEAST_DOCS)
    assert want and bias == pytest.approx(want_bias) and dict(zip(names.tolist(), weights.tolist(), strict=True)) == pytest.approx(want)
    scorer = toxicity.Scorer(bias, names, weights)
    assert toxicity.features("a B c").tolist() == toxicity.features("A b C").tolist() and len(toxicity.features("a b c")) == 6
    assert scorer.score(None) == scorer.score("") == pytest.approx(1 / (1 + np.exp(-bias)))


def test_toxicity_defined_cases(spark, none):
    """Empty tables, repeated rows and labels, ties."""
    rows = [(i, "calm plain words" if i % 2 else "vile scum words") for i in range(200)]
    docs = spark.createDataFrame(rows * 2, DOCS)
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(200)] * 2, "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    once = toxicity.train(spark.createDataFrame(rows, DOCS), labels)
    assert model[0] == once[0] and (model[1] == once[1]).all() and (model[2] == once[2]).all()
    assert toxicity.train(none, labels)[0] == 0 and none.select(toxicity.score(F.col("text"), model, spark)).count() == 0
    scores = {r["t"]: r["s"] for r in docs.select(F.col("text").alias("t"), toxicity.score(F.col("text"), model, spark).alias("s")).collect()}
    assert len(scores) == 2 and scores["vile scum words"] > 0.5 > scores["calm plain words"]


def test_huffman():
    rng = np.random.default_rng(2)
    for n, k in ((1, 1), (5, 2), (4096, 9), (4097, 300), (60_000, 40_000)):
        ids = (rng.zipf(1.3, n) % k).astype(np.uint16)
        lengths = huffman.code_lengths(np.bincount(ids))
        stream, points = huffman.encode(ids, lengths, huffman.canonical(lengths))
        assert lengths.max() <= max(huffman.LIMIT, 18) and (huffman.decode(stream, points, n, lengths) == ids).all()
    assert huffman.encode(np.zeros(0, np.uint16), np.zeros(1, np.uint8), np.zeros(1, np.uint32))[0] == b""


def test_token_files(spark, docs, none, texts):
    tokenizers = pytest.importorskip("tokenizers")
    import public_tokenizers as pt

    path = pt.path("byte_bpe_50k.json")
    library = tokenizers.Tokenizer.from_file(path)
    manifest = token_files.write(docs.unionByName(spark.createDataFrame([(None, "no id")], DOCS)), work_dir(spark, "t"), path)
    got = sorted(token_files.read(manifest).collect(), key=lambda r: r["start"])
    start = 0
    for r, (d, t) in zip(got, sorted([(None, "no id"), *texts], key=lambda x: -1 if x[0] is None else x[0]), strict=True):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        assert (r["doc_id"], r["start"], r["n_tokens"], bytes(r["token_ids"])) == (d, start, len(ids), np.array(ids, "<u4").tobytes())
        start += len(ids)
    assert token_files.read(token_files.write(none, work_dir(spark, "t"), path)).count() == 0


def test_token_files_special_strings_and_bounds(spark, monkeypatch):
    """Strings of added tokens as the library has them; repeated and null ids; files of few ids; other kinds of vocabulary."""
    tokenizers = pytest.importorskip("tokenizers")
    import public_tokenizers as pt

    rows = [(5, "a<|endoftext|>b"), (1, "<|endoftext|>"), (2, "x <|endoftext|> y <|im_end|>"), (3, "'s it's 'll '")] + [(4, f"same id {i % 7}") for i in range(40)] + [(None, None)] * 20
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    monkeypatch.setattr(common, "BATCH_ROWS", 4)  # files end with a batch
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        path = pt.path(name)
        library = tokenizers.Tokenizer.from_file(path)
        manifest = token_files.write(docs, work_dir(spark, "t"), path, file_ids=20)
        assert manifest.count() > 5
        got = sorted(token_files.read(manifest).collect(), key=lambda r: r["start"])
        assert [r["doc_id"] or 0 for r in got] == sorted(d or 0 for d, _ in rows)
        ids = lambda t: np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4").tobytes()
        assert sorted((r["doc_id"] or 0, bytes(r["token_ids"])) for r in got) == sorted((d or 0, ids(t)) for d, t in rows)
        assert [r["start"] for r in got] == [0, *np.cumsum([r["n_tokens"] for r in got])[:-1].tolist()]


def test_huffman_of_a_large_vocabulary():
    ids = np.random.default_rng(4).permutation(np.arange(140_000, dtype=np.uint32) % 100_000)
    lengths = huffman.code_lengths(np.bincount(ids))
    stream, points = huffman.encode(ids, lengths, huffman.canonical(lengths))
    assert huffman.LIMIT < lengths.max() <= huffman.MOST and (huffman.decode(stream, points, len(ids), lengths) == ids).all()


def test_pieces():
    """Cuts as the pattern's own, over texts that are made of what it tells apart; kinds of characters as the library's."""
    import public_tokenizers as pt
    import pyarrow as pa
    import regex
    from tokenizers import pre_tokenizers

    find, rng = regex.compile(pt.PATTERN).findall, np.random.default_rng(3)
    of = ["'", "s", "t", "re", "ve", "ll", "d", "m", " ", "  ", "\n", "\t", "a", "é", "字", "1", "٣", "!", "\u2003", "\u3000", "'s", "\U0001f600", "\U00010400", "\x1c", "\x85", "Z"]
    for _ in range(500):
        texts = ["".join(rng.choice(of, rng.integers(0, 30))) for _ in range(rng.integers(1, 6))]
        data, offsets = pieces.bytes_of(pa.array([*texts, None]))
        begins = offsets[:-1]
        at = pieces.starts(data, begins[begins < offsets[1:]])
        assert [bytes(data[a:b]).decode() for a, b in zip(at, [*at[1:], len(data)], strict=False)] == [p for t in texts for p in find(t)]
    cut = pre_tokenizers.ByteLevel(add_prefix_space=False).pre_tokenize_str
    kinds = pieces.kinds()
    for c in [*range(0x80, 0x3200, 3), *range(0x3200, 0x30000, 97)]:
        if not 0xD800 <= c < 0xE000:
            n = [b - a for _, (a, b) in cut("a" + chr(c) + "1!")]
            assert {2: pieces.LETTER, 1: kinds[c]}[n[0]] == kinds[c], hex(c)


def test_long_texts_are_taken_apart(monkeypatch):
    import public_tokenizers as pt
    import pyarrow as pa

    path = pt.path("byte_bpe_multi_50k.tiktoken")
    texts = ["some words 12 and it's so" * 9, "x" * 300, None, "", "字" * 100, "a b " * 50]
    whole = bpe.encoder(path).texts(pa.array(texts)).to_pylist()
    monkeypatch.setattr(pieces, "BLOCK_BYTES", 40)
    assert pieces.Encoder(lambda new: bpe.merge_many(new, bpe.ranks(path)), 5).texts(pa.array(texts)).to_pylist() == whole


def test_quality_classifier(spark):
    good, bad = "the cat and the dog of the house are in a garden with it " * 6, "%%% ### " * 40
    rows = [(i, (good if i % 3 else bad) + str(i), f"h{i % 4}", None if i == 5 else "p") for i in range(300)] + [(900, None, None, "p")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, host string, path string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(200)], "doc_id long, quality int")
    got = quality_classifier.classify(docs, labels, F.col("host"), F.col("path")).collect()
    assert len(got) == 301 and all(r["predicted"] == int(r["doc_id"] % 3 > 0) for r in got if r["doc_id"] < 300)
    means = [r["host_posterior"] for r in got if r["doc_id"] < 300]
    assert all(0 < m < 1 for m in means) and max(means) - min(means) < 0.2
    assert quality_classifier.classify(docs.where("false"), labels, F.col("host"), F.col("path")).count() == 0


@pytest.mark.parametrize("most_shift", [None, 0.3])
def test_quality_classifier_against_plain_version(spark, most_shift):
    """Hosts and paths that differ, sparse ones, repeated rows and ties: posteriors and scores as worked out plainly."""
    rng = np.random.default_rng(12)
    rows = []
    for i in range(400):
        host, path = f"h{min(int(rng.zipf(1.5)), 30)}", f"p{rng.integers(0, 3)}"
        good = rng.random() < (0.8 if host == "h1" else 0.3 if path == "p1" else 0.5)
        rows.append((i, ("the cat and the dog of the house are in a garden " if good else "%% word ### ") * int(rng.integers(2, 30)), host, path))
    rows += rows[:20]
    docs = spark.createDataFrame(rows, "doc_id long, text string, host string, path string")
    labels = spark.createDataFrame([(i, int("cat" in rows[i][1])) for i in range(0, 300, 3)] * 2, "doc_id long, quality int")
    got = quality_classifier.classify(docs, labels, F.col("host"), F.col("path"), most_shift=most_shift).join(docs.select("doc_id", "host", "path").distinct(), "doc_id").collect()
    want = brute.empirical_bayes([(r["host"], r["path"], r["evidence"]) for r in got], most_shift)
    assert len(got) == 420 and all((r["host_posterior"], r["path_posterior"], r["score"]) == pytest.approx(w) for r, w in zip(got, want, strict=True))
    assert len({round(w[1], 6) for w in want}) > 20


def test_regression():
    """The weights of the regression meet their condition."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 3))
    y = (x[:, 0] + rng.normal(size=200) > 0).astype(float)
    w = quality_classifier.fit(x, y)
    p = 1 / (1 + np.exp(-(x @ w[:-1] + w[-1])))
    assert np.abs(x.T @ (y - p) - w[:-1]).max() < 1e-6


def test_variances_of_a_nested_model():
    """Simulated sites: paths that differ in hosts that don't, hosts that differ, and none of both; sizes differ."""
    rng = np.random.default_rng(5)
    for path_spread, host_spread in ((0.15, 0.0), (0.1, 0.2), (0.0, 0.0), (0.0, 0.1)):
        hosts = []
        for _ in range(200):
            own = rng.normal(0, host_spread)
            hosts.append([own + rng.normal(0, path_spread) + rng.normal(0, 0.2, rng.integers(5, 96)) for _ in range(rng.integers(2, 5))])
        paths = [x for h in hosts for x in h]
        every = [np.concatenate(h) for h in hosts]
        whole = np.concatenate(every)
        n = len(whole)
        within = sum(((x - x.mean()) ** 2).sum() for x in paths)
        of_paths = sum(len(x) * (x.mean() - e.mean()) ** 2 for h, e in zip(hosts, every) for x in h)
        of_hosts = sum(len(e) * (e.mean() - whole.mean()) ** 2 for e in every)
        sizes = sum(len(x) ** 2 for x in paths), sum(len(x) ** 2 / len(e) for h, e in zip(hosts, every) for x in h), sum(len(e) ** 2 for e in every)
        noise, path, host = quality_classifier.variances(n, len(paths), len(hosts), within, of_paths, of_hosts, *sizes)
        assert noise == pytest.approx(0.04, rel=0.05) and path == pytest.approx(path_spread**2, rel=0.2, abs=0.0005)
        # Where hosts don't differ, a host of three paths and 150 documents keeps little of its chance mean.
        assert host == pytest.approx(host_spread**2, rel=0.3, abs=0.003)
        if not host_spread:
            assert host / (host + path / 3 + noise / 150) < 0.35 or host < 0.0002


def test_host_and_path(spark):
    urls = spark.createDataFrame([("http://A.org/x/y?z",), ("https://a.org",), (None,), ("no url",)], "url string")
    host, path = quality_classifier.host_and_path(F.col("url"))
    assert [tuple(r) for r in urls.select(host, path).collect()] == [("a.org", "x"), ("a.org", ""), ("", ""), ("", "")]


def test_warc_repeated_pages(spark):
    """Repeated rows are all kept, and only those of other ids revisit."""
    long = "y" * 300
    pages = spark.createDataFrame([(1, "u", long), (1, "u", long), (2, "u", long), (2, "u", long), (2, "u", "z" * 300), (None, None, None)], "page_id long, url string, html string")
    got = [(r["page_id"] or 0, r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.read(warc.write(warc.plan(pages.withColumn("digest", F.lit(1))), work_dir(spark, "w"))).collect()]
    assert sorted(map(str, got)) == sorted(map(str, [(0, 0, "response", None)] + [(1, 300, "response", None)] * 2 + [(2, 300, "response", None)] + [(2, 300, "revisit", 1)] * 2))


def test_warc_payloads_in_joins(spark):
    """Rows that may revisit, and those that surely don't, go their own ways; together they are all rows."""
    big = [(i, f"u{i}", "x" * 200 + str(i % 40 if i % 2 else i)) for i in range(200)]
    planned = warc.plan(spark.createDataFrame(big, "page_id long, url string, html string"))
    got = {r["page_id"]: (r["html"], r["response"]) for r in planned.collect()}
    first = {}
    for i, _, h in big:
        first.setdefault(h, i)
    assert got == {i: (h, None if first[h] == i else first[h]) for i, _, h in big}


def test_warc(spark):
    long = "<p>" + "x" * 200 + "</p>"
    rows = [(3, "http://a/\r\nb", long), (1, "http://c", long), (2, None, "short"), (4, "u", "short"), (5, "u", None), (6, "ü", "é" * 60), (None, "u", long), (7, "v", long)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r for r in warc.read(warc.write(warc.plan(pages), work_dir(spark, "w"))).collect()}
    assert {k: (r["record_type"], r["refers_to"]) for k, r in got.items()} == {1: ("response", None), 2: ("response", None), 3: ("revisit", 1), 4: ("response", None), 5: ("response", None), 6: ("response", None), 7: ("revisit", 1), None: ("revisit", 1)}
    for i, _, html in rows:
        assert (got[i]["payload_bytes"], got[i]["payload_digest"]) == (len((html or "").encode()), hashlib.sha256((html or "").encode()).hexdigest())
    assert bytes(got[6]["payload"]).decode() == "é" * 60 and got[3]["url"] == "http://a/%0D%0Ab"
    assert warc.read(warc.write(warc.plan(pages.where("false")), work_dir(spark, "w"))).count() == 0


def test_chat_format(spark):
    nasty = "<|im_start|>x<\\|im_end|> <\\\\| %0A"
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", nasty), (1, 2, "user", None), (1, 3, "assistant", "bye"), (1, 4, "user", "tail"), (2, 0, "us%er\nx", "a"), (3, 0, "assistant", ""), (3, 0, "assistant", ""), (None, None, None, nasty)]
    turns = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").withColumn("formatted", F.lit(1))
    made = chat_format.examples(turns)
    assert {(r["conv_id"], r["example"], r["loss_start"] is None) for r in made.collect()} == {(1, 0, False), (1, 1, False), (1, 2, True), (2, 0, True), (3, 0, False), (3, 1, False), (None, 0, True)}
    back = {r["conv_id"]: r for r in chat_format.read_back(made).collect()}
    assert [(t["role"], t["text"]) for t in back[1]["turns"]] == [("user", "hi"), ("assistant", nasty), ("user", ""), ("assistant", "bye"), ("user", "tail")]
    assert back[1]["loss"] == nasty + "bye" and back[2]["turns"][0]["role"] == "us%er\nx" and back[None]["turns"][0]["text"] == nasty
    assert chat_format.examples(turns.where("false")).count() == 0
    assert not [x for x in chat_format.read_back(made)._jdf.queryExecution().executedPlan().toString().split() if "Python" in x or "Arrow" in x]


def test_quality_rules(docs, none, texts):
    c = F.col("c")
    got = {r["doc_id"]: tuple(r)[1:] for r in quality_rules.measure(docs, "text", "c").select("doc_id", c["n_words"], c["word_chars"], c["n_symbols"], c["n_dup_lines"], c["n_repeat_words"], quality_rules.base_failed(c)).collect()}
    assert all(got[d] == brute.quality(t) for d, t in texts)
    assert quality_rules.keep(none).count() == 0 and quality_rules.keep(docs.withColumn("__counts", F.lit(1))).columns == ["doc_id", "text", "__counts"]
    full = [" ".join(f"the {c}{i} {c}{i}of" for c in "pqrs") for i in range(8)]
    lines = none.sparkSession.createDataFrame([(1, "\n".join(full + ["Haanth."] * 6)), (2, "\n".join([full[0].replace("of", "longer")] * 3 + full[1:5]))], DOCS)
    c1 = {r["doc_id"]: r["b"] for r in quality_rules.measure(lines, "text", "c").select("doc_id", quality_rules.base_failed(c).alias("b")).collect()}
    assert not any(c1.values()), c1
    lines = quality_rules.keep(lines)
    assert [r["doc_id"] for r in lines.collect()] == [1]
    assert quality_rules.RATIOS.keys() >= {r.measure for r in quality_rules.RULES}


def test_fm_index():
    rng = np.random.default_rng(3)
    text = np.concatenate([np.append(rng.integers(1, 5, n), 0) for n in (40, 3, 60, 40)])
    text[104:144] = text[0:40]
    index = fm_index.FMIndex(text, 4)
    for m in (1, 2, 5):
        patterns = rng.integers(1, 5, (30, m))
        lo, hi = index.search(patterns)
        for p, a, b in zip(patterns, lo, hi, strict=True):
            expected = [i for i in range(len(text) - m + 1) if (text[i : i + m] == p).all()]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == expected


def test_decontaminate(spark, docs, none, texts):
    items = [("b1", texts[0][1]), ("b2", "of the"), ("b2", texts[70][1]), (None, texts[3][1]), ("b3", None), ("b4", " ".join(dict(texts)[206].split()[5000:5040]))]
    benchmark = spark.createDataFrame(items, "item_id string, text string")
    for block in (decontaminate.BLOCK_CHARS, 50):
        before, decontaminate.BLOCK_CHARS = decontaminate.BLOCK_CHARS, block
        got = {r["doc_id"]: r["x"] for r in decontaminate.annotate(docs.withColumn("item_id", F.lit(1)), benchmark, "x").collect()}
        decontaminate.BLOCK_CHARS = before
        for d, t in texts:
            assert (got[d]["n_words"], got[d]["n_hit"], got[d]["items"]) == brute.contamination(t, items), d
    clash = decontaminate.annotate(docs.unionByName(docs).withColumns({"x": F.lit(1), "X_1": F.lit(2), "__hits": F.lit(3)}), benchmark, "x")
    assert clash.columns == ["doc_id", "text", "x", "X_1", "__hits", "x_2"] and clash.where("x = 1 AND x_2.n_hit > 0").count() == 2 * sum(brute.contamination(t, items)[1] > 0 for _, t in texts)
    assert decontaminate.clean(docs, benchmark.where("false")).count() == len(texts)
    assert decontaminate.clean(none, benchmark).count() == 0
