"""Line dedup at sizes and counts that the small fixture doesn't reach, against a plain version of its own."""

import random

import brute
import pytest

from linkspark.llm import line_dedup


def plain(lines):
    """The components of all pairs that are linked."""
    words, root = [x.split(" ") for x in lines], list(range(len(lines)))
    top = lambda i: i if root[i] == i else top(root[i])
    for i in range(len(lines)):
        for j in range(i):
            if brute.linked(words[i], words[j]):
                a, b = sorted((top(i), top(j)))
                root[b] = a
    made = {}
    for i in range(len(lines)):
        made.setdefault(top(i), set()).add(i)
    return {frozenset(own) for own in made.values()}


def leaf(width, size, seed):
    """Lines of a leaf: variants of some, with fields and numbers, and lines like no other."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcd") for _ in range(3))
    bases = [[rng.choice([word(), "<*>", word(), "a1"]) for _ in range(width - 3)] for _ in range(size // 8)]
    lines = set()
    while len(lines) < size:
        w = list(rng.choice(bases))
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = rng.choice(["<*>", word(), "b2"])
        lines.add(" ".join(["one", "two", "three", *w]))
    return sorted(lines)


def test_one_rule_at_every_size():
    for size in (2, line_dedup.FEW, line_dedup.FEW + 1, 1500):
        lines = [f"Report filed by {''.join(chr(97 + (i // 26**k) % 26) for k in range(3))} has been closed and archived" for i in range(size)]
        (name, own), = line_dedup.templates(lines)
        assert name == "Report filed by <*> has been closed and archived" and sorted(own) == list(range(size))


@pytest.mark.parametrize("width", [4, 5, 6, 7, 9, 12, 14, 21, 30])
@pytest.mark.parametrize("size", [16, 300])
def test_leaf_against_plain_version(width, size):
    lines = leaf(width, size, width) if width > 5 else [f"one two three {x}" + " y" * (width - 4) for x in "abcdefghijklmnop"]
    keys = line_dedup.line_keys(lines) if line_dedup.plan(width)[1] else None
    for made in (None, keys):
        assert {frozenset(own) for _, own in line_dedup.templates(lines, made)} == plain(lines)


@pytest.mark.parametrize("block", [50, 200, 20_000])
def test_leaf_that_does_not_shrink(spark, block):
    """Most lines are like no other; those that are lose none of their links in blocks."""
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    lines = [" ".join(["the", "same", "lead", *[word() for _ in range(9)]]) for _ in range(600)]
    for _ in range(100):
        w = ["the", "same", "lead", *[word() for _ in range(9)]]
        lines += [" ".join(w), " ".join([*w[:5], word(), *w[6:]]), " ".join([*w[:5], word(), *w[6:9], word(), *w[10:]])]
    order = rng.sample(range(900), 900)
    docs = spark.createDataFrame([(i, lines[k]) for i, k in enumerate(order)], "doc_id long, text string")
    gone = {order[r["doc_id"]] for r in line_dedup.dropped(docs, block_lines=block).collect()}
    assert len(gone) == 200 and all(k >= 600 for k in gone)


def test_rows_of_numbers_stay(spark):
    """Lines that are mostly numbers are compared by their own text; others generalise them."""
    numbers = ["12 7 2019", "5 88 1.3", "0 0 4", "77 1 9", "row 1 2 3", "row 4 5 6", "row 7 8 9", *[" ".join(str(i * k) for k in range(12)) for i in range(1, 5)]]
    rows = list(enumerate(numbers)) + [(50 + i, f"Page {i} of 40") for i in range(4)] + [(60 + i, "1 2 3 4") for i in range(3)]
    got = {r["doc_id"]: r["text"] for r in line_dedup.drop_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == dict(rows) | {51: "", 52: "", 53: "", 61: "", 62: ""}


def test_two_documents_suffice_for_long_lines(spark):
    word = lambda at: " ".join(f"{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(at, at + 60))
    long, edited = word(0), word(0).replace("bz", "other")
    twenty, nineteen = " ".join(word(200).split(" ")[:20]), " ".join(word(300).split(" ")[:19])
    rows = [(1, f"{long}\nown line of one"), (2, f"own line of two\n{edited}"), (3, twenty), (4, twenty), (5, nineteen), (6, nineteen), (7, f"{word(100)}\n{word(100)}")]
    got = {r["doc_id"]: r["text"] for r in line_dedup.drop_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == dict(rows) | {2: "own line of two", 4: ""}


def test_scraps_of_copies_go(spark):
    import corpus_pipeline

    copy = "\n".join(f"this paragraph of kind {k} stands in every copy" for k in ("one", "two", "six"))
    listed, unspaced = "\n".join(f"entry{chr(97 + i % 26)} {i}" for i in range(60)), "字" * 300
    rest = {1: "Haanth.", 2: "Haanth.", 3: "\n\n", 4: "　\n   \n\t", 5: "     ", 6: listed, 7: unspaced, 8: "but this line is its own"}
    rows = [(d, f"{copy}\n{t}") for d, t in rest.items()] + [(20, "Haanth."), (21, ""), (22, " "), (23, None)]
    kept = corpus_pipeline.lines(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    got = {r["doc_id"]: r["text"] for r in kept.collect()}
    assert got == {1: rows[0][1], 6: listed, 7: unspaced, 8: rest[8], 20: "Haanth.", 21: "", 22: " ", 23: None}
