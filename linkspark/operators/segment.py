"""Descriptions taken apart at boilerplate, and relations found in fields."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Collection, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as tx

SEGMENT = "array<struct<segment:string,label:string>>"


def openings(phrases: Collection[str]) -> dict[str, list[int]]:
    """By first word of phrases: the numbers of words that they have, the greatest first."""
    out: dict[str, set[int]] = {}
    for p in phrases:
        out.setdefault(p.partition(" ")[0], set()).add(p.count(" ") + 1)
    return {w: sorted(sizes, reverse=True) for w, sizes in out.items()}


def cover(tokens: list[str], phrases: Collection[str], opened: dict[str, list[int]], covered: list[bool], most: int = 4, skip_covered: bool = False) -> list[tuple[int, int, str]]:
    """Greedy longest matches of 2 to ``most`` tokens, left to right: (start, end, phrase). A match may run over
    tokens that are covered already; with skip_covered it may not start at one. opened: the phrases' ``openings``."""
    out, i, size = [], 0, len(tokens)
    while i < size:
        hit = 0
        if (sizes := opened.get(tokens[i])) and not (skip_covered and covered[i]):
            for n in sizes:
                if 2 <= n <= most and n <= size - i and (phrase := " ".join(tokens[i : i + n])) in phrases:
                    covered[i : i + n] = [True] * n
                    out.append((i, i + n, phrase))
                    hit = n
                    break
        i += hit or 1
    return out


def segments(texts: list[str], spans: list[list[tuple[int, int]]], signals: dict[str, str | None], boilerplate: set[str], seen: set[str], most_chars: int, least_tokens: int) -> list[dict]:
    """Runs of uncovered tokens of each text, with the label of the nearest signal before them, else after them."""
    out: list[dict] = []
    seen = set(seen)
    first, plain = openings(signals), openings(boilerplate)
    for text, found in zip(texts, spans, strict=True):
        words = [text[a:b] for a, b in found]
        covered = [False] * len(found)
        hits = cover([w.lower() for w in words], signals, first, covered)
        cover(words, boilerplate, plain, covered, skip_covered=True)
        labels = {s: signals[p] for s, _, p in hits}
        places = list(labels)  # ascending
        i = 0
        while i < len(found):
            if covered[i]:
                i += 1
                continue
            j = i
            while j < len(found) and not covered[j]:
                j += 1
            start = found[i - 1][1] if i else 0
            end = found[j][0] if j < len(found) else len(text)
            part = text[start:end].strip()
            if part and len(part) <= most_chars and part not in seen and j - i >= least_tokens:
                seen.add(part)
                before, after = bisect_left(places, i), bisect_left(places, j)
                out.append({"segment": part, "label": labels[places[before - 1]] if before else labels[places[after]] if after < len(places) else None})
            i = j
    return out


def segment(descriptions: Column, titles: Column, signals: dict[str, str | None] | None = None, boilerplate: set[str] | None = None, most_chars: int = 250, least_tokens: int = 1) -> Column:
    """Candidate strings of a record's descriptions, as array<struct<segment, label>>. Without phrases, whole
    descriptions that are short enough and not among the titles."""
    if not signals and not boilerplate:
        fit = F.filter(descriptions, lambda d: (F.length(d) <= most_chars) & (F.trim(d) != ""))
        return F.transform(F.array_except(fit, F.coalesce(titles, F.array().cast("array<string>"))), lambda d: F.struct(d.alias("segment"), F.lit(None).cast("string").alias("label")))
    signals, boilerplate = dict(signals or {}), set(boilerplate or ())

    @F.arrow_udf(SEGMENT)
    def run(texts: pa.Array, low: pa.Array, known: pa.Array) -> pa.Array:
        return pa.array((segments(t, _spans(w), signals, boilerplate, set(k), most_chars, least_tokens) for t, w, k in _rows(texts, low, known)), _KIND)

    return run(descriptions, _lower(descriptions), titles)


_KIND = pa.list_(pa.struct([("segment", pa.string()), ("label", pa.string())]))


def _lower(descriptions: Column) -> Column:
    return F.transform(descriptions, F.lower)


def _spans(low: list[str]) -> list[list[tuple[int, int]]]:
    return [tx.spans_in(t) for t in low]


def _rows(*columns: pa.Array) -> Iterator[tuple]:
    """Rows of lists, one at a time: a batch may have many long texts. Null is an empty list."""
    return (tuple(c[i].as_py() or [] for c in columns) for i in range(len(columns[0])))


#: Characters of the terms that one automaton holds; larger sets are searched in as many passes as they need.
TERM_CHARS = 2_000_000


def _present(words: list[str], wanted: Collection[str], opened: dict[str, list[int]], most: int = 4) -> set[str]:
    return {p for i, w in enumerate(words) for n in opened.get(w, ()) if 2 <= n <= most and n <= len(words) - i and (p := " ".join(words[i : i + n])) in wanted}


def segment_by_sets(rows: DataFrame, key: str, descriptions: str, titles: str, phrases: DataFrame, most_chars: int = 250, least_tokens: int = 1, phrase_chars: int = TERM_CHARS) -> DataFrame:
    """rows with ``segments`` as ``segment`` has them, for sets of phrases of any size: (ngram, signal_type), null for
    boilerplate. key is unique and not null.

    The phrases are dealt into blocks of ``phrase_chars`` characters on average, and a pass over the texts for each block
    tells which of them a record has; those are fewer than its own n-grams, and with them each record is taken apart by
    itself. No phrase is left out, and no result depends on the blocks. A signal of several types has the least one."""
    kinds = phrases.where("ngram IS NOT NULL AND ngram != ''").groupBy("ngram", F.col("signal_type").isNull().alias("plain")).agg(F.min("signal_type").alias("type"))
    total = kinds.agg(F.sum(F.length("ngram"))).first()[0] or 0
    if not total:
        return rows.withColumn("segments", segment(F.col(descriptions), F.col(titles), most_chars=most_chars))
    passes = -(-total // phrase_chars)
    spanned = rows.select(F.col(key).alias("key"), F.col(descriptions).alias("texts"), _lower(F.col(descriptions)).alias("low"))
    kind = T.StructType([T.StructField("key", rows.schema[key].dataType), T.StructField("signals", T.MapType(T.StringType(), T.StringType())), T.StructField("plain", T.ArrayType(T.StringType()))])

    def matches(k: int) -> DataFrame:
        own = kinds.where(F.pmod(F.xxhash64("ngram"), F.lit(passes)) == k).select("ngram", "plain", "type").collect()  # a block
        held = rows.sparkSession.sparkContext.broadcast(({r[0]: r[2] for r in own if not r[1]}, {r[0] for r in own if r[1]}))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            signals, plain = held.value
            first, other = openings(signals), openings(plain)
            for b in batches:
                hits = []
                for texts, low in _rows(b.column(1), b.column(2)):
                    words = [[t[i:j] for i, j in found] for t, found in zip(texts, _spans(low))]
                    hits.append((set().union(*[_present([x.lower() for x in w], signals, first) for w in words]), set().union(*[_present(w, plain, other) for w in words])))
                some = [i for i, h in enumerate(hits) if h[0] or h[1]]
                typed = pa.array([[(p, signals[p]) for p in sorted(hits[i][0])] for i in some], pa.map_(pa.string(), pa.string()))
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(some, pa.int64())), typed, pa.array([sorted(hits[i][1]) for i in some], pa.list_(pa.string()))], kind.names)

        return spanned.mapInArrow(run, kind)

    found = matches(0)
    for k in range(1, passes):
        found = found.unionByName(matches(k))
    own = found.groupBy(F.col("key").alias("__key")).agg(F.flatten(F.collect_list(F.map_entries("signals"))).alias("__signals"), F.flatten(F.collect_list("plain")).alias("__plain"))
    known = rows.join(own, F.col(key) == F.col("__key"), "left").drop("__key")

    @F.arrow_udf(SEGMENT)
    def run(texts: pa.Array, low: pa.Array, known: pa.Array, signals: pa.Array, plain: pa.Array) -> pa.Array:
        return pa.array((segments(t, _spans(w), {x["key"]: x["value"] for x in g}, set(p), set(k), most_chars, least_tokens) for t, w, k, g, p in _rows(texts, low, known, signals, plain)), _KIND)

    return known.withColumn("segments", run(F.col(descriptions), _lower(F.col(descriptions)), F.col(titles), F.col("__signals"), F.col("__plain"))).drop("__signals", "__plain")


def automaton(terms: list[str]) -> ahocorasick.Automaton:
    """Goto and failure links of the terms; a match gives the term."""
    made = ahocorasick.Automaton()
    for t in terms:
        made.add_word(t, t)
    if terms:
        made.make_automaton()
    return made


def places(text: str, found: ahocorasick.Automaton) -> list[tuple[str, int]]:
    """(term, at) of every term, each taken from the left without overlaps of its own."""
    free: dict[str, int] = {}
    out = []
    for end, term in found.iter(text) if len(found) else ():
        at = end - len(term) + 1
        if at >= free.get(term, 0):
            free[term] = end + 1
            out.append((term, at))
    return out


def relations(elements: DataFrame, terms: DataFrame, before: int = 40, after: int = 80, term_chars: int = TERM_CHARS) -> DataFrame:
    """rec, field, relation_type, term, at, context: all non-overlapping places of a term, without case. elements:
    (rec, field, text); terms: (relation_type, term, field), field null for any. A text is read once for all terms of a pass."""
    small = terms.where("term IS NOT NULL AND term != ''").select("relation_type", "term", F.lower("term").alias("low"), F.col("field").alias("only"))
    total = small.agg(F.sum(F.length("low"))).first()[0] or 0
    passes = max(1, -(-total // term_chars))
    kind = T.StructType([*[elements.schema[c] for c in ("rec", "field", "text")], T.StructField("low", T.StringType()), T.StructField("at", T.IntegerType())])

    def matches(k: int) -> DataFrame:
        # As many characters as term_chars on average: bounded, whatever the number of terms.
        own = [r[0] for r in small.where(F.pmod(F.xxhash64("low"), F.lit(passes)) == k).select("low").distinct().collect()]
        held = elements.sparkSession.sparkContext.broadcast(own)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = automaton(held.value)
            for batch in batches:
                hits = [(i, *hit) for i, text in enumerate(batch.column(3).to_pylist()) if text for hit in places(text, found)]
                rows = batch.take(pa.array([h[0] for h in hits], pa.int64()))
                yield pa.RecordBatch.from_arrays([*rows.columns[:3], pa.array([h[1] for h in hits], pa.string()), pa.array([h[2] for h in hits], pa.int32())], kind.names)

        return elements.select("rec", "field", "text", F.lower("text")).mapInArrow(run, kind)

    found = matches(0)
    for k in range(1, passes):
        found = found.unionByName(matches(k))
    fit = found.join(small, "low").where(F.col("only").isNull() | (F.col("only") == F.col("field")))
    start = F.greatest(F.col("at") - before, F.lit(0))
    return fit.select("rec", "field", "relation_type", "term", "at", F.trim(F.substr("text", start + 1, F.col("at") + F.length("term") + after - start)).alias("context"))
