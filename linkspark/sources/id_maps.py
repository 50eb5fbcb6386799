"""A large JSON store, ``{"_meta": ..., name: {id: record, ...}}``, read by several tasks.

Spark cuts the file at closing braces, which its text reader does by byte ranges. What a range's first brace means
depends on everything before it, so there are three passes over ranges, each with one small row a range for the next:

1. Whether a range begins within a string, and at which depth, is unknown; so each is scanned under both assumptions, and
   tells for either where it ends. Chained together, that gives the state at the beginning of each range.
2. With it, a range tells the last section (a key of the outermost object) that begins in it.
3. Now each range cuts its records. What stands before the first border and after the last belongs to records that cross
   ranges; those pieces, two a range at most, are put together by their order.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

_REST = re.compile(r'(?:[^"\\]|\\.)*', re.S)
_NEXT = re.compile(r'["{}\[\]]')


def advance(text: str, in_string: bool, depth: int) -> tuple[bool, int]:
    """The state after text: within a string or not, and how many brackets are open."""
    at = 0
    while True:
        if in_string:
            at = _REST.match(text, at).end()
            if at >= len(text):
                return True, depth
            at, in_string = at + 1, False
        m = _NEXT.search(text, at)
        if m is None:
            return False, depth
        at = m.end()
        c = m.group()
        in_string = c == '"'
        depth += 0 if in_string else 1 if c in "{[" else -1


class Cutter:
    """Cuts a range's text into pieces of the records of one section, given the state at its beginning."""

    def __init__(self, wanted: str, in_string: bool, depth: int, section: str | None):
        self.wanted, self.in_string, self.depth, self.section = wanted, in_string, depth, section
        self.piece: list[str] = []  # of the record that is open; it began in this range if whole
        self.whole, self.key = False, ""
        self.string: list[str] = []  # of the string that is open
        self.head: str | None = None  # what this range has of a record that began before it
        self.done: list[str] = []
        self.open_before = depth >= 2 and section == wanted and (depth > 2 or in_string)

    def feed(self, text: str) -> None:
        at = 0
        while at < len(text):
            if self.in_string:
                end = _REST.match(text, at).end()
                self._take(text[at:end], True)
                if end >= len(text):
                    return
                self._take('"', True)
                if self.depth == 1:
                    self.key = json.loads('"' + "".join(self.string)[:-1].removeprefix('"') + '"') if self.string and self.string[0] == '"' else self.key
                self.string = []
                at, self.in_string = end + 1, False
                continue
            m = _NEXT.search(text, at)
            if m is None:
                self._take(text[at:], False)
                return
            self._take(text[at : m.start()], False)
            at, c = m.end(), m.group()
            if c == '"':
                self.in_string = True
                self._take(c, True)
                continue
            if c in "{[":
                self.depth += 1
                if self.depth == 2:
                    self.section = self.key if c == "{" else ""
                    continue
                self._take(c, False)
            elif self.depth == 2:  # the section ends
                self.depth, self.section, self.piece, self.whole = 1, "", [], False
            else:
                self._take(c, False)
                self.depth -= 1
                if self.depth == 2:
                    self._border()

    def _take(self, part: str, string: bool) -> None:
        if string:
            self.string.append(part)
        if self.section == self.wanted and self.depth >= 2:
            if not self.piece and not self.open_before and not self.whole:
                part = part.lstrip(" \t\r\n,") if not string else part
                self.whole = bool(part)
            if part:
                self.piece.append(part)

    def _border(self) -> None:
        """A record ends here."""
        if self.section != self.wanted:
            return
        text = "".join(self.piece)
        if self.open_before:
            self.head = text
        else:
            self.done.append(text)
        self.piece, self.whole, self.open_before = [], False, False


def _record(text: str) -> tuple[str, str]:
    """id and JSON of ``"id": {...}``."""
    name, end = json.JSONDecoder().raw_decode(text.strip())
    return name, text.strip()[end:].lstrip().removeprefix(":").strip()


def id_map(spark: SparkSession, path: str, name: str, kind: T.StructType) -> DataFrame:
    """id and the fields of each record of the section ``name``."""
    lines = spark.read.option("lineSep", "}").text(path)
    rows = lines.select(F.concat("_metadata.file_path", F.lit("\n"), F.lpad(F.col("_metadata.file_block_start").cast("string"), 20, "0")).alias("range"), F.concat("value", F.lit("}")).alias("text"))

    def by_range(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, str]]:
        for b in batches:
            yield from zip(b.column(0).to_pylist(), b.column(1).to_pylist())

    def states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: dict[str, list[tuple[bool, int]]] = {}
        for r, text in by_range(batches):
            now[r] = [advance(text, *s) for s in now.get(r, [(False, 0), (True, 0)])]
        yield pa.RecordBatch.from_pydict({"range": pa.array(now, pa.string()), "ends": pa.array([[x for s in v for x in (int(s[0]), s[1])] for v in now.values()], pa.list_(pa.int64()))})

    begins: dict[str, tuple[bool, int]] = {}
    state, before = (False, 0), None
    for r in sorted(rows.mapInArrow(states, "range string, ends array<long>").collect(), key=lambda r: r["range"]):
        file = r["range"].split("\n")[0]
        state, before = state if file == before else (False, 0), file
        begins[r["range"]] = state
        k = 2 * int(state[0])
        state = bool(r["ends"][k]), state[1] + r["ends"][k + 1]

    def sections(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: dict[str, Cutter] = {}
        for r, text in by_range(batches):
            now.setdefault(r, Cutter("", *begins[r], None)).feed(text)
        yield pa.RecordBatch.from_pydict({"range": pa.array(now, pa.string()), "section": pa.array([c.section for c in now.values()], pa.string())})

    section, inside, before = None, {}, None
    for r in sorted(rows.mapInArrow(sections, "range string, section string").collect(), key=lambda r: r["range"]):
        file = r["range"].split("\n")[0]
        section, before = section if file == before else None, file
        inside[r["range"]] = section
        section = r["section"] if r["section"] is not None else section

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "body", "range", "part"]
        pack = lambda got: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*got), (pa.string(), pa.string(), pa.string(), pa.int32()))], names)
        now: dict[str, Cutter] = {}
        for r, text in by_range(batches):
            c = now.setdefault(r, Cutter(name, *begins[r], inside[r]))
            c.feed(text)
            if len(c.done) >= 200:
                yield pack([(*_record(x), None, None) for x in c.done])
                c.done = []
        out = []
        for r, c in now.items():
            out += [(*_record(x), None, None) for x in c.done]
            out += [(None, c.head, r, 0)] if c.head is not None else []
            rest = "".join(c.piece)
            # A range that lies within one record has no border: its text goes on what is open.
            out += [(None, rest, r, 0 if c.open_before and c.head is None else 1)] if rest.strip(" \t\r\n,") else []
        if out:
            yield pack(out)

    pieces = rows.mapInArrow(cut, "id string, body string, range string, part int")
    whole = pieces.where("range IS NULL").select("id", "body")
    # Two rows a range at most; a record begins where a piece has the part 1.
    edges = pieces.where("range IS NOT NULL").withColumn("n", F.sum("part").over(Window.orderBy("range", "part")))
    joined = edges.groupBy("n").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("range", "part", "body"))), lambda x: x["body"]), "").alias("text"))
    halves = F.udf(_record, "struct<id:string,body:string>", useArrow=False)
    every = whole.union(joined.select(halves("text").alias("r")).select("r.id", "r.body"))
    return every.select("id", F.from_json("body", kind, {"mode": "FAILFAST"}).alias("r")).select("id", "r.*")
