"""Texts cut into the pieces of the byte-level pattern, and pieces into ids, a block of texts at a time.

The pattern (``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``) tiles a text, so its matches
are given by where they start. That follows from the runs of bytes whose characters are of one kind (letters, numbers,
white space, others), which are found for a whole block at once:

* a run that isn't white space starts a piece, or the one space before it does;
* a run of white space is a piece but for its last character, if something follows it in its text; the last character
  belongs to the next piece if it is a space, and else is a piece;
* after a lone apostrophe that starts a piece, s, t, m, d, re, ve or ll belongs to that piece, and what is left of
  the letters starts another.

Each distinct piece of a block is encoded once, and a worker remembers pieces from block to block. A text longer than
a block is taken apart where the pattern begins a new match in any case: before a single space between ASCII letters.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa

#: Bytes of text in a block; a longer one is taken only where a text can't be taken apart.
BLOCK_BYTES = 4 << 20
#: After so many pieces (or that many of the given length in bytes) a worker forgets what it remembers.
PIECES, USUAL = 250_000, 16
OTHER, LETTER, NUMBER, SPACE = range(4)
_JOINT = re.compile(rb"(?<=[A-Za-z]) (?=[A-Za-z])")


@lru_cache(maxsize=1)
def kinds() -> np.ndarray:
    """The kind of every code point."""
    import regex

    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    every, place = "".join(points), np.array([c for c in range(0x110000) if not 0xD800 <= c < 0xE000])
    out = np.zeros(0x110000, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for m in regex.finditer(pattern, every):
            out[place[m.start() : m.end()]] = kind
    return out


def _kind_of_bytes(data: np.ndarray) -> np.ndarray:
    """For each byte of UTF-8, the kind of its character."""
    table = kinds()
    out = table[:256][data]
    lead = np.flatnonzero(data >= 0xC0)
    if len(lead):
        first = data[lead].astype(np.int64)
        for size, low, high, mask in ((2, 0xC0, 0xE0, 0x1F), (3, 0xE0, 0xF0, 0x0F), (4, 0xF0, 0x100, 0x07)):
            own = (first >= low) & (first < high)
            at, point = lead[own], first[own] & mask
            for i in range(1, size):
                point = point << 6 | (data[at + i] & 0x3F)
            for i in range(size):
                out[at + i] = table[point]
    return out


def starts(data: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Where the pieces of texts start. data: the texts' bytes, one after the other; begins: where each that isn't
    empty begins, in order."""
    if not len(data):
        return np.zeros(0, np.int64)
    kind = _kind_of_bytes(data)
    new = np.empty(len(data), bool)
    new[0] = True
    np.not_equal(kind[1:], kind[:-1], out=new[1:])
    new[begins] = True
    run = np.flatnonzero(new)
    head = np.zeros(len(run) + 1, bool)  # runs that begin a text, and the end
    head[np.searchsorted(run, begins)] = True
    head[-1] = True
    end = np.append(run[1:], len(data))
    kind = kind[run]
    inner = (kind == SPACE) & ~head[1:]  # white space with something after it in its text
    last = end - 1
    for _ in range(3):  # back to the first byte of the last character
        last = np.where(inner & (data[last] & 0xC0 == 0x80), last - 1, last)
    joins = inner & (data[last] == 0x20)
    after = np.append(False, joins[:-1])  # runs to which the space before them belongs
    out = np.zeros(len(data) + 1, bool)
    out[run[(kind != SPACE) & ~after]] = True
    out[run[(kind == SPACE) & (~inner | (last > run))]] = True
    out[last[inner]] = True
    quote = np.flatnonzero((kind[:-1] == OTHER) & (data[run[:-1]] == 0x27) & (end[:-1] - run[:-1] == 1) & (kind[1:] == LETTER) & ~head[1:-1] & ~after[:-1]) if len(run) > 1 else np.zeros(0, np.int64)
    if len(quote):
        at, stop = run[quote] + 1, end[quote + 1]
        one = np.isin(data[at], np.frombuffer(b"stmd", np.uint8))
        second = data[np.minimum(at + 1, len(data) - 1)]
        two = (stop - at > 1) & (((data[at] == 0x72) | (data[at] == 0x76)) & (second == 0x65) | (data[at] == 0x6C) & (second == 0x6C))
        size = np.where(one, 1, np.where(two, 2, 0))
        held = size > 0
        out[at[held]] = False
        rest = (at + size)[held & (at + size < stop)]
        out[rest] = True
    return np.flatnonzero(out[:-1])


def packed(offsets: np.ndarray, data: pa.Buffer) -> pa.Array:
    """A binary array of consecutive parts of data."""
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), data])


class Encoder:
    """Ids of texts. encode: from distinct pieces (bytes) to their ids, one after the other, and how many each has."""

    def __init__(self, encode: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], limit: int = PIECES):
        self.encode, self.limit = encode, limit
        self.forget()

    def forget(self) -> None:
        self.number: dict[bytes, int] = {}
        self.ids, self.ends, self.chars = np.zeros(0, "<u4"), np.zeros(1, np.int64), 0

    def block(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, pa.Buffer]:
        """Packed ids of the texts that lie between the offsets: their own offsets in bytes, and the bytes."""
        begins = offsets[:-1]
        at = starts(data, begins[begins < offsets[1:]])
        if not len(at):
            return np.zeros(len(offsets), np.int64), pa.py_buffer(b"")
        if len(self.number) > self.limit or self.chars > self.limit * USUAL:
            self.forget()
        pieces = packed(np.append(at, len(data)), pa.py_buffer(data)).dictionary_encode()
        distinct = pieces.dictionary.to_pylist()
        row = np.fromiter(map(self.number.get, distinct, repeat(-1)), np.int64, len(distinct))
        lacking = np.flatnonzero(row < 0)
        if len(lacking):
            new = [distinct[i] for i in lacking.tolist()] if len(lacking) < len(distinct) else distinct
            ids, sizes = self.encode(new)
            first = len(self.ends) - 1
            row[lacking] = np.arange(first, first + len(new))
            self.ids, self.ends = np.concatenate((self.ids, ids)), np.concatenate((self.ends, self.ends[-1] + np.cumsum(sizes)))
            self.number.update(zip(new, range(first, first + len(new)), strict=True))
            self.chars += sum(map(len, new))
        out = packed(4 * self.ends, pa.py_buffer(self.ids)).take(pa.array(row[pieces.indices.to_numpy()]))
        ends = np.frombuffer(out.buffers()[1], np.int32)[: len(out) + 1].astype(np.int64)
        return ends[np.searchsorted(at, offsets)], out.buffers()[2] or pa.py_buffer(b"")

    def texts(self, texts: pa.Array) -> pa.Array:
        """The packed ids of each text; of a null, those of an empty text."""
        data, offsets = bytes_of(texts)
        out, i = [pa.array([], pa.binary())], 0
        while i < len(texts):
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + BLOCK_BYTES, "right")) - 1)
            own = data[offsets[i] : offsets[j]]
            if len(own) <= BLOCK_BYTES:
                out.append(packed(*self.block(own, offsets[i : j + 1] - offsets[i])))
            else:  # one long text
                out.append(pa.array([b"".join(self.block(x, np.array([0, len(x)]))[1] for x in parts(own))], pa.binary()))
            i = j
        return pa.concat_arrays(out)


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an array of strings, and the offset at which each begins, with the end."""
    texts = texts.fill_null("").cast(pa.binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    held = texts.buffers()[2]
    data = np.frombuffer(held, np.uint8) if held and held.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def parts(data: np.ndarray, most: int | None = None) -> Iterator[np.ndarray]:
    """A long text, taken apart where a new match begins in any case."""
    at, view, most = 0, memoryview(data), most or BLOCK_BYTES
    while len(data) - at > most and (joint := _JOINT.search(view, at + most)):
        yield data[at : joint.start()]
        at = joint.start()
    yield data[at:]
