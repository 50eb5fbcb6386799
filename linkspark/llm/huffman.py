"""Length-limited canonical Huffman coding of integer symbols, over whole numpy arrays."""

from __future__ import annotations

import numpy as np

#: Bits of a code at most, or two more than it takes to number the symbols that occur, if that is more.
LIMIT = 16
#: A decoder looks at 32 bits, of which up to 7 lie before the code.
MOST = 25
BLOCK = 4096
#: Ids that are worked on at once.
SLICE = 1 << 19


def code_lengths(counts: np.ndarray, limit: int | None = None) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits by package-merge; 0 for symbols that don't occur."""
    out = np.zeros(len(counts), np.uint8)
    used = np.flatnonzero(counts)
    n = len(used)
    if n == 0:
        return out
    if n == 1:
        out[used] = 1
        return out
    limit = limit or min(MOST, max(LIMIT, (n - 1).bit_length() + 2))
    if n > 1 << limit or limit > MOST:
        raise ValueError(f"{n} symbols don't fit in codes of {limit} bits, or these in a decoder of {MOST}")
    order = used[np.argsort(counts[used], kind="stable")]
    weights = counts[order].astype(np.int64)
    row, leaves = weights, [np.ones(n, bool)]
    for _ in range(limit - 1):
        pairs = len(row) // 2
        both = np.concatenate((weights, row[0 : 2 * pairs : 2] + row[1 : 2 * pairs : 2]))
        by = np.argsort(both, kind="stable")
        row = both[by]
        leaves.append(by < n)
    lengths, take = np.zeros(n, np.int64), 2 * n - 2
    for leaf in reversed(leaves):
        own = int(leaf[:take].sum())
        lengths[:own] += 1
        take = 2 * (take - own)
    out[order] = lengths
    return out


def canonical(lengths: np.ndarray) -> np.ndarray:
    """The code of each symbol: codes of one length are consecutive, in order of the symbols."""
    codes, code, last = np.zeros(len(lengths), np.uint32), 0, 0
    used = np.flatnonzero(lengths)
    for length in range(1, int(lengths.max(initial=0)) + 1):
        own = used[lengths[used] == length]
        code <<= length - last
        last = length
        codes[own] = code + np.arange(len(own))
        code += len(own)
    return codes


def encode(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray, block: int = BLOCK) -> tuple[bytes, np.ndarray]:
    """The bit stream of ids, and the bit offset at which each block of ``block`` ids begins."""
    if not len(ids):
        return b"", np.zeros(0, np.uint64)
    total = sum(int(lengths[ids[a : a + SLICE]].sum(dtype=np.int64)) for a in range(0, len(ids), SLICE))
    words, points, at_bit = np.zeros((total + 63) // 32 + 1, np.uint32), [], 0
    for a in range(0, len(ids), SLICE):
        part = ids[a : a + SLICE]
        n_bits = lengths[part].astype(np.int64)
        ends = np.cumsum(n_bits) + at_bit
        begin = ends - n_bits
        at_bit = int(ends[-1])
        points.append(begin[(-a) % block :: block].astype(np.uint64))
        at, shift = begin >> 5, (begin & 31).astype(np.uint64)
        value = codes[part].astype(np.uint64) << (np.uint64(64) - n_bits.astype(np.uint64) - shift)
        first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        both = np.add.reduceat(value, first)  # bits don't overlap, so a sum is an OR
        words[at[first]] |= (both >> np.uint64(32)).astype(np.uint32)
        words[at[first] + 1] |= (both & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    return words.astype(">u4").tobytes()[: (total + 7) // 8], np.concatenate(points)


def table(lengths: np.ndarray) -> tuple[np.ndarray, int]:
    """Decoding table over the next ``width`` bits: symbol * 32 + code length."""
    width = int(lengths.max(initial=1))
    out = np.zeros(1 << width, np.int64)
    codes = canonical(lengths)
    used = np.flatnonzero(lengths)
    span = np.left_shift(1, width - lengths[used].astype(np.int64))
    first = codes[used].astype(np.int64) << (width - lengths[used].astype(np.int64))
    places = np.repeat(first - np.concatenate(([0], np.cumsum(span)[:-1])), span) + np.arange(span.sum())
    out[places] = np.repeat(used * 32 + lengths[used], span)
    return out, width


def decode(stream: bytes, checkpoints: np.ndarray, n: int, lengths: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """The n ids of a stream. Blocks are independent: all are decoded side by side, one id of each at a time."""
    out = np.zeros((len(checkpoints), block), np.int32)
    if not n:
        return out.ravel()[:0]
    entries, width = table(lengths)
    raw = np.frombuffer(stream + b"\0" * 4, np.uint8)
    window = raw[:-3].astype(np.uint32)  # 32 bits from each byte on
    for part in (raw[1:-2], raw[2:-1], raw[3:]):
        window <<= np.uint32(8)
        window |= part
    at, mask, most = checkpoints.astype(np.int64), np.uint32((1 << width) - 1), 32 - width
    last = n - (len(checkpoints) - 1) * block  # ids in the last block
    for k in range(min(block, n)):
        if k == last:
            at = at[:-1]
        entry = entries[(window[at >> 3] >> (most - (at & 7)).astype(np.uint32)) & mask]
        out[: len(at), k] = entry >> 5
        at = at + (entry & 31)
    return out.ravel()[:n]
