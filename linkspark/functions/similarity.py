"""String similarity: Indel ratios on 0..100 and the token-set ratio built from them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def lcs_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, a row of the table at a time as the bits of one integer."""
    if not a or not b:
        return 0
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & places.get(c, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def _codes(texts: list[str]) -> np.ndarray:
    """Code points of texts, a row each, filled up with zeros. A zero that is a text's own is told apart by its length."""
    width = max(map(len, texts), default=0)
    return np.frombuffer("".join(t.ljust(width, "\0") for t in texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).reshape(len(texts), width)


def lcs_lengths(a: list[str], b: list[str], chunk: int = 2048) -> np.ndarray:
    """lcs_length of each pair. Pairs whose shorter text has up to 64 characters go side by side: the row of each is
    one 64-bit number, and a step takes the next character of all. Longer ones take Python's integers, one by one."""
    out = np.zeros(len(a), dtype=np.int64)
    pairs = [(x, y) if len(x) <= len(y) else (y, x) for x, y in zip(a, b)]
    small = [i for i, (x, _) in enumerate(pairs) if 0 < len(x) <= 64]
    small.sort(key=lambda i: len(pairs[i][1]))  # steps of a chunk are those of its longest text
    for k in range(0, len(small), chunk):
        at = np.array(small[k : k + chunk])
        short, long = _codes([pairs[i][0] for i in at]), _codes([pairs[i][1] for i in at])
        size, steps = np.array([len(pairs[i][0]) for i in at]), np.array([len(pairs[i][1]) for i in at])
        known = np.unique(short)  # each character by its number; one that no short text has gets the number 0, without places
        letters = len(known) + 1
        number = lambda codes: np.where(known[np.minimum(np.searchsorted(known, codes), len(known) - 1)] == codes, np.searchsorted(known, codes) + 1, 0)
        base = np.arange(len(at), dtype=np.int64) * letters
        places = np.zeros(len(at) * letters, dtype=np.uint64)  # by pair and character: where the short text has it
        mine, other = number(short) + base[:, None], np.ascontiguousarray((number(long) + base[:, None]).T)
        for j in range(short.shape[1]):
            there = size > j
            places[mine[there, j]] |= np.uint64(1) << np.uint64(j)
        full = ~np.uint64(0) >> (64 - size).astype(np.uint64)
        row = full.copy()
        for j, live in enumerate(np.searchsorted(steps, np.arange(long.shape[1]), side="right")):
            own = row[live:]
            hit = own & places[other[j, live:]]
            row[live:] = (own + hit | own - hit) & full[live:]
        out[at] = size - np.bitwise_count(row)
    for i, (x, y) in enumerate(pairs):
        if len(x) > 64:
            out[i] = lcs_length(x, y)
    return out


def lcs(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence, by batches of pairs."""

    @F.pandas_udf("int")
    def kernel(x: pd.Series, y: pd.Series) -> pd.Series:
        there = (x.notna() & y.notna()).to_numpy()
        out = pd.Series(pd.NA, index=x.index, dtype="Int32")
        out[there] = lcs_lengths(x[there].tolist(), y[there].tolist())
        return out

    return kernel(a, b)


def window_lcs(short: str, long: str, batch: int = 256) -> int:
    """The greatest lcs_length of short and any window of long as long as short is. A window shares no more characters
    with short than their counts allow; windows go by that bound, until none that is left can beat the best."""
    m, places = len(short), len(long) - len(short) + 1
    if m == 0:
        return 0
    if short in long:
        return m
    codes, own = np.array([ord(c) for c in long]), {}
    for c in short:
        own[c] = own.get(c, 0) + 1
    bound = np.zeros(places, dtype=np.int64)
    for c, n in own.items():
        sums = np.r_[0, np.cumsum(codes == ord(c))]
        bound += np.minimum(sums[m:] - sums[:places], n)
    best, order = 0, np.argsort(-bound, kind="stable")
    for k in range(0, places, batch):
        at = [int(i) for i in order[k : k + batch] if bound[i] > best]
        if not at:
            break
        best = max(best, int(lcs_lengths([short] * len(at), [long[i : i + m] for i in at]).max()))
    return best


def partial_ratio(a: Column, b: Column) -> Column:
    """The best ratio of the shorter text and a window of the longer that is as long: round(100 LCS / length), half to
    even; 0 if either is empty. Of texts of one length it is their ratio."""

    @F.pandas_udf("int")
    def kernel(x: pd.Series, y: pd.Series) -> pd.Series:
        made = [pd.NA if not isinstance(p, str) or not isinstance(q, str) else window_lcs(*sorted((p, q), key=len)) for p, q in zip(x, y)]
        return pd.Series(made, index=x.index, dtype="Int32")

    m = F.least(F.length(a), F.length(b))
    return F.when(m == 0, 0).when(F.contains(a, b) | F.contains(b, a), 100).otherwise(F.rint(100 * kernel(a, b) / m).cast("int"))


def lcs_native(a: Column, b: Column) -> Column:
    """The same in built-in functions: a fold over a's characters, each of which folds a row over b's."""
    zero = F.transform(F.split(b, ""), lambda _: F.lit(0))

    def row(before: Column, c: Column) -> Column:
        cells = F.arrays_zip(F.split(b, "").alias("c"), before.alias("v"))
        start = F.struct(F.lit(0).alias("left"), F.lit(0).alias("corner"), F.array().cast("array<int>").alias("out"))

        def cell(acc: Column, x: Column) -> Column:
            v = F.when(x["c"] == c, acc["corner"] + 1).otherwise(F.greatest(acc["left"], x["v"]))
            return F.struct(v.alias("left"), x["v"].alias("corner"), F.concat(acc["out"], F.array(v)).alias("out"))

        return F.aggregate(cells, start, cell, lambda acc: acc["out"])

    last = F.aggregate(F.split(a, ""), zero, row)
    return F.when((F.length(a) == 0) | (F.length(b) == 0), 0).otherwise(F.coalesce(F.element_at(last, -1), F.lit(0)))


def ratio(a: Column, b: Column, kernel=lcs) -> Column:
    """round(100 * 2 LCS / (|a| + |b|)), half to even; 0 if either is empty."""
    total = F.length(a) + F.length(b)
    return F.when((F.length(a) == 0) | (F.length(b) == 0), 0).when(a == b, 100).otherwise(F.rint(200 * kernel(a, b) / total).cast("int"))


def processed(x: Column) -> Column:
    """Lower case, without U+0080..U+00FF, and with spaces for what isn't a letter, digit or underscore."""
    return F.trim(F.lower(F.regexp_replace(F.regexp_replace(x, "[\u0080-ÿ]", ""), r"(?U)\W", " ")))


def processed_tokens(x: Column) -> Column:
    """The distinct tokens of the processed text, in code point order."""
    return F.sort_array(F.array_distinct(F.filter(F.split(processed(x), r"\s+"), lambda t: t != "")))


def token_sort_ratio(a: Column, b: Column, kernel=lcs) -> Column:
    in_order = lambda x: F.array_join(F.sort_array(F.filter(F.split(processed(x), r"\s+"), lambda t: t != "")), " ")
    return ratio(in_order(a), in_order(b), kernel)


def set_parts(a: Column, b: Column) -> tuple[Column, Column, Column]:
    """From sorted distinct tokens: the common text, and both texts with the common tokens first."""
    common = F.array_join(F.sort_array(F.array_intersect(a, b)), " ")
    whole = lambda x, y: F.trim(F.concat_ws(" ", common, F.array_join(F.array_except(x, y), " ")))
    return common, whole(a, b), whole(b, a)


def token_set_ratio_of(a: Column, b: Column, kernel=lcs) -> Column:
    """Of sorted distinct tokens. The common text is a prefix of both, so two of the three ratios need no LCS."""
    common, x, y = set_parts(a, b)
    n = F.length(common)
    near = lambda z: F.when(n == 0, 0).otherwise(F.rint(200 * n / (n + F.length(z))).cast("int"))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0).otherwise(F.greatest(near(x), near(y), ratio(x, y, kernel)))


def token_set_ratio(a: Column, b: Column, kernel=lcs) -> Column:
    return token_set_ratio_of(processed_tokens(a), processed_tokens(b), kernel)


def set_scores(a: list[str], b: list[str], need: list[float]) -> np.ndarray:
    """token_set_ratio_of for texts of sorted distinct tokens, where it may reach need (a number for each pair); 0 where a
    bound shows that it can't. The common subsequence is taken only of pairs whose lengths leave it a chance."""
    out = [0] * len(a)
    xs, ys, at, floor, cache = [], [], [], [], {}
    for i, (p, q, least) in enumerate(zip(a, b, need)):
        if not p or not q:
            continue
        mine, other = cache.get(p), cache.get(q)
        if mine is None:
            toks = p.split(" ")
            mine = cache[p] = (toks, set(toks))
        if other is None:
            toks = q.split(" ")
            other = cache[q] = (toks, set(toks))
        both = mine[1] & other[1]
        np_, nq = len(p), len(q)
        short, total, near = min(np_, nq), np_ + nq, 0
        if both:
            common = " ".join(both) if len(both) < 2 else " ".join(sorted(both))
            n = len(common)
            near = out[i] = round(200 * n / (n + short))
        if near < 100 and 200 * short >= (max(least, near) - 1) * total:
            if not both:
                xs.append(p)
                ys.append(q)
                floor.append(0)
            else:
                # Common tokens lead both texts, so they are a part of some longest common subsequence.
                xs.append(" ".join([t for t in mine[0] if t not in both]))
                ys.append(" ".join([t for t in other[0] if t not in both]))
                floor.append(n)
            at.append(i)
    out = np.array(out, dtype=np.int64)
    if at:
        head, x, y = np.array(floor), np.array([len(t) for t in xs]), np.array([len(t) for t in ys])
        # After a common text of n characters, a blank follows in a text that has more; both have it or it is no part.
        blank = ((head > 0) & (x > 0) & (y > 0)).astype(np.int64)
        total = 2 * head + x + y + ((head > 0) & (x > 0)) + ((head > 0) & (y > 0))
        out[at] = np.maximum(out[at], np.rint(200 * (head + blank + lcs_lengths(xs, ys)) / total).astype(np.int64))
    return out


def set_score(a: Column, b: Column, need: Column) -> Column:
    """``set_scores`` of columns. It is called nondeterministic so that a filter by the score and the score itself don't
    work it out twice."""

    @F.pandas_udf("int")
    def kernel(x: pd.Series, y: pd.Series, least: pd.Series) -> pd.Series:
        return pd.Series(set_scores(x.tolist(), y.tolist(), least.tolist()))

    return kernel.asNondeterministic()(a, b, need)
