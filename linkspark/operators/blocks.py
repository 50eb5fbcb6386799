"""Pairs of short texts scored in blocks: as ``linkage.score_pairs`` scores them, but many at a time.

Equal texts are one class on either side, whose members travel with it as a list, so a pair of texts is scored once however many
rows have them. Classes meet by a key, a token that both have or what a pair has in common anyway; keys are dealt into tasks by the pairs
that they make, and a key of many rows is cut into pieces, each piece of one side meeting each of the other. A task thus
holds a bounded number of rows and of pairs, also where the job itself is quadratic.

Within a task all pairs of a key go through numpy side by side. A pair that shares its key's token only has one length of common
text and one boost for the whole key; its remaining texts can have no longer common subsequence than their characters and bigrams
allow, two 64-bit masks for each text (a bit of one that the other lacks stands for a character or bigram that isn't shared).
Only pairs which that leaves a chance have it taken, with a mask for each character of the left text. Pairs that share more tokens,
long texts and those whose tokens aren't the ratio's are scored one by one (``similarity.set_scores``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import LinkConfig
from ..functions import similarity as sim
from ..functions import text as tx
from . import linkage as lk

#: Members of a class in one row, members of a key in one piece, pairs of members that a task makes, and keys with pieces at most (those are broadcast).
SHARE, PIECE, TASK, HOT = 1000, 2000, 4_000_000, 65_536
#: Pairs of texts that are scored at a time, and numbers of a table of masks.
CHUNK, MASKS = 1 << 16, 1 << 22
#: Characters of texts that are compared side by side, and other tokens of such a text.
WIDE, OTHERS = 64, 4


class _Texts:
    """Remaining texts of one side: lengths, codes of characters, and masks of characters and bigrams."""

    def __init__(self, texts: list[str], known: np.ndarray, repeats: bool):
        self.size = np.array([len(t) for t in texts], dtype=np.int64)
        self.width = int(self.size.max(initial=0))
        flat = np.searchsorted(known, _points(texts))
        codes = np.full((len(texts), self.width + 1), len(known), dtype=np.int64)
        at = np.arange(len(flat)) - np.repeat(np.cumsum(self.size) - self.size, self.size)
        codes[np.repeat(np.arange(len(texts)), self.size), at] = flat
        self.codes = np.ascontiguousarray(codes.T)  # a row for each place
        self.chars, self.bigrams = np.zeros(len(texts), dtype=np.uint64), np.zeros(len(texts), dtype=np.uint64)
        blank = int(np.searchsorted(known, 32))
        bit = lambda x: np.uint64(1) << (x % 64).astype(np.uint64)
        held = np.zeros((len(known) + 1) * len(texts), dtype=np.int16) if repeats else None
        before, every = np.full(len(texts), blank, dtype=np.int64), np.arange(len(texts)) * (len(known) + 1)
        for j in range(self.width + 1):
            live, own = self.size > j, self.codes[j]
            there = np.where(live, own, blank)
            self.bigrams |= np.where(self.size >= j, bit(before * 37 + there * 11), np.uint64(0))
            before = there
            if held is None:
                times = 0
            else:
                times = held[every + own]
                held[every + own] += 1
            self.chars |= np.where(live, bit(own + 23 * times), np.uint64(0))


def _points(texts: list[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


class Block:
    """Scores of the pairs of two lists of texts. left, right: (key, text, tokens of the key's kind), the text being sorted distinct tokens.
    lead: of each left text the length of what its key's pairs have in common, with the text that is left of it without; boost: what
    their scores are multiplied by. Without keys of tokens (``by_token`` false) all pairs of a key count."""

    def __init__(self, left: list[tuple[str, str, list[str]]], right: list[tuple[str, str, list[str]]], by_token: bool, boost: np.ndarray, need: float):
        self.left, self.right, self.by_token, self.boost, self.need = left, right, by_token, boost, need
        numbers: dict[str, int] = {}
        self.lkey = np.array([numbers.setdefault(k, len(numbers)) for k, _, _ in left], dtype=np.int64)
        rkey = np.array([numbers.setdefault(k, len(numbers)) for k, _, _ in right], dtype=np.int64)
        self.order = np.argsort(rkey, kind="stable")
        self.held = np.bincount(rkey, minlength=len(numbers))
        self.begin = np.cumsum(self.held) - self.held
        token = (lambda k: k.split(" ", 1)[0]) if by_token else (lambda k: None)
        rest = lambda side: [" ".join([t for t in x.split(" ") if t != token(k)]) if by_token else x for k, x, _ in side]
        lrest, rrest = rest(left), rest([right[i] for i in self.order])
        self.lead = np.array([len(token(k)) if by_token else 0 for k, _, _ in left], dtype=np.int64)
        self.ltext, self.rtext = [x for _, x, _ in left], [right[i][1] for i in self.order]
        self.la, self.lb = (np.array([len(x) for x in texts], dtype=np.int64) for texts in (self.ltext, self.rtext))
        names: dict[str, int] = {}
        self.lother, self.lodd, self.lsign = self._others(left, lrest, token, names)
        self.rother, self.rodd, self.rsign = self._others([right[i] for i in self.order], rrest, token, names)
        short = lambda texts, odd: ["" if o else x for x, o in zip(texts, odd)]
        lrest, rrest = short(lrest, self.lodd), short(rrest, self.rodd)
        self.known = np.unique(np.r_[_points(lrest), _points(rrest), np.uint32(32)])
        repeats = len(self.known) * max(len(left), len(right)) <= 4 * MASKS  # whether a character's repeats are told apart, on both sides alike
        self.x, self.y = _Texts(lrest, self.known, repeats), _Texts(rrest, self.known, repeats)

    @staticmethod
    def _others(side: list, rest: list[str], token: Callable, names: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each text: its tokens but for the key's, whether it can't be compared side by side, and a mask of these tokens."""
        out = np.full((len(side), OTHERS), -1, dtype=np.int64)
        odd, sign = np.zeros(len(side), dtype=bool), np.zeros(len(side), dtype=np.uint64)
        for i, ((k, x, toks), r) in enumerate(zip(side, rest)):
            own = [names.setdefault(t, len(names)) for t in toks if t != token(k)]
            if len(own) > OTHERS or len(r) > WIDE or " ".join(sorted(toks)) != x:
                odd[i] = True
            else:
                out[i, : len(own)] = own
            sign[i] = sum({1 << n % 64 for n in own})
        return out, odd, sign

    def pairs(self, once: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(left, right, score, told) by chunks: pairs whose score times boost reaches the need, and those (told false, no score) that
        are to be scored one by one. once: one pair for each left text will do."""
        each = self.held[self.lkey]
        upto = np.cumsum(each)
        rows = max(1, MASKS // (len(self.known) + 1))
        a = 0
        while a < len(each):
            b = max(a + 1, min(a + rows, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + CHUNK, side="right"))))
            n = each[a:b]
            i = np.repeat(np.arange(a, b), n)
            j = np.arange(len(i)) - np.repeat(np.cumsum(n) - n - self.begin[self.lkey[a:b]], n)
            if len(i):
                yield self._scored(i, j, a, b, once)
            a = b

    def _scored(self, i: np.ndarray, j: np.ndarray, a: int, b: int, once: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        odd = self.lodd[i] | self.rodd[j]
        near_by = np.flatnonzero(~odd & ((self.lsign[i] & self.rsign[j]) != 0))
        if len(near_by):
            p, q = self.lother[i[near_by]], self.rother[j[near_by]]
            same = np.zeros(len(near_by), dtype=bool)
            for k in range(OTHERS):
                for m in range(OTHERS):
                    same |= (p[:, k] >= 0) & (p[:, k] == q[:, m])
            odd[near_by[same]] = True
        x, y, lead, boost = self.x.size[i], self.y.size[j], self.lead[i], self.boost[i]
        la, lb = self.la[i], self.lb[j]
        near = np.rint(200 * lead / (lead + np.minimum(la, lb)))
        lead = lead + ((lead > 0) & (x > 0) & (y > 0))
        p, q, g, h = self.x.chars[i], self.y.chars[j], self.x.bigrams[i], self.y.bigrams[j]
        count = lambda m: np.bitwise_count(m).astype(np.int64)
        most = np.minimum(x - count(p & ~q), y - count(q & ~p))
        most = np.minimum(most, (np.minimum(x - count(g & ~h), y - count(h & ~g)) + x + y) // 3)
        far = np.rint(200 * (lead + most) / (la + lb))
        open_ = ~odd & (far > near) & (far * boost >= self.need)
        if once:
            done = np.zeros(b - a, dtype=bool)
            done[i[~odd & (near * boost >= self.need)] - a] = True
            open_ &= ~done[i - a]
        at = np.flatnonzero(open_)
        score = near
        if len(at):
            common = self._common(i[at], j[at], a, b)
            score[at] = np.maximum(score[at], np.rint(200 * (lead[at] + common) / (la[at] + lb[at])))
        keep = np.flatnonzero(odd | (score * boost >= self.need))
        return i[keep], self.order[j[keep]], score[keep].astype(np.int64), ~odd[keep]

    def _common(self, i: np.ndarray, j: np.ndarray, a: int, b: int) -> np.ndarray:
        letters = len(self.known) + 1
        masks = np.zeros((b - a) * letters, dtype=np.uint64)
        base = np.arange(b - a) * letters
        size = self.x.size[a:b]
        for k in range(int(size.max(initial=0))):
            there = np.flatnonzero(size > k)
            masks[base[there] + self.x.codes[k, a:b][there]] |= np.uint64(1) << np.uint64(k)
        order = np.argsort(self.y.size[j].astype(np.uint8), kind="stable")
        i, j = i[order], j[order]
        full = np.where(self.x.size[i] > 0, ~np.uint64(0) >> np.minimum(64 - self.x.size[i], 63).astype(np.uint64), np.uint64(0))
        row, at = full.copy(), (i - a) * letters
        for k, live in enumerate(np.searchsorted(self.y.size[j], np.arange(int(self.y.size[j[-1]])), side="right")):
            own = row[live:]
            hit = own & masks[at[live:] + self.y.codes[k][j[live:]]]
            row[live:] = (own + hit | own - hit) & full[live:]
        out = np.empty(len(i), dtype=np.int64)
        out[order] = self.x.size[i] - np.bitwise_count(row)
        return out


def _weighed(block: Block, pairs: tuple, lead: np.ndarray, known: list[dict[str, float]], scale: float, most: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a chunk's pairs: left, right, score, and the weight of the common tokens. lead: by left row the weight of its key's token, known: its
    tokens' weights. A pair that shares several tokens comes from the heaviest."""
    i, j, score, told = pairs
    comb, keep, xs, ys, needs, at = lead[i], told.copy(), [], [], [], []
    for n in np.flatnonzero(~told):
        p, (_, y, other) = int(i[n]), block.right[int(j[n])]
        key, x, _ = block.left[p]
        shared = sorted(t for t in known[p] if t in other)
        if max((known[p][t], t) for t in shared)[1] == key.split(" ", 1)[0]:
            total = 0.0
            for t in shared:
                total += known[p][t]
            comb[n] = total
            xs.append(x)
            ys.append(y)
            needs.append(block.need / (1 + min(total / scale, most)))
            at.append(n)
    if at:
        score[at] = sim.set_scores(xs, ys, needs)
        keep[at] = score[at] * (1 + np.minimum(comb[at] / scale, most)) >= block.need
    return i[keep], j[keep], score[keep], comb[keep]


def _unweighed(block: Block, pairs: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a chunk's pairs: left, right and score. Those with a common token are scored here."""
    i, j, score, told = pairs
    at = np.flatnonzero(~told)
    if len(at):
        score[at] = sim.set_scores([block.left[n][1] for n in i[at]], [block.right[n][1] for n in j[at]], [block.need] * len(at))
    keep = score >= block.need
    return i[keep], j[keep], score[keep]


class _Members:
    """A column of lists: the members of each row."""

    def __init__(self, lists: pa.ChunkedArray):
        lists = lists.combine_chunks()
        lists = lists if isinstance(lists, pa.Array) else pa.concat_arrays(lists.chunks)
        self.size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        self.begin = np.cumsum(self.size) - self.size
        self.values = pc.list_flatten(lists)


def _each(own: _Members, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows all members: the row's place in i, and the member's."""
    n = own.size[i]
    row = np.repeat(np.arange(len(i)), n)
    return row, np.arange(len(row)) + np.repeat(own.begin[i] - np.cumsum(n) + n, n)


def _expanded(own: _Members, other: _Members, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For pairs of rows all pairs of members: the pair's place, and each member's."""
    m = other.size[j]
    n = own.size[i] * m
    pair = np.repeat(np.arange(len(i)), n)
    k = np.arange(len(pair)) - np.repeat(np.cumsum(n) - n, n)
    return pair, own.begin[i][pair] + k // m[pair], other.begin[j][pair] + k % m[pair]


def classes(rows: DataFrame, keys: list[str], own: Column) -> DataFrame:
    """Rows grouped by the keys, with their own values as lists of about SHARE at most; part tells lists of one class apart."""
    many = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > SHARE).select(*keys, F.ceil(F.col("__n") / SHARE).alias("__n"))
    dealt = rows.withColumn("own", own).join(many, keys, "left").withColumn("part", F.pmod(F.xxhash64("own"), F.coalesce("__n", F.lit(1))))
    return dealt.groupBy(*keys, "part").agg(F.collect_list("own").alias("own"))


def _met(left: DataFrame, right: DataFrame, key: Column, l: Column, r: Column, run: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """Rows of both sides with one key, in tasks of about TASK pairs of members: run of each task's rows, whose column k is the key and
    its piece. left, right: with ``own``, a list; l, r: by what rows of a key are dealt into pieces."""
    left, right = (side.withColumn("__key", key) for side in (left, right))
    counted = lambda side, name: side.groupBy("__key").agg(F.sum(F.size("own")).alias(name))
    counts = counted(left, "nl").join(counted(right, "nr"), "__key")
    total = counts.agg(F.sum("nl"), F.sum("nr"), F.sum(F.col("nl").cast("double") * F.col("nr"))).first()
    piece = max(PIECE, -(-max(total[0] or 0, total[1] or 0) // HOT))
    spark = left.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int((total[2] or 0) // TASK) + 1)
    pieces = lambda n: F.ceil(F.col(n) / piece).cast("int")
    hot = F.broadcast(counts.where((F.col("nl") > piece) | (F.col("nr") > piece)).select("__key", pieces("nl").alias("__l"), pieces("nr").alias("__r")))

    def dealt(side: DataFrame, own: Column, mine: str, other: str) -> DataFrame:
        k = lambda c: F.coalesce(F.col(c), F.lit(1))
        out = side.join(hot, "__key", "left").withColumn(f"{mine}_at", F.pmod(F.xxhash64(own), k(mine)))
        out = out.withColumn(f"{other}_at", F.explode(F.sequence(F.lit(0), k(other) - 1)))
        out = out.withColumn("k", F.concat_ws(" ", "__key", F.col("__l_at").cast("string"), F.col("__r_at").cast("string")))
        return out.drop("__key", "__l", "__r", "__l_at", "__r_at").withColumn("__task", F.pmod(F.xxhash64("k"), F.lit(tasks)).cast("int"))

    sides = (dealt(left, l, "__l", "__r"), dealt(right, r, "__r", "__l"))
    a, b = (side.repartition(tasks, "__task").groupBy("__task") for side in sides)
    return a.cogroup(b).applyInArrow(run, schema)


def _rows(t: pa.Table) -> list[tuple[str, str, list[str]]]:
    return list(zip(*(t.column(c).to_pylist() for c in ("k", "text", "toks"))))


def _with_text(side: DataFrame, text: str) -> DataFrame:
    proc = sim.processed_tokens(F.col(text))
    return side.withColumns({"toks": lk.tokens(F.col(text)), "text": F.array_join(proc, " ")}).where("text != ''")


def by_token(own: DataFrame, made: DataFrame, idf: DataFrame, threshold: float, scale: float, most: float, what: str, keep: lk.Keep = lk.as_is) -> DataFrame:
    """Pairs that share a token and reach the threshold (0..1). own: (cand, own, part), classes of candidates with structs for members; made:
    ``linkage.targets``. what: ``links`` gives every pair of members, the struct's fields, uri, raw (the score) and comb (the weight
    of the common tokens). ``any`` gives the members that have a pair, some more than once. ``counts`` counts pairs: members are then (w,
    n), n of one w, and the result is w, raw, comb, n."""
    held = _with_text(own, "cand")
    each = held.select("cand", "part", F.explode("toks").alias("token")).join(idf.select("token", "idf"), "token")
    known = each.groupBy("cand", "part").agg(F.collect_list("token").alias("names"), F.collect_list("idf").alias("weights"))
    left = keep(held.join(known, ["cand", "part"]).select("*", F.explode("names").alias("token")), "block_left")
    targets = made.where(F.size("proc") > 0).select(F.array_sort("toks").alias("toks"), F.array_join("proc", " ").alias("text"), "uri")
    right = keep(classes(targets, ["toks", "text"], F.col("uri")).select("*", F.explode("toks").alias("token")), "block_right")
    fields = own.schema["own"].dataType.elementType
    told = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields)
    schema = {"links": f"{told}, uri {made.schema['uri'].dataType.simpleString()}, raw int, comb double", "any": told, "counts": "w long, raw int, comb double, n long"}[what]
    names = {"links": [*fields.names, "uri", "raw", "comb"], "any": fields.names, "counts": ["w", "raw", "comb", "n"]}[what]

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        if not len(a) or not len(b):
            return _none(a, b, names)
        out, lefts = [], _rows(a)
        weights = [dict(zip(*x)) for x in zip(a.column("names").to_pylist(), a.column("weights").to_pylist())]
        lead = np.array([w[k.split(" ", 1)[0]] for (k, _, _), w in zip(lefts, weights)])
        block = Block(lefts, _rows(b), True, 1 + np.minimum(lead / scale, most), 100 * threshold)
        mine, other = _Members(a.column("own")), _Members(b.column("own"))
        seen = np.zeros(len(a), dtype=bool)
        for pairs in block.pairs(what == "any"):
            i, j, score, comb = _weighed(block, pairs, lead, weights, scale, most)
            if what == "any":
                seen[i] = True
            elif what == "links":
                pair, m, n = _expanded(mine, other, i, j)
                out.append([*mine.values.take(pa.array(m)).flatten(), other.values.take(pa.array(n)), pa.array(score[pair], pa.int32()), pa.array(comb[pair])])
            else:
                pair, at = _each(mine, i)
                w, times = (x.to_numpy(zero_copy_only=False)[at] for x in mine.values.flatten())
                t = pa.table({"w": w, "raw": score[pair].astype(np.int32), "comb": comb[pair], "n": times * other.size[j][pair]})
                t = t.group_by(["w", "raw", "comb"]).aggregate([("n", "sum")])
                out.append([t.column(c).combine_chunks() for c in ("w", "raw", "comb", "n_sum")])
        if what == "any":
            out.append(mine.values.take(pa.array(_each(mine, np.flatnonzero(seen))[1])).flatten())
        return pa.concat_tables([pa.table(p, names=names) for p in out]) if out else _none(a, b, names)

    return _met(left.select("token", "cand", "part", "text", "toks", "names", "weights", "own"), right, F.col("token"), F.struct("cand", "part"), F.struct("text", "part"), run, schema)


def within(cands: DataFrame, made: DataFrame, keys: list[str], carry: tuple[str, ...], threshold: float, keep: lk.Keep = lk.as_is) -> DataFrame:
    """carry, uri, raw: all pairs that agree in the keys and whose ratio, without weights, reaches the threshold (0..1). cands: (keys, cand,
    carry), made: (keys, proc, uri); keys and cand are not null."""
    tokens = F.split("text", " ").alias("toks")
    left = keep(_with_text(classes(cands, [*keys, "cand"], F.struct(*carry)), "cand").select(*keys, "cand", "part", "text", tokens, "own"), "block_left")
    targets = made.where(F.size("proc") > 0).select(*keys, F.array_join("proc", " ").alias("text"), "uri")
    right = keep(classes(targets, [*keys, "text"], F.col("uri")).select("*", tokens), "block_right")
    told = ", ".join(f"{c} {cands.schema[c].dataType.simpleString()}" for c in carry)
    names = [*carry, "uri", "raw"]

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        if not len(a) or not len(b):
            return _none(a, b, names)
        out, mine, other = [], _Members(a.column("own")), _Members(b.column("own"))
        block = Block(_rows(a), _rows(b), False, np.ones(len(a)), 100 * threshold)
        for pairs in block.pairs():
            i, j, score = _unweighed(block, pairs)
            pair, m, n = _expanded(mine, other, i, j)
            out.append([*mine.values.take(pa.array(m)).flatten(), other.values.take(pa.array(n)), pa.array(score[pair], pa.int32())])
        return pa.concat_tables([pa.table(p, names=names) for p in out]) if out else _none(a, b, names)

    schema = f"{told}, uri {made.schema['uri'].dataType.simpleString()}, raw int"
    return _met(left, right, F.to_json(F.struct(*keys)), F.struct("cand", "part"), F.struct("text", "part"), run, schema)


def _none(a: pa.Table, b: pa.Table, names: list[str]) -> pa.Table:
    """No pairs, in columns of the right types."""
    own = a.schema.field("own").type.value_type
    types = {own.field(k).name: own.field(k).type for k in range(own.num_fields)}
    types = {**types, "uri": b.schema.field("own").type.value_type, "raw": pa.int32(), "comb": pa.float64()}
    return pa.table({c: pa.array([], types[c]) for c in names})


def _titles(raw: DataFrame, variants: DataFrame, config: LinkConfig, keep: lk.Keep) -> tuple[DataFrame, DataFrame, DataFrame]:
    made = keep(lk.targets(variants, config.conversion_table), "title_targets")
    cands = keep(lk.candidates(raw, config.conversion_table), "title_candidates")
    return made, cands, keep(lk.idf_weights(made), "title_weights")


def title_links(raw: DataFrame, variants: DataFrame, config: LinkConfig = LinkConfig(), keep: lk.Keep = lk.as_is) -> DataFrame:
    """rec, uri, score, as ``linkage.title_stage`` gives them with weights."""
    made, cands, idf = _titles(raw, variants, config, keep)
    own = classes(cands.select("rec", "cand").distinct(), ["cand"], F.struct("rec"))
    pairs = by_token(own, made, idf, config.title_threshold, config.title_idf_scale, config.title_boost, "links", keep)
    boost = 1 + F.least(F.col("comb") / config.title_idf_scale, F.lit(config.title_boost))
    pairs = pairs.select("rec", "uri", (F.col("raw") * boost / 100).alias("score"))
    # Links may be many more than records, so they are grouped only if a record and a book can meet more than once.
    if cands.groupBy("rec").count().where("count > 1").isEmpty() and made.groupBy("uri").count().where("count > 1").isEmpty():
        return pairs
    return pairs.groupBy("rec", "uri").agg(F.max("score").alias("score"))


def linked_records(raw: DataFrame, variants: DataFrame, config: LinkConfig = LinkConfig(), keep: lk.Keep = lk.as_is) -> DataFrame:
    """rec: the records that ``title_links`` links at all. Candidates with the tokens of a target, whose score is 100, are settled by a
    join; the others look for one target that will do."""
    made, cands, idf = _titles(raw, variants, config, keep)
    own = keep(classes(cands.select("rec", "cand"), ["cand"], F.struct("rec")), "title_classes")
    if config.title_threshold > 1:
        return by_token(own, made, idf, config.title_threshold, config.title_idf_scale, config.title_boost, "any", keep).distinct()
    marked = own.withColumn("set", F.array_sort(lk.tokens(F.col("cand"))))
    sets = made.where(F.size("proc") > 0).select(F.array_sort("toks").alias("set")).distinct()
    same = marked.join(sets, "set", "left_semi").select(F.inline("own"))
    rest = marked.join(sets, "set", "left_anti").select(own.columns)
    return same.union(by_token(rest, made, idf, config.title_threshold, config.title_idf_scale, config.title_boost, "any", keep)).distinct()


def raw_matches(authors_raw: DataFrame, author_variants: DataFrame, titles_raw: DataFrame, book_variants: DataFrame, books: DataFrame, author_threshold: float, title_threshold: float, table: bool = True, keep: lk.Keep = lk.as_is) -> DataFrame:
    """rec, book, author, author_score, title_score, as ``linkage.raw_matches``; a book and its author are named once in books."""
    cand = tx.normalize_for_matching(F.col("raw"), table=table).alias("cand")
    names = keep(authors_raw.select("rec", "script", cand).where("cand != ''").distinct(), "raw_candidates")
    each = names.select("script", "cand").distinct().withColumn("name", F.col("cand"))
    found = within(each, lk.each_variant(author_variants, table), ["script"], ("name", "script"), author_threshold, lambda df, name: keep(df, f"author_{name}"))
    found = found.groupBy(F.col("name").alias("cand"), "script", "uri").agg((F.max("raw") / 100).alias("score"))
    authors = keep(names.join(found, ["cand", "script"]).groupBy("rec", F.col("uri").alias("author")).agg(F.max("score").alias("author_score")), "raw_authors")
    cands = keep(titles_raw.select("rec", "script", cand).where("cand != ''").distinct().join(authors, "rec"), "title_candidates")
    owned = books.select("uri", F.col("author_uri").alias("author")).where("author IS NOT NULL").distinct()
    made = keep(lk.each_variant(book_variants, table).join(owned, "uri"), "title_targets")
    pairs = within(cands, made, ["script", "author"], ("rec", "author", "author_score"), title_threshold, keep)
    pairs = pairs.select("rec", F.col("uri").alias("book"), "author", "author_score", (F.col("raw") / 100).alias("title_score"))
    if cands.groupBy("rec", "author").count().where("count > 1").isEmpty() and made.groupBy("uri", "author").count().where("count > 1").isEmpty():
        return pairs
    return pairs.groupBy("rec", "book", "author").agg(F.max("author_score").alias("author_score"), F.max("title_score").alias("title_score"))
