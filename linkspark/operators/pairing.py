"""Which pairs of two tables of texts can reach a score at all: joins on what such pairs must share, without pairs of all
with all.

The score is the token-set ratio, on 0..100: of sorted distinct tokens, the greatest of the ratios of the common text to
either whole text, and of the two whole texts with the common tokens first. Two facts bound it:

* Order a text's tokens by falling weight. If the first token that a pair shares is at some place, then its boost is
  limited by the weights from there on, so the ratio needed is known, and the common text is no longer than the tokens
  from there on. Hence each place has a window of partners' lengths; at a frequent token, where the rest of a text
  weighs little, the window is narrow. That is a prefix filter whose prefix ends by degrees.
* A pair without a common token needs the whole texts' ratio. With n and m characters and a common subsequence of L,
  they share 3 L - n - m + 1 of their bigrams at least (each token with a blank at both ends, so that their order
  doesn't matter), and L of their characters. So they meet in the prefixes of their rarest grams.

Lengths are joined by bands, and a key that many texts have is dealt out over a grid of tasks.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Lengths of one band differ by this factor at most.
BAND = 1.25
#: Rows of a key on one side that go to one task; a larger share of all rows counts where there are many.
SPLIT, SHARES = 20_000, 4096
#: Bands that aren't of lengths: texts of any length, and texts whose tokens aren't those of the ratio.
ANY, OTHER = -2, -1
#: A rounded ratio is at most so much above the ratio; sums of weights may differ in their last digits.
SLACK = 0.5 + 1e-6
#: A window of more bands than these is not dealt by bands.
BANDS = 3
#: From here on bigrams tell more than characters do.
BIGRAMS_FROM = 75.0


def _band(n: Column) -> Column:
    return F.floor(F.log(F.greatest(n, F.lit(1)).cast("double")) / math.log(BAND) + 1e-9).cast("int")


def dealt_join(left: DataFrame, right: DataFrame, keys: list[str], l: str, r: str, by: str, left_count: DataFrame, right_count: DataFrame) -> DataFrame:
    """The inner join on keys. A value of the key ``by`` with many rows on a side has them cut into pieces by l or r, and every piece
    of one side meets every piece of the other in a task of its own. The counts, (by, n), may be of more rows than are
    joined. Values with many rows are fewer than 2 SHARES, so they are broadcast."""
    n = left_count.select(by, F.col("n").alias("__nl")).join(right_count.select(by, F.col("n").alias("__nr")), by)
    totals = n.agg(F.sum("__nl").alias("__tl"), F.sum("__nr").alias("__tr"))  # one row
    most = F.greatest(F.lit(SPLIT), F.ceil(F.greatest("__tl", "__tr") / SHARES))
    pieces = lambda c: F.ceil(F.col(c) / most).cast("int")
    hot = n.crossJoin(F.broadcast(totals)).where((F.col("__nl") > most) | (F.col("__nr") > most)).select(by, pieces("__nl").alias("__kl"), pieces("__nr").alias("__kr"))

    def dealt(side: DataFrame, own: str, mine: str, other: str) -> DataFrame:
        k = lambda c: F.coalesce(F.col(c), F.lit(1))
        out = side.join(F.broadcast(hot), by, "left").withColumn(f"{mine}_at", F.pmod(F.hash(own), k(mine)))
        return out.withColumn(f"{other}_at", F.explode(F.sequence(F.lit(0), k(other) - 1))).drop("__kl", "__kr")

    return dealt(left, l, "__kl", "__kr").join(dealt(right, r, "__kr", "__kl"), [*keys, "__kl_at", "__kr_at"]).drop("__kl_at", "__kr_at")


def _totals(keys: DataFrame) -> DataFrame:
    return keys.groupBy("key").agg(F.count(F.lit(1)).alias("n"))


def _key(within: list[str], name: str) -> Column:
    """What rows are dealt by: a token or gram, and the values that a pair has in common anyway."""
    return F.xxhash64(*within, name)


def sharing(left: DataFrame, right: DataFrame, weights: DataFrame, threshold: float, scale: float | None, most: float, within: tuple[str, ...] = (), tasks: int | None = None) -> DataFrame:
    """Pairs that share a token and may reach the threshold (0..1) with their boost, 1 + min(sum of shared weights / scale, most);
    no boost if scale is None. left: (l, toks, len, plain, x), right: (r, toks, len, plain, y), len the length of the ratio's
    text, and plain whether its tokens are toks; l and r are unique. weights: (token, idf). within: columns of both sides that
    must be equal. tasks: into how many the left texts are dealt with their weights. The result has each pair once, in the task of its first shared
    token, with x, y and ``shared``, the weights of the common tokens in the tokens' order; nothing of a pair is shuffled."""
    w = list(within)
    each = left.select("l", "len", "plain", "x", *w, F.explode("toks").alias("token")).join(weights.select("token", "idf"), "token")
    each = each if tasks is None else each.repartition(tasks, "l")
    held = each.groupBy("l").agg(F.sort_array(F.collect_list(F.struct("idf", "token"))).alias("known"), *[F.first(c).alias(c) for c in ("len", "plain", "x", *w)])
    known = F.array_sort(F.transform("known", lambda t: F.struct(t["token"].alias("token"), t["idf"].alias("idf"))))
    place = held.select("l", "len", "plain", "x", *w, F.posexplode("known").alias("at", "t"), "known").withColumn("rest", F.slice("known", F.lit(1), F.col("at") + 1))
    total = F.aggregate("rest", F.lit(0.0), lambda acc, t: acc + t["idf"])
    boost = F.lit(1.0) if scale is None else 1 + F.least(total / scale, F.lit(most))
    placed = place.withColumn("need", 100 * threshold / boost - SLACK).withColumn("chars", F.aggregate("rest", F.lit(-1), lambda acc, t: acc + F.length(t["token"]) + 1))
    placed = placed.select("l", "len", "plain", "x", *w, "need", "chars", F.col("t.token").alias("token"), F.col("t.idf").alias("idf"), known.alias("known"))
    far = (200 - F.col("need")) / F.col("need")
    placed = placed.withColumns({"low": F.col("len") / far - 1e-6, "high": F.col("len") * far + 1e-6, "short": F.col("chars") * far + 1e-6})
    # Where the common text may be near the whole left text, or lengths say nothing, any partner will do.
    placed = placed.withColumn("free", ~F.col("plain") | (F.col("chars") >= F.col("low")) | (F.col("need") <= 0))
    upto = lambda a, b: F.when(a <= b, F.sequence(a, b)).otherwise(F.array().cast("array<int>"))
    bands = F.array_union(upto(F.lit(0), _band(F.col("short"))), upto(_band(F.col("low")), _band(F.col("high"))))
    # Of a wide window, more copies would be shuffled than partners are spared: lengths are compared after the join.
    posted = placed.withColumn("bands", bands).select("l", "x", *w, "token", "idf", "known", "free", "low", "high", "short", _key(w, "token").alias("key"), F.explode(F.when(F.col("free") | (F.size("bands") > BANDS), F.array(F.lit(ANY))).otherwise(F.array_union("bands", F.array(F.lit(OTHER))))).alias("band"))
    own = F.array(F.lit(ANY), F.when(F.col("plain"), _band(F.col("len"))).otherwise(F.lit(OTHER)))
    postings = right.select("r", "y", *w, F.col("len").alias("n"), F.col("plain").alias("rplain"), "toks", F.explode("toks").alias("token"), own.alias("bands")).select("r", "y", *w, "n", "rplain", "toks", "token", _key(w, "token").alias("key"), F.explode("bands").alias("band"))
    counted = lambda side: side.select(*w, F.explode("toks").alias("token")).select(_key(w, "token").alias("key"))
    met = dealt_join(posted, postings, [*w, "token", "key", "band"], "l", "r", "key", _totals(counted(left)), _totals(counted(right)))
    fits = F.col("free") | ~F.col("rplain") | (F.col("n") <= F.col("short")) | F.col("n").between(F.col("low"), F.col("high"))
    before = lambda t: (t["idf"] > F.col("idf")) | ((t["idf"] == F.col("idf")) & (t["token"] > F.col("token")))
    first = ~F.exists("known", lambda t: before(t) & F.array_contains("toks", t["token"]))
    shared = F.transform(F.filter("known", lambda t: F.array_contains("toks", t["token"])), lambda t: t["idf"])
    return met.where(fits & first).select("x", "y", shared.alias("shared"))


def _gram_list(q: int) -> Column:
    """The grams of a text's tokens, with repeats."""
    padded = lambda t: F.transform(F.sequence(F.lit(1), F.length(t) + 1), lambda i: F.concat(F.lit(" "), t, F.lit(" ")).substr(i, F.lit(2)))
    return F.flatten(F.transform("toks", padded)) if q == 2 else F.filter(F.split(F.array_join("toks", " "), ""), lambda c: c != "")


def _grams(side: DataFrame, q: int) -> DataFrame:
    """The side with ``gram``, a row for each gram of a text, followed by a number that counts its repeats."""
    repeats = F.transform(F.sequence(F.lit(1), F.size(F.filter("__all", lambda x: x == F.col("__g")))), lambda k: F.concat("__g", k.cast("string")))
    each = side.withColumn("__all", _gram_list(q)).select("*", F.explode(F.array_distinct("__all")).alias("__g"))
    return each.select("*", F.explode(repeats).alias("gram")).drop("__all", "__g")


def alike(left: DataFrame, right: DataFrame, threshold: float, within: tuple[str, ...] = ()) -> DataFrame:
    """Pairs without a common token whose whole texts' ratio may reach the threshold (0..1). left: (l, toks, len, x), right: (r, toks,
    len, y). within: columns of both sides that must be equal. Each pair comes once, in the task of the first gram that
    both prefixes have, with x and y."""
    need = 100 * threshold - SLACK
    if need <= 0:
        raise ValueError("a threshold of 0 leaves nothing to join on")
    q, w = 2 if need >= BIGRAMS_FROM else 1, list(within)
    far = (200 - need) / need
    df = _grams(right.select("toks"), q).groupBy("gram").agg(F.count(F.lit(1)).alias("df"))
    n = F.col("len")
    least = F.greatest(F.ceil(n / far - 1e-6), F.lit(1))  # the shortest partner's length, for which the least is shared
    shared = (n + least) * (3 * need / 200 - 1) + 1 if q == 2 else (n + least) * need / 200
    size = n + 1 if q == 2 else n
    upto = size - F.greatest(F.ceil(shared - 1e-6), F.lit(1)) + 1

    def prefix(side: DataFrame, key: str, own: str) -> DataFrame:
        """The side's rows with the prefix of each, the rarest grams first."""
        each = _grams(side.select(key, "toks", "len", own, *w), q).join(df, "gram", "left")
        held = each.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "gram"))).alias("all"), *[F.first(c).alias(c) for c in ("toks", "len", own, *w)])
        grams = F.transform(F.slice("all", F.lit(1), F.greatest(upto, F.lit(0)).cast("int")), lambda t: t["gram"])
        return held.select(key, "toks", "len", own, *w, grams.alias("grams")).where(F.size("grams") > 0)

    a, b = prefix(left, "l", "x"), prefix(right, "r", "y")
    bands = F.sequence(_band(least), _band(n * far + 1e-6))
    counted = lambda side: side.select(*w, F.explode("grams").alias("gram")).select(_key(w, "gram").alias("key"))
    posted = a.select("l", "x", *w, F.col("toks").alias("tl"), n.alias("nl"), size.alias("sl"), F.col("grams").alias("gl"), bands.alias("bands"), F.posexplode("grams").alias("atl", "gram"))
    posted = posted.withColumn("gl", F.slice("gl", F.lit(1), F.col("atl"))).withColumn("key", _key(w, "gram")).select("*", F.explode("bands").alias("band")).drop("bands")
    postings = b.select("r", "y", *w, F.col("toks").alias("tr"), n.alias("nr"), size.alias("sr"), F.col("grams").alias("gr"), _band(n).alias("band"), F.posexplode("grams").alias("atr", "gram")).withColumn("key", _key(w, "gram"))
    met = dealt_join(posted, postings, [*w, "gram", "key", "band"], "l", "r", "key", _totals(counted(a)), _totals(counted(b)))
    both = F.col("nl") + F.col("nr")
    # Of the first gram that a pair shares: those from here on are all it can share.
    enough = both * (3 * need / 200 - 1) + 1 if q == 2 else both * need / 200
    fits = (200 * F.least("nl", "nr") >= need * both) & (F.least(F.col("sl") - F.col("atl"), F.col("sr") - F.col("atr")) >= enough - 1e-6)
    return met.where(fits & ~F.arrays_overlap("gl", "gr") & ~F.arrays_overlap("tl", "tr")).select("x", "y")
