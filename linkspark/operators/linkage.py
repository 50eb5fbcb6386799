"""Staged linkage of records with authors and books: token-blocked similarity, IDF boosts, combination and tiers.

A pair without a common token scores 0 while IDF weights are in use, so joining on tokens loses nothing; ``pairing``
says which pairs can reach the threshold at all, with weights or without. Targets and candidates are normalised once,
each distinct candidate is scored once, and a longest common subsequence is taken only of pairs that pass a bound.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import LinkConfig
from ..functions import similarity as sim
from ..functions import text as tx
from . import pairing


def tokens(x: Column) -> Column:
    """The distinct white-space tokens of a normalised text."""
    return F.array_distinct(F.filter(F.split(x, " "), lambda t: t != ""))


def targets(variants: DataFrame, table: bool = True) -> DataFrame:
    """uri, script, norm (variants joined in order), toks (distinct tokens), proc (sorted tokens for the ratio)."""
    normal = variants.select("uri", "script", "ord", tx.normalize_for_matching(F.col("variant"), camel=True, is_corpus=True, table=table).alias("v")).where("v != ''")
    joined = normal.groupBy("uri", "script").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "v"))), lambda s: s["v"]), " ").alias("norm"))
    return joined.select("*", tokens(F.col("norm")).alias("toks"), sim.processed_tokens(F.col("norm")).alias("proc"))


def idf_weights(made: DataFrame) -> DataFrame:
    """token, df, idf = ln(1 + N / df), N the number of targets and df those with the token in either script."""
    df = made.select("uri", F.explode("toks").alias("token")).distinct().groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    n = made.agg(F.count_distinct("uri").alias("n"))
    return df.crossJoin(F.broadcast(n)).select("token", "df", F.log(1 + F.col("n") / F.col("df")).alias("idf"))  # n is one row


def candidates(raw: DataFrame, table: bool = True) -> DataFrame:
    """rec, ord, cand (normalised), from (rec, ord, raw)."""
    return raw.select("rec", "ord", tx.normalize_for_matching(F.col("raw"), table=table).alias("cand")).where("cand != ''")


#: Into so many parts at least the rows that have a candidate in common are dealt, by their own values; and into one for each SHARE
#: candidates, so that a part of one candidate holds no more rows than these.
PARTS, SHARE = 1024, 4000


#: Candidates of a task where rows of a record meet.
ROWS = 100_000


def tasks(spark: SparkSession, rows: int) -> int:
    """How many tasks so many rows are dealt into."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // ROWS))


def by_record(df: DataFrame, rows: int, *more: str) -> DataFrame:
    """df dealt by record (and more columns, for a join on all of them) into tasks of about ROWS of so many rows of input, so that what
    a task groups or sorts stays as it is when there are more of them; groups of a record and other columns take no other shuffle,
    and Spark puts no tasks together."""
    return df.repartition(tasks(df.sparkSession, rows), "rec", *more)


def score_pairs(cands: DataFrame, made: DataFrame, idf: DataFrame, threshold: float, scale: float, most: float, rare_idf: float, weighted: bool = True, carry: tuple[str, ...] = (), within: tuple[str, ...] = (), rows: int | None = None) -> DataFrame:
    """cand, uri, raw, comb, rare: for each pair whose boosted score reaches the threshold, its scripts' scores. Without weights
    pairs need no common token, and none is boosted. A pair is scored where the join finds it, so that no pairs are shuffled.

    carry: columns of cands that travel with the candidates, as lists, and make a row each of every pair of theirs; so no
    join of pairs with records follows. within: columns of cands and made that a pair must agree in. rows: how many cands are, for
    dealing those that are carried."""
    key = ["cand", *within]
    if carry:
        own = F.struct(*carry)
        held = cands.select(*key, own.alias("own"), F.pmod(F.xxhash64(own), F.lit(max(PARTS, -(-(rows or 0) // SHARE)))).alias("part"))
        held = held if rows is None else held.repartition(tasks(held.sparkSession, rows), *key, "part")
        held = held.groupBy(*key, "part").agg(F.collect_list("own").alias("own"))
    else:
        held = cands.select(*key).distinct().select("*", F.lit(0).alias("part"), F.lit(None).cast("array<int>").alias("own"))
    left = held.select("*", sim.processed_tokens(F.col("cand")).alias("cproc"), tokens(F.col("cand")).alias("ctoks"))
    left = left.select(F.struct(*key, "part").alias("l"), *within, "ctoks", "cproc", F.struct("cand", F.array_join("cproc", " ").alias("text"), "own").alias("x"))
    right = made.select(F.struct(*dict.fromkeys(("uri", "script", "norm", *within))).alias("r"), *within, "toks", "proc", F.struct("uri", "script", F.array_join("proc", " ").alias("text")).alias("y"))
    side = lambda df, id_, toks, proc, row: df.where(F.size(proc) > 0).select(id_, *within, F.col(toks).alias("toks"), F.length(F.array_join(proc, " ")).alias("len"), (F.sort_array(toks) == F.col(proc)).alias("plain"), row)
    if weighted:
        found = pairing.sharing(side(left, "l", "ctoks", "cproc", "x"), side(right, "r", "toks", "proc", "y"), idf, threshold, scale, most, within, None if rows is None or not carry else tasks(left.sparkSession, rows))
        total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda acc, x: acc + x)
        pairs = found.withColumns({"comb": total(F.col("shared")), "rare": total(F.filter("shared", lambda x: x >= rare_idf))})
        boost = 1 + F.least(F.col("comb") / scale, F.lit(most))
    else:
        a, b = side(left, "l", "cproc", "cproc", "x"), side(right, "r", "proc", "proc", "y")
        weights = idf_weights(made.select("uri", F.col("proc").alias("toks")))
        found = pairing.sharing(a, b, weights, threshold, None, 0.0, within).drop("shared").unionByName(pairing.alike(a, b, threshold, within))
        pairs, boost = found.withColumns({"comb": F.lit(0.0), "rare": F.lit(0.0)}), F.lit(1.0)
    raw = sim.set_score(F.col("x.text"), F.col("y.text"), threshold * 100 / F.col("boost"))
    scored = pairs.withColumn("boost", boost).withColumn("raw", raw).where(F.col("raw") * F.col("boost") >= threshold * 100)
    out = scored.select("x.cand", "x.own", "y.uri", "y.script", "raw", "comb", "rare", "boost")
    return out.select("cand", "uri", "script", "raw", "comb", "rare", "boost", F.inline("own")) if carry else out.drop("own")


def _boost(rare: Column, scale: float, most: float) -> Column:
    return 1 + F.least(rare / scale, F.lit(most))


#: How a stage keeps what it reads several times: given a table and a name, the table to read instead.
Keep = Callable[[DataFrame, str], DataFrame]


def as_is(df: DataFrame, name: str) -> DataFrame:
    return df


def author_stage(raw: DataFrame, variants: DataFrame, creators: DataFrame | None = None, config: LinkConfig = LinkConfig(), keep: Keep = as_is) -> DataFrame:
    """rec, uri, raw, rare, idf_score, score. raw: (rec, ord, raw); variants: (uri, script, ord, variant);
    creators: (rec, raw), the creator fields of records, for reweighting."""
    made = keep(targets(variants, config.conversion_table), "author_targets")
    idf = keep(idf_weights(made), "author_weights")
    cands = keep(candidates(raw, config.conversion_table), "author_candidates")
    pairs = score_pairs(cands, made, idf, config.author_threshold, config.author_idf_scale, config.author_boost, config.rare_idf, config.author_idf or config.creator_fields)
    # The better script; Latin where they tie.
    best = pairs.groupBy("cand", "uri").agg(F.max_by(F.struct("raw", "rare"), F.struct("raw", F.when(F.col("script") == "lat", 1).otherwise(0))).alias("b"))
    best = best.select("cand", "uri", (F.col("b.raw") / 100).alias("raw"), F.col("b.rare").alias("rare"))
    # A name that many records have is dealt out; of its authors, few beside its records, no pieces are made.
    counts = cands.groupBy("cand").agg(F.count(F.lit(1)).alias("n"))
    hits = by_record(pairing.dealt_join(cands, best, ["cand"], "rec", "uri", "cand", counts, counts.select("cand", F.lit(1).alias("n"))), raw.count())
    boosted = F.col("raw") * _boost(F.col("rare"), config.author_idf_scale, config.author_boost)
    first = Window.partitionBy("rec", "uri").orderBy(boosted.desc(), F.col("ord"))
    merged = keep(hits.withColumn("k", F.row_number().over(first)).where("k = 1").select("rec", "uri", "raw", "rare"), "author_pairs")
    merged = merged.withColumn("idf_score", F.col("raw") * _boost(F.col("rare"), config.author_idf_scale, config.author_boost))
    if not (config.creator_fields and creators is not None):
        return merged.withColumn("score", F.col("idf_score"))
    own = creators.select("rec", F.explode(tokens(tx.normalize_for_matching(F.col("raw"), table=config.conversion_table))).alias("token"))
    rows = raw.count()
    own = by_record(own, rows, "token").distinct()
    each = variants.select("uri", "script", "ord", F.explode(tokens(tx.normalize_for_matching(F.col("variant"), camel=True, is_corpus=True, table=config.conversion_table))).alias("token")).distinct()
    rare = each.join(idf.where(F.col("idf") >= config.creator_idf).select("token"), "token")
    sizes = rare.groupBy("uri", "script", "ord").agg(F.count(F.lit(1)).alias("n"))
    rare = rare.join(sizes, ["uri", "script", "ord"])
    count = lambda df: df.groupBy("uri").agg(F.count(F.lit(1)).alias("n"))
    pairs = pairing.dealt_join(merged.select("rec", "uri"), rare, ["uri"], "rec", "token", "uri", count(merged), count(rare))
    met = by_record(by_record(pairs, rows, "token").join(own, ["rec", "token"]), rows).groupBy("rec", "uri", "script", "ord").agg(F.count(F.lit(1)).alias("m"), F.first("n").alias("n"))
    rated = met.withColumn("share", F.col("m") / F.col("n"))
    # The best variant; Latin before Arabic and earlier before later where they tie.
    order = F.struct("share", F.when(F.col("script") == "lat", 1).otherwise(0), -F.col("ord"))
    chosen = rated.groupBy("rec", "uri").agg(F.max_by(F.struct("share", "m"), order).alias("c"))
    full = by_record(merged.join(chosen, ["rec", "uri"], "left"), rows).withColumn("m", F.coalesce("c.m", F.lit(0))).withColumn("creator", F.coalesce("c.share", F.lit(0.0)))
    triggered = F.max("m").over(Window.partitionBy("rec")) > 1
    w = config.creator_weights
    base = F.when(triggered, w[0] * F.col("raw") + w[1] * F.col("creator")).otherwise(F.col("raw"))
    return full.select("rec", "uri", "raw", "rare", "idf_score", (base * _boost(F.col("rare"), config.author_idf_scale, config.author_boost)).alias("score"))


def title_stage(raw: DataFrame, variants: DataFrame, config: LinkConfig = LinkConfig(), keep: Keep = as_is) -> DataFrame:
    """rec, uri, score: for each record and book the best boosted score of any candidate and script."""
    made = keep(targets(variants, config.conversion_table), "title_targets")
    cands = keep(candidates(raw, config.conversion_table), "title_candidates")
    rows = raw.count()
    own = by_record(cands.select("rec", "cand"), rows).distinct()
    pairs = score_pairs(own, made, keep(idf_weights(made), "title_weights"), config.title_threshold, config.title_idf_scale, config.title_boost, config.rare_idf, config.title_idf, ("rec",), rows=rows)
    pairs = pairs.select("rec", "uri", (F.col("raw") * F.col("boost") / 100).alias("score"))
    # Links may be many more than records, so they are grouped only if a record and a book can meet more than once. Equal
    # candidates of a record aren't told apart here: they only make it group what needn't be.
    if by_record(cands.select("rec"), rows).groupBy("rec").count().where("count > 1").isEmpty() and made.groupBy("uri").count().where("count > 1").isEmpty():
        return pairs
    return by_record(pairs, rows).groupBy("rec", "uri").agg(F.max("score").alias("score"))


def each_variant(variants: DataFrame, table: bool = True) -> DataFrame:
    """As ``targets``, but every variant is a target of its own."""
    normal = variants.select("uri", "script", tx.normalize_for_matching(F.col("variant"), camel=True, is_corpus=True, table=table).alias("norm")).where("norm != ''").distinct()
    return normal.select("*", tokens(F.col("norm")).alias("toks"), sim.processed_tokens(F.col("norm")).alias("proc"))


def raw_stage(raw: DataFrame, variants: DataFrame, threshold: float, table: bool = True, keep: Keep = as_is) -> DataFrame:
    """rec, uri, score: the best raw ratio of any candidate and any variant of one script, where it reaches the threshold.
    No weights, no boosts. raw: (rec, script, raw); variants: (uri, script, variant)."""
    cands = raw.select("rec", "script", tx.normalize_for_matching(F.col("raw"), table=table).alias("cand")).where("cand != ''").distinct()
    cands, made = keep(cands, "raw_candidates"), keep(each_variant(variants, table), "raw_targets")
    pairs = score_pairs(cands, made, made.sparkSession.createDataFrame([], "token string, idf double"), threshold, 1.0, 0.0, 0.0, weighted=False)
    best = pairs.groupBy("cand", "script", "uri").agg((F.max("raw") / 100).alias("score"))
    return cands.join(best, ["cand", "script"]).groupBy("rec", "uri").agg(F.max("score").alias("score"))


def raw_matches(authors_raw: DataFrame, author_variants: DataFrame, titles_raw: DataFrame, book_variants: DataFrame, books: DataFrame, author_threshold: float, title_threshold: float, table: bool = True, keep: Keep = as_is) -> DataFrame:
    """rec, book, author, author_score, title_score: books whose author and title both reach their thresholds, by raw ratios.
    Titles are compared only with those of books whose author has reached the threshold: the author is a part of the join's key."""
    authors = keep(raw_stage(authors_raw, author_variants, author_threshold, table, keep).select("rec", F.col("uri").alias("author"), F.col("score").alias("author_score")), "raw_authors")
    owned = books.select(F.col("uri").alias("book"), F.col("author_uri").alias("author"))
    cands = titles_raw.select("rec", "script", tx.normalize_for_matching(F.col("raw"), table=table).alias("cand")).where("cand != ''").distinct().join(authors, "rec")
    made = each_variant(book_variants, table).join(owned.distinct().withColumnRenamed("book", "uri"), "uri")
    cands, made = keep(cands, "title_candidates"), keep(made, "title_targets")
    none = made.sparkSession.createDataFrame([], "token string, idf double")
    pairs = score_pairs(cands, made, none, title_threshold, 1.0, 0.0, 0.0, weighted=False, carry=("rec", "author", "author_score"), within=("script", "author"))
    best = pairs.groupBy("rec", F.col("uri").alias("book"), "author").agg(F.max("author_score").alias("author_score"), (F.max("raw") / 100).alias("title_score"))
    return best.join(owned, ["book", "author"]).select("rec", "book", "author", "author_score", "title_score")


def paired(authors: DataFrame, titles: DataFrame, books: DataFrame, rows: int | None = None) -> DataFrame:
    """rec, author, book, title_score, author_score: pairs that agree in author and title, dealt by record and author if rows tells of how
    many candidates they are."""
    joined = titles.select("rec", F.col("uri").alias("book"), F.col("score").alias("title_score")).join(books.select(F.col("uri").alias("book"), F.col("author_uri").alias("author")), "book")
    owners = authors.select("rec", F.col("uri").alias("author"), F.col("score").alias("author_score"))
    if rows is not None:
        joined, owners = by_record(joined, rows, "author"), by_record(owners, rows, "author")
    return joined.join(owners, ["rec", "author"])


def combined_stage(authors: DataFrame, titles: DataFrame, books: DataFrame, config: LinkConfig = LinkConfig(), rows: int | None = None) -> DataFrame:
    """rec, book, author, author_score, title_score, score, rank: pairs that agree in author and title. rows: how many candidates
    they are of, for dealing them."""
    joined = paired(authors, titles, books, rows)
    fit = joined.where((F.col("author_score") >= config.combined_floor) & (F.col("title_score") >= config.combined_floor) & (F.col("title_score") >= config.title_floor))
    fit = fit if rows is None else by_record(fit, rows)
    rec = Window.partitionBy("rec")
    a, t = F.col("author_score") / F.max("author_score").over(rec), F.col("title_score") / F.max("title_score").over(rec)
    scored = fit.withColumn("score", config.combined_weights[0] * a + config.combined_weights[1] * t).where(F.col("score") >= config.combined_threshold)
    return scored.withColumn("rank", F.row_number().over(rec.orderBy(F.desc("score"), "book"))).select("rec", "book", "author", "author_score", "title_score", "score", "rank")


def _flags(records: DataFrame, authors: DataFrame, titles: DataFrame, combined: DataFrame) -> DataFrame:
    seen = lambda df, name: df.select("rec").distinct().withColumn(name, F.lit(True))
    out = records.select("rec").distinct()
    for df, name in ((authors, "s1"), (titles, "s2"), (combined, "s3")):
        out = out.join(seen(df, name), "rec", "left")
    return out.select("rec", *[F.coalesce(n, F.lit(False)).alias(n) for n in ("s1", "s2", "s3")])


#: In the order of reports.
TIERS = ("high_confidence", "author_only", "title_only", "unmatched")


def classify(records: DataFrame, authors: DataFrame, titles: DataFrame, combined: DataFrame) -> DataFrame:
    """rec, tier: high_confidence, author_only, title_only or unmatched."""
    return _flags(records, authors, titles, combined).select("rec", F.when(F.col("s3"), "high_confidence").when(F.col("s1"), "author_only").when(F.col("s2"), "title_only").otherwise("unmatched").alias("tier"))


def cli_tiers(records: DataFrame, authors: DataFrame, titles: DataFrame, combined: DataFrame) -> DataFrame:
    """rec, tier by the stricter rule of the command line: an author alone leaves a record unmatched."""
    return _flags(records, authors, titles, combined).select("rec", F.when(F.col("s3"), "high_confidence").when(F.col("s1") & F.col("s2"), "author_only").when(F.col("s2"), "title_only").otherwise("unmatched").alias("tier"))


@dataclass
class Linkage:
    """Inputs and results of a run, as tables; a stage reads some and sets others."""

    raw: DataFrame
    author_variants: DataFrame
    book_variants: DataFrame
    books: DataFrame
    creators: DataFrame | None = None
    config: LinkConfig = LinkConfig()
    authors: DataFrame | None = None
    titles: DataFrame | None = None
    combined: DataFrame | None = None
    tiers: DataFrame | None = None
    #: A folder that driver and executors share, in which each stage's result is written, for the next ones to read.
    folder: str | None = None

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """df as written in the folder, if there is one."""
        if not self.folder:
            return df
        df.write.mode("overwrite").parquet(f"{self.folder}/{name}")
        return df.sparkSession.read.schema(df.schema).parquet(f"{self.folder}/{name}")


RESULTS = ("authors", "titles", "combined", "tiers")


class Stage(Protocol):
    def __call__(self, run: Linkage) -> None: ...


def match_authors(run: Linkage) -> None:
    run.authors = author_stage(run.raw, run.author_variants, run.creators, run.config, run.keep)


def match_titles(run: Linkage) -> None:
    run.titles = title_stage(run.raw, run.book_variants, run.config, run.keep)


def combine(run: Linkage) -> None:
    run.combined = combined_stage(run.authors, run.titles, run.books, run.config, run.raw.count())


def tier(run: Linkage) -> None:
    run.tiers = classify(run.raw, run.authors, run.titles, run.combined)


def link(run: Linkage, steps: tuple[Stage | tuple[Stage, ...], ...] = ((match_authors, match_titles), combine, tier)) -> Linkage:
    """Runs the stages, those of one step side by side. With a folder, each result is worked out once, however often
    later stages use it."""

    def write(name: str) -> None:
        setattr(run, name, run.keep(getattr(run, name), name))

    for step in steps:
        before = {name: getattr(run, name) for name in RESULTS}
        stages = step if isinstance(step, tuple) else (step,)
        with ThreadPoolExecutor(len(stages)) as pool:
            list(pool.map(lambda stage: stage(run), stages))
        new = [name for name in RESULTS if getattr(run, name) is not None and getattr(run, name) is not before[name]]
        if run.folder and new:
            with ThreadPoolExecutor(len(new)) as pool:
                list(pool.map(write, new))
    return run
