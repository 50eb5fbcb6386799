"""Evaluation of links against a truth, sweeps over thresholds, and Pareto frontiers.

found: (rec, book, score, rank); truth: (rec, book), book null where no match is expected. A metric is one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import ranks
from .linkage import by_record


def _share(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def _f1(p: Column, r: Column) -> Column:
    return F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))


def _sides(found: DataFrame, truth: DataFrame, by: list[str]) -> DataFrame:
    """Per record of the truth (and per setting in ``by``): returned, expected, hits, null_expected, top_hit."""
    rows = truth.count()
    told = truth.select("rec", "book", F.lit(0).alias("n"), F.lit(0).alias("first"), F.lit(1).alias("told"))
    if by:
        told = told.crossJoin(F.broadcast(found.select(*by).distinct()))  # settings are few by design
    got = found.dropna(subset=["rec", *by]).select("rec", "book", F.lit(1).alias("n"), (F.col("rank") == 1).cast("int").alias("first"), F.lit(0).alias("told"), *by)
    # Both go to the task of their record, once; a join would sort them too.
    met = by_record(told.unionByName(got), rows).groupBy(*by, "rec", "book").agg(F.sum("n").alias("n"), F.max("first").alias("first"), F.max("told").alias("told"))
    right = F.when((F.col("told") == 1) & F.col("book").isNotNull(), 1).otherwise(0)
    out = met.groupBy(*by, "rec").agg(
        F.sum(right).alias("expected"), F.sum("n").alias("returned"), F.sum(F.col("n") * right).alias("hits"), F.coalesce(F.max(F.col("first") * right), F.lit(0)).alias("top_hit"), F.max("told").alias("told")
    )
    return out.where("told = 1").select(*by, "rec", "expected", (F.col("expected") == 0).alias("null_expected"), "returned", "hits", "top_hit")


def pair_metrics(found: DataFrame, truth: DataFrame, by: list[str] | None = None) -> DataFrame:
    """tp, fp, fn, tn over pairs; whatever is returned for a record without an expected match is a false positive."""
    s = _sides(found, truth, by or [])
    out = s.groupBy(*(by or [])).agg(F.sum("hits").alias("tp"), F.sum(F.col("returned") - F.col("hits")).alias("fp"), F.sum(F.col("expected") - F.col("hits")).alias("fn"), F.sum(F.when(F.col("null_expected") & (F.col("returned") == 0), 1).otherwise(0)).alias("tn"))
    p, r = _share(F.col("tp"), F.col("tp") + F.col("fp")), _share(F.col("tp"), F.col("tp") + F.col("fn"))
    return out.select("*", p.alias("precision"), r.alias("recall"), _f1(p, r).alias("f1"))


def candidate_metrics(found: DataFrame, truth: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Records with their match over all candidates (precision) and over all records (recall)."""
    s = _sides(found, truth, by or []).where(~F.col("null_expected"))
    out = s.groupBy(*(by or [])).agg(F.sum(F.when(F.col("hits") > 0, 1).otherwise(0)).alias("correct"), F.sum("returned").alias("candidates"), F.count(F.lit(1)).alias("records"))
    p, r = _share(F.col("correct"), F.col("candidates")), _share(F.col("correct"), F.col("records"))
    return out.select("*", p.alias("precision"), r.alias("recall"), _f1(p, r).alias("f1"))


def found_any_metrics(found: DataFrame, truth: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Recall: records of which any match is found. Precision: candidates that are expected."""
    s = _sides(found, truth, by or []).where(~F.col("null_expected"))
    out = s.groupBy(*(by or [])).agg(F.sum(F.when(F.col("hits") > 0, 1).otherwise(0)).alias("correct"), F.sum("returned").alias("matched"), F.sum(F.col("returned") - F.col("hits")).alias("extra"), F.count(F.lit(1)).alias("records"))
    p, r = _share(F.col("matched") - F.col("extra"), F.col("matched")), _share(F.col("correct"), F.col("records"))
    return out.select("*", p.alias("precision"), r.alias("recall"), _f1(p, r).alias("f1"))


def ranked_metrics(found: DataFrame, truth: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Global and mean precision by record, how often the first match is right, and records with wrong ones."""
    s = _sides(found, truth, by or []).where(~F.col("null_expected"))
    some = F.col("returned") > 0
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    out = s.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("total_records"),
        F.sum("returned").alias("total_candidates"),
        F.sum("hits").alias("correct_total"),
        count(some & (F.col("returned") > F.col("hits"))).alias("fp_count"),
        F.sum("top_hit").alias("perfect_count"),
        count(~some).alias("records_no_match"),
        F.coalesce(F.avg(F.when(some, F.col("hits") / F.col("returned"))), F.lit(0.0)).alias("mean_per_record_precision"),
    )
    return out.select("*", _share(F.col("correct_total"), F.col("total_candidates")).alias("global_precision"), _share(F.col("perfect_count"), F.col("total_records")).alias("best_match_accuracy"), _share(F.col("fp_count"), F.col("total_records") - F.col("records_no_match")).alias("fp_rate"))


def record_metrics(found: DataFrame, truth: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Records found over those and all extra matches (precision), and over all records (recall)."""
    s = _sides(found, truth, by or []).where(~F.col("null_expected"))
    out = s.groupBy(*(by or [])).agg(F.sum(F.when(F.col("hits") > 0, 1).otherwise(0)).alias("correct"), F.sum(F.col("returned") - F.col("hits")).alias("extra"), F.count(F.lit(1)).alias("records"))
    return out.select("*", _share(F.col("correct"), F.col("correct") + F.col("extra")).alias("precision"), _share(F.col("correct"), F.col("records")).alias("recall"))


def sweep(scored: DataFrame, truth: DataFrame, settings: DataFrame, by: str | None = None) -> DataFrame:
    """found_any_metrics at each setting (author_threshold, title_threshold) that returns anything, from one table of scored pairs
    (rec, book, author_score, title_score); by: a column that tells variants of the scores apart.

    Settings are a small grid, chosen by hand. A pair counts at all settings up to the highest thresholds that it reaches,
    so pairs are counted once by these two (a two-dimensional histogram), and sums from the top give every setting: the
    work doesn't grow with the number of settings. A record with several expected books counts once where any of them
    does: the steps of its best pairs count, less the corners in which neighbours overlap.

    scored may say by a column ``hit`` whether a pair is expected; then all its records must be ones of which a book is, and
    pairs aren't joined with the truth. A column ``n`` beside it says how many pairs a row counts for: pairs that were counted
    already need no record, and hits among them come as rows of their own with an n of 0."""
    grid = [(r[0], r[1]) for r in settings.select("author_threshold", "title_threshold").distinct().collect()]
    axes = [sorted({g[i] for g in grid}) for i in (0, 1)]
    keys = [by] if by else []
    reached = lambda c, axis: F.size(F.filter(F.array(*[F.lit(float(t)) for t in axis]), lambda t: t <= F.col(c)))
    expected, rows = truth.where("rec IS NOT NULL AND book IS NOT NULL").select("rec", "book"), truth.count()
    judged = by_record(truth.where("book IS NOT NULL").select("rec"), rows).distinct()  # none is expected of others
    places = (reached("author_score", axes[0]).alias("a"), reached("title_score", axes[1]).alias("t"))
    counted = ("n",) if "n" in scored.columns else ()
    if "hit" in scored.columns:
        # Pairs that aren't hits need no record, so they are as many rows as the grid has cells, and so many leave each task.
        marked = scored.select(*keys, F.when(F.col("hit"), F.col("rec")).alias("rec"), F.col("hit").cast("int").alias("hit"), *counted, *places).where("a > 0 AND t > 0")
    else:
        # Dealt by record and book, then by record, where a record's pairs stay until they are counted.
        right = by_record(expected, rows, "book").distinct().withColumn("hit", F.lit(1))
        placed = by_record(scored.select(*keys, "rec", "book", *places).where("a > 0 AND t > 0"), rows, "book")
        marked = by_record(placed.join(right, ["rec", "book"], "left").select(*keys, "rec", F.coalesce("hit", F.lit(0)).alias("hit"), "a", "t"), rows).join(judged, "rec", "left_semi")
    cells = marked.groupBy(*keys, "rec", "a", "t").agg((F.sum("n") if counted else F.count(F.lit(1))).alias("matched"), F.sum("hit").alias("hits"))
    each = cells.groupBy(*keys, "rec").agg(F.collect_list(F.struct("a", "t", "matched", "hits")).alias("all"))
    # A record's hits by falling a; those that reach no higher t than an earlier one add nothing.
    steps = F.sort_array(F.transform(F.filter("all", lambda x: x["hits"] > 0), lambda x: F.struct(x["a"].alias("a"), x["t"].alias("t"))), asc=False)
    top = lambda s, i: F.array_max(F.concat(F.transform(F.slice(s, F.lit(1), i), lambda x: x["t"]), F.array(F.lit(0))))
    front = F.filter("s", lambda x, i: x["t"] > top(F.col("s"), i))
    zero = F.lit(0).cast("long")
    mark = lambda a, t, c: F.struct(a.alias("a"), t.alias("t"), zero.alias("matched"), zero.alias("hits"), F.lit(c).alias("correct"))
    inner = F.transform("f", lambda x, i: mark(x["a"], F.get("f", i - 1)["t"], -1))
    told = F.transform("all", lambda x: F.struct(x["a"].alias("a"), x["t"].alias("t"), x["matched"].alias("matched"), x["hits"].alias("hits"), F.lit(0).alias("correct")))
    every = F.concat(told, F.transform("f", lambda x: mark(x["a"], x["t"], 1)), F.slice(inner, F.lit(2), F.greatest(F.size("f") - 1, F.lit(0))))
    marks = each.withColumn("s", steps).withColumn("f", front).select(*keys, F.inline(every))
    table = marks.groupBy(*keys, "a", "t").agg(*[F.sum(c).alias(c) for c in ("matched", "hits", "correct")])  # as many rows as the grid has cells
    at = scored.sparkSession.createDataFrame([(x, y, axes[0].index(x) + 1, axes[1].index(y) + 1) for x, y in grid], "author_threshold double, title_threshold double, ga int, gt int")
    summed = table.join(F.broadcast(at), (F.col("a") >= F.col("ga")) & (F.col("t") >= F.col("gt"))).groupBy(*keys, "author_threshold", "title_threshold")
    out = summed.agg(F.sum("correct").alias("correct"), F.sum("matched").alias("matched"), (F.sum("matched") - F.sum("hits")).alias("extra")).where("matched > 0")
    out = out.crossJoin(F.broadcast(judged.agg(F.count(F.lit(1)).alias("records"))))  # one row
    p, r = _share(F.col("matched") - F.col("extra"), F.col("matched")), _share(F.col("correct"), F.col("records"))
    return out.select("*", p.alias("precision"), r.alias("recall"), _f1(p, r).alias("f1"))


def boosted(pairs: DataFrame, variants: DataFrame) -> DataFrame:
    """(label, rec, book, author_score, title_score): the scores under each variant of scale and boost, from stored raw scores and sums
    of weights. pairs: (rec, book, author_raw, author_rare, title_raw, title_comb), raw of 0..1; variants, few by design:
    (label, author_scale, author_boost, title_scale, title_boost), a boost of 0 for no weights. Columns ``hit`` and ``n`` stay."""
    score = lambda raw, w, side: F.col(raw) * (1 + F.least(F.col(w) / F.col(f"{side}_scale"), F.col(f"{side}_boost")))
    every = pairs.crossJoin(F.broadcast(variants))
    return every.select("label", "rec", "book", score("author_raw", "author_rare", "author").alias("author_score"), score("title_raw", "title_comb", "title").alias("title_score"), *[c for c in ("hit", "n") if c in pairs.columns])


def pareto(results: DataFrame, key: list[str], a: str = "precision", b: str = "recall", least_b: float = 0.90) -> DataFrame:
    """Results that no other beats: none is at least as good in both and better in one. One window over distinct
    values of b, best first, instead of comparing all pairs."""
    fit = results.where(F.col(b) >= least_b)
    best = fit.groupBy(b).agg(F.max(a).alias("__a"))
    # The best a among larger b, through a running maximum over distinct values of b.
    above = best.withColumn("__above", F.max("__a").over(Window.orderBy(F.desc(b)).rowsBetween(Window.unboundedPreceding, -1)))
    return fit.join(above, b).where((F.col(a) == F.col("__a")) & (F.col("__above").isNull() | (F.col(a) > F.col("__above")))).select(*results.columns)


def label_means(results: DataFrame, label: str = "idf_label") -> DataFrame:
    return results.groupBy(label).agg(F.avg("precision").alias("mean_precision"), F.avg("recall").alias("mean_recall"), F.avg("f1").alias("mean_f1"), F.max("f1").alias("max_f1"))


def idf_percentiles(idf: DataFrame, percents: tuple[int, ...] = (10, 25, 50, 75, 90, 95, 99), ranges: int = ranks.RANGES) -> DataFrame:
    """percent, idf: the value at place floor(n p / 100) of all values in order. Equal values are counted, not sorted."""
    counts = idf.groupBy("idf").agg(F.count(F.lit(1)).alias("c"))
    each = ranks.running(counts, "idf", "c", ranges).withColumn("percent", F.explode(F.array(*[F.lit(p) for p in percents])))
    at = F.floor(F.col("total") * F.col("percent") / 100)
    return each.where((at >= F.col("before")) & (at < F.col("before") + F.col("c"))).select("percent", "idf")


def idf_over(idf: DataFrame, thresholds: tuple[float, ...] = (1.0, 1.5, 2.0, 2.5, 3.0, 3.5, 4.0, 4.5, 5.0)) -> DataFrame:
    """threshold, tokens: how many tokens have at least that weight."""
    counted = idf.agg(*[F.count_if(F.col("idf") >= t).alias(str(i)) for i, t in enumerate(thresholds)])
    return counted.select(F.inline(F.array(*[F.struct(F.lit(t).alias("threshold"), F.col(f"`{i}`").alias("tokens")) for i, t in enumerate(thresholds)])))


def stage_report(records: DataFrame, stages: dict[str, DataFrame], truth: DataFrame) -> DataFrame:
    """Per record and stage: how many books or authors it found, and whether an expected one is among them."""
    out = records.select("rec").distinct()
    for name, df in stages.items():
        marked = df.select("rec", "book").join(truth.select("rec", "book", F.lit(True).alias("hit")), ["rec", "book"], "left")
        out = out.join(marked.groupBy("rec").agg(F.count(F.lit(1)).alias(f"{name}_count"), F.coalesce(F.bool_or("hit"), F.lit(False)).alias(f"{name}_hit")), "rec", "left")
    return out.fillna(0, [f"{n}_count" for n in stages]).fillna(False, [f"{n}_hit" for n in stages])
