"""The engine's registered queries and, for each that SQL can express, the same query in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import LinkConfig
from ..functions import similarity as sim
from ..functions import text as tx
from ..operators import candidates as cd
from ..operators import evaluate as ev
from ..operators import exports
from ..operators import linkage as lk
from ..operators import merge, sampling, segment, stats, survey
from ..sources import sinks
from ..streaming import incremental
from . import match_catalog, source_catalog
from .proxies import CONFIG, lcs_sql, linkage, linkage_sql, ratio_sql, set_ratio_sql, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**source_catalog.QUERIES, **match_catalog.QUERIES}
ORACLES: dict[str, str] = {**source_catalog.ORACLES, **match_catalog.ORACLES}
FLAGSHIP = "combined_match"


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL if there is any."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


LAT = tx.LATIN
NORM = "trim(regexp_replace(regexp_replace(lower(strip_accents({})), '-+', ' ', 'g'), '\\s+', ' ', 'g'))"
SENTENCES = r"(SELECT doc_id, unnest(string_split(text, chr(10))) AS raw FROM documents)"


def _elements(s: SparkSession, d: str) -> DataFrame:
    """Conversations as a catalogue: conversation = record, role = field, turn = element."""
    return table(s, d, "conversations").select(F.col("conv_id").alias("rec"), F.col("role").alias("field"), F.col("turn").cast("int").alias("ord"), "text")


def _lines(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("raw"))


# Text functions


@query("SELECT doc_id, md5(strip_accents(text)) AS folded FROM documents")
def norm_fold(s, d):
    return table(s, d, "documents").select("doc_id", F.md5(tx.fold_accents(F.col("text"))).alias("folded"))


@query(f"SELECT p_partkey, {NORM.format("replace(replace(p_name || ' Ibn-' || p_type, 'C', 'ʿ'), 'c', 'ʿ')")} AS norm FROM part")
def norm_match(s, d):
    return table(s, d, "part").select("p_partkey", tx.normalize_for_matching(F.concat("p_name", F.lit(" Ibn-"), "p_type"), is_corpus=True).alias("norm"))


@query("SELECT p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda x: upper(x[1]) || x[2:]), '|') AS words FROM part")
def camel_split(s, d):
    return table(s, d, "part").select("p_partkey", F.array_join(tx.split_camel(F.replace(F.initcap("p_name"), F.lit(" "), F.lit(""))), "|").alias("words"))


@query("SELECT p_partkey, replace(replace(lower(p_name), 'c', 'ʿ'), ' ', '|') AS words FROM part")
def slug_tokens(s, d):
    return table(s, d, "part").select("p_partkey", F.array_join(tx.slug_tokens(F.replace(F.initcap("p_name"), F.lit(" "), F.lit(""))), "|").alias("words"))


@query(f"SELECT doc_id, len(t)::INT AS n, md5(array_to_string(t, ' ')) AS tokens FROM (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[{LAT}]+|\\p{{Nd}}+'), lambda x: length(x) >= 2) AS t FROM documents)")
def tok_lat(s, d):
    t = tx.tokens_lat(F.col("text"))
    return table(s, d, "documents").select("doc_id", F.size(t).alias("n"), F.md5(F.array_join(t, " ")).alias("tokens"))


@query()
def tok_abbrev(s, d):
    t = tx.tokens_lat(F.col("text"), True)
    return table(s, d, "documents").select("doc_id", F.size(t).alias("n"), F.md5(F.array_join(t, " ")).alias("tokens"))


@query(f"SELECT doc_id, len(list_filter(regexp_extract_all(lower(text), '[{LAT}]+|\\p{{Nd}}+'), lambda x: length(x) >= 2 AND NOT regexp_matches(x, '^\\p{{Nd}}+$')))::INT AS n FROM documents")
def digit_filter(s, d):
    return table(s, d, "documents").select("doc_id", F.size(tx.no_digits(tx.tokens_lat(F.col("text")))).alias("n"))


@query()
def token_spans(s, d):
    spans = tx.token_spans(F.col("text"))
    return table(s, d, "documents").select("doc_id", F.size(spans).alias("n"), F.try_element_at(spans, F.lit(-1))["end"].alias("last_end"))


@query(f"SELECT lang, count(*) FILTER (regexp_matches(text, '[{tx.ARABIC}]')) AS arabic, count(*) FILTER (regexp_matches(text, '[A-Za-z]')) AS latin, count(*) AS docs FROM documents GROUP BY lang")
def script_profile(s, d):
    t = F.coalesce("text", F.lit(""))
    return table(s, d, "documents").groupBy("lang").agg(F.count_if(tx.has_arabic(t)).alias("arabic"), F.count_if(tx.has_latin(t)).alias("latin"), F.count(F.lit(1)).alias("docs"))


@query("SELECT character, printf('U+%04X', unicode(character)) AS code, count(*) AS count FROM (SELECT unnest(string_split(text, '')) AS character FROM documents) WHERE unicode(character) > 127 GROUP BY character")
def char_inventory(s, d):
    return survey.characters(table(s, d, "documents"))


@query("SELECT page_id, trim(regexp_extract(html, '<title>([^<]*)</title>', 1)) AS title, len(regexp_extract_all(html, '<li>'))::INT AS items FROM pages")
def html_fields(s, d):
    return table(s, d, "pages").select("page_id", F.trim(F.regexp_extract("html", "<title>([^<]*)</title>", 1)).alias("title"), F.size(F.regexp_extract_all("html", F.lit("<li>"), F.lit(0))).alias("items"))


# Surveys

TOKENS = f"list_filter(regexp_extract_all(lower(string_agg(text, ' ' ORDER BY turn, text)), '[{LAT}]+|\\p{{Nd}}+'), lambda x: length(x) >= 2)"
GRAMS = f"""w AS (SELECT conv_id AS rec, role AS field, {TOKENS} AS w FROM conversations GROUP BY ALL),
g AS (SELECT rec, field, n::INT AS n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS ngram FROM (SELECT rec, field, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM w, (SELECT unnest([2, 3, 4]) AS n) WHERE len(w) >= n)),
c AS (SELECT field, n, ngram, sum(c)::BIGINT AS term_freq, count(*) AS doc_freq FROM (SELECT rec, field, n, ngram, count(*) AS c FROM g GROUP BY ALL) GROUP BY ALL)"""


@query(f"WITH {GRAMS} SELECT * FROM c")
def ngram_tf_df(s, d):
    return survey.ngram_counts(_elements(s, d))


@query(f"WITH {GRAMS} SELECT field, ngram FROM c WHERE 100 * doc_freq >= 5 * (SELECT count(DISTINCT conv_id) FROM conversations) AND term_freq <= 1.4 * doc_freq")
def boilerplate_over(s, d):
    e = _elements(s, d)
    return survey.boilerplate_over(survey.ngram_counts(e), e.select("rec").distinct().count())


@query(f"""WITH {GRAMS}, t AS (SELECT *, round(term_freq * ln((SELECT count(DISTINCT conv_id) FROM conversations) / doc_freq), 3) AS tfidf FROM c),
r AS (SELECT ranking, field, n, ngram, row_number() OVER (PARTITION BY ranking, field, n ORDER BY CASE ranking WHEN 'doc_freq' THEN doc_freq::DOUBLE WHEN 'term_freq' THEN term_freq::DOUBLE ELSE tfidf END DESC, ngram) AS place, doc_freq, term_freq, tfidf FROM t, (SELECT unnest(['doc_freq', 'term_freq', 'tfidf']) AS ranking))
SELECT ranking, field, n, place::INT AS place, ngram, doc_freq, term_freq, tfidf FROM r WHERE place <= 20""")
def ngram_report(s, d):
    e = _elements(s, d)
    return survey.top_ngrams(survey.tfidf(survey.ngram_counts(e), e))


@query(f"WITH {GRAMS} SELECT *, round(term_freq * ln((SELECT count(DISTINCT conv_id) FROM conversations) / doc_freq), 3) AS tfidf FROM c")
def ngram_tfidf(s, d):
    e = _elements(s, d)
    return survey.tfidf(survey.ngram_counts(e), e)


@query(f"""WITH {GRAMS}, p AS (SELECT *, round(100 * doc_freq / (SELECT count(DISTINCT conv_id) FROM conversations), 2) AS doc_freq_pct, round(term_freq / doc_freq, 3) AS repeats_per_doc FROM c)
SELECT field, ngram, n, doc_freq_pct, repeats_per_doc FROM p WHERE doc_freq_pct >= 5 AND (field = 'assistant' OR repeats_per_doc <= 1.4)""")
def boilerplate_suggest(s, d):
    e = _elements(s, d)
    settings = s.createDataFrame([("user", "full", 5.0, 1.4), ("system", "full", 5.0, 1.4), ("assistant", "freq_only", 5.0, 0.0)], "field string, strategy string, min_doc_freq_pct double, max_repeats_per_doc double")
    return survey.suggest_boilerplate(survey.ngram_counts(e), e, settings)


@query(f"""WITH e AS (SELECT role AS field, conv_id AS rec, count(*) AS c, count(*) FILTER (regexp_matches(text, '[{tx.ARABIC}]') AND NOT regexp_matches(text, '[A-Za-z]')) AS a,
  count(*) FILTER (regexp_matches(text, '[A-Za-z]') AND NOT regexp_matches(text, '[{tx.ARABIC}]')) AS l, count(*) FILTER (regexp_matches(text, '[A-Za-z]') AND regexp_matches(text, '[{tx.ARABIC}]')) AS m,
  count(*) FILTER (NOT regexp_matches(text, '[A-Za-z]') AND NOT regexp_matches(text, '[{tx.ARABIC}]')) AS n FROM conversations GROUP BY ALL)
SELECT field, count(*) AS records_present, round(100 * count(*) / (SELECT count(DISTINCT conv_id) FROM conversations), 2) AS coverage_pct, max(c) = 1 AS always_single, min(c) AS min_per_record, max(c) AS max_per_record,
  round(avg(c), 3) AS avg_per_record, round(100 * sum(a) / sum(c), 2) AS arabic_only_pct, round(100 * sum(l) / sum(c), 2) AS latin_only_pct, round(100 * sum(m) / sum(c), 2) AS mixed_pct, round(100 * sum(n) / sum(c), 2) AS empty_pct FROM e GROUP BY field""")
def field_coverage(s, d):
    e = _elements(s, d)
    return survey.coverage(e, e.select("rec").distinct().count())


@query("""SELECT role AS field, array_to_string(list(t ORDER BY conv_id, turn), '|') AS samples FROM (SELECT role, conv_id, turn, left(text, 140) AS t, row_number() OVER (PARTITION BY role ORDER BY conv_id, turn) AS k FROM conversations) WHERE k <= 5 GROUP BY role""")
def field_samples(s, d):
    return survey.samples(_elements(s, d)).select("field", F.array_join("samples", "|").alias("samples"))


# Candidates and similarity


@query(f"SELECT cand_norm, doc_id // 4096 AS part, array_to_string(list_sort(list(DISTINCT doc_id)), ',') AS rec_ids FROM (SELECT doc_id, {NORM.format('raw')} AS cand_norm FROM {SENTENCES}) WHERE cand_norm <> '' GROUP BY ALL")
def candidate_index(s, d):
    """No row has more than 4,096 ids."""
    return cd.candidate_index(_lines(s, d), "doc_id", part=F.floor(F.col("rec") / 4096)).select("cand_norm", "part", F.array_join(F.transform("rec_ids", lambda x: x.cast("string")), ",").alias("rec_ids"))


@query(f"SELECT count(DISTINCT cand_norm) AS candidates, count(*) AS uses FROM (SELECT DISTINCT doc_id, {NORM.format('raw')} AS cand_norm FROM {SENTENCES}) WHERE cand_norm <> ''")
def candidate_fanout(s, d):
    return cd.fanout(cd.candidate_uses(_lines(s, d), "doc_id"))


IDF = f"""t AS (SELECT item_id, {NORM.format("replace(replace(regexp_replace(text, '([a-z])([A-Z])', '\\1 \\2', 'g'), 'C', 'ʿ'), 'c', 'ʿ')")} AS norm FROM benchmark),
f AS (SELECT token, count(DISTINCT item_id) AS df FROM (SELECT item_id, unnest(string_split(norm, ' ')) AS token FROM t WHERE norm <> '') GROUP BY token),
i AS (SELECT token, df, ln(1 + (SELECT count(DISTINCT item_id) FROM t WHERE norm <> '') / df) AS idf FROM f)"""


def _idf(s: SparkSession, d: str) -> DataFrame:
    v = table(s, d, "benchmark").select(F.col("item_id").alias("uri"), F.lit("lat").alias("script"), F.lit(0).alias("ord"), F.col("text").alias("variant"))
    return lk.idf_weights(lk.targets(v))


@query(f"WITH {IDF} SELECT token, df, round(idf, 6) AS idf FROM i")
def token_idf(s, d):
    return _idf(s, d).select("token", "df", F.round("idf", 6).alias("idf"))


@query(f"""WITH {IDF}, o AS (SELECT idf, row_number() OVER (ORDER BY idf) - 1 AS k, count(*) OVER () AS n FROM i)
SELECT p::INT AS percent, round(idf, 6) AS idf FROM o JOIN (SELECT unnest([10, 25, 50, 75, 90, 95, 99]) AS p) ON k = (n * p) // 100""")
def idf_percentiles(s, d):
    return ev.idf_percentiles(_idf(s, d)).select("percent", F.round("idf", 6).alias("idf"))


NAMES = "(SELECT a.n AS a, b.n AS b FROM (SELECT DISTINCT p_name AS n FROM part) a, (SELECT DISTINCT p_name AS n FROM part) b)"


def _name_pairs(s: SparkSession, d: str) -> DataFrame:
    """All pairs of the distinct part names, of which there are 64 at any size."""
    n = table(s, d, "part").select("p_name").distinct()
    return n.select(F.col("p_name").alias("a")).crossJoin(n.select(F.col("p_name").alias("b")))


@query(f"SELECT a, b, {lcs_sql('a', 'b')}::INT AS lcs, {ratio_sql('a', 'b')} AS ratio FROM {NAMES}")
def indel_ratio(s, d):
    return _name_pairs(s, d).select("a", "b", sim.lcs("a", "b").alias("lcs"), sim.ratio(F.col("a"), F.col("b")).alias("ratio"))


@query(f"SELECT a, b, {lcs_sql('a', 'b')}::INT AS lcs FROM {NAMES}")
def lcs_builtin(s, d):
    return _name_pairs(s, d).select("a", "b", sim.lcs_native(F.col("a"), F.col("b")).alias("lcs"))


@query(f"SELECT a, b, raw FROM {set_ratio_sql(f"(SELECT a, b, list_sort(list_distinct(string_split(a, ' '))) AS x1, list_sort(list_distinct(string_split(b, ' '))) AS y1 FROM {NAMES})", 'x1', 'y1', 'a, b')}")
def token_set_ratio(s, d):
    return _name_pairs(s, d).select("a", "b", sim.token_set_ratio(F.col("a"), F.col("b")).alias("raw"))


# Linkage


def _linked(s: SparkSession, d: str) -> lk.Linkage:
    run = linkage(s, d)
    run.folder = source_catalog.folder(s, "linkage")
    lk.link(run, ((lk.match_authors, lk.match_titles), lk.combine))
    lk.tier(run)  # read at most once by a query, so not written
    return run


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


PLAIN = LinkConfig(rare_idf=CONFIG.rare_idf, creator_fields=False)


@query(f"WITH {linkage_sql()} SELECT rec, uri, round(raw, 6) AS raw, round(rare, 6) AS rare, round(idf_score, 6) AS idf_score, round(idf_score, 6) AS score FROM ga")
def author_match(s, d):
    run = linkage(s, d, PLAIN)
    lk.match_authors(run)
    return _rounded(run.authors)


@query(f"WITH {linkage_sql()} SELECT rec, uri, round(raw, 6) AS raw, round(rare, 6) AS rare, round(idf_score, 6) AS idf_score, round(score, 6) AS score FROM s1")
def creator_reweight(s, d):
    run = linkage(s, d)
    run.folder = source_catalog.folder(s, "linkage")
    lk.match_authors(run)
    return _rounded(run.authors)


@query(f"WITH {linkage_sql()} SELECT rec, uri, round(score, 6) AS score FROM s2")
def title_match(s, d):
    run = linkage(s, d)
    lk.match_titles(run)
    return _rounded(run.titles)


@query(f"WITH {linkage_sql()} SELECT rec, book, author, round(author_score, 6) AS author_score, round(title_score, 6) AS title_score, round(score, 6) AS score, rank FROM s3")
def combined_match(s, d):
    return _rounded(_linked(s, d).combined)


TIER = "SELECT r.rec, CASE WHEN r.rec IN (SELECT rec FROM s3) THEN 'high_confidence' WHEN {} THEN 'author_only' WHEN r.rec IN (SELECT rec FROM s2) THEN 'title_only' ELSE 'unmatched' END AS tier FROM r"


@query(f"WITH {linkage_sql()} {TIER.format('r.rec IN (SELECT rec FROM s1)')}")
def tiers(s, d):
    return _linked(s, d).tiers


@query(f"WITH {linkage_sql()} {TIER.format('r.rec IN (SELECT rec FROM s1) AND r.rec IN (SELECT rec FROM s2)')}")
def tiers_cli(s, d):
    run = _linked(s, d)
    return lk.cli_tiers(run.raw, run.authors, run.titles, run.combined)


@query(f"WITH {linkage_sql()} SELECT tier, count(*) AS records FROM ({TIER.format('r.rec IN (SELECT rec FROM s1)')}) GROUP BY tier")
def tier_counts(s, d):
    return stats.tier_counts(_linked(s, d).tiers)


@query(f"WITH {linkage_sql()} SELECT rec, book, round(score, 6) AS score, rank FROM s3 WHERE rank <= 1")
def first_matches(s, d):
    found = _linked(s, d).combined
    return _rounded(stats.first_matches(found, 1, found.count())).select("rec", "book", "score", "rank")


# Evaluation: the truth is each record's own name, but for every seventh record, of which none is expected.

TRUTH = "t AS (SELECT p_partkey AS rec, CASE WHEN p_partkey % 7 <> 0 THEN replace(lower(p_name), ' ', '_') END AS book FROM part)"
SIDES = f"""WITH {linkage_sql()}, {TRUTH},
x AS (SELECT t.rec, t.book IS NULL AS null_expected, (t.book IS NOT NULL)::INT AS expected, count(s3.book) AS returned, count(*) FILTER (s3.book = t.book) AS hits, count(*) FILTER (s3.book = t.book AND rank = 1) AS top_hit FROM t LEFT JOIN s3 USING (rec) GROUP BY ALL)"""
P = "CASE WHEN {0} + {1} > 0 THEN {0} / ({0} + {1}) ELSE 0 END"
F1 = "CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1"


def _truth(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "part").select(F.col("p_partkey").alias("rec"), F.when(F.col("p_partkey") % 7 != 0, F.replace(F.lower("p_name"), F.lit(" "), F.lit("_"))).alias("book"))


@query(f"{SIDES}, y AS (SELECT sum(hits)::BIGINT AS tp, sum(returned - hits)::BIGINT AS fp, sum(expected - hits)::BIGINT AS fn, count(*) FILTER (null_expected AND returned = 0) AS tn FROM x), z AS (SELECT *, {P.format('tp', 'fp')} AS precision, {P.format('tp', 'fn')} AS recall FROM y) SELECT *, {F1} FROM z")
def eval_pairs(s, d):
    return ev.pair_metrics(_linked(s, d).combined, _truth(s, d))


@query(f"{SIDES}, y AS (SELECT count(*) FILTER (hits > 0) AS correct, sum(returned)::BIGINT AS candidates, count(*) AS records FROM x WHERE NOT null_expected), z AS (SELECT *, coalesce(correct / nullif(candidates, 0), 0) AS precision, coalesce(correct / nullif(records, 0), 0) AS recall FROM y) SELECT *, {F1} FROM z")
def eval_candidates(s, d):
    return ev.candidate_metrics(_linked(s, d).combined, _truth(s, d))


@query(f"{SIDES}, y AS (SELECT count(*) FILTER (hits > 0) AS correct, sum(returned)::BIGINT AS matched, sum(returned - hits)::BIGINT AS extra, count(*) AS records FROM x WHERE NOT null_expected), z AS (SELECT *, coalesce((matched - extra) / nullif(matched, 0), 0) AS precision, coalesce(correct / nullif(records, 0), 0) AS recall FROM y) SELECT *, {F1} FROM z")
def eval_found_any(s, d):
    return ev.found_any_metrics(_linked(s, d).combined, _truth(s, d))


@query(f"""{SIDES}, y AS (SELECT count(*) AS total_records, sum(returned)::BIGINT AS total_candidates, sum(hits)::BIGINT AS correct_total, count(*) FILTER (returned > hits) AS fp_count, sum(top_hit)::BIGINT AS perfect_count, count(*) FILTER (returned = 0) AS records_no_match,
  round(coalesce(avg(hits / returned) FILTER (returned > 0), 0), 6) AS mean_per_record_precision FROM x WHERE NOT null_expected)
SELECT *, coalesce(correct_total / nullif(total_candidates, 0), 0) AS global_precision, coalesce(perfect_count / nullif(total_records, 0), 0) AS best_match_accuracy, coalesce(fp_count / nullif(total_records - records_no_match, 0), 0) AS fp_rate FROM y""")
def eval_ranked(s, d):
    return ev.ranked_metrics(_linked(s, d).combined, _truth(s, d)).withColumn("mean_per_record_precision", F.round("mean_per_record_precision", 6))


@query(f"{SIDES} SELECT count(*) FILTER (hits > 0) AS correct, sum(returned - hits)::BIGINT AS extra, count(*) AS records, coalesce(count(*) FILTER (hits > 0) / nullif(count(*) FILTER (hits > 0) + sum(returned - hits), 0), 0) AS precision, count(*) FILTER (hits > 0) / count(*) AS recall FROM x WHERE NOT null_expected")
def eval_records(s, d):
    return ev.record_metrics(_linked(s, d).combined, _truth(s, d))


GRID = [(a, t) for a in (0.8, 0.9, 1.0) for t in (0.85, 0.95, 1.1)]
SWEEP = f"""WITH {linkage_sql()}, {TRUTH}, p AS (SELECT s2.rec, s2.uri AS book, s1.score AS a, s2.score AS t FROM s2 JOIN tt USING (uri) JOIN s1 ON s1.rec = s2.rec AND s1.uri = tt.author),
grid AS (SELECT * FROM (VALUES {", ".join(f"({a}::DOUBLE, {t}::DOUBLE)" for a, t in GRID)}) g(author_threshold, title_threshold)),
x AS (SELECT author_threshold, title_threshold, t.rec, count(p.book) AS returned, count(*) FILTER (p.book = t.book) AS hits FROM grid CROSS JOIN t LEFT JOIN p ON p.rec = t.rec AND p.a >= author_threshold AND p.t >= title_threshold WHERE t.book IS NOT NULL GROUP BY ALL),
y AS (SELECT author_threshold, title_threshold, count(*) FILTER (hits > 0) AS correct, sum(returned)::BIGINT AS matched, sum(returned - hits)::BIGINT AS extra, count(*) AS records FROM x GROUP BY ALL HAVING sum(returned) > 0),
z AS (SELECT *, (matched - extra) / matched AS precision, correct / records AS recall FROM y), w AS (SELECT *, {F1} FROM z)"""


def _sweep(s: SparkSession, d: str) -> DataFrame:
    run = _linked(s, d)
    scored = lk.paired(run.authors, run.titles, run.books, run.raw.count())
    return ev.sweep(scored, _truth(s, d), s.createDataFrame(GRID, "author_threshold double, title_threshold double"))


@query(f"{SWEEP} SELECT * FROM w")
def sweep_thresholds(s, d):
    return _sweep(s, d)


@query(f"{SWEEP}, q AS (SELECT * FROM w WHERE recall >= 0.5) SELECT * FROM q WHERE NOT EXISTS (SELECT 1 FROM q o WHERE o.precision >= q.precision AND o.recall >= q.recall AND (o.precision > q.precision OR o.recall > q.recall))")
def pareto(s, d):
    return ev.pareto(_sweep(s, d), ["author_threshold", "title_threshold"], least_b=0.5)


@query(f"{SWEEP} SELECT author_threshold AS idf_label, round(avg(precision), 6) AS mean_precision, round(avg(recall), 6) AS mean_recall, round(avg(f1), 6) AS mean_f1, round(max(f1), 6) AS max_f1 FROM w GROUP BY author_threshold")
def label_means(s, d):
    return _rounded(ev.label_means(_sweep(s, d).withColumn("idf_label", F.col("author_threshold"))))


@query(f"""WITH {linkage_sql()}, {TRUTH} SELECT r.rec, (SELECT count(*) FROM s2 WHERE s2.rec = r.rec) AS titles_count, EXISTS (SELECT 1 FROM s2 JOIN t ON t.rec = s2.rec AND t.book = s2.uri WHERE s2.rec = r.rec) AS titles_hit,
  (SELECT count(*) FROM s3 WHERE s3.rec = r.rec) AS combined_count, EXISTS (SELECT 1 FROM s3 JOIN t ON t.rec = s3.rec AND t.book = s3.book WHERE s3.rec = r.rec) AS combined_hit FROM r""")
def stage_report(s, d):
    run = _linked(s, d)
    return ev.stage_report(run.raw, {"titles": run.titles.withColumnRenamed("uri", "book"), "combined": run.combined}, _truth(s, d))


@query(f"WITH {linkage_sql()}, {TRUTH}, e AS (SELECT * FROM t WHERE book IS NOT NULL) SELECT count(*) FILTER (s3.rec IS NOT NULL AND e.rec IS NOT NULL) AS both, count(*) FILTER (e.rec IS NULL) AS found_only, count(*) FILTER (s3.rec IS NULL) AS truth_only FROM s3 FULL JOIN e ON s3.rec = e.rec AND s3.book = e.book")
def set_counts(s, d):
    return merge.set_counts(_linked(s, d).combined, _truth(s, d).where("book IS NOT NULL"))


# Exports: written as CSV and read back

EXPORT = f"""WITH {linkage_sql()}, {TRUTH}, u AS (SELECT uri AS book, author AS author_uri, replace(uri, '_', ' ') AS book_title, 'author ' || author AS author_name FROM tt), h AS (SELECT rec, rec % 2 = 0 AS l FROM r)"""


def _exported(made: DataFrame) -> DataFrame:
    at = source_catalog.folder(made.sparkSession, "export")
    sinks.write_csv(made, at)
    return made.sparkSession.read.schema(made.schema).option("header", "true").csv(at)


def _books(run: lk.Linkage) -> DataFrame:
    return run.books.select(F.col("uri").alias("book"), "author_uri", F.replace("uri", F.lit("_"), F.lit(" ")).alias("book_title"), F.concat(F.lit("author "), "author_uri").alias("author_name"))


def _creators(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "part").select(F.col("p_partkey").alias("rec"), (F.col("p_partkey") % 2 == 0).alias("has_creator_lat"), F.lit(False).alias("has_creator_ara"))


@query(f"""{EXPORT}, c AS (SELECT rec, uri AS book FROM s2 UNION SELECT rec, book FROM s3 UNION SELECT rec, book FROM t WHERE book IS NOT NULL UNION SELECT s1.rec, u.book FROM s1 JOIN u ON u.author_uri = s1.uri)
SELECT c.rec AS record_id, t.book AS expected_book, c.book AS book_uri, book_title, author_uri, author_name, round(s1.raw, 4) AS score_raw, round(s1.idf_score, 4) AS score_idf, round(s1.score, 4) AS score_final, coalesce(s1.idf_score > s1.raw, false) AS idf_boosted,
  coalesce(abs(s1.score - s1.idf_score) > 1e-6, false) AS creator_reweighted, round(s2.score, 4) AS title_score, round(s3.score, 4) AS combined_score, s1.rec IS NOT NULL AS in_stage1, s2.rec IS NOT NULL AS in_stage2, s3.rec IS NOT NULL AS in_stage3,
  c.book IS NOT DISTINCT FROM t.book AS is_expected, l AS has_creator_lat, false AS has_creator_ara
FROM c JOIN t USING (rec) JOIN u ON u.book = c.book JOIN h USING (rec) LEFT JOIN s1 ON s1.rec = c.rec AND s1.uri = u.author_uri LEFT JOIN s2 ON s2.rec = c.rec AND s2.uri = c.book LEFT JOIN s3 ON s3.rec = c.rec AND s3.book = c.book""")
def export_author_scores(s, d):
    run = _linked(s, d)
    return _exported(exports.author_scores(run, _truth(s, d), _books(run), _creators(s, d)))


@query(f"""{EXPORT} SELECT s3.rec AS record_id, t.book AS expected_uri, s3.book AS matched_uri, s3.book IS NOT DISTINCT FROM t.book AS is_correct, rank, s3.author AS author_uri, author_name, round(s1.raw, 4) AS author_score_pre, round(s1.score, 4) AS author_score_post,
  l AS has_creator_lat, false AS has_creator_ara, round(s3.title_score, 4) AS title_score, round(s3.score, 4) AS combined_score FROM s3 JOIN t USING (rec) JOIN u ON u.book = s3.book JOIN h USING (rec) JOIN s1 ON s1.rec = s3.rec AND s1.uri = s3.author""")
def export_combined_scores(s, d):
    run = _linked(s, d)
    return _exported(exports.combined_scores(run, _truth(s, d), _books(run), _creators(s, d)))


@query(f"""{EXPORT} SELECT s3.rec AS record_id, t.book AS expected_book, s3.book AS winning_match, coalesce(s3.book = t.book, false) AS is_expected_match, t.book IS NULL AS is_null_expected, author AS author_uri, round(author_score, 4) AS author_score,
  round(title_score, 4) AS title_score, round(score, 4) AS combined_score, count(*) OVER (PARTITION BY s3.rec) AS num_matches_for_record FROM s3 JOIN t USING (rec)""")
def export_validation(s, d):
    return _exported(exports.validation(_linked(s, d), _truth(s, d)))


# Candidates of older kinds, and the ladders of samples


@query("""WITH b AS (SELECT p_partkey AS uri, CASE WHEN p_partkey % 3 <> 0 THEN p_name WHEN p_partkey % 2 = 0 THEN '' END AS title, p_type AS slug FROM part)
SELECT uri, 0 AS ord, replace(lower(coalesce(nullif(title, ''), slug)), 'c', 'ayn') AS cand FROM b""")
def slug_fallback(s, d):
    title = F.when(F.col("p_partkey") % 3 != 0, F.col("p_name")).when(F.col("p_partkey") % 2 == 0, "")
    books = table(s, d, "part").select(F.col("p_partkey").alias("uri"), title.alias("title_lat"), F.col("p_type").alias("title_slug"), F.lit(None).cast("string").alias("title_ara"))
    return cd.plain_book_candidates(books).select("uri", "ord", "cand")


@query("""SELECT p_partkey AS rec, 'title' AS purpose, unnest(list_distinct([p_name, p_type])) AS raw FROM part UNION ALL SELECT p_partkey, 'all', unnest(list_distinct(['Maker ' || (p_partkey % 7), p_name, p_type])) FROM part""")
def purposes(s, d):
    """Title candidates leave creators out; all candidates have them."""
    some, none = lambda *c: F.array(*c), F.array().cast("array<string>")
    p = table(s, d, "part").select(F.col("p_partkey").alias("record_id"), some(F.concat(F.lit("Maker "), (F.col("p_partkey") % 7).cast("string"))).alias("creator_lat"), some("p_name").alias("title_lat"), some("p_type").alias("description_candidates_lat"), none.alias("contributor_lat"), *[none.alias(f"{c}_ara") for c in ("creator", "contributor", "title", "description_candidates")])
    made = [cd.record_candidates(p, k).select(F.col("record_id").alias("rec"), F.lit(k).alias("purpose"), "raw") for k in ("title", "all")]
    return made[0].unionByName(made[1])


@query("""WITH p AS (SELECT p_partkey AS k, p_partkey % 4 AS c, p_partkey % 3 AS t, p_partkey % 6 AS e, ['Histoire de ' || p_name, 'Le Coran', 'Astronomie', 'Grammaire', p_name][(p_partkey % 5 + 1)::INT] AS s, CASE WHEN p_partkey % 11 > 0 THEN (p_partkey % 20) * 100 END AS y FROM part)
SELECT k, CASE WHEN c > 0 AND t > 0 THEN 'both' WHEN c > 0 THEN 'author_only' WHEN t > 0 THEN 'title_only' ELSE 'sparse' END AS completeness,
  CASE k % 5 WHEN 0 THEN 'historiography' WHEN 1 THEN 'religious' WHEN 2 THEN 'sciences' WHEN 3 THEN 'language' ELSE 'other' END AS subject_class,
  CASE WHEN y IS NULL THEN 'unknown' WHEN y < 900 THEN 'early' WHEN y < 1200 THEN 'medieval' ELSE 'late' END AS period, CASE WHEN k % 9 = 0 THEN 'composite' ELSE 'single_author' END AS kind,
  CASE WHEN c >= 3 OR t >= 2 OR e >= 5 THEN 'rich' WHEN c >= 1 OR t >= 1 OR e >= 2 THEN 'moderate' ELSE 'sparse' END AS richness, contains(lower(s), 'coran') AND t > 0 AS quran FROM p""")
def manuscript_ladders(s, d):
    k = F.col("p_partkey")
    subject = F.element_at(F.array(F.concat(F.lit("Histoire de "), "p_name"), F.lit("Le Coran"), F.lit("Astronomie"), F.lit("Grammaire"), F.col("p_name")), (k % 5 + 1).cast("int"))
    times = lambda c, n: F.array_repeat(c, n.cast("int"))
    none = F.array().cast("array<string>")
    made = table(s, d, "part").select(k.alias("k"), times(F.lit("c"), k % 4).alias("creator_lat"), times(subject, k % 3).alias("title_lat"), times(F.lit("d"), k % 6).alias("description_lat"), F.array(subject).alias("subject"), F.when(k % 11 > 0, (k % 20) * 100).alias("date_from"), (k % 9 == 0).alias("is_composite"), none.alias("creator_ara"), none.alias("title_ara"))
    return sampling.manuscript_strata(made).withColumn("quran", sampling.is_quran(made)).select("k", "completeness", "subject_class", "period", "kind", "richness", "quran")


# Merging


@query("SELECT l_partkey, arg_min(l_suppkey, l_orderkey * 10 + l_linenumber) AS l_suppkey, arg_min(l_quantity, l_orderkey * 10 + l_linenumber) AS l_quantity FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey, l_orderkey, l_linenumber ORDER BY l_suppkey, l_quantity) AS k FROM lineitem) WHERE k = 1) GROUP BY l_partkey")
def first_wins(s, d):
    rows = table(s, d, "lineitem").withColumn("o", F.struct("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity"))
    return merge.first_wins(rows, "l_partkey", "o", ["l_suppkey", "l_quantity"])


@query("SELECT c.c_custkey, coalesce(nullif(CASE WHEN c.c_custkey % 4 = 0 THEN '' ELSE c.c_name END, ''), nullif(s.s_name, '')) AS name, coalesce(nullif(CASE WHEN c.c_custkey % 3 = 0 THEN 0 ELSE c.c_nationkey END, 0), nullif(s.s_nationkey, 0)) AS nation FROM customer c LEFT JOIN supplier s ON c.c_custkey = s.s_suppkey")
def merge_coalesce(s, d):
    c = table(s, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 4 == 0, "").otherwise(F.col("c_name")).alias("name"), F.when(F.col("c_custkey") % 3 == 0, 0).otherwise(F.col("c_nationkey")).alias("nation"))
    return merge.first_filled(c, table(s, d, "supplier").select(F.col("s_suppkey").alias("c_custkey"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation")), "c_custkey")


@query("SELECT c_custkey, coalesce(s_name, c_name) AS name FROM customer LEFT JOIN supplier ON c_custkey = s_suppkey")
def preserve_existing(s, d):
    old = table(s, d, "supplier").select(F.col("s_suppkey").alias("c_custkey"), F.col("s_name").alias("name"))
    return merge.preserve(table(s, d, "customer").select("c_custkey", F.col("c_name").alias("name")), old, "c_custkey", ["name"])


@query("SELECT c_custkey::VARCHAR AS uri, coalesce(array_to_string(list_sort(list(DISTINCT o_orderpriority) FILTER (o_orderkey IS NOT NULL)), ','), '') AS links FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
def attach_links(s, d):
    books = table(s, d, "customer").select(F.col("c_custkey").cast("string").alias("uri"))
    versions = table(s, d, "orders").select(F.col("o_custkey").cast("string").alias("book_uri"), F.array("o_orderpriority").alias("links"))
    return merge.attach_links(books, versions).select("uri", F.array_join("version_links", ",").alias("links"))


@query("SELECT c_custkey, n_name AS wd_label_en, CASE WHEN n_name IS NULL THEN 'not found' END AS wd_error FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey AND n_nationkey % 5 <> 0")
def enrich_left_join(s, d):
    none = F.lit(None).cast("string")
    authors = table(s, d, "customer").select("c_custkey", F.concat(F.lit("Q"), "c_nationkey").alias("wikidata_id"), *[none.alias(c) for c in ("wd_label_ar", "wd_label_en", "wd_aliases_ar", "wd_aliases_en", "wd_death_year", "wd_fetched_at", "wd_error")])
    got = table(s, d, "nation").where("n_nationkey % 5 != 0").select(F.concat(F.lit("Q"), "n_nationkey").alias("qid"), none.alias("label_ar"), F.col("n_name").alias("label_en"), none.alias("aliases_ar"), none.alias("aliases_en"), none.alias("death_date"))
    return merge.enrich(authors, got, "2000-01-01").select("c_custkey", "wd_label_en", "wd_error")


@query("SELECT p_partkey, CASE WHEN list_contains(string_split(p_name, ' '), lower(replace(p_type, 'C', 'ʿ'))) THEN array_to_string(list_filter(string_split(replace(p_name, 'c', 'ʿ'), ' '), lambda w: w <> lower(p_type)), ' ') ELSE p_name END AS t FROM part")
def cull_tokens(s, d):
    part = table(s, d, "part")
    books = part.select(F.col("p_partkey").alias("uri"), F.col("p_type").alias("author_uri"), F.array("p_name").alias("title_ara"))
    names = part.select(F.col("p_type").alias("uri"), F.col("p_type").alias("variant")).distinct()
    return cd.cull_author_tokens(books, names).select(F.col("uri").alias("p_partkey"), F.get("title_ara", F.lit(0)).alias("t"))


@query("SELECT event_id, user_id FROM events WHERE event_id NOT IN (SELECT event_id FROM events WHERE event_id % 3 = 0)")
def incremental_anti(s, d):
    e = table(s, d, "events")
    return incremental.update(e.where("event_id % 3 = 0").select("event_id"), e.select("event_id", "user_id"), "event_id")


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN -1 ELSE user_id END AS user_id FROM events")
def upsert_union(s, d):
    e = table(s, d, "events").select("event_id", "user_id")
    return merge.upsert(e, e.where("event_id % 3 = 0").withColumn("user_id", F.lit(-1).cast("long")), "event_id")


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def windowed_counts(s, d):
    return incremental.windowed_counts(table(s, d, "events")).withColumn("total", F.round("total", 4))


# Statistics


def _pairs(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "orders").select(F.concat(F.lpad(F.col("o_custkey").cast("string"), 4, "0"), F.lit("."), "o_orderstatus").alias("uri"), F.col("o_orderkey").alias("rec"))


PAIRS = "WITH p AS (SELECT lpad(o_custkey::VARCHAR, 4, '0') || '.' || o_orderstatus AS uri, o_orderkey AS rec FROM orders)"


@query("SELECT c_nationkey AS author_uri, c_custkey // 4096 AS part, array_to_string(list_sort(list(c_custkey)), ',') AS books FROM customer GROUP BY ALL")
def books_by_author(s, d):
    b = cd.books_by_author(table(s, d, "customer").select(F.col("c_custkey").alias("uri"), F.col("c_nationkey").alias("author_uri")), F.floor(F.col("uri") / 4096))
    return b.select("author_uri", "part", F.array_join(F.transform("books", lambda x: x.cast("string")), ",").alias("books"))


@query(f"{PAIRS} SELECT count(DISTINCT uri) AS books, count(DISTINCT split_part(uri, '.', 1)) AS authors FROM p")
def unique_counts(s, d):
    return stats.unique_counts(_pairs(s, d))


@query(f"{PAIRS} SELECT uri, rec, count(*) OVER (PARTITION BY uri) AS records_per_uri, count(*) OVER (PARTITION BY rec) AS uris_per_record FROM p")
def uri_counts(s, d):
    return stats.with_counts(_pairs(s, d))


@query(f"{PAIRS}, c AS (SELECT uri, count(*) AS n FROM p GROUP BY uri) SELECT uri, n, round((n - (SELECT avg(n) FROM c)) / (SELECT stddev_pop(n) FROM c), 6) AS z_score FROM c WHERE abs((n - (SELECT avg(n) FROM c)) / (SELECT stddev_pop(n) FROM c)) > 2")
def outliers(s, d):
    return _rounded(stats.outliers(stats.counts_by(_pairs(s, d), "uri", "rec", "n"), "n", 2.0))


@query(f"{PAIRS}, c AS (SELECT uri FROM p GROUP BY uri HAVING count(*) > 6) SELECT uri, rec FROM p WHERE uri NOT IN (SELECT uri FROM c)")
def over_limit(s, d):
    return stats.drop_over(_pairs(s, d), 6)


@query("SELECT b::INT AS bin_start, count(o.y) AS count FROM (SELECT unnest(range(0, 10000, 5)) AS b) LEFT JOIN (SELECT year(o_orderdate) AS y FROM orders) o ON o.y > b AND o.y <= b + 4 GROUP BY b")
def chrono_bins(s, d):
    return stats.chronology(table(s, d, "orders").select(F.year("o_orderdate").alias("year")), width=5, until=10000)


@query(f"{PAIRS} SELECT uri, rec FROM p JOIN orders ON rec = o_orderkey WHERE lower(o_orderpriority) NOT LIKE '%urgent%'")
def drop_keyword(s, d):
    records = table(s, d, "orders").select(F.col("o_orderkey").alias("rec"), F.array("o_orderpriority").alias("titles"))
    return stats.drop_keyword(_pairs(s, d), records, "Urgent")


# Sampling: an arithmetic key, so that both engines order alike.

KEY = "(doc_id * 7919 + 104729) % 1000003"


@query(f"SELECT doc_id, lang FROM documents ORDER BY {KEY}, doc_id LIMIT 100")
def hash_sample(s, d):
    return sampling.simple(table(s, d, "documents").select("doc_id", "lang"), 100, "doc_id", key=F.expr(KEY))


@query(f"""WITH k AS (SELECT doc_id, lang, source, {KEY} AS key, row_number() OVER (PARTITION BY lang, source ORDER BY {KEY}, doc_id) AS rank, count(*) OVER (PARTITION BY lang, source) AS size, count(*) OVER () AS total FROM documents)
SELECT doc_id, lang, source FROM k ORDER BY CASE WHEN rank <= least(size, greatest(1, round(size / total * 150))) THEN 0 ELSE 1 END, key, doc_id LIMIT 150""")
def strat_sample(s, d):
    return sampling.stratified(table(s, d, "documents").select("doc_id", "lang", "source"), ["lang", "source"], 150, "doc_id", key=F.expr(KEY))


# Descriptions


@query()
def segment_runs(s, d):
    made = table(s, d, "documents").select("doc_id", F.split("text", "\n").alias("lines"))
    found = segment.segment(F.col("lines"), F.array().cast("array<string>"), {"licensed under": "licence", "all rights reserved": "rights"}, {"Released under", "under the", "of the"}, 250, 2)
    return made.select("doc_id", F.explode(found).alias("s")).select("doc_id", "s.segment", "s.label")


@query()
def segment_sets(s, d):
    """Documents taken apart at all pairs of words that benchmark items have: a set of phrases that grows with the data."""
    made = table(s, d, "documents").select("doc_id", F.split("text", "\n").alias("lines"), F.array().cast("array<string>").alias("titles")).where("doc_id IS NOT NULL")
    pairs = table(s, d, "benchmark").select(F.explode(tx.ngrams(tx.tokens_lat(F.col("text")), 2)).alias("ngram")).distinct()
    kinds = pairs.withColumn("signal_type", F.when(F.pmod(F.crc32("ngram"), F.lit(50)) == 0, F.lit("date:copy")))
    found = segment.segment_by_sets(made, "doc_id", "lines", "titles", kinds)
    return found.select("doc_id", F.explode("segments").alias("s")).select("doc_id", "s.segment", "s.label")


@query("""WITH e AS (SELECT doc_id AS rec, unnest(string_split(text, chr(10))) AS line FROM documents), t AS (SELECT * FROM (VALUES ('licence', 'licensed under'), ('rights', 'All rights reserved')) t(relation_type, term))
SELECT rec, relation_type, term, count(*)::BIGINT AS n, sum(len(string_split(lower(line), lower(term))) - 1)::BIGINT AS hits FROM e JOIN t ON contains(lower(line), lower(term)) GROUP BY ALL""")
def detect_relations(s, d):
    e = table(s, d, "documents").select(F.col("doc_id").alias("rec"), F.posexplode(F.split("text", "\n")).alias("line", "text")).withColumn("field", F.lit("description"))
    terms = s.createDataFrame([("licence", "licensed under", None), ("rights", "All rights reserved", None)], "relation_type string, term string, field string")
    keyed = segment.relations(e.withColumn("rec", F.struct("rec", "line")), terms)
    return keyed.groupBy(F.col("rec.rec").alias("rec"), "relation_type", "term").agg(F.count_distinct("rec.line").alias("n"), F.count(F.lit(1)).alias("hits"))
