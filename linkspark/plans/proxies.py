"""The linkage's inputs from the tables at hand: parts stand for records, their names for books, first words for authors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import LinkConfig
from ..operators import linkage as lk

#: With so few authors and books no token is as rare as in a real catalogue.
CONFIG = LinkConfig(rare_idf=2.0, creator_idf=1.5)


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def linkage(spark: SparkSession, d: str, config: LinkConfig = CONFIG) -> lk.Linkage:
    word = F.substring_index(F.lower("p_name"), " ", 1)
    part = table(spark, d, "part").select(F.col("p_partkey").alias("rec"), F.lower("p_name").alias("name"), word.alias("word"))
    maker = F.when(F.col("rec") % 3 != 0, F.concat("word", F.lit(" "), "word", F.lit("ville"))).otherwise(F.col("word"))
    raw = part.select("rec", F.posexplode(F.array("name", maker)).alias("ord", "raw"))
    creators = part.select("rec", maker.alias("raw"))
    words = part.select("word").distinct()
    authors = words.select(F.col("word").alias("uri"), F.lit("lat").alias("script"), F.posexplode(F.array(F.col("word"), F.concat("word", F.lit(" "), "word", F.lit("ville")))).alias("ord", "variant"))
    names = part.select("name", "word").distinct()
    books = names.select(F.replace("name", F.lit(" "), F.lit("_")).alias("uri"), F.col("word").alias("author_uri"))
    titles = names.select(F.replace("name", F.lit(" "), F.lit("_")).alias("uri"), F.lit("lat").alias("script"), F.lit(0).alias("ord"), F.col("name").alias("variant"))
    return lk.Linkage(raw=raw, author_variants=authors, book_variants=titles, books=books, creators=creators, config=config)


def lcs_sql(a: str, b: str) -> str:
    """Length of the longest common subsequence of two texts of up to 120 characters, in DuckDB's SQL."""
    full = f"((1::HUGEINT << length({a})::INT) - 1)"
    mask = f"list_sum(list_transform(range(length({a})), lambda i: CASE WHEN ({a})[i + 1] = c THEN 1::HUGEINT << i::INT ELSE 0::HUGEINT END))::HUGEINT"
    return f"(length({a}) - bit_count(list_reduce(list_transform(string_split({b}, ''), lambda c: {mask}), lambda s, m: ((s + (s & m)) | (s - (s & m))) & {full}, {full})))"


def ratio_sql(a: str, b: str) -> str:
    return f"(CASE WHEN {a} = '' OR {b} = '' THEN 0 WHEN {a} = {b} THEN 100 ELSE round_even(200 * {lcs_sql(a, b)} / (length({a}) + length({b})), 0) END)::INT"


def set_ratio_sql(source: str, a: str, b: str, keep: str) -> str:
    """SELECT keep, raw over a source with sorted token lists a and b."""
    return f"""(SELECT {keep}, CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0 ELSE greatest(
  CASE WHEN s = '' THEN 0 ELSE round_even(200 * length(s) / (length(s) + length(x)), 0)::INT END,
  CASE WHEN s = '' THEN 0 ELSE round_even(200 * length(s) / (length(s) + length(y)), 0)::INT END, {ratio_sql("x", "y")}) END AS raw
 FROM (SELECT *, trim(s || ' ' || array_to_string(list_filter({a}, lambda t: NOT list_contains({b}, t)), ' ')) AS x,
   trim(s || ' ' || array_to_string(list_filter({b}, lambda t: NOT list_contains({a}, t)), ' ')) AS y
  FROM (SELECT *, array_to_string(list_sort(list_intersect({a}, {b})), ' ') AS s FROM {source})))"""


def linkage_sql(c: LinkConfig = CONFIG) -> str:
    """WITH clauses s1 (authors), s2 (titles) and s3 (combined) of the linkage above."""
    score = lambda target, idf: f"""SELECT cand, uri, comb, rare, toks, ctoks FROM (SELECT cand, uri, sum(idf) AS comb, sum(CASE WHEN idf >= {c.rare_idf} THEN idf ELSE 0 END) AS rare
   FROM (SELECT DISTINCT cand, unnest(list_distinct(string_split(cand, ' '))) AS token FROM cand) JOIN (SELECT uri, unnest(toks) AS token FROM {target}) USING (token) JOIN {idf} USING (token) GROUP BY ALL)
   JOIN {target} USING (uri) JOIN (SELECT DISTINCT cand, list_sort(list_distinct(string_split(cand, ' '))) AS ctoks FROM cand) USING (cand)"""  # noqa: E731
    return f"""
r AS (SELECT p_partkey AS rec, lower(p_name) AS name, split_part(lower(p_name), ' ', 1) AS word FROM part),
m AS (SELECT *, CASE WHEN rec % 3 <> 0 THEN word || ' ' || word || 'ville' ELSE word END AS maker FROM r),
cand AS (SELECT rec, 0 AS ord, name AS cand FROM m UNION ALL SELECT rec, 1, maker FROM m),
ta AS (SELECT DISTINCT word AS uri, list_sort([replace(word, 'c', 'ʿ'), replace(word, 'c', 'ʿ') || 'ville']) AS toks FROM r),
ia AS (SELECT token, ln(1 + (SELECT count(*) FROM ta) / count(*)) AS idf FROM (SELECT unnest(toks) AS token FROM ta) GROUP BY token),
pa AS ({score("ta", "ia")}),
qa AS (SELECT * FROM {set_ratio_sql("pa", "ctoks", "toks", "cand, uri, comb, rare")} WHERE raw * (1 + least(comb / {c.author_idf_scale}, {c.author_boost})) >= {c.author_threshold * 100}),
ha AS (SELECT rec, uri, raw / 100 AS raw, rare, row_number() OVER (PARTITION BY rec, uri ORDER BY raw / 100 * (1 + least(rare / {c.author_idf_scale}, {c.author_boost})) DESC, ord) AS k FROM cand JOIN qa USING (cand)),
ga AS (SELECT rec, uri, raw, rare, raw * (1 + least(rare / {c.author_idf_scale}, {c.author_boost})) AS idf_score FROM ha WHERE k = 1),
va AS (SELECT DISTINCT word AS uri, 0 AS ord, [replace(word, 'c', 'ʿ')] AS toks FROM r UNION ALL SELECT DISTINCT word, 1, [replace(word, 'c', 'ʿ'), replace(word, 'c', 'ʿ') || 'ville'] FROM r),
ra AS (SELECT uri, ord, list(token) AS toks FROM (SELECT uri, ord, unnest(toks) AS token FROM va) JOIN ia USING (token) WHERE idf >= {c.creator_idf} GROUP BY uri, ord),
ca AS (SELECT rec, uri, ord, len(list_intersect(toks, string_split(maker, ' '))) AS n, len(list_intersect(toks, string_split(maker, ' '))) / len(toks) AS share FROM ga JOIN ra USING (uri) JOIN m USING (rec)),
ba AS (SELECT rec, uri, n, share FROM (SELECT *, row_number() OVER (PARTITION BY rec, uri ORDER BY share DESC, ord) AS k FROM ca WHERE n > 0) WHERE k = 1),
fa AS (SELECT *, max(coalesce(n, 0)) OVER (PARTITION BY rec) > 1 AS trig FROM ga LEFT JOIN ba USING (rec, uri)),
s1 AS (SELECT rec, uri, raw, rare, idf_score, (CASE WHEN trig THEN {c.creator_weights[0]} * raw + {c.creator_weights[1]} * coalesce(share, 0) ELSE raw END) * (1 + least(rare / {c.author_idf_scale}, {c.author_boost})) AS score FROM fa),
tt AS (SELECT DISTINCT replace(name, ' ', '_') AS uri, word AS author, list_sort(list_distinct(string_split(replace(name, 'c', 'ʿ'), ' '))) AS toks FROM r),
it AS (SELECT token, ln(1 + (SELECT count(*) FROM tt) / count(*)) AS idf FROM (SELECT unnest(toks) AS token FROM tt) GROUP BY token),
pt AS ({score("tt", "it")}),
qt AS (SELECT *, raw * (1 + least(comb / {c.title_idf_scale}, {c.title_boost})) AS b FROM {set_ratio_sql("pt", "ctoks", "toks", "cand, uri, comb")}),
s2 AS (SELECT rec, uri, max(b) / 100 AS score FROM cand JOIN qt USING (cand) WHERE b >= {c.title_threshold * 100} GROUP BY rec, uri),
j AS (SELECT s2.rec, s2.uri AS book, tt.author, s1.score AS author_score, s2.score AS title_score FROM s2 JOIN tt ON s2.uri = tt.uri JOIN s1 ON s1.rec = s2.rec AND s1.uri = tt.author
  WHERE s1.score >= {c.combined_floor} AND s2.score >= {c.combined_floor} AND s2.score >= {c.title_floor}),
k AS (SELECT *, {c.combined_weights[0]} * (author_score / max(author_score) OVER (PARTITION BY rec)) + {c.combined_weights[1]} * (title_score / max(title_score) OVER (PARTITION BY rec)) AS score FROM j),
s3 AS (SELECT rec, book, author, author_score, title_score, score, row_number() OVER (PARTITION BY rec ORDER BY score DESC, book)::INT AS rank FROM k WHERE score >= {c.combined_threshold})"""
