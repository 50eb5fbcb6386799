"""Quality rules: a threshold table compiled into one projection of built-in functions.

``measure`` adds the counts and ratios of a text; ``RULES`` is the threshold table; ``compile_rules`` turns a table
into one boolean column. No user function runs: splitting, windows, repeats and ratios are array functions.

Defined cases: a null text has no words and fails the base rule; an empty text likewise. Repeated rows and ties are
judged row by row. An empty table gives an empty table. Extra columns pass through; the measures sit in one struct
column whose name is chosen by the caller, so clashing names do no harm. Texts are used whole.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, let

#: Common function words of the four languages of the corpus, lower case.
STOP_WORDS = (
    "the of and to in is was it for on with as are this be at or from by an a that "
    "der die das und den dem des ist im in zu von mit nicht ein eine für auf sich "
    "le la les des de du et un une en dans pour que qui est par pas sur au avec "
    "el los las del y que se un una por con para no su lo es"
).split()
WHITE = "[\\x20\\x09-\\x0D]+"


class Rule(NamedTuple):
    """A measure (a key of RATIOS), and the least and the greatest value that pass; None: no bound."""

    measure: str
    least: float | None
    most: float | None


#: The production thresholds. Length, symbol, stop-word and line ratios; all must pass.
RULES = (
    Rule("n_words", 50, None),
    Rule("mean_word_chars", 2.0, 25.0),
    Rule("symbols_per_word", None, 0.10),
    Rule("marks_per_word", None, 0.50),
    Rule("stop_word_share", 0.02, None),
    Rule("dup_char_share", None, 0.30),  # of lines by their characters, so that repeated short lines weigh little
    Rule("repeat_word_share", None, 0.50),
)


def _per(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


#: Measures that rules may name, over the counts of ``counts``.
RATIOS = {
    "n_words": lambda c: c["n_words"].cast("double"),
    "mean_word_chars": lambda c: _per(c["word_chars"], c["n_words"]),
    "symbols_per_word": lambda c: _per(c["n_symbols"], c["n_words"]),
    "marks_per_word": lambda c: _per(c["n_marks"], c["n_words"]),
    "stop_word_share": lambda c: _per(c["n_stop_words"], c["n_words"]),
    "dup_line_share": lambda c: _per(c["n_dup_lines"], c["n_lines"]),
    "dup_char_share": lambda c: _per(c["n_dup_chars"], c["n_line_chars"]),
    "repeat_word_share": lambda c: _per(c["n_repeat_words"], c["n_words"]),
}


def words(text: Column) -> Column:
    """The runs of characters other than space and U+0009..U+000D."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WHITE, -1), "")


def _repeats(w: Column) -> Column:
    """How many words lie in a 3-word window that occurs twice or more in the text."""

    def windows(w: Column) -> Column:
        hashed = F.transform(w, lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))
        return let(F.slice(hashed, 1, F.greatest(F.size(w) - 2, F.lit(0))), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(_covered(w, h)))

    return F.when(F.size(w) < 3, 0).otherwise(windows(w)).cast("long")


def _covered(w: Column, h: Column) -> Column:
    """Sorting (hash, place) brings equal windows together; neighbours with the same three words are repeats."""

    def same(a: Column, b: Column) -> Column:
        i, j = a["i"], b["i"]
        return F.coalesce((a["h"] == b["h"]) & (F.get(w, i) == F.get(w, j)) & (F.get(w, i + 1) == F.get(w, j + 1)) & (F.get(w, i + 2) == F.get(w, j + 2)), F.lit(False))

    ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    repeated = let(ordered, lambda s: F.filter(s, lambda y, j: same(y, F.get(s, j - 1)) | same(y, F.get(s, j + 1))))
    places = F.flatten(F.transform(repeated, lambda y: F.array(y["i"], y["i"] + 1, y["i"] + 2)))
    return F.size(F.array_distinct(places))


def counts(text: Column) -> Column:
    """All counts of a text, as one struct column of longs."""
    whole = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(whole, "\n", -1), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    both = F.struct(words(text).alias("w"), lines.alias("l"), whole.alias("t"))
    return let(
        both,
        lambda v: F.struct(
            F.size(v["w"]).cast("long").alias("n_words"),
            F.length(F.array_join(v["w"], "")).cast("long").alias("word_chars"),
            F.length(F.regexp_replace(v["t"], "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
            F.length(F.regexp_replace(v["t"], "[^!?]+", "")).cast("long").alias("n_marks"),
            F.size(F.filter(v["w"], lambda x: F.lower(x).isin(*sorted(set(STOP_WORDS))))).cast("long").alias("n_stop_words"),
            F.size(v["l"]).cast("long").alias("n_lines"),
            (F.size(v["l"]) - F.size(F.array_distinct(v["l"]))).cast("long").alias("n_dup_lines"),
            F.length(F.array_join(v["l"], "")).cast("long").alias("n_line_chars"),
            (F.length(F.array_join(v["l"], "")) - F.length(F.array_join(F.array_distinct(v["l"]), ""))).cast("long").alias("n_dup_chars"),
            let(v["w"], _repeats).alias("n_repeat_words"),
        ),
    )


def base_failed(c: Column) -> Column:
    return (c["n_words"] < 50) | (100 * c["n_repeat_words"] > 50 * c["n_words"])


def compile_rules(c: Column, rules=RULES) -> Column:
    """One boolean column: every rule of the table holds for the counts c."""
    out = F.lit(True)
    for rule in rules:
        value = RATIOS[rule.measure](c)
        if rule.least is not None:
            out = out & (value >= F.lit(float(rule.least)))
        if rule.most is not None:
            out = out & (value <= F.lit(float(rule.most)))
    return out


def measure(df: DataFrame, text_col: str = "text", out: str = "quality") -> DataFrame:
    """df with a struct column ``out`` of all counts."""
    return df.withColumn(out, counts(F.col(f"`{text_col}`")))


def keep(df: DataFrame, text_col: str = "text", rules=RULES) -> DataFrame:
    """The rows of df that pass the base rule and the threshold table, with df's own columns."""
    c = fresh(df, "counts")
    return measure(df, text_col, c).where(~base_failed(F.col(c)) & compile_rules(F.col(c), rules)).select(*[F.col(f"`{x}`") for x in df.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    c = F.col("__c")
    rows = measure(docs, "text", "__c")
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    more = ["n_lines", "n_marks", "n_stop_words", "n_dup_chars"]
    return rows.select("doc_id", *[c[n].alias(n) for n in names], base_failed(c).alias("base_failed"), (~base_failed(c) & compile_rules(c)).alias("kept"), *[c[n].alias(n) for n in more])


def oracle() -> str:
    """DuckDB SQL for ``query``."""
    stop = ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS)))
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM d),
g AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM w WHERE len(w) >= 3),
g3 AS (SELECT doc_id, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM g),
r AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM g3),
p AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM r WHERE n >= 2) GROUP BY doc_id),
m AS (SELECT w.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
  length(regexp_replace(t, '[^!?]+', '', 'g'))::BIGINT AS n_marks,
  len(list_filter(w, lambda x: lower(x) IN ({stop})))::BIGINT AS n_stop_words,
  len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
  length(array_to_string(l, ''))::BIGINT AS n_line_chars, (length(array_to_string(l, '')) - length(array_to_string(list_distinct(l), '')))::BIGINT AS n_dup_chars,
  coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN p USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND word_chars / n_words BETWEEN 2.0 AND 25.0 AND n_symbols / n_words <= 0.10 AND n_marks / n_words <= 0.50
  AND n_stop_words / n_words >= 0.02 AND (n_line_chars = 0 OR n_dup_chars / n_line_chars <= 0.30) AND n_repeat_words / n_words <= 0.50 AS kept,
  n_lines, n_marks, n_stop_words, n_dup_chars
FROM b"""
