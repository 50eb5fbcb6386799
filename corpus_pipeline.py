"""The corpus pipeline: quality rules, line dedup, n-gram Jaccard join, benchmark decontamination, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; a stage's result is written and
read again as the next one's documents. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkspark.llm import bpe, decontaminate, line_dedup, ngram_join, quality_rules
from linkspark.llm.common import collected, delete_dir, fresh, written

#: What line dedup leaves of a document is no scrap from so many characters on: the 50 words of the base rule, at five.
SCRAP_CHARS = 250


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rule or the threshold table go."""
    return quality_rules.keep(docs)


def _scrap(text: Column) -> Column:
    """No line of LEAST_TOKENS tokens or more, and fewer than SCRAP_CHARS characters but white space of any kind. So
    long lists of short lines, and paragraphs of scripts without spaces, which count as a token, are no scraps."""
    full = F.exists(F.split(text, "\n", -1), lambda x: x.rlike(r"(?U)\S") & (line_dedup.n_tokens(line_dedup.masked(x)) >= line_dedup.LEAST_TOKENS))
    return ~full & (F.length(F.regexp_replace(text, r"(?U)\s+", "")) < SCRAP_CHARS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of templates that recur across documents go, but for one occurrence; n_chars follows the text. A document
    whose lines of enough tokens to be judged all stand in others goes too, if what it has beside them is a scrap."""
    gone = fresh(docs, "dropped")
    out = line_dedup.drop_lines(docs, n_dropped=gone)
    out = out.where((F.col(gone) == 0) | ~_scrap(F.coalesce("text", F.lit("")))).select(*docs.columns)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns) if "n_chars" in docs.columns else out


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, that of the smallest doc_id."""
    return ngram_join.keep_one(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents contaminated by the benchmark go."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, number of tokens, and digests of the ids and of the decoded bytes."""
    return bpe.digest(docs)


STAGES = [("quality rules", quality), ("line dedup", lines), ("n-gram join", near_duplicates), ("decontamination", decontaminated), ("byte-level BPE", tokens)]

#: Line templates, classes of near copies and BPE merges can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages. Once a stage is written, what it made on its way and the stage before it are deleted, so that no more
    than two copies of the documents lie in the shared folder; the last stage's documents stay, as the result reads them."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        with collected() as made:
            docs = written(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
        for path in [*made, *([before] if before else [])]:
            if path != docs._linkspark_path:
                delete_dir(spark, path)
        before = docs._linkspark_path
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
