"""A corpus from raw documents to a mix: each stage calls one operator of ``codeloom.llm``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm import jaccard_join, personal_data, quality_rules, source_mix, winnowing
from codeloom.llm.base import Scratch, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Near copies share this much of their shingles; op7's own query has a contract of its own.
SHINGLE_WORDS, SHINGLE_PERCENT = 5, 80


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that break a quality rule go."""
    return quality_rules.keep_good(docs.select(*COLUMNS))


def duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of the Jaccard join stays; five-word shingles, 0.8 or more."""
    return jaccard_join.Join(docs, n=SHINGLE_WORDS, percent=SHINGLE_PERCENT).kept(docs.select(*COLUMNS))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share a window with the benchmark go."""
    return winnowing.clean(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data are replaced by their kind; all documents stay, ``n_chars`` follows the text."""
    clean = personal_data.redact(docs.select(*COLUMNS), personal_data.train(docs))
    return clean.withColumn("n_chars", F.coalesce(F.char_length("text").cast("long"), "n_chars"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes."""
    return source_mix.mix(docs)


STAGES = [
    ("quality_rules", quality),
    ("jaccard_join", duplicates),
    ("winnowing", decontamination),
    ("personal_data", personal),
    ("source_mix", mixing),
]

#: Components and message passing have no SQL form; tests/llm compare the stages with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage over the documents; each result is written and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch.settle(name, stage(spark, docs, sf_dir))
    return docs
