"""Corpus pipeline over `documents`: quality rules, near duplicates, benchmark passages, secrets, packing.

Each stage takes what the one before kept, with the columns of documents; the last gives the packed
pieces. Clean documents pass every filter; secrets are masked within their documents.

Cases: null and empty texts pass the filters that need words to judge by what their operators state (quality rules reject
texts of few words; those without words are no near duplicates and hold no item or secret) and give empty pieces; rows that repeat id and text
become one with the near duplicates; other columns pass as they are, whatever their names; an empty table gives an
empty result in every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslake.llm import decontamination, ngram_join, packing, quality_rules, secret_scan
from corpuslake.llm.runtime import documents, dropped, settled, tune

SHINGLE_WORDS, PERCENT = 5, 80


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    tune(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_rules.accepted(docs, labels.filter(F.col("quality") == 1).select("doc_id"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    tune(spark)
    return ngram_join.one_of_each(docs, SHINGLE_WORDS, PERCENT)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    tune(spark)
    return decontamination.cleaned(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets masked."""
    tune(spark)
    return secret_scan.redacted(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces, packed into sequences."""
    tune(spark)
    return packing.packed(docs, packing.default_tokenizer())


STAGES = [
    ("quality rules", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark_passages),
    ("secret scans", secrets),
    ("best-fit packing", pack),
]

#: Hash tables, edit distances and compressed sizes are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, written = documents(spark, sf_dir), []
    for _, stage in STAGES[:-1]:
        docs = settled(stage(spark, docs, sf_dir))
        dropped(*written)
        written = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
