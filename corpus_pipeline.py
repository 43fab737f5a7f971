"""Corpus pipeline: language ID, near duplicates, decontamination, PII masking, source mixing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; ``run`` writes each stage's
result as Parquet in the shared folder and reads it again as the next stage's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tipflow.llm import decontaminate, langid, mixing, ngram_join, pii
from tipflow.llm.common import _paths, drop_written, small_batches, table, written


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that language ID accepts, as they are; it learns from their own lang labels.

    Without a labelled text there is no model to reject by, and all documents stay.  With one, null
    texts and texts without a letter go.  Repeated rows and null doc_ids are rows like others.
    """
    small_batches(spark)  # the join sets this too, but executors keep what the first stage makes them take
    # the row travels as one struct, so no name of its columns can clash
    rows = docs.select(F.struct(*docs.columns).alias("_row"), "text", "lang")
    return langid.identify(rows, F.lit(True), ["_row"]).where("not (rejected and learned)").select("_row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of the n-gram Jaccard join: the one with the smallest doc_id.

    Rows that repeat a doc_id or have none are judged each by their own text; rows without words stay.
    """
    return ngram_join.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item, judged by their texts; null texts stay."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind; null texts stay null."""
    return pii.masked(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of all documents left, an empty result of none."""
    return mixing.mix(docs)


STAGES = [
    ("language_id", language),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", decontamination),
    ("pii", personal_data),
    ("source_mixing", source_mix),
]
# Language models and the R-tree join cannot be expressed in SQL; tests/llm checks the rows by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table of documents.

    Once a stage's result is written, the tables it wrote on the way and the result before it are deleted.
    """
    docs = table(spark, sf_dir, "documents")
    begin = len(_paths)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
        drop_written(spark, begin, len(_paths) - 1)
    return STAGES[-1][1](spark, docs, sf_dir)
