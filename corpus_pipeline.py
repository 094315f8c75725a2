"""The training-data pipeline: quality filter, near-duplicate removal, decontamination, tokens.

Each stage takes (spark, docs, sf_dir), works on every row that the stage before kept and returns
a DataFrame; all but the last return the columns of documents.  ``run`` writes each stage's rows
as Parquet in the shared folder and reads them back, so a lost executor costs one stage at most; a
stage's rows are deleted once the next stage's are written.

Defined cases, for every stage: null and empty texts are texts like others (the classifier gives them
the score of its intercept, they are near-duplicates of nothing, contain no benchmark item, and have
no tokens); very long texts are worked on whole; rows that repeat an id are judged one by one; rows
without an id are judged like all others; an empty table goes through; other columns of documents are
kept as they are up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assay.llm import bpe, decontaminate, near_dedup, quality
from assay.llm.common import table
from assay.sources.scratch import discard, materialise

#: Percent of shared 5-word shingles from which two documents are near-duplicates in the pipeline: the
#: lowest that a near-duplicate stage may take, since one changed word alters five shingles, and a copy
#: with a few edits falls below a stricter one.
SIMILARITY = 80


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores at 0.5 or more; labels come from the held-in fold alone."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model).where("predicted = 1").select(docs.columns)


def near_dedup_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, with an id or without."""
    return near_dedup.deduplicate(docs, threshold=SIMILARITY, apart=False)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no benchmark item contaminates."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the bytes they decode to."""
    return bpe.round_trip(docs.select(F.col("doc_id").cast("long"), "text")).drop("text")


STAGES = [
    ("quality_classifier", quality_filter),
    ("near_dedup", near_dedup_filter),
    ("decontamination", decontamination),
    ("byte_bpe", tokens),
]

#: No SQL: a fitted classifier, components and BPE are beyond it; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the documents table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before, docs = docs, materialise(stage(spark, docs, sf_dir), name)
        discard(before)  # the documents table itself is no table of materialise, and stays
    return docs
