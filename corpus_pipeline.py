"""From raw documents to packed sequences: five stages, each a training-data operator on all that its predecessor kept.

Each stage takes (spark, docs, sf_dir), is written as Parquet and read again as the next one's ``docs``; all but the last
return the columns of documents, as they came.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyport.llm import _session, op5_packing, op6_decontamination, op7_near_dedup, op8_toxicity, op10_quality_rules

#: Similarity of five-word shingles at which documents count as copies of each other.
NEAR_PERCENT = 80


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base limits, or whose posterior quality is low, go."""
    return op10_quality_rules.filter_documents(docs)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go; labels come from the labels table, for the documents that are left."""
    return op8_toxicity.filter_documents(docs, _session.table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, that with the smallest id; near is 80 per cent of five-word shingles."""
    return op7_near_dedup.deduplicate(docs, percent=NEAR_PERCENT)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of a test item, edited or not, go."""
    return op6_decontamination.decontaminate(docs, _session.table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of what is left, in sequences, with their ids."""
    return op5_packing.pack(docs)


STAGES = [("quality_rules", quality_rules), ("toxicity", toxicity), ("near_dedup", near_dedup), ("decontamination", decontamination), ("packing", packing)]

#: Toxicity scores and alignments cannot be written in SQL; the tests compare with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on all documents; the result is the last stage's."""
    docs = _session.table(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES[:-1]:
        docs = _session.settled(lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            _session.discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
