"""The corpus pipeline: toxicity, exact dedup, near dedup, benchmark decontamination, packing.

Each stage works on all that the one before kept, and what it decides takes effect: toxic documents go, one document of
each group of exact or near copies stays (the largest id of exact copies, the smallest of near ones), documents that hold
a benchmark window go, the rest is packed. Every stage's result is written as Parquet in the shared folder and read again.

A row is known by its doc_id and its text together, nulls included: what a stage drops are rows, never all rows of an id. Null
texts count as empty. Of rows that repeat an id and a text one passes exact dedup; of equal texts the one with the largest id
stays, a null id only where there is no other. An empty table passes through all stages; further columns, of any name, stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.llm.common import discard, fresh, table, text_print, without_rows, written
from loam.llm.decontaminate import clean_documents
from loam.llm.exact_dedup import exact_duplicates
from loam.llm.near_dedup import near_duplicates
from loam.llm.packing import pack_documents
from loam.llm.toxicity import without_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5; the network learns from the labelled rows outside the held-out fifth."""
    return without_toxic(docs, table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, the one with the largest id; of rows that repeat an id and text, one."""
    found = written(exact_duplicates(docs).select("doc_id", "print", "kept", "group_size"))
    out = without_rows(docs, found.where("NOT kept"))
    if found.where("kept AND group_size > 1").groupBy("doc_id", "print").count().where("count > 1").limit(1).count():
        mark = fresh(docs, "print")
        out = out.withColumn(mark, text_print()).dropDuplicates(["doc_id", mark])
    return out.select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates, the one with the smallest id; texts without words all stay."""
    return without_rows(docs, near_duplicates(docs).where("NOT stays").select("doc_id", "print"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark window."""
    return clean_documents(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of what is left, in sequences of at most 2048 tokens."""
    return pack_documents(docs)


STAGES = [("toxicity", toxicity), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("decontamination", decontamination), ("packing", packing)]
#: A trained network decides in the first stage, which SQL cannot express; tests/llm/test_pipeline.py has the brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        before, docs = docs, written(stage(spark, docs, sf_dir))
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
