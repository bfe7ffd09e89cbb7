"""Training corpus pipeline: quality rules, toxicity, exact copies, near copies, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexmill.llm.common import table
from lexmill.llm.exact_dedup import drop_duplicates
from lexmill.llm.jaccard_join import drop_near_copies
from lexmill.llm.packing import pack
from lexmill.llm.quality import keep_good
from lexmill.llm.queries import tokenizer_path
from lexmill.llm.toxicity import drop_toxic
from lexmill.session import scratch, stage


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule and the voting rules keep."""
    return keep_good(docs)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under the toxicity threshold."""
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text."""
    return drop_duplicates(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies."""
    return drop_near_copies(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all remaining documents, placed in sequences."""
    return pack(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality_stage),
    ("toxicity", toxicity_stage),
    ("exact_dedup", exact_stage),
    ("ngram_jaccard_join", near_stage),
    ("packing", packing_stage),
]

#: The stages fit models and follow links, which SQL can't express; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each returns is written as Parquet and read again, and what it staged is removed."""
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES[:-1]:
        with scratch(spark):
            docs = stage(function(spark, docs, sf_dir), name, keep=True)
    return STAGES[-1][1](spark, docs, sf_dir)
