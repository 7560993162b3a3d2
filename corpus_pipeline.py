"""The corpus pipeline: its stages, each written as Parquet and read again as the next one's documents.

Results for odd input, in all stages: null texts are empty ones and null ids are ids;
rows that are repeated share one fate, and rows of one id with other texts are
documents of their own; other columns, also ones with names that an operator uses
inside, are passed by up to the last stage, whose columns are its own; an empty
table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from termloom.llm import near_dedup, packing, quality, suffix_dedup, toxicity
from termloom.llm.bpe import tokenizer_path
from termloom.llm.common import table, written


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose toxicity is one half or more; the model is fitted on the labels."""
    return toxicity.drop_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that fail the base or are more likely low than good."""
    return quality.keep_good(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates, linked from a similarity of 0.8 on, the document with the least doc_id stays."""
    return near_dedup.drop_near_duplicates(docs, link=near_dedup.STAGE_LINK)


def suffix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts what stands earlier in the corpus from the texts; every document stays."""
    return suffix_dedup.remove_repeats(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all token pieces in sequences."""
    return packing.packed_documents(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [("toxicity", toxicity_stage), ("quality", quality_stage), ("near_dedup", near_dedup_stage), ("suffix_dedup", suffix_stage), ("packing", packing_stage)]
#: SQL can't express the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
