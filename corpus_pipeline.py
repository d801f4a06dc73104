"""The corpus pipeline: five stages, each an operator of lexloom.llm over all that the one before kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
``documents``. run() writes each stage's rows as Parquet to the shared folder, reads them again, and removes
those of the stage before.

Defined cases, in every stage: a null text counts as an empty one (which the quality rules reject; given to a later
stage, null and empty texts are one class of near-duplicates); a null or repeated doc_id doesn't make two documents one,
rows that agree in id and text are; of ties the least doc_id, then the least hash of the text stays; columns beside those of
``documents`` come through, whatever their names; texts of any length are taken whole; an empty table stays empty.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from lexloom.llm import decontaminate, lines, pieces, quality, similar, simhash
from lexloom.llm.common import removed, shared_folder, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality.keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat an earlier one, or nearly so, go; every document stays."""
    return lines.dedup_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: those linked by a similarity of 0.8 or more over five-word shingles.

    SimHash fingerprints bring close copies together, an exact join the pairs that lie further apart than their two bits.
    """
    return simhash.keep_one(docs, classes=similar.classes)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak a benchmark item go."""
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, exact, ids."""
    return pieces.encode_texts(docs)


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_dedup), ("simhash_near_dedup", near_dedup), ("benchmark_decontamination", decontamination), ("sentencepiece", encoding)]
#: Regular expressions with look-behind, XXH64 and the tokeniser are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
        if k:
            removed(spark, f"{folder}/{k - 1}-{STAGES[k - 1][0]}")
    return docs
