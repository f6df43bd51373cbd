"""Documents to training sequences: five stages, each written as Parquet and read by the next.

Toxic documents go; boilerplate lines go; of every group of near copies one document stays, the
one with the least doc_id (or, in a group without any id, one row); benchmark passages are cut
out; what is left is tokenized and packed.  Documents that no stage objects to pass unchanged.

All stages but the last return the columns of documents, with n_chars following a changed text.
Null texts pass every stage; they count as empty, so with the empty ones they are one group of
near copies, of which one row stays.
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from loopledger.llm import best_fit, fm_decontaminate, line_frequency, shingle_copies, toxicity  # noqa: E402
from loopledger.llm.queries import quarter  # noqa: E402
from loopledger.llm.shared import table, workspace, written  # noqa: E402

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the grammar scores below the threshold, as it learned from the given labels."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), quarter)
    return docs.select(*COLUMNS).where(toxicity.scorer(model)("text") < toxicity.THRESHOLD)


def drop_boilerplate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that many documents of their source have for the lines' length."""
    cleaned = line_frequency.drop_boilerplate(docs.select(*COLUMNS))
    changed = cleaned.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(
        F.col("n_chars")))
    return changed.select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group whose fingerprints are linked within four bits; of these, one of
    every group linked by a similarity of five-word shingles of 0.8 or more."""
    return shingle_copies.one_of_each_near_copy(docs.select(*COLUMNS))


def cut_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the words of any benchmark window."""
    benchmark = table(spark, sf_dir, "benchmark")
    cut = fm_decontaminate.remove_contamination(docs.select(*COLUMNS), benchmark)
    return cut.withColumn("n_chars", F.when(F.size("spans") > 0, F.length("text").cast("long")).otherwise(
        F.col("n_chars"))).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each piece of each document, with its sequence."""
    return best_fit.best_fit_sequences(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_boilerplate_lines),
    ("simhash_near_dedup", drop_near_copies),
    ("benchmark_decontamination", cut_benchmark_passages),
    ("best_fit_packing", pack_sequences),
]

#: SQL expresses neither the grammar nor the packing; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents."""
    docs, folder = table(spark, sf_dir, "documents"), workspace(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        docs = written(stage(spark, docs, sf_dir), f"{folder}/{k}-{name}")
    return docs
