"""Streaming findings and running totals.

The scan keeps no state between units, so the batch operator runs unchanged on a
stream; only the totals keep state, one row per category.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.scan import findings_of, scan
from ..plans.report import cost_summary


def stream_findings(sources: DataFrame, **options) -> DataFrame:
    """Findings of a streaming DataFrame of source units."""
    return findings_of(scan(sources, **options))


def stream_totals(findings: DataFrame) -> DataFrame:
    """Running totals per category; use output mode ``complete``."""
    return cost_summary(findings, by=["category"]).drop("disclaimer")


def write_stream(findings: DataFrame, folder: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Append findings to parquet; each arriving unit is reported exactly once."""
    return (
        findings.writeStream.format("parquet").outputMode("append")
        .option("path", folder).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True})).start()
    )


def read_totals(spark: SparkSession, folder: str) -> DataFrame:
    """The latest totals: readers never meet a folder that is being replaced."""
    kept = spark.read.parquet(folder)
    return kept.where(F.col("batch") == kept.agg(F.max("batch")).scalar()).drop("batch")


def write_totals(totals: DataFrame, folder: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Keep the totals of every batch; a batch that is run again replaces only its own."""

    def replace(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return (
        totals.writeStream.outputMode("complete").foreachBatch(replace)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True})).start()
    )
