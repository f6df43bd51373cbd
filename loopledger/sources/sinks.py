"""Result sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..plans.report import result_rows, scan_counts
from ..session import folder_store


def write_json(results: DataFrame, folder: str) -> None:
    """Per-unit results with nested findings under ``results``, counts under ``summary``.

    The counts are taken while the results are written; nothing is scanned or read twice.  The
    summary comes last, so results without one belong to a run that did not end.
    """
    spark, counted = results.sparkSession, Observation()
    store, summary = folder_store(spark, f"{folder}/summary")
    store.delete(summary, True)
    sizes = F.coalesce(F.size("findings"), F.lit(0))
    seen = results.observe(
        counted, F.count("*").alias("total_files"), F.count_if(sizes > 0).alias("files_with_issues"),
        F.coalesce(F.sum(sizes), F.lit(0)).cast("long").alias("total_findings"))
    result_rows(seen).write.mode("overwrite").json(f"{folder}/results")
    names = scan_counts(results).columns
    spark.createDataFrame([tuple(counted.get[n] for n in names)], ", ".join(f"{n} long" for n in names)).coalesce(1).write.json(
        f"{folder}/summary")


def write_findings(findings: DataFrame, folder: str) -> None:
    findings.write.mode("overwrite").partitionBy("language").parquet(folder)


def to_json_rows(results: DataFrame) -> DataFrame:
    """Each result as one JSON text."""
    rows = result_rows(results)
    return rows.select("file_path", F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("json"))
