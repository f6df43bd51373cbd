"""Prices from tables: other unit costs, observed iteration counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import cost
from ..functions.match import final_severity


def price_with(
    findings: DataFrame, unit_costs: DataFrame, iterations: int | None = None, categories: Sequence[str] = tuple(cost.UNIT_COSTS)
) -> DataFrame:
    """Findings re-priced from a table ``category, unit_cost``; a category it lacks
    costs nothing, and of several prices for one the highest counts.

    Findings have the categories of their rules, so the table is cut down to those and
    reaches every task as one small map: the findings do not move.
    """
    prices = (
        unit_costs.where(F.col("category").isin(*categories)).groupBy("category").agg(F.max("unit_cost").alias("price"))
        .agg(F.map_from_entries(F.collect_list(F.struct("category", "price")))).scalar()
    )
    price = F.coalesce(F.try_element_at(prices, F.col("category")), F.lit(0.0))
    return findings.withColumn("estimated_cost", cost.estimate(F.col("category"), iterations, price=price))


def calls_per_run(events: DataFrame, key: str, time: str, gap: str = "30 minutes") -> DataFrame:
    """(key, runs, calls, iterations): calls of a unit cut into runs by pauses longer than a gap; iterations are those of
    its longest run.

    The calls of a run are summed before they are shuffled, so a unit of very many calls is no more than its runs.
    """
    runs = events.where(F.col(time).isNotNull()).groupBy(key, F.session_window(time, gap).alias("run")).agg(F.count("*").alias("n"))
    return runs.groupBy(key).agg(F.count("*").alias("runs"), F.sum("n").alias("calls"), F.max("n").alias("iterations"))


def price_with_counts(results: DataFrame, call_counts: DataFrame, key: str = "file_id") -> DataFrame:
    """Results re-priced with the iterations observed per unit (``key, iterations``).

    The join is per unit, not per finding, so it stays one row to one row.  Units
    without a count keep the default; of several counts for a unit the highest counts.
    """
    counted = results.join(call_counts.groupBy(key).agg(F.max("iterations").alias("observed")), key, "left")

    def reprice(finding):
        estimate = cost.estimate(finding["category"], F.col("observed"))
        repriced = finding.withField("estimated_cost", estimate)
        return repriced.withField(
            "severity", final_severity(finding["severity"], F.col("language"), repriced["estimated_cost"]["severity"])
        )

    return counted.select(
        *(c for c in results.columns if c != "findings"),
        F.transform("findings", reprice).alias("findings"),
    )
