"""Reports over scan results.

``results`` has one row per source unit, ``findings`` one row per finding.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import cost
from ..functions.text import capitalize, clip, sql_literal, strip
from ..rules import BUILTIN_RULES, Rule

MONEY = "decimal(18,2)"
TOTAL = "decimal(28,2)"


def _total(field: str) -> Column:
    """Sum of already rounded amounts, independent of row order; 0 for no rows."""
    amount = F.col(f"estimated_cost.{field}").cast(MONEY)
    return F.coalesce(F.sum(amount).cast(TOTAL), F.lit(0).cast(TOTAL)).cast("double")


def cost_totals() -> list[Column]:
    return [
        _total("per_execution_cost").alias("total_per_execution"),
        _total("monthly_cost").alias("total_monthly"),
    ]


def severity_counts(severity: Column) -> list[Column]:
    return [F.count_if(severity == level).alias(level) for level in ("low", "medium", "high")]


def cost_summary(findings: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Totals, cost-severity counts and number of priced findings, overall or per group."""
    return findings.groupBy(*by).agg(
        *cost_totals(),
        *severity_counts(F.col("estimated_cost.severity")),
        F.count("estimated_cost").alias("findings_count"),
        F.lit(cost.DISCLAIMER).alias("disclaimer"),
    )


def severity_histogram(findings: DataFrame) -> DataFrame:
    """Counts by the severity of the finding (not of its cost)."""
    return findings.agg(*severity_counts(F.lower("severity")))


def scan_counts(results: DataFrame) -> DataFrame:
    sized = results.select(F.size("findings").alias("n"))
    return sized.agg(
        F.count("*").alias("total_files"),
        F.count_if(F.col("n") > 0).alias("files_with_issues"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_findings"),
    )


def gate(results: DataFrame, threshold: int = 0) -> DataFrame:
    """One row telling whether a build should fail."""
    return results.agg(F.coalesce(F.sum(F.size("findings")), F.lit(0)).alias("findings_count")).select(
        "findings_count", (F.col("findings_count") > threshold).cast("int").alias("exit_code")
    )


def has_findings(results: DataFrame) -> bool:
    """The gate as a driver-side answer; stops at the first finding."""
    return not results.where(F.size("findings") > 0).isEmpty()


def result_rows(results: DataFrame) -> DataFrame:
    """Results as they are published: line text stripped, findings counted."""
    path = F.col("path")
    shown = F.transform(
        "findings",
        lambda f: F.struct(
            path.alias("file_path"),
            f["line_number"].alias("line_number"),
            strip(f["line_content"]).alias("line_content"),
            *(f[c].alias(c) for c in (
                "rule_id", "rule_name", "description", "severity", "category", "suggestion", "estimated_cost",
            )),
        ),
    )
    return results.select(path.alias("file_path"), "language", "error", shown.alias("findings")).select(
        "file_path", "language", "findings", F.size("findings").alias("findings_count"), "error"
    )


def clean_files(results: DataFrame) -> DataFrame:
    """Units scanned without error and without finding.

    Results keep one row per unit, so this is a filter and needs no anti-join.
    """
    return results.where(F.col("error").isNull() & (F.size("findings") == 0)).select("path", "language")


def _unit_total(field: str) -> Column:
    """Sum of already rounded amounts inside one result."""
    amounts = F.transform("findings", lambda f: F.coalesce(f["estimated_cost"][field].cast(TOTAL), F.lit(0).cast(TOTAL)))
    return F.aggregate(amounts, F.lit(0).cast(TOTAL), lambda a, b: (a + b).cast(TOTAL)).cast("double")


def findings_by_file(results: DataFrame) -> DataFrame:
    """Totals of every unit with findings.

    A result holds all of its unit, so nothing is regrouped, and units without a path of
    their own stay apart.
    """
    keys = [c for c in results.columns if c not in ("findings", "error")]
    return results.where(F.size("findings") > 0).select(
        *keys,
        F.size("findings").cast("long").alias("findings_count"),
        F.array_min(F.transform("findings", lambda f: f["line_number"])).alias("first_line"),
        _unit_total("per_execution_cost").alias("total_per_execution"),
        _unit_total("monthly_cost").alias("total_monthly"),
    )


def top_files(results: DataFrame, k: int = 10) -> DataFrame:
    """The k costliest units by monthly cost."""
    totals = findings_by_file(results).drop("first_line")
    ties = [c for c in ("path", "file_id") if c in totals.columns]
    return totals.orderBy(F.desc("total_monthly"), *ties).limit(k)


def cost_rollup(findings: DataFrame) -> DataFrame:
    """Sub-totals by language, category and rule; ``level`` is the grouping id."""
    by = ["language", "category", "rule_id"]
    amounts = {"total_per_execution": "per_execution_cost", "total_monthly": "monthly_cost"}
    # a few rows per rule are left before the roll-up multiplies them
    groups = findings.groupBy(*by).agg(F.count("*").alias("n"), *(
        F.sum(F.col(f"estimated_cost.{field}").cast(MONEY)).cast(TOTAL).alias(name) for name, field in amounts.items()))
    return groups.rollup(*by).agg(
        F.grouping_id().alias("level"), F.sum("n").alias("findings_count"),
        *(F.coalesce(F.sum(name).cast(TOTAL), F.lit(0).cast(TOTAL)).cast("double").alias(name) for name in amounts),
    )


def why_text(findings: DataFrame, rules: Sequence[Rule] = BUILTIN_RULES) -> DataFrame:
    """Add ``why``: the rule's explanation, or the description where it has none."""
    texts = F.expr(sql_literal({r.rule_id: r.why for r in rules if r.why}, map_keys=True))
    return findings.withColumn("why", F.coalesce(F.try_element_at(texts, F.col("rule_id")), "description"))


def report_lines(findings: DataFrame) -> DataFrame:
    """The pieces of a printed finding."""
    priced = F.col("estimated_cost")
    return findings.select(
        "path", "seq",
        F.concat(F.lit("["), F.upper("severity"), F.lit("] "), "rule_name").alias("headline"),
        F.concat(F.lit("Rule: "), "rule_id").alias("rule"),
        F.concat_ws(":", "path", F.col("line_number").cast("string")).alias("location"),
        clip(F.col("line_content")).alias("code"),
        F.col("description"),
        F.concat(
            F.lit("Estimated: "), cost.report_cost_text(priced["per_execution_cost"]), F.lit("/execution → "),
            cost.report_cost_text(priced["monthly_cost"]), F.lit("/month"),
        ).alias("cost"),
        F.concat(F.lit("Recommended Fix: "), "suggestion").alias("fix"),
        capitalize(F.col("language")).alias("language_name"),
        capitalize(F.col("severity")).alias("severity_name"),
    )
