"""Cost estimate of a finding and its rendering."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import sql_literal

# Prices per call in rupees, defaults and bands.
UNIT_COSTS = {
    "database_read": 0.002,
    "database_write": 0.004,
    "api_call": 0.01,
    "serialization": 0.0001,
}
DEFAULT_ITERATIONS = 100
DAYS_PER_MONTH = 30
HIGH_ABOVE, MEDIUM_ABOVE = 100.0, 10.0
DISCLAIMER = "Approximate estimate for awareness, not exact billing."
RUPEE = "₹"


def money(amount: Column, digits: int = 2) -> Column:
    """Fixed-point text without grouping, rounded on the exact binary value."""
    return F.translate(F.format_number(amount, digits), ",", "")


def round2(amount: Column) -> Column:
    """Two decimals, half-even on the exact binary value, as Python's ``round``.

    ``round`` and ``bround`` work on the shortest decimal text of the double and
    differ on values such as 0.285; number formatting does not.
    """
    return money(amount).cast("double")


def unit_cost(category: Column, costs: Mapping[str, float] = UNIT_COSTS) -> Column:
    """Price of one call; an unknown category costs nothing."""
    price = F.lit(0.0)
    for name, value in costs.items():
        price = F.when(category == name, F.lit(float(value))).otherwise(price)
    return price


def effective_iterations(iterations: Column | int | None) -> Column:
    value = iterations if isinstance(iterations, Column) else F.lit(iterations)
    return F.coalesce(F.nullif(value.cast("long"), F.lit(0)), F.lit(DEFAULT_ITERATIONS).cast("long"))


def cost_severity(monthly: Column) -> Column:
    return (
        F.when(monthly > HIGH_ABOVE, "high").when(monthly > MEDIUM_ABOVE, "medium").otherwise("low")
    )


def estimate(
    category: Column,
    iterations: Column | int | None = None,
    price: Column | None = None,
    costs: Mapping[str, float] = UNIT_COSTS,
) -> Column:
    """Struct of unit cost, iterations, rounded costs and cost severity."""
    unit = unit_cost(category, costs) if price is None else F.coalesce(price, F.lit(0.0))
    times = effective_iterations(iterations)
    per_execution = unit * times
    monthly = per_execution * DAYS_PER_MONTH
    return F.struct(
        category.alias("category"),
        unit.alias("unit_cost"),
        times.alias("iterations"),
        round2(per_execution).alias("per_execution_cost"),
        round2(monthly).alias("monthly_cost"),
        cost_severity(monthly).alias("severity"),
    )


def constant_estimate(category: str, costs: Mapping[str, float] = UNIT_COSTS, iterations: int | None = None) -> dict:
    """The same estimate for values known before the job starts."""
    unit = float(costs.get(category, 0.0))
    times = iterations or DEFAULT_ITERATIONS
    monthly = unit * times * DAYS_PER_MONTH
    severity = "high" if monthly > HIGH_ABOVE else "medium" if monthly > MEDIUM_ABOVE else "low"
    return {
        "category": category, "unit_cost": unit, "iterations": times,
        "per_execution_cost": round(unit * times, 2), "monthly_cost": round(monthly, 2), "severity": severity,
    }


def cost_map(costs: Mapping[str, float] = UNIT_COSTS, iterations: int | None = None) -> Column:
    """Estimates as a constant map from category; other categories have no estimate."""
    categories = {**UNIT_COSTS, **costs}
    return F.expr(sql_literal({c: constant_estimate(c, costs, iterations) for c in categories}, map_keys=True))


def quick_estimate(category: Column, iterations: Column | int | None = DEFAULT_ITERATIONS) -> Column:
    """Estimate by category name; an unknown name fails the job."""
    known = F.when(category.isin(*UNIT_COSTS), category).otherwise(
        F.raise_error(F.concat(F.lit("unknown cost category: "), F.coalesce(category, F.lit("null"))))
    )
    return estimate(known, iterations)


def cost_text(amount: Column) -> Column:
    """Library wording: more digits the smaller the amount."""
    text = (
        F.when(amount >= 1000, F.format_number(amount, 2))
        .when(amount >= 1, money(amount, 2))
        .when(amount >= 0.01, money(amount, 4))
        .otherwise(money(amount, 6))
    )
    return F.concat(F.lit(RUPEE), text)


def report_cost_text(amount: Column) -> Column:
    """Wording of the text report."""
    text = (
        F.when(amount >= 1000, F.format_number(amount, 2))
        .when(amount >= 0.01, money(amount, 2))
        .otherwise(money(amount, 4))
    )
    return F.concat(F.lit(RUPEE), text)


def indian_cost_text(amount: Column) -> Column:
    """As the report, but thousands are grouped the Indian way (12,34,567.89)."""
    plain = money(amount, 2)
    grouped = F.regexp_replace(plain, r"(?<=\d)(?=(\d\d)*\d{3}\.)", ",")
    text = (
        F.when(amount >= 1000, grouped)
        .when(amount >= 0.01, plain)
        .otherwise(money(amount, 4))
    )
    return F.concat(F.lit(RUPEE), text)
