"""Keep expensive columns from being evaluated again by later filters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def evaluate_once(df: DataFrame, *names: str) -> DataFrame:
    """Pin columns to one evaluation.

    A filter on a column is normally moved below the projection that defines it, with
    the definition copied along; for a scan that would mean scanning twice.  Filters
    do not move below a generator, so the columns pass through a one-row explode.
    """
    for name in names:
        others = [c for c in df.columns if c != name]
        df = df.select(*others, F.explode_outer(F.array(name)).alias(name))
    return df
