"""Connected components of a graph in a table, by alternating star contraction.

Every round sends each node's larger, then its smaller neighbours to the least neighbour, until
nothing moves: the number of rounds grows with the logarithm of the component size.  Each
round is written to shared storage, so a lost executor costs one round.  Minima are taken with
partial aggregation and joined back, so a hub is never gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loopledger.llm.shared import by_key, discard, workspace, written

#: Edges up to which Spark may send minima to the tasks; it guesses their number from compressed files.
SENT_EDGES = 100_000


def _to_least(edges: DataFrame, few: bool) -> DataFrame:
    """Each node u with neighbours v, as (u, v, least of u and all its v)."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    return edges.join(least if few else by_key(least), "u").select("u", "v", F.least("u", "m").alias("m"))


def _state(edges: DataFrame) -> tuple:
    """Number of edges and a sum over them, equal if nothing moved."""
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of (u, v) rows but the least of each component, which names it."""
    spark = edges.sparkSession
    folder = workspace(spark, "components")
    both = edges.select("u", "v").where("u <> v")
    now = written(both.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), f"{folder}/0")
    before, n = _state(now), 0
    while True:
        n, few = n + 1, before[0] <= SENT_EDGES
        sides = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _to_least(sides, few).where("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = written(large.distinct(), f"{folder}/{n}-large")
        small = _to_least(large, few)  # here v < u in every row
        moved = small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(
            small.select("u", F.col("m").alias("v")))
        now = written(moved.distinct(), f"{folder}/{n}")
        state = _state(now)
        discard(spark, f"{folder}/{n}-large", f"{folder}/{n - 1}")
        if state == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
        before = state
