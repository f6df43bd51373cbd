"""Parquet tables of a directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


SPREAD = "spark.loopledger.spread"


def spread(df: DataFrame, key: str) -> DataFrame:
    """Deal rows to as many tasks as the session asks for in ``spark.loopledger.spread``.

    Meant for inputs of a few files on many cores.  Without the setting nothing moves.
    """
    tasks = df.sparkSession.conf.get(SPREAD, None)
    return df.repartition(int(tasks), key) if tasks else df
