"""Lines of source units as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.loops import in_loop_flags, mark_lines, numbered_lines
from ..functions.text import split_lines
from .once import evaluate_once


def explode_lines(sources: DataFrame, text: str = "code") -> DataFrame:
    """One row per line: the other columns, ``line_no`` from 1, ``line``."""
    keys = [c for c in sources.columns if c != text]
    rows = sources.select(*keys, F.posexplode_outer(split_lines(F.col(text))).alias("pos", "line"))
    return rows.where(F.col("pos").isNotNull()).select(*keys, (F.col("pos") + 1).alias("line_no"), "line")


def lines_with_scope(sources: DataFrame, language: str, text: str = "code") -> DataFrame:
    """Lines with their ``in_loop`` flag, folded inside each source row: no shuffle."""
    keys = [c for c in sources.columns if c != text]
    lines = sources.select(*keys, split_lines(F.col(text)).alias("lines"))
    numbered = lines.select(*keys, "lines", numbered_lines(F.col("lines")).alias("numbered"))
    marked = numbered.select(*keys, "lines", mark_lines("numbered", language).alias("marks"))
    flagged = marked.select(*keys, "lines", in_loop_flags("marks", language).alias("flags"))
    # outer explode and pinned flags: filters must not bring a second walk below
    rows = evaluate_once(flagged, "flags").select(*keys, "flags", F.posexplode_outer("lines").alias("pos", "line"))
    return rows.where(F.col("pos").isNotNull()).select(
        *keys, (F.col("pos") + 1).alias("line_no"), "line", F.get("flags", F.col("pos")).alias("in_loop")
    )
