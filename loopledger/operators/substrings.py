"""Which texts contain which pieces, by equi-joins on short substrings.

Every piece is filed under its rarest gram: of its substrings of three characters, or the whole of
a shorter piece, the one found in the fewest texts.  A text gives its own grams, each once, and meets
only the pieces filed under one of them, so the work follows what occurs and not the number of
pieces.  A piece with a gram that no text has meets none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written

GRAM = 3
#: Offered grams that may be sent to the tasks; more of them are joined.
BROADCAST_GRAMS = 500_000


def grams(text: Column, sizes: tuple[int, ...] = (GRAM,)) -> Column:
    """Distinct substrings of the given sizes; size 0 is the empty text."""
    def of(size: int) -> Column:
        if size == 0:
            return F.array(F.lit(""))
        last = F.length(text) - size + 1
        return F.when(last > 0, F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(text, i, F.lit(size)))).otherwise(
            F.array().cast("array<string>"))

    return F.array_distinct(F.concat(*[of(s) for s in sizes]))


def own_grams(piece: Column) -> Column:
    """Grams that every text with the piece has."""
    return F.when(F.length(piece) >= GRAM, grams(piece)).otherwise(F.array(piece))


def sizes_of(wanted: DataFrame) -> tuple[int, ...]:
    """Sizes of the grams in column gram: a few numbers."""
    return tuple(sorted(r[0] for r in wanted.select(F.length("gram")).distinct().collect()))


def _sent(df: DataFrame) -> DataFrame:
    """A written table with a row for each gram, to be sent to the tasks if it is small."""
    return F.broadcast(df) if df.count() <= BROADCAST_GRAMS else df


def rarest(wanted: DataFrame, offered: DataFrame) -> DataFrame:
    """The gram of each item in (item, gram) that the fewest rows of (gram) offer, if all of them are offered.

    Grams are counted where they are read.  Numbered by rarity, they meet the items in the tasks that hold these,
    so that one number for each item moves.
    """
    counts = written(offered.groupBy("gram").agg(F.count(F.lit(1)).alias("n")), "gram-counts")
    numbered = written(counts.orderBy("n", "gram").select("gram", F.monotonically_increasing_id().alias("place")), "grams")
    found = wanted.join(_sent(numbered), "gram", "left").groupBy("item").agg(F.min(F.coalesce("place", F.lit(-1))).alias("place"))
    return found.where("place >= 0").join(_sent(numbered), "place").select("item", "gram")


def meeting(offered: DataFrame, filed: DataFrame) -> DataFrame:
    """offered joined with the written table filed on gram: only grams under which something is filed move."""
    used = written(filed.select("gram").distinct(), "used-grams")
    return offered.join(_sent(used), "gram", "left_semi").join(filed, "gram")


def containing(texts: DataFrame, pieces: DataFrame) -> DataFrame:
    """(text, piece) of all pairs of distinct texts (text) and pieces (piece) where the text contains the piece."""
    texts, pieces = texts.select("text").distinct(), pieces.select("piece").distinct()
    wanted = pieces.select(F.col("piece").alias("item"), F.explode(own_grams(F.col("piece"))).alias("gram"))
    offered = texts.select("text", F.explode(grams(F.col("text"), tuple(range(GRAM + 1)))).alias("gram"))
    filed = written(rarest(wanted, offered.select("gram")), "filed-pieces")
    met = meeting(offered, filed).where(F.contains("text", "item"))
    return met.select("text", F.col("item").alias("piece"))


def overlapping(names: DataFrame, patterns: DataFrame) -> DataFrame:
    """(obj, method, p_obj, p_method) of all pairs where name and pattern overlap in both parts.

    Two texts overlap if either contains the other, so an empty one overlaps any.  Methods meet by
    their grams in both directions; the objects of what meets are compared.
    """
    names = names.select("obj", "method").distinct()
    patterns = patterns.select(F.col("obj").alias("p_obj"), F.col("method").alias("p_method")).distinct()
    own, given = names.select("method").distinct(), patterns.select("p_method").distinct()
    within = containing(own.select(F.col("method").alias("text")), given.select(F.col("p_method").alias("piece"))).select(
        F.col("text").alias("method"), F.col("piece").alias("p_method"))
    around = containing(given.select(F.col("p_method").alias("text")), own.select(F.col("method").alias("piece"))).select(
        F.col("piece").alias("method"), F.col("text").alias("p_method"))
    methods = within.union(around).distinct()
    return names.join(methods, "method").join(patterns, "p_method").where(
        F.contains("obj", "p_obj") | F.contains("p_obj", "obj")).select("obj", "method", "p_obj", "p_method")
