"""Shards cut from a Hilbert curve over several metadata columns, with DataFrame functions only.

Every column is quantised to cells of about equal numbers of rows; the cell coordinates give an
index on the Hilbert curve, whose neighbours are neighbours in every column; rows are sorted by
it and cut into runs.  A run spans a small range of each column at once, so a reader that filters
on any of them skips most files by their minima and maxima.

Runs are equal in rows (at most one apart), whatever one value, source or group of copies holds:
rows of one cell are ordered by checksum and id, so a cell that fills a third of the corpus spreads
over tasks and shards like any other.  Positions come from a range-partitioned sort and the sums of
its partitions; only those sums and the cells' lower bounds reach the driver, and their numbers are
fixed by the number of partitions and cells.

Defined cases: a null or empty text has size 1 and checksum 0; null values of a column come before
all others; equal and repeated rows get places of their own next to each other; fewer rows than
shards leave shards empty; an empty table gives no rows; carried columns whose names clash with
the added ones are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loopledger.llm.shared import workspace, written

SHARDS = 16
#: Cells of each column: two to this power.
BITS = 6
DIMENSIONS = ("lang", "source", "size")
ADDED = ("size", "text_crc32", "law", "curve", "shard", "slot", "grown_shard")


def curve_steps(n: int = 3) -> list[list[int]]:
    """For every state of the curve and every corner of a cube: digit on the curve and next state, as digit + 2^n state.

    A state is the corner where the curve enters and the direction in which it leaves; within it,
    corners are visited along a Gray code that is turned and mirrored accordingly.
    """
    size, every = 1 << n, range(1 << n)

    def turned(x: int, by: int) -> int:
        by %= n
        return (x << by | x >> (n - by)) & (size - 1)

    gray = [w ^ w >> 1 for w in every]
    place = {g: w for w, g in enumerate(gray)}
    entry = [0] + [gray[2 * ((w - 1) // 2)] for w in every[1:]]
    ones = [(~w & w + 1).bit_length() - 1 for w in every]  # set bits at the end of w
    leave = [0] + [ones[w - 1] % n if w % 2 == 0 else ones[w] % n for w in every[1:]]
    table = []
    for state in range(size * n):
        enter, way = divmod(state, n)
        row = []
        for corner in every:
            w = place[turned(corner ^ enter, -(way + 1))]
            after = (enter ^ turned(entry[w], way + 1)) * n + (way + leave[w] + 1) % n
            row.append(w + size * after)
        table.append(row)
    return table


def hilbert_index(cells: Sequence[str], bits: int = BITS) -> Column:
    """Curve index of integer columns that hold cells below 2^bits."""
    n = len(cells)
    flat = ",".join(str(x) for row in curve_steps(n) for x in row)
    corner = "|".join(f"shiftleft(shiftright({c}, b) & 1, {n - 1 - k})" for k, c in enumerate(cells))
    step = f"get(steps, shiftright(a.step, {n}) * {1 << n} + ({corner}))"
    # the step is found first, then taken apart; a.at lags one digit behind
    folded = (f"aggregate(sequence({bits - 1}, 0), named_struct('at', 0L, 'step', 0), (a, b) -> named_struct("
              f"'at', shiftleft(a.at, {n}) | (a.step & {(1 << n) - 1}), 'step', {step}), "
              f"a -> shiftleft(a.at, {n}) | (a.step & {(1 << n) - 1}))")
    return F.expr(folded.replace("steps", f"array({flat})"))


def running(df: DataFrame, order: Sequence[str], weight: Column, folder: str) -> tuple[DataFrame, int]:
    """df with before, the weight of all rows that sort before each row, and the weight of all rows."""
    ranged = written(df.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), folder)
    sums = ranged.groupBy("part").agg(F.sum(weight).alias("w")).orderBy("part").collect()  # a row a partition
    before, total = {}, 0
    for r in sums:
        before[r["part"]] = total
        total += r["w"]
    offsets = F.array(*[F.lit(before.get(k, 0)).cast("long") for k in range(max(before, default=0) + 1)])
    within = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    place = F.get(offsets, F.col("part")) + F.coalesce(F.sum(weight).over(within), F.lit(0))
    return ranged.withColumn("before", place.cast("long")).drop("part"), total


def cell_bounds(df: DataFrame, column: str, bits: int, folder: str) -> list[tuple]:
    """(least value, cell) for up to 2^bits cells of about equal numbers of rows; null, if there, is below them all."""
    values = df.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    placed, total = running(values, ["value"], F.col("n"), folder)
    if not total:
        return []
    cell = F.expr(f"before * {1 << bits} div {total}")
    least = placed.where("value IS NOT NULL").groupBy(cell.alias("cell")).agg(F.min("value").alias("least"))
    return sorted((r["least"], r["cell"]) for r in least.collect())  # at most 2^bits rows


def _cell(value: Column, bounds: list[tuple], kind: str) -> Column:
    """The last cell whose least value is reached; null is in the first."""
    lows = F.array(*[F.lit(low) for low, _ in bounds]).cast(f"array<{kind}>")
    numbers = F.array(*[F.lit(cell) for _, cell in bounds]).cast("array<int>")
    reached = F.size(F.filter(lows, lambda low: low <= value))
    return F.when(value.isNull() | (reached < 1), 0).otherwise(F.get(numbers, reached - 1))


def place_on_curve(
    docs: DataFrame, carry: Sequence[str], dimensions: Sequence[str] = DIMENSIONS, shards: int = SHARDS, bits: int = BITS
) -> DataFrame:
    """Carried columns with size, text_crc32, law, curve, shard, slot and grown_shard, one row a document."""
    folder = workspace(docs.sparkSession, "hilbert")
    carried = [c for c in carry if c.lower() not in ADDED]
    text = F.coalesce(F.col("text"), F.lit(""))
    measured = docs.withColumns({"size": F.octet_length(text).cast("long") + 1, "text_crc32": F.crc32(text)})
    rows = written(measured.select(
        F.struct(*[F.col(f"`{c}`") for c in carried]).alias("row"), "size", "text_crc32",
        F.col("doc_id").cast("string").alias("tie"),
        *[F.col(f"`{c}`").alias(f"d{k}") for k, c in enumerate(dimensions)]), f"{folder}/rows")
    cells = {}
    for k in range(len(dimensions)):
        bounds = cell_bounds(rows, f"d{k}", bits, f"{folder}/cells-{k}")
        cells[f"c{k}"] = _cell(F.col(f"d{k}"), bounds, rows.schema[f"d{k}"].dataType.simpleString())
    on_curve = rows.withColumns(cells).withColumn("curve", hilbert_index(list(cells), bits)).select(
        "row", "size", "text_crc32", "tie", "curve")
    placed, total = running(on_curve, ["curve", "text_crc32", "tie"], F.lit(1), f"{folder}/sorted")
    n = max(total, 1)
    shard = F.expr(f"before * {shards} div {n}")
    return placed.withColumn("shard", shard.cast("int")).select(
        *[F.col(f"row.`{c}`").alias(c) for c in carried], "size", "text_crc32", F.lit("rows").alias("law"), "curve",
        "shard", F.expr(f"before - (shard * {n}L + {shards - 1}) div {shards}").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, dimensions: Sequence[str] = DIMENSIONS, shards: int = SHARDS) -> None:
    """All columns of docs as one folder a shard, each in curve order, so that file statistics prune on any dimension."""
    placed = place_on_curve(docs, docs.columns, dimensions, shards)
    placed.repartition(shards, "shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
