"""Scan each distinct content once and hand its result to every copy, also from one run to the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import folder_store, written
from .scan import resolve_sources, scan

# A content counts as hot when its copies exceed this share of all units, so there
# are at most 1 / HOT_SHARE hot contents: small enough to broadcast at any scale.
HOT_SHARE = 0.001
LEAST_HOT_SHARE = 0.0001
HOT_SALTS = 64
#: Units to scan that may be sent to every task as a set of numbers (about 16 bytes each); beyond, texts meet them in a join.
BROADCAST_UNITS = 2_000_000


def scan_distinct(files: DataFrame, hot_share: float = HOT_SHARE, salts: int = HOT_SALTS, **options) -> DataFrame:
    """``scan`` for a corpus full of copies: the units' columns without the code, then
    ``language, copies, error, findings``; one row for every unit.

    A result depends on text and language only.  Of the units that share both, one is
    chosen by a number on a narrow table; the numbers of the chosen ones are a filter on the units,
    which are then scanned where they are read, so no text moves.
    Hot contents are spread over ``salts`` join keys on their way back to the units.
    Units without a text, as where the reader met an error, go past all this.  Units equal in every column may be scanned more than once.
    """
    if not LEAST_HOT_SHARE <= hot_share <= 1:
        raise ValueError(f"hot_share must lie between {LEAST_HOT_SHARE} and 1")
    keyed, names = _keyed(files)
    # the narrow table is read several times below; the texts once more
    units = written(keyed.drop("code"), "contents")
    counts = _contents(units)
    results = _scanned(keyed, counts, **options).join(counts.drop("unit"), GROUP)
    return _handed_out(units, names, results, hot_share, salts)


GROUP = ["content", "language"]


def _keyed(files: DataFrame) -> tuple[DataFrame, list[str]]:
    """Units with a digest of their text and a number of their own, and the names of their other columns."""
    resolved = resolve_sources(files)
    names = [c for c in resolved.columns if c not in ("code", "language", "error")]
    return resolved.select(
        *names, "language", "error", "code", F.sha2("code", 256).alias("content"), F.xxhash64(*names).alias("unit")), names


def _contents(units: DataFrame) -> DataFrame:
    """(content, language, copies, unit): one unit for every content."""
    return units.where(F.col("content").isNotNull()).groupBy(*GROUP).agg(F.count("*").alias("copies"), F.min("unit").alias("unit"))


def _scanned(keyed: DataFrame, contents: DataFrame, broadcast: int = BROADCAST_UNITS, **options) -> DataFrame:
    """(content, language, error, findings) of the chosen units of contents."""
    chosen = written(contents.select(*GROUP, "unit"), "chosen")
    texts = keyed.where(F.col("content").isNotNull()).select(*GROUP, "unit", "code")
    if chosen.count() <= broadcast:
        # a number that two contents share lets one text too many pass, which is scanned to no effect
        texts = texts.join(F.broadcast(chosen.select("unit").distinct()), "unit", "left_semi")
    else:
        texts = texts.join(chosen, [*GROUP, "unit"])
    found = scan(texts.select("content", "code", F.col("language").alias("declared_language")), **options)
    one = F.get(F.collect_list(F.struct("error", "findings")), F.lit(0))
    return found.groupBy(*GROUP).agg(one.alias("r")).select(*GROUP, "r.*").join(chosen.select(*GROUP), GROUP, "left_semi")


def _handed_out(units: DataFrame, names: list[str], results: DataFrame, hot_share: float, salts: int) -> DataFrame:
    """The results of contents at all their units; those of hot contents over salted keys."""
    copies = units.where(F.col("content").isNotNull())
    total = copies.agg(F.count("*")).scalar()
    hot = F.broadcast(results.where(F.col("copies") > total * hot_share).select(*GROUP, F.lit(True).alias("hot")))
    salted = results.join(hot, GROUP, "left").select(
        *results.columns,
        F.explode(
            F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
        ).alias("salt"),
    )
    spread = copies.drop("error").join(hot, GROUP, "left").select(
        *names, *GROUP,
        F.when(F.col("hot"), F.pmod(F.xxhash64("unit", F.monotonically_increasing_id()), F.lit(salts)).cast("int"))
        .otherwise(F.lit(0)).alias("salt"),
    )
    shared = spread.join(salted, [*GROUP, "salt"]).select(*names, "language", "copies", "error", "findings")
    nothing = F.array().cast(results.schema["findings"].dataType)
    apart = units.where(F.col("content").isNull()).select(
        *names, "language", F.lit(1).cast("long").alias("copies"), "error", nothing.alias("findings"))
    return shared.union(apart)


class ScannedContents:
    """Results by content below a folder, one table for each run; a run counts once its mark is there.

    Results depend on the rules and prices given to ``scan``, so a folder belongs to one set of options.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def runs(self) -> list[int]:
        store, path = folder_store(self.spark, f"{self.folder}/marks")
        return sorted(int(s.getPath().getName()) for s in store.listStatus(path)) if store.exists(path) else []

    def read(self, like: DataFrame | None = None) -> DataFrame | None:
        runs = self.runs()
        return self.spark.read.parquet(*[f"{self.folder}/run-{n}" for n in runs]) if runs else like

    def add(self, results: DataFrame) -> None:
        runs = self.runs()
        number = runs[-1] + 1 if runs else 0
        results.write.mode("overwrite").parquet(f"{self.folder}/run-{number}")
        store, mark = folder_store(self.spark, f"{self.folder}/marks/{number}")
        store.create(mark, True).close()


def scan_incremental(files: DataFrame, folder: str, hot_share: float = HOT_SHARE, salts: int = HOT_SALTS, **options) -> DataFrame:
    """``scan_distinct`` that remembers: contents of earlier runs over the same folder are not scanned again.

    Known and new contents meet as digests, before any text is read again.
    """
    known = ScannedContents(files.sparkSession, folder)
    keyed, names = _keyed(files)
    units = written(keyed.drop("code"), "contents")
    contents = written(_contents(units), "distinct")
    before = known.read()
    fresh = contents if before is None else contents.join(before.select(*GROUP), GROUP, "left_anti")
    if fresh.head(1):
        known.add(_scanned(keyed, fresh, **options))
    every = known.read()
    if every is None:
        every = _scanned(keyed, contents, **options)
    return _handed_out(units, names, every.join(contents.drop("unit"), GROUP), hot_share, salts)
