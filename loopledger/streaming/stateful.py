"""Streams with state: loop scope of lines as they arrive, and totals that follow corrections.

State lives in Spark's store, keyed by file or unit, so a stream of any length is split by key and
survives lost executors.  Both need the RocksDB store (``state_store`` sets it for new queries).
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..functions import cost
from ..functions.loops import line_mark
from ..functions.match import line_hits, to_findings
from ..functions.text import searchable
from ..operators.scan import scan
from ..plans.report import MONEY
from ..rules import BUILTIN_RULES, JAVA, JAVASCRIPT, Rule, rules_for
from ..session import folder_store

cloudpickle.register_pickle_by_value(sys.modules[__name__])

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def state_store(spark: SparkSession) -> None:
    """Let streams that start from now on keep state by key, as these operators need it."""
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


# --- loop scope of arriving lines -----------------------------------------------------


def js_step(start: int, closes: int, _: int, loops: int, __: int | None) -> tuple[bool, int, None]:
    """A line opens at most one loop and every closing brace ends one."""
    return loops + start > 0, max(0, loops + start - closes), None


def java_step(start: int, delta: int, low: int, depth: int, base: int | None) -> tuple[bool, int, int | None]:
    """A loop stays open until the depth falls below the one it began at; the outermost is remembered."""
    if base is None and start:
        base = depth
    kept = base if base is not None and depth + low >= base else None
    return kept is not None, depth + delta, kept


STEPS = {JAVASCRIPT: js_step, JAVA: java_step}


_LINE = "struct<line_no:int,line:string,start:int,a:int,b:int>"
#: Line numbers of one entry of early lines.
BLOCK = 1024


class LoopScope(StatefulProcessor):
    """Lines inside loops, in the order of their numbers; lines that come early wait for those before.

    Those of the block of the next line wait beside the walk, others in an entry for each block, so a
    batch reads and writes the state once for every block it has lines of, not once for every line.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.walk = handle.getValueState("walk", f"next int, at int, base int, blocks int, early array<{_LINE}>")
        self.early = handle.getMapState("early", "block int", f"lines array<{_LINE}>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        file, language = key
        number, at, base, blocks, waiting = self.walk.get() or (1, 0, None, 0, [])
        step, inside, here, later = STEPS[language], [], {}, {}
        for part in rows:
            for line_no, *line in zip(*(part[c].tolist() for c in ("line_no", "line", "start", "a", "b"))):
                if line_no >= number:  # a line that comes again is known
                    block = int(line_no) // BLOCK
                    (here if block == number // BLOCK else later.setdefault(block, {}))[int(line_no)] = (line[0], *map(int, line[1:]))
        here |= {line[0]: tuple(line[1:]) for line in waiting}
        while (line := here.pop(number, None)) is not None:
            text, start, a, b = line
            in_loop, at, base = step(start, a, b, at, base)
            if in_loop:
                inside.append((file, language, number, text))
            number += 1
            block = number // BLOCK
            if number % BLOCK == 0:
                new, here = later.pop(block, {}), {}
                if blocks and self.early.containsKey((block,)):
                    here = self._lines(block)
                    self.early.removeKey((block,))
                    blocks -= 1
                here = new | here
        for block, lines in later.items():
            if blocks and self.early.containsKey((block,)):
                lines |= self._lines(block)
            else:
                blocks += 1
            self.early.updateValue((block,), (_listed(lines),))
        self.walk.update((number, at, base, blocks, _listed(here)))
        if inside:
            yield pd.DataFrame(inside, columns=["file_id", "language", "line_no", "line"])

    def _lines(self, block: int) -> dict[int, tuple]:
        return {line[0]: tuple(line[1:]) for line in self.early.getValue((block,))[0]}

    def close(self) -> None:
        pass


def _listed(lines: dict[int, tuple]) -> list[tuple]:
    return [(n, *line) for n, line in lines.items()]


def stream_line_findings(lines: DataFrame, rules: tuple[Rule, ...] = BUILTIN_RULES, unit_costs=cost.UNIT_COSTS,
                         iterations: int | None = None) -> DataFrame:
    """Findings of a stream of JavaScript and Java lines (file_id long, language, line_no int, line).

    The lines of a file may come in any order and over many batches; a finding appears once all lines up to its own are there.
    """
    own = lines.where(F.col("language").isin(JAVASCRIPT, JAVA)).withColumn("low", searchable(F.col("line")))
    js, java = (F.expr(line_mark("line", "low", language)) for language in (JAVASCRIPT, JAVA))
    is_js = F.col("language") == JAVASCRIPT
    marked = own.select(
        "file_id", "language", F.col("line_no").cast("int").alias("line_no"), "line",
        F.when(is_js, js["start"]).otherwise(java["start"].cast("int")).alias("start"),
        F.when(is_js, js["closes"]).otherwise(java["delta"]).cast("int").alias("a"),
        F.when(is_js, 0).otherwise(java["low"]).cast("int").alias("b"))
    kind = lines.schema["file_id"].dataType.simpleString()
    inside = marked.groupBy("file_id", "language").transformWithStateInPandas(
        LoopScope(), f"file_id {kind}, language string, line_no int, line string", "Append", "None")
    one = F.array(F.struct(F.col("line_no").alias("no"), F.col("line").alias("text"), searchable(F.col("line")).alias("low")))
    hits = inside.select("file_id", "language", one.alias("one")).select(
        "file_id", "language", F.when(is_js, line_hits(rules_for(JAVASCRIPT, rules), "one")).otherwise(
            line_hits(rules_for(JAVA, rules), "one")).alias("hits"))
    return hits.select("file_id", "language", F.explode(to_findings(F.col("hits"), rules, unit_costs, iterations)).alias("f")).select(
        "file_id", "language", "f.*")


# --- totals that follow corrections ---------------------------------------------------

SEVERITIES = ("low", "medium", "high")
AMOUNTS = ("per_execution", "monthly", *SEVERITIES, "findings")
_AMOUNT = f"struct<category:string,{','.join(f'{a}:bigint' for a in AMOUNTS)}>"


def unit_amounts(results: DataFrame) -> DataFrame:
    """results with `amounts`: for every category of a unit's findings its cents, counts by severity and number of prices."""
    def of(category: Column) -> Column:
        own = F.filter("findings", lambda f: f["category"].eqNullSafe(category))

        def total(value) -> Column:
            return F.aggregate(own, F.lit(0).cast("long"), lambda n, f: n + F.coalesce(value(f), F.lit(0)).cast("long"))

        cents = {c: total(lambda f, c=c: f["estimated_cost"][f"{c}_cost"].cast(MONEY) * 100) for c in ("per_execution", "monthly")}
        levels = {s: total(lambda f, s=s: (f["estimated_cost"]["severity"] == s).cast("long")) for s in SEVERITIES}
        priced = total(lambda f: f["estimated_cost"].isNotNull().cast("long"))
        return F.struct(category.alias("category"), *[v.alias(k) for k, v in (cents | levels).items()], priced.alias("findings"))

    categories = F.array_distinct(F.transform("findings", lambda f: f["category"]))
    return results.withColumn("amounts", F.transform(categories, of).cast(f"array<{_AMOUNT}>"))


#: Keys that units are dealt to (2^10), units of one entry of a key's state, and units of a batch that a task holds.
BLOCKS, ENTRY, HELD = 1024, 256, 50_000


class Changes(StatefulProcessor):
    """What units add to the totals and, if they were there before, take back.

    Units are dealt to blocks, and those of a block to entries, whose number doubles as units come: a batch
    reads and writes the state once for every entry it has units of, not once for every unit.
    """

    def __init__(self, kind: str):
        self.kind = kind

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.size = handle.getValueState("size", "units long, entries int")
        self.known = handle.getMapState(
            "known", "entry int", f"units array<struct<unit:{self.kind},place:bigint,version:bigint,amounts:array<{_AMOUNT}>>>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        newest: dict = {}
        for row in rows:
            before = newest.get(row.unit)
            if before is None or _later(row.version, before[1]):
                newest[row.unit] = (row.place, row.version, row.amounts)
            if len(newest) >= HELD:
                yield from self._changed(newest)
                newest = {}
        yield from self._changed(newest)

    def _changed(self, newest: dict) -> Iterator[Row]:
        units, entries = self.size.get() or (0, 1)
        there, by_entry = units, {}
        for unit, row in newest.items():
            by_entry.setdefault(row[0] & (entries - 1), {})[unit] = row
        for entry, own in by_entry.items():
            known = self._entry(entry) if there else {}
            for unit, (place, version, amounts) in own.items():
                before = known.get(unit)
                if before is None or _later(version, before[1]):
                    now = [(a["category"], *(int(a[f]) for f in AMOUNTS)) for a in amounts]
                    units += before is None
                    known[unit] = (place, int(version), now)
                    yield from map(_change, now)
                    yield from (_change((a[0], *(-x for x in a[1:]))) for a in (before[2] if before else ()))
            self.known.updateValue((entry,), (_listed(known),))
        wider = entries
        while units > ENTRY * wider:
            wider *= 2
        if wider > entries:
            self._spread(entries, wider)
        self.size.update((units, wider))

    def _entry(self, entry: int) -> dict:
        if not self.known.containsKey((entry,)):
            return {}
        return {unit: (place, version, [tuple(a) for a in amounts]) for unit, place, version, amounts in self.known.getValue((entry,))[0]}

    def _spread(self, entries: int, wider: int) -> None:
        """Deal the units of every entry over its successors."""
        for entry in range(entries):
            dealt: dict[int, dict] = {}
            for unit, row in self._entry(entry).items():
                dealt.setdefault(row[0] & (wider - 1), {})[unit] = row
            for to in {entry, *dealt}:
                self.known.updateValue((to,), (_listed(dealt.get(to, {})),))

    def close(self) -> None:
        pass


def _change(amounts: tuple) -> Row:
    return Row(**dict(zip(("category", *AMOUNTS), amounts)))


def _later(version: int | None, other: int | None) -> bool:
    return version is not None and other is not None and version > other


def stream_changes(sources: DataFrame, unit: str = "file_id", version: str = "version", **options) -> DataFrame:
    """(category, amounts..): changes of the totals by a stream of units; a later version of a unit replaces the earlier."""
    scanned = unit_amounts(scan(sources, **options)).select(F.col(unit).alias("unit"), F.col(version).cast("long").alias("version"), "amounts")
    hashed = F.xxhash64("unit")
    placed = scanned.withColumns({"block": F.pmod(hashed, F.lit(BLOCKS)).cast("int"), "place": F.shiftright(hashed, 10)})
    return placed.groupBy("block").transformWithState(
        Changes(scanned.schema["unit"].dataType.simpleString()), "category string, " + ", ".join(f"{a} long" for a in AMOUNTS), "Append", "None")


class TotalsTable:
    """Totals by category below a folder: every batch is a table of its own, seen once its mark is there.

    A batch that is run again starts from the same earlier batch.  Readers take the last mark; the
    batch before it is kept for those that still read it, older ones are removed.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def marks(self) -> list[int]:
        store, path = folder_store(self.spark, f"{self.folder}/marks")
        return sorted(int(s.getPath().getName()) for s in store.listStatus(path)) if store.exists(path) else []

    def read(self, before: int | None = None) -> DataFrame:
        done = [n for n in self.marks() if before is None or n < before]
        if not done:
            return self.spark.createDataFrame([], "category string, " + ", ".join(f"{a} long" for a in AMOUNTS))
        return self.spark.read.parquet(f"{self.folder}/batch-{done[-1]}")

    def add(self, changes: DataFrame, number: int) -> None:
        totals = self.read(number).unionByName(changes).groupBy("category").agg(*[F.sum(a).alias(a) for a in AMOUNTS])
        totals.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/batch-{number}")
        store, mark = folder_store(self.spark, f"{self.folder}/marks/{number}")
        store.create(mark, True).close()
        for old in [n for n in self.marks() if n < number][:-1]:
            for name in (f"marks/{old}", f"batch-{old}"):
                store, path = folder_store(self.spark, f"{self.folder}/{name}")
                store.delete(path, True)

    def summary(self) -> DataFrame:
        """Totals as the cost summary by category shows them; a category without a finding left is gone."""
        def money(name: str) -> Column:
            return (F.col(name).cast("decimal(28,2)") / 100).cast("decimal(28,2)").cast("double")

        return self.read().where("findings <> 0").select(
            "category", money("per_execution").alias("total_per_execution"), money("monthly").alias("total_monthly"),
            *SEVERITIES, F.col("findings").alias("findings_count"))


def write_changes(changes: DataFrame, folder: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Keep a TotalsTable of a stream of changes."""
    def add(batch: DataFrame, number: int) -> None:
        TotalsTable(batch.sparkSession, folder).add(batch, number)

    return changes.writeStream.foreachBatch(add).outputMode("append").option("checkpointLocation", checkpoint).trigger(
        **(trigger or {"availableNow": True})).start()
