"""Loop scope and hot context over a table of lines (one row per line).

For corpora that already come one line per row.  The work is split by file *and*
block of ``BLOCK`` lines, so a single huge file spreads over many tasks; only one
small summary row per block is then combined per file.  Line numbers are integers,
so a file has at most 2**31 / BLOCK of those.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import cost
from ..functions.loops import JAVA_WALK, WALKS, Walk, line_mark, walk_values
from ..functions.match import call_hits, line_hits, to_findings
from ..functions.text import any_of, searchable
from ..rules import BUILTIN_RULES, HOT, HOT_LOOKBACK, JAVA, JAVASCRIPT, PYTHON, Rule, rules_for
from ..session import written
from .once import evaluate_once

BLOCK = 4096


def _block(block: int) -> Column:
    return F.floor((F.col("line_no") - 1) / block).cast("int")


def _blocks(lines: DataFrame, language: str, key: str, block: int) -> DataFrame:
    """(key, block, items) with the marked lines of each block in order, as a written table.

    Rows are dealt by one number for file and block: a partitioning by file, which the
    input may have, would leave a huge file in one task.
    """
    others = [c for c in lines.columns if c not in (key, "line_no")]
    item = F.struct("line_no", *others, F.expr(line_mark("line", "low", language)).alias("m"))
    placed = lines.withColumns({"low": searchable(F.col("line")), "block": _block(block)}).select(
        key, "block", item.alias("item"))
    dealt = placed.withColumn("part", F.xxhash64(key, "block")).repartition("part")
    gathered = dealt.groupBy("part", key, "block").agg(F.array_sort(F.collect_list("item")).alias("items"))
    return written(gathered.drop("part"), "blocks")


def _with_flags(
    lines: DataFrame, language: str, key: str, block: int, summary: Callable[[str], str], between: Walk, state: str
) -> DataFrame:
    """Lines with their flags: fold each block alone, combine along the file, fold again from the state entered with.

    The table of blocks is read twice, for the summaries only its marks.
    """
    blocks = _blocks(lines, language, key, block)
    marks = F.expr("transform(items, i -> i.m)")
    summaries = blocks.select(key, "block", marks.alias("marks")).select(
        key, F.expr(f"named_struct('block', block, 'sum', {summary('marks')})").alias("b"))
    entering = (
        summaries.groupBy(key)
        .agg(F.array_sort(F.collect_list("b")).alias("bs"))
        .select(key, F.explode(walk_values("bs", between, value_type=f"struct<block:int,state:{between.state_type}>")).alias("e"))
        .select(key, "e.block", F.col("e.state").alias("entered"))
    )
    flagged = blocks.join(entering, [key, "block"]).withColumn("marks", marks).select(
        key, "items", walk_values("marks", WALKS[language], initial=state).alias("flags"))
    # blocks are never empty; outer only keeps a size test from being added below
    rows = evaluate_once(flagged, "flags").select(key, "flags", F.posexplode_outer("items").alias("pos", "item"))
    return rows.select(
        *(F.col(c) if c == key else F.col(f"item.{c}").alias(c) for c in lines.columns),
        F.col("item.m.start").cast("boolean").alias("loop_start"),
        F.get("flags", F.col("pos")).alias("in_loop"),
    )


def js_loop_scope(lines: DataFrame, key: str = "file_id", block: int = BLOCK) -> DataFrame:
    """Add ``loop_start`` and ``in_loop`` to JavaScript lines.

    The count of open loops is a running sum reflected at zero, so a block hands on its
    total and its lowest running sum, which is all its successors need.
    """
    def summary(marks: str) -> str:
        step = "b.total + m.start - m.closes"
        return (f"aggregate({marks}, named_struct('total', 0, 'low', 0), (b, m) -> "
                f"named_struct('total', {step}, 'low', least(b.low, {step})))")

    between = Walk("int", "0", "m.sum.total + greatest(s, -m.sum.low)", "named_struct('block', m.block, 'state', s)")
    return _with_flags(lines, JAVASCRIPT, key, block, summary, between, "entered")


def java_loop_scope(lines: DataFrame, key: str = "file_id", block: int = BLOCK) -> DataFrame:
    """Add ``loop_start`` and ``in_loop`` to Java lines.

    Each block is folded on its own to learn its change of brace depth, its lowest
    depth and the lowest loop it leaves open; combining those along the file gives
    every block the state it is entered with.
    """
    def summary(marks: str) -> str:
        return (f"aggregate({marks}, named_struct('w', {JAVA_WALK.initial}, 'low', 0), (b, m) -> "
                f"transform(array(b.w), s -> named_struct('w', {JAVA_WALK.after}, 'low', least(b.low, s.depth + m.low)))[0])")

    between = Walk(
        JAVA_WALK.state_type, JAVA_WALK.initial,
        "named_struct('depth', s.depth + m.sum.w.depth, 'base', least("
        "CASE WHEN s.base <= s.depth + m.sum.low THEN s.base END, s.depth + m.sum.w.base))",
        "named_struct('block', m.block, 'state', s)",
    )
    return _with_flags(lines, JAVA, key, block, summary, between, "entered")


LOOP_SCOPE = {JAVASCRIPT: js_loop_scope, JAVA: java_loop_scope}


def line_findings(
    lines: DataFrame, language: str, rules: Sequence[Rule] = BUILTIN_RULES, unit_costs: Mapping[str, float] = cost.UNIT_COSTS,
    iterations: int | None = None, key: str = "file_id", block: int = BLOCK,
) -> DataFrame:
    """Findings of JavaScript or Java lines: the key, then the fields of a finding, one row each.

    For files too long for one row: a file's lines are never together in a task.
    """
    own = rules_for(language, rules)
    inside = LOOP_SCOPE[language](lines.select(key, "line_no", "line"), key, block).where("in_loop")
    one = F.array(F.struct(F.col("line_no").alias("no"), F.col("line").alias("text"), searchable(F.col("line")).alias("low")))
    hits = inside.select(key, one.alias("one")).select(key, line_hits(own, "one").alias("hits"))
    return hits.select(key, F.explode(to_findings(F.col("hits"), own, unit_costs, iterations)).alias("f")).select(key, "f.*")


def call_findings(
    calls: DataFrame, lines: DataFrame, rules: Sequence[Rule] = BUILTIN_RULES,
    unit_costs: Mapping[str, float] = cost.UNIT_COSTS, iterations: int | None = None, key: str = "file_id",
) -> DataFrame:
    """Findings of a table of Python call sites; ``lines`` (key, line_no, line) give the shown text."""
    own = rules_for(PYTHON, rules)
    fields = [c for c in calls.columns if c != key]
    hits = calls.select(key, F.array(F.struct(*fields)).alias("calls"), F.array().cast("array<string>").alias("none")).select(
        key, call_hits(own, "calls", "none").alias("hits"))
    found = hits.select(key, F.explode(to_findings(F.col("hits"), own, unit_costs, iterations)).alias("f")).select(key, "f.*")
    shown = lines.select(key, F.col("line_no").alias("line_number"), "line")
    return found.join(shown, [key, "line_number"], "left").withColumn(
        "line_content", F.coalesce("line", "line_content")).select(found.columns)


def near_hot_path(lines: DataFrame, language: str, key: str = "file_id", block: int = BLOCK) -> DataFrame:
    """Add ``near_hot_path``: a hot word within the 20 (JavaScript) or 30 (Java)
    preceding lines.

    The last lines of a block are also sent to the next one as context, so a look-back
    never needs the whole file in one task.
    """
    back = HOT_LOOKBACK[language]
    home = _block(block)
    copies = F.when(
        (F.col("line_no") - 1) % block >= block - back, F.array(home, home + 1)
    ).otherwise(F.array(home))
    spread = lines.select(*lines.columns, home.alias("home"), F.explode(copies).alias("block"))
    frame = Window.partitionBy(key, "block").orderBy("line_no").rowsBetween(-back, -1)
    pattern = any_of(HOT[language])
    if language == JAVA:
        # these patterns may run over a line end
        hot = F.array_join(F.collect_list("line").over(frame), "\n").rlike(pattern)
    else:
        hot = F.coalesce(F.max(F.col("line").rlike(pattern)).over(frame), F.lit(False))
    return (
        spread.withColumn("near_hot_path", hot)
        .where(F.col("block") == F.col("home"))
        .select(*lines.columns, "near_hot_path")
    )
