"""The scan: source units in, one result row per unit out, without a shuffle.

Everything a finding needs lives in its file's row, so loop scope, rule matching and
pricing are a narrow projection.  A corpus of any size is read once and cut into
tasks by the scan alone; nothing is regrouped, so no key can become hot.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import cost
from ..functions.language import resolve_language
from ..functions.loops import has_start, in_loop_flags, mark_lines, numbered_lines
from ..functions.match import call_hits, line_hits, to_findings
from ..functions.text import may_find, split_lines
from ..rules import BUILTIN_RULES, LANGUAGES, LOOPS, PYTHON, UNKNOWN, Rule, rules_for
from ..session import small_batches, written
from .callsites import EXTRACT_TYPE, extract_calls
from .once import evaluate_once
from .rule_table import HIT_TYPE as TABLE_HIT_TYPE
from .rule_table import hits_by_unit

UNDETECTED = "Could not detect programming language"
SNIPPET_PATH = "<input>"

HIT_TYPE = "struct<rule_id:string,label:string,line_number:int,line_content:string,hot:boolean>"


def _no_hits() -> Column:
    return F.array().cast(f"array<{HIT_TYPE}>")


def resolve_sources(sources: DataFrame) -> DataFrame:
    """Source units with ``path``, ``language`` and ``error``, ready to scan.

    Needs ``code``; uses ``path``, ``declared_language`` and ``error`` (of the reader)
    when present and keeps all other columns.
    """
    columns = sources.columns
    path = F.col("path") if "path" in columns else F.lit(SNIPPET_PATH)
    declared = F.col("declared_language") if "declared_language" in columns else F.lit(None).cast("string")
    error = F.col("error") if "error" in columns else F.lit(None).cast("string")
    carried = [c for c in columns if c not in ("code", "path", "declared_language", "error")]
    resolved = sources.select(
        *carried,
        path.alias("path"),
        F.when(error.isNull(), F.col("code")).alias("code"),
        F.when(error.isNull(), resolve_language(declared, path, F.col("code")))
        .otherwise(F.lit(UNKNOWN)).alias("language"),
        error.alias("error"),
    )
    return resolved.withColumn(
        "error", F.coalesce("error", F.when(F.col("language") == UNKNOWN, F.lit(UNDETECTED)))
    )


def scan(
    sources: DataFrame,
    rules: Sequence[Rule] = BUILTIN_RULES,
    extra_rules: Sequence[Rule] = (),
    unit_costs: Mapping[str, float] = cost.UNIT_COSTS,
    iterations: int | None = None,
    rule_table: DataFrame | None = None,
) -> DataFrame:
    """Scan a DataFrame of source units (batch or streaming).

    Input as for ``resolve_sources``.  Returns its columns without the code, plus
    ``findings`` in emission order.  Rules of ``rule_table`` (see ``rule_table.py``)
    report after the others; lines inside loops and calls are joined with it, so it needs
    a batch.
    """
    if rule_table is not None and sources.isStreaming:
        raise ValueError("rules from a table are joined: use them in foreachBatch")
    small_batches(sources.sparkSession)
    resolved = resolve_sources(sources)
    base = [c for c in resolved.columns if c != "code"]
    all_rules = [*rules, *extra_rules]

    # languages without a rule need no work at all, Python without rules no parser
    tabled = rule_table
    own = {lang: rules_for(lang, all_rules) for lang in LANGUAGES if tabled is not None or rules_for(lang, all_rules)}
    parsed_python = extract_calls(F.when(F.col("language") == PYTHON, F.col("code"))) if PYTHON in own else F.lit(None)
    # a file without a piece of a loop and of a call that its rules look for is not even split
    worth = F.col("language") == PYTHON if PYTHON in own else F.lit(False)
    for lang in (lang for lang in own if lang != PYTHON):
        looked_for = [LOOPS[lang]] + ([[p.regex for r in own[lang] for p in r.patterns]] if tabled is None else [])
        worth = worth | ((F.col("language") == lang) & F.expr(may_find("code", *looked_for)))
    parsed = evaluate_once(resolved.select(
        *base,
        F.when(worth, split_lines(F.col("code"))).alias("lines"),
        parsed_python.cast(EXTRACT_TYPE).alias("py"),
    ), "py")
    language = F.col("language")
    brace = [lang for lang in own if lang != PYTHON]
    keep = [*base, "py", "lines"]

    # lines -> marks -> lines inside loops; a file without any loop start ends early
    numbered = parsed.select(*keep, F.when(language.isin(*brace), numbered_lines(F.col("lines"))).alias("numbered"))
    marked = numbered.select(
        *keep, "numbered",
        *(F.when(language == lang, mark_lines("numbered", lang)).alias(f"{lang}_marks") for lang in brace),
    )
    inside = F.lit(None)
    for lang in brace:
        flags = in_loop_flags(f"{lang}_marks", lang)
        flagged = F.zip_with("numbered", flags, lambda l, f: F.when(f, l))
        inside = F.when(
            (language == lang) & has_start(f"{lang}_marks"), F.filter(flagged, lambda l: l.isNotNull())
        ).otherwise(inside)
    scoped = marked.select(*keep, inside.alias("inside"))

    hits = F.lit(None)
    for lang in (lang for lang in brace if own[lang]):
        hits = F.when(language == lang, line_hits(own[lang], "inside")).otherwise(hits)
    if own.get(PYTHON):
        hits = F.when(language == PYTHON, call_hits(own[PYTHON], "py.calls", "lines")).otherwise(hits)
    hits = F.coalesce(hits, _no_hits())
    found = scoped.select(
        *(c for c in base if c != "error"),
        F.coalesce("error", F.col("py.error")).alias("error"),
        *([to_findings(hits, all_rules, unit_costs, iterations).alias("findings")] if all_rules or tabled is None else []),
        *([_calls().alias("calls"), "inside"] if tabled is not None else []),
    )
    if tabled is None:
        return evaluate_once(found, "findings")
    return _with_table(found, tabled, unit_costs, iterations)


def _calls() -> Column:
    """Python calls with the text of their lines."""
    return F.transform("py.calls", lambda c: c.withField(
        "text", F.coalesce(F.get(F.col("lines"), c["line_no"] - 1), F.lit(""))))


def _with_table(found: DataFrame, table: DataFrame, unit_costs: Mapping[str, float], iterations: int | None) -> DataFrame:
    """Results with the findings of a rule table after their own."""
    names = [c for c in found.columns if c not in ("findings", "calls", "inside")]
    # numbers follow the order of reading, so they are written with the rows before anything joins on them
    numbered = written(found.select(
        F.monotonically_increasing_id().alias("unit"), F.struct(*names).alias("row"), "language", "calls", "inside",
        *[c for c in found.columns if c == "findings"]), "units")
    more = hits_by_unit(numbered, table)
    priced = to_findings(F.coalesce("hits", F.array().cast(f"array<{TABLE_HIT_TYPE}>")), None, unit_costs, iterations)
    if "findings" in numbered.columns:
        priced = F.concat("findings", priced)
    joined = numbered.drop("calls", "inside", "language").join(more, "unit", "left")
    return evaluate_once(joined.select("row.*", priced.alias("findings")), "findings")


def findings_of(results: DataFrame) -> DataFrame:
    """One row per finding, ``seq`` giving the emission order inside its unit.

    The outer explode keeps the optimizer from adding a size test below it, which
    would evaluate the scan expressions twice.
    """
    keys = [c for c in results.columns if c not in ("findings", "error")]
    exploded = results.select(*keys, F.posexplode_outer("findings").alias("pos", "f"))
    return exploded.where(F.col("pos").isNotNull()).select(
        *keys, (F.col("pos") + 1).alias("seq"), "f.*"
    )
