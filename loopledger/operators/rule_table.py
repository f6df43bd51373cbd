"""Rules that come as a table with one row per pattern, however many.

Patterns stay a table.  A line pattern is filed under its rarest gram (see ``substrings``), one for
each top-level alternative, and lines inside loops meet only the patterns filed under a gram of
theirs; the regular expression runs on what met.  Call patterns meet distinct call names in the
same way.  Of the patterns of a rule that match at one place, the first in order counts.  Only
patterns without any literal piece are tried on every line of their language.

Columns: ``rule_id, language, rule_name, category, severity, sentence, suggestion, ord, label`` and
either ``regex`` (JavaScript, Java) or ``obj, method`` (Python); ``needs_loop`` (default true),
``label_text`` and ``label_category`` where a label changes the category, if the table has them.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

from ..functions.text import branches, regex, sql_literal
from ..rules import LANGUAGES, PAGINATION_WORDS, PYTHON
from ..session import written
from .substrings import GRAM, grams, meeting, overlapping, own_grams, rarest, sizes_of

SEVERITIES = ("low", "medium", "high")
RULE_FIELDS = ("rule_id", "language", "rule_name", "category", "severity", "sentence", "suggestion", "label_text", "label_category")
HIT_TYPE = ("struct<rule_id:string,label:string,line_number:int,line_content:string,hot:boolean,"
            f"rule:struct<{','.join(f'{f}:string' for f in RULE_FIELDS)}>>")
_COMPILED = StructType().add("java", StringType()).add("branches", ArrayType(ArrayType(StringType())))


def _compile(patterns: Column) -> Column:
    """The Java form of a pattern, and the literal pieces of each of its alternatives."""

    @F.arrow_udf(_COMPILED)
    def compile_(column: pa.Array) -> pa.Array:
        rows = [None if p is None else {"java": regex(p), "branches": branches(p)} for p in column.to_pylist()]
        return pa.array(rows, pa.struct([("java", pa.string()), ("branches", pa.list_(pa.list_(pa.string())))]))

    return compile_(patterns)


def _checked(table: DataFrame) -> DataFrame:
    """Rows of a uniform shape; a row that could never be applied fails the job instead."""
    def given(name: str, default: Column) -> Column:
        return F.col(name) if name in table.columns else default

    none = F.lit(None).cast("string")
    shaped = table.select(
        "rule_id", "language", "rule_name", "category", "severity", "sentence", "suggestion", F.col("ord").cast("long").alias("ord"),
        "label", given("regex", none).alias("regex"), F.lower(given("obj", none)).alias("obj"),
        F.lower(given("method", none)).alias("method"),
        F.coalesce(given("needs_loop", F.lit(True)), F.lit(True)).alias("needs_loop"),
        given("label_text", none).alias("label_text"), given("label_category", none).alias("label_category"),
    )
    wrong = (
        F.when(F.col("rule_id").isNull() | F.col("ord").isNull() | F.col("label").isNull(), "rule_id, ord or label is null")
        .when(~F.coalesce(F.col("language").isin(*LANGUAGES), F.lit(False)), F.concat(F.lit("unknown language "), F.coalesce("language", F.lit("null"))))
        .when(~F.coalesce(F.col("severity").isin(*SEVERITIES), F.lit(False)), "unknown severity")
        .when((F.col("language") == PYTHON) & (F.col("obj").isNull() | F.col("method").isNull()), "no obj and method")
        .when((F.col("language") != PYTHON) & F.col("regex").isNull(), "no regex")
    )
    said = F.concat(F.lit("rule "), F.coalesce("rule_id", F.lit("null")), F.lit(": "), wrong)
    return shaped.withColumn("rule_id", F.when(wrong.isNull(), F.col("rule_id")).otherwise(F.raise_error(said)))


def compiled(table: DataFrame) -> DataFrame:
    """Checked patterns as a written table, each with a number of its own; an ord that occurs twice in a rule fails the job."""
    rows = _checked(table)
    ready = rows.withColumn("c", _compile(F.col("regex"))).select(
        *[c for c in rows.columns if c != "regex"], F.col("c.java").alias("java"), F.col("c.branches").alias("branches"))
    rest = [c for c in ready.columns if c not in ("rule_id", "ord")]
    patterns = written(ready.select(F.monotonically_increasing_id().alias("pattern"), "rule_id", "ord", *rest), "patterns")
    # only a hash of each rule and ord moves, whole ones where a hash occurs twice
    hashed = F.xxhash64("rule_id", "ord").alias("hash")
    again = written(patterns.groupBy(hashed).agg(F.count(F.lit(1)).alias("times")).where("times > 1"), "pattern-hashes")
    if not again.isEmpty():
        twice = patterns.select("rule_id", "ord", hashed).join(again, "hash", "left_semi").groupBy("rule_id", "ord").agg(
            F.count(F.lit(1)).alias("times")).where("times > 1")
        twice.select(F.raise_error(F.lit("rule table: an ord occurs twice in a rule"))).first()
    return patterns


def _first_of_each(matches: DataFrame, *place: str) -> DataFrame:
    """The match with the least ord of every rule at a place."""
    rest = [c for c in matches.columns if c not in (*place, "rule_id", "ord")]
    return matches.groupBy(*place, "rule_id").agg(F.min_by(F.struct(*rest), "ord").alias("m")).select(*place, "rule_id", "m.*")


def line_matches(lines: DataFrame, patterns: DataFrame) -> DataFrame:
    """(unit, place, text, rule_id, label and the rule's fields) of (unit, language, place, text, low)."""
    own = patterns.where(F.col("java").isNotNull())
    wanted = own.select("pattern", F.posexplode("branches").alias("branch", "pieces"))
    long_ = F.filter("pieces", lambda p: F.length(p) >= GRAM)
    useful = F.when(F.size(long_) > 0, long_).otherwise(F.slice("pieces", 1, 1))
    wanted = wanted.select(F.struct("pattern", "branch").alias("item"), F.explode(useful).alias("piece")).select(
        "item", F.explode(own_grams(F.col("piece"))).alias("gram"))
    offered = lines.select("unit", "place", "language", F.explode(grams(F.col("low"), sizes_of(wanted) or (GRAM,))).alias("gram"))
    filed = written(rarest(wanted, offered.select("gram")).select("gram", "item.pattern").distinct(), "filed-patterns")
    met = meeting(offered, filed).select("unit", "place", "pattern").distinct()
    bare = own.where(F.size("branches") == 0)
    met = met.union(lines.join(bare.select("pattern", "language"), "language").select("unit", "place", "pattern"))
    # patterns that nothing met stay where they are
    used = own.join(filed.select("pattern").distinct(), "pattern", "left_semi").union(bare)
    found = met.join(used, "pattern").join(
        lines.select("unit", "place", "language", "text"), ["unit", "place", "language"]).where(F.rlike("text", "java"))
    return _first_of_each(found.select("unit", "place", "text", "ord", "label", *RULE_FIELDS), "unit", "place")


def call_matches(calls: DataFrame, patterns: DataFrame) -> DataFrame:
    """The same of (unit, place, text, line_no, obj, method, in_loop, in_hot_path, query_literal)."""
    own = patterns.where(F.col("language") == PYTHON)
    pairs = overlapping(calls, own)
    named = pairs.join(own.select("pattern", "ord", "label", "needs_loop", *RULE_FIELDS, F.col("obj").alias("p_obj"), F.col("method").alias("p_method")),
                       ["p_obj", "p_method"]).drop("p_obj", "p_method")
    bound = F.exists(F.expr(sql_literal(list(PAGINATION_WORDS))), lambda w: F.contains("query_literal", w))
    unbounded = (F.col("query_literal") != "") & ~bound
    found = calls.join(named, ["obj", "method"]).where(F.when(F.col("needs_loop"), F.col("in_loop")).otherwise(unbounded))
    return _first_of_each(found.select("unit", "place", "text", "line_no", "in_hot_path", "ord", "label", *RULE_FIELDS), "unit", "place")


def hits_by_unit(scoped: DataFrame, table: DataFrame) -> DataFrame:
    """(unit, hits): hits in order of place and rule, for (unit, language, inside, calls) with the lines and calls of units."""
    patterns = compiled(table)
    lines = written(scoped.select("unit", "language", F.explode("inside").alias("l")).select(
        "unit", "language", F.col("l.no").cast("int").alias("place"), F.col("l.text").alias("text"), F.col("l.low").alias("low")), "loop-lines")
    calls = scoped.select("unit", F.posexplode("calls").alias("place", "c")).select("unit", "place", "c.*")
    both = line_matches(lines, patterns).withColumn("line_no", F.col("place")).withColumn("in_hot_path", F.lit(False)).unionByName(
        call_matches(calls, patterns))
    hit = F.struct("rule_id", "label", F.col("line_no").alias("line_number"), F.col("text").alias("line_content"),
                   F.col("in_hot_path").alias("hot"), F.struct(*RULE_FIELDS).alias("rule")).cast(HIT_TYPE)
    return both.groupBy("unit").agg(F.transform(
        F.sort_array(F.collect_list(F.struct("place", "rule_id", hit.alias("hit")))), lambda x: x["hit"]).alias("hits"))
