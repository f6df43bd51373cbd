"""Named queries: every operator, run over the given tables.

Each takes the session and the folder of parquet tables.  Source files come from
``plans.corpus``, so the work of every query grows with the tables.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cost
from ..functions.language import (
    best_scored, content_scores, extension, is_excluded, is_supported, language_by_extension, resolve_language,
)
from ..functions.match import call_label
from ..functions.text import sql_literal
from ..operators import scope
from ..operators.callsites import call_site_table, register_udtf
from ..operators.dedup import scan_distinct, scan_incremental
from ..operators.lines import explode_lines, lines_with_scope
from ..operators.pricing import calls_per_run, price_with, price_with_counts
from ..operators.scan import findings_of, resolve_sources, scan
from ..operators.substrings import overlapping
from ..rules import BUILTIN_RULES, JAVA, JAVASCRIPT, PYTHON, CallPattern, LinePattern, Rule, rules_for
from ..session import checkpoint_dir, small_batches
from ..sources import tree, tree_source
from ..sources.long_files import tree_findings
from ..sources.sinks import to_json_rows, write_findings, write_json
from ..sources.snippets import embedded_scripts, parse_requests, snippets
from ..sources.tables import spread, table
from ..streaming.stateful import TotalsTable, state_store, stream_changes, stream_line_findings, write_changes
from ..streaming.live import read_totals, stream_findings, stream_totals, write_stream, write_totals
from . import report
from .corpus import source_files

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

FINDING_COLUMNS = (
    "line_number", "line_content", "rule_id", "rule_name", "description", "severity", "category", "suggestion",
)
COST_COLUMNS = ("unit_cost", "iterations", "per_execution_cost", "monthly_cost")


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return spread(table(spark, sf, "documents").select("doc_id", "text", "source"), "doc_id")


def files(spark: SparkSession, sf: str) -> DataFrame:
    return source_files(documents(spark, sf))


def with_language(df: DataFrame) -> DataFrame:
    return df.withColumn(
        "language", resolve_language(F.col("declared_language"), F.col("path"), F.col("code"))
    )


def results(spark: SparkSession, sf: str, **options) -> DataFrame:
    return scan(files(spark, sf), **options)


def findings(spark: SparkSession, sf: str, **options) -> DataFrame:
    return findings_of(results(spark, sf, **options))


def flat(df: DataFrame, *keys: str) -> DataFrame:
    """Findings with the cost struct spread into columns."""
    return df.select(
        *keys, "seq", *FINDING_COLUMNS,
        *(F.col(f"estimated_cost.{c}").alias(c) for c in COST_COLUMNS),
        F.col("estimated_cost.severity").alias("cost_severity"),
    )


def run_folder(spark: SparkSession, name: str) -> str:
    """A new folder for one run, in the shared folder of the cluster."""
    base = checkpoint_dir(spark)
    if "://" in base:
        return f"{base.rstrip('/')}/{name}-{os.urandom(6).hex()}"
    os.makedirs(base, exist_ok=True)
    return tempfile.mkdtemp(prefix=f"{name}-", dir=base)


# --- language -------------------------------------------------------------------------


@query
def ext_language_counts(spark: SparkSession, sf: str) -> DataFrame:
    path = F.col("path")
    kept = files(spark, sf).where(is_supported(path) & ~is_excluded(path))
    return kept.groupBy(extension(path).alias("ext"), language_by_extension(path).alias("language")).agg(
        F.count("*").alias("n_files")
    )


@query
def content_language(spark: SparkSession, sf: str) -> DataFrame:
    docs = documents(spark, sf).select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), F.col("text").alias("body"))
    pages = spread(table(spark, sf, "pages"), "page_id").select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), F.col("html").alias("body"))
    body = F.col("body")
    scored = docs.unionByName(pages).select("kind", "id", content_scores(body).alias("s"))
    return scored.select("kind", "id", "s.*", best_scored(F.col("s")).alias("language"))


@query
def resolved_language(spark: SparkSession, sf: str) -> DataFrame:
    return resolve_sources(files(spark, sf)).select("file_id", "path", "language", "error")


@query
def snippet_intake(spark: SparkSession, sf: str) -> DataFrame:
    """Conversation turns as snippets, and beside every turn of a user what is blank of it."""
    turns = table(spark, sf, "conversations").select(
        "conv_id", "turn", "role", F.lit(False).alias("blanked"), F.col("text").alias("code"), F.lit("auto").alias("language"))
    blank = turns.where("role = 'user'").withColumns({"blanked": F.lit(True), "code": F.regexp_replace("code", r"\S", "")})
    return resolve_sources(snippets(turns.union(blank))).select("conv_id", "turn", "blanked", "language", "error")


# --- lines and loop scope -------------------------------------------------------------


@query
def document_lines(spark: SparkSession, sf: str) -> DataFrame:
    return explode_lines(documents(spark, sf).select("doc_id", "text"), "text")


def _lines_of(spark: SparkSession, sf: str, language: str) -> DataFrame:
    own = with_language(files(spark, sf)).where(F.col("language") == language)
    return explode_lines(own.select("file_id", "code"))


@query
def js_loop_scope(spark: SparkSession, sf: str) -> DataFrame:
    lines = scope.js_loop_scope(_lines_of(spark, sf, JAVASCRIPT))
    return lines.select("file_id", "line_no", "loop_start", "in_loop")


@query
def java_loop_scope(spark: SparkSession, sf: str) -> DataFrame:
    lines = scope.java_loop_scope(_lines_of(spark, sf, JAVA))
    return lines.select("file_id", "line_no", "loop_start", "in_loop")


@query
def js_loop_scope_split(spark: SparkSession, sf: str) -> DataFrame:
    """The same with blocks of 16 lines, so that every file spans several."""
    lines = scope.js_loop_scope(_lines_of(spark, sf, JAVASCRIPT), block=16)
    return lines.select("file_id", "line_no", "loop_start", "in_loop")


@query
def java_loop_scope_split(spark: SparkSession, sf: str) -> DataFrame:
    lines = scope.java_loop_scope(_lines_of(spark, sf, JAVA), block=16)
    return lines.select("file_id", "line_no", "loop_start", "in_loop")


@query
def js_loop_scope_folded(spark: SparkSession, sf: str) -> DataFrame:
    own = with_language(files(spark, sf)).where(F.col("language") == JAVASCRIPT)
    return lines_with_scope(own.select("file_id", "code"), JAVASCRIPT).select("file_id", "line_no", "in_loop")


@query
def java_loop_scope_folded(spark: SparkSession, sf: str) -> DataFrame:
    own = with_language(files(spark, sf)).where(F.col("language") == JAVA)
    return lines_with_scope(own.select("file_id", "code"), JAVA).select("file_id", "line_no", "in_loop")


@query
def js_near_hot_path(spark: SparkSession, sf: str) -> DataFrame:
    return scope.near_hot_path(_lines_of(spark, sf, JAVASCRIPT), JAVASCRIPT).select("file_id", "line_no", "near_hot_path")


@query
def java_near_hot_path(spark: SparkSession, sf: str) -> DataFrame:
    return scope.near_hot_path(_lines_of(spark, sf, JAVA), JAVA).select("file_id", "line_no", "near_hot_path")


# --- findings -------------------------------------------------------------------------


def _language_findings(language: str) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        own = with_language(files(spark, sf)).where(F.col("language") == language)
        return flat(findings_of(scan(own.drop("language"), rules=rules_for(language))), "file_id")

    return run


QUERIES["js_findings"] = _language_findings(JAVASCRIPT)
QUERIES["java_findings"] = _language_findings(JAVA)
QUERIES["py_findings"] = _language_findings(PYTHON)


def _line_findings(language: str) -> Query:
    """The same from a table of lines, in blocks of 64 lines."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        found = scope.line_findings(_lines_of(spark, sf, language), language, block=64)
        return flat(found.withColumn("seq", F.lit(0)), "file_id").drop("seq")

    return run


QUERIES["js_line_findings"] = _line_findings(JAVASCRIPT)
QUERIES["java_line_findings"] = _line_findings(JAVA)


@query
def py_call_findings(spark: SparkSession, sf: str) -> DataFrame:
    """The findings of Python files from tables of their call sites and lines."""
    own = with_language(files(spark, sf)).where(F.col("language") == PYTHON)
    found = scope.call_findings(call_site_table(own), explode_lines(own.select("file_id", "code")))
    return flat(found.withColumn("seq", F.lit(0)), "file_id").drop("seq")


@query
def unbounded_queries(spark: SparkSession, sf: str) -> DataFrame:
    rule = [r for r in BUILTIN_RULES if r.rule_id == "PY004"]
    return findings(spark, sf, rules=rule).select("file_id", "line_number", "description", "severity")


@query
def py_call_sites(spark: SparkSession, sf: str) -> DataFrame:
    own = with_language(files(spark, sf)).where(F.col("language") == PYTHON)
    return call_site_table(own)


@query
def py_call_sites_lateral(spark: SparkSession, sf: str) -> DataFrame:
    """The same through the SQL table function."""
    register_udtf(spark)
    own = with_language(files(spark, sf)).where(F.col("language") == PYTHON)
    own.select("file_id", "code").createOrReplaceTempView("python_sources")
    return spark.sql("SELECT file_id, c.* FROM python_sources, LATERAL python_call_sites(code) c")


@query
def call_name_match(spark: SparkSession, sf: str) -> DataFrame:
    """Label per rule for each call name in use, with its number of calls."""
    names = py_call_sites(spark, sf).groupBy("obj", "method").agg(F.count("*").alias("n_calls"))
    labels = F.array(*(
        F.struct(F.lit(r.rule_id).alias("rule_id"), F.expr(call_label(r, "obj", "method")).alias("label"))
        for r in rules_for(PYTHON)
    ))
    return names.select("obj", "method", "n_calls", F.inline_outer(labels)).where(F.col("label").isNotNull())


@query
def all_findings(spark: SparkSession, sf: str) -> DataFrame:
    return flat(findings(spark, sf), "path", "language")


@query
def finding_costs(spark: SparkSession, sf: str) -> DataFrame:
    return findings(spark, sf).groupBy("rule_id", "severity", "estimated_cost").agg(
        F.count("*").alias("n")
    ).select("rule_id", "severity", "n", "estimated_cost.category", *(f"estimated_cost.{c}" for c in COST_COLUMNS),
             F.col("estimated_cost.severity").alias("cost_severity"))


# --- totals ---------------------------------------------------------------------------


@query
def cost_by_category(spark: SparkSession, sf: str) -> DataFrame:
    return report.cost_summary(findings(spark, sf), by=["category"])


@query
def cost_summary(spark: SparkSession, sf: str) -> DataFrame:
    return report.cost_summary(findings(spark, sf))


@query
def severity_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return report.severity_histogram(findings(spark, sf))


@query
def scan_counts(spark: SparkSession, sf: str) -> DataFrame:
    return report.scan_counts(results(spark, sf))


@query
def gate(spark: SparkSession, sf: str) -> DataFrame:
    return report.gate(results(spark, sf))


@query
def clean_files(spark: SparkSession, sf: str) -> DataFrame:
    return report.clean_files(results(spark, sf))


@query
def findings_by_file(spark: SparkSession, sf: str) -> DataFrame:
    return report.findings_by_file(results(spark, sf)).drop("file_id")


@query
def nested_results(spark: SparkSession, sf: str) -> DataFrame:
    """Published results, with the nested findings folded into one text for comparison."""
    rows = report.result_rows(results(spark, sf))
    parts = F.transform(
        "findings", lambda f: F.concat_ws(":", f["line_number"].cast("string"), f["rule_id"], f["line_content"])
    )
    return rows.select(F.col("file_path").alias("path"), "language", "findings_count", "error",
                       F.array_join(parts, "|").alias("findings"))


@query
def json_results(spark: SparkSession, sf: str) -> DataFrame:
    """The JSON sink: written, read back, and compared field by field."""
    folder = run_folder(spark, "json")
    write_json(results(spark, sf), folder)
    back = spark.read.schema("file_path string, language string, error string, findings_count int, "
                             "findings array<struct<file_path:string,line_number:int,rule_id:string>>").json(f"{folder}/results")
    counts = spark.read.schema("total_files long, files_with_issues long, total_findings long").json(f"{folder}/summary")
    per_file = back.select(F.col("file_path").alias("path"), "language", "findings_count", F.size("findings").alias("nested_count"), "error")
    total = counts.select(
        F.lit("*").alias("path"), F.lit(None).cast("string").alias("language"),
        F.col("total_findings").cast("int").alias("findings_count"), F.col("files_with_issues").cast("int").alias("nested_count"),
        F.lit(None).cast("string").alias("error"),
    )
    return per_file.unionByName(total)


@query
def json_rows(spark: SparkSession, sf: str) -> DataFrame:
    text = F.col("json")
    return to_json_rows(results(spark, sf)).select(
        F.get_json_object(text, "$.file_path").alias("path"),
        F.get_json_object(text, "$.language").alias("language"),
        F.get_json_object(text, "$.findings_count").cast("int").alias("findings_count"),
        F.get_json_object(text, "$.findings[0].rule_id").alias("first_rule"),
        F.get_json_object(text, "$.findings[0].estimated_cost.category").alias("first_category"),
    )


@query
def partitioned_findings(spark: SparkSession, sf: str) -> DataFrame:
    """The parquet sink, read back for one language: only its partition is opened."""
    folder = run_folder(spark, "findings")
    write_findings(findings(spark, sf), folder)
    back = spark.read.parquet(folder).where(F.col("language") == JAVASCRIPT)
    return back.groupBy("rule_id").agg(F.count("*").alias("n"))


# --- text -----------------------------------------------------------------------------


def _priced_events(spark: SparkSession, sf: str) -> DataFrame:
    """Each event as a call of a category, its value as the number of iterations."""
    kinds = {"view": "serialization", "click": "database_read", "purchase": "database_write", "signup": "api_call"}
    category = F.coalesce(
        F.try_element_at(F.expr(sql_literal(kinds, map_keys=True)), F.col("event_type")), F.lit("api_call")
    )
    return table(spark, sf, "events").select(
        "event_id", category.alias("category"), F.floor(F.col("value") * 50).cast("long").alias("calls"), "value"
    )


@query
def quick_estimate(spark: SparkSession, sf: str) -> DataFrame:
    priced = _priced_events(spark, sf).select(
        "event_id", "calls", cost.quick_estimate(F.col("category"), F.col("calls")).alias("e")
    )
    return priced.select("event_id", "calls", "e.*")


@query
def cost_text(spark: SparkSession, sf: str) -> DataFrame:
    amount = F.col("value") * F.col("value")
    small = F.col("value") / 4096
    return table(spark, sf, "events").select(
        "event_id",
        cost.cost_text(amount).alias("library_text"),
        cost.report_cost_text(amount).alias("report_text"),
        cost.indian_cost_text(amount * 16).alias("indian_text"),
        cost.cost_text(small).alias("small_text"),
        cost.report_cost_text(small).alias("small_report_text"),
    )


@query
def report_lines(spark: SparkSession, sf: str) -> DataFrame:
    return report.report_lines(findings(spark, sf))


@query
def why_text(spark: SparkSession, sf: str) -> DataFrame:
    return report.why_text(findings(spark, sf)).select("path", "seq", "rule_id", "why")


# --- sources --------------------------------------------------------------------------


def _write_tree(sources: DataFrame, root: str) -> None:
    """Lay the corpus out as loose files below ``root`` (a shared folder)."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, code in zip(batch["path"], batch["code"]):  # one file at a time as Python bytes
                target = os.path.join(root, path.as_py())
                os.makedirs(os.path.dirname(target), exist_ok=True)
                with open(target, "wb") as out:
                    out.write(code.as_buffer())
            yield pa.RecordBatch.from_arrays([batch["path"]], ["path"])

    small_batches(sources.sparkSession)
    sources.select("path", "code").mapInArrow(write, "path string").write.format("noop").mode("overwrite").save()


def _bytes(code: Column, broken: Column) -> Column:
    """UTF-8 bytes of a text, with a stray byte in front where ``broken``."""
    encoded = F.encode(code, "UTF-8")
    return F.when(broken, F.concat(F.unhex(F.lit("FF")), encoded)).otherwise(encoded)


def _relative(root: str) -> Column:
    return F.substr(F.col("path"), F.lit(len(root) + 2))


def _local_tree(spark: SparkSession, sf: str, broken: Column) -> str:
    root = tree.local_path(run_folder(spark, "tree"))
    _write_tree(files(spark, sf).select("path", _bytes(F.col("code"), broken).alias("code")), root)
    return root


@query
def code_tree_scan(spark: SparkSession, sf: str) -> DataFrame:
    """The corpus as loose files, listed, read and scanned."""
    root = _local_tree(spark, sf, F.lit(False))
    scanned = scan(tree.read_tree(spark, root))
    return scanned.select(_relative(root).alias("path"), "language", "error", F.size("findings").alias("findings_count"))


@query
def code_tree_source(spark: SparkSession, sf: str) -> DataFrame:
    """The same through the data source, with excluded parts of the path left to it."""
    root = _local_tree(spark, sf, F.lit(False))
    tree_source.register(spark)
    listed = spark.read.format(tree_source.NAME).option("recursive", "true").load(f"file://{root}")
    scanned = scan(listed.where(~F.col("path").contains("no such part")))
    return scanned.select(_relative(root).alias("path"), "language", "error", F.size("findings").alias("findings_count"))


@query
def long_file_findings(spark: SparkSession, sf: str) -> DataFrame:
    """Findings of a tree whose JavaScript and Java files of over 2000 bytes are read in ranges of 700 bytes."""
    root = _local_tree(spark, sf, F.lit(False))
    found = tree_findings(spark, root, long_bytes=2000, range_bytes=700)
    return flat(found.withColumn("path", _relative(root)).withColumn("seq", F.lit(0)), "path", "language").drop("seq")


@query
def named_files_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Every file read by its name, excluded and unknown kinds too, and one missing per folder."""
    root = _local_tree(spark, sf, F.lit(False))
    named = files(spark, sf).select("path")
    missing = table(spark, sf, "documents").select("source").distinct().select(
        F.concat(F.lit("repo/"), "source", F.lit("/missing.py")).alias("path"))
    paths = named.unionByName(missing).select(F.concat(F.lit(root + "/"), "path").alias("path"))
    scanned = scan(tree.read_paths(paths))
    return scanned.select(
        _relative(root).alias("path"), "language",
        F.replace("error", F.lit(root + "/"), F.lit("")).alias("error"), F.size("findings").alias("findings_count"),
    )


@query
def invalid_text_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Every fifth file starts with a stray byte: an error row, not a failed job."""
    content = _bytes(F.col("code"), F.col("file_id") % 5 == 0)
    scanned = scan(tree.decode_binary(files(spark, sf).select("path", content.alias("content"))))
    return scanned.select("path", "language", "error", F.size("findings").alias("findings_count"))


@query
def request_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Snippets arriving as JSON request bodies, without a path."""
    bodies = files(spark, sf).select(
        "file_id",
        F.to_json(F.struct("code", F.coalesce("declared_language", F.lit("auto")).alias("language"))).alias("value"),
    )
    return scan(parse_requests(bodies)).select("file_id", "path", "language", "error", F.size("findings").alias("findings_count"))


@query
def page_scripts(spark: SparkSession, sf: str) -> DataFrame:
    return embedded_scripts(table(spark, sf, "pages").select("page_id", "html"))


@query
def page_script_scan(spark: SparkSession, sf: str) -> DataFrame:
    scripts = embedded_scripts(table(spark, sf, "pages").select("page_id", "html"))
    scanned = scan(scripts.withColumn("declared_language", F.lit(JAVASCRIPT)))
    return scanned.select("page_id", "script_no", "language", "error", F.size("findings").alias("findings_count"))


# --- streaming ------------------------------------------------------------------------


def _stream_files(spark: SparkSession, sf: str) -> DataFrame:
    schema = table(spark, sf, "documents").schema
    # a pattern, so that the table may be one file or a folder of files: a plain path must be a folder
    return source_files(spark.readStream.schema(schema).parquet(f"{sf.rstrip('/')}/documents.parque[t]"))


@query
def streamed_findings(spark: SparkSession, sf: str) -> DataFrame:
    folder = run_folder(spark, "stream")
    found = stream_findings(_stream_files(spark, sf))
    write_stream(found, f"{folder}/findings", f"{folder}/state").awaitTermination()
    return flat(spark.read.parquet(f"{folder}/findings"), "path", "language")


@query
def streamed_totals(spark: SparkSession, sf: str) -> DataFrame:
    folder = run_folder(spark, "totals")
    totals = stream_totals(stream_findings(_stream_files(spark, sf)))
    write_totals(totals, f"{folder}/totals", f"{folder}/state").awaitTermination()
    return read_totals(spark, f"{folder}/totals")


@query
def streamed_line_findings(spark: SparkSession, sf: str) -> DataFrame:
    """Lines dealt over four batches, those of a file in no order."""
    folder = run_folder(spark, "lines")
    lines = _lines_of(spark, sf, JAVASCRIPT).withColumn("language", F.lit(JAVASCRIPT)).union(
        _lines_of(spark, sf, JAVA).withColumn("language", F.lit(JAVA)))
    tasks = 4 * max(1, spark.sparkContext.defaultParallelism // 4)
    lines.repartition(tasks, F.xxhash64("file_id", "line_no")).write.parquet(f"{folder}/lines")
    state_store(spark)
    each = -(-len(spark.read.schema(lines.schema).parquet(f"{folder}/lines").inputFiles()) // 4) or 1
    arriving = spark.readStream.schema(lines.schema).option("maxFilesPerTrigger", each).parquet(f"{folder}/lines")
    write_stream(stream_line_findings(arriving), f"{folder}/findings", f"{folder}/state").awaitTermination()
    found = spark.read.parquet(f"{folder}/findings")
    return flat(found.withColumn("seq", F.lit(0)), "file_id", "language").drop("seq")


@query
def corrected_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Every file arrives twice, first with another snippet, and every third a last time as it was."""
    folder, docs = run_folder(spark, "corrected"), documents(spark, sf)
    first = source_files(docs, snippet_by=F.length("text") + 3).withColumn("version", F.lit(1))
    second = source_files(docs).withColumn("version", F.lit(2))
    for part in (first, second, first.where("file_id % 3 = 0")):
        part.write.mode("append").parquet(f"{folder}/files")
    state_store(spark)
    each = -(-len(spark.read.schema(first.schema).parquet(f"{folder}/files").inputFiles()) // 3) or 1
    arriving = spark.readStream.schema(first.schema).option("maxFilesPerTrigger", each).parquet(f"{folder}/files")
    write_changes(stream_changes(arriving), f"{folder}/totals", f"{folder}/state").awaitTermination()
    return TotalsTable(spark, f"{folder}/totals").summary()


# --- corpus ---------------------------------------------------------------------------


@query
def top_files(spark: SparkSession, sf: str) -> DataFrame:
    return report.top_files(results(spark, sf), 20).drop("file_id", "language")


@query
def cost_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return report.cost_rollup(findings(spark, sf))


@query
def observed_iterations(spark: SparkSession, sf: str) -> DataFrame:
    """Estimates per event category with the observed number of events as iterations."""
    counted = _priced_events(spark, sf).groupBy("category").agg(F.count("*").alias("calls"))
    return counted.select(cost.estimate(F.col("category"), F.col("calls")).alias("e")).select("e.*")


@query
def observed_file_costs(spark: SparkSession, sf: str) -> DataFrame:
    """Findings priced with the events of the user whose id is the file's."""
    counts = (
        table(spark, sf, "events").groupBy(F.col("user_id").alias("file_id"))
        .agg((F.count("*") * 10).alias("iterations"))
    )
    priced = findings_of(price_with_counts(results(spark, sf), counts))
    return flat(priced, "path").select("path", "seq", "rule_id", "severity", *COST_COLUMNS, "cost_severity")


@query
def observed_run_costs(spark: SparkSession, sf: str) -> DataFrame:
    """Findings priced with the longest run of events, pauses of two days apart, of the user whose id is the file's."""
    runs = calls_per_run(table(spark, sf, "events"), "user_id", "ts", "2 days").withColumnRenamed("user_id", "file_id")
    priced = findings_of(price_with_counts(results(spark, sf), runs.select("file_id", "iterations")))
    return flat(priced, "path").select("path", "seq", "rule_id", "severity", *COST_COLUMNS, "cost_severity")


@query
def event_runs(spark: SparkSession, sf: str) -> DataFrame:
    return calls_per_run(table(spark, sf, "events"), "user_id", "ts", "2 days")


@query
def incremental_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Two thirds of the files scanned first, then all: only contents that are new are scanned again."""
    folder = run_folder(spark, "known")
    every = source_files(documents(spark, sf), snippet_by=F.length("text"))
    scan_incremental(every.where("file_id % 3 > 0"), folder)
    scanned = scan_incremental(every, folder)
    return scanned.select("file_id", "path", "language", "copies", "error", F.size("findings").alias("findings_count"))


@query
def dedup_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Each distinct content scanned once.  The snippet is chosen by text length here, so
    exact copies among the documents become equal files."""
    docs = documents(spark, sf)
    scanned = scan_distinct(source_files(docs, snippet_by=F.length("text")))
    return scanned.select("file_id", "path", "language", "copies", "error", F.size("findings").alias("findings_count"))


# --- caller-supplied rules and prices -------------------------------------------------

CUSTOM_RULES = (
    Rule("PY900", PYTHON, "Row Save in Loop", "database_write", "medium", "saves one row at a time.",
         "Save rows in bulk.", (CallPattern("row", "save", "ORM save"),)),
    Rule("JS900", JAVASCRIPT, "Console Output in Loop", "serialization", "low", "prints inside a loop.",
         "Log once after the loop.", (LinePattern(r"\.push\s*\(", "Array push"), LinePattern(r"console\s*\.", "console call"))),
)
CUSTOM_COSTS = {"database_read": 0.05, "api_call": 0.25}


@query
def custom_rules(spark: SparkSession, sf: str) -> DataFrame:
    return findings(spark, sf, extra_rules=CUSTOM_RULES).groupBy("rule_id", "description", "severity").agg(
        F.count("*").alias("n"), *report.cost_totals()
    )


def _given_rules(spark: SparkSession, sf: str) -> DataFrame:
    """A rule for every part and supplier; every hundredth looks for a call that occurs."""
    numbers = table(spark, sf, "part").select(F.lit("P").alias("kind"), F.col("p_partkey").alias("n")).union(
        table(spark, sf, "supplier").select(F.lit("S"), "s_suppkey"))
    occurs, name = F.col("n") % 100 == 0, F.concat("kind", F.col("n").cast("string"))
    return numbers.select(
        name.alias("rule_id"), F.when(F.col("kind") == "P", JAVASCRIPT).otherwise(JAVA).alias("language"),
        F.lit("Given Rule").alias("rule_name"), F.lit("api_call").alias("category"), F.lit("low").alias("severity"),
        F.lit("was looked for.").alias("sentence"), F.lit("Look again.").alias("suggestion"), F.lit(1).alias("ord"),
        F.when(occurs & (F.col("kind") == "P"), r"\bfetch\s*\(").when(occurs, r"\.findById\s*\(")
        .otherwise(F.concat(F.lit("call"), name, F.lit(r"\s*\("))).alias("regex"), F.lit("Given call").alias("label"),
    )


@query
def table_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Rules from a table: more of them than a plan should hold."""
    found = findings(spark, sf, rules=(), rule_table=_given_rules(spark, sf))
    return found.groupBy("rule_id", "language", "description").agg(F.count("*").alias("n"), *report.cost_totals())


def _many_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Two patterns for every order line, one for every order and customer, a call for every part."""
    line = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    numbers = table(spark, sf, "lineitem").select(F.lit("L").alias("kind"), line.alias("n")).distinct().withColumn(
        "ord", F.explode(F.array(F.lit(1), F.lit(2))))
    for kind, name, key in (("O", "orders", "o_orderkey"), ("C", "customer", "c_custkey"), ("P", "part", "p_partkey")):
        numbers = numbers.union(table(spark, sf, name).select(F.lit(kind), F.col(key), F.lit(1)))
    kind, n, name = F.col("kind"), F.col("n"), F.concat("kind", F.col("n").cast("string"))
    absent = F.concat(F.lit("call"), name, F.lit("x"), F.col("ord").cast("string"))
    return numbers.select(
        name.alias("rule_id"), "ord", F.when(kind == "C", JAVA).when(kind == "P", PYTHON).otherwise(JAVASCRIPT).alias("language"),
        F.lit("Given Rule").alias("rule_name"), F.lit("api_call").alias("category"), F.lit("low").alias("severity"),
        F.lit("was looked for.").alias("sentence"), F.lit("Look again.").alias("suggestion"),
        F.when((kind == "O") & (n % 1000 == 0), MANY_JS).when((kind == "C") & (n % 100 == 0), MANY_JAVA)
        .when(kind != "P", F.concat(absent, F.lit(r"\s*\(|other"), absent, F.lit(r"\s*\("))).alias("regex"),
        F.when(kind == "P", F.when(n % 100 == 0, "requests").otherwise(F.concat(F.lit("svc"), n.cast("string")))).alias("obj"),
        F.when(kind == "P", F.when(n % 100 == 0, "get").otherwise(F.concat(F.lit("op"), n.cast("string")))).alias("method"),
        F.lit("Given call").alias("label"),
    )


MANY_JS, MANY_JAVA = r"\bfetch\s*\(|\.findOne\s*\(", r"\.findById\s*\("


@query
def table_rules_many(spark: SparkSession, sf: str) -> DataFrame:
    """Over 100,000 patterns at scale 0.01: lines and calls meet only those filed under what they hold."""
    found = findings(spark, sf, rules=(), rule_table=_many_rules(spark, sf))
    return found.groupBy("rule_id", "language", "description").agg(F.count("*").alias("n"), *report.cost_totals())


@query
def call_pattern_overlap(spark: SparkSession, sf: str) -> DataFrame:
    """Call names in use against a pattern for every order line and order: how many overlap, and the first."""
    names = py_call_sites(spark, sf).groupBy("obj", "method").agg(F.count("*").alias("n_calls"))
    n = F.col("n")
    given = table(spark, sf, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("n")).union(
        table(spark, sf, "orders").select(-F.col("o_orderkey"))).distinct()
    objects = F.array(F.lit(""), F.lit("db"), F.lit("session"), F.lit("request"), F.concat(F.lit("svc"), n.cast("string")))
    methods = F.array(F.lit("get"), F.lit("find"), F.lit("e"))
    patterns = given.select(
        F.get(objects, F.abs(n) % 5).alias("obj"),
        F.when(n % 1000 == 0, F.get(methods, F.abs(n) % 3)).otherwise(F.concat(F.lit("op"), n.cast("string"))).alias("method"))
    met = overlapping(names, patterns)
    per = met.groupBy("obj", "method").agg(
        F.count("*").alias("n_patterns"), F.min(F.concat("p_obj", F.lit("."), "p_method")).alias("first_pattern"))
    return names.join(per, ["obj", "method"]).select("obj", "method", "n_calls", "n_patterns", "first_pattern")


@query
def custom_costs(spark: SparkSession, sf: str) -> DataFrame:
    """Prices from a table: the mean event value per category, which two categories lack."""
    prices = _priced_events(spark, sf).where("category in ('database_read', 'api_call')").groupBy("category").agg(
        (F.sum(F.floor("value").cast("long")) / F.count("*") / 1024).alias("unit_cost"))
    priced = price_with(findings(spark, sf), prices)
    return flat(priced, "path").select("path", "seq", "rule_id", "category", *COST_COLUMNS, "cost_severity")


@query
def custom_cost_map(spark: SparkSession, sf: str) -> DataFrame:
    """Prices and iterations given to the scan itself; high costs raise Python severities."""
    found = findings(spark, sf, unit_costs=CUSTOM_COSTS, iterations=250)
    return found.groupBy("rule_id", "severity").agg(F.count("*").alias("n"), *report.cost_totals())
