"""Job entry: ``python -m loopledger scan SOURCE [--json FOLDER] ...``; master and settings come from Spark's own files.

SOURCE is a Parquet table with a column ``code`` (``--table``, or a name that ends in .parquet) or a tree of
source files in any store.  The exit code is 1 if more findings than ``--allow`` were made, else 0; 2 for
wrong arguments.
"""

from __future__ import annotations

import argparse
import sys
import time

from pyspark.sql import Observation, SparkSession
from pyspark.sql import functions as F

from .operators.scan import findings_of, scan
from .plans import report
from .session import ship, written
from .sources import tree_source
from .sources.sinks import write_findings, write_json


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="loopledger", description="Find and price calls that cost money inside loops.")
    commands = parser.add_subparsers(dest="command", required=True)
    one = commands.add_parser("scan", help="scan a table or a tree of source files")
    one.add_argument("source")
    one.add_argument("--table", action="store_true", help="SOURCE is a Parquet table whatever its name")
    one.add_argument("--flat", action="store_true", help="do not go into folders below SOURCE")
    one.add_argument("--exclude", action="append", default=[], help="part of a path to leave out (may be repeated)")
    one.add_argument("--json", metavar="FOLDER", help="write results and summary as JSON")
    one.add_argument("--findings", metavar="FOLDER", help="write findings as Parquet, by language")
    one.add_argument("--iterations", type=int, help="assumed iterations of a loop")
    one.add_argument("--allow", type=int, default=0, help="findings up to which the exit code is 0")
    one.add_argument("--top", type=int, default=10, help="files to list")
    return parser.parse_args(argv)


def sources(spark: SparkSession, args: argparse.Namespace):
    if args.table or args.source.rstrip("/").endswith(".parquet"):
        return spark.read.parquet(args.source)
    tree_source.register(spark)
    reader = spark.read.format(tree_source.NAME).option("recursive", str(not args.flat).lower())
    if args.exclude:
        reader = reader.option("excludes", ",".join([*tree_source.DEFAULT_EXCLUDES, *args.exclude]))
    return reader.load(args.source)


def run(spark: SparkSession, args: argparse.Namespace, out=sys.stdout) -> int:
    """Scan, write and report; the exit code."""
    started, counts = time.monotonic(), Observation("scan")
    results = scan(sources(spark, args), iterations=args.iterations)
    seen = results.observe(
        counts, F.count("*").alias("files"), F.coalesce(F.sum(F.size("findings")), F.lit(0)).alias("findings"),
        F.count_if(F.col("error").isNotNull()).alias("errors"))
    # scanned once: what is written or listed below reads this table
    kept = written(seen, "results")
    found = findings_of(kept)
    if args.json:
        write_json(kept, args.json)
    if args.findings:
        write_findings(found, args.findings)
    got = counts.get
    for row in report.cost_summary(found, by=["category"]).orderBy("category").collect():  # one row for each category
        print(f"{row['category']}: {row['findings_count']} findings, {row['total_monthly']:.2f} a month", file=out)
    for row in report.top_files(kept, args.top).collect():
        print(f"{row['path']}: {row['findings_count']} findings", file=out)
    print(f"{got['files']} files, {got['findings']} findings, {got['errors']} errors, "
          f"{(time.monotonic() - started) * 1000:.2f} ms", file=out)
    return int(got["findings"] > args.allow)


def main(argv: list[str] | None = None) -> int:
    args = arguments(argv)
    spark = SparkSession.builder.appName("loopledger").config("spark.ui.enabled", "false").getOrCreate()
    ship(spark)
    try:
        return run(spark, args)
    finally:
        spark.stop()


if __name__ == "__main__":
    sys.exit(main())
