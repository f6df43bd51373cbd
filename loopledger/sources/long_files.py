"""Files too long for one value, as lines read by byte ranges.

A file is cut into ranges of bytes that tasks read side by side; a line belongs to the range in which
it starts, and its number follows from the counts of the ranges before.  So neither a file nor its
lines are ever together in a task.  Line breaks are those of Python texts, found in the bytes.

A file with a byte that is not UTF-8, or a line longer than a value can hold, gives one error row
(line_no null) and no lines; a last break adds no empty line; an empty file has no lines.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.language import language_by_extension
from ..operators.scan import findings_of, scan
from ..operators.scope import line_findings
from ..rules import JAVA, JAVASCRIPT
from ..session import written
from .files import open_store
from .tree import MAX_FILE_BYTES, list_tree, read_paths

cloudpickle.register_pickle_by_value(sys.modules[__name__])

RANGE_BYTES = 64 << 20
PIECE = 4 << 20
#: Lines of one batch, by bytes.
BATCH_BYTES = 8 << 20
# The line breaks of Python texts in UTF-8; a carriage return and line feed are one.
_BREAK = re.compile(rb"\r\n|[\n\r\x0b\x0c\x1c-\x1e]|\xc2\x85|\xe2\x80[\xa8\xa9]")
_LONGEST_BREAK = 3


def _lines(handle, size: int, start: int, end: int) -> Iterator[bytes]:
    """Lines that start in [start, end), without their breaks."""
    at = max(start - _LONGEST_BREAK, 0)
    # a line starts at the front of the file and behind every break, so one that ends before `start` is looked for first
    owned, held = start == 0, b""
    while True:
        piece = handle.read_at(min(PIECE, size - at - len(held)), at + len(held)) if at + len(held) < size else b""
        held += piece
        final = at + len(held) >= size
        seen = 0
        for m in _BREAK.finditer(held):
            if not final and m.end() > len(held) - _LONGEST_BREAK:
                break  # what follows may belong to this break
            if owned:
                yield held[seen : m.start()]
            seen = m.end()
            owned = owned or at + seen >= start
            if at + seen >= end:
                return
        if final:
            if owned and seen < len(held):
                yield held[seen:]
            return
        if len(held) - seen > MAX_FILE_BYTES:
            raise ValueError(f"line longer than {MAX_FILE_BYTES} bytes")
        at, held = at + seen, held[seen:]


def _read(root: str, provider: str | None):
    """Lines of ranges (path, size, range, start, end)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = open_store(root, provider)
        names = ["path", "range", "place", "line", "error"]
        kinds = [pa.string(), pa.int32(), pa.int64(), pa.string(), pa.string()]

        def pack(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names)

        for batch in batches:
            for path, size, number, start, end in zip(*(batch.column(k).to_pylist() for k in range(5))):
                rows, held = [], 0
                try:
                    with store.open_input_file(path) as handle:
                        for place, line in enumerate(_lines(handle, size, start, end)):
                            rows.append((path, number, place, line.decode("utf-8"), None))
                            held += len(line) + 64
                            if held > BATCH_BYTES:
                                yield pack(rows)
                                rows, held = [], 0
                except (OSError, ValueError) as exc:
                    rows.append((path, number, None, None, f"Could not read file: {exc}"))
                if rows:
                    yield pack(rows)

    return read


def with_size(paths: DataFrame, root: str = "/", provider: str | None = None) -> DataFrame:
    """(path, size) of named files; one that cannot be looked at has size 0 and fails where it is read."""

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = open_store(root, provider)
        for batch in batches:
            found = [max(store.get_file_info(p).size or 0, 0) for p in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], ["path", "size"])

    return paths.select("path").mapInArrow(sizes, "path string, size long")


def long_lines(files: DataFrame, range_bytes: int = RANGE_BYTES, root: str = "/", provider: str | None = None) -> DataFrame:
    """(path, line_no, line, error) of files (path, size), read range by range."""
    last = F.floor((F.col("size") - 1) / range_bytes).cast("int")
    ranges = files.where("size > 0").select("path", "size", F.explode(F.sequence(F.lit(0), last)).alias("range")).select(
        "path", "size", "range", (F.col("range").cast("long") * range_bytes).alias("start"),
        ((F.col("range").cast("long") + 1) * range_bytes).alias("end"))
    dealt = ranges.repartition(F.xxhash64("path", "range"))
    lines = written(dealt.mapInArrow(
        _read(root, provider), "path string, range int, place long, line string, error string"), "ranges")
    counts = lines.groupBy("path", "range").agg(F.count("line").alias("n"), F.max("error").alias("failed"))
    before = Window.partitionBy("path").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("path", "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    failed = counts.where("failed IS NOT NULL").groupBy("path").agg(F.min("failed").alias("error"))
    whole = lines.where("error IS NULL").join(failed.select("path"), "path", "left_anti").join(offsets, ["path", "range"])
    return whole.select("path", (F.col("before") + F.col("place") + 1).cast("int").alias("line_no"), "line", "error").union(
        failed.select("path", F.lit(None).cast("int"), F.lit(None).cast("string"), "error"))


def tree_findings(spark: SparkSession, root: str, long_bytes: int = MAX_FILE_BYTES, range_bytes: int = RANGE_BYTES,
                  **options) -> DataFrame:
    """Findings (path, language, then a finding's fields) of a tree, whatever the length of its JavaScript and Java files.

    Files over `long_bytes` are scanned as lines.  A Python file must be parsed whole, so it is read as one value.
    """
    sized = written(with_size(list_tree(spark, root)).withColumn("language", language_by_extension(F.col("path"))), "sizes")
    by_lines = (F.col("size") > long_bytes) & F.col("language").isin(JAVASCRIPT, JAVA)
    short = findings_of(scan(read_paths(sized.where(~by_lines).select("path")), **options)).drop("seq")
    found = short
    for language in (JAVASCRIPT, JAVA):
        own = long_lines(sized.where(by_lines & (F.col("language") == language)), range_bytes)
        more = line_findings(own.where("line_no IS NOT NULL"), language, key="path", **options)
        found = found.unionByName(more.withColumn("language", F.lit(language)))
    return found
