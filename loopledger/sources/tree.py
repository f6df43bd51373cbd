"""Loose source trees on a file system every executor can reach.

Built-in file readers skip names that start with ``_`` or ``.``, which source trees
are full of, so paths are listed and files opened by small Python functions on the
executors.
"""

from __future__ import annotations

import os
import sys
import uuid
from collections.abc import Iterator, Sequence
from itertools import islice

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.language import DEFAULT_EXCLUDES, is_excluded, is_supported
from ..session import checkpoint_dir

cloudpickle.register_pickle_by_value(sys.modules[__name__])

LISTING = "path string, kind string, error string"
PATHS_PER_BATCH = 5_000
BYTES_PER_BATCH = 16 << 20
# A text must fit one column value; a longer file is reported, not dropped.
MAX_FILE_BYTES = (1 << 31) - (1 << 20)


def local_path(root: str) -> str:
    """A path that executors can open; trees in other stores are refused rather than found empty."""
    scheme, found, rest = root.partition("://")
    if found and scheme != "file":
        raise ValueError(f"{root}: trees are opened as files; read other stores with binaryFile and decode_binary")
    return os.path.normpath("/" + rest.lstrip("/") if found else root)


def _all_excluded(folder: str, excludes: Sequence[str]) -> bool:
    """The exclusion test looks at whole paths, so a matching folder is out entirely."""
    return any(x in folder + "/" for x in excludes)


def _lister(excludes: Sequence[str]):
    def below(folder: str) -> Iterator[tuple[str, str, str | None]]:
        """(path, kind, error) of what is in a folder; one that cannot be read is an error."""
        try:
            with os.scandir(folder) as entries:
                for e in entries:
                    if e.is_dir(follow_symlinks=False):
                        if not _all_excluded(e.path, excludes):
                            yield e.path, "folder", None
                    elif not e.is_dir():
                        yield e.path, "file", None
        except OSError as exc:
            yield folder, "error", f"Could not read folder: {exc}"

    def list_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for folder in batch["path"].to_pylist():
                found = below(folder)
                while rows := list(islice(found, PATHS_PER_BATCH)):
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], ["path", "kind", "error"])

    return list_


def _listed(spark: SparkSession, root: str, recursive: bool, excludes: Sequence[str]) -> DataFrame:
    """(path, kind, error) of files and unreadable folders below a root, listed level by level on the executors.

    Every level is a table, dealt out by folder, so neither the driver nor one task holds a subtree.
    """
    root = local_path(root)
    level = spark.createDataFrame([(root,)] if os.path.isdir(root) else [], "path string")
    store = f"{checkpoint_dir(spark).rstrip('/')}/tree-{uuid.uuid4().hex}"
    found, depth, more = None, 0, True
    while more:
        folders = level.repartition(_reading_tasks(spark), F.xxhash64("path"))
        listing = folders.mapInArrow(_lister(excludes), LISTING)
        listing.write.parquet(f"{store}/{depth}")
        listing = spark.read.schema(LISTING).parquet(f"{store}/{depth}")
        here = listing.where("kind <> 'folder'")
        found = here if found is None else found.union(here)
        level = listing.where("kind = 'folder'").select("path")
        depth, more = depth + 1, recursive and not level.isEmpty()
    return found


def read_source(path: str) -> tuple[str | None, str | None]:
    """(text, error) of one file; every failure becomes an error text."""
    if not os.path.exists(path):
        return None, f"File not found: {path}"
    if not os.path.isfile(path):
        return None, f"Not a file: {path}"
    try:
        if os.path.getsize(path) > MAX_FILE_BYTES:
            return None, f"Could not read file: larger than {MAX_FILE_BYTES} bytes"
        with open(path, encoding="utf-8") as handle:
            return handle.read(), None
    except (OSError, UnicodeError) as exc:
        return None, f"Could not read file: {exc}"


def _read(batches: Iterator[pa.RecordBatch], files_only: bool = False) -> Iterator[pa.RecordBatch]:
    names = ["path", "code", "error"]

    def pack(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()) for c in zip(*rows)], names)

    rows, size = [], 0
    for batch in batches:
        for path in batch["path"].to_pylist():
            if files_only and not os.path.isfile(path):
                continue
            text, error = read_source(path)
            # held as UTF-8: a string may take four bytes a character
            code = None if text is None else text.encode("utf-8")
            own, text = len(code or b""), None
            if rows and size + own > BYTES_PER_BATCH:
                full = pack(rows)
                rows, size = [], 0
                yield full
                del full
            rows.append((path, code, error))
            size += own
    if rows:
        yield pack(rows)


def _read_listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """As ``_read``, leaving out links to nowhere and other things that are no files."""
    return _read(batches, files_only=True)


def _reading_tasks(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def list_tree(
    spark: SparkSession, root: str, recursive: bool = True, excludes: Sequence[str] | None = None
) -> DataFrame:
    """Paths of all supported files below ``root``; a missing root gives no rows."""
    excludes = tuple(excludes or DEFAULT_EXCLUDES)
    listed = _listed(spark, root, recursive, excludes).where("kind = 'file'").select("path")
    return listed.where(is_supported(F.col("path")) & ~is_excluded(F.col("path"), excludes))


def read_tree(
    spark: SparkSession, root: str, recursive: bool = True, excludes: Sequence[str] | None = None
) -> DataFrame:
    """``path, code, error`` of a source tree.

    Paths are pruned before any file is opened, then spread evenly by hash, so one
    crowded directory does not keep one task busy.  A folder that cannot be read is an error row.
    """
    excludes = tuple(excludes or DEFAULT_EXCLUDES)
    listed = _listed(spark, root, recursive, excludes)
    paths = listed.where(
        (F.col("kind") == "file") & is_supported(F.col("path")) & ~is_excluded(F.col("path"), excludes)).select("path")
    spread = paths.repartition(_reading_tasks(spark), F.xxhash64("path"))
    read = spread.mapInArrow(_read_listed, "path string, code string, error string")
    return read.union(listed.where("kind = 'error'").select("path", F.lit(None).cast("string"), "error"))


def read_path(spark: SparkSession, path: str) -> DataFrame:
    """One named file, without extension or exclusion tests."""
    return spark.createDataFrame([(path,)], "path string").mapInArrow(
        _read, "path string, code string, error string"
    )


def read_paths(paths: DataFrame) -> DataFrame:
    """Read the files named in column ``path``, one row each."""
    return paths.select("path").mapInArrow(_read, "path string, code string, error string")


def decode_binary(files: DataFrame) -> DataFrame:
    """``path, code, error`` from rows of Spark's ``binaryFile`` source (``path, content``).

    For object stores.  That source leaves out hidden names; undecodable rows become
    errors here.
    """
    text = F.col("content").cast("string")
    valid = F.is_valid_utf8(text)
    return files.select(
        "path",
        F.when(valid, F.regexp_replace(text, r"\r\n?", "\n")).alias("code"),
        F.when(~valid, F.lit("Could not read file: not valid UTF-8")).alias("error"),
    )
