"""Source trees of any store as a data source: ``spark.read.format("source_tree").load(root)``.

Columns ``path, code, error``; names that start with ``_`` or ``.`` are read like any other.  Folders
are listed through the store's own file system: level by level while the job is planned until there
is enough to deal out, below that by the tasks.  Filters on ``path`` (equality, prefix, suffix,
part of the name, and their negation) are taken over, so what they exclude is neither listed below
nor opened.

Options: ``recursive`` (default true); ``excludes``, parts of a path separated by commas; ``extensions``
in the same form; ``provider``, a ``module:function`` for stores of one's own (see ``files``);
``tasks``, how many to plan at least where the tree is large enough; ``longest``, bytes of the
largest file that is read, a longer one is an error row.

A folder that cannot be read, a file that cannot be opened and one that is not UTF-8 are error rows.  A
missing root and an empty tree give no rows; links to folders are not followed in local trees, links
to nowhere are left out.
"""

from __future__ import annotations

import os
import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import SparkSession
from pyspark.sql import datasource as ds

from ..functions.language import DEFAULT_EXCLUDES, EXTENSIONS
from .files import has_extension, open_store, plain_text, shown_root

cloudpickle.register_pickle_by_value(sys.modules[__name__])

NAME = "source_tree"
BYTES_PER_BATCH = 16 << 20
FILES_PER_TASK = 500
LONGEST = (1 << 31) - (1 << 20)
SUPPORTED = tuple(e for own in EXTENSIONS.values() for e in own)


@dataclass
class Share(ds.InputPartition):
    """What one task reads: files, folders with all below them, and errors met while planning."""

    files: tuple[str, ...] = ()
    folders: tuple[str, ...] = ()
    errors: tuple[tuple[str, str], ...] = ()


def _accepts(test: tuple, path: str) -> bool:
    kind, value = test
    if kind == "not":
        return not _accepts(value, path)
    if kind in ("start", "end"):
        return path.startswith(value) if kind == "start" else path.endswith(value)
    return {"equal": path.__eq__, "part": path.__contains__}.get(kind, lambda v: path in v)(value)


def _may_hold(test: tuple, folder: str) -> bool:
    """Whether a file below a folder can pass; only what looks at the front of a path can tell."""
    kind, value = test
    front = folder.rstrip("/") + "/"
    if kind == "equal":
        return value.startswith(front)
    if kind == "start":
        return value.startswith(front) or front.startswith(value)
    if kind == "in":
        return any(v.startswith(front) for v in value)
    if kind == "not" and value[0] in ("start", "part"):
        return not _accepts(value, front)
    return True


def _test_of(filter_: ds.Filter) -> tuple | None:
    """A filter on the path as a plain test, or nothing."""
    if isinstance(filter_, ds.Not):
        inner = _test_of(filter_.child)
        return ("not", inner) if inner else None
    kinds = {ds.EqualTo: "equal", ds.StringStartsWith: "start", ds.StringEndsWith: "end", ds.StringContains: "part", ds.In: "in"}
    kind = kinds.get(type(filter_))
    return (kind, filter_.value) if kind and tuple(filter_.attribute) == ("path",) and filter_.value is not None else None


class TreeReader(ds.DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root, self.provider = options["path"], options.get("provider")
        self.recursive = options.get("recursive", "true").lower() == "true"
        self.excludes = tuple(x for x in options.get("excludes", ",".join(DEFAULT_EXCLUDES)).split(",") if x)
        self.extensions = tuple(x for x in options.get("extensions", ",".join(SUPPORTED)).split(",") if x)
        self.tasks, self.longest = int(options.get("tasks", 64)), int(options.get("longest", LONGEST))
        self.tests: list[tuple] = []

    def pushFilters(self, filters: list[ds.Filter]) -> Iterator[ds.Filter]:
        for filter_ in filters:
            test = _test_of(filter_)
            if test:
                self.tests.append(test)
            else:
                yield filter_

    def _shown(self, base: str, path: str) -> str:
        return f"{shown_root(self.root)}/{path[len(base.rstrip('/')):].lstrip('/')}"

    def _wanted(self, shown: str) -> bool:
        return (has_extension(shown, self.extensions) and not any(x in shown for x in self.excludes)
                and all(_accepts(t, shown) for t in self.tests))

    def _below(self, store: fs.FileSystem, base: str, folder: str) -> tuple[list[str], list[str], list[tuple[str, str]]]:
        """Files and folders in a folder, and the error if it cannot be read."""
        try:
            found = store.get_file_info(fs.FileSelector(folder, recursive=False, allow_not_found=folder == base))
        except OSError as exc:
            return [], [], [(self._shown(base, folder), f"Could not read folder: {exc}")]
        files, folders, local = [], [], isinstance(store, fs.LocalFileSystem)
        for info in found:
            shown = self._shown(base, info.path)
            if info.type == fs.FileType.Directory:
                if not any(x in shown + "/" for x in self.excludes) and all(_may_hold(t, shown) for t in self.tests):
                    if not (local and os.path.islink(info.path)):
                        folders.append(info.path)
            elif info.type == fs.FileType.File and self._wanted(shown):
                files.append(info.path)
        return sorted(files), sorted(folders), []

    def partitions(self) -> Sequence[Share]:
        store, base = open_store(self.root, self.provider)
        level, files, errors = [base], [], []
        while level and (level == [base] or len(level) + len(files) // FILES_PER_TASK < self.tasks):
            deeper = []
            for folder in level:
                more, below, failed = self._below(store, base, folder)
                files += more
                errors += failed
                deeper += below
            level = deeper if self.recursive else []
        size = max(1, min(FILES_PER_TASK, -(-len(files) // self.tasks)))
        shares = [Share(files=tuple(files[k : k + size])) for k in range(0, len(files), size)]
        shares += [Share(folders=(folder,)) for folder in level]
        return [*shares, Share(errors=tuple(errors))] if errors or not shares else shares

    def read(self, partition: Share) -> Iterator[pa.RecordBatch]:
        store, base = open_store(self.root, self.provider)
        rows, held = [], 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()) for c in zip(*rows)] or [pa.array([], pa.string())] * 3,
                                              names=["path", "code", "error"])

        for row in self._rows(store, base, partition):
            size = len(row[1] or "")
            if rows and held + size > BYTES_PER_BATCH:
                yield batch()
                rows, held = [], 0
            rows.append(row)
            held += size
        if rows:
            yield batch()

    def _rows(self, store: fs.FileSystem, base: str, share: Share) -> Iterator[tuple[str, str | None, str | None]]:
        yield from self._failed(share.errors)
        for path in share.files:
            yield self._opened(store, base, path)
        waiting = list(share.folders)
        while waiting:
            files, folders, errors = self._below(store, base, waiting.pop())
            waiting += folders
            yield from self._failed(errors)
            for path in files:
                yield self._opened(store, base, path)

    def _failed(self, errors: Sequence[tuple[str, str]]) -> Iterator[tuple[str, None, str]]:
        """Error rows of folders, which pass the filters on the path like any row."""
        return ((path, None, error) for path, error in errors if all(_accepts(t, path) for t in self.tests))

    def _opened(self, store: fs.FileSystem, base: str, path: str) -> tuple[str, str | None, str | None]:
        shown = self._shown(base, path)
        try:
            with store.open_input_stream(path) as handle:
                data = handle.read(self.longest + 1)
            if len(data) > self.longest:
                return shown, None, f"Could not read file: larger than {self.longest} bytes"
            return shown, plain_text(data), None
        except (OSError, UnicodeError) as exc:
            return shown, None, f"Could not read file: {exc}"


class TreeSource(ds.DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "path string, code string, error string"

    def reader(self, schema) -> TreeReader:
        return TreeReader(dict(self.options))


def register(spark: SparkSession) -> None:
    """Make the format known to a session, with filters handed over to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TreeSource)
