"""Files of any store: paths, file systems and texts, for functions that run on executors."""

from __future__ import annotations

import importlib
import os
import sys
from collections.abc import Sequence

from pyarrow import fs
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def open_store(root: str, provider: str | None = None) -> tuple[fs.FileSystem, str]:
    """File system of a root, and the root's path in it.

    A plain path or ``file://`` is the local one; other schemes go to the store they name.  A provider
    ``module:function`` is called with the root instead, for stores of one's own.
    """
    if provider:
        module, _, name = provider.partition(":")
        return getattr(importlib.import_module(module), name)(root)
    scheme, found, rest = root.partition("://")
    if not found:
        return fs.LocalFileSystem(), os.path.normpath(root)
    if scheme == "file":
        return fs.LocalFileSystem(), os.path.normpath("/" + rest.lstrip("/"))
    return fs.FileSystem.from_uri(root)


def shown_root(root: str) -> str:
    """How paths below a root start in results: local ones as plain paths."""
    scheme, found, rest = root.partition("://")
    return os.path.normpath("/" + rest.lstrip("/") if scheme == "file" and found else root) if not found or scheme == "file" else root.rstrip("/")


def plain_text(data: bytes) -> str:
    """Text as Python opens it: UTF-8 with universal line ends."""
    text = data.decode("utf-8")
    return text.replace("\r\n", "\n").replace("\r", "\n") if "\r" in text else text


def has_extension(path: str, extensions: Sequence[str]) -> bool:
    """Whether the last suffix of the file name is one of these; a name such as ``.py`` has none."""
    stem, dot, suffix = path.rsplit("/", 1)[-1].rpartition(".")
    return bool(stem and dot) and f".{suffix}".lower() in extensions
