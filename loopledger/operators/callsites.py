"""Python call sites: one small record per call, parsed on the executors.

Python's grammar cannot be expressed with column functions, so this one step runs
the standard-library parser inside an Arrow-batched function.  Everything after it
(name matching, rules, pricing) is column expressions again.
"""

from __future__ import annotations

import ast
import sys
import warnings
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf, udtf

from ..rules import HOT_FUNCTION_WORDS
from ..session import small_batches

# Ship this module's functions with the job, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

CALL_FIELDS = (
    T.StructType()
    .add("line_no", T.IntegerType())
    .add("obj", T.StringType())
    .add("method", T.StringType())
    .add("in_loop", T.BooleanType())
    .add("in_hot_path", T.BooleanType())
    .add("query_literal", T.StringType())
)
EXTRACT_TYPE = T.StructType().add("calls", T.ArrayType(CALL_FIELDS)).add("error", T.StringType())

_FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)
# `async for` is deliberately absent: it does not count as a loop.
_LOOPS = (ast.For, ast.While, ast.ListComp, ast.DictComp, ast.SetComp, ast.GeneratorExp)


def call_name(func: ast.expr) -> tuple[str, str] | None:
    """(receiver, method) of a call, lower-cased; null where the receiver has no name."""
    match func:
        case ast.Name(id=name):
            return "", name.lower()
        case ast.Attribute(value=ast.Name(id=owner), attr=name):
            pass
        case ast.Attribute(value=ast.Attribute(attr=owner), attr=name):
            pass
        case ast.Attribute(value=ast.Call(func=ast.Attribute(attr=owner)), attr=name):
            pass
        case _:
            return None
    return owner.lower(), name.lower()


def query_literal(call: ast.Call) -> str | None:
    """Lower-cased text of a string or f-string given as first positional argument."""
    match call.args:
        case [ast.Constant(value=str() as text), *_]:
            return text.lower()
        case [ast.JoinedStr(values=parts), *_]:
            return "".join(str(p.value) for p in parts if isinstance(p, ast.Constant)).lower()
    return None


def call_sites(code: str) -> Iterator[tuple]:
    """Calls of one source text in pre-order, with loop and function context.

    The walk keeps its own stack, so nesting depth is no limit.
    """
    pending = [(ast.parse(code), False, False)]
    while pending:
        node, in_loop, hot = pending.pop()
        if isinstance(node, _FUNCTIONS):
            name = node.name.lower()
            hot = any(word in name for word in HOT_FUNCTION_WORDS)
        elif isinstance(node, _LOOPS):
            in_loop = True
        elif isinstance(node, ast.Call):
            named = call_name(node.func)
            if named:
                yield node.lineno, *named, in_loop, hot, query_literal(node)
        pending.extend((child, in_loop, hot) for child in reversed(list(ast.iter_child_nodes(node))))


_CALLS_ARROW = pa.struct([
    ("line_no", pa.int32()), ("obj", pa.string()), ("method", pa.string()),
    ("in_loop", pa.bool_()), ("in_hot_path", pa.bool_()), ("query_literal", pa.string()),
])


@arrow_udf(EXTRACT_TYPE)
def extract_calls(code: pa.Array) -> pa.Array:
    """Calls per text.  A syntax error gives no calls and no error; any other parser
    failure is reported in ``error``."""
    offsets, rows, errors = [0], [], []
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        for value in code:  # one text at a time as a Python string
            text, error, found = value.as_py(), None, []
            if text is not None:
                try:
                    found = list(call_sites(text))
                except SyntaxError:
                    pass
                except (ValueError, RecursionError, MemoryError) as exc:
                    error = str(exc) or type(exc).__name__
            rows.extend(found)
            offsets.append(len(rows))
            errors.append(error)
    columns = zip(*rows) if rows else [()] * len(_CALLS_ARROW)
    calls = pa.StructArray.from_arrays(
        [pa.array(list(values), type=f.type) for values, f in zip(columns, _CALLS_ARROW)],
        fields=list(_CALLS_ARROW),
    )
    nested = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), calls)
    return pa.StructArray.from_arrays([nested, pa.array(errors, pa.string())], names=["calls", "error"])


def call_site_table(files: DataFrame, key: str = "file_id", code: str = "code") -> DataFrame:
    """Table of call sites: the key, ``seq`` in pre-order from 1, and the call fields."""
    small_batches(files.sparkSession)
    parsed = files.select(key, extract_calls(F.col(code))["calls"].alias("calls"))
    exploded = parsed.select(key, F.posexplode("calls").alias("pos", "call"))
    return exploded.select(key, (F.col("pos") + 1).alias("seq"), "call.*")


@udtf(returnType=T.StructType([T.StructField("seq", T.IntegerType()), *CALL_FIELDS]), useArrow=True)
class PythonCallSites:
    """``SELECT ... FROM files, LATERAL python_call_sites(code)``"""

    def eval(self, code: str):
        if code is None:
            return
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            try:
                found = list(call_sites(code))
            except (SyntaxError, ValueError, RecursionError, MemoryError):
                return
        for seq, row in enumerate(found, 1):
            yield seq, *row


def register_udtf(spark: SparkSession, name: str = "python_call_sites") -> None:
    spark.udtf.register(name, PythonCallSites)
