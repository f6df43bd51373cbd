"""Which lines lie inside a loop: a per-row fold over the lines of one file.

The fold is the form used by ``scan``: it needs no shuffle, because every line of
a file already sits in the file's row.  ``operators.scope`` holds the relational
form for corpora stored one line per row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..rules import JAVA, JAVASCRIPT, LOOPS
from .text import finds, searchable

# Lines folded at a time.
CHUNK = 128


def numbered_lines(lines: Column) -> Column:
    """Array of ``no, text, low``: line number from 1, text, and its searchable form."""
    return F.transform(
        lines,
        lambda text, i: F.struct((i + 1).alias("no"), text.alias("text"), searchable(text).alias("low")),
    )


def is_loop_start(text: str, lowered: str, language: str) -> str:
    """SQL of the loop-start test of one line."""
    return "(" + " OR ".join(finds(text, lowered, p) for p in LOOPS[language]) + ")"


def _count(text: str, char: str) -> str:
    return f"(length({text}) - length(replace({text}, '{char}', '')))"


def brace_low(text: str) -> str:
    """SQL of the lowest brace balance reached inside a line, at most 0."""
    step = "CASE ch WHEN '{' THEN 1 WHEN '}' THEN -1 ELSE 0 END"
    return (
        f"CASE WHEN contains({text}, '}}') THEN "
        f"aggregate(split(regexp_replace({text}, '[^{{}}]', ''), ''), named_struct('at', 0, 'low', 0), "
        f"(acc, ch) -> named_struct('at', acc.at + {step}, 'low', least(acc.low, acc.at + {step})), acc -> acc.low) "
        "ELSE 0 END"
    )


def line_mark(text: str, lowered: str, language: str) -> str:
    """SQL of what the scope of a line depends on.

    JavaScript: loop starts and closing braces.  Java: loop start, change of brace
    depth, lowest depth within the line.
    """
    start = is_loop_start(text, lowered, language)
    if language == JAVASCRIPT:
        return f"named_struct('start', CAST({start} AS INT), 'closes', {_count(text, '}')})"
    return (
        f"named_struct('start', {start}, 'delta', {_count(text, '{')} - {_count(text, '}')}, "
        f"'low', {brace_low(text)})"
    )


@dataclass(frozen=True)
class Walk:
    """A walk along the marks of a file, as SQL of a state ``s`` and a mark ``m``."""

    state_type: str
    initial: str
    after: str
    inside: str


# JavaScript: the number of open loops.  A loop-start line opens one level and each
# closing brace ends one; opening braces play no part.
JS_WALK = Walk("int", "0", "greatest(0, s + m.start - m.closes)", "s + m.start > 0")

# Java: brace depth, and the depth at which the outermost open loop began.  A loop
# stays open until the depth falls below the one it began at.  Later loops begin at
# least as deep, so they end no later than the outermost one and only that one has to
# be remembered.
_BASE = "coalesce(s.base, CASE WHEN m.start THEN s.depth END)"
_KEPT = f"CASE WHEN s.depth + m.low >= {_BASE} THEN {_BASE} END"
JAVA_WALK = Walk(
    "struct<depth:int,base:int>",
    "named_struct('depth', 0, 'base', CAST(NULL AS INT))",
    f"named_struct('depth', s.depth + m.delta, 'base', {_KEPT})",
    f"({_KEPT}) IS NOT NULL",
)

WALKS = {JAVASCRIPT: JS_WALK, JAVA: JAVA_WALK}


def walk_states(marks: str, walk: Walk, initial: str | None = None) -> str:
    """SQL of the state after the last mark."""
    return f"aggregate({marks}, {initial or walk.initial}, (s, m) -> {walk.after})"


def walk_values(
    marks: str, walk: Walk, value: str | None = None, value_type: str = "boolean", initial: str | None = None
) -> Column:
    """One value per mark of an array column, by default whether it is inside a loop.

    ``aggregate`` copies its whole accumulator at every step, so values are never
    gathered over the full length: the state entering each chunk is found first, then
    every chunk is walked on its own.  Cost stays near linear for the longest files.
    """
    none = f"CAST(array() AS array<{value_type}>)"
    chunks = (
        f"transform(sequence(0, CAST(floor((size({marks}) - 1) / {CHUNK}) AS INT)), "
        f"k -> slice({marks}, k * {CHUNK} + 1, {CHUNK}))"
    )
    entering = (
        "aggregate(slice(cs, 1, size(cs) - 1), "
        f"named_struct('state', {initial or walk.initial}, 'seen', CAST(array() AS array<{walk.state_type}>)), "
        f"(acc, chunk) -> named_struct('state', {walk_states('chunk', walk, 'acc.state')}, "
        "'seen', concat(acc.seen, array(acc.state))), acc -> concat(acc.seen, array(acc.state)))"
    )
    # the state is rebound as s so that the walk's SQL reads the same everywhere
    run = (
        f"aggregate(chunk, named_struct('s', entry, 'out', {none}), (acc, m) -> "
        f"transform(array(acc.s), s -> named_struct('s', {walk.after}, "
        f"'out', concat(acc.out, array({value or walk.inside}))))[0], acc -> acc.out)"
    )
    return F.expr(
        f"CASE WHEN size({marks}) > 0 THEN transform(array({chunks}), "
        f"cs -> flatten(zip_with(cs, {entering}, (chunk, entry) -> {run})))[0] ELSE {none} END"
    )


def mark_lines(numbered: str, language: str) -> Column:
    """Marks of an array column of numbered lines."""
    return F.expr(f"transform({numbered}, l -> {line_mark('l.text', 'l.low', language)})")


def has_start(marks: str) -> Column:
    return F.expr(f"exists({marks}, m -> CAST(m.start AS BOOLEAN))")


def in_loop_flags(marks: str, language: str) -> Column:
    """Array of booleans, one per mark of an array column."""
    return walk_values(marks, WALKS[language])
