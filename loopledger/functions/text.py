"""Text helpers with the line, whitespace and regex conventions of Python strings."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as a line break and as white space in Python text.
LINE_BREAK = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029]"
UNUSUAL_BREAK = r"[\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029]"
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and only when reached, then use it in ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def sql_literal(value, map_keys: bool = False) -> str:
    """SQL text of plain Python data: lists are arrays, dicts structs (or a map)."""
    if isinstance(value, dict):
        kind = "map" if map_keys else "named_struct"
        return f"{kind}({', '.join(f'{sql_literal(k)}, {sql_literal(v)}' for k, v in value.items())})"
    if isinstance(value, (list, tuple)):
        return f"array({', '.join(map(sql_literal, value))})"
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    if value is None:
        return "CAST(NULL AS STRING)"
    return f"{value!r}D" if isinstance(value, float) else f"{value}L"


def split_lines(code: Column) -> Column:
    """Lines of a text without their breaks; a final break adds no empty line.

    Only texts with other breaks than a plain line feed pay for a regular expression.
    """
    unified = F.when(code.rlike(UNUSUAL_BREAK), F.regexp_replace(code, LINE_BREAK, "\n")).otherwise(code)
    return let(
        F.split(unified, "\n", -1),
        lambda parts: F.when(
            F.get(parts, F.size(parts) - 1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)
        ).otherwise(parts),
    )


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITESPACE))


def is_blank(text: Column) -> Column:
    return strip(text) == ""


def contains_any(text: Column, words: Iterable[str]) -> Column:
    test = F.lit(False)
    for word in words:
        test = test | text.contains(word)
    return test


# what Python counts as a word character: letters, all kinds of numbers, the underscore
WORD = r"[\p{L}\p{N}_]"
_CLASSES = {
    r"\s": r"[\s\x1F]", r"\w": WORD, r"\W": r"[^\p{L}\p{N}_]",
    r"\b": f"(?:(?<={WORD})(?!{WORD})|(?<!{WORD})(?={WORD}))",
    r"\B": f"(?:(?<={WORD})(?={WORD})|(?<!{WORD})(?!{WORD}))",
}


def regex(pattern: str) -> str:
    """Java form of a pattern: ignore case, Unicode classes, and Python's idea of white space and words."""
    return "(?iU)" + re.sub(r"\\.", lambda m: _CLASSES.get(m[0], m[0]), pattern, flags=re.S)


def any_of(patterns: Iterable[str]) -> str:
    return regex("|".join(f"(?:{p})" for p in patterns))


# pieces of a pattern; plain characters that nothing here tells apart come together
_LITERALS = re.compile(r"[A-Za-z0-9_@ ]+|\\.|\[\^?\]?(?:\\.|[^\]])*\]|.", re.S)
_ALTERNATIVES = re.compile(r"[^\\\[()|]+|\\.|\[\^?\]?(?:\\.|[^\]])*\]|.", re.S)


def required_texts(pattern: str) -> list[str]:
    """Literal pieces every match of ``pattern`` contains, in their ``searchable`` form.

    Conservative: groups and character classes count for nothing, and a pattern with
    a top-level alternative or an unusual escape yields no pieces.
    """
    runs, run, depth, in_count = [], "", 0, False
    for token in _LITERALS.findall(pattern):
        literal = ""
        if in_count:
            in_count = token != "}"
        elif token == "(":
            depth += 1
        elif token == ")":
            depth -= 1
        elif depth:
            continue
        elif len(token) > 1 and token[0] not in "\\[":
            run += token.lower()
            continue
        elif token == "|":
            return []
        elif token in ("*", "?", "{"):
            run, in_count = run[:-1], token == "{"
        elif token[0] == "\\" and token[1].isalnum():
            if token[1] not in "bBdDsSwW":
                return []
        elif token[0] == "\\":
            literal = token[1]
        elif token.isalnum() or token in "@_ ":
            literal = token
        if literal:
            for letter, plain in _SAME_LETTERS:
                literal = literal.replace(letter, plain)
            run += literal.lower()
        else:
            runs.append(run)
            run = ""
    return sorted({r for r in [*runs, run] if r}, key=len, reverse=True)


def branches(pattern: str) -> list[list[str]]:
    """Required pieces of every top-level alternative of a pattern; empty if one of them has none."""
    parts, depth = [""], 0
    for token in _ALTERNATIVES.findall(pattern):
        depth += (token == "(") - (token == ")")
        if token == "|" and not depth:
            parts.append("")
        else:
            parts[-1] += token
    found = [required_texts(p) for p in parts]
    return found if all(found) else []


_SAME_LETTERS = (("\u017f", "s"), ("\u0131", "i"), ("\u0130", "i"))


def searchable(text: Column) -> Column:
    """Lower case, with the letters that ignore-case search equates to i and s."""
    for letter, plain in _SAME_LETTERS:
        text = F.replace(text, F.lit(letter), F.lit(plain))
    return F.lower(text)


def may_find(text: str, *pattern_sets: Iterable[str]) -> str:
    """SQL of whether a text may hold a match of each set on some line, by plain substring tests.

    A pattern without a literal piece makes its set certain, so the answer is never wrong
    in the negative.
    """
    tests = []
    for patterns in pattern_sets:
        pieces = {tuple(required_texts(p)) for p in patterns}
        if () not in pieces:
            tests.append("(" + " OR ".join(
                "(" + " AND ".join(f"contains(low, {sql_literal(p)})" for p in one) + ")" for one in sorted(pieces)) + ")")
    if not tests:
        return "true"
    for letter, plain in _SAME_LETTERS:
        text = f"replace({text}, '{letter}', '{plain}')"
    return f"get(transform(array(lower({text})), low -> {' AND '.join(tests)}), 0)"


def finds(text: str, lowered: str, pattern: str) -> str:
    """SQL of an ignore-case search.  Plain substring tests on ``lowered`` (the
    ``searchable`` form) come first and settle nearly every line without running the
    regular expression."""
    tests = [f"contains({lowered}, {sql_literal(piece)})" for piece in required_texts(pattern)]
    return "(" + " AND ".join([*tests, f"rlike({text}, {sql_literal(regex(pattern))})"]) + ")"


def capitalize(text: Column) -> Column:
    """Upper-case the first letter, leave the rest."""
    return F.concat(F.upper(F.substring(text, 1, 1)), F.substr(text, F.lit(2)))


def clip(text: Column, limit: int = 80) -> Column:
    """Strip, and shorten a longer text to ``limit`` characters ending in dots."""
    return let(
        strip(text),
        lambda s: F.when(F.length(s) > limit, F.concat(F.substring(s, 1, limit - 3), F.lit("...")))
        .otherwise(s),
    )
