"""Secret scan: fixed patterns, and a randomness test battery for all other long tokens.

Every run of 16 or more token characters gets the smallest encoding whose alphabet holds it
(hexadecimal, base 32, lower-case or mixed letters and digits, base 64 with either pair of marks).
Three tests ask whether its characters were drawn evenly and independently from that alphabet:
chi-squared over the alphabet, over all symbols and over cells that expect five characters; the
number of runs in either half of the alphabet, which is binomial; and the serial correlation of
neighbours.  The least of their probabilities, corrected for their number, must not be below
RANDOM_BELOW.

A token that passes may still be ordinary text, the more easily the shorter it is.  Its ordinary
probability is that of a token of its length and encoding, with characters as the short tokens
of all texts have them, to have as few equal pairs of characters.  Over all distinct tokens of the
corpus these probabilities go through Benjamini and Hochberg's step-up rule, so the share of
ordinary tokens among the reported ones is held at FALSE_SHARE, and a short token needs a corpus
with few like it.

Texts are read once, by the tasks that hold them.  What moves are digests of tokens, one row each;
to the driver come 256 counts of characters and the counts of at most 1,200 steps of probability.

Defined cases: a null or empty text has no spans; spans count code points, ends exclusive;
a very long text is scanned whole; digits alone, or characters of no one encoding, are never
random; a token that touches a span of a pattern is not reported again; repeated rows have their
spans each, but equal tokens count once for the false-discovery control; an empty table gives no
rows; other columns are ignored whatever their names.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from loopledger.llm.shared import workspace, written

LEAST, RANDOM_BELOW, FALSE_SHARE = 16, 0.001, 0.05
#: Order of kinds at one start; the first three are fixed patterns.
KINDS = ("assign", "access", "hex", "random")
STEPS, STEP = 1200, 0.05

_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

_DIGITS, _LOWER = "0123456789", "abcdefghijklmnopqrstuvwxyz"
_UPPER = _LOWER.upper()
#: Encodings by the size of their alphabets; the first that holds a token is taken.
ENCODINGS = {
    "hex": _DIGITS + _LOWER[:6],
    "HEX": _DIGITS + _UPPER[:6],
    "base32": "234567" + _UPPER,
    "base36": _DIGITS + _LOWER,
    "base62": _DIGITS + _LOWER + _UPPER,
    "base64": _DIGITS + _LOWER + _UPPER + "+/",
    "base64url": _DIGITS + _LOWER + _UPPER + "-_",
}
_SETS = {name: frozenset(alphabet.encode()) for name, alphabet in ENCODINGS.items()}
_IN_TOKEN = np.zeros(256, bool)
_IN_TOKEN[list((_DIGITS + _LOWER + _UPPER + "+/-_=").encode())] = True  # "=" only pads


def fixed_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the patterns, in order."""
    found = []
    low = text.lower() if "=" in text or ":" in text else ""
    if any(k in low for k in _KEYWORDS):
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


def encoding(token: bytes) -> str | None:
    chars = set(token)
    if chars <= _SETS["hex"] and chars <= _SETS["HEX"]:
        return None  # digits alone
    return next((name for name, alphabet in _SETS.items() if chars <= alphabet), None)


def _normal(z: float) -> float:
    """Upper tail of the normal distribution."""
    return 0.5 * math.erfc(z / math.sqrt(2))


def _chi_squared(x: float, df: int) -> float:
    """Upper tail, by the cube-root approximation."""
    return _normal(((x / df) ** (1 / 3) - 1 + 2 / (9 * df)) / math.sqrt(2 / (9 * df)))


def _binomial(k: int, n: int, p: float = 0.5) -> float:
    """P(at least k of n)."""
    if p <= 0 or p >= 1:
        return float(k <= (n if p >= 1 else 0))
    log = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)
           for i in range(k, n + 1)] if n <= 2000 else []
    if n > 2000:
        return _normal((k - 0.5 - n * p) / math.sqrt(n * p * (1 - p)))
    return min(1.0, math.fsum(map(math.exp, log)))


def battery(token: bytes, alphabet: str) -> dict[str, float]:
    """Probabilities of the tests under even and independent characters."""
    size, n = len(alphabet), len(token)
    place = np.zeros(256, np.int64)
    place[list(alphabet.encode())] = np.arange(size)
    at = place[np.frombuffer(token, np.uint8)]
    counts = np.bincount(at, minlength=size)
    chi = float((counts.astype(float) ** 2).sum()) * size / n - n
    cells = max(2, min(size, n // 5))
    edges = np.arange(cells + 1) * size // cells
    pooled, expected = np.add.reduceat(counts, edges[:-1]), np.diff(edges) * (n / size)
    runs = int((np.diff(at >= size // 2) != 0).sum())
    x = at - (size - 1) / 2
    correlation = float((x[1:] * x[:-1]).sum()) / ((size * size - 1) / 12) / math.sqrt(n - 1)
    return {
        "symbols": _chi_squared(max(chi, 1e-9), size - 1),
        "cells": _chi_squared(max(float(((pooled - expected) ** 2 / expected).sum()), 1e-9), cells - 1),
        "runs": min(1.0, 2 * min(_binomial(runs, n - 1), _binomial(n - 1 - runs, n - 1))),
        "serial": 2 * _normal(abs(correlation)),
    }


def looks_random(token: bytes, alphabet: str) -> bool:
    p = battery(token, alphabet)
    return 1 - (1 - min(p.values())) ** len(p) >= RANDOM_BELOW


def equal_pairs(token: bytes) -> int:
    counts = np.bincount(np.frombuffer(token, np.uint8))
    return int((counts * (counts - 1)).sum()) // 2


def ordinary(n: int, alphabet: str, equal: int, characters: np.ndarray) -> float:
    """Probability of so few equal pairs among n characters drawn by the given counts."""
    own, other = list(alphabet.encode()), list(alphabet.swapcase().encode())
    q = characters[own] + 1.0
    if set(own) & set(other) <= set(_DIGITS.encode()):  # letters of one case are as frequent as those of either case
        q += np.where(np.array(own) != np.array(other), characters[other], 0)
    q /= q.sum()
    s2, s3 = float((q**2).sum()), float((q**3).sum())
    pairs = n * (n - 1) / 2
    spread = math.sqrt(pairs * (s2 - s2 * s2) + n * (n - 1) * (n - 2) * max(s3 - s2 * s2, 0.0))
    return _normal((pairs * s2 - equal - 0.5) / spread)


class Tokens:
    """Runs of token characters of texts; counts what the short ones are made of."""

    def __init__(self) -> None:
        self.characters = np.zeros(256, np.int64)

    def long_ones(self, text: str) -> list[tuple[int, int, bytes]]:
        """(start, end, token) in code points, padding cut off."""
        data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
        inside = np.concatenate(([False], _IN_TOKEN[data], [False]))
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        starts, ends = edge[::2], edge[1::2]
        long_ = ends - starts >= LEAST
        self.characters += np.bincount(data, minlength=256)
        if not long_.any():
            return []
        raw = data.tobytes()
        shift = None if text.isascii() else np.concatenate(([0], np.cumsum((data & 0xC0) == 0x80)))
        out = []
        for a, b in zip(starts[long_].tolist(), ends[long_].tolist()):
            token = raw[a:b]
            self.characters -= np.bincount(data[a:b], minlength=256)
            a, b = a + len(token) - len(token.lstrip(b"=")), b - (len(token) - len(token.rstrip(b"=")))
            if b - a >= LEAST:
                move = (0, 0) if shift is None else (int(shift[a]), int(shift[b]))
                out.append((a - move[0], b - move[1], raw[a:b]))
        return out


_SPAN = "array<struct<start:int,kind:int,end:int>>"
_TOKEN = "array<struct<start:int,end:int,id:binary,code:int,equal:bigint,passed:boolean>>"
_WEIGHED = "array<struct<start:int,kind:int,end:int,id:binary,step:int>>"
_NAMES = list(ENCODINGS)


def found(docs: DataFrame, name: str, text: str) -> DataFrame:
    """(name, fixed, tokens, stats): spans of patterns and traits of long tokens; stats in a row of its own for each task."""
    kind = docs.schema[name].dataType.simpleString()
    schema = f"name {kind}, fixed {_SPAN}, tokens {_TOKEN}, stats array<long>"
    fields = to_arrow_schema(docs.sparkSession.createDataFrame([], schema).schema)

    def tested(tokens: list[tuple[int, int, bytes]], spans: list[tuple[int, int, int]]) -> list[tuple]:
        out = []
        for a, b, token in tokens:
            code = encoding(token)
            if code and not any(a < e and s < b for s, _, e in spans):
                passed = looks_random(token, ENCODINGS[code])
                out.append((a, b, hashlib.md5(token).digest(), _NAMES.index(code), equal_pairs(token), passed))
        return out

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Tokens()
        for batch in batches:
            rows = []
            for key, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                spans = fixed_spans(t) if t else []
                rows.append((key, spans, tested(seen.long_ones(t), spans) if t else [], None))
            yield _batch(rows, fields)
        yield _batch([(None, None, None, seen.characters.tolist())], fields)

    return docs.select(F.col(name).alias("name"), F.col(text).alias("text")).mapInArrow(scan, schema)


def _batch(rows: list[tuple], fields: pa.Schema) -> pa.RecordBatch:
    def shaped(value, kind):
        names = [f.name for f in kind.value_type] if pa.types.is_list(kind) and pa.types.is_struct(kind.value_type) else None
        return [None if v is None else [dict(zip(names, x)) for x in v] for v in value] if names else value

    columns = list(zip(*rows)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(shaped(c, f.type), f.type) for c, f in zip(columns, fields)], schema=fields)


def weighed(table: DataFrame, characters: np.ndarray) -> DataFrame:
    """(name, fixed, tokens): every token with the step of its ordinary probability, 0 if it does not look random."""
    schema = table.select("name", "fixed").schema.add("tokens", table.sparkSession.createDataFrame(
        [], f"t {_WEIGHED}").schema["t"].dataType)
    fields = to_arrow_schema(schema)
    random_ = KINDS.index("random")

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for tokens in batch.column("tokens").to_pylist():
                row = []
                for t in tokens:
                    p = ordinary(t["end"] - t["start"], ENCODINGS[_NAMES[t["code"]]], t["equal"],
                                 characters) if t["passed"] else 1.0
                    step = min(int(-math.log(max(p, 1e-300)) / STEP), STEPS - 1) if p < 1 else 0
                    row.append((t["start"], random_, t["end"], t["id"], step))
                out.append((row,))
            tokens = _batch(out, pa.schema([fields.field("tokens")])).column(0)
            yield pa.RecordBatch.from_arrays([batch.column("name"), batch.column("fixed"), tokens], schema=fields)

    return table.where("stats IS NULL").select("name", "fixed", "tokens").mapInArrow(weigh, schema)


def least_step(steps: dict[int, int], share: float = FALSE_SHARE) -> int:
    """The smallest step from which on tokens are reported: Benjamini and Hochberg's rule on counts by step."""
    total, above, least = sum(steps.values()), 0, STEPS
    for s in sorted(steps, reverse=True):
        above += steps[s]
        if s and total * math.exp(-s * STEP) <= share * above:
            least = s
    return least


def secret_spans(docs: DataFrame, name: str = "doc_id", text: str = "text", share: float = FALSE_SHARE) -> DataFrame:
    """(name, spans): for every row its spans by start and kind, as structs of start, kind, end."""
    table = written(found(docs, name, text), workspace(docs.sparkSession, "secrets"))
    characters = np.zeros(256, np.int64)
    for r in table.where("stats IS NOT NULL").select(F.posexplode("stats")).groupBy("pos").agg(F.sum("col").alias("n")).collect():
        characters[r.pos] = r.n
    rows = weighed(table, characters)
    steps = rows.select(F.explode("tokens").alias("t")).select("t.id", "t.step").distinct().groupBy("step").count().collect()
    least = least_step({r.step: r["count"] for r in steps}, share)
    random_ = F.transform(F.filter("tokens", lambda t: t["step"] >= least), lambda t: F.struct(t["start"], t["kind"], t["end"]))
    return rows.select(F.col("name").alias(name), F.sort_array(F.concat("fixed", random_.cast(_SPAN))).alias("spans"))


def as_text(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
