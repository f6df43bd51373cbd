"""Language identification: multinomial naive Bayes over hashed character n-grams.

Every character n-gram of a whole text, in lower case with runs of anything but letters as one
blank, is hashed to one of a fixed number of buckets.  Training counts buckets by language, adds
them up over all labelled rows, and turns them into matrices of log-probabilities for up to LANGUAGES
languages each: of bounded size, so one is sent to all tasks.  Scoring is a sparse product: the
matrix rows of a text's n-grams are added up, many texts at a time in numpy.  More languages than
one matrix holds are scored in one pass over the texts for each matrix, which carries on the best
language so far and the mass of all.

Defined cases: a null text, or one without a letter, is "und" with score 0; equal texts get equal
answers; with no labelled row at all every text is "und"; ties go to the first language in
order; texts of any length are read whole, in stretches of bounded size; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from loopledger.llm.shared import discard, workspace, written

BUCKETS = 1 << 15
ORDERS = (1, 2, 3)
#: Languages of one matrix, and count vectors that a task holds at once.
LANGUAGES = 256
UNKNOWN = "und"
SMOOTHING = 0.5
STRETCH = 1 << 20

_LETTERS = re.compile(r"[^\W\d_]+")


def grams(text: str) -> Iterator[np.ndarray]:
    """Buckets of all n-grams of a text, in stretches."""
    words = " ".join(_LETTERS.findall(text.lower()))
    if not any(map(str.isalpha, words)):
        return
    points = np.frombuffer(f" {words} ".encode("utf-32-le", "replace"), "<u4")
    for a in range(0, len(points), STRETCH):
        part = points[a : a + STRETCH + max(ORDERS) - 1].astype(np.uint64)
        room = min(len(part), STRETCH)
        key, found = np.zeros(len(part), np.uint64), []
        for n in ORDERS:
            if n > 1:
                key = key[:-1]
            if len(part) < n:
                break
            key = key * np.uint64(0x1F35_7AEA_2E62_A9C5) + part[n - 1 :] + np.uint64(n)
            found.append((key * np.uint64(0x9E37_79B9_7F4A_7C15) >> np.uint64(64 - 15))[:room])
        yield np.concatenate(found).astype(np.int64)


#: Best log-probability so far, its language, and the mass of all languages so far relative to it.
State = tuple[float, str, float]


def _merged(a: State | None, b: State | None) -> State | None:
    """Of two states over languages in order; none is a text without a letter."""
    if a is None or b is None:
        return a or b
    best = a if a[0] >= b[0] else b
    return best[0], best[1], float(a[2] * np.exp(a[0] - best[0]) + b[2] * np.exp(b[0] - best[0]))


def _answers(states: list[State | None]) -> tuple[list[str], list[float]]:
    return [s[1] if s else UNKNOWN for s in states], [1 / s[2] if s else 0.0 for s in states]


class Model:
    """Languages in order and their log-probabilities, one row for each bucket."""

    def __init__(self, languages: list[str], counts: np.ndarray, texts: np.ndarray, all_texts: float | None = None):
        self.languages = languages
        smooth = counts + SMOOTHING
        self.matrix = np.log(smooth / smooth.sum(axis=0)).astype(np.float32)
        self.prior = np.log((texts + 1) / (all_texts or (texts + 1).sum())) if languages else np.zeros(0)

    def states(self, texts: list[str | None]) -> list[State | None]:
        out: list[State | None] = []
        for text in texts:
            total, seen = self.prior.astype(np.float64), 0
            for buckets in grams(text or ""):
                times = np.bincount(buckets, minlength=0)
                present = np.flatnonzero(times)
                total = total + times[present] @ self.matrix[present].astype(np.float64)
                seen += len(buckets)
            if not seen or not self.languages:
                out.append(None)
                continue
            best = int(np.argmax(total))
            out.append((float(total[best]), self.languages[best], float(np.exp(total - total[best]).sum())))
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        return _answers(self.states(texts))


class Models:
    """More languages than one matrix holds: matrices that are loaded one after another."""

    def __init__(self, languages: list[str], size: int, load: Callable[[list[str]], Model]):
        self.languages, self._size, self._load = languages, size, load

    def __iter__(self) -> Iterator[Model]:
        for k in range(0, len(self.languages), self._size):
            yield self._load(self.languages[k : k + self._size])


def fit(labelled: DataFrame, languages: int = LANGUAGES) -> Model | Models:
    """Learn from (text, lang) rows; one matrix for every so many languages."""
    rows = labelled.where("lang IS NOT NULL AND text IS NOT NULL").select("text", "lang")
    texts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    names, all_texts = sorted(texts), float(sum(texts.values()) + len(texts))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}

        def counted() -> Iterator[pa.RecordBatch]:
            for lang, total in totals.items():
                present = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(present), pa.string()), pa.array(present, pa.int32()),
                     pa.array(total[present], pa.int64())], names=["lang", "bucket", "n"])
            totals.clear()

        for batch in batches:
            for text, lang in zip(*(c.to_pylist() for c in batch.columns)):
                if lang not in totals and len(totals) >= LANGUAGES:
                    yield from counted()
                total = totals.setdefault(lang, np.zeros(BUCKETS, np.int64))
                for buckets in grams(text):
                    own = np.bincount(buckets)
                    total[: len(own)] += own
        yield from counted()

    summed = rows.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))

    def load(some: list[str], table: DataFrame) -> Model:
        # one row for each language: as many vectors of BUCKETS numbers as a matrix has columns
        vectors = table.groupBy("lang").agg(F.collect_list(F.struct("bucket", "n")).alias("v")).toLocalIterator()
        counts, place = np.zeros((BUCKETS, len(some)), np.float64), {n: k for k, n in enumerate(some)}
        for r in vectors:
            at = np.array(r["v"], np.int64).reshape(-1, 2)
            counts[at[:, 0], place[r["lang"]]] = at[:, 1]
        return Model(some, counts, np.array([texts[n] for n in some], np.float64), all_texts)

    if len(names) <= languages:
        return load(names, summed)
    fixed = written(summed, workspace(labelled.sparkSession, "languages"))
    return Models(names, languages, lambda some: load(some, fixed.where(F.col("lang").isin(some))))


def predictor(model: Model):
    """Struct of lang_pred and score for a text column."""

    @F.arrow_udf(StructType().add("lang_pred", "string").add("score", "double"))
    def predict(texts: pa.Array) -> pa.Array:
        names, scores = model.predict(texts.to_pylist())
        return pa.StructArray.from_arrays(
            [pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["lang_pred", "score"])

    return predict


_STATE = StructType().add("best", "double").add("lang", "string").add("mass", "double")


def _carried(model: Model):
    """State after a text column and the state before."""

    @F.arrow_udf(_STATE)
    def carry(texts: pa.Array, before: pa.Array) -> pa.Array:
        known = [tuple(b.values()) if b and b["lang"] is not None else None for b in before.to_pylist()]
        after = [_merged(a, b) for a, b in zip(known, model.states(texts.to_pylist()))]
        return pa.array([dict(zip(("best", "lang", "mass"), s)) if s else None for s in after],
                        pa.struct([("best", pa.float64()), ("lang", pa.string()), ("mass", pa.float64())]))

    return carry


def identified(docs: DataFrame, model: Model | Models, text: Column) -> DataFrame:
    """docs with lang_pred and score; columns of these names are replaced."""
    rest = [c for c in docs.columns if c.lower() not in ("lang_pred", "score")]
    if isinstance(model, Model):
        found = docs.select(*[F.col(f"`{c}`") for c in rest], predictor(model)(text).alias("found_"))
        return found.select(*[F.col(f"`{c}`") for c in rest], "found_.lang_pred", "found_.score")
    own = F.struct(*[F.col(f"`{c}`") for c in rest]).alias("row")
    folder = workspace(docs.sparkSession, "identified")
    rows = docs.select(own, text.alias("text_"), F.lit(None).cast(_STATE).alias("state_"))
    # each pass is written, so a task holds one matrix
    for k, one in enumerate(model):
        rows = written(rows.select("row", "text_", _carried(one)("text_", "state_").alias("state_")), f"{folder}/{k}")
        if k:
            discard(docs.sparkSession, f"{folder}/{k - 1}")
    rows = rows.select("row", F.struct(
        F.coalesce("state_.lang", F.lit(UNKNOWN)).alias("lang_pred"),
        F.coalesce(1 / F.col("state_.mass"), F.lit(0.0)).alias("score")).alias("found_"))
    return rows.select(*[F.col(f"row.`{c}`").alias(c) for c in rest], "found_.lang_pred", "found_.score")
