"""Toxicity by a weighted finite-state pattern grammar over clauses.

A lexicon maps words to symbols (insult with a weight, threat, target, negation, reported speech).
Five small transducers read a clause's symbols in step; their product tells in which arc an insult or
a threat stands: aimed at a target or not, negated or not, reported or not.  A threat counts only
where it meets a target.  What an arc weighs is fitted; isolated words are never scored, only what
stands in a clause.

All is learned from a bounded sample of labelled rows, which is written once: insults from the words
and word beginnings that mark toxic texts; threats from the words that mark toxic texts without an
insult in clauses with a target; negations, reports and targets from the words around insults that
change how often the text is toxic; arc weights by logistic regression about a prior, so arcs that
the sample does not show keep theirs.  Seeds and prior define the grammar without any labels.

Defined cases: null, empty and wordless texts have no clause and get the base score; equal texts and
repeated rows get equal scores; labels that are null or have no document are not learned from and
several labels of one document count as toxic if one does; copies in the sample count once; very
long texts are scanned whole; an empty table gives no rows and other columns pass through whatever
their names.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loopledger.llm.shared import workspace, written

#: Labelled rows that are learned from, at most; they bound the lexicon, too.
SAMPLE_ROWS = 20_000
THRESHOLD = 0.3
#: Texts that an entry must mark at least, and the share of them that must be toxic.
LEAST_TEXTS, LEAST_SHARE = 5, 0.9
STEMS = range(4, 9)
#: Entries that a task counts before it hands on what it has.
COUNTED_AT_ONCE = 100_000

# fixed values: seeds of the lexicon
INSULTS = ("bastard clown disgusting dumb filth fool garbage idiot imbecile loser moron pathetic scum stupid trash "
           "vermin worthless").split()
THREATS = "beat burn crush destroy hang hurt kill murder punch shoot stab strangle".split()
TARGETS = ("he her him she their them they these those u ur you your yourself "
           "du dich dir ihr sie tu toi vous ils usted ustedes ellos").split()
NEGATIONS = "cannot isn ne neither never nicht nie no non nor not pas wasn without".split()
REPORTS = "according alleged called claimed quoted reported said says sagte dijo dit wrote".split()
SEED_WEIGHT, THREAT_WEIGHT = 4.0, 3.0
#: Words before an insult that a negation reaches over, and how much a word must change the odds.
REACH, LEAST_CHANGE = 4, 3.0

_CLAUSE = re.compile(r"[^.!?;\n]+")
_BLANK = bytes(
    c if c >= 128 or chr(c).isalnum() else 32 for c in range(256)
)


def words_of(text: str) -> list[bytes]:
    """Lower-case words in UTF-8; everything in ASCII but letters and digits separates."""
    return text.lower().encode("utf-8", "replace").translate(_BLANK).split()


# symbols of the grammar
OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)


def _within(opens: int, words: int):
    """A transducer that says whether a symbol was read within the last words."""

    def step(state: int, symbol: int) -> tuple[int, bool]:
        state = words if symbol == opens else max(state - 1, 0)
        return state, state > 0

    return step


def _since(opens: int):
    """A transducer that says whether a symbol was read in this clause so far."""

    def step(state: int, symbol: int) -> tuple[int, bool]:
        state = state or int(symbol == opens)
        return state, bool(state)

    return step


#: Arcs: an insult or a threat, aimed at a target (4), negated (2), reported (1); threats are always aimed.
ARCS = [("insult", k) for k in range(8)] + [("threat", k) for k in range(4)]


def _prior() -> np.ndarray:
    """Base score, then what each arc weighs before anything is learned."""
    out = [-4.0]
    for kind, k in ARCS:
        out.append((2.5 if kind == "insult" else 2.6) * (1.2 if k & 4 else 1.0) * (0.25 if k & 2 else 1.0) * (0.5 if k & 1 else 1.0))
    return np.array(out)


class Grammar:
    """Product of the five transducers, built for the states that occur."""

    parts = {
        "insult": _within(INSULT, 1), "threat": _within(THREAT, 5), "target": _since(TARGET),
        "negated": _within(NEGATION, REACH), "reported": _since(REPORT),
    }

    def __init__(self, parts: dict | None = None) -> None:
        self.parts = parts or self.parts
        self._arcs: dict[tuple, tuple] = {}

    def _arc(self, state: tuple, symbol: int) -> tuple[tuple, int | None, bool]:
        """Next state, the arc of an insult or an aimed threat, whether a target was met."""
        read = [step(s, symbol) for step, s in zip(self.parts.values(), state)]
        on = {name: out for name, (_, out) in zip(self.parts, read)}
        context = 2 * on.get("negated", False) + on.get("reported", False)
        target = on.get("target", False)
        aimed = symbol == TARGET and on.get("threat", False) or symbol == THREAT and target
        arc = context if symbol == INSULT and on.get("insult") else 8 + context if aimed else None
        return tuple(s for s, _ in read), arc, target

    def read(self, symbols: list[int], weights: list[float]) -> dict[int, float]:
        """Weight in each arc of one clause."""
        state, found, aimed = (0,) * len(self.parts), {}, False
        for symbol, weight in zip(symbols, weights):
            step = self._arcs.get((state, symbol))
            if step is None:
                step = self._arcs[(state, symbol)] = self._arc(state, symbol)
            state, arc, aimed = step
            if arc is not None:
                found[arc] = found.get(arc, 0.0) + (weight if arc < 8 else THREAT_WEIGHT)
        return {(arc + 4 if aimed and arc < 4 else arc): x for arc, x in found.items()}


@dataclass
class Model:
    """Lexicon of whole words and of word beginnings, symbols of other words, and weights of the arcs."""

    words: dict[bytes, float] = field(default_factory=lambda: {w.encode(): SEED_WEIGHT for w in INSULTS})
    stems: dict[bytes, float] = field(default_factory=dict)
    learned: dict[bytes, int] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=_prior)

    def __post_init__(self) -> None:
        self.grammar = Grammar()
        self.symbols = {w.encode(): s for s, group in (
            (THREAT, THREATS), (TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS)) for w in group} | self.learned
        self.heads = {w[:4] for w in self.words} | {w[:4] for w in self.stems}
        self.threats = {w for w, s in self.symbols.items() if s == THREAT}

    def insult(self, word: bytes) -> float:
        best = self.words.get(word, 0.0)
        if word[:4] in self.heads:
            for n in STEMS:
                if n >= len(word):
                    break
                best = max(best, self.stems.get(word[:n], 0.0))
        return best

    def clauses(self, text: str | None) -> Iterator[tuple[list[bytes], list[int], list[float]]]:
        """Words, symbols and weights of the clauses of a text with an insult or a threat in it."""
        words, heads = set(words_of(text or "")), self.heads
        found = {w: self.insult(w) for w in words if w[:4] in heads}
        found = {w: x for w, x in found.items() if x}
        if not found and words.isdisjoint(self.threats):
            return
        for clause in _CLAUSE.finditer(text):
            read = words_of(clause[0])
            weights = [found.get(w, 0.0) for w in read]
            yield read, [INSULT if x else self.symbols.get(w, OTHER) for w, x in zip(read, weights)], weights

    def features(self, text: str | None) -> list[float]:
        """For each arc, the logarithm of all it holds."""
        total = [0.0] * len(ARCS)
        for _, symbols, weights in self.clauses(text):
            for arc, weight in self.grammar.read(symbols, weights).items():
                total[arc] += weight
        return [math.log1p(x) if x else 0.0 for x in total]

    def score(self, text: str | None) -> float:
        z = self.weights[0] + float(self.weights[1:] @ np.array(self.features(text)))
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def _around(text: str, model: Model) -> set[bytes]:
    """What a text shows of the words around its insults, or of clauses with a target if it has none: a letter, then the word."""
    out, insulted = set(), False
    for words, symbols, _ in model.clauses(text):
        places = [k for k, s in enumerate(symbols) if s == INSULT]
        insulted |= bool(places)
        for k in places:
            out.update(b"n" + w for w, s in zip(words[max(k - REACH, 0) : k], symbols[max(k - REACH, 0) : k]) if s == OTHER)
            out.update(b"r" + w for w, s in zip(words[: max(k - REACH, 0)], symbols) if s == OTHER)
        if places:
            out.update(b"t" + w for w, s in zip(words, symbols) if s == OTHER)
    if insulted:
        return out | {b"i"}
    for clause in _CLAUSE.finditer(text):
        words = words_of(clause[0])
        if any(model.symbols.get(w) == TARGET for w in words):
            out.update(b"h" + w for w in words if model.symbols.get(w, OTHER) == OTHER and len(w) > 3)
    return out | {b"c"}


def _entries(text: str) -> set[bytes]:
    """Whole words, and with a final star their beginnings."""
    words = {w for w in words_of(text) if 3 < len(w) <= 40}
    return words | {w[:n] + b"*" for w in words for n in STEMS if n < len(w)}


def _sample(docs: DataFrame, labels: DataFrame, held_out) -> DataFrame:
    """(text, toxic) of at most SAMPLE_ROWS labelled documents, chosen by a hash of the id; copies once."""
    chosen = (
        labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
        .where(~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_ROWS)
    )
    texts = docs.select("doc_id", "text").where("text IS NOT NULL")
    return (
        texts.join(F.broadcast(chosen), "doc_id")  # at most SAMPLE_ROWS pairs of numbers
        .groupBy(F.md5("text").alias("same")).agg(F.any_value("text").alias("text"), F.max("toxic").alias("toxic"))
        .select("text", "toxic")
    )


def _counted(sample: DataFrame, entries) -> DataFrame:
    """(entry, bad, seen): toxic texts and all texts of the sample that give each entry."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        bad: Counter = Counter()

        def so_far() -> pa.RecordBatch:
            keys = list(seen)
            columns = [pa.array(keys, pa.binary()), pa.array([bad[k] for k in keys], pa.int64()),
                       pa.array(list(seen.values()), pa.int64())]
            seen.clear()
            bad.clear()
            return pa.RecordBatch.from_arrays(columns, names=["entry", "bad", "seen"])

        for batch in batches:
            for text, toxic in zip(*(c.to_pylist() for c in batch.columns)):
                own = entries(text)
                seen.update(own)
                if toxic:
                    bad.update(own)
                if len(seen) > COUNTED_AT_ONCE:
                    yield so_far()
        yield so_far()

    counts = sample.mapInArrow(count, "entry binary, bad long, seen long")
    return counts.groupBy("entry").agg(F.sum("bad").alias("bad"), F.sum("seen").alias("seen"))


def _with_insults(sample: DataFrame) -> Model:
    """Words and beginnings that mark toxic texts."""
    total = F.col("entry") == F.lit(bytearray())
    kept = _counted(sample, lambda text: _entries(text) | {b""}).where(
        total | (F.col("bad") >= LEAST_TEXTS) & (F.col("bad") >= LEAST_SHARE * F.col("seen")))
    known = {bytes(r["entry"]): (r["bad"], r["seen"]) for r in kept.collect()}  # entries of five texts of the sample each
    bad, seen = known.pop(b"", (0, 0))
    words, stems = dict(Model().words), {}
    for entry, (b, s) in known.items():
        weight = float(np.log((b + 0.5) / (bad + 1)) - np.log((s - b + 0.5) / (seen - bad + 1)))
        if entry.endswith(b"*"):
            stems[entry[:-1]] = weight
        else:
            words[entry] = max(weight, words.get(entry, 0.0))
    return Model(words, stems)


def _with_context(sample: DataFrame, model: Model) -> Model:
    """Words around insults, and threats, that change how often a text is toxic."""
    counts = _counted(sample, lambda text: _around(text, model))
    whole = F.octet_length("entry") == 1
    rows = counts.where(whole | (F.greatest("bad", F.col("seen") - F.col("bad")) >= LEAST_TEXTS)).collect()
    known = {bytes(r["entry"]): (r["bad"], r["seen"] - r["bad"]) for r in rows}
    learned: dict[bytes, int] = {}
    for entry, (bad, good) in sorted(known.items()):
        kind, word = entry[:1], entry[1:]
        base_bad, base_good = known.get(b"c" if kind == b"h" else b"i", (0, 0))
        odds = (bad + 0.5) / (good + 0.5) / ((base_bad + 0.5) / (base_good + 0.5))
        if not word:
            continue
        if kind in b"nr" and good >= LEAST_TEXTS and odds * LEAST_CHANGE < 1:
            learned.setdefault(word, NEGATION if kind == b"n" else REPORT)
        elif kind in b"th" and bad >= LEAST_TEXTS and odds > LEAST_CHANGE and bad >= LEAST_SHARE * (bad + good):
            learned.setdefault(word, TARGET if kind == b"t" else THREAT)
    return Model(model.words, model.stems, learned)


def fit(docs: DataFrame, labels: DataFrame, held_out) -> Model:
    """Learn lexicon, symbols and arc weights.  held_out: column of doc_id -> column, rows that are not learned from."""
    sample = written(_sample(docs, labels, held_out), workspace(docs.sparkSession, "toxicity"))
    model = _with_context(sample, _with_insults(sample))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, toxic = (c.to_pylist() for c in batch.columns)
            got = [[round(x, 2) for x in model.features(t)] for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(got, pa.list_(pa.float64())), pa.array(toxic, pa.int32())],
                                             names=["arcs", "toxic"])

    measured = (
        sample.mapInArrow(measure, "arcs array<double>, toxic int").groupBy("arcs", "toxic").count()
        .orderBy("arcs", "toxic").collect()  # at most SAMPLE_ROWS rows
    )
    model.weights = _fitted(np.array([[1, *r["arcs"]] for r in measured], float).reshape(-1, 1 + len(ARCS)),
                            np.array([r["toxic"] for r in measured], float),
                            np.array([r["count"] for r in measured], float), model.weights)
    return model


def _fitted(x: np.ndarray, y: np.ndarray, n: np.ndarray, prior: np.ndarray, precision: float = 0.5) -> np.ndarray:
    """Logistic regression about a prior; no arc counts against toxicity."""
    b = prior.copy()
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        gradient = x.T @ (n * (y - p)) - precision * (b - prior)
        curvature = (x.T * (n * p * (1 - p))) @ x + precision * np.eye(len(b))
        step = np.linalg.solve(curvature, gradient)
        b += step / max(1.0, float(np.abs(step).max()) / 2)
        if np.abs(step).max() < 1e-8:
            break
    return np.concatenate([b[:1], np.maximum(b[1:], 0.05)])


def scorer(model: Model):
    """The score as a column function of a text column."""

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return pa.array([model.score(t) for t in texts.to_pylist()], pa.float64())

    return score


def toxicity_scores(spark: SparkSession, docs: DataFrame, labels: DataFrame, held_out) -> DataFrame:
    """docs with a score (0 to 1) and predicted (1 from THRESHOLD on), computed once a row."""
    score = scorer(fit(docs, labels, held_out))
    rest = [c for c in docs.columns if c.lower() not in ("score", "predicted")]
    return docs.select(*[F.col(f"`{c}`") for c in rest], score("text").alias("score")).withColumn(
        "predicted", (F.col("score") >= THRESHOLD).cast("int"))
