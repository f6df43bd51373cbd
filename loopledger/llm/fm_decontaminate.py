"""Benchmark decontamination: an FM-index for every shard of training documents.

A task cuts its documents into shards of bounded length, indexes each shard's words, searches
all benchmark windows backwards in it, locates their occurrences and merges them to spans for
removal.  Documents never move between tasks.  The benchmark is read in blocks of bounded size,
sent to all tasks as word numbers (4 bytes a word) and distinct words; its windows are places in
them and are looked up CHUNK at a time.  A larger benchmark makes further passes over the documents,
each written before the next, which add to the spans found so far.

Defined cases: a null, empty or wordless document has no words and no spans; items without words
have no window; a shorter item than a window is one window; windows that several items share
count for all of them; a document longer than a shard is indexed in overlapping parts; repeated
rows are searched each; an item with a null id is searched like any other but is not listed; empty
tables give clean documents or no rows; columns that clash with the added names are replaced, others
pass through.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from loopledger.llm.fm_index import FMIndex
from loopledger.llm.shared import workspace, written

WINDOW = 10
SHARD_WORDS = 250_000
#: Windows looked up together.
CHUNK = 50_000
#: Benchmark text searched in one pass, on average.
BLOCK_BYTES = 4_000_000
ADDED = ("n_words", "spans", "items")

# words are runs of ASCII letters and digits and of everything outside ASCII, in lower case
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
_WORD = re.compile(rb"[^ ]+")


def folded(text: str | None) -> bytes:
    """UTF-8 of a text in lower case (A to Z only), with a blank for every byte between words."""
    return (text or "").encode("utf-8", "replace").translate(_FOLD)


class Windows:
    """A block of benchmark items as word numbers, with the first word of every window by its length."""

    def __init__(self, items: list[tuple[str | None, str | None]], size: int = WINDOW):
        numbers: dict[bytes, int] = defaultdict()
        numbers.default_factory = numbers.__len__
        parts, starts = [], defaultdict(list)
        self.names, ends, at = [name for name, _ in items], [], 0
        for _, text in items:
            words = folded(text).split()
            part = np.fromiter(map(numbers.__getitem__, words), np.int32, len(words))
            windows = max(len(words) - size + 1, min(len(words), 1))
            if windows:
                starts[min(len(words), size)].append(at + np.arange(windows))
            parts.append(part)
            at += len(part)
            ends.append(at)
        self.words = np.concatenate(parts) if parts else np.zeros(0, np.int32)
        self.vocabulary, self.ends = list(numbers), np.array(ends, np.int64)
        self.starts = {n: np.concatenate(s).astype(np.int32) for n, s in starts.items()}
        self.longest = max(starts, default=1)

    def item(self, at: np.ndarray) -> list[str | None]:
        """Names of the items that hold these words."""
        return [self.names[k] for k in np.searchsorted(self.ends, at, "right").tolist()]


def _search(shard: list[tuple[int, int, list[bytes]]], windows: Windows) -> Iterator[tuple[int, int, int, str | None]]:
    """(document, first word, end word, item) of all occurrences.  shard: (document, place of first word, words)."""
    numbers: dict[bytes, int] = defaultdict()
    numbers.default_factory = numbers.__len__
    number = numbers.__getitem__
    texts = [np.fromiter(map(number, words), np.int64, len(words)) + 1 for _, _, words in shard]
    numbers.default_factory = None
    index = FMIndex(texts, len(numbers))
    known = np.array([numbers.get(w, -1) + 1 for w in windows.vocabulary], np.int64)
    here = known[windows.words] if len(known) else np.zeros(0, np.int64)
    for length, every in windows.starts.items():
        for k in range(0, len(every), CHUNK):
            starts = every[k : k + CHUNK]
            phrases = here[starts[:, None] + np.arange(length)]
            present = np.flatnonzero((phrases > 0).all(axis=1))
            if not len(present):
                continue
            low, high = index.search(phrases[present])
            times = high - low
            rows = np.repeat(low - np.concatenate([[0], np.cumsum(times)[:-1]]), times) + np.arange(times.sum())
            items = windows.item(starts[np.repeat(present, times)])
            places = index.locate(rows)
            part = np.searchsorted(index.starts, places, "right") - 1
            for p, at, item in zip(part.tolist(), (places - index.starts[part]).tolist(), items):
                document, base, _ = shard[p]
                yield document, base + at, base + at + length, item


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping and touching spans as one, in order."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _shards(texts: list[bytes], overlap: int) -> Iterator[tuple[list, list[int]]]:
    """Shards of the given documents, and the numbers of words seen so far."""
    shard, held, counts = [], 0, []
    for k, text in enumerate(texts):
        words = text.split()
        counts.append(len(words))
        for a in range(0, max(len(words) - overlap, 1), SHARD_WORDS):
            part = words[a : a + SHARD_WORDS + overlap] if len(words) > SHARD_WORDS else words
            if held and held + len(part) > SHARD_WORDS:
                yield shard, counts
                shard, held = [], 0
            shard.append((k, a, part))
            held += len(part)
    if shard:
        yield shard, counts


def _pass(docs: DataFrame, windows: Windows, text: str, first: bool, cut: bool) -> DataFrame:
    spec = docs.schema
    if first:
        docs = docs.select("*", F.lit(0).cast("long").alias("n_words"),
                           F.expr("CAST(array() AS array<struct<first: bigint, last: bigint>>)").alias("spans"),
                           F.expr("CAST(array() AS array<string>)").alias("items"))
        spec = docs.schema
    arrow = to_arrow_schema(spec)
    place = spec.names.index(text)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [folded(t) for t in batch.column(place).to_pylist()]
            spans = [[(s["first"], s["last"] + 1) for s in x] for x in batch.column(batch.num_columns - 2).to_pylist()]
            items = [set(x) for x in batch.column(batch.num_columns - 1).to_pylist()]
            counts: list[int] = []
            for shard, counts in _shards(texts, windows.longest - 1):
                for k, a, b, item in _search(shard, windows):
                    spans[k].append((a, b))
                    if item is not None:
                        items[k].add(item)
            whole = [merged(x) for x in spans]
            added = [
                pa.array(counts, pa.int64()),
                pa.array([[{"first": a, "last": b - 1} for a, b in x] for x in whole], arrow.field("spans").type),
                pa.array([sorted(x) for x in items], arrow.field("items").type),
            ]
            columns = batch.columns[: batch.num_columns - 3]
            if cut and any(whole):
                columns[place] = pa.array(
                    [without_spans(t, x) for t, x in zip(columns[place].to_pylist(), whole)], columns[place].type)
            yield pa.RecordBatch.from_arrays([*columns, *added], schema=arrow)

    return docs.mapInArrow(find, spec)


def contaminated_spans(docs: DataFrame, benchmark: DataFrame, text: str = "text", cut: bool = False) -> DataFrame:
    """docs with n_words, spans (first and last word of each stretch to remove) and items (sorted ids as strings).

    With cut, the stretches are gone from the text; all is done where the index is.
    """
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ADDED])
    folder = workspace(docs.sparkSession, "decontaminated")
    size = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = 1 + size // BLOCK_BYTES
    for block in range(blocks):
        part = benchmark.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        rows = part.select(F.col("item_id").cast("string"), "text").collect()
        docs = _pass(docs, Windows([(r[0], r[1]) for r in rows]), text, block == 0, cut and block == blocks - 1)
        if block < blocks - 1:
            docs = written(docs, f"{folder}/{block}")
    return docs


def without_spans(text: str | None, spans: list[tuple[int, int]]) -> str | None:
    """The text with a line feed in place of each stretch of words (first, end)."""
    if not spans or text is None:
        return text
    whole, words = text.encode("utf-8", "replace"), [(m.start(), m.end()) for m in _WORD.finditer(folded(text))]
    kept, at = [], 0
    for first, end in spans:
        kept.append(whole[at : words[first][0]])
        at = words[end - 1][1]
    return b"\n".join([*kept, whole[at:]]).decode("utf-8")


def remove_contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """docs with benchmark stretches cut out of the text, with spans and items beside it."""
    return contaminated_spans(docs, benchmark, text, cut=True)
