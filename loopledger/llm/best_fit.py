"""Best-fit packing of tokenized documents into sequences of bounded length.

Bounded-space online best-fit: a task keeps a fixed number of open bins, found through a
bitset keyed by free space.  A piece goes to the open bin with the least free space that
holds it; when the number of open bins would be exceeded, the fullest closes first.

Only (document, length) rows move.  Pieces are dealt and ordered by hash, so that long and
short ones meet at any number of pieces a task; of every LOOK_AHEAD that arrive the longest
are placed first.  Every task packs its share alone and names its sequences after itself,
and its few open bins are all that a larger number of tasks can cost.

Defined cases: a null or empty text is the end id alone; pieces of equal length are placed in
order of arrival, and of equally full bins the one filled last takes a piece; a document longer than a sequence
is cut into full sequences after a first piece that holds the rest; repeated rows and equal
doc_ids are packed as rows of their own; an empty table gives no rows; other columns are
ignored whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from loopledger.llm.shared import END, encoder

CAPACITY = 2048
OPEN_BINS = 4096
#: Pieces that are ordered by length before they are placed; all of them may be more than half a sequence.
LOOK_AHEAD = 4096


class OpenBins:
    """Open bins by free space: a bitset of the sizes present and a stack of bins for each."""

    def __init__(self, capacity: int, limit: int):
        self.capacity, self.limit = capacity, limit
        self.present, self.count, self.made = 0, 0, 0
        self.by_free: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _lowest(self, at_least: int) -> int:
        """The smallest free space present that is at_least so large, or -1."""
        rest = self.present >> at_least
        return at_least + (rest & -rest).bit_length() - 1 if rest else -1

    def _take(self, free: int) -> int:
        bins = self.by_free[free]
        found = bins.pop()
        if not bins:
            self.present ^= 1 << free
        self.count -= 1
        return found

    def place(self, length: int) -> tuple[int, int]:
        """Bin and offset for a piece."""
        free = self._lowest(length)
        if free < 0:
            if self.count >= self.limit:
                self._take(self._lowest(0))  # the fullest closes
            number, free = self.made, self.capacity
            self.made += 1
        else:
            number = self._take(free)
        left = free - length
        if left:
            self.by_free[left].append(number)
            self.present |= 1 << left
            self.count += 1
        return number, self.capacity - free


def pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizer_path: str | None = None) -> DataFrame:
    """One row for each piece of each document: doc_id, piece, start, length, ids_crc32."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, end = encoder(tokenizer_path), np.asarray([END], "<u4").tobytes()
        for batch in (b.slice(k, 512) for b in batches for k in range(0, b.num_rows, 512)):
            rows: list[tuple] = []
            for doc_id, data in zip(batch.column(0).to_pylist(), of.encode_many(batch.column(1).to_pylist())):
                data = memoryview(np.frombuffer(data, of.kind).astype("<u4").tobytes() + end)
                total = len(data) // 4
                bounds = [0, *range(total % capacity or capacity, total + 1, capacity)]
                rows += [
                    (doc_id, k, a, b - a, zlib.crc32(data[4 * a : 4 * b]))
                    for k, (a, b) in enumerate(zip(bounds, bounds[1:]))
                ]
            columns = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema
            )

    kind = docs.schema["doc_id"].dataType
    schema = pa.schema([("doc_id", to_arrow_type(kind)), ("piece", pa.int32()), ("start", pa.int64()),
                        ("length", pa.int64()), ("ids_crc32", pa.int64())])
    return docs.select("doc_id", "text").mapInArrow(
        cut, f"doc_id {kind.simpleString()}, piece int, start long, length long, ids_crc32 long"
    )


def pack(cut: DataFrame, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, tasks: int | None = None) -> DataFrame:
    """Add sequence_id and offset to rows that have a length of at most capacity."""

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins = OpenBins(capacity, open_bins)
        for batch in (b.slice(k, LOOK_AHEAD) for b in gathered(batches) for k in range(0, b.num_rows, LOOK_AHEAD)):
            lengths = batch.column("length").to_numpy()
            task = batch.column("task")[0].as_py()
            number, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
            for k in np.argsort(-lengths, kind="stable").tolist():
                number[k], offset[k] = bins.place(int(lengths[k]))
            keep = [f for f in batch.schema.names if f not in ("task", "order")]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(f) for f in keep), pa.array(task << 40 | number), pa.array(offset)],
                names=[*keep, "sequence_id", "offset"],
            )

    key = F.xxhash64("doc_id", "piece", "start", "ids_crc32")
    dealt = cut.withColumn("order", key)
    dealt = dealt.repartition("order") if tasks is None else dealt.repartition(tasks, "order")
    # the same rows in the same order if a task is run again
    ordered = dealt.withColumn("order", F.hash("order")).sortWithinPartitions("order", "doc_id", "piece", "ids_crc32")
    schema = cut.schema.add("sequence_id", "long").add("offset", "long")
    return ordered.withColumn("task", F.spark_partition_id().cast("long")).mapInArrow(fill, schema)


def gathered(batches: Iterator[pa.RecordBatch], least: int = LOOK_AHEAD) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at least so many, but for the last."""
    held, n = [], 0

    def together() -> pa.RecordBatch:
        return pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for batch in (b for b in batches if b.num_rows):
        held.append(batch)
        n += batch.num_rows
        if n >= least:
            yield together()
            held, n = [], 0
    if held:
        yield together()


def best_fit_sequences(docs: DataFrame, capacity: int = CAPACITY, open_bins: int = OPEN_BINS) -> DataFrame:
    """Pack all documents: one row per piece with its sequence and its offset there."""
    return pack(pieces(docs, capacity), capacity, open_bins)
