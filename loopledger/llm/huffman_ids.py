"""Token ids in files: canonical, length-limited Huffman codes from global counts.

Files of a dataset (each a Parquet table, so that they live in any store Spark can write):

blocks  one row per independent block: part, block, start (ids before it in its part), documents
        (doc_id and number of ids), n (ids), payload (codes, highest bit first) and checkpoints
        (for every CHECKPOINT ids, how many bits they take, as unsigned 16-bit integers)
parts   one row per part: its ids and the ids of all parts before it
code    one row: the code length of every id; canonical codes follow from the lengths

A block holds whole documents, in ascending doc_id order over blocks and parts, and decodes with
the code alone.  Checkpoints let a reader start at any of them, and let all stretches of a block
decode side by side: one table look-up gives the next id of each.

Defined cases: a null or empty text is the end id alone; null doc_ids come first; equal doc_ids
and repeated rows are kept, ordered by their ids; a document longer than a block is a block of
its own; an id that never occurs has no code; an empty table makes empty files and no rows; other
columns are ignored.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from loopledger.llm.shared import END, discard, encoder, workspace, written

LONGEST_CODE = 20
BLOCK_IDS = 131_072
CHECKPOINT = 128


def code_lengths(counts: np.ndarray, longest: int = LONGEST_CODE) -> np.ndarray:
    """Lengths of an optimal code with no length over longest (package-merge); 0 where the count is 0."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    n = len(used)
    if n < 2:
        lengths[used] = 1
        return lengths
    longest = max(longest, int(n - 1).bit_length())
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.int64)
    packages, kinds = leaves[:0], []
    for _ in range(longest):
        both = np.concatenate([leaves, packages])
        by_weight = np.argsort(both, kind="stable")
        kinds.append(by_weight < n)
        row = both[by_weight]
        packages = row[: len(row) // 2 * 2].reshape(-1, 2).sum(axis=1)
    take, depth = 2 * n - 2, np.zeros(n, np.int64)
    for is_leaf in reversed(kinds):
        chosen = int(is_leaf[:take].sum())
        depth[:chosen] += 1
        take = 2 * (take - chosen)
    lengths[order] = depth
    return lengths


class Code:
    """Canonical codes for given lengths: shorter first, then by id."""

    def __init__(self, lengths: np.ndarray):
        self.lengths = lengths.astype(np.int64)
        ids = np.flatnonzero(lengths)
        ids = ids[np.lexsort((ids, lengths[ids]))]
        self.longest = int(lengths.max(initial=1))
        shares = np.int64(1) << (self.longest - self.lengths[ids])
        firsts = np.cumsum(shares) - shares
        self.codes = np.zeros(len(lengths), np.uint64)
        self.codes[ids] = (firsts >> (self.longest - self.lengths[ids])).astype(np.uint64)
        #: for the next bits, the id and the length of its code
        self.table = np.zeros(1 << self.longest, np.uint32)
        self.table[: shares.sum()] = np.repeat((ids << 5 | self.lengths[ids]).astype(np.uint32), shares)

    def encode(self, ids: np.ndarray) -> tuple[bytes, bytes]:
        """Payload and checkpoints."""
        if not len(ids):
            return b"", b""
        sizes, codes = self.lengths[ids], self.codes[ids]
        ends = np.cumsum(sizes)
        starts = ends - sizes
        word, left = starts >> 6, 64 - (starts & 63) - sizes
        fits = left >= 0
        here = np.where(fits, codes << np.maximum(left, 0).astype(np.uint64),
                        codes >> np.maximum(-left, 0).astype(np.uint64))
        out = np.zeros(int(ends[-1] >> 6) + 1, np.uint64)
        first = np.flatnonzero(np.diff(word, prepend=-1))
        out[word[first]] = np.bitwise_or.reduceat(here, first)
        over = np.flatnonzero(~fits)
        out[word[over] + 1] |= codes[over] << (64 + left[over]).astype(np.uint64)
        marks = np.append(starts[::CHECKPOINT], ends[-1])
        return out.byteswap().tobytes()[: (int(ends[-1]) + 7) // 8], np.diff(marks).astype("<u2").tobytes()

    def decode(self, payload: bytes, checkpoints: bytes, n: int, first: int = 0, last: int | None = None) -> np.ndarray:
        """Ids first to last (not included) of a block of n ids."""
        last = n if last is None else last
        if last <= first:
            return np.zeros(0, np.uint32)
        marks = np.cumsum(np.frombuffer(checkpoints, "<u2"), dtype=np.int64)
        marks = np.concatenate([[0], marks[:-1]])
        lane_from, lane_to = first // CHECKPOINT, (last - 1) // CHECKPOINT + 1
        at = marks[lane_from:lane_to].copy()
        short = n - CHECKPOINT * (len(marks) - 1) if lane_to == len(marks) else CHECKPOINT
        data = payload + b"\0" * 8
        windows = np.ndarray((len(data) - 3,), ">u4", data, strides=(1,))
        out = np.zeros((len(at), CHECKPOINT), np.uint32)
        shift, mask = 32 - self.longest, (1 << self.longest) - 1
        for step in range(CHECKPOINT):
            lanes = len(at) if step < short else len(at) - 1
            if not lanes:
                break
            place = at[:lanes]
            bits = windows[place >> 3].astype(np.int64) >> (shift - (place & 7)) & mask
            entry = self.table[bits]
            out[:lanes, step] = entry >> 5
            at[:lanes] += entry & 31
        base = lane_from * CHECKPOINT
        return out.reshape(-1)[first - base : last - base]


@functools.cache
def _code(lengths: bytes) -> Code:
    return Code(np.frombuffer(lengths, np.uint8))


def tokenized(docs: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """(doc_id, ids, width, counts): all ids of each whole text and the end id, as little-endian integers of `width` bytes.

    How often each id of the vocabulary occurs in a task stands in a row of its own, without ids.
    """
    kind = docs.schema["doc_id"].dataType
    arrow = to_arrow_type(kind)
    names = ["doc_id", "ids", "width", "counts"]

    def ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = encoder(tokenizer_path)
        end, total = np.asarray([END], of.kind).tobytes(), np.zeros(of.size, np.int64)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for k in range(0, len(texts), 256):
                data = [x + end for x in of.encode_many(texts[k : k + 256])]
                total += np.bincount(np.frombuffer(b"".join(data), of.kind), minlength=of.size)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(k, len(data)).cast(arrow), pa.array(data, pa.binary()),
                     pa.array(np.full(len(data), of.kind.itemsize, np.int32)), pa.nulls(len(data), pa.list_(pa.int64()))],
                    names=names)
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.nulls(1, arrow), pa.nulls(1, pa.binary()), pa.nulls(1, pa.int32()),
                                              pa.array([total], pa.list_(pa.int64()))], names=names)

    return docs.select("doc_id", "text").mapInArrow(
        ids, f"doc_id {kind.simpleString()}, ids binary, width int, counts array<long>")


def global_counts(tokens: DataFrame) -> np.ndarray:
    """How often each id occurs in all documents: one number for each id of the vocabulary."""
    rows = tokens.where("counts IS NOT NULL").select(F.posexplode("counts").alias("id", "n")).where("n > 0")
    got = rows.groupBy("id").agg(F.sum("n").alias("n")).collect()  # at most one row for each id of the vocabulary
    counts = np.zeros(max((r["id"] for r in got), default=0) + 1, np.int64)
    for r in got:
        counts[r["id"]] = r["n"]
    return counts


def write_ids(docs: DataFrame, path: str, tokenizer_path: str | None = None) -> None:
    """Tokenize, count, and write the three tables of the format under path."""
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType
    arrow = to_arrow_type(kind)
    plain = workspace(spark, "ids")
    tokens = written(tokenized(docs, tokenizer_path), plain, "snappy")  # ids hardly shrink
    lengths = code_lengths(global_counts(tokens)).tobytes()
    documents = pa.list_(pa.struct([("doc_id", arrow), ("n", pa.int64())]))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, part = _code(lengths), TaskContext.get().partitionId()
        held, names, sizes, block, start, width = [], [], [], 0, 0, 4

        def flush() -> pa.RecordBatch:
            nonlocal block, start
            joined = np.frombuffer(b"".join(held), f"<u{width}")
            payload, marks = code.encode(joined)
            own = pa.StructArray.from_arrays([pa.array(names, arrow), pa.array(sizes, pa.int64())], ["doc_id", "n"])
            own = pa.ListArray.from_arrays(pa.array([0, len(names)], pa.int32()), own)
            row = (part, block, start, own, len(joined), payload, marks)
            block, start = block + 1, start + len(joined)
            held.clear()
            names.clear()
            sizes.clear()
            kinds = (pa.int32(), pa.int32(), pa.int64(), documents, pa.int64(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays(
                [v if v is own else pa.array([v], k) for v, k in zip(row, kinds)],
                names=["part", "block", "start", "documents", "n", "payload", "checkpoints"])

        count = 0
        for batch in batches:
            for doc_id, data, width in zip(*(c.to_pylist() for c in batch.columns)):
                n = len(data) // width
                if held and count + n > BLOCK_IDS:
                    yield flush()
                    count = 0
                held.append(data)
                names.append(doc_id)
                sizes.append(n)
                count += n
        if held:
            yield flush()

    ids = tokens.where("ids IS NOT NULL").drop("counts")
    ordered = ids.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "ids")
    ordered.select("doc_id", "ids", "width").mapInArrow(
        pack, f"part int, block int, start long, documents array<struct<doc_id: {kind.simpleString()}, n: bigint>>, "
              "n long, payload binary, checkpoints binary").write.parquet(f"{path}/blocks")
    discard(spark, plain)
    parts = spark.read.parquet(f"{path}/blocks").groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect()
    before, rows = 0, []  # one row for each task that wrote
    for r in parts:
        rows.append((r["part"], r["n"], before))
        before += r["n"]
    spark.createDataFrame(rows, "part int, n long, before long").coalesce(1).write.parquet(f"{path}/parts")
    spark.createDataFrame([(bytearray(lengths),)], "lengths binary").coalesce(1).write.parquet(f"{path}/code")


def read_ids(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, ids): every document of a written dataset, ids as little-endian 32 bits.

    Without ids, all are decoded for the checksums but not handed on.
    """
    lengths = bytes(spark.read.parquet(f"{path}/code").first()["lengths"])
    parts = spark.read.parquet(f"{path}/parts").select("part", "before")
    blocks = spark.read.parquet(f"{path}/blocks")
    kind = blocks.schema["documents"].dataType.elementType["doc_id"].dataType
    arrow = to_arrow_type(kind)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = _code(lengths)
        for batch in batches:
            for documents, n, payload, marks, start in zip(batch.column(0), *(c.to_pylist() for c in batch.columns[1:])):
                data = memoryview(code.decode(payload, marks, n).astype("<u4").tobytes())
                sizes = documents.values.field("n").to_numpy()
                ends = np.cumsum(sizes)
                cut = [data[4 * a : 4 * b] for a, b in zip((ends - sizes).tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [documents.values.field("doc_id").cast(arrow), pa.array(start + ends - sizes, pa.int64()),
                     pa.array(sizes, pa.int64()), pa.array([zlib.crc32(x) for x in cut], pa.int64()),
                     pa.array([bytes(x) if with_ids else None for x in cut], pa.binary())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"])

    placed = blocks.join(F.broadcast(parts), "part").select(
        "documents", "n", "payload", "checkpoints", (F.col("start") + F.col("before")).alias("start"))
    return placed.mapInArrow(
        unpack, f"doc_id {kind.simpleString()}, start long, n_tokens long, ids_crc32 long, ids binary")
