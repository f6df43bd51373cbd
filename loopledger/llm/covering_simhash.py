"""Near copies by SimHash fingerprints and covering locality-sensitive hashing.

A fingerprint has 64 bits from the hashes of word shingles.  Bit positions get random non-zero
codes of r + 1 bits; for each of the 2^(r+1) - 1 non-zero vectors, a mask keeps the positions
whose code has an odd product with it.  Any r positions leave at least one vector with even
products for all of them, so two fingerprints within r bits agree under at least one mask: no
pair within the radius is missed, by construction rather than with some probability.

Only distinct fingerprints are compared, and only those that share a masked value.  A bucket of
moderate size is compared in one task by blocks and gives the edges of a spanning forest, never
all pairs.  A larger bucket is not gathered: two of its members are within 4 bits exactly if
they share a midpoint within 2 bits of both, so every member is sent to its midpoints within
the free positions, and each midpoint, which few can share, links its members to the least.
Components are then contracted over edges between fingerprints and named by their least doc_id.

Defined cases: a null or wordless text has fingerprint zero and is linked like any other; fewer
words than a shingle make one shingle; rows with an equal fingerprint share a group, rows with an
equal doc_id only if their texts are near; a null doc_id takes part in its group but never names
it (a group of null ids alone is named null); an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loopledger.llm.components import components
from loopledger.llm.shared import by_key, discard, only_rows, workspace, written

RADIUS = 4
SEED = 42
#: Members of a bucket that one task compares; larger ones go by midpoints, with the same result.
LARGE_BUCKET = 20_000

_UPPER_TO_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def shingle_hashes(text: str | None, words_in_shingle: int, seed: int = SEED) -> np.ndarray:
    """Hashes of all word shingles of a whole text in order; none for a wordless one."""
    # ASCII white space only: the bytes 0x1c to 0x1f and non-ASCII blanks belong to words
    words = text.encode("utf-8", "replace").translate(_UPPER_TO_LOWER).split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    n = max(len(words) - words_in_shingle + 1, 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[: n - 1]])
    ends = ends[words_in_shingle - 1 :] - 1 if len(words) >= words_in_shingle else ends[-1:] - 1
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts.tolist(), ends.tolist())), "<u8", n)


def simhash(text: str | None, words_in_shingle: int = 4, seed: int = SEED) -> int:
    """Fingerprint of a whole text; a bit is set if more than half of the shingles set it."""
    hashes = shingle_hashes(text, words_in_shingle, seed)
    n = len(hashes)
    counts = np.zeros(64, np.int64)
    for k in range(0, n, 1 << 16):
        bits = np.unpackbits(hashes[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    set_bits = (2 * counts > n).astype(np.uint8)
    return int(np.packbits(set_bits, bitorder="little").view("<u8")[0])


def fingerprints(texts: Column) -> Column:
    """Fingerprint of a text column as a signed 64-bit integer."""

    @F.arrow_udf("long")
    def of(column: pa.Array) -> pa.Array:
        values = np.array([simhash(t) for t in column.to_pylist()], np.uint64)
        return pa.array(values.view(np.int64), pa.int64())

    return of(texts)


def masks(radius: int = RADIUS, seed: int = SEED) -> list[int]:
    """Covering masks as signed 64-bit integers."""
    codes = np.random.default_rng(seed).permutation(np.resize(np.arange(1, 1 << (radius + 1)), 64))
    out = []
    for vector in range(1, 1 << (radius + 1)):
        kept = [i for i, code in enumerate(codes.tolist()) if bin(code & vector).count("1") % 2]
        out.append(sum(1 << i for i in kept) - (1 << 64 if 63 in kept else 0))
    return out


def _forest(prints: np.ndarray, names: np.ndarray, radius: int, block: int = 512) -> list[tuple[int, int]]:
    """Edges (name, root name) that connect what is within the radius."""
    n = len(prints)
    root = np.arange(n)
    for a in range(0, n, block):
        for b in range(a, n, block):
            near = np.bitwise_count(prints[a : a + block, None] ^ prints[None, b : b + block]) <= radius
            apart = near & (root[a : a + block, None] != root[None, b : b + block])
            for i in np.flatnonzero(apart.any(axis=1)):
                found = root[b : b + block][near[i]]
                if (found != root[a + i]).any():
                    joined = np.unique(np.append(found, root[a + i]))
                    root[np.isin(root, joined)] = joined[0]
    return [(int(names[i]), int(names[r])) for i, r in enumerate(root) if i != r]


def links(prints: DataFrame, radius: int = RADIUS, large: int = LARGE_BUCKET, folder: str | None = None) -> DataFrame:
    """Edges (u, v) between the names of distinct fingerprints that connect all pairs within the radius.

    prints: (fp, name) with distinct fp and names that are never null.  Members of shared buckets are
    written to the folder, as small and large buckets are both made of them.
    """
    tables = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(m).cast("long").alias("mask"))
                       for k, m in enumerate(masks(radius))])
    keyed = prints.select("fp", "name", F.explode(tables).alias("t")).select(
        F.col("t.k").alias("k"), F.col("fp").bitwiseAND(F.col("t.mask")).alias("part"), "fp", "name")
    sizes = keyed.groupBy("k", "part").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    shared = written(keyed.join(by_key(sizes), ["k", "part"]), folder or workspace(prints.sparkSession, "shared"))

    def connect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            edges: list[tuple[int, int]] = []
            for members in batch.column(0).to_pylist():
                edges += _forest(np.array([m["fp"] for m in members], np.int64).view(np.uint64),
                                 np.array([m["name"] for m in members], np.int64), radius)
            yield pa.RecordBatch.from_arrays(
                [pa.array([e[k] for e in edges], pa.int64()) for k in (0, 1)], names=["u", "v"])

    small = (
        shared.where(F.col("members") <= large).groupBy("k", "part")
        .agg(F.collect_list(F.struct("fp", "name")).alias("bucket")).select("bucket")
        .mapInArrow(connect, "u long, v long")
    )
    return small.union(_by_midpoints(shared.where(F.col("members") > large), radius))


def _by_midpoints(members: DataFrame, radius: int) -> DataFrame:
    """Edges within large buckets (k, part, fp, name): all who share a midpoint are linked to the least.

    A midpoint differs from each in half the radius, and only in positions its mask leaves free.
    """
    half, all_masks = radius // 2, masks(radius)
    assert radius % 2 == 0, "midpoints need an even radius"
    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flips: dict[int, np.ndarray] = {}
        for batch in batches:
            columns = [np.asarray(batch.column(n), np.int64) for n in ("k", "fp", "name")]
            for k, fp, name in zip(*columns):
                if int(k) not in flips:
                    free = [1 << i for i in range(64) if not (all_masks[int(k)] >> i) & 1]
                    flips[int(k)] = np.array([sum(c) for n in range(half + 1) for c in combinations(free, n)], np.uint64)
                mids = (flips[int(k)] ^ np.uint64(int(fp) % (1 << 64))).view(np.int64)
                n = len(mids)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, k), pa.int64()), pa.array(mids, pa.int64()),
                     pa.array(np.full(n, name), pa.int64())], names=["k", "mid", "name"])

    folder = workspace(members.sparkSession, "midpoints")
    mids = written(members.select("k", "fp", "name").withColumn("k", F.col("k").cast("long")).mapInArrow(
        spread, "k long, mid long, name long"), folder)
    least = mids.groupBy("k", "mid").agg(F.min("name").alias("v"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return mids.join(by_key(least), ["k", "mid"]).where("name <> v").select(F.col("name").alias("u"), "v").distinct()


def _grouped(rows: DataFrame, folder: str, radius: int, large: int) -> DataFrame:
    """(fp, name, component) for the distinct fingerprints of (doc_id, fp) rows.

    name is the least doc_id with the fingerprint; the least fingerprint stands for a component, as ids
    may be null or repeated.
    """
    prints = written(rows.groupBy("fp").agg(F.min("doc_id").alias("name")), f"{folder}/prints")
    found = components(links(prints.select("fp", F.col("fp").alias("name")), radius, large, f"{folder}/shared"))
    discard(rows.sparkSession, f"{folder}/shared")
    return prints.join(by_key(found), prints["fp"] == found["node"], "left").select(
        "fp", "name", F.coalesce("component", "fp").alias("component"))


def near_groups(docs: DataFrame, radius: int = RADIUS, large: int = LARGE_BUCKET) -> DataFrame:
    """(doc_id, fp, component_id) for every row: groups of fingerprints linked within the radius."""
    folder = workspace(docs.sparkSession, "simhash")
    rows = written(docs.select("doc_id", fingerprints(F.col("text")).alias("fp")), f"{folder}/rows")
    groups = written(_grouped(rows, folder, radius, large), f"{folder}/groups")
    least = groups.groupBy("component").agg(F.min("name").alias("component_id"))
    return rows.join(by_key(groups.join(by_key(least), "component")), "fp").select("doc_id", "fp", "component_id")


def first_rows(rows: DataFrame, folder: str, radius: int = RADIUS, large: int = LARGE_BUCKET) -> DataFrame:
    """(at) of the row with the least doc_id of every group of (doc_id, at, fp); null ids come last, then the least at."""
    groups = _grouped(rows, folder, radius, large)
    # the first row of each fingerprint, so that a group is no larger than its distinct fingerprints
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "at")
    first = rows.groupBy("fp").agg(F.min(order).alias("best"))
    kept = first.join(by_key(groups), "fp").groupBy("component").agg(F.min("best").alias("best"))
    return kept.select(F.col("best.at").alias("at"))


def one_of_each_group(docs: DataFrame, radius: int = RADIUS, large: int = LARGE_BUCKET) -> DataFrame:
    """The row with the least doc_id of every group; of equal rows, and of a group of null ids, one."""
    folder = workspace(docs.sparkSession, "simhash")
    taken = {c.lower() for c in docs.columns}
    row = next(c for c in (f"row_{n}" for n in range(len(taken) + 1)) if c not in taken)
    # numbers follow the order of reading, so they are written with the rows before anything joins on them
    numbered = written(docs.withColumn(row, F.monotonically_increasing_id()), f"{folder}/numbered")
    rows = written(numbered.select("doc_id", F.col(row).alias("at"), fingerprints(F.col("text")).alias("fp")),
                   f"{folder}/rows")
    kept = first_rows(rows, folder, radius, large)
    return only_rows(numbered, row, kept).select(*docs.columns)


def as_hex(fp: Column) -> Column:
    """16 lower-case hexadecimal digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
