"""Near copies in two rules: linked fingerprints, then similarity of five-word shingles.

Fingerprints are linked within four bits by covering masks (covering_simhash), and one row of each
group stays.  Pairs with a shingle similarity of 0.8 differ in about ten bits, so of what stays
copies are also found by their shingles, a second method: the similarity of two texts is the share
of their distinct five-word shingles that both have.  96 minima over each text's shingles make 24
bands of 4; texts that share a band are candidates.  A pair at similarity 0.8 shares none with
probability (1 - 0.8^4)^24, about 3 in a million.

First each text meets the least of each of its buckets, and confirmed copies go.  Buckets of three or
more that still share texts then make families, by the components of texts and buckets.  A family
is compared in one task on bit rows of its shared shingles, and gives the edges of a spanning
forest, never all pairs; a family beyond FAMILY_ROWS or FAMILY_BYTES is dealt to blocks, and every
pair of blocks is compared in a task of its own.  Candidates of the first step whose minima agree
too seldom for the similarity (a loss below one in 30,000) are left out; all that is linked is
confirmed on whole sets of shingles.

Texts are read once, for fingerprints, minima and the row's number; sets are made of candidates only.
They are never shuffled: the numbers of the rows wanted are sent to where the texts are read.

Defined cases: words are those of the fingerprints; fewer words than a shingle make one shingle; null
and wordless texts have no shingle and are one group of fingerprints; the row with the least doc_id of
a group stays, null ids last, of equal ids and repeated rows the first read; of a chain of copies
several may stay, but no two of them are copies; a very long text has a longer set; an empty table
gives no rows; all columns pass, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructType

from loopledger.llm import covering_simhash
from loopledger.llm.components import components
from loopledger.llm.covering_simhash import shingle_hashes, simhash
from loopledger.llm.shared import by_key, discard, only_rows, small_batches, workspace, written

WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 24, 4
#: Share of equal minima below which a candidate is not compared.
LEAST_ESTIMATE = 0.625
#: Texts and bytes of shingles that one task compares.
FAMILY_ROWS, FAMILY_BYTES = 2048, 16_000_000
#: Candidates of one text from which on it is dealt to several tasks.
HUB, SALTS = 2_000, 64
SEED = 42

_FACTORS = np.random.default_rng(SEED).integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFT = np.uint64(29)


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of all shingles of a text."""
    return np.unique(shingle_hashes(text, WORDS, SEED))


def minima(shingles: np.ndarray) -> np.ndarray:
    """96 minima of a set of shingles that is not empty."""
    least = np.full(len(_FACTORS), np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(shingles), 1 << 12):
        mixed = shingles[k : k + (1 << 12), None] * _FACTORS
        mixed ^= mixed >> _SHIFT
        least = np.minimum(least, mixed.min(axis=0))
    return least


def bands(least: np.ndarray) -> list[int]:
    """One signed 64-bit key for each band."""
    rows = least.reshape(BANDS, ROWS)
    keys = np.array([xxhash.xxh64_intdigest(row.tobytes(), k) for k, row in enumerate(rows)], np.uint64)
    return keys.view(np.int64).tolist()


def _sketch(texts: Column) -> Column:
    """Fingerprint, number of distinct shingles, band keys and a byte of each minimum; no keys without a shingle."""

    @F.arrow_udf(StructType().add("fp", LongType()).add("n", LongType()).add("keys", ArrayType(LongType())).add("minima", BinaryType()))
    def of(column: pa.Array) -> pa.Array:
        rows = []
        for text in column.to_pylist():
            shingles, fp = shingle_set(text), simhash(text)
            row = {"fp": fp - (1 << 64 if fp >> 63 else 0), "n": len(shingles), "keys": None, "minima": None}
            if len(shingles):
                least = minima(shingles)
                row |= {"keys": bands(least), "minima": (least >> np.uint64(56) ^ least).astype(np.uint8).tobytes()}
            rows.append(row)
        return pa.array(rows, pa.struct([("fp", pa.int64()), ("n", pa.int64()), ("keys", pa.list_(pa.int64())), ("minima", pa.binary())]))

    return of(texts)


def _sets(texts: Column) -> Column:
    @F.arrow_udf(ArrayType(LongType()))
    def of(column: pa.Array) -> pa.Array:
        return pa.array([shingle_set(t).view(np.int64) for t in column.to_pylist()], pa.list_(pa.int64()))

    return of(texts)


def _agreeing(a: Column, b: Column) -> Column:
    """Whether enough minima of two texts agree."""

    @F.arrow_udf("boolean")
    def of(left: pa.Array, right: pa.Array) -> pa.Array:
        x, y = (np.frombuffer(b"".join(s.to_pylist()), np.uint8).reshape(-1, BANDS * ROWS) for s in (left, right))
        return pa.array((x == y).sum(axis=1) >= LEAST_ESTIMATE * BANDS * ROWS, pa.bool_())

    return of(a, b)


def _similar(a: Column, b: Column) -> Column:
    """Whether two sets of shingles have the least similarity."""

    @F.arrow_udf("boolean")
    def of(left: pa.Array, right: pa.Array) -> pa.Array:
        out = []
        for x, y in zip(left, right):
            x, y = x.values.to_numpy(), y.values.to_numpy()
            both = len(np.intersect1d(x, y, assume_unique=True))
            out.append(both >= SIMILARITY * (len(x) + len(y) - both))
        return pa.array(out, pa.bool_())

    return of(a, b)


def _met(pairs: DataFrame, values: DataFrame, end: str, value: str) -> DataFrame:
    """pairs with the value of one end; a text of many pairs is dealt to SALTS tasks."""
    hubs = pairs.groupBy(end).agg(F.count(F.lit(1)).alias("degree")).where(F.col("degree") > HUB).select(end, F.lit(True).alias("hub"))
    other = "v" if end == "u" else "u"
    salted = pairs.join(hubs, end, "left").withColumn("salt", F.when(F.col("hub"), F.pmod(F.xxhash64(other), F.lit(SALTS)).cast("int")).otherwise(0))
    side = values.select(F.col("at").alias(end), F.col(value).alias(f"of_{end}")).join(hubs, end, "left").withColumn(
        "salt", F.explode(F.when(F.col("hub"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    return salted.drop("hub").join(by_key(side.drop("hub")), [end, "salt"]).drop("salt")


def _confirmed(numbered: DataFrame, sketched: DataFrame, pairs: DataFrame, row: str, folder: str) -> DataFrame:
    """The (u, v) of the given pairs whose texts are similar."""
    near = _met(_met(pairs, sketched, "u", "minima"), sketched, "v", "minima")
    near = written(near.where(_agreeing(F.col("of_u"), F.col("of_v"))).select("u", "v"), f"{folder}-near")
    ends = near.select(F.explode(F.array("u", "v")).alias(row)).distinct()
    sets = written(_shingles(numbered, ends, row), f"{folder}-sets")
    edges = _met(_met(near, sets, "v", "shingles"), sets, "u", "shingles")
    return edges.where(_similar(F.col("of_u"), F.col("of_v"))).select("u", "v")


def _shingles(numbered: DataFrame, chosen: DataFrame, row: str) -> DataFrame:
    """(at, shingles) of the chosen rows."""
    return only_rows(numbered.select(row, "text"), row, chosen).select(
        F.col(row).alias("at"), _sets(F.col("text")).alias("shingles"))


def _surplus(edges: DataFrame, sketched: DataFrame, folder: str) -> DataFrame:
    """(at) of the rows that go: all but the least doc_id of each group of linked (u, v)."""
    linked = components(edges)
    members = written(linked.select(F.col("node").alias("at"), "component").union(
        linked.select(F.col("component").alias("at"), "component").distinct()), f"{folder}-members")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "at")
    least = members.join(by_key(sketched.select("at", "doc_id")), "at").groupBy("component").agg(F.min(order)["at"].alias("at"))
    return written(members.select("at").join(by_key(least), "at", "left_anti"), f"{folder}-surplus")


def _fit(a: str, b: str) -> Column:
    """Shares of shingles cannot reach the similarity if the sizes do not."""
    return F.least(a, b) >= SIMILARITY * F.greatest(a, b)


def shared_counts(sets: list[np.ndarray], words: int = 64, cells: int = 1 << 21) -> np.ndarray:
    """How many elements each two sets share, by popcounts of bit rows; elements of one set alone are left out."""
    m = len(sets)
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    _, place, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    common = times > 1
    column = np.cumsum(common) - 1
    kept = common[place]
    owner, column = owner[kept], column[place[kept]]
    by_column = np.argsort(column, kind="stable")
    owner, column = owner[by_column], column[by_column]
    out = np.zeros((m, m), np.int64)
    step = max(1, cells // (m * words))
    for first in range(0, int(common.sum()), 64 * words):
        a, b = np.searchsorted(column, [first, first + 64 * words])
        bits = np.zeros((m, 64 * words), bool)
        bits[owner[a:b], column[a:b] - first] = True
        rows = np.packbits(bits, axis=1).view(np.uint64)
        for k in range(0, m, step):
            out[k : k + step] += np.bitwise_count(rows[k : k + step, None, :] & rows[None, :, :]).sum(axis=2, dtype=np.int64)
    return out


def forest(names: list[int], sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Edges (name, name) that connect what is similar."""
    sizes, both = np.array([len(s) for s in sets]), shared_counts(sets)
    near = both >= SIMILARITY * (sizes[:, None] + sizes[None, :] - both)
    root = np.arange(len(names))
    while True:
        least = np.where(near, root[None, :], len(names)).min(axis=1)
        least = np.minimum(root, least)
        if (least == root).all():
            return [(names[i], names[r]) for i, r in enumerate(root.tolist()) if i != r]
        root = least


def _within_families(left: DataFrame, sets: DataFrame, rows: int, folder: str) -> DataFrame:
    """(u, v) edges between similar texts of (at, n, key), texts of one family of buckets; sets: (at, shingles)."""
    first = left.groupBy("key").agg(F.min("at").alias("v"), F.count(F.lit(1)).alias("members")).where("members > 1")
    linked = written(components(left.join(by_key(first), "key").select(F.col("at").alias("u"), "v")), f"{folder}-linked")
    of = linked.select(F.col("node").alias("at"), F.col("component").alias("family")).union(
        linked.select(F.col("component").alias("at"), F.col("component").alias("family")).distinct())
    members = written(of.join(by_key(left.select("at", "n").distinct()), "at"), f"{folder}-families")
    blocks = members.groupBy("family").agg(F.greatest(
        F.ceil(F.count(F.lit(1)) / rows), F.ceil(8 * F.sum("n") / FAMILY_BYTES)).cast("int").alias("blocks"))
    # few families are beyond a block, so these may be broadcast
    sized = members.join(blocks.where("blocks > 1"), "family", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = sized.withColumn("own", F.pmod(F.xxhash64("at"), F.col("blocks")).cast("int")).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pairs = dealt.select("at", "family", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            edges: list[tuple[int, int]] = []
            for group in batch.column(0):
                names, shingles = group.values.field("at").to_pylist(), group.values.field("shingles")
                edges += forest(names, [x.values.to_numpy() for x in shingles])
            yield pa.RecordBatch.from_arrays([pa.array([e[k] for e in edges], pa.int64()) for k in (0, 1)], names=["u", "v"])

    gathered = pairs.join(by_key(sets), "at").groupBy("family", "a", "b").agg(F.collect_list(F.struct("at", "shingles")).alias("texts"))
    return gathered.select("texts").mapInArrow(compare, "u long, v long")


def one_of_each_near_copy(docs: DataFrame, family_rows: int = FAMILY_ROWS) -> DataFrame:
    """docs without all but one row of every group of linked fingerprints, and of every group of similar texts."""
    spark, folder = docs.sparkSession, workspace(docs.sparkSession, "copies")
    small_batches(spark)
    taken = {c.lower() for c in docs.columns}
    row, sketch = (next(c for c in (f"{x}_{n}" for n in range(len(taken) + 1)) if c not in taken) for x in ("row", "sketch"))
    # numbers follow the order of reading, so they are written with the rows before anything joins on them
    numbered = written(docs.withColumns({row: F.monotonically_increasing_id(), sketch: _sketch(F.col("text"))}), f"{folder}/numbered")
    rows = numbered.select("doc_id", F.col(row).alias("at"), F.col(f"{sketch}.fp").alias("fp"))
    kept = written(covering_simhash.first_rows(rows, f"{folder}/groups"), f"{folder}/kept")
    narrow = numbered.select("doc_id", F.col(row).alias("at"), F.col(f"{sketch}.n").alias("n"),
                             F.col(f"{sketch}.keys").alias("keys"), F.col(f"{sketch}.minima").alias("minima"))
    sketched = written(narrow.where("n > 0").join(by_key(kept), "at", "left_semi"), f"{folder}/sketched")

    keyed = sketched.select("at", "n", F.explode("keys").alias("key"))
    buckets = keyed.groupBy("key").agg(F.min(F.struct("at", "n")).alias("least"), F.count(F.lit(1)).alias("members"))
    shared = written(keyed.join(by_key(buckets.where("members > 1")), "key"), f"{folder}/shared")
    stars = shared.where("at <> least.at").where(_fit("n", "least.n")).select(F.col("least.at").alias("u"), F.col("at").alias("v"))
    stars = written(stars.distinct(), f"{folder}/stars")
    gone = _surplus(_confirmed(numbered, sketched, stars, row, f"{folder}/stars"), sketched, f"{folder}/stars")
    left = written(shared.where("members > 2").join(by_key(gone), "at", "left_anti").select("key", "at", "n"), f"{folder}/left")
    sets = written(_shingles(numbered, left.select(F.col("at").alias(row)).distinct(), row), f"{folder}/sets")
    more = _surplus(_within_families(left, sets, family_rows, f"{folder}/left"), sketched, f"{folder}/families")
    gone = gone.union(more)
    stay = written(kept.join(by_key(gone), "at", "left_anti"), f"{folder}/stay")
    discard(spark, *(f"{folder}/{x}" for x in (
        "groups", "kept", "sketched", "shared", "stars", "stars-near", "stars-sets", "stars-members", "stars-surplus", "left",
        "left-linked", "left-families", "sets", "families-members", "families-surplus")))
    return only_rows(numbered, row, stay).select(*docs.columns)
