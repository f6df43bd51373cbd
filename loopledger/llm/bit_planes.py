"""Centroid clustering on bit planes: exact integer k-means with AND and popcount.

Components become integers in two's complement, and bit b of all 64 components of a vector is
packed into one unsigned 64-bit word, its plane b.  A dot product is the sum over all pairs of
planes of 2^(b+c) * popcount(plane b AND centroid's plane c), where the sign plane of either side
counts negatively; squared distances follow from three dot products.  All of it is exact.

The planes are written once (8 bytes for each bit of the widest component) and read in every
round.  A task sends the sums and counts of its clusters alone, so neither vectors nor a cluster
that holds a third of them are shuffled; the driver sees clusters x 64 sums a round.

Defined cases: a vector is kept if it has 64 components, none of them null or not finite; equal
names and repeated rows are vectors of their own; ties go to the smaller cluster, ties between
seeds to the lesser planes; a null name has no seed order and comes last; fewer vectors than
clusters make fewer clusters; no vector kept gives no rows; a cluster without vectors keeps its
centroid; components over 28 bits are refused, as their distances do not fit a long; other
columns are ignored whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from loopledger.llm.shared import workspace, written

COMPONENTS, CLUSTERS, ROUNDS, SCALE = 64, 40, 5, 256
WIDEST = 28
#: Vectors whose pairs of planes are counted together, so that the words stay in the cache.
TOGETHER = 512


def seed_order(name: Column) -> Column:
    return F.sha2(F.concat(F.lit("2:"), name.cast("string")), 256)


def packed(values: np.ndarray, width: int) -> np.ndarray:
    """Planes (n, width) of integers (n, 64)."""
    bits = (values[:, None, :] >> np.arange(width)[None, :, None]) & 1
    return np.packbits(bits.astype(np.uint8), axis=2, bitorder="little").view("<u8")[:, :, 0]


def unpacked(planes: np.ndarray) -> np.ndarray:
    """Integers (n, 64) of planes (n, width)."""
    n, width = planes.shape
    flat = np.ascontiguousarray(planes, "<u8").view(np.uint8).reshape(n, width, 8)
    bits = np.unpackbits(flat, axis=2, bitorder="little").astype(np.int64)
    return np.einsum("nbc,b->nc", bits, weights(width))


def weights(width: int) -> np.ndarray:
    """What a bit of each plane counts: the last one is the sign."""
    return np.array([1 << b for b in range(width - 1)] + [-(1 << (width - 1))], np.int64)


def dots(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Dot products of planes, by broadcasting over all but the last axis."""
    total = 0
    for b, u in enumerate(weights(x.shape[-1])):
        # the counts of one plane are weighted by the planes of the other side, then by its own weight
        part = 0
        for c, v in enumerate(weights(y.shape[-1])):
            part = part + np.bitwise_count(x[..., b] & y[..., c]) * v
        total = total + part * u
    return total


def nearest(planes: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cluster and squared distance of each vector; the smaller of equally near clusters."""
    own = dots(centroids, centroids)
    labels, distances = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for k in range(0, len(planes), TOGETHER):
        x = planes[k : k + TOGETHER]
        d = dots(x, x)[:, None] - 2 * dots(x[:, None, :], centroids[None, :, :]) + own[None, :]
        label = d.argmin(1)
        labels.append(label)
        distances.append(d[np.arange(len(x)), label])
    return np.concatenate(labels), np.concatenate(distances)


def kept(vectors: DataFrame, vector: str, name: str) -> DataFrame:
    """(name, values): integers of the vectors that count."""
    x, good = F.col(vector), lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    values = F.transform(x, lambda c: F.floor(F.lit(float(SCALE)) * c.cast("double")))
    return vectors.where((F.size(x) == COMPONENTS) & F.forall(x, lambda c: good(c.cast("double")))).select(
        F.col(name).alias("name"), values.alias("values"))


def _planes(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u8").reshape(-1, width)


def pack(values: DataFrame, width: int) -> DataFrame:
    """(name, planes) of (name, values)."""

    def pack_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column("values").flatten().to_numpy().reshape(-1, COMPONENTS)
            planes = [p.tobytes() for k in range(0, len(rows), TOGETHER) for p in packed(rows[k : k + TOGETHER], width)]
            yield pa.RecordBatch.from_arrays([batch.column("name"), pa.array(planes, pa.binary())], names=["name", "planes"])

    return values.mapInArrow(pack_, values.select("name").schema.add("planes", "binary"))


def moved(table: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Every centroid that has vectors replaced by the floor of their mean."""
    width, k = centroids.shape[1], len(centroids)
    schema = "cluster int, component int, total long, n long"
    fields = to_arrow_schema(table.sparkSession.createDataFrame([], schema).schema)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((k, COMPONENTS), np.int64), np.zeros(k, np.int64)
        for batch in (b for b in batches if b.num_rows):
            planes = _planes(batch.column("planes"), width)
            label, _ = nearest(planes, centroids)
            for s in range(0, len(planes), TOGETHER):
                np.add.at(total, label[s : s + TOGETHER], unpacked(planes[s : s + TOGETHER]))
            n += np.bincount(label, minlength=k)
        full = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([
            pa.array(np.repeat(full, COMPONENTS), pa.int32()), pa.array(np.tile(np.arange(COMPONENTS), len(full)), pa.int32()),
            pa.array(total[full].ravel(), pa.int64()), pa.array(np.repeat(n[full], COMPONENTS), pa.int64())], schema=fields)

    out = unpacked(centroids)
    found = table.select("planes").mapInArrow(sums, schema).groupBy("cluster", "component").agg(
        F.sum("total").alias("total"), F.sum("n").alias("n"))
    for r in found.collect():
        out[r.cluster, r.component] = r.total // r.n
    return packed(out, width)


def assigned(table: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(name, cluster, distance) of (name, planes)."""
    width = centroids.shape[1]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label, distance = nearest(_planes(batch.column("planes"), width), centroids)
            yield pa.RecordBatch.from_arrays(
                [batch.column("name"), pa.array(label, pa.int32()), pa.array(distance, pa.int64())],
                names=["name", "cluster", "distance"])

    return table.mapInArrow(assign, table.select("name").schema.add("cluster", "integer").add("distance", "long"))


def cluster(vectors: DataFrame, vector: str = "embedding", name: str = "vec_id", clusters: int = CLUSTERS,
            rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """Assignment (name, cluster, distance) of all vectors kept, and the final centroids (cluster, centroid)."""
    spark, folder = vectors.sparkSession, workspace(vectors.sparkSession, "planes")
    values = kept(vectors, vector, name)
    far = F.greatest(F.array_max("values"), -F.array_min("values") - 1)
    widest = values.agg(F.max(far)).first()[0]
    shape = values.select(F.col("name").alias(name)).schema.add("cluster", "integer").add("distance", "long")
    if widest is None:
        return spark.createDataFrame([], shape), spark.createDataFrame([], "cluster int, centroid array<long>")
    width = int(widest).bit_length() + 1
    if width > WIDEST:
        raise ValueError(f"components of {width} bits: their squared distances do not fit a long")
    table = written(pack(values, width), f"{folder}/planes")
    seeds = table.orderBy(F.asc_nulls_last(seed_order(F.col("name"))), "planes").limit(clusters).select("planes").collect()
    centroids = np.frombuffer(b"".join(r.planes for r in seeds), "<u8").reshape(-1, width)
    for _ in range(rounds):
        centroids = moved(table, centroids)
    out = assigned(table, centroids).withColumnRenamed("name", name)
    final = [(k, row) for k, row in enumerate(unpacked(centroids).tolist())]
    return out, spark.createDataFrame(final, "cluster int, centroid array<long>")


def with_inertia(vectors: DataFrame, **options) -> DataFrame:
    """Assignment with the inertia of each vector's cluster and of all, and a digest of its centroid."""
    rows, centroids = cluster(vectors, **options)
    rows = written(rows, workspace(vectors.sparkSession, "clusters"))
    per = {r.cluster: r.n for r in rows.groupBy("cluster").agg(F.sum("distance").alias("n")).collect()}
    digests = [(r.cluster, per.get(r.cluster, 0), hashlib.sha256(",".join(map(str, r.centroid)).encode()).hexdigest())
               for r in centroids.collect()]
    about = vectors.sparkSession.createDataFrame(digests, "cluster int, cluster_inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(about), "cluster").withColumn("inertia", F.lit(sum(per.values())).cast("long"))


def sql(vectors: str = "embeddings", clusters: int = CLUSTERS, rounds: int = ROUNDS) -> str:
    """The same in SQL."""
    square = "list_sum(list_transform(list_zip(k.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    steps = []
    for n in range(rounds + 1):
        steps.append(f"""a{n} AS MATERIALIZED (
  SELECT r, vec_id, CAST(m % 4096 AS INTEGER) AS cluster, CAST(m // 4096 AS BIGINT) AS distance, v FROM (
    SELECT k.r, any_value(k.vec_id) AS vec_id, any_value(k.v) AS v, min(CAST({square} AS HUGEINT) * 4096 + c.cluster) AS m
    FROM kept k CROSS JOIN c{n} c GROUP BY k.r))""")
        if n < rounds:
            steps.append(f"""c{n + 1} AS MATERIALIZED (
  SELECT c.cluster, coalesce(f.v, c.v) AS v FROM c{n} c LEFT JOIN (
    SELECT cluster, list(CAST((s - (s % n + n) % n) // n AS BIGINT) ORDER BY i) AS v FROM (
      SELECT cluster, i, sum(x) AS s, count(*) AS n FROM (
        SELECT cluster, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{n}) GROUP BY cluster, i)
    GROUP BY cluster) f USING (cluster))""")
    return f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id,
         list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM {vectors} WHERE len(embedding) = {COMPONENTS}
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {COMPONENTS}),
c0 AS MATERIALIZED (
  SELECT CAST(row_number() OVER (ORDER BY h, v) - 1 AS INTEGER) AS cluster, v FROM (
    SELECT sha256('2:' || CAST(vec_id AS VARCHAR)) AS h, v FROM kept ORDER BY h, v LIMIT {clusters})),
{",".join(steps)}
SELECT vec_id, cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
       CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} c USING (cluster)"""
