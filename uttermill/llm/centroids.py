"""Clustering of integer vectors around centroids, with distances by popcounts of bit planes.

Method: bit ``b`` of the 64 components of a vector, in two's complement, is packed into one
unsigned 64-bit number, the vector's plane ``b``.  A dot product is then the sum over pairs
of planes of ``weight * weight * popcount(plane AND plane)``, where a plane weighs 2**b and
the uppermost, which holds the signs, minus that; squared distances follow from dot products
and are exact integers.  A vector has as many planes as the widest of its batch needs;
repeating the uppermost one adds more without changing the value.

The planes are staged once (8 bytes a plane and vector); every round is one pass over them
that returns one row of sums per task and cluster, so nothing but k centroids and their
sums reaches the driver, and no row is shuffled.  The ``k`` starting vectors are those of
the smallest digest, whatever the size of the table.

Defined cases: a vector that is null, has not exactly 64 components, or has a null or
non-finite one, is left out.  A null id counts as an empty one in the digest and stays null.
Rows that repeat are vectors of their own; starting vectors of one digest are ordered by
their planes.  Fewer vectors than ``k`` make fewer centroids; an empty table gives an empty
result.  A scaled component of 2**27 or more ends the job with an error that says so, as
distances would no longer fit 64 bits.  Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.staging import stage
from .frames import named

COMPONENTS = 64
CLUSTERS, ROUNDS, SCALE, SEED = 16, 3, 64, "1"
MAX_BITS = 27  # of a component without its sign: (2 * 2**27)**2 * 64 is below 2**63
BLOCK = 1 << 13  # vectors that numpy handles at once


def to_planes(x: np.ndarray) -> np.ndarray:
    """Planes (plane, vector) of whole numbers (vector, component)."""
    top = int(max(x.max(initial=0), -1 - x.min(initial=0)))
    bits = [(x >> b & 1).astype(np.uint8) for b in range(top.bit_length() + 1)]
    packed = [np.packbits(b, axis=1, bitorder="little").reshape(-1).view("<u8") for b in bits]
    return np.stack(packed).astype(np.uint64)


def plane_weights(n: int) -> np.ndarray:
    weights = np.int64(1) << np.arange(n, dtype=np.int64)
    weights[-1] *= -1
    return weights


def to_components(planes: np.ndarray) -> np.ndarray:
    """The whole numbers (vector, component) of planes."""
    out = np.zeros((planes.shape[1], COMPONENTS), np.int64)
    for plane, weight in zip(planes, plane_weights(len(planes)).tolist()):
        octets = np.ascontiguousarray(plane, "<u8").view(np.uint8).reshape(-1, COMPONENTS // 8)
        out += weight * np.unpackbits(octets, axis=1, bitorder="little").astype(np.int64)
    return out


def dot(planes: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Dot products of vectors (plane, vector) with one vector (plane, 1) or with one each."""
    total = np.zeros(planes.shape[1], np.int64)
    weights = plane_weights(len(planes))[:, None]
    for plane, weight in zip(other, plane_weights(len(other)).tolist()):
        if plane.any():
            total += weight * (weights * np.bitwise_count(planes & plane)).sum(axis=0)
    return total


def distances(planes: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances (centroid, vector); ``centroids`` are planes too."""
    own, out = dot(planes, planes), []
    for k in range(centroids.shape[1]):
        one = centroids[:, k : k + 1]
        out.append(own - 2 * dot(planes, one) + dot(one, one))
    return np.stack(out)


def nearest(planes: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid, the smaller of equals, and its squared distance."""
    found = distances(planes, centroids)
    best = found.argmin(axis=0)
    return best, found[best, np.arange(len(best))]


def _read(column: pa.Array) -> np.ndarray:
    """Planes (plane, vector) of a stored batch; narrower vectors get their uppermost plane again."""
    offsets, flat = column.offsets.to_numpy(), column.values.to_numpy()
    width = np.diff(offsets)
    at = np.arange(width.max(initial=1))[:, None]
    return flat[offsets[:-1] + np.minimum(at, width - 1)].view(np.uint64)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            part = batch.slice(at, BLOCK)
            yield part, _read(part.column("planes"))


def vector_planes(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(id, planes) of the vectors that count, of each component x floor(scale * x)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                part = part.filter(pc.fill_null(pc.equal(pc.list_value_length(part.column("v")), COMPONENTS), False))
                flat = part.column("v").flatten().cast(pa.float64())
                values = flat.to_numpy(zero_copy_only=False).reshape(-1, COMPONENTS)  # a null becomes a NaN
                good = np.isfinite(values).all(axis=1)
                scaled = np.floor(scale * values[good])
                if (np.abs(scaled) >= 1 << MAX_BITS).any():
                    raise ValueError(f"a component times {scale} has more than {MAX_BITS} bits: distances would not fit a long")
                planes = to_planes(scaled.astype(np.int64))
                ends = np.arange(planes.shape[1] + 1, dtype=np.int32) * len(planes)
                stored = pa.ListArray.from_arrays(pa.array(ends), pa.array(planes.T.reshape(-1).view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column("id").filter(pa.array(good)), stored], ["id", "planes"])

    rows = vectors.select(named(id_col).cast("long").alias("id"), named(vector_col).cast("array<double>").alias("v"))
    return rows.mapInArrow(run, "id long, planes array<long>")


@dataclass
class Clustering:
    """Planes of the vectors, as a staged table, and the final centroids."""

    planes: DataFrame
    centroids: np.ndarray  # (centroid, component)

    def assigned(self) -> DataFrame:
        """(id, cluster, distance) per vector."""
        centroids = to_planes(self.centroids)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part, planes in _blocks(batches):
                cluster, distance = nearest(planes, centroids)
                columns = [part.column("id"), pa.array(cluster.astype(np.int32)), pa.array(distance)]
                yield pa.RecordBatch.from_arrays(columns, ["id", "cluster", "distance"])

        return self.planes.mapInArrow(run, "id long, cluster int, distance long")


def _round(planes: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Centroids after one round."""
    k, fixed = len(centroids), to_planes(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(k, np.int64), np.zeros((k, COMPONENTS), np.int64)
        for _, part in _blocks(batches):
            cluster, _ = nearest(part, fixed)
            x = to_components(part)
            n += np.bincount(cluster, minlength=k)
            for c in np.unique(cluster).tolist():
                total[c] += x[cluster == c].sum(axis=0)
        some = np.flatnonzero(n)
        sums = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1, dtype=np.int32) * COMPONENTS), pa.array(total[some].reshape(-1)))
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(n[some]), sums], ["cluster", "n", "sums"])

    parts = planes.mapInArrow(run, "cluster int, n long, sums array<long>")
    sums = parts.select("cluster", "n", F.posexplode("sums").alias("at", "x")).groupBy("cluster", "at")
    out = centroids.copy()
    for r in sums.agg(F.sum("n").alias("n"), F.sum("x").alias("x")).collect():  # k * 64 rows at most
        out[r.cluster, r.at] = r.x // r.n
    return out


def fit(
    vectors: DataFrame,
    k: int = CLUSTERS,
    rounds: int = ROUNDS,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    scale: int = SCALE,
    seed: str = SEED,
) -> Clustering:
    """Centroids after ``rounds`` rounds from the ``k`` vectors with the smallest sha256 of ``seed:id``."""
    planes = stage(vector_planes(vectors, id_col, vector_col, scale), "vector-planes")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    first = planes.orderBy(digest, "planes").limit(k).collect()
    one = lambda r: to_components(np.array([r.planes], np.int64).T.view(np.uint64))[0]
    centroids = np.stack([one(r) for r in first]) if first else np.zeros((0, COMPONENTS), np.int64)
    for _ in range(rounds if first else 0):
        centroids = _round(planes, centroids)
    return Clustering(planes, centroids)


def cluster_report(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", **options) -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid_sha256) per vector that counts."""
    found = fit(vectors, id_col=id_col, vector_col=vector_col, **options)
    spark, schema = vectors.sparkSession, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"
    if not len(found.centroids):
        own, sides = spark.createDataFrame([], "id long, cluster int, distance long"), []
    else:
        own = stage(found.assigned(), "clusters")
        sums = {r.cluster: r.s for r in own.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # k rows at most
        digest = lambda c: hashlib.sha256(",".join(map(str, found.centroids[c].tolist())).encode()).hexdigest()
        sides = [(c, s, sum(sums.values()), digest(c)) for c, s in sums.items()]
    return own.join(F.broadcast(spark.createDataFrame(sides, schema)), "cluster").select(
        F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )
