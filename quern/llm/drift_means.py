"""Centroid clustering with geometric drift tightening.

Vectors and centroids are whole numbers, so distances and means are exact. Every vector carries its centroid, an upper
bound of the distance to it and a lower bound of the distance to all others. When centroids move, the upper bound grows by
the drift of the vector's own. The lower bound shrinks by less than the others' drift: all vectors of a cluster lie in a
sphere about its old centroid, whose radius is their largest upper bound, and in the plane through that centroid and the
two places p, q of another one, the distance to p exceeds that to q by at most |pq| cos(phi - beta) anywhere in the sphere;
phi is the angle at the middle of pq between q and the sphere's centre, beta the angle under which its radius appears
there. (A point that is t nearer to q than to p lies within the cone of the hyperbola's asymptotes, cos = t / |pq|.) Where
the sphere reaches that cone's axis, the full drift counts, and where it lies wholly on p's side, none.
A vector whose bounds leave its centroid in doubt is ambiguous: its distances to all centroids are computed exactly.

A round is one pass over the vectors, written with their bounds, and one aggregate of a row a centroid, which alone goes
to the driver: k rows of d sums. Groups are never gathered, so a cluster that holds most vectors is no hot key.

Defined results: a vector is kept if it has exactly `dims` components, none of them null, NaN or infinite; other rows have
no result. Ties of distance go to the smaller number; ties of the starting hash to the smaller id, then the smaller vector,
nulls first. Repeated rows are vectors of their own. With fewer vectors than k there are as many centroids. An empty table
gives no rows. Components must be less than 2**26 as whole numbers, so that squared distances are exact in 64 bits; a
larger one is an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.session import discard, staged

#: Whole components beyond this could not be squared and summed exactly.
LARGEST = 1 << 26
#: Bounds are kept in floating point; a margin so much larger than its rounding keeps them on the safe side.
MARGIN = 1e-9


def whole_vectors(rows: DataFrame, id_column: str, vector: str, dims: int, scale: int) -> DataFrame:
    """(_id, _v): the kept vectors in whole numbers, floor(scale * x) of each component."""
    x = F.col(vector)
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))))
    kept = rows.filter((F.size(x) == dims) & F.coalesce(finite, F.lit(False)))
    scaled = F.transform(x, lambda v: F.floor(v.cast("double") * scale))
    largest = F.array_max(F.transform(x, lambda v: F.abs(v.cast("double") * scale)))
    checked = F.when(largest < LARGEST, scaled).otherwise(F.raise_error(F.lit(f"a component times {scale} reaches 2**26")).cast("array<bigint>"))
    return kept.select(F.col(id_column).alias("_id"), F.transform(checked, lambda v: v.cast("int")).alias("_v"))


def start(vectors: DataFrame, k: int, salt: str) -> np.ndarray:
    """The k vectors whose ids hash lowest, in that order."""
    key = F.sha2(F.concat(F.lit(f"{salt}:"), F.coalesce(F.col("_id").cast("string"), F.lit(""))), 256)
    first = vectors.orderBy(key, "_id", "_v").limit(k).collect()
    return np.array([r["_v"] for r in first], np.int64)


def squared_distances(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances, a row a vector."""
    most = max(np.abs(vectors).max(initial=0), np.abs(centroids).max(initial=0))
    if most * most * vectors.shape[1] * 4 < 1 << 53:  # whole numbers so small are exact in floating point too
        v, c = vectors.astype(float), centroids.astype(float)
        return ((v * v).sum(axis=1)[:, None] - 2 * (v @ c.T) + (c * c).sum(axis=1)).astype(np.int64)
    out = np.empty((len(vectors), len(centroids)), np.int64)
    for j, c in enumerate(centroids):
        d = vectors - c
        out[:, j] = (d * d).sum(axis=1)
    return out


def own_distances(vectors: np.ndarray, centroids: np.ndarray, cluster: np.ndarray) -> np.ndarray:
    d = vectors - centroids[cluster]
    return (d * d).sum(axis=1)


def loosening(before: np.ndarray, after: np.ndarray, radii: np.ndarray) -> np.ndarray:
    """How much nearer any vector of cluster i may have come to a centroid other than its own, for each i."""
    p, q = before.astype(float), after.astype(float)
    drift = np.sqrt(((q - p) ** 2).sum(axis=1))
    middle, along = (p + q) / 2, (q - p) / np.where(drift > 0, drift, 1)[:, None]
    from_middle = p[:, None, :] - middle[None]  # sphere i seen from the middle of j's move
    away = np.sqrt((from_middle**2).sum(axis=2))
    safe = np.where(away > 0, away, 1)
    cos_phi = np.clip(np.einsum("ijd,jd->ij", from_middle, along) / safe, -1, 1)
    sin_beta = np.clip(radii[:, None] / safe, 0, 1)
    sin_phi, cos_beta = np.sqrt(1 - cos_phi**2), np.sqrt(1 - sin_beta**2)
    reaches_axis = (away <= radii[:, None] * (1 + MARGIN)) | (cos_phi >= cos_beta)
    share = np.where(reaches_axis, 1.0, np.maximum(cos_phi * cos_beta + sin_phi * sin_beta, 0.0) + MARGIN)
    nearer = drift * np.minimum(share, 1.0)
    np.fill_diagonal(nearer, 0.0)
    return nearer.max(axis=1, initial=0.0)


def assign(vectors: np.ndarray, centroids: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, ...]:
    """(cluster, upper, lower) after the centroids' move, given bounds that hold for their new places, and how many vectors
    were scanned."""
    cluster, upper, lower = cluster.copy(), upper.copy(), lower.copy()
    unsure = np.flatnonzero(~(upper * (1 + MARGIN) < lower))
    if len(unsure):  # the exact distance to the own centroid may settle it
        known = unsure[cluster[unsure] >= 0]
        upper[known] = np.sqrt(own_distances(vectors[known], centroids, cluster[known]))
        unsure = unsure[~((cluster[unsure] >= 0) & (upper[unsure] * (1 + MARGIN) < lower[unsure]))]
    if len(unsure):
        d = squared_distances(vectors[unsure], centroids)
        best = d.argmin(axis=1)  # of equals, the first
        cluster[unsure], upper[unsure] = best, np.sqrt(d[np.arange(len(best)), best])
        d[np.arange(len(best)), best] = np.iinfo(np.int64).max
        lower[unsure] = np.sqrt(d.min(axis=1)) if d.shape[1] > 1 else np.inf
    return cluster, upper, lower, len(unsure)


def _array(batch: pa.RecordBatch, name: str, dims: int) -> np.ndarray:
    return batch.column(name).flatten().to_numpy().astype(np.int64).reshape(-1, dims)


def _pass(rows: DataFrame, centroids: np.ndarray, drift: np.ndarray, loose: np.ndarray) -> DataFrame:
    """Every vector with its centroid and bounds for these centroids; drift and loose are what the bounds give way by."""
    dims = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = _array(batch, "_v", dims)
            cluster, upper, lower = (batch.column(c).to_numpy() for c in ("_cluster", "_upper", "_lower"))
            if len(drift):
                upper, lower = upper + drift[cluster] * (1 + MARGIN), lower - loose[cluster] * (1 + MARGIN)
            cluster, upper, lower, scanned = assign(vectors, centroids, cluster, upper, lower)
            counts = np.zeros(batch.num_rows, np.int64)
            counts[0] = scanned
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id"), batch.column("_v"), pa.array(cluster, pa.int32()), pa.array(upper, pa.float64()), pa.array(lower, pa.float64()), pa.array(counts)],
                names=["_id", "_v", "_cluster", "_upper", "_lower", "_scanned"],
            )

    kind = rows.schema["_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"_id {kind}, _v array<int>, _cluster int, _upper double, _lower double, _scanned long")


def _moved(rows: DataFrame, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The centroids' next places, the radius of each cluster's sphere, and the vectors scanned: a row a centroid."""
    dims = centroids.shape[1]
    sums = [F.sum(F.col("_v")[i].cast("long")).alias(f"s{i}") for i in range(dims)]
    found = rows.groupBy("_cluster").agg(F.count("*").alias("n"), F.max("_upper").alias("radius"), F.sum("_scanned").alias("scanned"), *sums).collect()
    after, radii = centroids.copy(), np.zeros(len(centroids))
    for r in found:
        after[r["_cluster"]] = [r[f"s{i}"] // r["n"] for i in range(dims)]
        radii[r["_cluster"]] = r["radius"]
    return after, radii, sum(r["scanned"] for r in found)


def cluster(rows: DataFrame, k: int = 40, rounds: int = 5, id_column: str = "vec_id", vector: str = "embedding", dims: int = 64, scale: int = 256, salt: str = "2") -> tuple[DataFrame, np.ndarray, list[int]]:
    """(_id, _v, _cluster) of every kept vector after `rounds` rounds and one more assignment, the final centroids, and how
    many vectors each of the assignments scanned. The table is a written one."""
    vectors = whole_vectors(rows, id_column, vector, dims, scale)
    centroids = start(vectors, k, salt)
    unknown: list[Column] = [F.lit(-1).alias("_cluster"), F.lit(float("inf")).alias("_upper"), F.lit(0.0).cast("double").alias("_lower")]
    held = vectors.select("*", *unknown)
    if not len(centroids):
        return held.select("_id", "_v", "_cluster"), np.zeros((0, dims), np.int64), []
    drift = loose = np.zeros(0)
    scans, written = [], None
    for n in range(rounds + 1):
        held = staged(_pass(held, centroids, drift, loose))
        if written is not None:
            discard(written)
        written = held
        after, radii, scanned = _moved(held, centroids)
        scans.append(scanned)
        if n < rounds:
            drift = np.sqrt(((after - centroids).astype(float) ** 2).sum(axis=1))
            loose = loosening(centroids, after, radii * (1 + MARGIN))
            centroids = after
    return held.select("_id", "_v", "_cluster"), centroids, scans


def digest(found: DataFrame, centroids: np.ndarray, id_column: str = "vec_id") -> DataFrame:
    """Each vector's cluster, squared distance, the sums of distances over its cluster and over all, and its centroid's hash."""
    spark, kinds = found.sparkSession, "_cluster int, _c array<bigint>"
    places = [(j, c) for j, c in enumerate(centroids.tolist())]
    square = F.aggregate(F.zip_with("_v", "_c", lambda a, b: (a - b) * (a - b)), F.lit(0).cast("long"), lambda s, v: s + v)
    near = found.join(F.broadcast(spark.createDataFrame(places, kinds)), "_cluster").withColumn("distance", square)
    sums = {r["_cluster"]: r["s"] for r in near.groupBy("_cluster").agg(F.sum("distance").alias("s")).collect()}  # at most a row a centroid
    total = sum(sums.values())
    facts = [(j, c, sums.get(j, 0), total, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for j, c in places]
    table = spark.createDataFrame(facts, f"{kinds}, cluster_inertia long, inertia long, centroid_sha256 string")
    rows = found.join(F.broadcast(table), "_cluster")
    return rows.select(F.col("_id").alias(id_column), F.col("_cluster").alias("cluster"), square.alias("distance"), "cluster_inertia", "inertia", "centroid_sha256")
