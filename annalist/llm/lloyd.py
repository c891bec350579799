"""Operator 13: centroid clustering by plain Lloyd rounds over exact integers.

Each component x of a vector becomes the integer floor(scale * x).  A round
broadcasts the centroids (``k`` vectors), assigns every vector in
``mapInPandas`` by integer squared differences, and sums the vectors of each
cluster per partition; these sums, at most ``k * (dims + 1)`` rows a partition,
merge through ``groupBy``.  All arithmetic is in whole numbers, so neither the
order of rows nor the number of partitions changes a result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

K, ROUNDS, DIMS, SCALE, SALT = 16, 3, 64, 64, "1"
#: Integers from here on are refused: the squared distance of two such vectors might not fit 64 bits.
LARGEST = 1 << 27


def usable(vec: Column, dims: int) -> Column:
    """Whether a vector has exactly ``dims`` components, none of them null or non-finite."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce((F.size(vec) == dims) & F.forall(vec, finite), F.lit(False))


def _whole(vecs: pd.Series, scale: int) -> np.ndarray:
    values = np.floor(np.stack(vecs.to_list()).astype(np.float64) * scale)
    if np.abs(values).max() >= LARGEST:
        raise ValueError(f"components of {LARGEST // scale} or more are not supported")
    return values.astype(np.int64)


def nearest(values: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each row, the lowest of equals, and the squared distance."""
    distances = np.stack([((values - c) ** 2).sum(axis=1) for c in centroids], axis=1)
    cluster = distances.argmin(axis=1)
    return cluster, distances[np.arange(len(values)), cluster]


def seeds(kept: DataFrame, k: int, scale: int, salt: str) -> np.ndarray:
    """The ``k`` vectors with the smallest sha256 of ``<salt>:<vec_id>``; of rows that repeat an id the smaller vectors come first."""
    named = kept.where("vec_id is not null").select(F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")), 256).alias("h"), "vec")
    first = named.orderBy("h", "vec").limit(k).collect()
    return _whole(pd.Series([r["vec"] for r in first]), scale) if first else np.zeros((0, 0), np.int64)


def moved(kept: DataFrame, centroids: np.ndarray, scale: int) -> np.ndarray:
    """The centroids after one round: componentwise floor(sum / count) of their vectors; one without vectors stays."""
    k, dims = centroids.shape
    shared = kept.sparkSession.sparkContext.broadcast(centroids)

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((k, dims + 1), np.int64)
        for batch in batches:
            if len(batch):
                values = _whole(batch["vec"], scale)
                cluster, _ = nearest(values, shared.value)
                for c in np.unique(cluster):
                    own = values[cluster == c]
                    total[c, :dims] += own.sum(axis=0)
                    total[c, dims] += len(own)
        c, i = np.nonzero(np.broadcast_to(total[:, dims:] > 0, total.shape))
        yield pd.DataFrame({"cluster": c, "place": i, "total": total[c, i]})

    parts = kept.select("vec").mapInPandas(sums, "cluster int, place int, total bigint")
    merged = parts.groupBy("cluster", "place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    exact = {(r["cluster"], r["place"]): int(r["total"]) for r in merged.collect()}  # k * (dims + 1) numbers
    rows = [[exact[c, i] // exact[c, dims] for i in range(dims)] if (c, dims) in exact else centroids[c].tolist() for c in range(k)]
    return np.array(rows, np.int64)


def digest(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()


def cluster(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, salt: str = SALT) -> tuple[DataFrame, np.ndarray]:
    """``vectors(vec_id, vec)`` to rows ``(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256)`` and the final centroids.

    A vector is kept if it has exactly ``dims`` components, none null or
    non-finite; others give no row.  Centroids start as the ``k`` kept vectors
    of ``seeds``; with fewer vectors there are fewer.  Ties go to the lower
    centroid; repeated rows count as often as they stand; rows without a vec_id
    are clustered but never a seed, and where no row has one, no rows come out.
    Components of LARGEST / scale or more raise ValueError.  No rows give none;
    other columns, whatever their names, are ignored.
    """
    spark = vectors.sparkSession
    kept = vectors.select("vec_id", "vec").where(usable(F.col("vec"), dims))
    centroids = seeds(kept, k, scale, salt)
    schema = "vec_id bigint, cluster int, distance bigint"
    if not len(centroids):
        empty = spark.createDataFrame([], schema)
        return empty.select("*", *[F.lit(None).cast(t).alias(c) for c, t in (("cluster_inertia", "bigint"), ("inertia", "bigint"), ("centroid_sha256", "string"))]), centroids
    for _ in range(rounds):
        centroids = moved(kept, centroids, scale)
    shared = spark.sparkContext.broadcast(centroids)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                at, distance = nearest(_whole(batch["vec"], scale), shared.value)
                yield pd.DataFrame({"vec_id": batch["vec_id"], "cluster": at, "distance": distance})

    assigned = stored(kept.mapInPandas(assign, schema))
    sums = {r["cluster"]: int(r["d"]) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    facts = [(c, d, sum(sums.values()), digest(centroids[c])) for c, d in sums.items()]  # a row a cluster
    named = spark.createDataFrame(facts, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return assigned.join(F.broadcast(named), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"), centroids
