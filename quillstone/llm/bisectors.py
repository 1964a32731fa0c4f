"""Integer k-means whose assignment is a tournament of bisecting planes.

For centroids i < j the squared distances of v differ by a linear function: d(v, i) <= d(v, j) exactly if the product of
v and 2(ci - cj) is at least |ci|^2 - |cj|^2. These normals and thresholds are computed once a round for all pairs. A
vector meets the centroids in order of number; each of the k - 1 sign tests eliminates one, and zero keeps the smaller
number. Everything is 64-bit integers, and the distance to the winner is computed exactly at the end.

Vectors stay in their tasks. A round sends sums by cluster and component, added up in each task before they are shuffled;
the driver holds k centroids.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.store import released, save, small_batches

#: Sizes of components for which every product and distance of 64 components fits 64 bits.
LARGEST = 1 << 27
#: Rows that a task assigns together.
ROWS = 4096


class Tournament:
    """Centroids as integer rows, with the planes between each two."""

    def __init__(self, centroids: np.ndarray):
        self.centroids, self.k = centroids, len(centroids)
        self.normals = 2 * (centroids[:, None, :] - centroids[None, :, :])
        norms = (centroids * centroids).sum(axis=1)
        self.thresholds = norms[:, None] - norms[None, :]

    def winners(self, v: np.ndarray) -> np.ndarray:
        best = np.zeros(len(v), np.int64)
        for rival in range(1, self.k):
            for holder in range(rival):  # those who meet this rival, by the centroid they hold
                at = np.flatnonzero(best == holder)
                if len(at):
                    side = v[at] @ self.normals[holder, rival] - self.thresholds[holder, rival]
                    best[at[side < 0]] = rival
        return best

    def distances(self, v: np.ndarray, of: np.ndarray) -> np.ndarray:
        d = v - self.centroids[of]
        return np.einsum("ij,ij->i", d, d)


def grid_vectors(vectors: DataFrame, dim: int = 64, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, v array<long>) with floor(scale * x) for each component x as a double: rows of exactly ``dim`` components,
    none null, NaN or infinite; others are left out. Null and repeated ids are kept, a row each."""
    v = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("e"))
    finite = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = v.where((F.size("e") == dim) & F.coalesce(finite, F.lit(False)))
    cell = lambda x: F.when(F.abs(x) <= 1e15, F.floor(x * scale)).otherwise(F.lit((1 << 62))).cast("long")  # noqa: E731  the bound is checked
    return good.select("vec_id", F.transform("e", cell).alias("v"))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.int64)


def _sums(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = Tournament(centroids)
        total, count = np.zeros_like(centroids), np.zeros(t.k, np.int64)
        for b in batches:
            for k in range(0, b.num_rows, ROWS):
                v = _matrix(b.column("v").slice(k, ROWS))
                of = t.winners(v)
                np.add.at(total, of, v)
                count += np.bincount(of, minlength=t.k)
        some = np.flatnonzero(count)
        dim = centroids.shape[1]
        yield pa.record_batch({"cluster": np.repeat(some, dim), "place": np.tile(np.arange(dim), len(some)), "total": total[some].ravel(), "n": np.repeat(count[some], dim)})

    return released(run)


def _assigned(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = Tournament(centroids)
        for b in batches:
            for k in range(0, b.num_rows, ROWS):
                part = b.slice(k, ROWS)
                v = _matrix(part.column("v"))
                of = t.winners(v)
                yield pa.record_batch({"vec_id": part.column("vec_id"), "cluster": of.astype(np.int32), "distance": t.distances(v, of)})

    return released(run)


def centroid_clusters(grid: DataFrame, k: int = 16, rounds: int = 3, seed: str = "1") -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance) of each row of ``grid_vectors``, saved, and the final centroids by number.

    Centroids start as the k rows with the smallest SHA-256 of "seed:vec_id" (ties: by components; null ids last); fewer
    rows give fewer centroids, none give no rows. A round assigns all rows and moves each centroid that has some to
    the floor of their mean. Components beyond 2^27 raise a ValueError, as distances might not fit a long.
    """
    small_batches(grid.sparkSession)
    g = save(grid, "grid-vectors")
    largest = g.agg(F.max(F.greatest(F.abs(F.array_max("v")), F.abs(F.array_min("v")))).alias("m")).first()["m"]
    if largest is not None and largest > LARGEST:
        raise ValueError(f"a component of {largest} is beyond {LARGEST}")
    if largest is None:
        return g.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), np.zeros((0, 0), np.int64)
    draw = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = g.select(draw.alias("draw"), "v").orderBy(F.asc_nulls_last("draw"), "v").limit(k).collect()
    centroids = np.array([r["v"] for r in first], np.int64)
    for _ in range(rounds):
        parts = g.mapInArrow(_sums(centroids), "cluster long, place long, total long, n long")
        means = parts.groupBy("cluster", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect()  # at most k x dim rows
        centroids = centroids.copy()
        for r in means:
            centroids[r["cluster"], r["place"]] = r["total"] // r["n"]
    return save(g.mapInArrow(_assigned(centroids), "vec_id long, cluster int, distance long"), "clusters"), centroids


def centroid_digests(centroids: np.ndarray) -> list[str]:
    return [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]


def with_inertia(assigned: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Adds cluster_inertia and inertia (sums of distances; null beyond a long) and centroid_sha256."""
    sums = assigned.groupBy("cluster").agg(F.try_sum("distance").alias("cluster_inertia")).collect()  # at most k rows
    by = {r["cluster"]: r["cluster_inertia"] for r in sums}
    total = None if None in by.values() or sum(by.values()) >= 1 << 63 else sum(by.values())
    pick = lambda values, kind: F.get(F.array(*(F.lit(x).cast(kind) for x in values)), F.col("cluster")) if len(values) else F.lit(None).cast(kind)
    return assigned.select("*", pick([by.get(c) for c in range(len(centroids))], "long").alias("cluster_inertia"), F.lit(total).cast("long").alias("inertia"), pick(centroid_digests(centroids), "string").alias("centroid_sha256"))
