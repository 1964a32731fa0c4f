"""A stored partition of vectors for exact nearest neighbours: cells around centroids, with the range of distances to them.

Vectors are scaled to length one, so that order by cosine is order by distance. Each lies in the cell of its nearest
centroid; a cell is a folder, its rows are sorted by their distance to the centroid, and the least and the greatest of these
are kept. By the triangle inequality no row of a cell is nearer to a query than the query's distance to the centroid lies
outside of that range. A search scores the cells next to a query first; their k-th score then rules out most others, whose
folders are never read. What may hold one of the k best is read, so results are those of a full scan.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstone.operators.sizes import numbered
from quillstone.sources.tables import save_table

#: Distances and scores are sums of doubles; bounds give way by this much.
SLACK = 1e-6


def _unit(b: pa.RecordBatch, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows with a vector of the size that has a direction, and these vectors at length one."""
    vec = b.column("vec")
    whole = np.flatnonzero(np.diff(vec.offsets.to_numpy()) == size) if len(vec) else np.zeros(0, np.int64)
    m = np.stack([vec[int(i)].values.to_numpy(zero_copy_only=False) for i in whole]) if len(whole) else np.zeros((0, size))
    norm = np.linalg.norm(m, axis=1)
    good = np.isfinite(norm) & (norm > 0)
    return whole[good], m[good] / norm[good, None]


def _summed(centroids: np.ndarray):
    """Sums of the vectors by cell and component: a task gives at most one row for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros_like(centroids), np.zeros(len(centroids), bool)
        for b in batches:
            _, m = _unit(b, centroids.shape[1])
            cell = (m @ centroids.T).argmax(axis=1)
            np.add.at(total, cell, m)
            seen[cell] = True
        cell, at = np.nonzero(np.broadcast_to(seen[:, None], total.shape))
        yield pa.record_batch({"cell": cell, "at": at, "x": total[cell, at]})

    return run


def _placed(centroids: np.ndarray):
    """Each row with its cell and its distance to the cell's centroid; rows without a direction are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, m = _unit(b, centroids.shape[1])
            cell = (m @ centroids.T).argmax(axis=1)
            distance = np.linalg.norm(m - centroids[cell], axis=1)
            out = b.take(pa.array(rows))
            yield out.append_column("distance", pa.array(distance)).append_column("cell", pa.array(cell.astype(np.int32)))

    return run


def _scored(ids: np.ndarray, q: np.ndarray, reads: np.ndarray, k: int, decimals: int):
    """The best k of each batch for each query that reads the rows' cell; ``reads`` has a row a query and a column a cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, m = _unit(b, q.shape[1])
            keys, cells = b.column("chunk_id").to_numpy()[rows], b.column("cell").to_numpy()[rows]
            for cell in np.unique(cells):
                asked, mine = np.flatnonzero(reads[:, cell]), np.flatnonzero(cells == cell)
                mine = mine[np.argsort(keys[mine], kind="stable")]  # of equal scores the smaller id comes first
                score = np.round(q[asked] @ m[mine].T, decimals)
                best = np.argsort(-score, axis=1, kind="stable")[:, :k]
                yield pa.record_batch({"query_id": np.repeat(ids[asked], best.shape[1]), "chunk_id": keys[mine][best].ravel(), "score": np.take_along_axis(score, best, 1).ravel()})

    return run


class VectorIndex:
    """An index below ``root``. ``cells_read`` has, for each block of the last search, how many cells were read and how many there are."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.cells_read = spark, root.rstrip("/"), []

    def build(self, corpus: DataFrame, cells: int | None = None, sample: int = 50_000, rounds: int = 3) -> None:
        """Indexes (chunk_id, vec, ...); other columns are kept for conditions. Null, zero and non-finite vectors are left out,
        and so are those of another length than most of the sample have.

        Centroids are fitted to at most ``sample`` vectors, those with the smallest hashes of their ids, in ``rounds`` rounds;
        all vectors are indexed. ``cells`` is by default the square root of their number, 4,096 at most, so that centroids
        and ranges of cells stay small.
        """
        some = corpus.where("vec is not null and size(vec) > 0").select(F.col("chunk_id").cast("long").alias("chunk_id"), F.col("vec").cast("array<double>").alias("vec"))
        n = some.count()
        fit = save_table(some.orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(sample), "index-sample")
        size = fit.groupBy(F.size("vec").alias("size")).count().orderBy(F.desc("count"), "size").head()
        first: list[np.ndarray] = []
        if size:
            wanted = min(cells or min(isqrt(n), 4096), sample)
            rows = fit.where(F.size("vec") == size["size"]).where(~F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("vec", lambda x: x != 0))
            first = [np.array(r.vec) / np.linalg.norm(r.vec) for r in rows.dropDuplicates(["vec"]).orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(wanted).collect()]
        centroids = np.array(first).reshape(len(first), size["size"] if first else 0)
        for _ in range(rounds if first else 0):
            sums = fit.mapInArrow(_summed(centroids), "cell long, at long, x double").groupBy("cell", "at").agg(F.sum("x").alias("x")).collect()  # a row a cell and component
            total = np.zeros_like(centroids)
            for r in sums:
                total[r.cell, r["at"]] = r.x
            norm = np.linalg.norm(total, axis=1)
            moved = norm > 0
            centroids[moved] = total[moved] / norm[moved, None]
        self.spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centroids)], "cell int, centroid array<double>").coalesce(1).write.parquet(f"{self.root}/centroids")
        self.add(corpus)

    def add(self, corpus: DataFrame) -> None:
        """Adds rows with the columns that the index was built with and chunk_ids that it doesn't have. Ranges of cells are
        written last: rows of an addition that was broken off are not seen."""
        centroids = self._centroids()
        if not len(centroids):
            return
        rows = corpus.withColumn("chunk_id", F.col("chunk_id").cast("long")).withColumn("vec", F.col("vec").cast("array<double>")).where("chunk_id is not null and vec is not null")
        part = f"segment={len(self._segments())}"
        names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
        placed = rows.mapInArrow(_placed(centroids), f"{names}, distance double, cell int")
        # Ranges of distances and ids split a cell that holds many rows.
        placed.repartitionByRange("cell", "distance", "chunk_id").sortWithinPartitions("cell", "distance").write.mode("overwrite").partitionBy("cell").parquet(f"{self.root}/rows/{part}")
        kept = self.spark.read.schema(f"{names}, distance double, cell int").parquet(f"{self.root}/rows/{part}")
        ranges = kept.groupBy("cell").agg(F.count("*").alias("n"), F.min("distance").alias("least"), F.max("distance").alias("greatest"))
        ranges.withColumn("columns", F.lit(names)).coalesce(1).write.parquet(f"{self.root}/ranges/{part}")

    def _centroids(self) -> np.ndarray:
        found = self.spark.read.schema("cell int, centroid array<double>").parquet(f"{self.root}/centroids").orderBy("cell").collect()
        return np.array([r.centroid for r in found])

    def _segments(self) -> list[str]:
        """Folders of rows whose ranges are written, in order."""
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/ranges")
        files = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in files.listStatus(at)] if files.exists(at) else []
        whole = [n for n in names if files.exists(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/ranges/{n}/_SUCCESS"))]
        return [f"{self.root}/rows/{n}" for n in sorted(whole, key=lambda n: int(n.split("=")[1]))]

    def search(self, queries: DataFrame, k: int, where: Column | None = None, decimals: int = 9, block: int = 1000) -> DataFrame:
        """(query_id, chunk_id, score, rank): the exact k best by cosine for each of (query_id, qvec), as ``dense_top_k`` ranks
        them: scores are rounded first and ties go to the smaller chunk_id. ``where`` is a condition on the rows' other
        columns. Queries go in blocks of about ``block``, one after the other; those without a direction or of another
        length have no rows."""
        self.cells_read = []
        segments, centroids = self._segments(), self._centroids()
        none = self.spark.createDataFrame([], "query_id long, chunk_id long, score double, rank int")
        if not segments or not len(centroids):
            return none
        ranges = self.spark.read.schema("cell int, n long, least double, greatest double, columns string").parquet(*(s.replace("/rows/", "/ranges/") for s in segments))
        cells = ranges.groupBy("cell").agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.max("greatest").alias("greatest")).collect()  # a row a cell
        names = ranges.head()["columns"]
        rows = reduce(DataFrame.union, (self.spark.read.schema(f"{names}, distance double, cell int").parquet(s) for s in segments))
        rows = (rows if where is None else rows.where(where)).select("chunk_id", "vec", "distance", "cell")
        n, least, greatest = np.zeros(len(centroids)), np.full(len(centroids), np.inf), np.zeros(len(centroids))
        for c in cells:
            n[c.cell], least[c.cell], greatest[c.cell] = c.n, c.least, c.greatest
        asked = save_table(queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("qvec").cast("array<double>").alias("qvec")).where("query_id is not null and qvec is not null"), "index-queries")
        blocks, found = -(-max(1, asked.count()) // block), []
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")

        def scored(reads: np.ndarray, name: str) -> DataFrame:
            read = np.flatnonzero(reads.any(axis=0)).tolist()
            top = rows.where(F.col("cell").isin(read)).mapInArrow(_scored(ids, q, reads, k, decimals), "query_id long, chunk_id long, score double")
            return save_table(top.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k), name)

        for i in range(blocks):
            mine = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i).collect()  # about a block
            mine = [r for r in mine if len(r.qvec) == centroids.shape[1] and None not in r.qvec and 0 < np.linalg.norm(r.qvec) < np.inf]
            if not mine:
                continue
            ids, q = np.array([r.query_id for r in mine]), np.array([np.array(r.qvec) / np.linalg.norm(r.qvec) for r in mine])
            away = np.sqrt(np.maximum(0, 2 - 2 * q @ centroids.T))
            # The cells next to each query, up to the one with which k rows are reached.
            by_distance = np.argsort(np.where(n > 0, away, np.inf), axis=1, kind="stable")
            before = np.cumsum(n[by_distance], axis=1) - n[by_distance]
            near = np.zeros(away.shape, bool)
            np.put_along_axis(near, by_distance, before < k, axis=1)
            near &= n > 0
            one = scored(near, "index-near")
            kth = {r.query_id: r.score for r in one.where(F.col("rank") == k).select("query_id", "score").collect()}  # a row a query
            enough = np.array([kth.get(i, -2.0) for i in ids.tolist()])
            bound = np.maximum(0, np.maximum(away - greatest, least - away) - SLACK)
            more = (1 - bound**2 / 2 + SLACK + 10.0**-decimals >= enough[:, None]) & (n > 0) & ~near
            self.cells_read.append((int((near | more).any(axis=0).sum()), int((n > 0).sum())))
            both = one.union(scored(more, "index-more")) if more.any() else one
            found.append(save_table(both.drop("rank").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k), "index-ranked"))
        return reduce(DataFrame.union, found) if found else none

    def search_multi_query(self, queries: DataFrame, n: int, where: Column | None = None, decimals: int = 9) -> DataFrame:
        """(chunk_id, distance, rank): the first n chunks of each query, each chunk once with its least cosine distance."""
        found = self.search(queries, n, where, decimals).groupBy("chunk_id").agg(F.min(1 - F.col("score")).alias("distance"))
        return numbered(found, ["distance", "chunk_id"], "rank")
