"""A table kept in buckets whose changes rewrite only the buckets they touch.

``<root>/manifest/<version>`` is a small table of a row a bucket: the bucket and the folder that has its rows. A change writes
the new rows of touched buckets to a new folder and then a manifest of the next version, which names the old folders for
all other buckets. Until its manifest is there a change can't be seen, so one that fails midway leaves the table as it
was, and a reader that began before it goes on with the files it knows. Of two writers of one version one fails.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Versioned:
    """A versioned table below ``root``. Rows are dealt by the columns ``by`` to ``buckets`` buckets, and within each of these
    by the columns ``key`` to ``split`` more, for values of ``by`` that have very many rows."""

    def __init__(self, spark: SparkSession, root: str, key: list[str], by: list[str] | None = None, buckets: int = 64, split: int = 1):
        self.spark, self.root, self.key, self.by = spark, root.rstrip("/"), key, by or key
        self.buckets, self.split = buckets, split

    def _fs(self):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.root)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path

    def version(self) -> int:
        """The last version written; 0: none."""
        fs, path = self._fs()
        at = path(f"{self.root}/manifest")
        names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
        return max((int(n) for n in names if n.isdigit() and fs.exists(path(f"{self.root}/manifest/{n}/_SUCCESS"))), default=0)

    def folders(self, version: int | None = None) -> dict[int, str]:
        """The folder of each bucket that has rows; a row a bucket, of which there are buckets x split at most."""
        version = self.version() if version is None else version
        if not version:
            return {}
        return {r["bucket"]: r["folder"] for r in self.spark.read.schema("bucket int, folder string").parquet(f"{self.root}/manifest/{version}").collect()}

    def bucket(self) -> F.Column:
        wide, deep = F.pmod(F.xxhash64(*self.by), F.lit(self.buckets)), F.pmod(F.xxhash64(*self.key, F.lit(1)), F.lit(self.split))
        return (wide * self.split + deep).cast("int")

    def buckets_of(self, **values) -> list[int]:
        """The buckets that may have rows with these values of all columns of ``by``."""
        types = dict(self.read().dtypes)
        hashed = F.xxhash64(*(F.lit(values[c]).cast(types[c]) for c in self.by))
        wide = self.spark.range(1).select(F.pmod(hashed, F.lit(self.buckets)).alias("b")).first()["b"]
        return [wide * self.split + k for k in range(self.split)]

    def read(self, buckets: list[int] | None = None, version: int | None = None) -> DataFrame:
        """The table, or some of its buckets; an empty one has no columns, so a table is to be written before it is read."""
        folders = self.folders(version)
        paths = sorted({f"{f}/bucket={b}" for b, f in folders.items() if buckets is None or b in set(buckets)})
        some = paths or [f"{f}/bucket={b}" for b, f in list(folders.items())[:1]]
        if not some:
            raise ValueError(f"{self.root} has no rows")
        df = self.spark.read.parquet(*some)
        return df if paths else df.limit(0)

    def _commit(self, rows: DataFrame, version: int, keep: dict[int, str], touched: set[int] | None = None) -> dict[int, str]:
        """Writes rows as buckets of a new folder, and then the next manifest."""
        at = f"{self.root}/data/{version + 1}-{uuid.uuid4().hex[:8]}"
        rows.withColumn("bucket", self.bucket()).repartition(self.buckets * self.split, "bucket").sortWithinPartitions("bucket", *self.key).write.partitionBy("bucket").parquet(at)
        fs, path = self._fs()
        new = {int(s.getPath().getName().split("=")[1]): at for s in fs.listStatus(path(at)) if s.getPath().getName().startswith("bucket=")}
        folders = {b: f for b, f in keep.items() if touched is None or b not in touched} | new
        names = self.spark.createDataFrame(sorted(folders.items()), "bucket int, folder string")
        names.coalesce(1).write.mode("errorifexists").parquet(f"{self.root}/manifest/{version + 1}")
        return folders

    def replace(self, rows: DataFrame) -> int:
        """A new table in place of the old one; gives the version."""
        version = self.version()
        self._commit(rows, version, {})
        return version + 1

    def change(self, touched: list[int], made: Callable[[DataFrame], DataFrame]) -> int:
        """``made`` gives the new rows of the touched buckets from their old ones; others stay as they are."""
        version, keep = self.version(), self.folders()
        self._commit(made(self.read(touched)), version, keep, set(touched))
        return version + 1

    def upsert(self, new: DataFrame, order: list[str]) -> int:
        """Rows of ``new`` in place of those with the same key; of repeated keys the last by ``order``, or any one that
        their columns' hash decides where there is none. Columns that old rows lack are null there."""
        from quillstone.operators.store import latest_per_key, upsert

        last = latest_per_key(new, self.key, [F.desc(c) for c in order] or [F.xxhash64(*new.columns)]).drop(*(c for c in order if c not in self.key))
        if not self.folders():
            return self.replace(last)
        touched = [r["b"] for r in last.select(self.bucket().alias("b")).distinct().collect()]  # buckets x split at most
        return self.change(touched, lambda old: upsert(old, last, self.key, [])) if touched else self.version()

    def add(self, new: DataFrame) -> int:
        """Rows whose key isn't there yet; of repeated keys any one that their columns' hash decides. Stored rows stay."""
        from quillstone.operators.store import latest_per_key

        one = latest_per_key(new, self.key, [F.xxhash64(*new.columns)])
        if not self.folders():
            return self.replace(one)
        touched = [r["b"] for r in one.select(self.bucket().alias("b")).distinct().collect()]  # buckets x split at most
        if not touched or one.join(self.read(touched).select(*self.key), self.key, "left_anti").isEmpty():
            return self.version()
        return self.change(touched, lambda old: old.unionByName(one.join(old.select(*self.key), self.key, "left_anti"), allowMissingColumns=True))

    def delete(self, **values) -> tuple[int, int]:
        """Drops the rows with these values of ``by``; (version, how many)."""
        touched = [b for b in self.buckets_of(**values) if b in self.folders()]
        if not touched:
            return self.version(), 0
        same = F.lit(True)
        for c, v in values.items():
            same = same & F.coalesce(F.col(c) == v, F.lit(False))
        n = self.read(touched).where(same).count()
        return (self.change(touched, lambda old: old.where(~same)) if n else self.version()), n

    def vacuum(self, keep: int = 1) -> int:
        """Deletes what only versions before the last ``keep`` name; gives how many folders of buckets went."""
        fs, path = self._fs()
        last = self.version()
        used = {f"{f}/bucket={b}" for v in range(max(1, last - keep + 1), last + 1) for b, f in self.folders(v).items()}
        gone = 0
        for folder in fs.listStatus(path(f"{self.root}/data")):
            for part in fs.listStatus(folder.getPath()):
                name = part.getPath().toString()
                if part.isDirectory() and not any(name.endswith(u.split("/data/")[1]) for u in used):
                    gone += fs.delete(part.getPath(), True)
        for v in range(1, last - keep + 1):
            fs.delete(path(f"{self.root}/manifest/{v}"), True)
        return gone
