"""Tables and files that jobs share: all go below the folder that the session names in spark.checkpoint.dir."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's URI below spark.checkpoint.dir; where that is unset and the master is local, a temporary one is set."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("a cluster needs spark.checkpoint.dir, a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-quillstone-")
        spark.conf.set("spark.checkpoint.dir", base)
    _made.append(f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}")
    return _made[-1]


#: The folders that this driver asked for, oldest first.
_made: list[str] = []


def mark() -> int:
    """A point in time for ``clear``."""
    return len(_made)


def clear(spark: SparkSession, since: int = 0, keep: tuple[str, ...] = ()) -> None:
    """Deletes the folders made since a mark but those to keep: call it once what was computed from them is written."""
    for at in [f for f in _made[since:] if f not in keep]:
        _delete(spark, at)
        _made.remove(at)


#: Options of ``save`` for tables whose rows take megabytes. Parquet looks at a page's and a row group's size every hundred rows at
#: first, and a task holds what it has until then, as do readers; so it is to look at each row, and row groups are of 16 MB.
WIDE_ROWS = {"parquet.block.size": 16 << 20, "parquet.page.size.row.check.min": 1, "parquet.page.size.row.check.max": 1}


def save(df: DataFrame, name: str, **options) -> DataFrame:
    """Writes a table to the shared folder and reads it back: lineage ends here and lost executors cost no rework."""
    at = shared_folder(df.sparkSession, name)
    df.write.options(**options).parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def spare(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def drop(spark: SparkSession, *tables: DataFrame) -> None:
    """Deletes tables that save() wrote and that no later job reads."""
    for at in {f.rpartition("/")[0] for t in tables for f in t.inputFiles()}:
        _delete(spark, at)


def _delete(spark: SparkSession, at: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession, mb: int = 4) -> None:
    """Bounds the Arrow batches that Python tasks get, as texts may be very long."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{mb}m")


def released(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """Wraps a task's function over batches so that an idle worker process gives freed memory back to the system."""

    @wraps(run)
    def task(batches: Iterator) -> Iterator:
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):  # not glibc
            pass

    return task


def n_buckets(spark: SparkSession) -> int:
    """How many ways work is dealt out: the session's number of shuffle partitions, which its owner sets for the data."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
