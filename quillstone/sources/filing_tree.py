"""A data source over a tree of filings, TICKER/FORM/DATE_ACCESSION/file: one row a filing with its primary file.

The driver lists the first level only. Each task lists the folders of some tickers and picks the primary file of a filing where
it lists it, so nothing is shuffled. Conditions on ticker, form and date are taken over from Spark: folders that they leave out
are never listed.
"""

from __future__ import annotations

import operator
import re
import zlib
from collections.abc import Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual

from quillstone.sources.tables import save_table

SCHEMA = "ticker string, filing_type string, date string, accession_number string, source_path string, length long"
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
_FOLDER = re.compile(r"(.{4}-.{2}-.{2})_(.*)", re.DOTALL)
_COMPARED = {EqualTo: operator.eq, EqualNullSafe: operator.eq, GreaterThan: operator.gt, GreaterThanOrEqual: operator.ge, LessThan: operator.lt, LessThanOrEqual: operator.le}


@dataclass(frozen=True)
class Bound:
    """A condition on one level of the tree; texts compare by code points, as Spark compares them."""

    level: str
    test: type
    value: str | tuple[str, ...]

    def holds(self, name: str) -> bool:
        return name in self.value if self.test is In else _COMPARED[self.test](name, self.value)


@dataclass
class Tickers(InputPartition):
    folders: list[tuple[str, str]]
    slice: int


def _entries(files: fs.FileSystem, folder: str, missing: bool = True) -> list[fs.FileInfo]:
    """What a folder holds, by name; one that has gone since it was named holds nothing."""
    return sorted(files.get_file_info(fs.FileSelector(folder, allow_not_found=missing)), key=lambda e: e.base_name)


def _primary(entries: list[fs.FileInfo]) -> fs.FileInfo | None:
    """The largest HTML file, of equal ones the first by name; else the first PDF."""
    kept = [e for e in entries if e.type == fs.FileType.File]
    html = [e for e in kept if re.search(r"\.html?$", e.base_name, re.I)]
    return min(html, key=lambda e: -e.size) if html else next((e for e in kept if e.base_name.lower().endswith(".pdf")), None)


class TreeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.bounds = options["path"], []
        self.group, self.slices = int(options.get("tickers_per_task", 16)), int(options.get("slices", 1))
        if self.group < 1 or self.slices < 1:
            raise ValueError("tickers_per_task and slices are at least 1")

    def _open(self, level: str, name: str) -> bool:
        return all(b.holds(name) for b in self.bounds if b.level == level)

    def partitions(self) -> list[Tickers]:
        files, root = fs.FileSystem.from_uri(self.root)
        named = [(e.base_name.upper(), e.path) for e in _entries(files, root, missing=False) if e.type == fs.FileType.Directory]
        kept = [(t, p) for t, p in named if t != "NEWS" and self._open("ticker", t)]
        groups = [kept[k : k + self.group] for k in range(0, len(kept), self.group)]
        return [Tickers(g, s) for g in groups for s in range(self.slices)] or [Tickers([], 0)]

    def _filings(self, part: Tickers) -> Iterator[tuple]:
        files, _ = fs.FileSystem.from_uri(self.root)
        for ticker, at in part.folders:
            for form in _entries(files, at):
                if form.type != fs.FileType.Directory or not self._open("filing_type", form.base_name):
                    continue
                for filing in _entries(files, form.path):
                    name = _FOLDER.fullmatch(filing.base_name)
                    if filing.type != fs.FileType.Directory or not name or not self._open("date", name[1]):
                        continue
                    if zlib.crc32(filing.base_name.encode()) % self.slices == part.slice and (main := _primary(_entries(files, filing.path))):
                        yield ticker, form.base_name, name[1], name[2], main.path, main.size

    def read(self, partition: Tickers) -> Iterator[pa.RecordBatch]:
        types = [pa.string()] * 5 + [pa.int64()]
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        batch: list[tuple] = []
        for row in self._filings(partition):
            batch.append(row)
            if len(batch) == 4096:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*batch), types)], names)
                batch = []
        if batch:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*batch), types)], names)


class FilteredTreeReader(TreeReader):
    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes comparisons of ticker, form and date with texts; others are Spark's to apply."""
        for f in filters:
            level = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            values = f.value if isinstance(f, In) else (getattr(f, "value", None),)
            if level in ("ticker", "filing_type", "date") and (type(f) in _COMPARED or isinstance(f, In)) and all(isinstance(v, str) for v in values):
                self.bounds.append(Bound(level, type(f), tuple(values) if isinstance(f, In) else f.value))
            elif not (isinstance(f, IsNotNull) and level in ("ticker", "filing_type", "date")):  # a level has a name
                yield f


class FilingTree(DataSource):
    @classmethod
    def name(cls) -> str:
        return "filing_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        options = dict(self.options)
        return FilteredTreeReader(options) if options.get("pushed") == "true" else TreeReader(options)


def read_tree(spark: SparkSession, root: str, tickers_per_task: int = 16, slices: int = 1) -> DataFrame:
    """(ticker, filing_type, date, accession_number, source_path, length) of each filing below ``root``, a path or URI that
    pyarrow's file systems know. Tickers are in capitals; a folder NEWS, folders whose names have no date and filings without
    HTML or PDF give no row; a root that isn't there is an error.

    Conditions reach the tree where the session has ``spark.sql.python.filterPushdown.enabled``; else Spark applies them to the
    rows. A task lists ``tickers_per_task`` tickers; with ``slices`` their filings are shared out among as many tasks.
    """
    spark.dataSource.register(FilingTree)
    pushed = str(spark.conf.get(PUSHDOWN, "false")).lower()
    return spark.read.format("filing_tree").option("pushed", pushed).option("tickers_per_task", tickers_per_task).option("slices", slices).load(root)


def write_tree(rows: DataFrame, root: str) -> None:
    """Writes (ticker, filing_type, date, accession_number, file, content) into the tree; a task that runs twice writes the same
    files again. Names with a slash are an error, as they would lead out of their folder."""
    parts = ("ticker", "filing_type", "date", "accession_number", "file")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = fs.FileSystem.from_uri(root)
        for b in batches:
            made = set()
            for r in b.to_pylist():
                if any(not r[p] or "/" in r[p] or r[p] in (".", "..") for p in parts):
                    raise ValueError(f"no name of a folder or file: {[r[p] for p in parts]}")
                folder = f"{base}/{r['ticker']}/{r['filing_type']}/{r['date']}_{r['accession_number']}"
                if folder not in made:
                    files.create_dir(folder, recursive=True)
                    made.add(folder)
                with files.open_output_stream(f"{folder}/{r['file']}") as out:
                    out.write(r["content"] or b"")
            yield pa.record_batch({"n": pa.array([b.num_rows], pa.int64())})

    rows.select(*parts, F.col("content").cast("binary").alias("content")).mapInArrow(write, "n long").agg(F.sum("n")).collect()


def remove_tree(rows: DataFrame, root: str) -> None:
    """Removes what ``write_tree`` wrote for the tickers of ``rows``, in tasks, and then the root."""

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = fs.FileSystem.from_uri(root)
        for b in batches:
            for t in b.column("ticker").unique().to_pylist():
                if files.get_file_info(f"{base}/{t}").type == fs.FileType.Directory:
                    files.delete_dir(f"{base}/{t}")
            yield pa.record_batch({"n": pa.array([b.num_rows], pa.int64())})

    rows.select("ticker").mapInArrow(remove, "n long").agg(F.sum("n")).collect()
    files, base = fs.FileSystem.from_uri(root)
    files.delete_dir(base)


def through_trees(rows: DataFrame, root: str, condition: str, filings: int = 50_000, at_once: int = 1) -> DataFrame:
    """What ``read_tree`` finds under a condition in the tree of ``rows``, of which about ``filings`` filings are on disk at a time:
    a filing takes folders and files of a block each, many times its row. Tickers are dealt to rounds; each round's tree is
    written, read and removed, and what it gave is kept as a table.

    ``at_once`` rounds of so many times fewer filings run beside each other: while one round's jobs start or its tree is listed,
    others write and remove.
    """
    spark, tasks = rows.sparkSession, rows.sparkSession.sparkContext.defaultParallelism
    at = f"{root}/rows"
    all_ = save_table(rows, "tree-rows")
    rounds = -(-max(1, all_.select("ticker", "filing_type", "date", "accession_number").distinct().count()) * at_once // filings)
    all_.withColumn("__round", F.pmod(F.xxhash64("ticker"), F.lit(rounds)).cast("int")).repartition(tasks, "__round").write.partitionBy("__round").parquet(at)
    dealt = spark.read.schema(f"{_ddl(all_)}, __round int").parquet(at)

    def through(k: int) -> None:
        mine = dealt.where(F.col("__round") == k).drop("__round").repartition(tasks, "ticker")
        tree = f"{root}/tree-{k}"
        fs.FileSystem.from_uri(tree)[0].create_dir(fs.FileSystem.from_uri(tree)[1], recursive=True)
        write_tree(mine, tree)
        read_tree(spark, tree, tickers_per_task=256).where(condition).write.parquet(f"{root}/found/round={k}")
        remove_tree(mine, tree)

    with ThreadPoolExecutor(at_once) as pool:
        done = [pool.submit(inheritable_thread_target(spark)(through), k) for k in range(rounds)]
        try:
            for d in done:
                d.result()
        finally:
            pool.shutdown(cancel_futures=True)  # after an error no further round begins
    return spark.read.option("basePath", f"{root}/found").schema(SCHEMA).parquet(f"{root}/found/round=*")


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{n}` {t}" for n, t in df.dtypes)
