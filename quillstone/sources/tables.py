"""Files of rows: JSON lines, JSON arrays, CSV and Parquet tables; names, types and first rows of a table."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path below spark.checkpoint.dir; where that is unset and the master is local, below a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("a cluster needs spark.checkpoint.dir, a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-quillstone-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def save_table(df: DataFrame, name: str, file_rows: int = 0) -> DataFrame:
    """Writes a table to the shared folder and reads it back: lineage ends here and lost executors cost no rework.

    ``file_rows`` bounds a file's rows, and so those of a task that reads the table: a scan counts each file as 4 MB more than it has
    (``spark.sql.files.openCostInBytes``), so 32 files at most fill a task's 128 MB, however well their rows compress.
    """
    at = work_folder(df.sparkSession, name)
    df.write.option("maxRecordsPerFile", file_rows).parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One object a line with a stated schema, so that nothing is read to infer it; blank lines are skipped."""
    return spark.read.schema(schema).json(path)


def read_json_arrays(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The objects of files that each hold one array; a file is read whole, so these are to be small."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def write_json_arrays(df: DataFrame, path: str, rows: int = 10_000) -> None:
    """Files of one JSON array each: a file for each part of the table, of about ``rows`` rows so that readers can hold it. A reader
    takes the first array of a file alone, so no file gets two, however the parts are dealt to tasks."""
    parts = -(-max(1, df.count()) // rows)
    line = F.to_json(F.struct(*(F.col(f"`{c}`") for c in df.columns)), {"ignoreNullFields": "false"})
    dealt = df.select(line.alias("line")).withColumn("part", F.pmod(F.xxhash64("line"), F.lit(parts)))
    arrays = dealt.groupBy("part").agg(F.concat(F.lit("["), F.array_join(F.collect_list("line"), ","), F.lit("]")).alias("value"))
    arrays.repartition(parts, "part").select("value").write.option("lineSep", "\n").option("maxRecordsPerFile", 1).text(path)


def write_json_lines(df: DataFrame, path: str) -> None:
    """One object a line in UTF-8; null fields stay as nulls."""
    df.write.option("ignoreNullFields", False).json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header in each file; quotes are doubled and nulls are empty fields."""
    df.write.option("header", True).option("escape", '"').csv(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What ``write_csv`` wrote, line ends inside of fields included; an empty text comes back as null, as in any CSV."""
    return spark.read.schema(schema).option("header", True).option("escape", '"').option("multiLine", True).csv(path)


def replace_table(df: DataFrame, path: str) -> None:
    """The table's whole contents are replaced."""
    df.write.mode("overwrite").parquet(path)


def describe(df: DataFrame) -> DataFrame:
    """One row per column: its position, name, type and number of values, by one pass over the table."""
    counts = df.agg(F.array(*(F.struct(F.lit(i).alias("position"), F.lit(n).alias("name"), F.lit(t).alias("type"), F.count(F.col(f"`{n}`")).alias("n_values")) for i, (n, t) in enumerate(df.dtypes))).alias("c"))
    return counts.select(F.explode("c").alias("c")).select("c.*")
