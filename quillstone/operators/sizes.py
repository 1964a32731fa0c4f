"""Joins by broadcast only behind a count, and numbers of rows in an order without one task for all."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def broadcast_if_small(table: DataFrame, rows: int = 10_000) -> DataFrame:
    """Hints at a broadcast where a count shows at most ``rows`` rows; otherwise the join shuffles as usual."""
    return F.broadcast(table) if table.limit(rows + 1).count() <= rows else table


def numbered(table: DataFrame, order: list[str], name: str) -> DataFrame:
    """Adds each row's number from 1 in the order of some columns, which are to tell all rows apart. Rows are dealt to ranges of
    the order; each range numbers its own, after the counts of those before it."""
    from quillstone.sources.tables import save_table

    dealt = table.repartitionByRange(*order).withColumn("__range", F.spark_partition_id())
    ranges = save_table(dealt, "ranges")
    counts = ranges.groupBy("__range").agg(F.count("*").alias("__n"))
    before = counts.withColumn("__before", F.coalesce(F.sum("__n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row a range
    own = F.row_number().over(Window.partitionBy("__range").orderBy(*order))
    return ranges.withColumn("__own", own).join(F.broadcast(before), "__range").withColumn(name, (F.col("__before") + F.col("__own")).cast("int")).drop("__range", "__own", "__n", "__before")
