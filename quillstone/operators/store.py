"""Store operations: replace on conflict, filtered reads, pivots, chunk collections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.operators.sizes import numbered


def upsert(old: DataFrame, new: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Rows of ``new`` replace those of ``old`` with the same key, null values too; of repeated keys in ``new`` the row
    that comes last by ``order`` stays."""
    both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)), allowMissingColumns=True)
    latest = Window.partitionBy(*key).orderBy(F.desc("__new"), *map(F.desc, order))
    return both.withColumn("__n", F.row_number().over(latest)).where("__n = 1").drop("__n", "__new")


def query_facts(facts: DataFrame, ticker: str | None = None, period_like: str | None = None, statement: str | None = None, metric_like: str | None = None) -> DataFrame:
    """Optional conditions joined by AND; patterns ignore case as SQLite's LIKE does."""
    for c, value, like in (("ticker", ticker, False), ("period", period_like, True), ("statement", statement, False), ("metric", metric_like, True)):
        if value is not None:
            facts = facts.where(F.col(c).ilike(value) if like else F.col(c) == value)
    return facts


def pivot_periods(facts: DataFrame, periods: list[str] | None = None) -> DataFrame:
    """A column a period: the given ones, or all that the facts have, which are few."""
    return facts.groupBy("ticker", "statement", "metric").pivot("period", periods).agg(F.first("value", ignorenulls=True))


def stats(facts: DataFrame, filings: DataFrame) -> DataFrame:
    return facts.agg(F.count("*").alias("n_facts"), F.countDistinct("ticker").alias("n_tickers")).crossJoin(filings.agg(F.count("*").alias("n_filings")))


def add_chunks(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Only chunks whose id isn't stored, each id once."""
    return new.dropDuplicates(["chunk_id"]).join(stored.select("chunk_id"), "chunk_id", "left_anti")


def latest_per_key(rows: DataFrame, key: list[str], order: list) -> DataFrame:
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("__n = 1").drop("__n")


def hash_split(key: Column, share: float) -> Column:
    """True for about ``share`` of the keys, the same ones in every run and partitioning; null keys are outside."""
    part = F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("long")
    return F.coalesce(part < int(share * (1 << 32)), F.lit(False))


def upsert_filings(old: DataFrame, new: DataFrame, order: list[str], counters: tuple[str, ...] = ("section_count", "chunk_count", "sql_row_count")) -> DataFrame:
    """Replaces filings by accession number; counters that a row lacks are 0."""
    merged = upsert(old, new, ["accession_number"], order)
    return merged.select("*", *(F.lit(0).alias(c) for c in counters if c not in merged.columns)).na.fill(0, list(counters))


def upsert_canonical(old: DataFrame, new: DataFrame, order: list[str]) -> DataFrame:
    """Canonical metrics replaced by metric."""
    return upsert(old, new, ["metric"], order)


def ranked_canonical(stored: DataFrame) -> DataFrame:
    """Canonical metrics by falling share of companies (ties: metric), with their rank."""
    return numbered(stored.withColumn("__less", -F.col("ticker_pct")), ["__less", "metric"], "rank").drop("__less")


def chunk_filter(ticker: str | None = None, doc_type: str | None = None, filing_date_gte: str | None = None, section: str | None = None) -> Column:
    """The chunks that vector search looks at; dates are compared as strings."""
    keep = F.lit(True)
    for c, v in (("ticker", ticker), ("doc_type", doc_type), ("section", section)):
        keep = keep if v is None else keep & (F.col(c) == v)
    return keep if filing_date_gte is None else keep & (F.col("filing_date") >= filing_date_gte)


def delete_by_ticker(chunks: DataFrame, ticker: str) -> tuple[DataFrame, DataFrame]:
    """The chunks that stay, and one row with the number of those deleted; null tickers stay."""
    gone = F.coalesce(F.col("ticker") == ticker, F.lit(False))
    return chunks.where(~gone), chunks.agg(F.count_if(gone).alias("n_deleted"))
