"""Filing sources: a directory tree of filings, company-facts JSON, and form listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_FACT = "struct<fy:int, fp:string, form:string, filed:string, end:string, val:double>"
FACTS_SCHEMA = f"facts struct<`us-gaap`:map<string, struct<units:map<string, array<{_FACT}>>>>>"


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, length) of every file below ``root``; contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length")


def filing_directory(name: Column) -> Column:
    """``DATE_ACC`` as (date, accession_number), told by the places of the hyphens; other names give null."""
    pattern = F.lit(r"^(.{4}-.{2}-.{2})_(.*)$")
    parts = F.struct(F.regexp_extract(name, r"^(.{4}-.{2}-.{2})_(.*)$", 1).alias("date"), F.regexp_extract(name, r"^(.{4}-.{2}-.{2})_(.*)$", 2).alias("accession_number"))
    return F.when(F.regexp_like(name, pattern), parts)


def read_company_map(spark: SparkSession, path: str) -> DataFrame:
    """(ticker, company) of sidecar files that are each one JSON object of names by ticker; of repeated tickers the first name."""
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string, string>")).alias("ticker", "company"))
    return rows.groupBy("ticker").agg(F.min("company").alias("company"))


def with_companies(rows: DataFrame, companies: DataFrame) -> DataFrame:
    """``rows`` with the company of their ticker; tickers that have none name themselves."""
    return rows.join(companies.select("ticker", "company"), "ticker", "left").withColumn("company", F.coalesce("company", "ticker"))


def walk_filings(files: DataFrame, companies: DataFrame | None = None, tickers: list[str] | None = None, forms: list[str] | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """One row a filing from the (path, length) of ``.../TICKER/FORM/DATE_ACC/file``; dates are inclusive strings.

    The primary file is the largest HTML file, else the first PDF; ties go by path. The choice is a partial aggregate,
    so folders with many files cost no sort. ``companies`` (ticker, company) names tickers; others name themselves.
    """
    at = F.split("path", "/")
    rows = files.select("path", "length", *(F.element_at(at, -k).alias(n) for k, n in ((4, "ticker"), (3, "filing_type"), (2, "dir"), (1, "file"))))
    rows = rows.where(F.col("ticker") != "NEWS").withColumn("d", filing_directory(F.col("dir"))).where("d is not null").select("path", "length", "ticker", "filing_type", "dir", "file", "d.*")
    for column, values in (("ticker", tickers), ("filing_type", forms)):
        if values is not None:
            rows = rows.where(F.col(column).isin(values))
    rows = rows.where(F.col("date") >= start) if start else rows
    rows = rows.where(F.col("date") <= end) if end else rows
    html, pdf = F.lower("file").rlike(r"\.html?$"), F.lower("file").rlike(r"\.pdf$")
    order = F.struct((~html).alias("not_html"), F.when(html, -F.col("length")).alias("size"), "path")
    picked = rows.where(html | pdf).groupBy("ticker", "filing_type", "date", "accession_number").agg(F.min_by("path", order).alias("source_path"))
    if companies is None:
        return picked.withColumn("company", F.col("ticker"))
    return with_companies(picked, companies)


def company_facts(documents: DataFrame) -> DataFrame:
    """Facts of (ticker, json) documents: one row a value with its concept, unit and place in its array.

    What isn't JSON of that form gives no rows. A document is parsed once: an inner explode would first be turned into a
    condition on its input, which parses it again.
    """
    parsed = documents.select("ticker", F.from_json("json", FACTS_SCHEMA)["facts"]["us-gaap"].alias("concepts"))
    units = parsed.select("ticker", F.explode_outer("concepts").alias("concept", "c")).where("concept is not null").select("ticker", "concept", F.explode("c.units").alias("unit", "values"))
    return units.select("ticker", "concept", "unit", F.posexplode("values").alias("pos", "v")).select("ticker", "concept", "unit", "pos", "v.*")


def listed_filings(pages: DataFrame, forms: list[str], start: str, end: str) -> DataFrame:
    """Listing pages with parallel arrays (form, date, accession, document) as rows, by form and inclusive dates."""
    names = ["form", "date", "accession", "document"]
    others = [c for c in pages.columns if c not in names]
    rows = pages.select(*others, F.inline(F.arrays_zip(*names)))
    return rows.where(F.col("form").isin(forms) & F.col("date").between(start, end))


def padded_cik(cik: Column) -> Column:
    digits = cik.cast("string")
    return F.when(F.length(digits) >= 10, digits).otherwise(F.lpad(digits, 10, "0"))
