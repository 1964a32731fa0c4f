"""The ingest of filings as one declarative job graph: facts, sections, chunks, provenance, with the errors of each part apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.operators import html, metrics, store, text
from quillstone.sources.tables import save_table

KEYS = ["ticker", "filing_type", "date", "accession_number", "source_path"]


def section_chunks(plain: Column, size: int = 512, overlap: int = 64) -> Column:
    """array<struct<section, text>>: the chunks of each section, in the order of sections; their places are the chunk indices."""
    of = lambda s: F.transform(text.chunks(s["text"], size, overlap), lambda c: F.struct(s["section"].alias("section"), c.alias("text")))
    return F.flatten(F.transform(text.sections(plain), of))


def parsed_filings(filings: DataFrame, html_col: str = "html") -> DataFrame:
    """Text and tables of each filing from one pass of the parser, written once; a null page is an error of its own row."""
    page = html.parsed(F.col(html_col))
    made = filings.withColumn("__p", page).select(*KEYS, F.col("__p.text").alias("plain"), F.col("__p.tables").alias("tables"), F.when(F.col(html_col).isNull(), "no contents").alias("error"))
    return save_table(made, "parsed-filings")


def ingest(filings: DataFrame, facts: DataFrame, chunks: DataFrame, provenance: DataFrame, canonical: DataFrame | None = None, html_col: str = "html", batch: int = 1) -> dict[str, DataFrame]:
    """The stores after an ingest and a summary.

    ``facts`` has (ticker, period, statement, metric, value, raw_value), ``chunks`` (chunk_id, doc_id, section, chunk_index,
    text) and ``provenance`` a row a filing. Facts are limited to ``canonical`` metrics where these are given, and replace
    stored ones of the same key; chunks that are stored stay. A filing without contents adds nothing but its provenance
    row, which names the error. The parsed filings are written once and every store comes from that table.
    """
    parsed = parsed_filings(filings, html_col)
    period = text.fiscal_period(F.col("filing_type"), F.col("date"))
    found = text.facts_of(parsed.withColumn("period", period).where("error is null"), [*KEYS, "period"])
    if canonical is not None:
        found = metrics.in_canonical(found, canonical)
    found = save_table(found, "ingest-facts")
    new_facts = found.select("ticker", "period", "statement", "metric", "value", "raw_value", F.lit(batch).alias("seq"), F.col("accession_number").alias("of"))
    key = ["ticker", "period", "statement", "metric"]
    stored = store.upsert(facts.withColumn("seq", F.lit(0)).withColumn("of", F.lit("")), new_facts, key, ["seq", "of", "value", "raw_value"]).select(*key, "value", "raw_value")
    doc = text.document_id(F.col("ticker"), F.col("filing_type"), F.col("date"))
    cut = parsed.where("error is null").select(*KEYS, doc.alias("doc_id"), F.posexplode(section_chunks(F.col("plain"))).alias("chunk_index", "c")).select(*KEYS, "doc_id", "chunk_index", "c.*")
    cut = save_table(cut.withColumn("chunk_id", text.chunk_id(F.col("doc_id"), F.col("source_path"), F.col("chunk_index"))), "ingest-chunks")
    added = store.add_chunks(chunks, cut.select("chunk_id", "doc_id", "section", "chunk_index", "text"))
    n_facts = found.groupBy("accession_number").agg(F.count("*").cast("int").alias("sql_row_count"))
    n_chunks = cut.groupBy("accession_number").agg(F.countDistinct("section").cast("int").alias("section_count"), F.count("*").cast("int").alias("chunk_count"))
    rows = parsed.select(*KEYS, "error").join(n_facts, "accession_number", "left").join(n_chunks, "accession_number", "left").withColumn("seq", F.lit(batch))
    filed = store.upsert_filings(provenance.withColumn("seq", F.lit(0)), rows, ["seq"]).drop("seq")
    total = lambda d, n: d.agg(F.count("*").alias(n))
    summary = total(parsed, "filings").crossJoin(parsed.agg(F.count("error").alias("errors"))).crossJoin(total(found, "facts")).crossJoin(total(cut, "chunks")).crossJoin(total(added, "added"))
    return {"facts": stored, "chunks": chunks.unionByName(added, allowMissingColumns=True), "provenance": filed, "summary": summary}
