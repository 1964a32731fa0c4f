"""Ingest into stores that change in place, with each stage's errors apart, from a table or a stream of filings.

A filing goes through reading, text, tables, facts and chunks. An error of one stage is a struct of the stage and the reason
in the filing's provenance row, and the stages that don't need its result go on: a filing whose facts fail keeps its
chunks. Taking the same filings in again changes nothing. The stream is an extension: the original ingests files once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from quillstone.operators import html, metrics, text
from quillstone.operators.ingest import KEYS, section_chunks
from quillstone.operators.versions import Versioned
from quillstone.sources.tables import save_table


@dataclass
class Stores:
    facts: Versioned
    chunks: Versioned
    provenance: Versioned

    @staticmethod
    def below(spark: SparkSession, root: str, buckets: int = 64, split: int = 1) -> Stores:
        return Stores(
            Versioned(spark, f"{root}/facts", ["ticker", "period", "statement", "metric"], ["ticker"], buckets, split),
            Versioned(spark, f"{root}/chunks", ["chunk_id"], ["doc_id"], buckets, split),
            Versioned(spark, f"{root}/provenance", ["accession_number"], None, buckets),
        )


def staged(filings: DataFrame, html_col: str = "html") -> DataFrame:
    """Each filing with its period, doc_id, plain text, tables and errors, written once. A page is parsed once.

    A null page fails reading. A parser's fault fails text, and with it chunks; one in tables fails facts, and so does a date
    that gives no period. A filing without ticker, form or date has no document id, which fails chunks.
    """
    p = F.col("__p")
    sound = F.coalesce(F.col("date").rlike(r"^\d{4}-\d{2}-\d{2}$"), F.lit(False))
    named = F.col("ticker").isNotNull() & F.col("filing_type").isNotNull() & F.col("date").isNotNull()
    doc = F.when(named, text.document_id(F.col("ticker"), F.col("filing_type"), F.col("date")))
    error = lambda stage, failed, why: F.when(failed, F.struct(F.lit(stage).alias("stage"), why.alias("error")))
    unread = F.col(html_col).isNull()
    errors = F.array(
        error("read", unread, F.lit("no contents")), error("text", p["text_error"].isNotNull(), p["text_error"]), error("facts", p["tables_error"].isNotNull(), p["tables_error"]),
        error("facts", ~unread & ~sound, F.concat(F.lit("no period in the date "), F.coalesce("date", F.lit("null")))), error("chunks", ~unread & doc.isNull(), F.lit("no document id")),
    )
    made = filings.withColumn("__p", html.parsed_or_errors(F.col(html_col)))
    period = F.when(sound, text.fiscal_period(F.col("filing_type"), F.col("date")))
    return save_table(made.select(*KEYS, period.alias("period"), doc.alias("doc_id"), p["text"].alias("plain"), p["tables"].alias("tables"), F.filter(errors, lambda e: e.isNotNull()).alias("errors")), "staged-filings")


def _without(stages: tuple[str, ...]):
    return ~F.exists("errors", lambda e: e["stage"].isin(*stages))


def ingest_into(filings: DataFrame, stores: Stores, canonical: DataFrame | None = None, html_col: str = "html") -> DataFrame:
    """Takes filings (the KEYS and a page) into the stores and gives their provenance rows: counts and errors.

    Facts replace stored ones of the same key (of the filing that comes last by date and accession number), chunks are added
    where their id is new, and a filing's provenance row is replaced. Only touched buckets are written.
    """
    s = staged(filings, html_col)
    found = text.facts_of(s.where(_without(("read", "text", "facts"))), [*KEYS, "period"])
    if canonical is not None:
        found = metrics.in_canonical(found, canonical)
    found = save_table(found, "ingest-facts")
    cut = s.where(_without(("read", "text", "chunks"))).select(*KEYS, "doc_id", F.posexplode(section_chunks(F.col("plain"))).alias("chunk_index", "c")).select(*KEYS, "doc_id", "chunk_index", "c.*")
    cut = save_table(cut.withColumn("chunk_id", text.chunk_id(F.col("doc_id"), F.col("source_path"), F.col("chunk_index"))), "ingest-chunks")
    n_facts = found.groupBy("accession_number").agg(F.count("*").cast("int").alias("sql_row_count"))
    n_chunks = cut.groupBy("accession_number").agg(F.countDistinct("section").cast("int").alias("section_count"), F.count("*").cast("int").alias("chunk_count"))
    rows = s.select(*KEYS, "errors").join(n_facts, "accession_number", "left").join(n_chunks, "accession_number", "left").na.fill(0, ["sql_row_count", "section_count", "chunk_count"])
    rows = save_table(rows, "ingest-provenance")
    if not found.isEmpty():
        stores.facts.upsert(found.select("ticker", "period", "statement", "metric", "value", "raw_value", F.struct("date", "accession_number", "raw_value", "value").alias("__of")), ["__of"])
    if not cut.isEmpty():
        stores.chunks.add(cut.select("chunk_id", "doc_id", "section", "chunk_index", "text"))
    if not rows.isEmpty():
        stores.provenance.upsert(rows, [])
    return rows


def ingest_stream(filings: DataFrame, stores: Stores, checkpoint: str, canonical: DataFrame | None = None, html_col: str = "html") -> StreamingQuery:
    """Takes what is new in a streaming table of filings into the stores and ends. A batch that is run again after a failure
    changes nothing that it had done."""

    def batch(rows: DataFrame, _: int) -> None:
        if not rows.isEmpty():
            ingest_into(rows, stores, canonical, html_col)

    return filings.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
