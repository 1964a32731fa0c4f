import os

import pytest
from pyspark.sql import functions as F

from quillstone.operators import html, reingest

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


def filings(spark):
    p = spark.read.parquet(f"{SF}/pages.parquet")
    table = "<h2>Item 1. Business</h2><p>We sell things.</p><h2>Item 7. Results</h2><table><tr><td>Total revenue</td><td>1,250</td></tr><tr><td>Net income</td><td>(30)</td></tr><tr><td>Gross profit of operations</td><td>7</td></tr></table>"
    page = F.when(F.col("page_id") % 10 == 9, F.lit(None)).otherwise(F.concat("html", F.lit(table)))
    date = F.when(F.col("page_id") % 10 == 8, "soon").when(F.col("page_id") % 10 == 7, F.lit(None)).otherwise(F.concat(F.lit("20"), F.lpad(F.col("page_id") % 25, 2, "0"), F.lit("-12-31")))
    return p.select("page_id", F.concat(F.lit("T"), F.col("page_id") % 4).alias("ticker"), F.lit("10-K").alias("filing_type"), date.alias("date"), F.col("page_id").cast("string").alias("accession_number"), "url", page.alias("html")).withColumnRenamed("url", "source_path")


def rows(df):
    return sorted((tuple(r) for r in df.select(*sorted(df.columns)).collect()), key=str)


def test_a_stream_of_pages_fills_the_stores_as_one_ingest_does_and_twice_changes_nothing(spark, tmp_path):
    once = reingest.Stores.below(spark, f"file://{tmp_path}/once", buckets=2)
    made = filings(spark).where("page_id < 30")
    told = {r.accession_number: r for r in reingest.ingest_into(made, once).collect()}
    assert len(told) == 30
    for k, r in told.items():
        stages = [e.stage for e in r.errors]
        assert stages == {9: ["read"], 8: ["facts"], 7: ["facts", "chunks"]}.get(int(k) % 10, [])
        assert (r.chunk_count > 0) == (int(k) % 10 not in (7, 9)) and (r.sql_row_count > 0) == (int(k) % 10 < 7)
        assert r.section_count > 1 or r.chunk_count == 0  # more than one heading a page
    facts, chunks = rows(once.facts.read()), rows(once.chunks.read())
    assert any(r.metric == "Total revenue" and r.value == 1250.0 for r in once.facts.read().collect())
    reingest.ingest_into(made, once)
    assert rows(once.facts.read()) == facts and rows(once.chunks.read()) == chunks
    source, streamed = f"{tmp_path}/in", reingest.Stores.below(spark, f"file://{tmp_path}/streamed", buckets=2)
    for k in (0, 1, 0):  # the first half comes again
        made.where(F.col("accession_number").cast("int") % 2 == k).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(made.schema).parquet(source)
        reingest.ingest_stream(stream, streamed, f"file://{tmp_path}/checkpoint").awaitTermination()
    assert rows(streamed.facts.read()) == facts and rows(streamed.chunks.read()) == chunks
    assert rows(streamed.provenance.read()) == rows(once.provenance.read())


def test_a_fault_of_one_page_is_an_error_of_its_own(spark, monkeypatch):
    deep = "<table><tr><td>" * 400 + "x"
    df = spark.createDataFrame([(1, "<p>fine</p>"), (2, deep), (3, None), (4, ""), (5, "<![bad[x"), (6, "<table><tr><td>a</td></tr><tr><td>b</td></tr></table>")], "i int, html string")
    got = {r.i: r.p for r in df.select("i", html.parsed_or_errors(F.col("html")).alias("p")).collect()}
    assert got[1].text == "fine" and got[1].text_error is None and got[3].text is None and got[6].tables == [[["a"], ["b"]]]
    assert got[2].text == "x" and got[2].tables == [] and "too many cells" in got[2].tables_error
    assert set(got) == {1, 2, 3, 4, 5, 6}
