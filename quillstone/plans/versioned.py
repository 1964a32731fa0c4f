"""Queries over stores that change in place, over the index that stays, over several queries a question, and percentiles of what is sound."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillstone.operators import evaluation, reingest, retrieval
from quillstone.operators.lexical_index import LexicalIndex
from quillstone.operators.vector_index import VectorIndex
from quillstone.operators.versions import Versioned
from quillstone.plans.domain import FACTS, PANEL, facts, frame
from quillstone.plans.extraction import _filing_pages
from quillstone.plans.registry import _BM25, _COS, _DENSE, _FUSED, _VEC, _chunks, _questions, _vectors, query
from quillstone.sources.tables import save_table, work_folder

KEY = ["ticker", "period", "statement", "metric"]
FA = f"({FACTS})"


@query(f"WITH f AS {FA} SELECT ticker, period, statement, metric, CASE WHEN ticker <> 'S1' THEN value WHEN period = 'FY1999' THEN NULL ELSE value * 2 END AS value FROM f")
def U1_store_merge(spark, d):
    """Facts of one ticker replace stored ones: the last of each key counts, and only that ticker's bucket is written."""
    stored = Versioned(spark, work_folder(spark, "facts-store"), KEY, by=["ticker"], buckets=16)
    old = facts(spark, d).drop("unit")
    stored.upsert(old, [])
    one = old.where("ticker = 'S1'")
    new = one.withColumn("value", F.when(F.col("period") != "FY1999", F.col("value") * 2)).withColumn("seq", F.lit(1))
    stored.upsert(new.unionByName(one.withColumn("seq", F.lit(0))), ["seq"])
    return stored.read().select(*KEY, "value")


@query("SELECT source AS ticker, doc_id FROM documents WHERE source IS DISTINCT FROM 'src0' AND source IS NOT NULL")
def U13_store_delete(spark, d):
    stored = Versioned(spark, work_folder(spark, "chunk-store"), ["doc_id"], by=["ticker"], buckets=8, split=4)
    stored.replace(spark.read.parquet(f"{d}/documents.parquet").where("source is not null").select(F.col("source").alias("ticker"), "doc_id"))
    stored.delete(ticker="src0")
    return stored.read().select("ticker", "doc_id")


@query(f"SELECT ticker, year, net_margin FROM ({PANEL}) p WHERE year <> 'FY1997'")
def S14_store_replace(spark, d):
    """A table in place of the old one; readers of the old version go on with its files."""
    rows = frame(spark, d, PANEL).select("ticker", "year", "net_margin")
    stored = Versioned(spark, work_folder(spark, "panel-store"), ["ticker", "year"], buckets=8)
    stored.replace(rows.where("year = 'FY1997'"))
    stored.replace(rows.where("year <> 'FY1997'"))
    return stored.read().select(*rows.columns)


@query(f"WITH {_BM25} SELECT query_id, chunk_id, score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 20")
def R4_R5_stored_index(spark, d):
    """Built in two additions; then a seventh of the chunks is taken out and added again."""
    chunks = _chunks(spark, d)
    index = LexicalIndex(spark, work_folder(spark, "lexical-index"), buckets=8)
    index.add(chunks.where("chunk_id % 2 = 0"))
    index.add(chunks.where("chunk_id % 2 = 1"))
    some = chunks.where("chunk_id % 7 = 3")
    index.remove(some)
    index.add(some)
    return index.search(_questions(spark, d).select("query_id", "text"), 20).select("query_id", "chunk_id", "score", "rank")


_TERMS = "list_distinct(regexp_extract_all(lower(coalesce({}, '')), '([a-z0-9_]{{2,}})', 1))"


@query(f"""WITH {_BM25}, {_DENSE}, {_FUSED.format(k=20)}, m AS (SELECT query_id // 2 AS question_id, chunk_id, max(rrf_score) AS rrf_score FROM f GROUP BY 1, 2),
o AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY rrf_score DESC, chunk_id) AS rank FROM m), a AS (SELECT query_id // 2 AS question_id, arg_min(text, query_id) AS text FROM q GROUP BY 1),
x AS (SELECT o.question_id, o.chunk_id, o.rrf_score, coalesce(len(list_intersect({_TERMS.format('a.text')}, {_TERMS.format('d.text')})) / nullif(len({_TERMS.format('a.text')}), 0), 0) AS x FROM o JOIN a USING (question_id) JOIN documents d ON d.doc_id = o.chunk_id WHERE rank <= 25),
z AS (SELECT *, min(x) OVER (PARTITION BY question_id) AS lo, max(x) OVER (PARTITION BY question_id) AS hi FROM x) SELECT question_id, chunk_id, round(rrf_score, 9) AS rrf_score, round(CASE WHEN hi = lo THEN 1 ELSE (x - lo) / (hi - lo) END, 9)::DOUBLE AS relevance FROM z""")
def R13_multi_rerank(spark, d):
    """Two queries a question, merged, and scored against the first of them."""
    q = _questions(spark, d).withColumn("question_id", F.expr("query_id div 2"))
    corpus = _chunks(spark, d).join(_vectors(spark, d), "chunk_id", "left").select("chunk_id", "text", "vec")
    alone = _vectors(spark, d).join(_chunks(spark, d), "chunk_id", "left_anti").select("chunk_id", F.lit(None).cast("string").alias("text"), "vec")
    found = retrieval.multi_candidates(q, corpus.union(alone), k=20, filters=False, cap=25)
    return found.where("text is not null").select("question_id", "chunk_id", F.round("rrf_score", 9).alias("rrf_score"), F.round("relevance", 9).alias("relevance"))


@query("""WITH e AS (SELECT event_type, CASE WHEN event_id % 11 = 0 THEN 'nan'::DOUBLE WHEN event_id % 13 = 0 THEN 'inf'::DOUBLE WHEN event_id % 17 = 0 THEN 1000001 ELSE value END AS v FROM events),
s AS (SELECT event_type, list_sort(list(v)) AS l FROM e WHERE v IS NOT NULL AND isfinite(v) AND v <= 1e6 GROUP BY 1) SELECT event_type, l[least(CAST(floor(len(l) * 0.5) AS BIGINT), len(l) - 1) + 1] AS p50, l[least(CAST(floor(len(l) * 0.9) AS BIGINT), len(l) - 1) + 1] AS p90 FROM s""")
def A13_sound_percentiles(spark, d):
    bad = F.when(F.col("event_id") % 11 == 0, float("nan")).when(F.col("event_id") % 13 == 0, float("inf")).when(F.col("event_id") % 17 == 0, 1000001.0)
    rows = spark.read.parquet(f"{d}/events.parquet").select("event_type", bad.otherwise(F.col("value")).alias("v"))
    return evaluation.percentiles(rows, "event_type", "v", {"p50": 0.5, "p90": 0.9}, most=1e6)


@query(f"""WITH p AS ({PANEL}) SELECT concat(ticker, '-', year) AS accession_number, CASE year WHEN 'FY1998' THEN 'read: no contents' WHEN 'FY1996' THEN 'facts: no period in the date soon' ELSE '' END AS errors,
CASE WHEN year IN ('FY1996', 'FY1998') THEN 0 WHEN year = 'FY1995' THEN 1 ELSE 6 END AS sql_row_count, CASE WHEN year = 'FY1998' THEN 0 ELSE 1 END AS chunk_count, CASE WHEN year IN ('FY1996', 'FY1998') THEN 0 WHEN year = 'FY1995' THEN 1 ELSE 6 END::BIGINT AS stored_facts FROM p""")
def U14_errors_by_stage(spark, d):
    """Taken in twice: pages of FY1998 can't be read; those of FY1996 have no date, so no facts, and keep their chunks."""
    pages = _filing_pages(spark, d)
    date = F.when(F.col("period") == "FY1996", "soon").otherwise(F.concat(F.substring("period", 3, 4), F.lit("-12-31")))
    number, page = F.concat("ticker", F.lit("-"), "period"), F.when(F.col("period") != "FY1998", F.col("html"))
    made = save_table(pages.select("ticker", F.lit("10-K").alias("filing_type"), date.alias("date"), number.alias("accession_number"), F.concat(F.lit("/data/"), number).alias("source_path"), page.alias("html")), "pages")
    stores = reingest.Stores.below(spark, work_folder(spark, "ingested"), buckets=8)
    for _ in range(2):
        reingest.ingest_into(made, stores)
    kept = stores.facts.read().groupBy(F.concat("ticker", F.lit("-"), "period").alias("accession_number")).agg(F.count("*").alias("stored_facts"))
    shown = F.array_join(F.transform("errors", lambda e: F.concat(e["stage"], F.lit(": "), e["error"])), "; ")
    return stores.provenance.read().join(kept, "accession_number", "left").select("accession_number", shown.alias("errors"), "sql_row_count", "chunk_count", F.coalesce("stored_facts", F.lit(0)).cast("long").alias("stored_facts"))


@query(f"WITH e AS ({_VEC}), s AS (SELECT q.vec_id AS query_id, c.vec_id AS chunk_id, round({_COS}, 6) AS score FROM e q, e c WHERE q.vec_id % 50 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM s) SELECT query_id, chunk_id, score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 20")
def R3_U11_vector_index(spark, d):
    """Built from two thirds of the vectors; the others are added."""
    vectors = _vectors(spark, d)
    index = VectorIndex(spark, work_folder(spark, "vector-index"))
    index.build(vectors.where("chunk_id % 3 <> 0"))
    index.add(vectors.where("chunk_id % 3 = 0"))
    asked = vectors.where("chunk_id % 50 = 0").select(F.col("chunk_id").alias("query_id"), F.col("vec").alias("qvec"))
    return index.search(asked, 20, decimals=6)
