"""Queries of reference prompts with their contexts, spot checks of rows, and resolution of facts by a mapping file."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillstone.operators import panel, references
from quillstone.plans.domain import CASES, PANEL, frame
from quillstone.plans.registry import _COS, _TIE, _VEC, _XBRL, query
from quillstone.sources.tables import work_folder

# A third of the cases are asked with a value; every fiftieth, that has a vector, with a context. {s} is the SQL's text type.
_ASKED = f"""
SELECT id, category, CASE WHEN id % 11 <> 0 THEN concat('What of ', config, ' in FY', CAST(2000 + id % 25 AS STRING), ' or FY1999?') END AS question,
  CASE WHEN id % 3 = 0 THEN (CASE id % 5 WHEN 0 THEN latency * -1370000.0 WHEN 1 THEN latency * 1370000.0 WHEN 2 THEN latency / 7919.0 WHEN 3 THEN latency * 1.25e10 ELSE latency * 3.0 END) + 0.1234 END AS expected_value, config, latency
FROM ({CASES}) c
"""
_AMOUNT = """CASE WHEN v IS NULL THEN '' WHEN v < 0 AND -v >= 1e9 THEN format('-${:.3f}B (net loss)', -v / 1e9) WHEN v < 0 THEN format('-${:,.0f}', -v) WHEN v >= 1e12 THEN format('${:.3f}T', v / 1e12) WHEN v >= 1e9 THEN format('${:.3f}B', v / 1e9)
WHEN v >= 1e6 THEN format('${:.1f}M', v / 1e6) WHEN v < 1 THEN format('{:.2f}%', v * 100) ELSE format('${:,.2f}', v) END"""


@query(f"""WITH e AS ({_VEC}), a AS (SELECT *, expected_value::DOUBLE AS v, coalesce(question, '') AS q, list_filter([config, 'x' || (id % 4), 'total', 'net'], lambda w: w IS NOT NULL) AS k,
  CASE WHEN contains(lower(category), 'type3') THEN 'Type3' WHEN contains(lower(category), 'type2') AND NOT contains(lower(category), 'type1') THEN 'Type2' ELSE 'Type1' END AS kind FROM ({_ASKED}) c),
s AS (SELECT q.vec_id AS id, c.vec_id AS chunk_id, round({_COS}, 6) AS score FROM e q, e c JOIN documents t ON t.doc_id = c.vec_id WHERE q.vec_id % 50 = 0 AND t.text IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, chunk_id) AS rank FROM s),
x AS (SELECT id, string_agg('[' || trim(concat_ws(' ', coalesce(source, ''), coalesce(lang, ''), '')) || ']' || chr(10) || text[1:600], chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS context FROM r JOIN documents d ON d.doc_id = r.chunk_id WHERE rank <= 5 GROUP BY 1),
t AS (SELECT a.*, context, array_to_string(k, ', ') AS every, array_to_string(k[1:3], ', ') AS three, {_AMOUNT} AS amount FROM a LEFT JOIN x ON x.id = a.id)
SELECT id, kind, CASE WHEN kind <> 'Type3' THEN regexp_extract(q, 'FY[0-9]{{4}}') END AS year, CASE WHEN kind = 'Type1' AND v IS NOT NULL THEN k[1] WHEN kind = 'Type1' THEN three ELSE every END AS key_word, CASE WHEN kind = 'Type1' AND v IS NOT NULL THEN amount END AS prom_answer,
'Question: ' || q || CASE WHEN kind = 'Type1' AND v IS NOT NULL THEN chr(10) || 'Answer: ' || amount || ' (' || v::VARCHAR::DECIMAL(30,4)::VARCHAR || ')' || chr(10) || 'Mention: ' || three || chr(10) || chr(10) || 'Write three full sentences that answer it, each with this very number.'
WHEN kind = 'Type1' THEN chr(10) || 'Mention: ' || every || chr(10) || chr(10) || 'Write three full sentences with the companies, values or ranks that are asked for.'
WHEN kind = 'Type2' AND context IS NOT NULL THEN chr(10) || chr(10) || 'Context:' || chr(10) || context || chr(10) || chr(10) || 'Mention: ' || every || chr(10) || chr(10) || 'Write three answers of two to four sentences from this context alone; say so where it isn''t enough.'
WHEN kind = 'Type2' THEN chr(10) || 'Mention: ' || every || chr(10) || chr(10) || 'Write three answers of two to four sentences.' ELSE chr(10) || 'Mention where it fits: ' || every || chr(10) || chr(10) || 'Write three short replies of an assistant.' END AS prompt FROM t""")
def Y17_reference_prompts(spark, d):
    """All cases; those whose id is a multiple of 50 are the stated set of questions that get a context."""
    # Spark divides by 7919.0 in decimals, cut to six places; DuckDB in doubles.
    words = F.array_compact(F.array("config", F.concat(F.lit("x"), (F.col("id") % 4).cast("string")), F.lit("total"), F.lit("net")))
    cases = frame(spark, d, _ASKED.replace("7919.0", "7919.0D")).withColumn("expected_value", F.col("expected_value").cast("double")).withColumn("keywords", words)
    vectors = spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vec"))
    docs = spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("chunk_id"), "text", F.col("source").alias("company"), F.col("lang").alias("filing_type"), F.lit("").alias("date"))
    asked = vectors.where("chunk_id % 50 = 0").select(F.col("chunk_id").alias("query_id"), F.col("vec").alias("qvec"))
    return references.reference_prompts(cases, references.cited_contexts(asked, vectors.join(docs, "chunk_id"), 5, 600, decimals=6))


_NUMBERS = ["total_revenue", "net_income", "current_ratio", "roa"]


@query(f"WITH p AS ({PANEL}), c AS ({' UNION ALL '.join(f"SELECT ticker, year, '{c}' AS col, {c} AS v FROM p" for c in _NUMBERS)}) SELECT ticker, year, col, CASE WHEN v IS NULL THEN 'NULL' WHEN abs(v) > 1e6 THEN format('{{:,.0f}}', v) ELSE format('{{:.4f}}', v) END AS shown FROM c")
def Y21_spot_checks(spark, d):
    """All rows of the panel are wanted."""
    p = frame(spark, d, PANEL).select("ticker", "year", *_NUMBERS)
    return references.spot_checks(p, p)


@query(f"""WITH m AS (SELECT DISTINCT 'col' || (l_partkey % 7 // 2) AS col, 'C' || (l_partkey % 7) AS concept, l_partkey % 7 % 2 AS rank FROM lineitem), x AS ({_XBRL}),
r AS (SELECT x.*, m.col, row_number() OVER (PARTITION BY ticker, fy, m.col ORDER BY m.rank, form = '10-K/A' DESC, filed DESC, pos DESC, {', '.join(t + ' DESC' for t in _TIE)}) AS n FROM x JOIN m ON x.concept = m.concept WHERE fp = 'FY')
SELECT ticker, fy, col, concept, val FROM r WHERE n = 1""")
def P7_P10_mapped_resolution(spark, d):
    """The mapping is a file, made of the concepts that the facts have: two a column, the even one first."""
    at = work_folder(spark, "mapping-of-facts")
    k = F.col("l_partkey") % 7
    concepts = spark.read.parquet(f"{d}/lineitem.parquet").select(k.alias("k")).distinct().groupBy(F.concat(F.lit("col"), F.expr("k div 2")).alias("name"))
    entries = concepts.agg(F.array_sort(F.collect_list(F.concat(F.lit("C"), "k"))).alias("xbrl_concepts")).withColumn("e", F.struct("name", F.struct(F.lit("income_statement").alias("statement"), "xbrl_concepts", F.lit("USD").alias("xbrl_unit"))))
    entries.agg(F.to_json(F.struct(F.map_from_entries(F.collect_list("e")).alias("panel_columns"))).alias("value")).write.text(at)
    return panel.resolve_xbrl(frame(spark, d, _XBRL), panel.read_mapping(spark, at).select("col", "concept", "unit", "rank"), _TIE)
