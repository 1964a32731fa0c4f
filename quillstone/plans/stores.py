"""Queries of stores, vector search, ingest, the SQL surface's records and evaluation runs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillstone import sqlsurface
from quillstone.operators import evaluation as ev
from quillstone.operators import ingest, metrics, panel, retrieval, runs, store, text
from quillstone.plans.domain import CASES, FACTS, FILINGS, PANEL, facts, frame
from quillstone.plans.extraction import _filing_pages
from quillstone.plans.registry import _COS, _VEC, query
from quillstone.sources import filings, tables

P, FA, FI, CA = (f"({x}) " for x in (PANEL, FACTS, FILINGS, CASES))


def _read(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


# Sources.
@query("SELECT o_orderkey, CASE WHEN o_custkey % 2 = 0 THEN coalesce(c_name, concat('C', CAST(o_custkey AS STRING))) ELSE concat('C', CAST(o_custkey AS STRING)) END AS company FROM orders LEFT JOIN customer ON c_custkey = o_custkey")
def S4_company_map(spark, d):
    at = tables.work_folder(spark, "company-map")
    named = _read(spark, d, "customer").where("c_custkey % 2 = 0").select(F.concat(F.lit("C"), "c_custkey").alias("ticker"), F.col("c_name").alias("company"))
    named.groupBy(F.col("ticker").substr(-1, 1).alias("part")).agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("ticker", "company")))).alias("value")).write.partitionBy("part").text(at)
    asked = _read(spark, d, "orders").select("o_orderkey", F.concat(F.lit("C"), "o_custkey").alias("ticker"))
    return filings.with_companies(asked, filings.read_company_map(spark, at)).select("o_orderkey", "company")


@query(f"SELECT ticker, year, total_revenue FROM {P} p")
def S12_json_arrays(spark, d):
    at = tables.work_folder(spark, "panel-arrays")
    tables.write_json_arrays(frame(spark, d, PANEL).select("ticker", "year", "total_revenue"), at)
    return tables.read_json_arrays(spark, at, "ticker string, year string, total_revenue double")


@query("SELECT c_custkey, lpad(CAST(c_custkey * 3 AS STRING), 10, '0') AS cik FROM customer")
def Y22_required_cik(spark, d):
    c = _read(spark, d, "customer")
    registry = c.select(F.concat(F.lit("T"), "c_custkey").alias("ticker"), (F.col("c_custkey") * 3).alias("cik"))
    return runs.with_cik(c.select("c_custkey", F.concat(F.lit("t"), "c_custkey").alias("ticker")), registry).select("c_custkey", "cik")


# Stores.
_CANON = "SELECT source AS metric, lang AS statement, count(*) AS ticker_count, count(*) / 1000.0::DOUBLE AS ticker_pct FROM documents GROUP BY 1, 2"


@query("WITH o AS (SELECT source AS metric, count(*)::DOUBLE AS ticker_pct FROM documents GROUP BY 1), n AS (SELECT source AS metric, count(*) / 2 AS ticker_pct FROM documents WHERE lang = 'en' GROUP BY 1), u AS (SELECT * FROM n UNION ALL SELECT * FROM o WHERE metric NOT IN (SELECT metric FROM n)) SELECT metric, ticker_pct, CAST(row_number() OVER (ORDER BY ticker_pct DESC, metric) AS INTEGER) AS rank FROM u")
def U8_canonical_metrics(spark, d):
    docs = _read(spark, d, "documents")
    old = docs.groupBy(F.col("source").alias("metric")).agg(F.count("*").cast("double").alias("ticker_pct")).withColumn("seq", F.lit(0))
    new = docs.where("lang = 'en'").groupBy(F.col("source").alias("metric")).agg((F.count("*") / 2).alias("ticker_pct")).withColumn("seq", F.lit(1))
    return store.ranked_canonical(store.upsert_canonical(old, new, ["seq"]).select("metric", "ticker_pct"))


_CHUNKS = "SELECT d.doc_id AS chunk_id, d.source AS ticker, d.lang AS doc_type, concat(CAST(2015 + d.doc_id % 10 AS STRING), '-06-30') AS filing_date, concat('Item ', CAST(d.doc_id % 3 AS STRING)) AS section, d.text, e.embedding FROM documents d JOIN embeddings e ON d.doc_id = e.vec_id"


def _stored(spark, d):
    return frame(spark, d, _CHUNKS).withColumnRenamed("embedding", "vec")


@query(f"WITH c AS ({_CHUNKS}), q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 7), s AS (SELECT chunk_id, round(1 - {_COS.replace('c.v', 'c.embedding::DOUBLE[]')}, 6) AS distance FROM c, q WHERE doc_type = 'en' AND filing_date >= '2017-06-30' AND section = 'Item 1') SELECT chunk_id, distance FROM s ORDER BY distance, chunk_id LIMIT 5")
def U11_vector_search(spark, d):
    q = _read(spark, d, "embeddings").where("vec_id = 7").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qvec"))
    found = retrieval.dense_top_k(q, _stored(spark, d).where(store.chunk_filter(doc_type="en", filing_date_gte="2017-06-30", section="Item 1")), 5, decimals=6)
    return found.select("chunk_id", F.round(1 - F.col("score"), 6).alias("distance"))


@query(f"WITH c AS ({_CHUNKS}), q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 50 = 0), s AS (SELECT query_id, chunk_id, round({_COS.replace('c.v', 'c.embedding::DOUBLE[]')}, 6) AS score FROM c, q), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS n FROM s) SELECT chunk_id, round(min(1 - score), 6) AS distance FROM r WHERE n <= 3 GROUP BY 1")
def U12_multi_query_search(spark, d):
    q = _read(spark, d, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qvec"))
    return retrieval.search_multi_query(q, _stored(spark, d), 3, decimals=6).select("chunk_id", F.round("distance", 6).alias("distance"))


@query("SELECT count(*) FILTER (source = 'src0') AS n_deleted, count(*) FILTER (source IS DISTINCT FROM 'src0') AS n_left FROM documents")
def U13_delete_by_ticker(spark, d):
    kept, gone = store.delete_by_ticker(_read(spark, d, "documents").select("doc_id", F.col("source").alias("ticker")), "src0")
    return gone.crossJoin(kept.agg(F.count("*").alias("n_left")))


# Metrics.
@query(f"WITH c AS ({_CANON}) SELECT metric, statement, ticker_count, printf('%.1f%%', ticker_pct * 100) AS ticker_pct FROM c")
def M6_metric_summary(spark, d):
    return metrics.metric_summary(frame(spark, d, _CANON.replace("::DOUBLE", "D").replace("1000.0D", "1000D")))


_FORMS = "SELECT f.*, CASE WHEN ticker < 'S5' THEN '10-K' ELSE '8-K' END AS filing_type FROM ({}) f WHERE ticker < 'S5' OR statement = 'balance_sheet' OR metric = 'Net income'"


@query(f"WITH f AS ({_FORMS.format(FACTS)}) SELECT ticker, period, metric, value FROM f WHERE metric IN (SELECT metric FROM f WHERE filing_type = '10-K' AND value IS NOT NULL GROUP BY metric HAVING count(DISTINCT ticker) / (SELECT count(DISTINCT ticker) FROM f WHERE filing_type = '10-K') >= 0.9) OR (lower(metric) LIKE '%revenue%' AND EXISTS (SELECT 1 FROM f WHERE filing_type = '10-K'))")
def M7_two_pass_analysis(spark, d):
    f = facts(spark, d).withColumn("filing_type", F.when(F.col("ticker") < "S5", "10-K").otherwise("8-K")).where("ticker < 'S5' or statement = 'balance_sheet' or metric = 'Net income'")
    return metrics.two_pass(tables.save_table(f, "facts"), 0.9)[1].select("ticker", "period", "metric", "value")


# Panel.
_REGISTRY = panel.METRIC_CANDIDATES
_RENAMED = {"Total revenue": "Total revenues", "Revenues, net": "Net revenues", "Current assets": "Total current assets", "Current liabilities": "Total current liabilities"}
_AS_FILED = "CASE metric " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in _RENAMED.items()) + " ELSE metric END"


def _filed(spark, d):
    return facts(spark, d).withColumn("metric", F.expr(_AS_FILED))


def _case(col, positive, *names):
    keep = lambda n: f"max(CASE WHEN metric = '{n}'{' AND value > 0' if positive else ''} THEN value END)"
    return f"coalesce({', '.join(map(keep, names))}) AS {col}" if len(names) > 1 else f"{keep(names[0])} AS {col}"


@query(f"WITH f AS (SELECT ticker, period, statement, {_AS_FILED} AS metric, value FROM {FA} f) SELECT * FROM (SELECT ticker, period, {_case('cash', True, 'Cash and cash equivalents')}, {_case('total_assets', True, 'Total assets')}, {_case('current_assets', True, 'Total current assets')}, {_case('current_liabilities', True, 'Total current liabilities')}, {_case('total_liabilities', True, 'Total liabilities')}, {_case('total_revenue', True, 'Total revenues', 'Net revenues')}, {_case('net_income', False, 'Net income')} FROM f GROUP BY 1, 2) WHERE coalesce(cash, total_assets, current_assets, current_liabilities, total_liabilities, total_revenue, net_income) IS NOT NULL")
def P1_registered_candidates(spark, d):
    picked = panel.wide(panel.pick_priority(_filed(spark, d), panel.candidates(spark)), list(_REGISTRY))
    return picked.select("ticker", "period", "cash", "total_assets", "current_assets", "current_liabilities", "total_liabilities", "total_revenue", "net_income")


@query(f"WITH f AS (SELECT ticker, period, {_AS_FILED} AS metric, value FROM {FA} f), w AS (SELECT ticker, period AS year, {_case('cash', False, 'Cash and cash equivalents')}, {_case('total_assets', False, 'Total assets')}, {_case('current_assets', False, 'Total current assets')}, {_case('current_liabilities', False, 'Total current liabilities')}, {_case('net_income', False, 'Net income')} FROM f WHERE value IS NOT NULL AND metric IN ({', '.join(repr(m) for m in panel.LEGACY_METRICS)}) GROUP BY 1, 2) SELECT *, current_assets / nullif(current_liabilities, 0) AS current_ratio, net_income / nullif(total_assets, 0) AS net_margin, net_income / nullif(total_assets, 0) AS roa FROM w")
def P5_legacy_panel(spark, d):
    return panel.legacy_panel(_filed(spark, d)).select("ticker", "year", "cash", "total_assets", "current_assets", "current_liabilities", "net_income", "current_ratio", "net_margin", "roa")


@query("SELECT concat('col', CAST(p_size AS STRING)) AS col, CASE WHEN p_size % 2 = 0 THEN 'balance_sheet' ELSE 'income_statement' END AS statement, CASE WHEN p_size % 5 = 0 THEN 'USD/shares' ELSE 'USD' END AS unit, p_size % 7 = 0 AS computed, v.concept, v.rank FROM (SELECT DISTINCT p_size FROM part) p, LATERAL (SELECT concat('First', CAST(p_size AS STRING)) AS concept, 1 AS rank UNION ALL SELECT 'Other', 2) v WHERE p_size % 7 <> 0")
def P10_mapping_registry(spark, d):
    at = tables.work_folder(spark, "mapping")
    entry = F.struct(F.when(F.col("p_size") % 2 == 0, "balance_sheet").otherwise("income_statement").alias("statement"), F.when(F.col("p_size") % 7 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("First"), "p_size"), F.lit("Other"))).alias("xbrl_concepts"), F.when(F.col("p_size") % 5 == 0, "USD/shares").otherwise("USD").alias("xbrl_unit"), (F.col("p_size") % 7 == 0).alias("computed"))
    rows = _read(spark, d, "part").select("p_size").distinct().select(F.struct(F.concat(F.lit("col"), "p_size").alias("name"), entry.alias("entry")).alias("e"))
    rows.agg(F.to_json(F.struct(F.map_from_entries(F.collect_list("e")).alias("panel_columns"))).alias("value")).write.text(at)
    return panel.read_mapping(spark, at)


# Ingest: the made filings of the panel, with every filing's facts, sections and chunks.
def _ingested(spark, d):
    pages = _filing_pages(spark, d)
    made = pages.select("ticker", F.lit("10-K").alias("filing_type"), F.concat(F.substring("period", 3, 4), F.lit("-12-31")).alias("date"), F.concat("ticker", F.lit("-"), "period").alias("accession_number"), F.concat(F.lit("/data/"), "ticker", F.lit("/"), "period", F.lit("/main.htm")).alias("source_path"), F.when(F.col("period") != "FY1998", F.col("html")).alias("html"))
    stored = facts(spark, d).where("period = 'FY1997'").select("ticker", "period", "statement", "metric", (F.col("value") * 0).alias("value"), F.lit("old").alias("raw_value"))
    none = spark.createDataFrame([], "chunk_id string, doc_id string, section string, chunk_index int, text string")
    filed = spark.createDataFrame([], "ticker string, filing_type string, date string, accession_number string, source_path string, error string, sql_row_count int, section_count int, chunk_count int")
    return ingest.ingest(made, stored, none, filed)


@query(f"WITH p AS {P} SELECT count(*) AS filings, count(*) FILTER (year = 'FY1998') AS errors, coalesce(sum(CASE WHEN year = 'FY1998' THEN 0 WHEN year = 'FY1995' THEN 1 ELSE 6 END), 0)::BIGINT AS facts, count(*) FILTER (year <> 'FY1998') AS chunks, count(*) FILTER (year <> 'FY1998') AS added FROM p")
def U14_ingest(spark, d):
    return _ingested(spark, d)["summary"]


@query(f"WITH p AS {P} SELECT concat(ticker, '-', year) AS accession_number, CASE WHEN year = 'FY1998' THEN 'no contents' END AS error, CASE WHEN year = 'FY1998' THEN 0 WHEN year = 'FY1995' THEN 1 ELSE 6 END AS sql_row_count, CASE WHEN year = 'FY1998' THEN 0 ELSE 1 END AS chunk_count FROM p")
def U14_provenance(spark, d):
    return _ingested(spark, d)["provenance"].select("accession_number", "error", "sql_row_count", "chunk_count")


_SECTIONED = ["concat('About order ', o_orderkey, '. It is one of many.')", "'Item 1. Business'", "concat(repeat('We sell things. ', 50), 'End of order ', o_orderkey, '.')", "'Item 7. Results'", "concat('Total ', cast(o_custkey as string), '.')"]


@query("""WITH o AS (SELECT o_orderkey, o_custkey FROM orders) SELECT o_orderkey, 0 AS chunk_index, 'preamble' AS section, concat('About order ', o_orderkey, '. It is one of many.') AS text FROM o
UNION ALL SELECT o_orderkey, 1, 'Item 1. Business', rtrim(repeat('We sell things. ', 34)) FROM o UNION ALL SELECT o_orderkey, 2, 'Item 1. Business', concat(repeat('We sell things. ', 20), 'End of order ', o_orderkey, '.') FROM o
UNION ALL SELECT o_orderkey, 3, 'Item 7. Results', concat('Total ', o_custkey, '.') FROM o""")
def T10_section_chunks(spark, d):
    filed = _read(spark, d, "orders").selectExpr("o_orderkey", f"concat_ws('\\n', {', '.join(_SECTIONED)}) as text")
    return filed.select("o_orderkey", F.posexplode(ingest.section_chunks(F.col("text"))).alias("chunk_index", "c")).select("o_orderkey", "chunk_index", "c.*")


@query("SELECT p_partkey, concat('Label ', p_name) AS label FROM part")
def T11_label_with_number(spark, d):
    """A number, a roman numeral or a bracketed one, with blanks around it, goes; the label stays."""
    lead = F.when(F.col("p_partkey") % 3 == 0, " 1. ").when(F.col("p_partkey") % 3 == 1, "(iv) ").otherwise("\t2.3) ")
    return _read(spark, d, "part").select("p_partkey", text.clean_label(F.concat(lead, F.lit("Label  "), "p_name", F.lit(" : "))).alias("label"))


# The SQL surface.
_STATEMENTS = ("SELECT sales FROM panel WHERE ticker = 'GOOGL'", "SELECT ticker FROM panel, secret", "DROP TABLE panel", "SELECT reflect('java.lang.System', 'exit') FROM panel", "SELECT max(profit) FROM panel")


@query("""SELECT n_nationkey, CASE n_nationkey % 5 WHEN 0 THEN 'SELECT total_revenue FROM panel WHERE ticker = ''GOOG''' WHEN 1 THEN 'SELECT ticker FROM panel, secret' WHEN 2 THEN 'DROP TABLE panel' WHEN 3 THEN 'SELECT reflect(''java.lang.System'', ''exit'') FROM panel' ELSE 'SELECT max(net_income) FROM panel' END AS sql_repaired,
CASE n_nationkey % 5 WHEN 0 THEN 2 WHEN 4 THEN 1 ELSE 0 END AS n_repairs, n_nationkey % 5 IN (0, 4) AS is_valid, CASE n_nationkey % 5 WHEN 1 THEN 'unknown tables: secret' WHEN 2 THEN 'Only SELECT statements allowed: DropTable, UnresolvedIdentifier' WHEN 3 THEN 'unknown functions: reflect' ELSE '' END AS error FROM nation""")
def N1_N2_Y10_statement_records(spark, d):
    """The gate is the parser of the driver: each distinct statement is read once there, and the rows are joined with its record."""
    asked = _read(spark, d, "nation").select("n_nationkey", F.get(F.array(*map(F.lit, _STATEMENTS)), F.col("n_nationkey") % 5).alias("sql_original"))
    records = spark.createDataFrame([sqlsurface.postprocess(spark, s, {"panel"}) for s in _STATEMENTS], sqlsurface.RECORD)
    return asked.join(F.broadcast(records), "sql_original").select("n_nationkey", "sql_repaired", F.size("repairs").alias("n_repairs"), "is_valid", "error")


@query(f"""WITH p AS (SELECT ticker, year, floor(total_revenue) AS total_revenue, CASE WHEN year <> 'FY1996' THEN cash END AS cash FROM {P} p WHERE year IN ('FY1996', 'FY1997') AND ticker <> 'S3' OR ticker = 'S3' AND year = 'FY1996'),
s AS (SELECT *, format('{{:,}}', total_revenue::BIGINT) AS r, format('{{:,}}', cash::BIGINT) AS c FROM p) SELECT ticker, CASE WHEN count(*) = 1 THEN string_agg('year: ' || year || ', total_revenue: ' || r || coalesce(', cash: ' || c, ''), '') ELSE string_agg(year || ' | ' || r || ' | ' || coalesce(c, 'None'), E'\\n' ORDER BY year) END AS shown FROM s GROUP BY 1""")
def N4_formatted_rows(spark, d):
    p = frame(spark, d, PANEL).where("year in ('FY1996', 'FY1997') and ticker <> 'S3' or ticker = 'S3' and year = 'FY1996'")
    return sqlsurface.format_rows(p.select("ticker", "year", F.floor("total_revenue").cast("double").alias("total_revenue"), F.when(F.col("year") != "FY1996", F.col("cash")).alias("cash")), ["ticker"], ["year"])


@query("SELECT doc_id, concat('p = ''FY', CAST(1990 + doc_id % 30 AS STRING), ''' OR p LIKE ''%FY', CAST(1990 + doc_id % 30 AS STRING), '%''') AS sql FROM documents")
def N6_repaired_periods(spark, d):
    year = (F.lit(1990) + F.col("doc_id") % 30).cast("string")
    return _read(spark, d, "documents").select("doc_id", sqlsurface.repair_period(F.concat(F.lit("p = 'F"), year, F.lit("' OR p LIKE '%F"), year, F.lit("%'"))).alias("sql"))


_SHAPES = ("SELECT a FROM b JOIN c", "SELECT a FROM b ORDER BY a LIMIT 3", "SELECT avg(a) FROM b", "SELECT a FROM b WHERE y BETWEEN 1 AND 2", "SELECT a FROM filing_metadata", "SELECT a FROM b WHERE t IN ('x')", "SELECT a FROM b WHERE c > 1", "SELECT a FROM b WHERE c = 1")


@query("SELECT shape, count(*) AS n FROM (SELECT CASE doc_id % 8 WHEN 0 THEN 'join' WHEN 1 THEN 'ranking' WHEN 2 THEN 'aggregation' WHEN 3 THEN 'trend' WHEN 4 THEN 'filing' WHEN 5 THEN 'comparison' WHEN 6 THEN 'threshold' ELSE 'single' END AS shape FROM documents) s GROUP BY 1")
def N9_query_shapes(spark, d):
    sql = F.get(F.array(*map(F.lit, _SHAPES)), (F.col("doc_id") % 8).cast("int"))
    return _read(spark, d, "documents").select(sqlsurface.query_shape(sql).alias("shape")).groupBy("shape").agg(F.count("*").alias("n"))


@query(f"WITH p AS (SELECT ticker, year, coalesce(CAST(round(net_margin, 4) AS STRING), 'NULL') AS m FROM {P} p) SELECT count(*) AS n, 'a' AS only_in FROM p WHERE year = 'FY1997' HAVING count(*) > 0 UNION ALL SELECT count(*), 'b' FROM p WHERE year = 'FY1998' HAVING count(*) > 0")
def N14_result_differences(spark, d):
    p = frame(spark, d, PANEL).select("ticker", "year", "net_margin")
    return sqlsurface.result_differences(p.where("year <> 'FY1998'"), p.where("year <> 'FY1997'")).groupBy("only_in").agg(F.count("*").alias("n"))


@query("""WITH s AS (SELECT CASE doc_id % 4 WHEN 0 THEN 'AAPL' WHEN 1 THEN 'BRK-B' ELSE concat('T', CAST(doc_id % 97 AS STRING)) END AS ticker FROM documents WHERE doc_id % 5 <> 0) SELECT ticker, count(*) AS n FROM s GROUP BY 1 ORDER BY n DESC, ticker LIMIT 10""")
def A12_named_tickers(spark, d):
    name = F.when(F.col("doc_id") % 4 == 0, "AAPL").when(F.col("doc_id") % 4 == 1, "BRK-B").otherwise(F.concat(F.lit("T"), F.col("doc_id") % 97))
    sql = F.when(F.col("doc_id") % 5 == 0, F.lit("SELECT 1")).otherwise(F.concat(F.lit("SELECT a FROM p WHERE Ticker = '"), name, F.lit("'")))
    return runs.named_tickers(_read(spark, d, "documents").select(sql.alias("sql")))


_PAIRS = [("point", "What was {ticker}'s revenue in {year}?", "SELECT total_revenue FROM panel WHERE ticker = '{ticker}' AND year = '{year}'"), ("assets", "What did {ticker} own in {year}?", "SELECT total_assets FROM panel WHERE ticker = '{ticker}' AND year = '{year}'")]


@query(f"""WITH q AS (SELECT 'point' AS template, concat('What was ', ticker, '''s revenue in ', year, '?') AS question, concat('SELECT total_revenue FROM panel WHERE ticker = ''', ticker, ''' AND year = ''', year, '''') AS sql FROM {P} p
UNION ALL SELECT 'assets', concat('What did ', ticker, ' own in ', year, '?'), concat('SELECT total_assets FROM panel WHERE ticker = ''', ticker, ''' AND year = ''', year, '''') FROM {P} p)
SELECT template, question, sql FROM q WHERE CAST(concat('0x', substr(md5(concat('pairs', question)), 1, 8)) AS BIGINT) < 2147483648""")
def N11_question_pairs(spark, d):
    return runs.question_pairs(frame(spark, d, PANEL), _PAIRS, 0.5).select("template", "question", "sql")


@query(f"SELECT ticker, year, concat('SELECT value FROM financials WHERE metric = ''Total revenue'' AND ticker = ''', ticker, ''' AND period = ''', year, '''') AS sql FROM {P} p")
def N5_long_form(spark, d):
    sql = F.concat(F.lit("SELECT total_revenue FROM panel WHERE ticker = '"), "ticker", F.lit("' AND year = '"), "year", F.lit("'"))
    return frame(spark, d, PANEL).select("ticker", "year", runs.long_form(sql, {"total_revenue": "Total revenue", "net_income": "Net income"}).alias("sql"))


# Evaluation runs.
@query(f"""WITH p AS (SELECT ticker, year, CAST(substr(year, 3) AS INTEGER) AS y FROM {P} p) SELECT ticker, year, y % 2 = 0 AS our_value, CASE WHEN y % 2 = 0 THEN 1.0 ELSE 0.5 END::DOUBLE AS our_keywords, CASE WHEN y % 3 = 0 THEN true END AS other_value, CASE WHEN y % 3 = 0 THEN 1.0 END::DOUBLE AS other_keywords FROM p""")
def Y2_scored_sides(spark, d):
    y = F.substring("year", 3, 4).cast("int")
    right = F.concat(F.lit("The revenue was $"), F.format_number(F.floor("total_revenue"), 0), F.lit("."))
    wrong = F.concat(F.lit("The sales were about "), F.format_string("%.6f", F.col("total_revenue") * 1.5 / 1e6), F.lit(" million."))
    words = F.array(F.lit("the"), F.lit("Revenue"))
    sides = frame(spark, d, PANEL).withColumn("our", runs.scored_side(F.when(y % 2 == 0, right).otherwise(wrong), words, F.col("total_revenue"))).withColumn("other", runs.scored_side(F.when(y % 3 == 0, right), words, F.col("total_revenue")))
    return sides.select("ticker", "year", F.col("our.value_correct").alias("our_value"), F.col("our.keyword_hit_rate").alias("our_keywords"), F.col("other.value_correct").alias("other_value"), F.col("other.keyword_hit_rate").alias("other_keywords"))


_SCORED = """SELECT config, kind, CAST(round(CASE WHEN intent = 0 THEN least(x, 0.5) ELSE x END, 4) AS DECIMAL(10,4)) AS score, latency FROM (SELECT *, CASE WHEN kind = 'Type3' THEN 0.4 * key + 0.6 * key WHEN kind = 'Type2' THEN 0.3 * key + 0.05 * val + 0.65 * key ELSE 0.1 * key + 0.6 * val + 0.3 * key END::DOUBLE AS x FROM
(SELECT c.*, (latency % 5) / 4 AS key, CASE WHEN value_correct = 1 THEN 1.0 WHEN value_correct = 0 THEN 0.0 ELSE 0.5 END AS val, CASE WHEN contains(category, 'Type3') THEN 'Type3' WHEN contains(category, 'Type2') AND NOT contains(category, 'Type1') THEN 'Type2' ELSE 'Type1' END AS kind FROM c) c) s"""


@query(f"""WITH a AS {CA}, c AS (SELECT 'own' AS config, category, intent_correct AS intent, value_correct, latency FROM a UNION ALL SELECT 'other', category, 1, value_correct, latency FROM a UNION ALL SELECT 'file', category, intent_correct, value_correct, latency FROM a WHERE config = 'src0'), s AS ({_SCORED}),
l AS (SELECT config, list_sort(list(latency)) AS l FROM s GROUP BY 1) SELECT s.config, count(*) AS n_cases, round(avg(score)::DOUBLE, 4) AS composite_score, round(avg(score) FILTER (kind = 'Type1')::DOUBLE, 4) AS type1, round(avg(score) FILTER (kind = 'Type2')::DOUBLE, 4) AS type2, round(avg(score) FILTER (kind = 'Type3')::DOUBLE, 4) AS type3,
round(avg(latency)::DOUBLE, 3) AS latency_mean_s, any_value(l.l[CAST(floor(len(l.l) * 0.5) AS BIGINT) + 1])::DOUBLE AS latency_p50_s, any_value(l.l[CAST(floor(len(l.l) * 0.95) AS BIGINT) + 1])::DOUBLE AS latency_p95_s FROM s JOIN l ON s.config = l.config GROUP BY 1""")
def Y4_E8_run_table(spark, d):
    c = frame(spark, d, CASES)
    side = lambda i: F.struct(i.alias("intent_correct"), (F.col("value_correct") == 1).alias("value_correct"), ((F.col("latency") % 5) / 4).alias("keyword_hit_rate"))
    sided = c.select("category", side(F.col("intent_correct") == 1).alias("our"), side(F.lit(None).cast("boolean")).alias("gpt"), F.col("latency").cast("double").alias("total_s"))
    case = F.struct("category", (F.col("intent_correct") == 1).alias("intent_correct"), (F.col("value_correct") == 1).alias("value_correct"), ((F.col("latency") % 5) / 4).alias("keyword_hit_rate"), F.struct(F.col("latency").cast("double").alias("total_s")).alias("timings"))
    file = c.where("config = 'src0'").select(F.array(case).alias("cases"))
    cases = runs.cases_of_side(sided, "own", "our", "total_s").unionByName(runs.cases_of_side(sided, "other", "gpt", "total_s", sure_intent=True)).unionByName(runs.cases_of_file(file, "file"))
    return runs.run_table(cases)


@query("WITH s AS (SELECT event_type AS config, user_id % 8 + 1 AS concurrency, max(value) AS qps, min(value) AS p50 FROM events GROUP BY 1, 2), m AS (SELECT config, max(qps) AS q FROM s GROUP BY 1) SELECT s.config, min(p50) FILTER (concurrency = 1) AS single_req_p50, any_value(m.q) AS peak_qps, min(concurrency) FILTER (qps = m.q) AS peak_concurrency FROM s JOIN m ON s.config = m.config GROUP BY 1")
def Y4_sweep_table(spark, d):
    return runs.sweep_table(_sweep(spark, d).withColumnRenamed("quant", "config"))


def _sweep(spark, d):
    return _read(spark, d, "events").groupBy(F.col("event_type").alias("quant"), (F.col("user_id") % 8 + 1).alias("concurrency")).agg(F.max("value").alias("qps"), F.min("value").alias("latency_p50"))


@query("""WITH s AS (SELECT event_type AS quant, user_id % 8 + 1 AS concurrency, max(value) AS qps, min(value) AS p50 FROM events GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS n FROM events)
SELECT r.event_type AS quant, r.value AS qps, r.value / 2 AS latency_p50, s.qps AS base_qps, s.p50 AS base_p50, r.value / nullif(s.qps, 0) AS speedup FROM r LEFT JOIN s ON s.quant = r.event_type AND s.concurrency = 8 WHERE r.n = 1""")
def Y6_against_baseline(spark, d):
    made = _read(spark, d, "events").select(F.col("event_type").alias("quant"), F.col("value").alias("qps"), (F.col("value") / 2).alias("latency_p50"), "event_id")
    return runs.against_baseline(made, _sweep(spark, d), ["event_id"])


@query("WITH b AS (SELECT sum(coalesce(quality, 0)) / count(*) * 100 AS q, sum(coalesce(toxic, 0)) / count(*) * 100 AS t FROM labels), f AS (SELECT sum(CASE WHEN doc_id % 5 = 0 THEN 1 ELSE coalesce(quality, 0) END) / count(*) * 100 AS q, sum(coalesce(toxic, 0)) / count(*) * 100 AS t FROM labels) SELECT 'quality' AS metric, b.q AS base, f.q AS tuned, f.q - b.q AS delta FROM b, f UNION ALL SELECT 'toxic', b.t, f.t, f.t - b.t FROM b, f")
def Y8_score_table(spark, d):
    base = _read(spark, d, "labels")
    return runs.score_table(base, base.withColumn("quality", F.when(F.col("doc_id") % 5 == 0, 1).otherwise(F.col("quality"))), ["quality", "toxic"])


@query("SELECT CASE WHEN event_id % 3 = 0 THEN 'eval' ELSE 'train' END AS part, event_id AS step, user_id / 2 AS epoch, value AS loss, CASE WHEN event_id % 3 = 0 THEN 0.5 ELSE 0.0 END::DOUBLE AS accuracy FROM events WHERE event_id % 3 <> 2 AND value IS NOT NULL AND NOT isnan(value)")
def Y9_training_log(spark, d):
    entry = "named_struct('step', event_id, 'epoch', user_id / 2, 'loss', if(event_id % 3 = 1, value, null), 'eval_loss', if(event_id % 3 = 0, value, null), 'eval_mean_token_accuracy', if(event_id % 3 = 0, 0.5D, null))"
    states = _read(spark, d, "events").selectExpr(f"to_json(named_struct('log_history', array({entry}))) as json")
    return runs.training_log(states)


@query("""WITH a AS (SELECT text, row_number() OVER (ORDER BY doc_id) AS k FROM documents WHERE doc_id % 37 = 0), b AS (SELECT text, row_number() OVER (ORDER BY item_id) AS k FROM benchmark WHERE length(trim(text)) >= 50),
u AS (SELECT text, row_number() OVER (ORDER BY s, k) - 1 AS k FROM (SELECT 0 AS s, k, text FROM a UNION ALL SELECT 1, k, text FROM b) x), f AS (SELECT *, count(*) OVER () AS n FROM u WHERE k < 700) SELECT g.position, md5(f.text) AS digest FROM f, LATERAL (SELECT unnest(range(f.k::BIGINT, 700, f.n::BIGINT)) AS position) g""")
def Y14_calibration_sample(spark, d):
    first = _read(spark, d, "documents").where("doc_id % 37 = 0").select(F.col("doc_id").alias("id"), "text")
    return runs.calibration_sample(first, _read(spark, d, "benchmark").select(F.col("item_id").alias("id"), "text"), 700).select("position", F.md5("text").alias("digest"))


@query("SELECT source, count(*) AS total, count(*) FILTER (n_chars >= 300) AS kept, count(*) FILTER (n_chars >= 300 AND contains(text, 'the')) AS fixed, count(*) FILTER (NOT coalesce(n_chars >= 300, false)) AS discarded FROM documents GROUP BY 1")
def Y15_filter_report(spark, d):
    return runs.filter_report(_read(spark, d, "documents"), F.col("n_chars") >= 300, F.contains("text", F.lit("the")), "source")


@query(f"SELECT total_revenue AS value FROM {P} p WHERE ticker = 'S1' AND year = 'FY1997'")
def Y16_ground_truth(spark, d):
    return runs.scalar(sqlsurface.execute(spark, "SELECT revenue FROM panel WHERE ticker = 'S1' AND year = 'FY1997'", {"panel": frame(spark, d, PANEL)}))


@query("SELECT id, CASE WHEN value_correct IS NULL THEN '' ELSE config END AS answer, CASE WHEN value_correct IS NULL THEN true ELSE intent_correct = 1 END AS intent_correct, CASE WHEN value_correct IS NULL THEN false ELSE value_correct = 1 END AS value_correct, CASE WHEN value_correct IS NULL THEN 0.0 ELSE latency::DOUBLE END AS total_s, CASE WHEN value_correct IS NULL THEN 1 ELSE 4 END AS fluency_score, CASE WHEN value_correct IS NULL THEN 'timeout' END AS error FROM " + CA + "c")
def Y20_failure_records(spark, d):
    c = frame(spark, d, CASES)
    error = F.when(F.col("value_correct").isNull(), "timeout")
    return c.select("id", *runs.failure_record(error, F.col("config"), {"intent_correct": F.col("intent_correct") == 1, "value_correct": F.col("value_correct") == 1, "total_s": F.col("latency").cast("double"), "fluency_score": F.lit(4)}))


@query(f"SELECT 'total_revenue' AS col, CASE WHEN total_revenue > 1e6 THEN format('{{:,}}', round_even(total_revenue, 0)::BIGINT) END AS shown FROM {P} p WHERE ticker = 'S2' AND year = 'FY1996' AND total_revenue > 1e6")
def Y21_spot_check(spark, d):
    found = runs.spot_check(frame(spark, d, PANEL), "S2", "FY1996")
    return found.where("col = 'total_revenue' and shown like '%,%'")


@query("""WITH e AS (""" + _VEC + """), q AS (SELECT b.item_id AS id, e.v FROM benchmark b JOIN e ON e.vec_id = b.item_id), s AS (SELECT q.id, c.vec_id, round(""" + _COS + """, 6) AS score FROM q, e c), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, vec_id) AS n FROM s WHERE vec_id IN (SELECT doc_id FROM documents))
SELECT r.id AS query_id, string_agg(substr(d.text, 1, 600), E'\\n\\n' ORDER BY n) AS context FROM r JOIN documents d ON d.doc_id = r.vec_id WHERE n <= 5 GROUP BY 1""")
def Y17_reference_context(spark, d):
    """The texts, cut to 600 characters, of the five nearest chunks of each question."""
    vectors = _read(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vec"))
    docs = _read(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.substring("text", 1, 600).alias("text"))
    q = _read(spark, d, "benchmark").join(vectors, F.col("item_id") == F.col("chunk_id")).select(F.col("item_id").alias("query_id"), F.col("vec").alias("qvec"))
    top = retrieval.dense_top_k(q, vectors.join(docs, "chunk_id", "left_semi"), 5, decimals=6).join(docs, "chunk_id")
    return top.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda r: r["text"]), "\n\n").alias("context"))


@query("SELECT doc_id, contains(lower(text), 'total') OR contains(lower(text), 'license') AS found FROM documents")
def Y19_pages_with_keywords(spark, d):
    return _read(spark, d, "documents").select("doc_id", text.has_keyword(F.col("text"), ["Total", "license"]).alias("found"))


_CORE = [f"S{k}" for k in range(1, 10)]
_COMPARE = [("total_revenue", "Compare {n1} and {n2} revenue in {fy}."), ("net_income", "Compare {n1} and {n2} net income in {fy}."), ("total_revenue", "Which had higher revenue in {fy}, {n1} or {n2}?"), ("total_assets", "Compare {n1} and {n2} total assets in {fy}.")]


@query(f"""WITH p AS (SELECT * FROM {P} p WHERE ticker IN ({', '.join(f"'{t}'" for t in _CORE)})), l AS (SELECT a.ticker AS n1, b.ticker AS n2, max(a.year) AS fy FROM p a JOIN p b ON a.year = b.year AND a.ticker < b.ticker GROUP BY 1, 2),
v AS (SELECT l.*, a.total_revenue AS r1, b.total_revenue AS r2, a.net_income AS i1, b.net_income AS i2, a.total_assets AS t1, b.total_assets AS t2 FROM l JOIN p a ON a.ticker = n1 AND a.year = fy JOIN p b ON b.ticker = n2 AND b.year = fy)
SELECT n1, n2, fy, 'total_revenue' AS metric, format('Compare {{}} and {{}} revenue in {{}}.', n1, n2, fy) AS question FROM v WHERE r1 IS NOT NULL AND r2 IS NOT NULL UNION ALL SELECT n1, n2, fy, 'net_income', format('Compare {{}} and {{}} net income in {{}}.', n1, n2, fy) FROM v WHERE i1 IS NOT NULL AND i2 IS NOT NULL
UNION ALL SELECT n1, n2, fy, 'total_revenue', format('Which had higher revenue in {{}}, {{}} or {{}}?', fy, n1, n2) FROM v WHERE r1 IS NOT NULL AND r2 IS NOT NULL UNION ALL SELECT n1, n2, fy, 'total_assets', format('Compare {{}} and {{}} total assets in {{}}.', n1, n2, fy) FROM v WHERE t1 IS NOT NULL AND t2 IS NOT NULL""")
def E12_comparison_cases(spark, d):
    return runs.comparison_cases(frame(spark, d, PANEL), _CORE, _COMPARE)


@query(f"""WITH p AS (SELECT p.*, row_number() OVER (PARTITION BY ticker ORDER BY year DESC) AS n FROM {P} p), r AS (SELECT * FROM p WHERE n <= 2) SELECT ticker, year, concat('What were ', ticker, '''s revenue and net income in ', year, '?') AS question FROM r WHERE total_revenue IS NOT NULL AND net_income IS NOT NULL
UNION ALL SELECT ticker, year, concat('What were ', ticker, '''s total assets and liabilities in ', year, '?') FROM r WHERE total_assets IS NOT NULL AND total_liabilities IS NOT NULL""")
def E12_compound_cases(spark, d):
    return runs.compound_cases(frame(spark, d, PANEL), [(["total_revenue", "net_income"], "What were {name}'s revenue and net income in {fy}?"), (["total_assets", "total_liabilities"], "What were {name}'s total assets and liabilities in {fy}?")])


@query("SELECT doc_id, CAST(concat('0x', substr(md5(CAST(doc_id AS STRING)), 1, 8)) AS BIGINT) < 3650722201 AS train FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) ORDER BY doc_id LIMIT 400")
def Y13_distillation_batch(spark, d):
    """What isn't answered yet, in order of ids and up to a given number, split for training and validation."""
    open_ = _read(spark, d, "documents").select("doc_id").join(_read(spark, d, "labels"), "doc_id", "left_anti").orderBy("doc_id").limit(400)
    return open_.select("doc_id", store.hash_split(F.col("doc_id"), 0.85).alias("train"))
