"""Queries of filing sources, HTML, sections, fact extraction, question filters and answer scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillstone.operators import evaluation as ev
from quillstone.operators import html, retrieval, store, text
from quillstone.plans.domain import CASES, FILINGS, PANEL, frame
from quillstone.plans.registry import _NAMED, _TICKERS_OF, query
from quillstone.sources import filing_tree, filings
from quillstone.sources.tables import work_folder

P, FI, CA = (f"({x}) " for x in (PANEL, FILINGS, CASES))
_ACC = "CAST(accession_number AS BIGINT)"
_FILES = f"""
SELECT concat('/data/', CASE WHEN length(ticker) = 2 THEN 'NEWS' ELSE ticker END, '/', filing_type, '/', CASE WHEN {_ACC} % 11 = 0 THEN 'misc' ELSE date END, '_', accession_number, '/', v.name) AS path,
  {_ACC} % v.size AS length
FROM {FI} f CROSS JOIN (SELECT 'main.htm' AS name, 7 AS size UNION ALL SELECT 'exhibit.html', 5 UNION ALL SELECT 'scan.pdf', 9) v WHERE {_ACC} % 5 <> 0 OR v.name = 'scan.pdf'
"""


def _documents(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet")


# Sources.
@query(f"""SELECT ticker, filing_type, date, accession_number, coalesce(c_name, ticker) AS company,
concat('/data/', ticker, '/', filing_type, '/', date, '_', accession_number, CASE WHEN {_ACC} % 5 = 0 THEN '/scan.pdf' WHEN {_ACC} % 7 > {_ACC} % 5 THEN '/main.htm' ELSE '/exhibit.html' END) AS source_path
FROM {FI} f LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 2 = 0) c ON concat('C', CAST(c_custkey AS STRING)) = ticker
WHERE length(ticker) <> 2 AND {_ACC} % 11 <> 0 AND filing_type IN ('10-K', '10-Q') AND date BETWEEN '1996-01-01' AND '1999-12-31'""")
def S1_S4_walk_filings(spark, d):
    named = spark.read.parquet(f"{d}/customer.parquet").where("c_custkey % 2 = 0").selectExpr("concat('C', c_custkey) as ticker", "c_name as company")
    return filings.walk_filings(frame(spark, d, _FILES), named, forms=["10-K", "10-Q"], start="1996-01-01", end="1999-12-31")


@query(f"SELECT ticker, filing_type AS form, date, accession_number AS accession, 'a.htm' AS document FROM {FI} f WHERE filing_type <> '10-Q' AND date >= '2000-01-01' UNION ALL SELECT ticker, '8-K', date, concat(accession_number, 'b'), 'b.htm' FROM {FI} f WHERE date >= '2000-01-01'")
def S6_listed_filings(spark, d):
    pages = frame(spark, d, FILINGS).selectExpr("ticker", "array(filing_type, '8-K') as form", "array(date, date) as date", "array(accession_number, concat(accession_number, 'b')) as accession", "array('a.htm', 'b.htm') as document")
    return filings.listed_filings(pages, ["10-K", "8-K"], "2000-01-01", "9999-12-31")


@query("SELECT concat('S', CAST(l_suppkey AS STRING)) AS ticker, concat('C', CAST(l_partkey % 7 AS STRING)) AS concept, 'USD' AS unit, v.pos, CAST(year(l_shipdate) AS INTEGER) AS fy, 'FY' AS fp, CASE WHEN l_linestatus = 'F' THEN '10-K' ELSE '10-K/A' END AS form, substr(CAST(l_shipdate AS STRING), 1, 10) AS filed, l_extendedprice + v.pos AS val FROM lineitem, (SELECT CAST(0 AS INTEGER) AS pos UNION ALL SELECT 1) v")
def S8_company_facts(spark, d):
    fact = "named_struct('fy', year(l_shipdate), 'fp', 'FY', 'form', if(l_linestatus = 'F', '10-K', '10-K/A'), 'filed', substr(cast(l_shipdate as string), 1, 10), 'val', l_extendedprice + {})"
    body = f"to_json(named_struct('facts', named_struct('us-gaap', map(concat('C', l_partkey % 7), named_struct('units', map('USD', array({fact.format(0)}, {fact.format(1)})))))))"
    documents = spark.read.parquet(f"{d}/lineitem.parquet").selectExpr("concat('S', l_suppkey) as ticker", f"{body} as json")
    return filings.company_facts(documents).drop("end")


@query("SELECT c_custkey, lpad(CAST(c_custkey AS STRING), 10, '0') AS cik FROM customer")
def S9_padded_cik(spark, d):
    return spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", filings.padded_cik(F.col("c_custkey")).alias("cik"))


# HTML, sections, facts.
@query(r"""WITH s AS (SELECT page_id, regexp_replace(html, '(?is)<(head|script|style)\b.*?</(head|script|style)>|<!--.*?-->|<!doctype[^>]*>', '<>', 'g') AS h FROM pages),
n AS (SELECT page_id, array_to_string(list_filter(string_split_regex(h, '<[^>]*>'), lambda x: x <> ''), chr(10)) AS t FROM s),
e AS (SELECT page_id, regexp_replace(replace(replace(replace(t, '&copy;', '©'), '&middot;', '·'), '&quot;', '"'), '&amp;?', '&', 'g') AS t FROM n)
SELECT page_id, regexp_replace(regexp_replace(regexp_replace(t, '[ \t]+', ' ', 'g'), chr(10) || '{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS text FROM e""")
def T1_visible_text(spark, d):
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", html.visible_text(F.col("html")).alias("text"))


@query("""SELECT o_orderkey, 'preamble' AS section, concat('order ', CAST(o_orderkey AS STRING)) AS text FROM orders
UNION ALL SELECT o_orderkey, 'Item 1. Business', concat(o_orderpriority, chr(10), 'more') FROM orders UNION ALL SELECT o_orderkey, 'PART II', concat('ITEM 9. ', repeat('long ', 30), 'end') FROM orders WHERE o_orderkey % 2 = 0""")
def T2_sections(spark, d):
    lines = ["concat('order ', o_orderkey)", "'Item 1. Business'", "concat('contents ', o_orderstatus)", "'ITEM 7. Results'", "'  '", "' Item 1. Business '", "o_orderpriority", "'more'", "'PART II'", "if(o_orderkey % 2 = 0, concat('ITEM 9. ', repeat('long ', 30), 'end'), '')"]
    filed = spark.read.parquet(f"{d}/orders.parquet").selectExpr("o_orderkey", f"concat_ws('\\n', {', '.join(lines)}) as text")
    return filed.select("o_orderkey", F.inline(text.sections(F.col("text"))))


@query("SELECT doc_id, contains(upper(text), 'THE') OR contains(upper(text), 'LICENSE') AS found FROM documents")
def T4_keyword_filter(spark, d):
    return _documents(spark, d).select("doc_id", text.has_keyword(F.col("text"), ["the", "License"]).alias("found"))


@query("WITH h AS (SELECT DISTINCT source, doc_id FROM documents WHERE contains(upper(text), 'LICENSE')) SELECT source, doc_id FROM documents d WHERE EXISTS (SELECT 1 FROM h WHERE h.source = d.source AND d.doc_id BETWEEN h.doc_id - 20 AND h.doc_id + 20)")
def T6_pages_near_keywords(spark, d):
    return text.pages_near_keywords(_documents(spark, d), ["license"], 20, "source", "doc_id").select("source", "doc_id")


@query(r"SELECT p_partkey, trim(regexp_replace(regexp_replace(concat('(', CAST(p_size AS STRING), ') ', p_name, ' :'), '^[\d.\-()ivxlIVXL]+[.)]', ''), '\s+', ' ', 'g'), ' :.,;') AS label FROM part")
def T11_clean_label(spark, d):
    label = F.concat(F.lit("("), F.col("p_size").cast("string"), F.lit(") "), "p_name", F.lit(" :"))
    return spark.read.parquet(f"{d}/part.parquet").select("p_partkey", text.clean_label(label).alias("label"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 7 <> 0 THEN CAST(floor(c_acctbal) AS BIGINT)::DOUBLE END AS value FROM customer")
def T12_parse_number(spark, d):
    whole = F.floor("c_acctbal")
    cell = F.when(F.col("c_custkey") % 7 == 0, "N/A").when(whole < 0, F.concat(F.lit(" ("), F.format_number(-whole, 0), F.lit(")"))).otherwise(F.concat(F.lit("$ "), F.format_number(whole, 0)))
    return spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", text.parse_number(cell).alias("value"))


_LABELS = (("Total revenue", "total_revenue"), ("Net income", "net_income")), (("Total assets", "total_assets"), ("Current assets", "current_assets"), ("Total liabilities", "total_liabilities"), ("Current liabilities", "current_liabilities"))
_SHOWN = "CASE WHEN floor({c}) < 0 THEN concat('(', format('{{:,}}', -CAST(floor({c}) AS BIGINT)), ')') ELSE format('{{:,}}', CAST(floor({c}) AS BIGINT)) END"
_FACT_ROWS = " UNION ALL ".join(
    f"SELECT ticker, year AS period, '{s}' AS statement, '{m}' AS metric, floor({c}) * 1e3 AS value, CASE WHEN {c} IS NULL THEN '' ELSE {_SHOWN.format(c=c)} END AS raw_value FROM p WHERE year <> 'FY1995'"
    for s, rows in zip(("income_statement", "balance_sheet"), _LABELS)
    for m, c in rows
)


def _filing_pages(spark, d):
    def cell(c):
        n = F.floor(c)
        return F.when(F.col(c).isNull(), "—").when(n < 0, F.concat(F.lit("("), F.format_number(-n, 0), F.lit(")"))).otherwise(F.format_number(n, 0))

    def table(rows):
        body = [x for m, c in rows for x in (F.lit(f"<tr><td>{m}:</td><td>$</td><td> "), cell(c), F.lit("</td></tr>"))]
        return F.concat(F.lit("<table><tr><th></th><th>"), "year", F.lit("</th></tr><tr><td> </td></tr>"), *body, F.lit("</table>"))

    prose = F.concat(F.lit("<p>Total revenue ..... $"), cell("total_revenue"), F.lit("</p>"))
    body = F.when(F.col("year") == "FY1995", prose).otherwise(F.concat(*map(table, _LABELS)))
    page = F.concat(F.lit("<html><head><title>billions</title></head><body><ix:header>billions</ix:header><p>"), F.lower("ticker"), F.lit(" in <b>thousands</b></p>"), body, F.lit("</body></html>"))
    return frame(spark, d, PANEL).select("ticker", F.col("year").alias("period"), page.alias("html"))


@query(f"WITH p AS {P} {_FACT_ROWS} UNION ALL SELECT ticker, year, 'unknown', 'Total revenue', floor(total_revenue) * 1e3, {_SHOWN.format(c='total_revenue')} FROM p WHERE year = 'FY1995'")
def T3_T14_T17_filing_facts(spark, d):
    return text.filing_facts(_filing_pages(spark, d))


# Retrieval.
@query(f"WITH q AS (SELECT conv_id, turn, text, {_TICKERS_OF.format('text')} AS named FROM conversations) SELECT conv_id, turn, {_NAMED} FROM q")
def R1_question_filters(spark, d):
    return spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", retrieval.question_filters(F.col("text")).alias("f")).select("conv_id", "turn", "f.*")


@query(f"SELECT accession_number FROM {FI} f WHERE ticker = 'C10' AND contains(date, '2000')")
def R2_filtered_filings(spark, d):
    asked = retrieval.question_filters(F.lit("What did Customer Ten file in FY2000?"), companies={"customer ten": "C10"})
    return frame(spark, d, FILINGS).where(retrieval.fits_filters(asked, F.col("ticker"), F.col("filing_type"), F.col("date"))).select("accession_number")


_GRAMS = "CASE WHEN length({t}) >= 3 THEN list_distinct(list_transform(range(1, length({t}) - 1), lambda i: substr({t}, i, 3))) ELSE [] END"


@query(f"WITH c AS (SELECT conv_id, turn, {_GRAMS.format(t='text')} AS g FROM conversations) SELECT a.conv_id, a.turn, coalesce(len(list_intersect(a.g, b.g)) / nullif(len(list_distinct(list_concat(a.g, b.g))), 0), 0) AS overlap FROM c a JOIN c b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1")
def R9_trigram_overlap(spark, d):
    c = spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", "text")
    later = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("next"))
    return c.join(later, ["conv_id", "turn"]).select("conv_id", "turn", retrieval.trigram_jaccard(F.col("text"), F.col("next")).alias("overlap"))


# Scoring.
@query(f"SELECT ticker, year, CASE WHEN net_income >= 0 THEN CAST(substr(year, 3) AS INTEGER) % 2 = 0 END AS value_ok FROM {P} p")
def E1_value_correct(spark, d):
    right = F.concat(F.lit("Revenue was $"), F.format_number(F.floor("total_revenue"), 0), F.lit("."))
    wrong = F.concat(F.lit("About "), F.format_string("%.6f", F.col("total_revenue") * 1.5 / 1e6), F.lit(" million."))
    answered = frame(spark, d, PANEL).withColumn("answer", F.when(F.substring("year", 3, 4).cast("int") % 2 == 0, right).otherwise(wrong))
    return answered.select("ticker", "year", ev.value_correct(F.col("answer"), F.when(F.col("net_income") >= 0, F.col("total_revenue"))).alias("value_ok"))


@query("SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN turn % 2 = 0 WHEN turn % 3 = 1 THEN role = 'assistant' END AS intent_ok FROM conversations")
def E3_intent_correct(spark, d):
    c = spark.read.parquet(f"{d}/conversations.parquet")
    parts = F.when(F.col("turn") % 3 == 0, F.array(F.lit("a"), F.lit("b")))
    got = F.when(F.col("turn") % 2 == 0, F.array(F.lit("a"), F.lit("b")))
    return c.select("conv_id", "turn", ev.intent_correct(F.col("role"), got, F.when(F.col("turn") % 3 == 1, "assistant"), parts).alias("intent_ok"))


@query(f"""WITH c AS (SELECT *, (latency % 5) / 4 AS key, CASE WHEN value_correct = 1 THEN 1.0 WHEN value_correct = 0 THEN 0.0 ELSE 0.5 END AS val FROM {CA} c),
s AS (SELECT id, intent_correct, CASE WHEN category = 'Type3' THEN 0.5 * key + 0.5 * 0.25 WHEN category = 'Type2' THEN 0.4 * key + 0.1 * val + 0.5 * 0.25 ELSE 0.15 * key + 0.65 * val + 0.2 * 0.25 END::DOUBLE AS x FROM c)
SELECT id, round(CASE WHEN intent_correct = 0 THEN least(x, 0.5) ELSE x END, 4) AS score FROM s""")
def E8_case_score(spark, d):
    c = frame(spark, d, CASES)
    return c.select("id", ev.case_score(F.col("category"), F.col("intent_correct") == 1, F.col("value_correct") == 1, (F.col("latency") % 5) / 4, F.lit(0.25)).alias("score"))


@query(r"""WITH m AS (SELECT doc_id, regexp_extract(replace(text, ',', ''), '(\d+(?:\.\d+)?)(?:\s*([BbMmTt]))?(?:[^\p{L}\p{N}\p{M}_]|$)', ['n', 'u']) AS m FROM documents)
SELECT doc_id, try_cast(m.n AS DOUBLE) * CASE upper(m.u) WHEN 'B' THEN 1e9 WHEN 'M' THEN 1e6 WHEN 'T' THEN 1e12 ELSE 1.0 END AS number FROM m""")
def Y1_first_number(spark, d):
    return _documents(spark, d).select("doc_id", ev.first_number(F.col("text")).alias("number"))


# Counters and splits.
@query("SELECT event_type, max(user_id) FILTER (n = top) AS n_best, any_value(top) AS peak FROM (SELECT event_type, user_id, n, max(n) OVER (PARTITION BY event_type) AS top FROM (SELECT event_type, user_id, count(*) AS n FROM events GROUP BY 1, 2) a) b GROUP BY 1")
def A16_peak(spark, d):
    n = spark.read.parquet(f"{d}/events.parquet").groupBy("event_type", "user_id").agg(F.count("*").alias("n"))
    return n.groupBy("event_type").agg(F.max_by("user_id", F.struct("n", "user_id")).alias("n_best"), F.max("n").alias("peak"))


@query("SELECT source, count(*) AS n, count(quality) AS judged, count(*) FILTER (quality = 1) AS good, count(*) FILTER (quality = 1) / nullif(count(quality), 0) AS rate FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1")
def A17_conditional_counters(spark, d):
    j = _documents(spark, d).select("doc_id", "source").join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id", "left")
    good = F.count_if(F.col("quality") == 1)
    return j.groupBy("source").agg(F.count("*").alias("n"), F.count("quality").alias("judged"), good.alias("good"), F.try_divide(good, F.count("quality")).alias("rate"))


@query("SELECT conv_id, turn, CAST(concat('0x', substr(md5(CAST(conv_id AS STRING)), 1, 8)) AS BIGINT) < 3650722201 AS train FROM conversations")
def N12_hash_split(spark, d):
    return spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", store.hash_split(F.col("conv_id"), 0.85).alias("train"))


# The first filing of each company and form, as a tree on disk.
_TREE = f"""
SELECT ticker, filing_type, min(date) AS date, CAST(count(*) AS STRING) AS accession_number, CASE WHEN count(*) % 4 = 3 THEN 'scan.pdf' WHEN count(*) % 4 = 2 THEN 'main.htm' ELSE 'exhibit.html' END AS file, CAST(count(*) AS BIGINT) AS length
FROM {FI} f GROUP BY 1, 2
"""


@query(f"SELECT ticker, filing_type, date, accession_number, file, length FROM ({_TREE}) t WHERE filing_type IN ('10-K', '8-K') AND date >= '1993-01-01'")
def S1_S3_filing_tree(spark, d):
    """Written as a tree and read back by the data source, about 50,000 filings at a time; beside each primary file lies a smaller one or one of another type."""
    first = frame(spark, d, _TREE)
    names = ["ticker", "filing_type", "date", "accession_number"]
    spare = F.struct(F.when(F.col("file") == "scan.pdf", "zz.pdf").otherwise("a.pdf").alias("file"), (F.col("length") + 1).alias("n"))
    files = first.select(*names, F.inline(F.array(F.struct("file", F.col("length").alias("n")), spare))).withColumn("content", F.repeat(F.lit("x"), F.col("n").cast("int")))
    found = filing_tree.through_trees(files, work_folder(spark, "filing-tree"), "filing_type in ('10-K', '8-K') and date >= '1993-01-01'", at_once=4)
    return found.select(*names, F.element_at(F.split("source_path", "/"), -1).alias("file"), "length")
