"""All registered queries of the reference's operators with their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstone import sqlsurface
from quillstone.operators import evaluation as ev
from quillstone.operators import metrics, panel, retrieval, store, text
from quillstone.plans.domain import CASES, FACTS, FILINGS, PANEL, facts, frame

_QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(sql: str | None):
    """Registers a function under its name with the DuckDB SQL for its rows."""

    def add(f):
        _QUERIES[f.__name__] = (f, sql)
        return f

    return add


def _load_others() -> None:
    from quillstone.plans import extraction, prompts, scoring, sql_tables, stores, versioned  # noqa: F401  register their queries


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load_others()
    return {k: f for k, (f, _) in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    _load_others()
    return {k: s for k, (_, s) in _QUERIES.items() if s}


def _panel(spark, d):
    return frame(spark, d, PANEL)


def _facts(spark, d):
    return facts(spark, d)


P, FA, FI, CA = (f"({x}) " for x in (PANEL, FACTS, FILINGS, CASES))


# SQL surface: the patterns that questions use, through repair, gate and execution.
def _surface(name: str, asked: str, sql: str):
    def run(spark, d):
        return sqlsurface.execute(spark, asked, {"panel": _panel(spark, d), "financials": _facts(spark, d), "filing_metadata": frame(spark, d, FILINGS)})

    run.__name__ = name
    query(f"WITH panel AS {P}, financials AS {FA}, filing_metadata AS {FI} {sql}")(run)


for _name, _asked, _sql in (
    ("slice0_top_revenue", "SELECT ticker, revenue FROM panel WHERE year = 'FY1997' AND revenue IS NOT NULL ORDER BY revenue DESC, ticker LIMIT 5", "SELECT ticker, total_revenue FROM panel WHERE year = 'FY1997' AND total_revenue IS NOT NULL ORDER BY total_revenue DESC, ticker LIMIT 5"),
    ("Q1_point_lookup", "SELECT profit FROM panel WHERE ticker = 'S1' AND year = 'FY1998'", "SELECT net_income FROM panel WHERE ticker = 'S1' AND year = 'FY1998'"),
    ("Q2_multi_column", "SELECT ticker, year, sales, assets FROM panel WHERE ticker = 'S2'", "SELECT ticker, year, total_revenue, total_assets FROM panel WHERE ticker = 'S2'"),
    ("Q3_in_list", "SELECT ticker, earnings FROM panel WHERE ticker IN ('S1', 'S2', 'S3') AND year = 'FY1999' ORDER BY earnings DESC", "SELECT ticker, net_income FROM panel WHERE ticker IN ('S1', 'S2', 'S3') AND year = 'FY1999'"),
    ("Q4_threshold", "SELECT ticker, year, roa FROM panel WHERE roa > 0.01 ORDER BY roa", "SELECT ticker, year, roa FROM panel WHERE roa > 0.01"),
    ("Q6_lexical_between", "SELECT year, turnover FROM panel WHERE ticker = 'S5' AND year BETWEEN 'FY1996' AND 'FY1999'", "SELECT year, total_revenue FROM panel WHERE ticker = 'S5' AND year BETWEEN 'FY1996' AND 'FY1999'"),
    ("Q7_like", "SELECT ticker, metric, value FROM financials WHERE period LIKE 'FY199%' AND metric ILIKE '%REVENUE%'", "SELECT ticker, metric, value FROM financials WHERE period LIKE 'FY199%' AND metric ILIKE '%REVENUE%'"),
    ("Q8_date_strings", "SELECT ticker, date FROM filing_metadata WHERE date > '2000-12-31'", "SELECT ticker, date FROM filing_metadata WHERE date > '2000-12-31'"),
    ("Q9_change", "SELECT a.ticker, (a.revenue - b.revenue) AS change FROM panel a JOIN panel b ON a.ticker = b.ticker WHERE a.year = 'FY1999' AND b.year = 'FY1998'", "SELECT a.ticker, (a.total_revenue - b.total_revenue) AS change FROM panel a JOIN panel b ON a.ticker = b.ticker WHERE a.year = 'FY1999' AND b.year = 'FY1998'"),
    ("Q10_growth_residual", "SELECT a.ticker, a.value AS now, b.value AS before FROM financials a JOIN financials b ON a.ticker = b.ticker AND a.metric = b.metric WHERE a.period = 'FY1998' AND b.period = 'FY1997' AND a.value >= 1.2 * b.value", "SELECT a.ticker, a.value AS now, b.value AS before FROM financials a JOIN financials b ON a.ticker = b.ticker AND a.metric = b.metric WHERE a.period = 'FY1998' AND b.period = 'FY1997' AND a.value >= 1.2 * b.value"),
    ("J2_fan_out_residual", "SELECT a.ticker, a.metric AS m1, b.metric AS m2 FROM financials a JOIN financials b ON a.ticker = b.ticker AND a.value < b.value WHERE a.period = 'FY1997' AND b.period = 'FY1998' AND a.metric = 'Net income'", "SELECT a.ticker, a.metric AS m1, b.metric AS m2 FROM financials a JOIN financials b ON a.ticker = b.ticker AND a.value < b.value WHERE a.period = 'FY1997' AND b.period = 'FY1998' AND a.metric = 'Net income'"),
    ("J5_semi_join", "SELECT ticker, year, assets FROM panel WHERE ticker IN (SELECT ticker FROM panel WHERE net_income > 20000)", "SELECT ticker, year, total_assets FROM panel WHERE ticker IN (SELECT ticker FROM panel WHERE net_income > 20000)"),
    ("J8_scalar_subquery", "SELECT ticker, year FROM panel WHERE total_revenue > (SELECT max(total_revenue) * 0.9 FROM panel)", "SELECT ticker, year FROM panel WHERE total_revenue > (SELECT max(total_revenue) * 0.9 FROM panel)"),
    ("A1_global_aggregates", "SELECT max(revenue) AS hi, min(revenue) AS lo, CAST(sum(CAST(revenue AS DECIMAL(38,4))) AS DOUBLE) AS total, count(*) AS n FROM panel WHERE year = 'FY1997'", "SELECT max(total_revenue) AS hi, min(total_revenue) AS lo, CAST(sum(CAST(total_revenue AS DECIMAL(38,4))) AS DOUBLE) AS total, count(*) AS n FROM panel WHERE year = 'FY1997'"),
    ("A3_group_count", "SELECT ticker, count(*) AS n FROM filing_metadata GROUP BY ticker", "SELECT ticker, count(*) AS n FROM filing_metadata GROUP BY ticker"),
    ("A4_distinct", "SELECT DISTINCT filing_type, substr(date, 1, 4) AS y FROM filing_metadata", "SELECT DISTINCT filing_type, substr(date, 1, 4) AS y FROM filing_metadata"),
    ("A5_max_date", "SELECT filing_type, max(date) AS latest FROM filing_metadata GROUP BY filing_type", "SELECT filing_type, max(date) AS latest FROM filing_metadata GROUP BY filing_type"),
    ("L1_top_k", "SELECT ticker, year, roa FROM panel WHERE roa IS NOT NULL ORDER BY roa DESC, ticker, year LIMIT 10", "SELECT ticker, year, roa FROM panel WHERE roa IS NOT NULL ORDER BY roa DESC, ticker, year LIMIT 10"),
    ("L2_most_recent", "SELECT ticker, date, accession_number FROM filing_metadata ORDER BY date DESC, accession_number LIMIT 1", "SELECT ticker, date, accession_number FROM filing_metadata ORDER BY date DESC, accession_number LIMIT 1"),
    ("X2_union_all", "SELECT ticker, revenue AS v FROM panel WHERE year = 'FY1997' UNION ALL SELECT ticker, assets AS v FROM panel WHERE year = 'FY1997'", "SELECT ticker, total_revenue AS v FROM panel WHERE year = 'FY1997' UNION ALL SELECT ticker, total_assets AS v FROM panel WHERE year = 'FY1997'"),
):
    _surface(_name, _asked, _sql)


# Sources and stores.
@query(f"SELECT filing_type, count(*) AS n FROM {FI} f GROUP BY 1")
def S5_filings_by_form(spark, d):
    return frame(spark, d, FILINGS).groupBy("filing_type").agg(F.count("*").alias("n"))


@query(f"WITH f AS {FA}, n AS (SELECT ticker, period, statement, metric, CASE WHEN period = 'FY1999' THEN NULL ELSE value * 2 END AS value FROM f WHERE period >= 'FY1999') SELECT ticker, period, statement, metric, value FROM n UNION ALL SELECT f.ticker, f.period, f.statement, f.metric, f.value FROM f WHERE period < 'FY1999'")
def U1_upsert(spark, d):
    old = _facts(spark, d).drop("unit")
    new = old.where("period >= 'FY1999'").withColumn("value", F.when(F.col("period") != "FY1999", F.col("value") * 2)).withColumn("seq", F.lit(1))
    key = ["ticker", "period", "statement", "metric"]
    return store.upsert(old.withColumn("seq", F.lit(0)), new, key, ["seq"]).select(*key, "value")


@query(f"WITH f AS {FA}, n AS (SELECT ticker, period, statement, metric, value * 3 AS value FROM f WHERE metric IN ('Total revenue', 'Net income')) SELECT * FROM n UNION ALL SELECT ticker, period, statement, metric, value FROM f WHERE metric NOT IN ('Total revenue', 'Net income') AND period < 'FY1998'")
def U2_upsert_filtered(spark, d):
    """Only facts with canonical metrics are upserted."""
    f = _facts(spark, d).drop("unit")
    key = ["ticker", "period", "statement", "metric"]
    canonical = spark.createDataFrame([("revenue",), ("income",)], "metric string").select(metrics.metric_key(F.col("metric")).alias("metric"))
    new = metrics.in_canonical(f.where("metric <> 'Revenues, net'"), canonical).withColumn("value", F.col("value") * 3).withColumn("seq", F.lit(1))
    return store.upsert(f.where("period < 'FY1998'").withColumn("seq", F.lit(0)), new, key, ["seq"]).select(*key, "value")


@query(f"SELECT f.* FROM {FA} f WHERE period ILIKE 'fy199%' AND statement = 'balance_sheet' AND metric ILIKE '%ASSETS'")
def U3_query(spark, d):
    return store.query_facts(_facts(spark, d), period_like="fy199%", statement="balance_sheet", metric_like="%ASSETS")


_YEARS = [f"FY{y}" for y in range(1995, 2002)]


@query(f"SELECT ticker, statement, metric, {', '.join(f"max(CASE WHEN period = '{y}' THEN value END) AS {y}" for y in _YEARS)} FROM {FA} f GROUP BY ALL")
def U4_pivot(spark, d):
    p = store.pivot_periods(_facts(spark, d))
    return p.select("ticker", "statement", "metric", *(F.col(y) if y in p.columns else F.lit(None).cast("double").alias(y) for y in _YEARS))


@query(f"SELECT DISTINCT ticker, period FROM {FA} f")
def U7_tickers_periods(spark, d):
    return _facts(spark, d).select("ticker", "period").distinct()


@query(f"SELECT (SELECT count(*) FROM {FA} f) AS n_facts, (SELECT count(DISTINCT ticker) FROM {FA} f) AS n_tickers, (SELECT count(*) FROM {FI} f) AS n_filings")
def U9_stats(spark, d):
    return store.stats(_facts(spark, d), frame(spark, d, FILINGS))


@query("SELECT doc_id, lang FROM documents WHERE source <> 'src0' AND doc_id NOT IN (SELECT doc_id FROM labels)")
def U10_add_chunks(spark, d):
    stored = spark.read.parquet(f"{d}/labels.parquet").select(F.col("doc_id").alias("chunk_id"))
    new = spark.read.parquet(f"{d}/documents.parquet").where("source <> 'src0'").select(F.col("doc_id").alias("chunk_id"), "lang")
    return store.add_chunks(stored, new).select(F.col("chunk_id").alias("doc_id"), "lang")


# Metric frequency.
_KEY = "list_aggregate(list_sort(list_filter(string_split_regex(regexp_replace(lower(metric), '[^a-z\\s]', ' ', 'g'), '\\s+'), lambda w: length(w) > 1 AND w NOT IN ({}))), 'string_agg', ' ')".format(", ".join(f"'{w}'" for w in metrics.FILLERS))


@query(f"SELECT DISTINCT metric, {_KEY} AS key FROM {FA} f")
def M1_metric_key(spark, d):
    return _facts(spark, d).select("metric", metrics.metric_key(F.col("metric")).alias("key")).distinct()


@query(f"WITH f AS (SELECT f.*, {_KEY} AS key FROM {FA} f) SELECT DISTINCT key, ticker FROM f WHERE value IS NOT NULL AND length(key) >= 4")
def M4_frequency_matrix(spark, d):
    return metrics.frequency_matrix(_facts(spark, d))


@query(f"""WITH f AS (SELECT f.*, {_KEY} AS key FROM {FA} f), r AS (SELECT * FROM f WHERE value IS NOT NULL AND length(key) >= 4),
m AS (SELECT key, statement, row_number() OVER (PARTITION BY key ORDER BY count(*) DESC, statement) AS rn FROM r GROUP BY 1, 2), n AS (SELECT count(DISTINCT ticker) AS n FROM f)
SELECT r.key AS metric, any_value(m.statement) AS statement, count(DISTINCT ticker) AS ticker_count, count(DISTINCT ticker) / any_value(n.n) AS ticker_pct FROM r JOIN m ON r.key = m.key AND m.rn = 1, n GROUP BY r.key HAVING count(DISTINCT ticker) / any_value(n.n) >= 0.5""")
def M5_canonical_metrics(spark, d):
    return metrics.canonical_metrics(_facts(spark, d), 0.5).drop("canonical_name")


# Panel.
_CAND = [("total_revenue", "income_statement", "Revenues, net", 1, True), ("total_revenue", "income_statement", "Total revenue", 2, True), ("net_income", "income_statement", "Net income", 1, False), ("total_assets", "balance_sheet", "Total assets", 1, True), ("current_assets", "balance_sheet", "Current assets", 1, True), ("current_liabilities", "balance_sheet", "Current liabilities", 1, True), ("long_term_debt", "balance_sheet", "Total liabilities", 1, False)]
_COLS = list(dict.fromkeys(c[0] for c in _CAND))


def _picked(spark, d):
    cand = spark.createDataFrame(_CAND, "col string, statement string, metric string, rank int, positive_only boolean")
    return panel.wide(panel.pick_priority(_facts(spark, d), cand), _COLS)


_PICKED = f"(SELECT ticker, period, max(CASE WHEN metric = 'Revenues, net' AND value > 0 THEN value END) AS total_revenue, max(CASE WHEN metric = 'Net income' THEN value END) AS net_income, max(CASE WHEN metric = 'Total assets' AND value > 0 THEN value END) AS total_assets, max(CASE WHEN metric = 'Current assets' AND value > 0 THEN value END) AS current_assets, max(CASE WHEN metric = 'Current liabilities' AND value > 0 THEN value END) AS current_liabilities, max(CASE WHEN metric = 'Total liabilities' THEN value END) AS long_term_debt FROM {FA} f GROUP BY 1, 2)"


@query(f"SELECT * FROM {_PICKED} p")
def P1_priority_pick(spark, d):
    return _picked(spark, d)


@query(f"WITH p AS {_PICKED}, g AS (SELECT * FROM (SELECT DISTINCT ticker FROM p) a, (SELECT DISTINCT period FROM p) b) SELECT g.ticker, g.period, p.total_revenue, p.net_income FROM g LEFT JOIN p ON g.ticker = p.ticker AND g.period = p.period")
def P2_densify(spark, d):
    return panel.densify(_picked(spark, d)).select("ticker", "period", "total_revenue", "net_income")


@query(f"SELECT ticker, period, CASE WHEN net_income BETWEEN -500000 AND 100000 THEN net_income END AS net_income FROM {_PICKED} p")
def P3_plausibility(spark, d):
    return panel.null_implausible(_picked(spark, d), {"net_income": (-5e5, 1e5)}).select("ticker", "period", "net_income")


@query(f"SELECT ticker, period, CASE WHEN current_assets / nullif(current_liabilities, 0) BETWEEN 0 AND 50 THEN current_assets / nullif(current_liabilities, 0) END AS current_ratio, CASE WHEN net_income / nullif(total_assets, 0) BETWEEN -1 AND 1 THEN net_income / nullif(total_assets, 0) END AS roa, CASE WHEN long_term_debt / nullif(total_assets, 0) BETWEEN 0 AND 5 THEN long_term_debt / nullif(total_assets, 0) END AS debt_to_assets FROM {_PICKED} p")
def P4_derived_ratios(spark, d):
    p = panel.add_ratios(_picked(spark, d), debt="long_term_debt", zero_is_missing=False)
    return panel.null_implausible(p, panel.RATIO_BOUNDS).select("ticker", "period", "current_ratio", "roa", "debt_to_assets")


@query(f"WITH p AS {_PICKED} " + " UNION ALL ".join(f"SELECT '{c}' AS col, count({c}) AS filled, count(*) AS total, count({c}) / count(*) AS rate FROM p" for c in _COLS))
def P6_fill_rates(spark, d):
    return panel.fill_rates(_picked(spark, d), _COLS)


_XBRL = "SELECT l_suppkey AS ticker, year(l_shipdate) AS fy, CASE WHEN l_returnflag = 'R' THEN 'Q1' ELSE 'FY' END AS fp, CASE WHEN l_linestatus = 'F' THEN '10-K' ELSE '10-K/A' END AS form, concat('C', CAST(l_partkey % 7 AS STRING)) AS concept, 'USD' AS unit, CAST(l_shipdate AS STRING) AS filed, l_linenumber AS pos, l_extendedprice AS val, l_orderkey, l_partkey, l_quantity, l_discount, l_tax FROM lineitem"
_MAP = [("revenue", "C1", "USD", 1), ("revenue", "C2", "USD", 2), ("income", "C3", "USD", 1), ("income", "C9", "USD", 2)]
_TIE = ["val", "l_orderkey", "l_partkey", "l_quantity", "l_discount", "l_tax"]


@query(f"""WITH m(col, concept, rank) AS (VALUES ('revenue', 'C1', 1), ('revenue', 'C2', 2), ('income', 'C3', 1), ('income', 'C9', 2)), x AS ({_XBRL}),
r AS (SELECT x.*, m.col, row_number() OVER (PARTITION BY ticker, fy, m.col ORDER BY m.rank, form = '10-K/A' DESC, filed DESC, pos DESC, {', '.join(t + ' DESC' for t in _TIE)}) AS n FROM x JOIN m ON x.concept = m.concept WHERE fp = 'FY')
SELECT ticker, fy, col, concept, val FROM r WHERE n = 1""")
def P7_P8_xbrl_resolution(spark, d):
    mapping = spark.createDataFrame(_MAP, "col string, concept string, unit string, rank int")
    return panel.resolve_xbrl(frame(spark, d, _XBRL), mapping, _TIE)


@query(f"SELECT ticker, year, current_ratio, net_margin, roa, debt_to_assets FROM {P} p")
def P9_row_per_year(spark, d):
    return panel.add_ratios(_panel(spark, d).drop("current_ratio", "net_margin", "roa", "debt_to_assets")).select("ticker", "year", "current_ratio", "net_margin", "roa", "debt_to_assets")


# Windows.
@query(f"SELECT ticker, year, total_revenue FROM (SELECT p.*, row_number() OVER (PARTITION BY ticker ORDER BY year DESC) AS n FROM {P} p) q WHERE n <= 3")
def W5_last_three_years(spark, d):
    w = Window.partitionBy("ticker").orderBy(F.desc("year"))
    return _panel(spark, d).withColumn("n", F.row_number().over(w)).where("n <= 3").select("ticker", "year", "total_revenue")


# Text.
@query(r"""SELECT doc_id, len(list_filter(list_transform(string_split(regexp_replace(regexp_replace(text, '([.!?])\s+', '\1<SEP>', 'g'), '\n{2,}', '<SEP>', 'g'), '<SEP>'), lambda s: trim(s, E' \t\n\r')), lambda s: s <> '')) AS n_sentences FROM documents""")
def T8_sentences(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.size(text.sentences(F.col("text"))).cast("long").alias("n_sentences"))


@query(None)
def T9_T10_chunks(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet")
    c = docs.select("doc_id", "source", F.posexplode(text.chunks(F.col("text"))).alias("chunk_index", "text"))
    return c.withColumn("chunk_id", text.chunk_id(F.col("doc_id").cast("string"), F.col("source"), F.col("chunk_index")))


@query("SELECT doc_id, CASE WHEN contains(upper(text), 'BILLION') THEN 1e9 WHEN contains(upper(text), 'MILLION') THEN 1e6 WHEN contains(upper(text), 'THOUSAND') THEN 1e3 ELSE 1.0 END::DOUBLE AS scale FROM documents")
def T13_scale(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", text.detect_scale(F.col("text")).alias("scale"))


@query(f"SELECT accession_number, CASE WHEN filing_type = '10-K' THEN concat('FY', substr(date, 1, 4)) ELSE substr(date, 1, 7) END AS period FROM {FI} f")
def T18_period(spark, d):
    return frame(spark, d, FILINGS).select("accession_number", text.fiscal_period(F.col("filing_type"), F.col("date")).alias("period"))


# Retrieval: stated queries against all rows.
_COS = "list_dot_product(q.v, c.v) / sqrt(list_dot_product(q.v, q.v) * list_dot_product(c.v, c.v))"
_VEC = "SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings"


def _dense(spark, d, k=20):
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qvec"))
    return retrieval.dense_top_k(q, e.select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vec")), k, decimals=6)


@query(f"WITH e AS ({_VEC}), s AS (SELECT q.vec_id AS query_id, c.vec_id AS chunk_id, round({_COS}, 6) AS score FROM e q, e c WHERE q.vec_id % 50 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM s) SELECT query_id, chunk_id, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 20")
def R3_dense_top_k(spark, d):
    return _dense(spark, d).select("query_id", "chunk_id", "rank")


_TERMS = "regexp_extract_all(lower({}), '[a-z0-9_]{{2,}}')"
_BM25_OF = """
c AS (SELECT doc_id AS chunk_id, """ + _TERMS.format("text") + """ AS terms FROM documents), l AS (SELECT chunk_id, len(terms) AS dl FROM c), w AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM l),
qt AS (SELECT query_id, unnest(list_distinct(""" + _TERMS.format("text") + """)) AS term FROM q), t AS (SELECT chunk_id, unnest(terms) AS term FROM c),
tf AS (SELECT chunk_id, term, count(*) AS tf FROM t WHERE term IN (SELECT term FROM qt) GROUP BY 1, 2), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
s AS (SELECT qt.query_id, tf.chunk_id, round(sum(floor(ln(1 + (w.n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / w.avgdl)) * 1e9 + 0.5)::BIGINT)::DOUBLE / 1e9, 6) AS score FROM tf JOIN df USING (term) JOIN qt USING (term) JOIN l USING (chunk_id), w GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM s WHERE score > 0)"""
_BM25 = "q AS (SELECT item_id AS query_id, text FROM benchmark)," + _BM25_OF
# The dense list of the same questions: their vectors are the rows of embeddings with their id, and chunks share the ids of documents.
_DENSE = f"""e AS ({_VEC}), ds AS (SELECT q.query_id, c.vec_id AS chunk_id, round({_COS.replace('q.v', 'qv.v')}, 6) AS score FROM q JOIN e qv ON qv.vec_id = q.query_id, e c),
dr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM ds)"""
_FUSED = """f AS (SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.chunk_id, b.chunk_id) AS chunk_id, coalesce(1 / (60 + a.rank), 0) + coalesce(1 / (60 + b.rank), 0) AS rrf_score, a.rank AS dense_rank, b.rank AS sparse_rank
FROM (SELECT * FROM dr WHERE rank <= {k}) a FULL JOIN (SELECT * FROM r WHERE rank <= {k}) b ON a.query_id = b.query_id AND a.chunk_id = b.chunk_id)"""


def _chunks(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("chunk_id"), "text")


def _vectors(spark, d):
    return spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vec"))


def _questions(spark, d):
    q = spark.read.parquet(f"{d}/benchmark.parquet").select(F.col("item_id").alias("query_id"), "text")
    return q.join(_vectors(spark, d).withColumnRenamed("vec", "qvec"), F.col("query_id") == F.col("chunk_id"), "left").select("query_id", "text", "qvec")


def _sparse(spark, d):
    return retrieval.bm25_scores(_questions(spark, d).select("query_id", "text"), _chunks(spark, d))


def _lists(spark, d, k):
    """Dense and sparse top k of the questions."""
    dense = retrieval.dense_top_k(_questions(spark, d).select("query_id", "qvec"), _vectors(spark, d), k, decimals=6)
    return dense, retrieval.top_k(_sparse(spark, d), k)


@query(f"WITH {_BM25} SELECT query_id, count(*) AS n, max(score) AS best FROM s GROUP BY 1")
def R4_R5_bm25(spark, d):
    return _sparse(spark, d).groupBy("query_id").agg(F.count("*").alias("n"), F.max("score").alias("best"))


@query(f"WITH {_BM25} SELECT query_id, chunk_id, score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 20")
def R5_bm25_top_k(spark, d):
    return retrieval.top_k(_sparse(spark, d), 20)


@query(f"WITH {_BM25}, {_DENSE}, {_FUSED.format(k=20)} SELECT query_id, chunk_id, rrf_score, CAST(dense_rank AS INTEGER) AS dense_rank, CAST(sparse_rank AS INTEGER) AS sparse_rank FROM f")
def R7_rank_fusion(spark, d):
    return retrieval.reciprocal_rank_fusion(*_lists(spark, d, 20)).select("query_id", "chunk_id", "rrf_score", "dense_rank", "sparse_rank")


@query(f"""WITH {_BM25}, {_DENSE}, {_FUSED.format(k=20)}, m AS (SELECT query_id // 2 AS question_id, chunk_id, max(rrf_score) AS rrf_score FROM f GROUP BY 1, 2),
o AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY rrf_score DESC, chunk_id) AS rank FROM m) SELECT question_id, chunk_id, rrf_score, CAST(rank AS INTEGER) AS rank FROM o WHERE rank <= 25""")
def R13_best_of_queries(spark, d):
    fused = retrieval.reciprocal_rank_fusion(*_lists(spark, d, 20)).withColumn("question_id", F.expr("query_id div 2"))
    return retrieval.best_of_queries(fused, cap=25)


@query(f"""WITH {_BM25}, {_DENSE}, {_FUSED.format(k=40)} SELECT query_id, count(dense_rank) AS dense_recall_count, count(sparse_rank) AS sparse_recall_count, count(*) AS candidate_pool_size, least(count(*), 50) AS rerank_input_size FROM f GROUP BY 1""")
def R14_stage_counts(spark, d):
    n = retrieval.stage_counts(*_lists(spark, d, 40))
    return n.select("query_id", *(F.col(c).cast("bigint").alias(c) for c in n.columns if c != "query_id"))


# Filtered retrieval: a third of the questions names a ticker, form and year, a third a company; chunks have these fields by their id.
_ASKED = "SELECT item_id AS query_id, concat(CASE item_id % 3 WHEN 0 THEN 'What did AAPL say in its 10-K of FY2021? ' WHEN 1 THEN 'What did Microsoft report? ' ELSE '' END, text) AS text FROM benchmark"
_META = "SELECT doc_id AS chunk_id, text, CASE doc_id % 4 WHEN 0 THEN 'AAPL' WHEN 1 THEN 'MSFT' WHEN 2 THEN 'IBM' END AS ticker, CASE doc_id % 3 WHEN 0 THEN '10-K' ELSE '8-K' END AS filing_type, concat(CAST(2019 + doc_id % 5 AS STRING), '-03-01') AS date FROM documents"
_NAMED = f"""CASE WHEN len(named) = 1 THEN named[1] {" ".join(f"WHEN regexp_matches(lower(text), '{retrieval.NAME.format(n)}') THEN '{t}'" for n, t in retrieval.COMPANIES.items())} END AS ticker,
CASE WHEN regexp_matches(text, '(?i)\\b10-?K\\b') THEN '10-K' WHEN regexp_matches(text, '(?i)\\b10-?Q\\b') THEN '10-Q' WHEN regexp_matches(text, '(?i)\\b8-?K\\b') THEN '8-K' END AS filing_type,
nullif(regexp_extract(text, '(?i)\\b(?:FY|fiscal\\s+)?(20\\d{{2}})\\b', 1), '') AS year"""
_TICKERS_OF = "list_distinct(list_transform(list_filter(regexp_extract_all({}, '\\b[A-Z]{{1,5}}\\b'), lambda w: w IN (" + ", ".join(f"'{t}'" for t in retrieval.TICKERS) + ")), lambda w: CASE w WHEN 'GOOGL' THEN 'GOOG' ELSE w END))"


def _filtered(spark, d):
    """The questions with their vectors, and the chunks with vector (null where there is none), text and metadata."""
    questions = frame(spark, d, _ASKED).join(_questions(spark, d).select("query_id", "qvec"), "query_id")
    return questions, frame(spark, d, _META).join(_vectors(spark, d), "chunk_id", "left")


@query(f"""WITH q AS ({_ASKED}), n AS (SELECT query_id, {_NAMED} FROM (SELECT *, {_TICKERS_OF.format('text')} AS named FROM q) x), meta AS ({_META}),
p AS (SELECT n.query_id, m.chunk_id, coalesce(n.ticker, n.filing_type, n.year) IS NOT NULL AS has FROM n, meta m WHERE (n.ticker IS NULL OR n.ticker = m.ticker) AND (n.filing_type IS NULL OR n.filing_type = m.filing_type) AND (n.year IS NULL OR contains(m.date, n.year))),
{_BM25_OF.replace(" FROM s WHERE score > 0", " FROM (SELECT s.* FROM s JOIN p USING (query_id, chunk_id) WHERE has) s WHERE score > 0").replace("qt AS (SELECT query_id,", "qt AS (SELECT query_id,")}, {_DENSE.replace("FROM ds)", "FROM (SELECT ds.* FROM ds JOIN p USING (query_id, chunk_id)) ds)")}, {_FUSED.format(k=40)},
g AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, dense_rank NULLS LAST, sparse_rank NULLS LAST) AS rank FROM f),
x AS (SELECT g.query_id, g.chunk_id, g.rrf_score, list_distinct({_TERMS.format('q.text')}) AS qt, {_TERMS.format('m.text')} AS ct FROM g JOIN q USING (query_id) JOIN meta m USING (chunk_id) WHERE g.rank <= 50),
y AS (SELECT query_id, chunk_id, rrf_score, coalesce(len(list_intersect(qt, ct)) / nullif(len(qt), 0), 0) AS scored FROM x)
SELECT query_id, chunk_id, rrf_score, CASE WHEN max(scored) OVER o = min(scored) OVER o THEN 1.0 ELSE (scored - min(scored) OVER o) / (max(scored) OVER o - min(scored) OVER o) END::DOUBLE AS relevance FROM y WINDOW o AS (PARTITION BY query_id)""")
def R8_R12_filtered_candidates(spark, d):
    questions, chunks = _filtered(spark, d)
    fused = retrieval.reciprocal_rank_fusion(*retrieval.recall(questions, chunks, 40))
    return retrieval.rerank(fused, questions, chunks).select("query_id", "chunk_id", "rrf_score", "relevance")


@query(None)
def R11_R12_hybrid_mmr(spark, d):
    return retrieval.retrieve(*_filtered(spark, d))


# Evaluation.
def _cases(spark, d):
    return frame(spark, d, CASES)


@query(f"SELECT CASE WHEN contains(category, 'Type3') THEN 'Type3' WHEN contains(category, 'Type2') AND NOT contains(category, 'Type1') THEN 'Type2' ELSE 'Type1' END AS type, count(*) AS n, sum(value_correct) / count(value_correct) AS value_accuracy, sum(intent_correct) / count(intent_correct) AS intent_accuracy FROM {CA} c GROUP BY 1")
def A8_A11_E7_means_per_type(spark, d):
    mean = lambda c: F.try_divide(F.sum(c), F.count(c))
    return _cases(spark, d).groupBy(ev.map_category(F.col("category")).alias("type")).agg(F.count("*").alias("n"), mean("value_correct").alias("value_accuracy"), mean("intent_correct").alias("intent_accuracy"))


@query("WITH s AS (SELECT event_type, list_sort(list(value)) AS l FROM events WHERE value IS NOT NULL GROUP BY 1) SELECT event_type, l[least(CAST(floor(len(l) * 0.5) AS BIGINT), len(l) - 1) + 1] AS p50, l[least(CAST(floor(len(l) * 0.95) AS BIGINT), len(l) - 1) + 1] AS p95 FROM s")
def A9_A13_floor_percentiles(spark, d):
    return ev.percentiles(spark.read.parquet(f"{d}/events.parquet"), "event_type", "value", {"p50": 0.5, "p95": 0.95})


@query(f"SELECT config, id, latency FROM (SELECT c.*, row_number() OVER (PARTITION BY config ORDER BY latency DESC, id) AS n FROM {CA} c) q WHERE n = 1")
def A15_best_per_group(spark, d):
    return store.latest_per_key(_cases(spark, d), ["config"], [F.desc("latency"), "id"]).select("config", "id", "latency")


@query(f"WITH c AS {CA}, a AS (SELECT * FROM c WHERE id % 3 <> 0), b AS (SELECT id, intent_correct AS value_correct FROM c WHERE id % 3 <> 1) SELECT coalesce(a.id, b.id) AS id, a.value_correct AS a_value_correct, b.value_correct AS b_value_correct, a.id IS NOT NULL AND b.id IS NOT NULL AND a.value_correct IS DISTINCT FROM b.value_correct AS disagree FROM a FULL JOIN b ON a.id = b.id")
def J10_E10_compare_runs(spark, d):
    c = _cases(spark, d)
    return ev.compare_runs(c.where("id % 3 <> 0"), c.where("id % 3 <> 1").select("id", F.col("intent_correct").alias("value_correct")), "id", "value_correct")


@query("SELECT doc_id, (contains(lower(text), 'the')::int + contains(lower(text), 'und')::int + contains(lower(text), 'que')::int) / 3 AS rate FROM documents")
def E2_keyword_rate(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", ev.keyword_hit_rate(F.col("text"), F.array(*map(F.lit, ("the", "und", "que")))).alias("rate"))


@query(r"""WITH w AS (SELECT doc_id, trim(text) AS t, list_filter(string_split_regex(lower(trim(text)), '\s+'), lambda x: x <> '') AS l FROM documents),
r AS (SELECT *, list_transform(range(1, greatest(len(l) - 3, 1)), lambda i: array_to_string(l[i:i+4], ' ')) AS runs, regexp_matches(t, '[.!?"]$') AS ends FROM w)
SELECT doc_id, CASE WHEN length(t) < 10 THEN 1 WHEN len(runs) > len(list_distinct(runs)) THEN 2 WHEN len(l) < 15 THEN 3 WHEN len(l) >= 30 AND ends THEN 5 WHEN ends THEN 4 ELSE 3 END AS fluency FROM r""")
def E4_fluency(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", ev.fluency(F.col("text")).alias("fluency"))


@query("SELECT role, count(*) AS n, count(DISTINCT conv_id) AS n_conversations FROM conversations GROUP BY 1")
def A12_role_counts(spark, d):
    return spark.read.parquet(f"{d}/conversations.parquet").groupBy("role").agg(F.count("*").alias("n"), F.countDistinct("conv_id").alias("n_conversations"))
