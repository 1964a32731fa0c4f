"""Queries over tables of statements: repair, gate, rewriting and execution."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from quillstone.operators import templates
from quillstone.plans.domain import FILINGS, PANEL, frame
from quillstone.plans.registry import query
from quillstone.sources.tables import save_table
from quillstone.sqlsurface import statements

P = f"({PANEL})"


def _made(spark, d, shapes: list[str], name: str = "sql"):
    """A row a shape and row of the panel, with {ticker} and {year} put in."""
    filled = lambda s: F.replace(F.replace(F.lit(s), F.lit("{ticker}"), F.col("ticker")), F.lit("{year}"), F.col("year"))
    rows = F.posexplode(F.array(*map(filled, shapes))).alias("shape", name)
    return frame(spark, d, PANEL).select("ticker", "year", rows)


def _shapes_sql(shapes: list[str], name: str) -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    return f"CASE shape {' '.join(f'WHEN {i} THEN {quote(s)}' for i, s in enumerate(shapes))} END".replace("{ticker}", "' || ticker || '").replace("{year}", "' || year || '") + f" AS {name}"


_ASKED = [
    "SELECT sales, Profit FROM panel WHERE ticker = '{ticker}' AND year = '{year}'", "SELECT ticker FROM panel, secret WHERE year = '{year}'", "DROP TABLE panel -- {ticker}",
    "SELECT ticker FROM panel WHERE ticker IN ('GOOGL', '{ticker}') AND revenue > (SELECT avg(revenue) FROM panel WHERE panel.year = year)", "WITH a AS (SELECT * FROM b), b AS (SELECT '{ticker}' AS x) SELECT x FROM a",
]
_REPAIRED = [_ASKED[0].replace("sales, Profit", "total_revenue, net_income"), _ASKED[1], _ASKED[2], _ASKED[3].replace("GOOGL", "GOOG").replace("revenue", "total_revenue"), _ASKED[4]]
_ERRORS = ["", "unknown tables: secret", "Only SELECT statements allowed: DropTable, UnresolvedIdentifier", "panel.year = year compares a column of the inner panel with itself: give it an alias", "unknown tables: b"]


@query(f"""SELECT ticker, year, shape::INTEGER AS shape, {_shapes_sql(_REPAIRED, 'sql_repaired')}, CASE shape WHEN 0 THEN 'sales -> total_revenue,Profit -> net_income' WHEN 3 THEN 'GOOGL -> GOOG,revenue -> total_revenue,revenue -> total_revenue' ELSE '' END AS repairs,
shape = 0 AS is_valid, {_shapes_sql(_ERRORS, 'error')} FROM {P} p, (SELECT unnest(range(5)) AS shape)""")
def N1_N2_Y10_statement_table(spark, d):
    """Repair as a column over all statements; the gate reads each template once."""
    found = statements.statement_records(_made(spark, d, _ASKED), {"panel"})
    return found.select("ticker", "year", "shape", "sql_repaired", F.array_join("repairs", ",").alias("repairs"), "is_valid", "error")


_WIDE = [
    "SELECT net_income FROM panel WHERE ticker = '{ticker}' AND year = '{year}'", "SELECT ticker, AVG(total_revenue) FROM panel WHERE year IN ('FY1993', '{year}') GROUP BY ticker",
    "SELECT year, net_income FROM panel WHERE ticker = '{ticker}' AND year BETWEEN 'FY1993' AND 'FY1995' ORDER BY year;", "SELECT ticker, total_revenue FROM panel ORDER BY total_revenue DESC LIMIT 3", "SELECT ticker FROM panel WHERE year = '{year}'",
]
_LONG = [
    "SELECT value FROM financials WHERE metric = 'Net income' AND ticker = '{ticker}' AND period = '{year}';", "SELECT ticker, AVG(value) FROM financials WHERE metric = 'Total revenue' AND period IN ('FY1993', '{year}') GROUP BY ticker;",
    "SELECT period, value FROM financials WHERE metric = 'Net income' AND ticker = '{ticker}' AND period IN ('FY1993', 'FY1994', 'FY1995') ORDER BY period;", "SELECT ticker, value FROM financials  WHERE metric = 'Total revenue' ORDER BY value DESC LIMIT 3;",
]


@query(f"SELECT ticker, year, shape::INTEGER AS shape, {_shapes_sql(_LONG, 'sql')} FROM {P} p, (SELECT unnest(range(5)) AS shape)")
def N5_panel_rewrite(spark, d):
    """Equality, IN, BETWEEN, ORDER BY and aggregates; a statement without a metric gives null."""
    made = _made(spark, d, _WIDE, "wide")
    return made.select("ticker", "year", "shape", statements.panel_to_long(F.col("wide"), {"net_income": "Net income", "total_revenue": "Total revenue"}).alias("sql"))


_RUN = [
    "SELECT revenue FROM panel WHERE ticker = '{ticker}' AND year = '{year}'", "SELECT ticker, sales FROM panel WHERE year = '{year}' ORDER BY total_revenue DESC, ticker LIMIT 3", "SELECT max(profit), count(*) FROM panel WHERE ticker = '{ticker}'",
    "SELECT year FROM panel WHERE ticker = '{ticker}' AND year > '{year}'", "SELECT nothing FROM panel WHERE ticker = '{ticker}'",
]


def _panel_tables(spark, d):
    return {"panel": save_table(frame(spark, d, PANEL), "panel")}


@query(f"""WITH p AS ({PANEL}), s AS (SELECT ticker, year, unnest(range(5)) AS shape FROM p)
SELECT ticker, year, shape::INTEGER AS shape, CASE shape WHEN 0 THEN 1 WHEN 1 THEN (SELECT least(3, count(*)) FROM p q WHERE q.year = s.year) WHEN 2 THEN 1 WHEN 3 THEN (SELECT count(*) FROM p q WHERE q.ticker = s.ticker AND q.year > s.year) END::BIGINT AS n_rows, shape < 4 AS runs FROM s""")
def N8_statement_runs(spark, d):
    """Each template is one job, however many statements have it."""
    made = save_table(_made(spark, d, _RUN), "asked")
    found = statements.statement_results(made, _panel_tables(spark, d))
    return made.join(found, "sql").select("ticker", "year", "shape", "n_rows", (F.col("error") == "").alias("runs"))


_PREDICTED = ["SELECT total_revenue FROM panel WHERE year = '{year}' AND ticker = '{ticker}'", "SELECT year FROM panel WHERE ticker = '{ticker}' AND year >= '{year}'", "SELECT FROM panel WHERE ticker = '{ticker}'"]
_EXPECTED = ["SELECT revenue FROM panel WHERE ticker = '{ticker}' AND year = '{year}'", "SELECT year FROM panel WHERE ticker = '{ticker}' AND year > '{year}'", "SELECT max(year) FROM panel WHERE ticker = '{ticker}'"]


@query(f"""WITH p AS ({PANEL}), s AS (SELECT ticker, year, unnest(range(3)) AS shape, EXISTS (SELECT 1 FROM p q WHERE q.ticker = p.ticker AND q.year > p.year) AS later FROM p)
SELECT ticker, year, shape::INTEGER AS shape, true AS expected_ok, shape <> 1 OR later AS expected_has_rows, shape <> 2 AS predicted_ok, CASE WHEN shape <> 1 OR later THEN shape = 0 END AS rows_match FROM s""")
def N13_execution_match(spark, d):
    made = _made(spark, d, _PREDICTED, "predicted").join(_made(spark, d, _EXPECTED, "expected"), ["ticker", "year", "shape"])
    return statements.execution_match(made, _panel_tables(spark, d)).select("ticker", "year", "shape", "expected_ok", "expected_has_rows", "predicted_ok", "rows_match")


_CALLED = {"total_revenue": "revenue", "net_income": "net income", "cash": "cash"}
_CELLS = " UNION ALL ".join(f"SELECT ticker, year, '{c}' AS col, '{w}' AS words, {c}::DOUBLE AS value FROM p" for c, w in _CALLED.items())
_MANY = {
    "lookup": ("v", "'What was ' || ticker || '''s ' || words || ' in ' || year || '?'", "'SELECT ' || col || ' FROM panel WHERE ticker = ''' || ticker || ''' AND year = ''' || year || ''''"),
    "trend": ("(SELECT DISTINCT ticker, col, words FROM v)", "'How has ' || ticker || '''s ' || words || ' changed over the years?'", "'SELECT year, ' || col || ' FROM panel WHERE ticker = ''' || ticker || ''' AND ' || col || ' IS NOT NULL ORDER BY year'"),
    "span": ("(SELECT * FROM r WHERE first IS NOT NULL)", "'Show ' || ticker || '''s ' || words || ' from ' || first || ' to ' || year || '.'", "'SELECT year, ' || col || ' FROM panel WHERE ticker = ''' || ticker || ''' AND year BETWEEN ''' || first || ''' AND ''' || year || ''' ORDER BY year'"),
    "change": ("(SELECT * FROM r WHERE before IS NOT NULL)", "'How did ' || ticker || '''s ' || words || ' change from ' || before || ' to ' || year || '?'", "'SELECT year, ' || col || ' FROM panel WHERE ticker = ''' || ticker || ''' AND year IN (''' || before || ''', ''' || year || ''') ORDER BY year'"),
    "comparison": ("(SELECT * FROM r WHERE other IS NOT NULL)", "'Compare ' || ticker || '''s and ' || other || '''s ' || words || ' in ' || year || '.'", "'SELECT ticker, ' || col || ' FROM panel WHERE ticker IN (''' || ticker || ''', ''' || other || ''') AND year = ''' || year || ''''"),
    "ranking": ("y", "'Which 5 companies had the highest ' || words || ' in ' || year || '?'", "'SELECT ticker, ' || col || ' FROM panel WHERE year = ''' || year || ''' AND ' || col || ' IS NOT NULL ORDER BY ' || col || ' DESC LIMIT 5'"),
    "lowest": ("y", "'Which 5 companies had the lowest ' || words || ' in ' || year || '?'", "'SELECT ticker, ' || col || ' FROM panel WHERE year = ''' || year || ''' AND ' || col || ' IS NOT NULL ORDER BY ' || col || ' ASC LIMIT 5'"),
    "filter": ("y", "'Which companies had ' || words || ' of at least ' || lim || ' in ' || year || '?'", "'SELECT ticker, ' || col || ' FROM panel WHERE year = ''' || year || ''' AND ' || col || ' >= ' || lim"),
    "average": ("y", "'What was the average ' || words || ' of all companies in ' || year || '?'", "'SELECT avg(' || col || ') FROM panel WHERE year = ''' || year || ''' AND ' || col || ' IS NOT NULL'"),
}


@query(f"""WITH p AS ({PANEL}), v AS (SELECT * FROM ({_CELLS}) WHERE value IS NOT NULL),
r AS (SELECT *, lag(year) OVER o AS before, lag(year, 2) OVER o AS first, lead(ticker) OVER (PARTITION BY year, col ORDER BY md5(concat_ws('|', 'pairs', col, year, ticker)), ticker) AS other FROM v WINDOW o AS (PARTITION BY ticker, col ORDER BY year)),
y AS (SELECT year, col, words, floor(quantile_disc(value, 0.75))::BIGINT::VARCHAR AS lim FROM v GROUP BY ALL),
a AS ({' UNION ALL '.join(f"SELECT '{k}' AS kind, col, {q} AS question, {x} AS sql FROM {t}" for k, (t, q, x) in _MANY.items())})
SELECT kind, col AS "column", question, sql FROM a QUALIFY row_number() OVER (PARTITION BY kind, col ORDER BY md5(concat_ws('|', 'pairs', kind, question)), question) <= 40""")
def N11_generated_pairs(spark, d):
    """Nine kinds of questions over three columns; the limit of 40 a kind and column is the sample."""
    return templates.generated_pairs(frame(spark, d, PANEL), _CALLED, 40)


_KINDS = [
    templates.Asked("ratio", ("roa",), "What is {ticker}'s return on assets for {year}?"),
    templates.Asked("ratio", ("current_ratio",), "What is {ticker}'s current ratio for {year}?"),
    templates.Asked("two columns", ("net_income", "total_liabilities"), "What are {ticker}'s net income and total liabilities in {year}?"),
    templates.Asked("best in class", ("net_margin",), "Which 3 companies had the best net margin in {year}?", best=3),
]


def _in_duckdb(text: str) -> str:
    """An expression for a template whose parts are columns."""
    parts = [f"'{p.replace("'", "''")}'" if k % 2 == 0 else p for k, p in enumerate(re.split(r"\{(\w+)\}", text))]
    return " || ".join(p for p in parts if p != "''")


_SMALLEST = "SELECT kind, col AS \"column\", question, sql FROM (SELECT DISTINCT * FROM a) QUALIFY row_number() OVER (PARTITION BY kind, col ORDER BY md5(concat_ws('|', 'pairs', kind, question)), question, sql) <= 40"


@query(f"""WITH p AS ({PANEL}), a AS ({' UNION ALL '.join(f"SELECT '{a.kind}' AS kind, '{'+'.join(a.columns)}' AS col, {_in_duckdb(a.question)} AS question, {_in_duckdb(a.sql())} AS sql FROM p WHERE {' AND '.join(f'{c} IS NOT NULL' for c in a.columns)}" for a in _KINDS)}) {_SMALLEST}""")
def N11_asked_pairs(spark, d):
    """Ratios, two columns at once and the best in class; the limit of 40 a kind and columns is the sample."""
    return templates.asked_pairs(frame(spark, d, PANEL), _KINDS, 40)


_OF = "FROM filing_metadata WHERE ticker = '{ticker}'"
_FILED = {
    ("last filing", "filing_type"): ("When did {ticker} file its most recent {filing_type}?", f"SELECT date {_OF} AND filing_type = '{{filing_type}}' ORDER BY date DESC LIMIT 1"),
    ("filing count", "filing_type"): ("How many {filing_type} filings does {ticker} have?", f"SELECT count(*) {_OF} AND filing_type = '{{filing_type}}'"),
    ("filings of a year", "'any'"): ("List {ticker}'s filings from {year}.", f"SELECT filing_type, date {_OF} AND date LIKE '{{year}}%' ORDER BY date"),
    ("filings since", "filing_type"): ("List all {filing_type} filings of {ticker} after {earlier}.", f"SELECT date {_OF} AND filing_type = '{{filing_type}}' AND date > '{{earlier}}-12-31' ORDER BY date DESC"),
    ("company", "'any'"): ("What company does the ticker {ticker} stand for?", f"SELECT company {_OF} LIMIT 1"),
}


@query(f"""WITH f AS (SELECT *, date[1:4] AS year, (date[1:4]::INTEGER - 1)::VARCHAR AS earlier FROM ({FILINGS})), a AS ({' UNION ALL '.join(f"SELECT '{k}' AS kind, {c} AS col, {_in_duckdb(q)} AS question, {_in_duckdb(x)} AS sql FROM f" for (k, c), (q, x) in _FILED.items())}) {_SMALLEST}""")
def N11_filing_pairs(spark, d):
    """Five kinds of questions about filings; the limit of 40 a kind and form is the sample."""
    filed = frame(spark, d, FILINGS).withColumn("company", F.concat("ticker", F.lit(" Inc")))
    return templates.filing_pairs(filed, 40)
