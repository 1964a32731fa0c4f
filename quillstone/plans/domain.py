"""Domain tables (facts, panel, filings, cases) derived from the driver's tables by one SQL text for Spark and DuckDB.

Money is summed as DECIMAL and cast to DOUBLE last, so that both engines agree to the bit whatever the row order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SUMS = """
SELECT concat('S', CAST(l_suppkey AS STRING)) AS ticker, concat('FY', CAST(year(l_shipdate) AS STRING)) AS year,
  CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(6,2)))) AS DOUBLE) AS total_revenue,
  CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_discount AS DECIMAL(6,2)) - 40 * CAST(l_quantity AS DECIMAL(12,2))) AS DOUBLE) AS net_income,
  CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS total_assets,
  CAST(sum(CASE WHEN l_returnflag = 'R' THEN CAST(l_extendedprice AS DECIMAL(18,2)) END) AS DOUBLE) AS total_liabilities,
  CAST(sum(CASE WHEN l_returnflag = 'A' THEN CAST(l_extendedprice AS DECIMAL(18,2)) END) AS DOUBLE) AS current_assets,
  CAST(sum(CASE WHEN l_returnflag = 'N' THEN CAST(l_extendedprice AS DECIMAL(18,2)) ELSE 0 END) AS DOUBLE) AS current_liabilities,
  CAST(sum(CAST(l_quantity AS DECIMAL(12,2))) AS DOUBLE) AS cash
FROM lineitem GROUP BY 1, 2
"""
PANEL = f"""
SELECT s.*, CASE WHEN current_assets <> 0 AND current_liabilities <> 0 THEN current_assets / current_liabilities END AS current_ratio,
  CASE WHEN net_income <> 0 AND total_revenue <> 0 THEN net_income / total_revenue END AS net_margin,
  CASE WHEN net_income <> 0 AND total_assets <> 0 THEN net_income / total_assets END AS roa,
  CASE WHEN total_liabilities <> 0 AND total_assets <> 0 THEN total_liabilities / total_assets END AS debt_to_assets
FROM ({SUMS}) s
"""
#: (metric label, statement, column of the sums)
METRICS = [
    ("Total revenue", "income_statement", "total_revenue"), ("Revenues, net", "income_statement", "total_revenue"), ("Net income", "income_statement", "net_income"),
    ("Total assets", "balance_sheet", "total_assets"), ("Current assets", "balance_sheet", "current_assets"), ("Cash and cash equivalents", "balance_sheet", "cash"),
    ("Total liabilities", "balance_sheet", "total_liabilities"), ("Current liabilities", "balance_sheet", "current_liabilities"),
]
FACTS = f"WITH s AS ({SUMS}) " + " UNION ALL ".join(f"SELECT ticker, year AS period, '{s}' AS statement, '{m}' AS metric, {c} AS value, 'USD' AS unit FROM s" for m, s, c in METRICS)
FILINGS = """
SELECT concat('C', CAST(o_custkey AS STRING)) AS ticker, CASE WHEN o_orderpriority LIKE '1%' THEN '10-K' WHEN o_orderpriority LIKE '2%' THEN '10-Q' ELSE '8-K' END AS filing_type,
  substr(CAST(o_orderdate AS STRING), 1, 10) AS date, CAST(o_orderkey AS STRING) AS accession_number
FROM orders
"""
CASES = """
SELECT d.doc_id AS id, d.source AS config, CASE WHEN d.lang = 'en' THEN 'Type1' WHEN d.lang = 'de' THEN 'Type2' WHEN d.lang = 'fr' THEN 'Type3' ELSE 'Type1+Type2' END AS category,
  l.quality AS value_correct, l.toxic AS intent_correct, d.n_chars AS latency
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
"""
TABLES = ("lineitem", "orders", "documents", "labels", "embeddings", "benchmark", "conversations", "events", "pages", "supplier")


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The long facts table from one pass over the sums; the rows of FACTS."""
    from pyspark.sql import functions as F

    rows = F.explode(F.array(*(F.struct(F.lit(s).alias("statement"), F.lit(m).alias("metric"), F.col(c).alias("value")) for m, s, c in METRICS))).alias("f")
    return frame(spark, sf_dir, SUMS).select("ticker", F.col("year").alias("period"), rows).select("ticker", "period", "f.*", F.lit("USD").alias("unit"))


def frame(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Runs SQL whose table names are the driver's tables; names are bound to this call's frames, not to global views."""
    import re

    used = [t for t in TABLES if re.search(rf"\b(FROM|JOIN)\s+{t}\b", sql)]
    bound = re.sub(rf"\b(FROM|JOIN)(\s+)({'|'.join(used)})\b", r"\1\2{\3}", sql.replace("{", "{{").replace("}", "}}"))
    return spark.sql(bound, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used})
