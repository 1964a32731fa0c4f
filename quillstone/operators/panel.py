"""Panel construction: priority picks, densification, plausibility, ratios, XBRL resolution, fill rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstone.operators.sizes import broadcast_if_small

# Plausible ranges in USD, both ends allowed.
BOUNDS = {
    "total_revenue": (-1e11, 6e11),
    "net_income": (-2e11, 2e11),
    "operating_income": (-2e11, 2e11),
    "cfo": (-5e10, 2e11),
    "capex": (-2e11, 0.0),
    "cash": (0.0, 5e11),
    "total_assets": (0.0, 4e12),
    "current_assets": (0.0, 2e12),
    "current_liabilities": (0.0, 2e12),
    "total_liabilities": (0.0, 4e12),
    "goodwill": (0.0, 5e11),
    "long_term_debt": (0.0, 1e12),
    "inventories": (0.0, 5e11),
    "accounts_payable": (0.0, 5e11),
    "retained_earnings": (-1e12, 3e12),
    "interest_expense": (-1e11, 1e11),
    "da": (0.0, 1e11),
}
RATIO_BOUNDS = {"current_ratio": (0.0, 50.0), "roa": (-1.0, 1.0), "net_margin": (-1.5, 1.5), "debt_to_assets": (0.0, 5.0)}


#: The labels that may fill each panel column, in the order in which they are tried; stocks are to be positive.
METRIC_CANDIDATES = {
    "cash": ("balance_sheet", ["Cash and cash equivalents", "Cash"], True),
    "total_assets": ("balance_sheet", ["Total assets", "Assets"], True),
    "current_assets": ("balance_sheet", ["Total current assets", "Current assets"], True),
    "current_liabilities": ("balance_sheet", ["Total current liabilities", "Current liabilities"], True),
    "total_liabilities": ("balance_sheet", ["Total liabilities"], True),
    "goodwill": ("balance_sheet", ["Goodwill"], True),
    "deferred_tax": ("balance_sheet", ["Deferred income taxes", "Deferred tax assets"], True),
    "accounts_payable": ("balance_sheet", ["Accounts payable"], True),
    "retained_earnings": ("balance_sheet", ["Retained earnings"], True),
    "long_term_debt": ("balance_sheet", ["Long-term debt", "Long term debt"], True),
    "inventories": ("balance_sheet", ["Inventories", "Inventory"], True),
    "aoci": ("balance_sheet", ["Accumulated other comprehensive loss", "Accumulated other comprehensive income/(loss)", "Accumulated other comprehensive income"], False),
    "apic": ("balance_sheet", ["Additional paid-in capital", "Additional paid in capital"], True),
    "land": ("balance_sheet", ["Land"], True),
    "other_assets": ("balance_sheet", ["Other assets"], True),
    "other_current_assets": ("balance_sheet", ["Other current assets"], True),
    "other_liabilities": ("balance_sheet", ["Other liabilities"], True),
    "total_revenue": ("income_statement", ["Total net sales", "Total revenues", "Net revenues", "Revenue", "Net sales", "Total revenue", "Revenues", "Net Revenue"], True),
    "net_income": ("income_statement", ["Net income", "Net earnings", "Net Income", "Net Earnings"], False),
    "operating_income": ("income_statement", ["Total operating income", "Total Operating Income", "Income from operations", "Operating income", "Operating Income"], False),
    "interest_expense": ("income_statement", ["Interest expense", "Interest Expense"], False),
    "interest_income": ("income_statement", ["Interest income", "Interest Income"], False),
    "da": ("income_statement", ["Depreciation and amortization", "Depreciation & amortization", "Depreciation, depletion and amortization"], True),
    "comprehensive_income": ("income_statement", ["Comprehensive income", "Total comprehensive income"], False),
    "cfo": ("cash_flow", ["Net cash provided by operating activities", "Net cash from operating activities", "Cash provided by operating activities"], False),
    "capex": ("cash_flow", ["Capital expenditures", "Purchases of property and equipment", "Capital expenditure"], False),
    "operating_leases": ("cash_flow", ["Operating leases", "Operating lease payments"], False),
}
#: The labels that the older panel keeps, with their columns.
LEGACY_METRICS = {
    "Cash and cash equivalents": "cash",
    "Total assets": "total_assets",
    "Total current assets": "current_assets",
    "Total current liabilities": "current_liabilities",
    "Total liabilities": "total_liabilities",
    "Goodwill": "goodwill",
    "Deferred income taxes": "deferred_tax",
    "Accounts payable": "accounts_payable",
    "Retained earnings": "retained_earnings",
    "Other assets": "other_assets",
    "Other current assets": "other_current_assets",
    "Other liabilities": "other_liabilities",
    "Long-term debt": "long_term_debt",
    "Inventories": "inventories",
    "Accumulated other comprehensive loss": "aoci",
    "Additional paid-in capital": "apic",
    "Land": "land",
    "Net income": "net_income",
    "Interest expense": "interest_expense",
    "Interest income": "interest_income",
    "Depreciation and amortization": "da",
    "Operating income": "operating_income",
    "Comprehensive income": "comprehensive_income",
    "Net cash provided by operating activities": "cfo",
    "Capital expenditures": "capex",
    "Operating leases": "operating_leases",
}


def candidates(spark: SparkSession, registry: dict[str, tuple[str, list[str], bool]] = METRIC_CANDIDATES) -> DataFrame:
    """A registry as (col, statement, metric, rank, positive_only)."""
    rows = [(c, s, m, k, positive) for c, (s, names, positive) in registry.items() for k, m in enumerate(names)]
    return spark.createDataFrame(rows, "col string, statement string, metric string, rank int, positive_only boolean")


_ENTRY = "struct<statement:string, xbrl_concepts:array<string>, xbrl_unit:string, computed:boolean, nl_synonyms:array<string>>"


def read_mapping(spark: SparkSession, path: str) -> DataFrame:
    """(col, statement, unit, computed, concept, rank) of a mapping file ``{"panel_columns": {name: entry}}``: a row a concept, in
    the order in which they are tried. Columns without concepts are computed ones and have no row."""
    entries = spark.read.schema(f"panel_columns map<string, {_ENTRY}>").option("multiLine", True).json(path).select(F.explode("panel_columns").alias("col", "e"))
    return entries.select("col", "e.statement", F.col("e.xbrl_unit").alias("unit"), "e.computed", F.posexplode("e.xbrl_concepts").alias("k", "concept")).select("col", "statement", "unit", "computed", "concept", (F.col("k") + 1).alias("rank"))


def legacy_panel(facts: DataFrame, metrics: dict[str, str] = LEGACY_METRICS) -> DataFrame:
    """The older panel: the largest value of each kept metric per (ticker, fiscal year), wide, with its own ratios (net margin by
    total assets, debt as long-term debt)."""
    kept = facts.where(F.col("metric").isin(*metrics) & F.col("value").isNotNull() & F.col("period").startswith("FY"))
    name = F.get(F.filter(F.array(*(F.struct(F.lit(m).alias("m"), F.lit(c).alias("c")) for m, c in metrics.items())), lambda p: p["m"] == F.col("metric")), F.lit(0))["c"]
    w = kept.withColumn("col", name).groupBy("ticker", F.col("period").alias("year")).pivot("col", list(metrics.values())).agg(F.max("value"))
    pairs = {"current_ratio": ("current_assets", "current_liabilities"), "debt_to_assets": ("long_term_debt", "total_assets"), "net_margin": ("net_income", "total_assets"), "roa": ("net_income", "total_assets")}
    return w.withColumns({n: ratio(x, y, zero_is_missing=False) for n, (x, y) in pairs.items()})


def pick_priority(facts: DataFrame, candidates: DataFrame) -> DataFrame:
    """First candidate per (ticker, period, col) by rank, then the larger value; one pass for all columns.

    ``candidates`` has (col, statement, metric, rank, positive_only) and is a registry of a few hundred rows at most.
    """
    hits = facts.join(broadcast_if_small(candidates), ["statement", "metric"]).where("value is not null and (not positive_only or value > 0)")
    best = F.min_by("value", F.struct("rank", (-F.col("value")).alias("v")))
    return hits.groupBy("ticker", "period", "col").agg(best.alias("value"))


def wide(picked: DataFrame, columns: list[str]) -> DataFrame:
    """Long to wide with a given column list, so that no extra job looks for the values."""
    return picked.groupBy("ticker", "period").pivot("col", columns).agg(F.first("value", ignorenulls=True))


def densify(panel: DataFrame) -> DataFrame:
    """All tickers by all periods, with nulls where there is no row."""
    periods = panel.select("period").distinct()
    grid = panel.select("ticker").distinct().crossJoin(broadcast_if_small(periods, 1000))
    return grid.join(panel, ["ticker", "period"], "left")


def null_implausible(panel: DataFrame, bounds: dict[str, tuple[float, float]] = BOUNDS) -> DataFrame:
    return panel.withColumns({c: F.when(F.col(c).between(lo, hi), F.col(c)) for c, (lo, hi) in bounds.items() if c in panel.columns})


def ratio(a: str, b: str, zero_is_missing: bool = True) -> Column:
    """a / b; with ``zero_is_missing`` a zero on either side gives null, otherwise only a zero divisor does."""
    value = F.try_divide(F.col(a), F.col(b))
    return F.when(F.col(a) != 0, value) if zero_is_missing else value


def add_ratios(panel: DataFrame, debt: str = "total_liabilities", zero_is_missing: bool = True) -> DataFrame:
    pairs = {"current_ratio": ("current_assets", "current_liabilities"), "net_margin": ("net_income", "total_revenue"), "roa": ("net_income", "total_assets"), "debt_to_assets": (debt, "total_assets")}
    return panel.withColumns({n: ratio(a, b, zero_is_missing) for n, (a, b) in pairs.items()})


def fill_rates(panel: DataFrame, columns: list[str]) -> DataFrame:
    """(col, filled, total, rate), one pass over the panel."""
    counts = panel.agg(F.count("*").alias("total"), *(F.count(c).alias(c) for c in columns))
    rows = counts.unpivot(["total"], columns, "col", "filled")
    return rows.select("col", "filled", "total", F.try_divide("filled", "total").alias("rate"))


def resolve_xbrl(facts: DataFrame, mapping: DataFrame, tie: list[str]) -> DataFrame:
    """Annual value per (ticker, fy, col): the first concept with a 10-K or 10-K/A hit; of its hits the amended one, then
    the latest filed, then the last position. ``tie`` names columns that settle what is left."""
    hits = facts.where("fp = 'FY' and form in ('10-K', '10-K/A')").join(broadcast_if_small(mapping), ["concept", "unit"])
    order = Window.partitionBy("ticker", "fy", "col").orderBy("rank", (F.col("form") == "10-K/A").desc(), F.desc("filed"), F.desc("pos"), *map(F.desc, tie))
    return hits.withColumn("n", F.row_number().over(order)).where("n = 1").select("ticker", "fy", "col", "concept", "val")
