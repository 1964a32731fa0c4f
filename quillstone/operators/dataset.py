"""Question and SQL pairs as columns: domain filter, structure, schema and match checks, lists in answers, chat rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone import sqlsurface

# The tables and columns that the schema check knows, SQL words and other words that it passes over.
COLUMNS = {
    "panel": [
        "ticker", "year", "cash", "total_assets", "current_assets", "current_liabilities", "total_liabilities", "goodwill", "long_term_debt",
        "accounts_payable", "inventories", "deferred_tax", "retained_earnings", "other_assets", "net_income", "interest_expense", "interest_income",
        "da", "operating_income", "cfo", "capex", "current_ratio", "debt_to_assets", "roa", "net_margin",
    ],
    "filing_metadata": [
        "ticker", "company", "filing_type", "date", "accession_number",
    ],
    "financials": [
        "ticker", "period", "statement", "metric", "value", "unit",
    ],
}
SQL_WORDS = (
    "select", "from", "where", "and", "or", "not", "in", "is", "null", "order", "by", "limit", "join", "on", "group", "having", "as", "distinct", "between",
    "like", "asc", "desc", "avg", "sum", "max", "min", "count", "inner", "left", "right", "outer", "union", "all", "case", "when", "then", "else", "end",
    "insert", "into", "values", "update", "set", "delete", "create", "table", "index", "view",
)
PASSED_OVER = (
    "fy2019", "fy2020", "fy2021", "fy2022", "fy2023", "fy2024", "k",
)

# Terms of finance, and patterns of questions about other things.
TERMS = (
    "revenue", "revenues", "sales", "turnover", "top line", "profit", "profits", "earnings", "income", "bottom line", "operating income", "ebit",
    "net income", "net profit", "gross profit", "gross margin", "margin", "profitability", "assets", "liabilities", "equity", "goodwill", "debt",
    "borrowings", "long-term debt", "inventory", "inventories", "cash", "receivable", "payable", "retained earnings", "cash flow", "cfo", "capex",
    "capital expenditure", "depreciation", "amortization", "roa", "roe", "return on assets", "return on equity", "current ratio", "debt-to-assets",
    "leverage", "liquidity", "net margin", "profit margin", "return on sales", "10-k", "10-q", "8-k", "filing", "annual report", "fiscal", "fy20",
    "annual", "quarterly", "quarter", "revenue growth", "profit growth", "earnings growth", "interest expense", "interest income", "dividend",
)
NOISE = (
    r"\b(tournament|season|match|game|player|team|sport|podium)\b", r"\b(song|album|artist|band|music|genre)\b",
    r"\b(movie|film|actor|director|award|oscar)\b", r"\b(country|capital|population|area|continent)\b",
    r"\b(stamp duty|tax revenue|national insurance)\b", r"\b(win.loss|margin of (victory|defeat))\b", r"\bfield \d+\b", r"\bokajima|jeriome\b",
)
# The tickers and companies that the domain filter knows.
DOMAIN_TICKERS = (
    "AAPL", "MSFT", "AMZN", "GOOGL", "GOOG", "META", "NVDA", "TSLA", "JPM", "V", "JNJ", "WMT", "PG", "UNH", "HD", "DIS", "BAC", "XOM", "PFE", "CVX", "KO",
    "ABBV", "AVGO", "COST", "MRK", "TMO", "CSCO", "NKE", "ORCL", "CRM", "LLY", "AMD", "INTC", "QCOM", "NFLX", "MCD", "LOW", "CAT", "MMM", "GILD", "REGN",
    "BIIB", "TXN", "ACN", "ABT", "PEP", "IBM", "BA", "HON", "FDX", "UPS", "GE", "T", "DE",
)
DOMAIN_COMPANIES = (
    "apple", "microsoft", "amazon", "alphabet", "google", "meta", "nvidia", "tesla", "jpmorgan", "visa", "johnson", "walmart", "procter", "unitedhealth",
    "home depot", "disney", "bank of america", "exxon", "pfizer", "chevron", "coca-cola", "abbvie", "broadcom", "costco", "merck", "thermo fisher", "cisco",
    "nike", "oracle", "salesforce", "eli lilly", "intel", "qualcomm", "netflix", "mcdonald", "lowe", "caterpillar", "3m", "gilead", "regeneron", "biogen",
    "texas instruments", "accenture", "abbott", "pepsico", "ibm", "boeing", "honeywell", "fedex", "ups", "general electric",
)


def is_domain_question(question: Column) -> Column:
    """Whether a question is about finance: no noise pattern, and a ticker in capitals, a company, a term or a fiscal year. Null is not."""
    words = (*DOMAIN_COMPANIES, *TERMS)
    named = question.rlike(rf"(?U)\b({'|'.join(DOMAIN_TICKERS)})\b") | question.rlike(r"(?U)\bFY20\d{2}\b")

    def fits(low: Column) -> Column:
        known = named
        for w in words:  # plain searches; one pattern of so many words is several times slower
            known = known | F.contains(low, F.lit(w))
        return ~low.rlike(f"(?U){'|'.join(NOISE)}") & known

    return F.coalesce(F.transform(F.array(F.lower(question)), fits)[0], F.lit(False))  # lower-cased once


def tables_in(sql: Column) -> Column:
    """Distinct lower-case names after FROM and JOIN."""
    return F.array_distinct(F.regexp_extract_all(F.lower(sql), F.lit(r"\b(?:from|join)\s+(\w+)"), F.lit(1)))


def schema_ok(sql: Column, columns: dict[str, list[str]] = COLUMNS) -> Column:
    """Whether only known tables are read and no table has over two words that are neither its columns nor SQL's.

    Words in literals count too, as does every alias; that is why two are let through.
    """
    names = list(columns)
    words = F.regexp_extract_all(F.lower(sql), F.lit(r"\b([a-z_][a-z0-9_]*)\b"), F.lit(1))
    strange = [F.contains(F.array_join(F.transform(tables_in(sql), lambda t: F.concat(F.lit("<"), t, F.lit(">"))), ""), F.lit(f"<{n}>"))
               & (F.size(F.array_except(words, F.array(*map(F.lit, (*columns[n], *names, *SQL_WORDS, *PASSED_OVER))))) > 2) for n in names]
    any_strange = strange[0]
    for s in strange[1:]:
        any_strange = any_strange | s
    return (F.size(F.array_except(tables_in(sql), F.array(*map(F.lit, names)))) == 0) & ~any_strange


def runs_with_rows(spark: SparkSession, sql: str, tables: dict[str, DataFrame]) -> bool:
    """Whether a statement passes the gate, runs and gives a row; one Spark job that stops at the first row."""
    from pyspark.errors import PySparkException

    try:
        return not sqlsurface.execute(spark, sql, tables).isEmpty()
    except (sqlsurface.Refused, PySparkException):
        return False


def pair_ok(sql: Column) -> Column:
    """SELECT at the start, a FROM, and none of the four words that change data, wherever they stand. Null is not."""
    up = F.upper(F.trim(sql))
    return F.coalesce(F.startswith(up, F.lit("SELECT")) & F.contains(up, F.lit("FROM")) & ~up.rlike("DROP|INSERT|UPDATE|DELETE"), F.lit(False))


def normalised(sql: Column) -> Column:
    """Comments out, runs of space to one, no semicolons at the end, lower case."""
    one_line = F.regexp_replace(F.regexp_replace(sql, r"--[^\n]*", ""), r"\s+", " ")
    return F.lower(F.regexp_replace(F.trim(one_line), ";+$", ""))


def score_sql(predicted: Column, expected: Column, question: Column, tables: list[str], columns: list[str], avoided: str = "financials") -> dict[str, Column]:
    """0/1 columns: valid_sql, correct_table, correct_column, period_format, keyword_match, exact_match.

    ``columns`` leaves out the keys. Years are 20xx; a question without a year or ticker can't miss one. Execution is
    checked by ``runs_with_rows``.
    """
    p, up = F.trim(predicted), F.upper(predicted)
    years = F.regexp_extract_all(question, F.lit(r"\b(20\d{2})\b"), F.lit(1))
    capitals = F.regexp_extract_all(question, F.lit(r"\b([A-Z]{2,5})\b"), F.lit(1))
    words = F.regexp_extract_all(F.lower(F.regexp_replace(p, "'[^']*'", " ")), F.lit(r"\b(\w+)\b"), F.lit(1))
    known = F.arrays_overlap(tables_in(p), F.array(*map(F.lit, tables)))
    checks = {
        "valid_sql": up.rlike(r"^\s*SELECT\b") & up.rlike(r"\bFROM\b"),
        "correct_table": known & ~up.rlike(rf"\bFROM\s+{avoided.upper()}\b"),
        "correct_column": F.arrays_overlap(words, F.array(*map(F.lit, columns))),
        "period_format": (F.size(years) == 0) | F.exists(years, lambda y: F.contains(up, F.concat(F.lit("FY"), y))),
        "keyword_match": F.forall(capitals, lambda t: F.contains(up, t)) & F.forall(years, lambda y: F.contains(p, y)),
        "exact_match": normalised(p) == normalised(expected),
    }
    return {name: F.coalesce(c, F.lit(False)).cast("int") for name, c in checks.items()}


def text_list(raw: Column) -> Column:
    """The JSON list of strings in a model's answer, trimmed and without empty ones: the whole answer, else its first
    [...]; null where neither is a list of strings."""

    def strings(s: Column) -> Column:
        v = F.try_parse_json(s)
        items = F.when(F.schema_of_variant(v).isin("ARRAY<STRING>", "ARRAY<VOID>"), F.from_json(s, "array<string>"))
        return F.when(~F.exists(items, lambda x: x.isNull()), F.filter(F.transform(items, lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != ""))

    return F.coalesce(strings(raw), strings(F.regexp_extract(raw, r"(?s)\[.*?\]", 0)))


def references(raw: Column, fallback: Column, n: int = 3) -> Column:
    """``n`` reference answers: the list in the answer, else its lines over 20 characters without numbering, filled up
    with ``fallback``."""
    lines = F.transform(F.filter(F.split(raw, r"\R"), lambda x: F.length(F.trim(x)) > 20), lambda x: F.regexp_replace(F.trim(x), r"^[0-9.\-) \"']+", ""))
    found = F.coalesce(F.nullif(text_list(raw), F.array().cast("array<string>")), F.filter(lines, lambda x: (x != "") & (x != fallback)), F.array().cast("array<string>"))
    return F.slice(F.concat(found, F.array_repeat(fallback, n)), 1, n)


def chat_example(system: str, question: Column, sql: Column) -> Column:
    """array<struct<role, content>> with one semicolon at the end of the SQL."""
    turn = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return F.array(turn("system", F.lit(system)), turn("user", question), turn("assistant", F.concat(F.regexp_replace(F.trim(sql), ";+$", ""), F.lit(";"))))


def prompt_and_completion(messages: Column, end_token: str) -> dict[str, Column]:
    """All messages but the last, and the last one's content with the end token."""
    return {"prompt": F.slice(messages, 1, F.greatest(F.size(messages) - 1, F.lit(0))), "completion": F.concat(F.element_at(messages, -1)["content"], F.lit(end_token))}
