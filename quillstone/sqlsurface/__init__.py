"""Read-only SQL surface: identifier repair, gate, execution, formatting."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Other names of panel columns.
SYNONYMS = {
    "profit": "net_income", "profits": "net_income", "net_profit": "net_income", "net_earnings": "net_income", "earnings": "net_income", "bottom_line": "net_income", "net": "net_income", "income": "net_income", "after_tax_profit": "net_income", "take_home_profit": "net_income",
    "revenue": "total_revenue", "revenues": "total_revenue", "sales": "total_revenue", "net_sales": "total_revenue", "total_sales": "total_revenue", "gross_sales": "total_revenue", "turnover": "total_revenue", "top_line": "total_revenue", "net_revenue": "total_revenue",
    "ebit": "operating_income", "op_income": "operating_income", "operating_profit": "operating_income", "operating_earnings": "operating_income", "income_from_operations": "operating_income", "operating_result": "operating_income",
    "operating_cash_flow": "cfo", "cash_from_operations": "cfo", "cash_flow_from_operations": "cfo", "operating_cash": "cfo",
    "capital_expenditures": "capex", "capital_spending": "capex", "ppe_purchases": "capex",
    "cash_balance": "cash", "cash_on_hand": "cash", "cash_and_cash_equivalents": "cash", "cash_holdings": "cash", "cash_position": "cash", "liquidity": "cash",
    "assets": "total_assets", "asset_base": "total_assets", "book_assets": "total_assets",
    "short_term_assets": "current_assets", "liquid_assets": "current_assets",
    "short_term_liabilities": "current_liabilities", "short_term_obligations": "current_liabilities",
    "liabilities": "total_liabilities", "total_obligations": "total_liabilities",
    "ltd": "long_term_debt", "long_term_borrowings": "long_term_debt", "debt": "long_term_debt", "borrowings": "long_term_debt",
    "inventory": "inventories", "stock": "inventories",
    "payables": "accounts_payable", "trade_payables": "accounts_payable", "ap": "accounts_payable",
    "accumulated_earnings": "retained_earnings", "retained_profits": "retained_earnings",
    "interest_cost": "interest_expense", "finance_cost": "interest_expense", "borrowing_cost": "interest_expense", "cost_of_debt": "interest_expense",
    "depreciation": "da", "amortization": "da", "d_and_a": "da",
    "gross_margin_dollars": "gross_profit",
    "rd": "r_and_d", "r_and_d_expense": "r_and_d", "research_and_development": "r_and_d", "research_expense": "r_and_d",
    "share_repurchases": "buybacks", "stock_buybacks": "buybacks", "repurchases": "buybacks",
    "dividends": "dividends_paid", "dividend_payments": "dividends_paid",
    "eps": "eps_diluted", "diluted_eps": "eps_diluted", "earnings_per_share": "eps_diluted",
    "net_profit_margin": "net_margin", "profit_margin": "net_margin", "return_on_sales": "net_margin",
    "return_on_assets": "roa", "asset_returns": "roa", "asset_productivity": "roa",
    "liquidity_ratio": "current_ratio", "working_capital_ratio": "current_ratio",
    "debt_ratio": "debt_to_assets", "leverage_ratio": "debt_to_assets", "debt_to_assets_ratio": "debt_to_assets",
}
#: Other spellings of a ticker; filings and the panel have the first share class alone.
TICKERS = {"GOOGL": "GOOG", "BRK.B": "BRK-B", "BRK/B": "BRK-B"}
#: Statements start with one of these, and the relational parts of a query are of these kinds of Spark's parsed plans.
PLAN_NODES = frozenset((
    "Project", "Filter", "Aggregate", "Join", "Sort", "GlobalLimit", "LocalLimit", "Offset", "Distinct", "Union", "Except", "Intersect", "SubqueryAlias", "UnresolvedHaving",
    "UnresolvedRelation", "UnresolvedSubqueryColumnAliases", "UnresolvedWith", "OneRowRelation", "UnresolvedInlineTable", "WithWindowDefinition", "UnresolvedOrderBy",
))
#: Functions a statement may call; all are deterministic and read nothing but their arguments.
FUNCTIONS = frozenset((
    "abs", "any_value", "approx_count_distinct", "avg", "between", "cast", "ceil", "ceiling", "char_length", "coalesce", "concat", "concat_ws", "contains", "count", "count_if", "date_format", "day",
    "dense_rank", "double", "endswith", "exp", "first", "first_value", "floor", "format_number", "format_string", "greatest", "if", "ifnull", "ilike", "instr", "int", "isnull", "isnotnull",
    "lag", "last", "last_value", "lead", "least", "left", "len", "length", "like", "ln", "log", "log10", "lower", "lpad", "ltrim", "max", "max_by", "mean", "median", "min", "min_by", "mod",
    "month", "nullif", "nullifzero", "nvl", "percent_rank", "percentile", "percentile_approx", "pow", "power", "quarter", "rank", "regexp_extract", "regexp_like", "regexp_replace", "replace", "right", "rlike",
    "round", "row_number", "rpad", "rtrim", "sign", "split_part", "sqrt", "startswith", "stddev", "string", "substr", "substring", "sum", "to_date", "trim", "try_divide", "upper", "variance", "year",
))


class Refused(ValueError):
    """The statement is not one that the surface runs."""


def repair(sql: str) -> tuple[str, list[tuple[str, str]]]:
    """Puts column names for their synonyms outside string literals and canonical tickers inside; (sql, repairs)."""
    repairs: list[tuple[str, str]] = []

    def note(old: str, new: str | None) -> str:
        if new is None or new == old:
            return old
        repairs.append((old, new))
        return new

    def part(text: str) -> str:
        if len(text) > 1 and text[0] in "'\"" and text[0] == text[-1]:
            return f"{text[0]}{note(text[1:-1], TICKERS.get(text[1:-1]))}{text[0]}"
        return re.sub(r"[A-Za-z_]\w*", lambda m: note(m[0], SYNONYMS.get(m[0].lower())), text)

    return "".join(part(p) for p in re.split(r"""('(?:[^']|'')*'|"(?:[^"]|"")*")""", sql)), repairs


def _seq(items) -> list:
    return [items.apply(k) for k in range(items.size())]


#: Names that Spark reads as functions where no column has them; they need no brackets.
BARE_FUNCTIONS = frozenset("current_catalog current_database current_date current_schema current_time current_timestamp current_user localtime localtimestamp session_user user".split())
#: Expressions that hold a query.
_SUBQUERIES = frozenset(("ScalarSubquery", "Exists", "ListQuery", "LateralSubquery"))


class _Parsed:
    """What Spark's own parser finds in a statement, walked with its scopes.

    A name of WITH is visible in later definitions of the same WITH, in the query below it and in the queries within that;
    an inner name hides an outer one. Each use of a relation is either such a name or a table of the surface, and only the
    latter are in ``relations``, with their place in the text.
    """

    def __init__(self, spark: SparkSession, sql: str):
        self.nodes: set[str] = set()
        self.functions: set[str] = set()
        self.relations: list[tuple[list[str], int, int, bool]] = []
        self.alike: list[str] = []
        try:
            plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
        except Exception as e:  # Py4J hands the parser's error on
            raise Refused(f"not a statement: {str(e).strip().splitlines()[0][:200]}") from None
        self._plan(plan, frozenset(), False, None)

    def _plan(self, node, visible: frozenset[str], aliased: bool, inner: list[str] | None) -> None:
        """``inner``: what the FROM of the subquery that the node is a part of calls its relations; None at the top."""
        name = node.getClass().getSimpleName()
        self.nodes.add(name)
        if name == "UnresolvedRelation":
            parts, at = _seq(node.multipartIdentifier()), node.origin()
            if len(parts) != 1 or parts[0].lower() not in visible:
                self.relations.append((parts, at.startIndex().get(), at.stopIndex().get() + 1, aliased))
        if name == "UnresolvedWith":
            for definition in _seq(node.cteRelations()):
                self._plan(definition._2(), visible, True, inner)
                visible = visible | {definition._1().lower()}
        for child in _seq(node.children()):
            self._plan(child, visible, name == "SubqueryAlias", inner)
        for e in _seq(node.expressions()):
            self._expression(e, visible, inner)

    def _expression(self, e, visible: frozenset[str], inner: list[str] | None) -> None:
        name = e.getClass().getSimpleName()
        if name == "UnresolvedFunction":
            self.functions.add(".".join(_seq(e.nameParts())).lower())
        elif name == "UnresolvedAttribute" and len(parts := _seq(e.nameParts())) == 1 and parts[0].lower() in BARE_FUNCTIONS:
            self.functions.add(parts[0].lower())
        elif name.startswith(("Current", "LocalT")):
            self.functions.add(name.lower())
        elif name == "EqualTo" and inner and len(inner) == 1:
            self._same_column(e, inner[0])
        if name in _SUBQUERIES:
            self._plan(e.plan(), visible, False, _sources(e.plan()))
        for child in _seq(e.children()):
            self._expression(child, visible, inner)

    def _same_column(self, e, source: str) -> None:
        """Both sides are the inner relation's column: what was meant as a correlation is always true."""
        sides = [_seq(x.nameParts()) for x in (e.left(), e.right()) if x.getClass().getSimpleName() == "UnresolvedAttribute"]
        if len(sides) == 2 and sides[0][-1].lower() == sides[1][-1].lower() and all(len(x) == 1 or [source] == [p.lower() for p in x[:-1]] for x in sides):
            self.alike.append(f"{'.'.join(sides[0])} = {'.'.join(sides[1])} compares a column of the inner {source} with itself: give it an alias")


def _sources(plan) -> list[str]:
    """What a query's FROM calls its relations."""
    name = plan.getClass().getSimpleName()
    if name == "SubqueryAlias":
        return [plan.alias().lower()]
    if name == "UnresolvedRelation":
        return [_seq(plan.multipartIdentifier())[-1].lower()]
    return [x for child in _seq(plan.children()) for x in _sources(child)]


def check(spark: SparkSession, sql: str, tables: set[str]) -> _Parsed:
    """Raises Refused unless Spark's parser finds one query whose relations are the given tables or names of a WITH that are
    visible where they stand, whose functions are among FUNCTIONS, and whose subqueries don't compare a column of their own
    with itself. Nothing is resolved, so nothing outside the tables is looked at."""
    found = _Parsed(spark, sql)
    if bad := sorted(found.nodes - PLAN_NODES):
        raise Refused(f"Only SELECT statements allowed: {', '.join(bad)}")
    known = {t.lower() for t in tables}
    if bad := sorted(".".join(name) for name, *_ in found.relations if len(name) != 1 or name[0].lower() not in known):
        raise Refused(f"unknown tables: {', '.join(bad)}")
    if bad := sorted(found.functions - FUNCTIONS):
        raise Refused(f"unknown functions: {', '.join(bad)}")
    if found.alike:
        raise Refused(found.alike[0])
    return found


def bound_text(found: _Parsed, sql: str) -> str:
    """The statement with a parameter for each use of a table, as ``spark.sql`` takes frames."""
    parts, done = [], 0
    for name, start, stop, aliased in sorted(found.relations, key=lambda r: r[1]):
        table = name[0].lower()
        parts += [_literal(sql[done:start]), f"{{{table}}}" if aliased else f"{{{table}}} AS {table}"]
        done = stop
    return "".join(parts) + _literal(sql[done:])


def execute(spark: SparkSession, sql: str, tables: dict[str, DataFrame]) -> DataFrame:
    """Repairs, checks and runs a question's SQL over the given frames; the result is lazy. The frames are bound to this
    statement's relations alone, and no view of the session is made or seen."""
    fixed, _ = repair(sql.strip().rstrip(";"))
    return spark.sql(bound_text(check(spark, fixed, set(tables)), fixed), **{t.lower(): f for t, f in tables.items()})


def _literal(text: str) -> str:
    return text.replace("{", "{{").replace("}", "}}")


RECORD = "sql_original string, sql_repaired string, repairs array<string>, is_valid boolean, error string"


def postprocess(spark: SparkSession, sql: str, tables: set[str]) -> tuple[str, str, list[str], bool, str]:
    """The record of one statement: original, repaired, the repairs made, whether the gate lets it through, and why not."""
    fixed, repairs = repair(sql)
    try:
        check(spark, fixed.strip().rstrip(";"), tables)
        return sql, fixed, [f"{old} -> {new}" for old, new in repairs], True, ""
    except Refused as e:
        return sql, fixed, [f"{old} -> {new}" for old, new in repairs], False, str(e)


def format_rows(rows: DataFrame, group: list[str] = (), order: list[str] = ()) -> DataFrame:
    """One text per group (all rows where there is none): 'No data found.' can't arise here, one row is 'name: value' of its
    filled columns, several are lines of values between bars, ordered. Meant for results that a reader can read."""
    shown = [c for c in rows.columns if c not in group]
    text = {c: format_value(F.col(f"`{c}`")) if t in ("double", "float") else F.col(f"`{c}`").cast("string") for c, t in rows.dtypes}
    pair = F.array_join(F.filter(F.array(*(F.concat(F.lit(f"{c}: "), text[c]) for c in shown)), lambda x: x.isNotNull()), ", ")
    line = F.concat_ws(" | ", *(F.coalesce(text[c], F.lit("None")) for c in shown))
    each = F.struct(*(F.col(f"`{c}`") for c in order), pair.alias("__pair"), line.alias("__line"))
    g = rows.groupBy(*(F.col(f"`{c}`") for c in group)).agg(F.array_sort(F.collect_list(each)).alias("__rows"))
    out = F.when(F.size("__rows") == 0, "No data found.").when(F.size("__rows") == 1, F.get("__rows", F.lit(0))["__pair"]).otherwise(F.array_join(F.transform("__rows", lambda r: r["__line"]), "\n"))
    return g.select(*(F.col(f"`{c}`") for c in group), out.alias("shown"))


def format_value(c: Column) -> Column:
    """Whole numbers and others with thousands separators, the latter with up to 4 decimals."""
    return F.when(c == F.floor(c), F.format_number(c, 0)).otherwise(F.regexp_replace(F.regexp_replace(F.format_number(c, 4), "0+$", ""), r"\.$", ""))


def repair_period(sql: Column) -> Column:
    """'F2023' to 'FY2023' inside literals, also in LIKE patterns."""
    return F.regexp_replace(sql, r"'(%?)F(\d{4})(%?)'", "'$1FY$2$3'")


def query_shape(sql: Column) -> Column:
    """The first shape that fits."""
    up = F.upper(sql)
    return (
        F.when(up.contains("JOIN"), "join").when(up.contains("ORDER BY") & up.contains("LIMIT"), "ranking").when(up.rlike(r"\b(AVG|SUM|MAX|MIN|COUNT)\s*\("), "aggregation")
        .when(up.contains("BETWEEN") | (F.regexp_count(up, F.lit("YEAR")) >= 2), "trend").when(up.contains("FILING_METADATA"), "filing").when(up.rlike(r"\bIN\s*\("), "comparison").when(up.rlike("[<>]"), "threshold").otherwise("single")
    )


def result_differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that two results don't share, as multisets; numbers to 4 decimals, nulls as 'NULL'; names don't count."""
    text = lambda df: df.select(*(F.coalesce(F.format_string("%.4f", F.col(f"`{n}`").cast("double")) if t in ("double", "float") else F.col(f"`{n}`").cast("string"), F.lit("NULL")).alias(f"c{i}") for i, (n, t) in enumerate(df.dtypes)))
    x, y = text(a), text(b)
    return x.exceptAll(y).withColumn("only_in", F.lit("a")).unionAll(y.exceptAll(x).withColumn("only_in", F.lit("b")))
