"""Tables of SQL statements: repair, gate, rewriting and execution of many statements at once.

Repair and rewriting are column expressions over tokens. For the gate and for execution, string literals and compared
numbers are lifted out of a statement and comments left out; what is left is its template. A template is parsed once on the driver and run once
as a lateral join of its statements' literals with the template's query, so that there are as many jobs as templates,
however many statements there are.
"""

from __future__ import annotations

import re
from functools import reduce
from itertools import count

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.sources.tables import save_table
from quillstone.sqlsurface import SYNONYMS, TICKERS, Refused, bound_text, check, execute

#: A quoted literal or name, an identifier, a run of anything else, or a quote that nothing closes.
TOKEN = r"""'(?:[^']|'')*'|"(?:[^"]|"")*"|[A-Za-z_]\w*|[^A-Za-z_'"]+|['"]"""
STRING, NUMBER = r"'(?:[^']|'')*'", r"([<>=]\s*)(-?\d+(?:\.\d+)?)(?![\w.])"
#: A quoted literal or name, a comment (a hint is none), a run of anything else, or a mark that begins none of these.
PART = r"""'[^']*(?:''[^']*)*'|"[^"]*(?:""[^"]*)*"|`[^`]*`|--[^\r\n]*|/\*(?!\+)(?s:.*?)\*/|[^'"`/-]+|['"`/-]"""


def _lookup(table: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in table.items() for x in pair))


def repaired(sql: Column) -> Column:
    """struct<sql, repairs>: column names for their synonyms outside quotes and canonical tickers inside; each repair as
    'old -> new'. Null stays null."""
    bare = lambda t: F.substr(t, F.lit(2), F.length(t) - 2)
    quoted = lambda t: F.substr(t, F.lit(1), F.lit(1)).isin("'", '"') & (F.length(t) > 1)
    old = lambda t: F.when(quoted(t), bare(t)).otherwise(t)
    new = lambda t: F.when(quoted(t), F.coalesce(F.try_element_at(_lookup(TICKERS), bare(t)), bare(t))).otherwise(F.coalesce(F.try_element_at(_lookup(SYNONYMS), F.lower(t)), t))
    mark = lambda t: F.when(quoted(t), F.substr(t, F.lit(1), F.lit(1))).otherwise("")
    parts = F.transform(F.regexp_extract_all(sql, F.lit(TOKEN), F.lit(0)), lambda t: F.struct(mark(t).alias("mark"), old(t).alias("old"), new(t).alias("new")))
    text = F.array_join(F.transform(parts, lambda p: F.concat(p["mark"], p["new"], p["mark"])), "")
    changed = F.filter(parts, lambda p: p["old"] != p["new"])
    return F.when(sql.isNotNull(), F.struct(text.alias("sql"), F.transform(changed, lambda p: F.concat(p["old"], F.lit(" -> "), p["new"])).alias("repairs")))


def without_comments(sql: Column) -> Column:
    """A statement with a space for each comment. One with a backslash, or with a comment inside a comment, stays as it is: where its
    quotes and comments end is then for Spark's parser to say."""
    comment = lambda p: p.startswith("--") | (p.startswith("/*") & (F.length(p) > 2))

    def text(parts: Column) -> Column:
        nested = F.exists(parts, lambda p: comment(p) & (F.locate("/*", p, 3) > 0) & p.startswith("/*"))
        return F.when(nested, sql).otherwise(F.array_join(F.transform(parts, lambda p: F.when(comment(p), " ").otherwise(p)), ""))

    return F.when(sql.contains("\\") | ~sql.rlike(r"--|/\*"), sql).otherwise(_bound(F.regexp_extract_all(sql, F.lit(PART), F.lit(0)), text))


def lifted(sql: Column) -> Column:
    """struct<template, strings, numbers>: string literals become '' and compared numbers 0; both lists are in order. Comments are
    left out, so that statements which differ in these alone share a template."""

    def parts(sql: Column) -> Column:
        one = F.regexp_replace(F.regexp_replace(F.trim(sql), r"[;\s]+$", ""), STRING, "''")
        strings = F.transform(F.regexp_extract_all(sql, F.lit(STRING), F.lit(0)), lambda s: F.replace(F.substr(s, F.lit(2), F.length(s) - 2), F.lit("''"), F.lit("'")))
        numbers = F.transform(F.regexp_extract_all(one, F.lit(NUMBER), F.lit(2)), lambda n: n.cast("double"))
        return F.struct(F.regexp_replace(one, NUMBER, "$1 0").alias("template"), strings.alias("strings"), numbers.alias("numbers"))

    return _bound(without_comments(sql), parts)


#: What a statement's analysis or run may raise.
FAULTS = (Refused, PySparkException, Py4JJavaError)


def _reason(e: Exception) -> str:
    text = e.java_exception.getMessage() if isinstance(e, Py4JJavaError) else str(e)
    return (text or type(e).__name__).strip().splitlines()[0][:200]


def _failed(asked: DataFrame, why: str) -> DataFrame:
    return asked.select("sql", F.lit(None).cast("long").alias("n_rows"), F.lit(None).cast("decimal(38,0)").alias("digest"), F.lit(why).alias("error"))


def _templates(asked: DataFrame, most: int) -> list[str]:
    found = [r["template"] for r in asked.select("template").distinct().limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"over {most} templates: raise max_templates, as each is parsed on the driver")
    return sorted(found)


def statement_records(statements: DataFrame, tables: set[str], sql_col: str = "sql", max_templates: int = 10_000) -> DataFrame:
    """The statements' rows with sql_repaired, repairs, is_valid and error: each template goes through the gate once.

    The gate looks at structure, names and functions only, which statements of one template share. A null statement is not
    valid.
    """
    rows = statements.withColumn("__r", repaired(F.col(sql_col))).withColumn("__t", F.coalesce(lifted(F.col("__r.sql"))["template"], F.lit("")))
    spark, verdicts = statements.sparkSession, []
    for t in _templates(rows.select(F.col("__t").alias("template")), max_templates):
        try:
            check(spark, t, tables)
            verdicts.append((t, True, ""))
        except Refused as e:
            verdicts.append((t, False, str(e)))
    known = spark.createDataFrame(verdicts, "__t string, is_valid boolean, error string")
    joined = rows.join(F.broadcast(known), "__t")  # at most max_templates rows
    return joined.select(*(joined[c] for c in statements.columns), F.col("__r.sql").alias("sql_repaired"), F.col("__r.repairs").alias("repairs"), "is_valid", "error")


def _cell(name: str, kind: str) -> Column:
    c = F.col(name)
    return F.coalesce(F.format_string("%.4f", c.cast("double")) if kind in ("double", "float") or kind.startswith("decimal") else c.cast("string"), F.lit("NULL"))


def _digested(rows: DataFrame, by: list[str], kinds: list[str]) -> DataFrame:
    """n_rows and a digest of the rows as a multiset: numbers to four decimals, nulls as NULL; names and order don't count."""
    text = F.concat_ws("\x1f", *(_cell(f"c{i}", k) for i, k in enumerate(kinds)))
    return rows.groupBy(*by).agg(F.count("*").alias("n_rows"), F.sum(F.xxhash64(text, F.lit(7)).cast("decimal(38,0)")).alias("digest"))


def _by_template(template: str, asked: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """(sql, n_rows, digest) of all statements of a template from one query."""
    spark = asked.sparkSession
    kinds = [t for _, t in spark.sql(bound_text(check(spark, template, set(tables)), template), **tables).dtypes]
    counts = {"s": count(), "n": count()}
    put = lambda m: f"__asked.__s{next(counts['s'])}" if m[0] == "''" else f"{m[1]}__asked.__n{next(counts['n'])}"
    inner = re.sub(rf"''|{NUMBER}", put, template)
    text = bound_text(check(spark, inner, set(tables)), inner)
    columns = ", ".join(f"c{i}" for i in range(len(kinds)))
    # Each literal is a column of its own: Spark then sees which of the query's rows belong to a statement, also below a LIMIT.
    flat = asked.select("sql", *(F.get(c, F.lit(k)).alias(f"__{c[0]}{k}") for c, n in (("strings", next(counts["s"])), ("numbers", next(counts["n"]))) for k in range(n)))
    rows = spark.sql(f"SELECT __asked.sql, {columns} FROM {{__asked}} AS __asked, LATERAL ({text}) AS __rows({columns})", **{**tables, "__asked": flat})
    found = _digested(rows, ["sql"], kinds)
    return asked.select("sql").join(found, "sql", "left").select("sql", F.coalesce("n_rows", F.lit(0)).alias("n_rows"), "digest", F.lit("").alias("error"))


def _one_by_one(asked: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """The same from a job a statement, for templates that Spark can't join with their literals."""
    spark, out = asked.sparkSession, []
    for r in asked.select("sql").toLocalIterator():
        try:
            df = execute(spark, r["sql"], tables)
            got = _digested(df.toDF(*(f"c{i}" for i in range(len(df.columns)))), [], [t for _, t in df.dtypes]).first()
            out.append((r["sql"], got["n_rows"], got["digest"], ""))
        except FAULTS as e:
            out.append((r["sql"], None, None, _reason(e)))
    return spark.createDataFrame(out, "sql string, n_rows long, digest decimal(38,0), error string")


def statement_results(statements: DataFrame, tables: dict[str, DataFrame], sql_col: str = "sql", max_templates: int = 1000, job_each: int = 200) -> DataFrame:
    """(sql, n_rows, digest, error) for each distinct statement, repaired: what it gives on the tables, as a row count and a
    digest of its rows, or why it gives nothing. Null statements have no row.

    A template that fails as a join is run statement by statement if it has at most ``job_each``; beyond that its error stands
    for all of them.
    """
    tables = {t.lower(): f for t, f in tables.items()}
    fixed = statements.select(F.col(sql_col).alias("sql")).where("sql is not null").distinct().withColumn("l", lifted(repaired(F.col("sql"))["sql"]))
    asked = save_table(fixed.select("sql", "l.*"), "statements")
    found = []
    for t in _templates(asked, max_templates):
        mine = asked.where(F.col("template") == t)
        try:
            found.append(save_table(_by_template(t, mine, tables), "statement-results"))
        except FAULTS as e:
            alone = not isinstance(e, Refused) and mine.limit(job_each + 1).count() <= job_each
            found.append(_one_by_one(mine, tables) if alone else _failed(mine, _reason(e)))
    empty = statements.sparkSession.createDataFrame([], "sql string, n_rows long, digest decimal(38,0), error string")
    return reduce(DataFrame.union, found) if found else empty


def with_rows(pairs: DataFrame, tables: dict[str, DataFrame], sql_col: str = "sql") -> DataFrame:
    """The rows whose statement runs and gives at least one row."""
    good = statement_results(pairs, tables, sql_col).where("n_rows > 0").select(F.col("sql").alias(sql_col))
    return pairs.join(good, sql_col, "left_semi")


def execution_match(pairs: DataFrame, tables: dict[str, DataFrame], predicted: str = "predicted", expected: str = "expected") -> DataFrame:
    """Adds expected_ok, expected_has_rows, predicted_ok and rows_match, which is null where the expected statement gives no rows."""
    each = statement_results(pairs.select(F.explode(F.array(predicted, expected)).alias("sql")), tables)
    each = save_table(each, "statement-results")
    side = lambda name, n: each.select(F.col("sql").alias(name), F.col("n_rows").alias(f"__n{n}"), F.col("digest").alias(f"__d{n}"))
    both = pairs.join(side(predicted, 1), predicted, "left").join(side(expected, 2), expected, "left")
    has = F.coalesce(F.col("__n2") > 0, F.lit(False))
    same = F.coalesce((F.col("__n1") == F.col("__n2")) & (F.col("__d1") == F.col("__d2")), F.lit(False))
    return both.select(*pairs.columns, F.col("__n2").isNotNull().alias("expected_ok"), has.alias("expected_has_rows"), F.col("__n1").isNotNull().alias("predicted_ok"), F.when(has, same).alias("rows_match"))


#: Columns of the panel that name a row and no metric.
ROW_NAMES = ("ticker", "year", "company", "sector", "industry")


def panel_to_long(sql: Column, metrics: dict[str, str], prefix: str = "FY", repeats: int = 3) -> Column:
    """A statement on the wide panel as one on the long facts table; null where it selects no known metric.

    The first metric of the SELECT list, within an aggregate or not, becomes ``value`` wherever it stands, under a condition on
    its name; ``year`` becomes ``period``, of a range of years the list (the first ``repeats`` ranges and lists are
    rewritten), with ``prefix`` before the digits. Statements that don't name the panel stay as they are.
    """
    shape = r"(?is)^(SELECT\s+)(.+?)\s+FROM\s+panel\b(.*)$"

    def with_metric(metric: Column) -> Column:
        word = F.concat(F.lit(r"(?i)\b"), metric, F.lit(r"\b"))
        chosen = F.regexp_replace(F.regexp_replace(F.regexp_extract(sql, shape, 2), word, F.lit("value")), r"(?i)\byear\b", "period")
        rest = F.regexp_replace(F.regexp_replace(F.regexp_extract(sql, shape, 3), r"(?i)\bpanel\b", "financials"), word, F.lit("value"))
        named = reduce(lambda c, m: c.when(metric == m, F.lit(f"metric = '{metrics[m]}'")), metrics, F.when(F.lit(False), ""))
        rest = _bound(_periods(rest, prefix, repeats), lambda r: _under(r, named))
        return F.concat(F.regexp_extract(sql, shape, 1), chosen, F.lit(" FROM financials"), rest)

    bare = F.regexp_replace(F.regexp_extract(sql, shape, 2), r"(?i)\b(AVG|SUM|MAX|MIN|COUNT)\s*\(([^)]+)\)", "$2")
    names = F.transform(F.split(bare, ","), lambda t: F.regexp_replace(F.trim(F.lower(t)), r"""^['"]+|['"]+$""", ""))
    metric = F.get(F.filter(names, lambda n: n.isin(*[m for m in metrics if m not in ROW_NAMES])), F.lit(0))
    made = F.regexp_replace(_bound(metric, with_metric), r"(?s);?\s*$", "")
    return F.when(~F.lower(sql).contains("panel"), sql).when(sql.rlike(shape), F.concat(made, F.lit(";")))


def _bound(value: Column, then) -> Column:
    """``then`` of a value that is computed once, however often it is used."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _periods(rest: Column, prefix: str, repeats: int) -> Column:
    """Conditions on years as conditions on periods."""
    inside, between = r"(?i)\byear\s+IN\s*\(([^)]+)\)", r"(?i)\byear\s+BETWEEN\s+'FY(\d{4})'\s+AND\s+'FY(\d{4})'"
    listed = lambda years: F.concat(F.lit("period IN ("), F.array_join(F.transform(years, lambda y: F.concat(F.lit(f"'{prefix}"), y, F.lit("'"))), ", "), F.lit(")"))

    def one_list(r: Column) -> Column:
        years = F.regexp_extract_all(F.regexp_extract(r, inside, 1), F.lit(r"FY(\d{4})"), F.lit(1))
        return F.when(r.rlike(inside), F.replace(r, F.regexp_extract(r, inside, 0), listed(years))).otherwise(r)

    def one_range(r: Column) -> Column:
        low, high = (F.coalesce(F.regexp_extract(r, between, k).try_cast("int"), F.lit(0)) for k in (1, 2))
        years = F.when(low <= high, F.transform(F.sequence(low, F.greatest(low, high)), lambda y: y.cast("string"))).otherwise(F.array().cast("array<string>"))
        return F.when(r.rlike(between), F.replace(r, F.regexp_extract(r, between, 0), listed(years))).otherwise(r)

    rest = F.regexp_replace(rest, r"(?i)\byear\s*=\s*'FY(\d{4})'", f"period = '{prefix}$1'")
    for _ in range(repeats):
        rest = _bound(_bound(rest, one_list), one_range)
    return F.regexp_replace(rest, r"(?i)\byear\b(?!\s*=|\s+IN|\s+BETWEEN)", "period")


def _under(rest: Column, condition: Column) -> Column:
    """What follows FROM, with one more condition."""
    first, later = r"(?is)^(.*?\bWHERE\b)(.*)$", r"(?is)^(.*?)(\b(?:ORDER|GROUP|LIMIT)\b.*)$"
    part = lambda pattern, k: F.regexp_extract(rest, pattern, k)
    return (
        F.when(rest.rlike(first), F.concat(part(first, 1), F.lit(" "), condition, F.lit(" AND"), part(first, 2)))
        .when(rest.rlike(later), F.concat(part(later, 1), F.lit(" WHERE "), condition, F.lit(" "), part(later, 2)))
        .otherwise(F.concat(F.regexp_replace(rest, r"[;\s]+$", ""), F.lit(" WHERE "), condition))
    )
