"""Question and SQL pairs over a panel by kind of question, sampled by key.

All candidates of a kind come from the panel's own rows, so each question has an answer: pairs of companies are neighbours in
the order of their hashes, never all pairs, and thresholds are quantiles of a year's values. Of each stratum (kind and
column) the pairs with the smallest hashes of their questions are taken: the same ones at any partitioning.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.operators.sizes import broadcast_if_small
from quillstone.sources.tables import save_table

KINDS = ("lookup", "trend", "span", "change", "comparison", "ranking", "lowest", "filter", "average")


def _text(pattern: str, **parts: Column) -> Column:
    """The pattern with the values in place of the names in braces; other braces stay."""
    pieces = re.split("(" + "|".join(re.escape(f"{{{n}}}") for n in parts) + ")", pattern) if parts else [pattern]
    return F.concat(*(parts[x[1:-1]] if k % 2 else F.lit(x) for k, x in enumerate(pieces)))


def panel_values(panel: DataFrame, columns: dict[str, str]) -> DataFrame:
    """(ticker, year, column, words, value): the filled cells of the named columns; ``columns`` has what a question calls each."""
    cells = F.inline(F.array(*(F.struct(F.lit(c).alias("column"), F.lit(w).alias("words"), F.col(c).cast("double").alias("value")) for c, w in columns.items())))
    return panel.where("ticker is not null and year is not null").select("ticker", "year", cells).where("value is not null")


def generated_pairs(panel: DataFrame, columns: dict[str, str], per_stratum: int, seed: str = "pairs", top: int = 5, share: float = 0.75) -> DataFrame:
    """(kind, column, question, sql): at most ``per_stratum`` pairs a kind and column. Years are texts in order, as 'FY2023'.

    Kinds: lookup of a value; trend of a company over all years, or a span of three; change from the year before that it has;
    comparison of two companies; ranking by the largest and the lowest values; filter by the ``share`` quantile of a year's
    values, as a whole number; average of a year. An empty panel gives no pairs.
    """
    v = panel_values(panel, columns).dropDuplicates(["ticker", "year", "column"])
    own = Window.partitionBy("ticker", "column").orderBy("year")
    order = F.md5(F.concat_ws("|", F.lit(seed), "column", "year", "ticker"))
    mixed = Window.partitionBy("year", "column").orderBy(order, "ticker")
    rows = v.withColumn("before", F.lag("year").over(own)).withColumn("first", F.lag("year", 2).over(own)).withColumn("other", F.lead("ticker").over(mixed))
    # The exact quantile: the value at its place in its year and column, whose rows are sorted on disk where they don't fit.
    sized = Window.partitionBy("year", "column", "words")
    placed = v.withColumn("__n", F.row_number().over(sized.orderBy("value"))).join(v.groupBy("year", "column").agg(F.greatest(F.lit(1), F.ceil(share * F.count("*"))).alias("__at")), ["year", "column"])
    years = placed.where("__n = __at").select("year", "column", "words", F.floor("value").cast("long").cast("string").alias("limit"))
    lines = v.select("ticker", "column", "words").distinct()

    def made(df: DataFrame, kind: str, question: str, sql: str) -> DataFrame:
        parts = {c: F.col(c) for c in df.columns if f"{{{c}}}" in question + sql} | {"top": F.lit(str(top))}
        return df.select(F.lit(kind).alias("kind"), "column", _text(question, **parts).alias("question"), _text(sql, **parts).alias("sql"))

    one, some = "FROM panel WHERE ticker = '{ticker}'", "FROM panel WHERE year = '{year}' AND {column} IS NOT NULL"
    found = [
        made(rows, "lookup", "What was {ticker}'s {words} in {year}?", f"SELECT {{column}} {one} AND year = '{{year}}'"),
        made(lines, "trend", "How has {ticker}'s {words} changed over the years?", f"SELECT year, {{column}} {one} AND {{column}} IS NOT NULL ORDER BY year"),
        made(rows.where("first is not null"), "span", "Show {ticker}'s {words} from {first} to {year}.", f"SELECT year, {{column}} {one} AND year BETWEEN '{{first}}' AND '{{year}}' ORDER BY year"),
        made(rows.where("before is not null"), "change", "How did {ticker}'s {words} change from {before} to {year}?", f"SELECT year, {{column}} {one} AND year IN ('{{before}}', '{{year}}') ORDER BY year"),
        made(rows.where("other is not null"), "comparison", "Compare {ticker}'s and {other}'s {words} in {year}.", "SELECT ticker, {column} FROM panel WHERE ticker IN ('{ticker}', '{other}') AND year = '{year}'"),
        made(years, "ranking", "Which {top} companies had the highest {words} in {year}?", f"SELECT ticker, {{column}} {some} ORDER BY {{column}} DESC LIMIT {{top}}"),
        made(years, "lowest", "Which {top} companies had the lowest {words} in {year}?", f"SELECT ticker, {{column}} {some} ORDER BY {{column}} ASC LIMIT {{top}}"),
        made(years, "filter", "Which companies had {words} of at least {limit} in {year}?", "SELECT ticker, {column} FROM panel WHERE year = '{year}' AND {column} >= {limit}"),
        made(years, "average", "What was the average {words} of all companies in {year}?", f"SELECT avg({{column}}) {some}"),
    ]
    all_ = found[0]
    for more in found[1:]:
        all_ = all_.union(more)
    place = F.row_number().over(Window.partitionBy("kind", "column").orderBy(F.md5(F.concat_ws("|", F.lit(seed), "kind", "question")), "question"))
    return all_.withColumn("__n", place).where(F.col("__n") <= per_stratum).drop("__n")


@dataclass(frozen=True)
class Asked:
    """A kind of question about one row of a panel, whose named columns are all filled; ``question`` has {ticker} and {year}.
    With ``best`` it has {year} alone and asks for the ``best`` rows of a year with the highest values of the first column."""

    kind: str
    columns: tuple[str, ...]
    question: str
    best: int = 0

    def sql(self) -> str:
        first = self.columns[0]
        if self.best:
            return f"SELECT ticker, {first} FROM panel WHERE year = '{{year}}' AND {first} IS NOT NULL ORDER BY {first} DESC LIMIT {self.best}"
        return f"SELECT {', '.join(self.columns)} FROM panel WHERE ticker = '{{ticker}}' AND year = '{{year}}'"


def _quoted(c: str) -> Column:
    return F.replace(F.col(c), F.lit("'"), F.lit("''"))


#: Hexadecimal digits of a hash by which pairs are left out before they are sorted: 65,536 values a stratum are counted.
DIGITS = 4


def _smallest(pairs: DataFrame, per_stratum: int, seed: str) -> DataFrame:
    """Of each stratum the distinct pairs with the smallest hashes, from two passes over ``pairs``.

    The first finds which beginnings of hashes occur. As different beginnings are of different questions, the pairs wanted
    are among those up to the ``per_stratum``-th beginning; of a large table these are few, and only they are shuffled and sorted.
    """
    stratum, order = Window.partitionBy("kind", "column"), F.md5(F.concat_ws("|", F.lit(seed), "kind", "question"))
    begins = F.substring(order, 1, DIGITS)
    seen = pairs.select("kind", "column", begins.alias("__begins")).distinct()
    last = seen.withColumn("__n", F.row_number().over(stratum.orderBy("__begins"))).where(F.col("__n") <= per_stratum).groupBy("kind", "column").agg(F.max("__begins").alias("__last"))
    few = pairs.join(broadcast_if_small(save_table(last, "last-hashes")), ["kind", "column"]).where(begins <= F.col("__last")).select(*pairs.columns).distinct()
    return few.withColumn("__n", F.row_number().over(stratum.orderBy(order, "question", "sql"))).where(F.col("__n") <= per_stratum).drop("__n")


def _pairs(rows: DataFrame, kinds: list[tuple[str, Column, str, str, Column]]) -> DataFrame:
    """All pairs of (kind, stratum, question, sql, condition) in one pass: each row gives those whose condition holds. A row is
    repeated by the number of a kind and no texts are made before they are asked for."""
    made = lambda t, f: _text(t, **{c: f(c) for c in rows.columns if f"{{{c}}}" in t})

    def pick(values: list[Column]) -> Column:
        out = F
        for k, v in enumerate(values):
            out = out.when(F.col("__kind") == k, v)
        return out

    names, columns, questions, sqls, hold = zip(*kinds)
    each = rows.withColumn("__kind", F.explode(F.array(*map(F.lit, range(len(kinds)))))).where(pick(hold))
    return each.select(pick([F.lit(n) for n in names]).alias("kind"), pick(columns).alias("column"), pick([made(q, F.col) for q in questions]).alias("question"), pick([made(q, _quoted) for q in sqls]).alias("sql"))


def asked_pairs(panel: DataFrame, asked: list[Asked], per_stratum: int, seed: str = "pairs") -> DataFrame:
    """(kind, column, question, sql): pairs of stated kinds, as ratios, earnings a share, research and development, what went to
    shareholders, two columns at once or the best in class. At most ``per_stratum`` a kind and columns, those with the smallest
    hashes; quotes in tickers are doubled in SQL. Rows without ticker or year and those that lack a column give none."""
    rows = panel.where("ticker is not null and year is not null")
    filled = lambda a: reduce(Column.__and__, (F.col(f"__v.{c}").isNotNull() for c in a.columns))
    kinds = [(a.kind, F.lit("+".join(a.columns)), a.question, a.sql(), filled(a)) for a in asked]
    used = sorted({c for a in asked for c in a.columns})
    return _smallest(_pairs(save_table(rows.select("ticker", "year", F.struct(*used).alias("__v")), "asked-rows"), kinds), per_stratum, seed)


def filing_pairs(filings: DataFrame, per_stratum: int, seed: str = "pairs") -> DataFrame:
    """(kind, column, question, sql) about (ticker, company, filing_type, date): the last filing of a form, how many there are,
    the filings of a year, those after a year, and a ticker's company. Each has an answer. ``column`` is the form, or 'any'."""
    rows = filings.where("ticker is not null and filing_type is not null and date is not null").select("ticker", "company", F.col("filing_type").alias("form"), F.substring("date", 1, 4).alias("year"))
    rows = save_table(rows, "filing-rows").withColumn("earlier", (F.col("year").try_cast("int") - 1).cast("string"))
    where, form, any_ = "FROM filing_metadata WHERE ticker = '{ticker}'", F.col("form"), F.lit("any")
    of_form = f"{where} AND filing_type = '{{form}}'"
    return _smallest(_pairs(rows, [
        ("last filing", form, "When did {ticker} file its most recent {form}?", f"SELECT date {of_form} ORDER BY date DESC LIMIT 1", F.lit(True)),
        ("filing count", form, "How many {form} filings does {ticker} have?", f"SELECT count(*) {of_form}", F.lit(True)),
        ("filings of a year", any_, "List {ticker}'s filings from {year}.", f"SELECT filing_type, date {where} AND date LIKE '{{year}}%' ORDER BY date", F.lit(True)),
        ("filings since", form, "List all {form} filings of {ticker} after {earlier}.", f"SELECT date {of_form} AND date > '{{earlier}}-12-31' ORDER BY date DESC", F.col("earlier").isNotNull()),
        ("company", any_, "What company does the ticker {ticker} stand for?", f"SELECT company {where} LIMIT 1", F.col("company").isNotNull()),
    ]), per_stratum, seed)
