"""Text operators: sentences, chunks, headings, numbers, scales, statements, periods."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Phrases that tell a balance sheet, an income statement and a cash flow statement.
STATEMENT_ANCHORS = {
    "balance_sheet": [
        "TOTAL ASSETS", "CURRENT ASSETS", "CASH AND CASH EQUIVALENTS", "ACCOUNTS RECEIVABLE", "INVENTORIES", "GOODWILL", "INTANGIBLE ASSETS",
        "PROPERTY PLANT AND EQUIPMENT", "PROPERTY AND EQUIPMENT", "TOTAL LIABILITIES", "CURRENT LIABILITIES", "ACCOUNTS PAYABLE", "LONG-TERM DEBT",
        "DEFERRED REVENUE", "DEFERRED TAX", "STOCKHOLDERS EQUITY", "SHAREHOLDERS EQUITY", "RETAINED EARNINGS", "COMMON STOCK",
        "ADDITIONAL PAID-IN CAPITAL", "TREASURY STOCK", "TOTAL EQUITY", "NONCONTROLLING INTEREST",
    ],
    "income_statement": [
        "TOTAL REVENUE", "NET REVENUE", "NET SALES", "REVENUES", "COST OF GOODS SOLD", "COST OF REVENUE", "GROSS PROFIT", "OPERATING INCOME",
        "OPERATING EXPENSES", "RESEARCH AND DEVELOPMENT", "SELLING GENERAL AND ADMINISTRATIVE", "DEPRECIATION AND AMORTIZATION", "INTEREST EXPENSE",
        "INTEREST INCOME", "INCOME BEFORE TAX", "PROVISION FOR INCOME TAXES", "NET INCOME", "EARNINGS PER SHARE", "DILUTED EPS", "BASIC EPS",
        "WEIGHTED AVERAGE SHARES",
    ],
    "cash_flow": [
        "CASH FLOWS FROM OPERATING", "OPERATING ACTIVITIES", "CASH FLOWS FROM INVESTING", "INVESTING ACTIVITIES", "CASH FLOWS FROM FINANCING",
        "FINANCING ACTIVITIES", "CAPITAL EXPENDITURES", "PURCHASES OF PROPERTY", "DEPRECIATION", "STOCK-BASED COMPENSATION", "NET CASH PROVIDED",
        "NET CASH USED", "CASH AND CASH EQUIVALENTS AT END",
    ],
}
# How headings of a filing's sections begin.
HEADINGS = (
    "ITEM 1.", "ITEM 1A.", "ITEM 1B.", "ITEM 1C.", "ITEM 2.", "ITEM 3.", "ITEM 4.", "ITEM 5.", "ITEM 6.", "ITEM 7.", "ITEM 7A.", "ITEM 8.", "ITEM 9.",
    "ITEM 9A.", "ITEM 9B.", "ITEM 10.", "ITEM 11.", "ITEM 12.", "ITEM 13.", "ITEM 14.", "ITEM 15.", "PART I", "PART II", "PART III", "PART IV",
)
NULL_TOKENS = ["", "-", "--", "—", "N/A", "n/a", "nm", "NM", "*"]


#: What (?U)\\s takes in a regular expression.
BLANKS = "\t\n\x0b\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def once(value: Column, of: Callable[[Column], Column]) -> Column:
    """``of(value)`` with the value computed once, however often ``of`` names it: within lambdas nothing else sees to that."""
    return F.transform(F.array(value), of)[0]


def strip(c: Column) -> Column:
    """Without white space at both ends, which is all that is looked at."""
    return F.btrim(c, F.lit(BLANKS))


def sentences(text: Column) -> Column:
    """Cut at white space after . ! ? and at blank lines; trimmed, without empty ones."""
    return F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+|\n{2,}"), strip), lambda s: s != "")


def chunks(text: Column, size: int = 512, overlap: int = 64) -> Column:
    """Greedy chunks of whole sentences as a fold; a new chunk begins with the trailing sentences that fit the overlap. The
    state holds the places and the length of the current chunk's sentences and no text, since a lambda's result is copied."""

    def tail(current: Column) -> Column:
        def keep(state, n):
            fits = state.open & (state.n + n <= overlap)
            return F.when(fits, F.struct((state.kept + 1).alias("kept"), (state.n + n).alias("n"), fits.alias("open"))).otherwise(F.struct(state.kept.alias("kept"), state.n.alias("n"), F.lit(False).alias("open")))

        return F.aggregate(F.reverse(current), F.struct(F.lit(0).alias("kept"), F.lit(0).alias("n"), F.lit(True).alias("open")), keep)

    def spans(lengths: Column) -> Column:
        """array<struct<a, b>>: the sentences from place a up to, but without, place b make a chunk."""

        def add(state, n):
            kept = tail(F.slice(lengths, state.a + 1, state.b - state.a))
            made = lambda done, a, begun: F.struct(done.alias("done"), a.alias("a"), (state.b + 1).alias("b"), (begun + n).alias("n"))
            full = (state.n + n > size) & (state.b > state.a)
            return F.when(full, made(F.concat(state.done, F.array(F.struct(state.a.alias("a"), state.b.alias("b")))), state.b - kept["kept"], kept["n"])).otherwise(made(state.done, state.a, state.n))

        begun = F.struct(F.array().cast("array<struct<a:int,b:int>>").alias("done"), F.lit(0).alias("a"), F.lit(0).alias("b"), F.lit(0).alias("n"))
        end = F.aggregate(lengths, begun, add)
        return F.transform(F.array(end), lambda e: F.when(e.b > e.a, F.concat(e.done, F.array(F.struct(e.a.alias("a"), e.b.alias("b"))))).otherwise(e.done))[0]

    of = lambda s: F.transform(F.transform(F.array(F.transform(s, F.length)), spans)[0], lambda p: F.array_join(F.slice(s, p.a + 1, p.b - p.a), " "))
    return F.transform(F.array(sentences(text)), of)[0]


def clean_label(label: Column) -> Column:
    """Without a leading number such as ' 1. ' or '(iv) ', with single blanks, and without marks and blanks at both ends."""
    bare = F.regexp_replace(label, r"(?U)^\s*[\d.\-()ivxlIVXL]+[.)]\s*", "")
    return F.regexp_replace(F.regexp_replace(bare, r"(?U)\s+", " "), r"^[ :.,;]+|[ :.,;]+$", "")


def parse_number(cell: Column) -> Column:
    """US notation; parentheses around the whole cell make it negative; what isn't a finite number is null."""
    return once(strip(cell), _number)


def _number(raw: Column) -> Column:
    negative = raw.startswith("(") & raw.endswith(")")
    bare = F.regexp_replace(F.regexp_replace(raw, r"^[()]+|[()]+$", ""), r"(?U)[$,%\s]", "")
    value = once(bare, lambda b: F.when(b.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), b.try_cast("double")))
    return F.when(~raw.isin(NULL_TOKENS), F.when(negative, -value).otherwise(value))


def detect_scale(text: Column) -> Column:
    return once(F.upper(text), lambda up: F.when(up.contains("BILLION"), 1e9).when(up.contains("MILLION"), 1e6).when(up.contains("THOUSAND"), 1e3).otherwise(1.0))


def infer_statement(text: Column) -> Column:
    """The statement with the most anchors, of at least two; ties in the order of the list above."""
    counts = lambda up: F.struct(*(sum((up.contains(a).cast("int") for a in v), F.lit(0)).alias(k) for k, v in STATEMENT_ANCHORS.items()))

    def named(n: Column) -> Column:
        most = F.greatest(*(n[k] for k in STATEMENT_ANCHORS))
        out = F.when(most < 2, "unknown")
        for k in STATEMENT_ANCHORS:
            out = out.when(n[k] == most, k)
        return out

    return once(once(F.upper(text), counts), named)


def fiscal_period(form: Column, date: Column) -> Column:
    return F.when(form == "10-K", F.concat(F.lit("FY"), F.substring(date, 1, 4))).otherwise(F.substring(date, 1, 7))


def document_id(ticker: Column, kind: Column, date: Column) -> Column:
    return F.concat_ws("__", ticker, kind, date)


def chunk_id(doc_id: Column, path: Column, index: Column) -> Column:
    return F.concat_ws("__", doc_id, F.substring(F.md5(path), 1, 8), F.format_string("%05d", index))


def sections(text: Column, headings: tuple[str, ...] = HEADINGS, longest: int = 120) -> Column:
    """array<struct<section, text>>: the lines below each heading, and what comes before the first as ``preamble``.

    A line under ``longest`` characters that begins with a heading, in any case, is one; its whole line names the section.
    Of repeated headings the last counts, and sections without text are left out. No shuffle: a text is one row.
    """
    begins = "^(" + "|".join(h.replace(".", r"\.") for h in headings) + ")"

    def split(lines: Column) -> Column:
        line = lambda i: strip(F.element_at(lines, i))
        heads = F.filter(F.sequence(F.lit(1), F.size(lines)), lambda i: once(line(i), lambda x: (F.length(x) < longest) & F.upper(x).rlike(begins)))
        return F.transform(F.array(F.concat(F.array(F.lit(0)), heads)), lambda starts: cut(lines, starts))[0]

    def cut(lines: Column, starts: Column) -> Column:
        def part(s: Column, k: Column) -> Column:
            stop = F.coalesce(F.get(starts, k + 1), F.size(lines) + 1)
            name = F.when(s == 0, "preamble").otherwise(strip(F.element_at(lines, F.greatest(s, F.lit(1)))))
            return F.struct(name.alias("section"), strip(F.array_join(F.slice(lines, s + 1, stop - s - 1), "\n")).alias("text"), k.alias("k"))

        return F.transform(F.array(F.transform(starts, part)), last)[0]

    def last(parts: Column) -> Column:
        kept = F.filter(parts, lambda p: (p.text != "") & ~F.exists(parts, lambda q: (q.section == p.section) & (q.k > p.k)))
        return F.transform(kept, lambda p: F.struct(p.section.alias("section"), p.text.alias("text")))

    return F.transform(F.array(F.split(text, "\n")), split)[0]


def has_keyword(text: Column, keywords: list[str]) -> Column:
    """Whether any keyword is contained, in any case."""
    up = F.upper(text)
    return F.exists(F.array(*(F.lit(k.upper()) for k in keywords)), lambda k: F.contains(up, k))


def pages_near_keywords(pages: DataFrame, keywords: list[str], window: int = 2, doc: str = "doc", page: str = "page", text_col: str = "text") -> DataFrame:
    """The rows of ``pages`` at most ``window`` pages from one of the same document with a keyword."""
    hits = pages.where(has_keyword(F.col(text_col), keywords))
    near = hits.select(doc, F.explode(F.sequence(F.col(page) - window, F.col(page) + window)).alias(page)).distinct()
    return pages.join(near, [doc, page], "left_semi")


def table_facts(table: Column, scale: Column) -> Column:
    """array<struct<statement, metric, value, raw_value>> of one table: the first cell is the label, the first number to
    its right times ``scale`` the value. Rows without a number have a null value; labels under 3 letters are left out."""
    statement = infer_statement(F.array_join(F.flatten(table), " "))

    def fact(row: Column) -> Column:
        cells = F.transform(F.slice(row, 2, F.size(row)), lambda c: F.struct(parse_number(c).alias("value"), strip(c).alias("raw")))
        metric = clean_label(F.get(row, F.lit(0)))
        return once(F.get(F.filter(cells, lambda c: c.value.isNotNull()), F.lit(0)), lambda first: F.struct(metric.alias("metric"), (first.value * scale).alias("value"), F.coalesce(first.raw, F.lit("")).alias("raw_value")))

    named = F.filter(F.transform(F.filter(table, lambda r: F.size(r) > 0), fact), lambda f: F.length(f.metric) >= 3)
    return F.transform(F.array(statement), lambda s: F.transform(named, lambda f: F.struct(s.alias("statement"), f.metric.alias("metric"), f.value.alias("value"), f.raw_value.alias("raw_value"))))[0]


def text_facts(text: Column) -> Column:
    """The same from plain text: a label, two or more blanks or dots, a number. A sign or bracket before it is not read."""
    pattern = F.lit(r"(?U)([A-Z][A-Za-z &,\-/]{5,60}?)[\s.]{2,}[$(]?\s*([\d,]+(?:\.\d+)?)\)?")
    pairs = F.arrays_zip(F.regexp_extract_all(text, pattern, F.lit(1)).alias("label"), F.regexp_extract_all(text, pattern, F.lit(2)).alias("raw"))
    scale = detect_scale(text)

    def fact(p: Column, s: Column) -> Column:
        return once(clean_label(p["label"]), lambda metric: F.struct(infer_statement(metric).alias("statement"), metric.alias("metric"), (parse_number(p["raw"]) * s).alias("value"), p["raw"].alias("raw_value")))

    facts = F.transform(F.array(scale), lambda s: F.transform(pairs, lambda p: fact(p, s)))[0]
    return F.filter(facts, lambda f: f.value.isNotNull() & (F.length(f.metric) >= 5))


def facts_of(filings: DataFrame, keys: list[str]) -> DataFrame:
    """Facts out of (plain, tables): those of the tables with one scale for the whole text; of the text where no table gives a row."""
    found = once(detect_scale(F.col("plain")), lambda scale: F.flatten(F.transform("tables", lambda t: table_facts(t, scale))))
    return filings.select(*keys, F.inline(once(found, lambda facts: F.when(F.size(facts) > 0, facts).otherwise(text_facts(F.col("plain"))))))


def filing_facts(filings: DataFrame, html_col: str = "html") -> DataFrame:
    """The facts of each filing's page, which is parsed once."""
    from quillstone.operators import html

    keys = [c for c in filings.columns if c != html_col]
    return facts_of(filings.withColumn("__p", html.parsed(F.col(html_col))).select(*keys, F.col("__p.text").alias("plain"), F.col("__p.tables").alias("tables")), keys)


def extractor_kind(path: Column) -> Column:
    """Which reader takes a file: 'pdf', 'html', or 'html' as a guess, marked 'html?', for other names."""
    low = F.lower(path)
    return F.when(F.endswith(low, F.lit(".pdf")), "pdf").when(low.rlike(r"\.html?$"), "html").otherwise("html?")
