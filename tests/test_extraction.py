import pytest
from pyspark.sql import functions as F

from quillstone.operators import evaluation as ev
from quillstone.operators import html, panel, retrieval, store, text
from quillstone.sources import filings

PAGE = """<html><head><title>T</title><body><script>var a = "<p>no</p>";</script><p>Cash &amp; more</p><xbrli:context><b>gone</b></xbrli:context>
<p>  <ix:nonfraction>89,500</ix:nonfraction>   paid</p><table><tr><td>only row</td></tr></table>
<table><tr><th>a<th>b<tr><td> 1 </td><td><b>2</b> x</td></tr><tr><td> </td><td></td></tr></table>
<table><tr><td>out<table><tr><td>in 1</td></tr><tr><td>in 2</td></tr></table></td></tr><tr><td>end</td></tr></table></body></html>"""


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_html_text_and_tables(spark):
    df = spark.createDataFrame([(1, PAGE), (2, None), (3, "")], "id int, html string")
    rows = {r.id: r for r in df.select("id", html.visible_text(F.col("html")).alias("t"), html.tables(F.col("html")).alias("tables")).collect()}
    assert [x.strip() for x in rows[1].t.split("\n") if x.strip()][:3] == ["Cash & more", "89,500", "paid"]
    assert "gone" not in rows[1].t and "var a" not in rows[1].t and "\n\n\n" not in rows[1].t
    assert [list(map(list, t)) for t in rows[1].tables] == [
        [["a", "b"], ["1", "2x"]],
        [["outin 1in 2", "in 1", "in 2"], ["in 1"], ["in 2"], ["end"]],
        [["in 1"], ["in 2"]],
    ]
    assert (rows[2].t, rows[2].tables, rows[3].t, rows[3].tables) == (None, [], "", [])


def test_sections_take_the_last_of_repeated_headings(spark):
    lines = ["intro", "ITEM 7. Results", "stub", "item 1. Business", "PART I", "", "ITEM 7. Results", "the body", "ITEM 1. " + "x" * 120, "more"]
    found = one(spark, text.sections(F.lit("\n".join(lines))))
    assert [(r.section, r.text) for r in found] == [("preamble", "intro"), ("ITEM 7. Results", "the body\n" + lines[8] + "\nmore")]
    assert one(spark, text.sections(F.lit(""))) == []
    assert one(spark, text.sections(F.lit(None).cast("string"))) is None


def test_facts_from_tables_and_text(spark):
    golden = [["", "Sep 2023", "Sep 2022"], ["Total net sales", "383,285", "394,328"], ["Cost of sales", "214,137"], ["Net income", "96,995"], ["EPS", "n/a", "6.13"], ["Gross profit", "—"], ["ab", "1"]]
    rows = one(spark, text.table_facts(F.array(*(F.array(*map(F.lit, r)) for r in golden)), F.lit(1e6)))
    assert [(r.metric, r.value, r.raw_value) for r in rows] == [("Total net sales", 383285e6, "383,285"), ("Cost of sales", 214137e6, "214,137"), ("Net income", 96995e6, "96,995"), ("EPS", 6130000.0, "6.13"), ("Gross profit", None, "")]
    assert {r.statement for r in rows} == {"income_statement"}
    plain = one(spark, text.text_facts(F.lit("in thousands\nNet income ........ $12,345\nNet change in cash  (1,200)\nCash  7")))
    assert [(r.metric, r.value) for r in plain] == [("Net income", 12345e3), ("Net change in cash", 1200e3)]


def test_walk_reads_names_and_picks_the_primary_file(spark, tmp_path):
    for at, size in (("AA/10-K/2020-01-02_X1/a.htm", 5), ("AA/10-K/2020-01-02_X1/b.HTML", 9), ("AA/10-K/2020-01-02_X1/z.pdf", 99), ("AA/8-K/2021-01-01_X2/b.pdf", 1), ("AA/8-K/2021-01-01_X2/a.pdf", 1), ("AA/8-K/nodate/a.htm", 3), ("AA/8-K/2021-02-01_X3/a.txt", 3), ("NEWS/8-K/2021-01-01_X4/a.htm", 1), ("BB/10-K/2019-12-31_X5/a.htm", 1)):
        (tmp_path / at).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / at).write_text("x" * size)
    files = filings.list_files(spark, str(tmp_path))
    named = spark.createDataFrame([("AA", "Alpha")], "ticker string, company string")
    found = filings.walk_filings(files, named, start="2019-12-31", end="2021-01-01").orderBy("accession_number").collect()
    assert [(r.ticker, r.company, r.filing_type, r.date, r.accession_number, r.source_path.rpartition("/")[2]) for r in found] == [
        ("AA", "Alpha", "10-K", "2020-01-02", "X1", "b.HTML"), ("AA", "Alpha", "8-K", "2021-01-01", "X2", "a.pdf"), ("BB", "BB", "10-K", "2019-12-31", "X5", "a.htm"),
    ]
    assert [r.ticker for r in filings.walk_filings(files, tickers=["BB"], forms=["10-K"]).collect()] == ["BB"]


def test_company_facts_skip_what_is_not_json(spark):
    docs = spark.createDataFrame([("A", '{"facts": {"us-gaap": {"Assets": {"units": {"USD": [{"fy": 2020, "val": 5}, {"fy": 2021, "val": 7}]}}}}}'), ("B", "{"), ("C", None)], "ticker string, json string")
    assert [(r.ticker, r.concept, r.unit, r.pos, r.fy, r.val) for r in filings.company_facts(docs).orderBy("pos").collect()] == [("A", "Assets", "USD", 0, 2020, 5.0), ("A", "Assets", "USD", 1, 2021, 7.0)]
    assert one(spark, filings.padded_cik(F.lit(320193))) == "0000320193"


@pytest.mark.parametrize(
    ("answer", "expected", "others", "right"),
    [
        ("Revenue was $383,285,000,000.", 383285e6, None, True), ("about 383.29 billion", 383285e6, None, True), ("about 500 billion", 383285e6, None, False), ("383,285 (in millions)", 383285e6, None, True),
        ("margin 25.3%", 0.2531, None, True), ("ROA of 0.1756", 0.1756, None, True), ("ROA of 17", 0.1756, None, False), ("margin 30%", 0.2531, [0.3], False),
        ("a loss of 2,722,000,000", -2722e6, None, True), ("2,722,000,000", -2722e6, None, False), ("-2.72B", -2722e6, None, True), ("a loss of 9 B", -2722e6, None, False),
        ("about 99 M", 50e6, [98e6], True), ("about 99 M", 50e6, [50e6, 0.0], False), ("anything", None, None, None), (None, 5e6, None, False), ("6.13", 6.13, None, True),
    ],
)
def test_value_correct(spark, answer, expected, others, right):
    row = spark.createDataFrame([(answer, expected, others)], "a string, e double, o array<double>")
    assert row.select(ev.value_correct(F.col("a"), F.col("e"), F.col("o")).alias("x")).first().x is right


def test_intent_scores_and_first_numbers(spark):
    cases = spark.createDataFrame([("a", None, "a", None), ("b", None, "a", None), (None, None, None, None), (None, ["a"], None, ["a"]), (None, None, None, ["a"])], "i string, s array<string>, e string, es array<string>")
    assert [r.x for r in cases.select(ev.intent_correct(F.col("i"), F.col("s"), F.col("e"), F.col("es")).alias("x")).collect()] == [True, False, None, True, False]
    yes, no, unknown = F.lit(True), F.lit(False), F.lit(None).cast("boolean")
    assert one(spark, ev.case_score(F.lit("TYPE1-ranking"), yes, yes, F.lit(1.0), F.lit(1.0))) == 1.0
    assert one(spark, ev.case_score(F.lit("Type1+Type2"), no, yes, F.lit(1.0), F.lit(1.0))) == 0.5
    assert one(spark, ev.case_score(F.lit("type2"), unknown, unknown, F.lit(0.5), None, ev.FINAL_WEIGHTS)) == 0.5
    for said, value in (("it is 1,234.5M now", 1234.5e6), ("2 t", 2e12), ("3 mètres", 3.0), ("none", None), ("-7", 7.0)):
        assert one(spark, ev.first_number(F.lit(said))) == value


@pytest.mark.parametrize(
    ("question", "found"),
    [
        ("What was Apple's revenue in FY2023?", ("AAPL", None, "2023")), ("Show MSFT 10-K filings from 2022", ("MSFT", "10-K", "2022")), ("Compare AAPL and MSFT 8k", (None, "8-K", None)),
        ("Compare AAPL and MSFT with Tesla", ("TSLA", None, None)), ("How do firms handle AI risk in 1999?", (None, None, None)), (None, (None, None, None)),
    ],
)
def test_question_filters(spark, question, found):
    assert tuple(one(spark, retrieval.question_filters(F.lit(question).cast("string")))) == found


def test_split_is_stable_and_densify_keeps_all_periods(spark):
    keys = spark.range(4000)
    n = keys.where(store.hash_split(F.col("id"), 0.85)).count()
    assert abs(n - 3400) < 120 and n == keys.repartition(7).where(store.hash_split(F.col("id"), 0.85)).count()
    assert one(spark, store.hash_split(F.lit(None), 0.85)) is False
    wide = spark.range(1200).select(F.lit("T").alias("ticker"), F.col("id").cast("string").alias("period"), F.lit(1.0).alias("v"))
    assert panel.densify(wide).count() == 1200


def test_company_facts_parse_a_document_once(spark):
    """An explode of parsed JSON is not turned into a condition that parses it again; documents without facts give no rows."""
    doc = '{"facts": {"us-gaap": {"A": {"units": {"USD": [{"fy": 2020, "val": 1.0}, {"fy": 2021, "val": 2.0}], "EUR": []}}, "B": {"units": {}}, "C": null}}}'
    rows = [("x", doc), ("none", '{"facts": {"us-gaap": {}}}'), ("null", None), ("bad", "no json"), ("other", '{"facts": {}}')]
    found = filings.company_facts(spark.createDataFrame(rows, "ticker string, json string"))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("from_json(") == 1
    assert [(r.ticker, r.concept, r.unit, r.pos, r.fy, r.val) for r in found.orderBy("pos").collect()] == [("x", "A", "USD", 0, 2020, 1.0), ("x", "A", "USD", 1, 2021, 2.0)]


def test_strip_and_chunks_of_texts_with_other_blanks(spark):
    """All that (?U)\\s takes goes at both ends and nothing else does; chunks are those of a plain loop, whatever the blanks."""
    import random

    blanks = "\t\n\x0b\f\r \x85\xa0       　"
    rng, words = random.Random(3), ["aé", "b.", "long" * 9, "c!", "​d?", *blanks, "\n\n", "\x1c"]
    texts = [None, "", blanks, *("".join(rng.choice(words) for _ in range(rng.randrange(200))) for _ in range(60))]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").orderBy("k")
    rows = df.select(text.strip(F.col("t")).alias("s"), F.regexp_replace("t", r"(?U)^\s+|\s+$", "").alias("r"), text.sentences(F.col("t")).alias("cut"), text.chunks(F.col("t"), 60, 20).alias("chunks")).collect()
    for r in rows:
        assert r.s == r.r and (r.cut is None) == (r.chunks is None)
        made, current = [], []
        for s in r.cut or []:
            if current and sum(map(len, current)) + len(s) > 60:
                made.append(" ".join(current))
                kept = []
                while len(kept) < len(current) and sum(map(len, kept)) + len(current[-1 - len(kept)]) <= 20:
                    kept.insert(0, current[-1 - len(kept)])
                current = kept
            current.append(s)
        assert (r.chunks or []) == made + ([" ".join(current)] if current else [])


def test_the_fold_of_chunks_holds_no_text(spark):
    """A lambda's result is copied: with texts in the state, a text of many chunks costs their square."""
    plan = spark.range(1).select(text.chunks(F.col("id").cast("string")))._jdf.queryExecution().analyzed().toString()
    assert "array<struct<a:int,b:int>>" in plan and "as array<string>" not in plan


def test_pages_are_parsed_in_slices(spark):
    """A batch of many pages is held a slice at a time, in its order; an empty batch gives an empty result."""
    import pandas as pd

    sizes = [len(x) for x in html._in_slices(iter([pd.Series(["<p>a</p>"] * 600), pd.Series([], dtype=str)]), lambda p: pd.DataFrame({"n": p.map(len)}))]
    assert sizes == [256, 256, 88, 0]
    rows = spark.range(700).coalesce(1).select("id", html.parsed(F.concat(F.lit("<p>"), F.col("id").cast("string"), F.lit("</p>")))["text"].alias("t"))
    assert {(r.id, r.t) for r in rows.collect()} == {(k, str(k)) for k in range(700)}
