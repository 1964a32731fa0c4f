"""What an expression names several times is computed once; each text is worth a pass over all its anchors."""

from pyspark.sql import functions as F

from quillstone.operators import html, text


def test_texts_are_put_into_capitals_once(spark):
    assert str(text.infer_statement(F.col("t"))).count("upper(") == 1
    assert str(text.detect_scale(F.col("t"))).count("upper(") == 1
    assert str(text.parse_number(F.col("t"))).count("trim(") == 1


def test_facts_of_a_page_come_from_one_pass_over_its_tables(spark):
    rows = [("in millions", [[["", "2020"], ["Total assets", "$", "(1,5)"], ["Current assets", "x", ""]]]), ("Net income from sales ..... $12", []), (None, None), ("None here", [[["a"], ["b"]]])]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, plain string, tables array<array<array<string>>>")
    found = text.facts_of(df, ["i"])
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("TOTAL LIABILITIES") == 2  # in tables, and in the text where they give no row
    got = [tuple(r) for r in found.orderBy("i", "metric").collect()]
    assert got == [(0, "balance_sheet", "Current assets", None, ""), (0, "balance_sheet", "Total assets", -15e6, "(1,5)"), (1, "unknown", "Net income from sales", 12.0, "12")]


def test_no_lines_are_counted(spark):
    page = html._Page("<p>a</p>\n\n<table><tr><td>b\n</td></tr><tr><td>c</td></tr></table>")
    assert page.getpos() == (1, 0) and "".join(page.nodes) == "a\n\nb\nc"
