import re

import pytest
from pyspark.sql import functions as F

from quillstone import sqlsurface
from quillstone.sqlsurface import statements as st


@pytest.fixture(scope="module")
def tables(spark):
    rows = [(t, f"FY{y}", float(i * 10 + y - 2000), float(i)) for i, t in enumerate(("GOOG", "AB", "O'N")) for y in (2020, 2021, 2022)]
    return {"panel": spark.createDataFrame([*rows, ("AB", "FY2023", None, 5.0)], "ticker string, year string, total_revenue double, net_income double")}


def column(spark, texts, made):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, sql string")
    return [r.x for r in df.select("i", made(F.col("sql")).alias("x")).orderBy("i").collect()]


STATEMENTS = [
    "SELECT revenue FROM panel WHERE ticker = 'GOOGL' AND year = 'FY2021'", "select Sales, profit from panel where note = 'revenue' and t = \"BRK.B\"", "SELECT 'it''s revenue', eps FROM panel", "SELECT \"revenue\" FROM panel",
    "", "SELECT 'open", "DROP TABLE panel", "SELECT d10, 10k FROM panel WHERE net > 1.5e3", "SELECT revenue\n  -- sales\nFROM panel",
]


def test_repair_as_a_column_is_the_repair_of_one_statement(spark):
    for sql, got in zip(STATEMENTS, column(spark, STATEMENTS, st.repaired)):
        fixed, repairs = sqlsurface.repair(sql)
        assert (got.sql, got.repairs) == (fixed, [f"{a} -> {b}" for a, b in repairs])
    assert column(spark, [None], st.repaired) == [None]


def test_literals_are_lifted_and_can_be_put_back(spark):
    texts = ["SELECT a FROM panel WHERE t = 'x''y' AND v >=-2.5 AND n IN ('p', '') LIMIT 3;", "SELECT round(a, 2) FROM panel WHERE b<7"]
    got = column(spark, texts, st.lifted)
    assert [(list(g.strings), list(g.numbers)) for g in got] == [(["x'y", "p", ""], [-2.5]), ([], [7.0])]
    assert re.sub(r"\s+", "", got[0].template) == "SELECTaFROMpanelWHEREt=''ANDv>=0ANDnIN('','')LIMIT3" and "round(a, 2)" in got[1].template


def test_records_of_a_table_of_statements(spark):
    texts = ["SELECT sales FROM panel WHERE ticker = 'GOOGL'", "SELECT sales FROM panel WHERE ticker = 'A; DROP TABLE x'", "SELECT s FROM secret", "DROP TABLE panel", None, "nothing"]
    df = spark.createDataFrame(list(enumerate(texts)), "template int, sql string")
    got = {r.template: r for r in st.statement_records(df, {"panel"}).collect()}
    assert [got[i].is_valid for i in range(6)] == [True, True, False, False, False, False]
    assert got[0].sql_repaired == "SELECT total_revenue FROM panel WHERE ticker = 'GOOG'" and list(got[0].repairs) == ["sales -> total_revenue", "GOOGL -> GOOG"]
    assert got[2].error == "unknown tables: secret" and got[4].sql_repaired is None
    with pytest.raises(ValueError, match="templates"):
        st.statement_records(df, {"panel"}, max_templates=2)


def test_statements_that_differ_in_comments_share_a_template(spark):
    texts = [f"DROP TABLE panel -- S{i}" for i in range(50)] + [f"SELECT ticker /* S{i}'s */ FROM panel -- it's {i}\nWHERE ticker = 'S{i}'" for i in range(50)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, sql string")
    got = {r.i: r for r in st.statement_records(df, {"panel"}, max_templates=2).collect()}
    assert len(got) == 100 and all(got[i].sql_repaired == texts[i] and got[i].is_valid == (i >= 50) for i in got)
    assert {got[i].error for i in range(50)} == {"Only SELECT statements allowed: DropTable, UnresolvedIdentifier"}
    assert [list(g.strings) for g in column(spark, texts[50:], st.lifted)] == [[f"S{i}"] for i in range(50)]


def test_only_comments_are_left_out(spark):
    same = ["SELECT '-- a', \"/* b */\", `--c` FROM panel", "SELECT /*+ BROADCAST(panel) */ a FROM panel", "SELECT a - -1, b / c FROM panel", "SELECT 1 /* open", "SELECT '\\' -- ' FROM secret", "SELECT /* a /* ' */ ' */ 1 FROM panel", None]
    assert column(spark, same, st.without_comments) == same
    assert column(spark, ["-- x", "SELECT/**/a--'\r\nFROM p /* ' */, 'q--' -- -- /*", "SELECT a /* -- */ FROM p--"], st.without_comments) == [" ", "SELECT a \r\nFROM p  , 'q--'  ", "SELECT a   FROM p "]
    hidden = ["SELECT ticker FROM panel /* ' */ UNION SELECT x FROM secret -- '", "SELECT ticker FROM panel -- '\nUNION SELECT x FROM secret WHERE y = ''"]
    df = spark.createDataFrame(list(enumerate(hidden)), "i int, sql string")
    assert {r.error for r in st.statement_records(df, {"panel"}).collect()} == {"unknown tables: secret"}


def plain_result(spark, sql, tables):
    rows = sqlsurface.execute(spark, sql, tables).collect()
    return sorted(tuple("NULL" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v) for v in r) for r in rows)


GOOD = [
    *(f"SELECT total_revenue FROM panel WHERE ticker = '{t}' AND year = '{y}'" for t in ("GOOG", "AB", "O''N", "none") for y in ("FY2020", "FY2023")),
    *(f"SELECT ticker, year, revenue FROM panel WHERE year = '{y}' ORDER BY total_revenue DESC LIMIT 2" for y in ("FY2021", "FY2022", "FY1900")),
    *(f"SELECT max(revenue), count(*) FROM panel WHERE ticker = '{t}' AND net_income > {n}" for t in ("GOOG", "AB", "none") for n in (-1, 1.5)),
    *(f"SELECT ticker, avg(total_revenue) AS m FROM panel WHERE year IN ('FY2020', '{y}') GROUP BY ticker HAVING avg(total_revenue) > {n}" for y in ("FY2021", "FY2022") for n in (3, 15)),
    *(f"SELECT ticker FROM panel WHERE ticker LIKE '{p}'" for p in ("%O%", "A_")),
    "SELECT ticker FROM panel WHERE total_revenue > (SELECT avg(p.total_revenue) FROM panel p WHERE p.year = 'FY2021')",
    "WITH w AS (SELECT * FROM panel WHERE year = 'FY2020') SELECT count(*) FROM w",
    "SELECT count(*) FROM panel", "SELECT ticker, ticker FROM panel WHERE year = 'FY2022'",
]
BAD = ["SELECT nothing FROM panel WHERE ticker = 'AB'", "SELECT s FROM secret", "DROP TABLE panel", "", "SELECT 1 / (total_revenue - total_revenue) FROM panel WHERE year = 'FY2020'", "SELECT (SELECT p.ticker FROM panel p) FROM panel"]


def test_statements_run_by_template_as_they_run_alone(spark, tables):
    df = spark.createDataFrame([(s,) for s in [*GOOD, *BAD, None, GOOD[0]]], "sql string")
    got = {r.sql: r for r in st.statement_results(df, tables).collect()}
    assert set(got) == {*GOOD, *BAD} and all(got[s].n_rows is None and got[s].error for s in BAD)
    plain = {s: plain_result(spark, s, tables) for s in GOOD}
    assert {s: got[s].n_rows for s in GOOD} == {s: len(r) for s, r in plain.items()}
    for a in GOOD:
        for b in GOOD:
            assert (got[a].digest == got[b].digest) == (plain[a] == plain[b]) or not plain[a] or not plain[b]
    kept = st.with_rows(df, tables).collect()
    assert sorted(r.sql for r in kept) == sorted([s for s in GOOD if plain[s]] + [GOOD[0]])


def test_execution_match(spark, tables):
    a, same, other, none, bad = GOOD[0], "SELECT total_revenue AS x FROM panel WHERE year = 'FY2020' AND ticker = 'GOOG'", GOOD[2], GOOD[6], "SELECT FROM"
    df = spark.createDataFrame([(1, same, a), (2, other, a), (3, bad, a), (4, a, none), (5, a, bad), (6, None, a)], "sql long, predicted string, expected string")
    got = {r.sql: (r.expected_ok, r.expected_has_rows, r.predicted_ok, r.rows_match) for r in st.execution_match(df, tables).collect()}
    assert got == {1: (True, True, True, True), 2: (True, True, True, False), 3: (True, True, False, False), 4: (True, False, True, None), 5: (False, False, True, None), 6: (True, True, False, False)}


def test_as_many_jobs_as_templates(spark, tables):
    many = spark.range(3000).select(F.concat(F.lit("SELECT revenue FROM panel WHERE net_income = "), F.col("id") % 7, F.lit(" AND ticker = '"), F.col("id"), F.lit("'")).alias("sql"))
    spark.sparkContext.setJobGroup("templates", "x")
    assert st.statement_results(many, tables).count() == 3000
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("templates")
    spark.sparkContext.setJobGroup("other", "x")
    assert len(jobs) < 30


REWRITES = {
    "SELECT net_income FROM panel WHERE ticker = 'A' AND year = 'FY2023'": "SELECT value FROM financials WHERE metric = 'Net income' AND ticker = 'A' AND period = 'F2023';",
    "SELECT ticker, AVG(total_revenue) FROM panel WHERE year IN ('FY2021', 'FY2022') GROUP BY ticker;": "SELECT ticker, AVG(value) FROM financials WHERE metric = 'Total revenue' AND period IN ('F2021', 'F2022') GROUP BY ticker;",
    "select year, net_income from panel where year between 'FY2020' and 'FY2022' order by year": "select period, value FROM financials where metric = 'Net income' AND period IN ('F2020', 'F2021', 'F2022') order by period;",
    "SELECT ticker, net_income FROM panel ORDER BY net_income DESC LIMIT 3": "SELECT ticker, value FROM financials  WHERE metric = 'Net income' ORDER BY value DESC LIMIT 3;",
    "SELECT MAX(net_income) FROM panel;": "SELECT MAX(value) FROM financials WHERE metric = 'Net income';",
    "SELECT ticker FROM panel": None, "UPDATE panel SET a = 1": None, "SELECT value FROM financials": "SELECT value FROM financials",
    "SELECT net_income FROM panel WHERE year BETWEEN 'FY2022' AND 'FY2020'": "SELECT value FROM financials WHERE metric = 'Net income' AND period IN ();",
}


def test_panel_statements_become_statements_on_long_facts(spark):
    got = column(spark, [*REWRITES, None], lambda c: st.panel_to_long(c, {"net_income": "Net income", "total_revenue": "Total revenue"}, "F"))
    assert got == [*REWRITES.values(), None]
