import pytest

from quillstone import sqlsurface


@pytest.fixture(scope="module")
def tables(spark):
    panel = spark.createDataFrame([("A", "FY1", 3.0), ("A", "FY2", 5.0), ("B", "FY1", 4.0)], "ticker string, year string, total_revenue double")
    spark.createDataFrame([("hidden",)], "s string").createOrReplaceTempView("secret")
    yield {"panel": panel}
    spark.catalog.dropTempView("secret")


REFUSED = {
    "SELECT s FROM secret WHERE EXISTS (WITH secret AS (SELECT 1 AS one) SELECT one FROM secret)": "unknown tables: secret",
    "SELECT secret.s, i.one FROM secret, (WITH secret AS (SELECT 1 AS one) SELECT one FROM secret) i": "unknown tables: secret",
    "WITH a AS (SELECT * FROM b), b AS (SELECT 1 AS x) SELECT * FROM a": "unknown tables: b",
    "WITH secret AS (SELECT * FROM secret) SELECT * FROM secret": "unknown tables: secret",
    "SELECT * FROM (WITH q AS (SELECT 1 AS x) SELECT x FROM q) i, q": "unknown tables: q",
    "SELECT (WITH q AS (SELECT 1 AS x) SELECT max(x) FROM q) AS m FROM panel WHERE year IN (SELECT x FROM q)": "unknown tables: q",
    "SELECT current_user FROM panel": "unknown functions: current_user",
    "SELECT CURRENT_TIMESTAMP FROM panel": "unknown functions: current_timestamp",
    "SELECT ticker FROM panel WHERE total_revenue > (SELECT avg(total_revenue) FROM panel WHERE panel.ticker = ticker)": "panel.ticker = ticker compares",
    "SELECT ticker FROM panel WHERE EXISTS (SELECT 1 FROM panel p WHERE ticker = p.ticker AND p.year = 'FY1')": "ticker = p.ticker compares",
    "WITH RECURSIVE r AS (SELECT 1 AS n UNION ALL SELECT n + 1 FROM r WHERE n < 3) SELECT n FROM r": "unknown tables: r",
}


@pytest.mark.parametrize("sql", REFUSED)
def test_names_are_refused_out_of_their_scope(spark, tables, sql):
    with pytest.raises(sqlsurface.Refused) as e:
        sqlsurface.execute(spark, sql, tables)
    assert REFUSED[sql] in str(e.value)


ALLOWED = {
    "WITH panel AS (SELECT ticker FROM panel WHERE year = 'FY1') SELECT ticker FROM panel": [("A",), ("B",)],
    "WITH a AS (SELECT ticker FROM panel), b AS (SELECT ticker FROM a WHERE ticker = 'B') SELECT * FROM b": [("B",)],
    "WITH a AS (SELECT 'out' AS x) SELECT x, (WITH a AS (SELECT 'in' AS x) SELECT max(x) FROM a) AS y FROM a": [("out", "in")],
    "WITH a AS (SELECT 'B' AS t) SELECT ticker FROM panel WHERE ticker IN (SELECT t FROM a)": [("B",)],
    "SELECT ticker FROM panel o WHERE total_revenue > (SELECT avg(total_revenue) FROM panel i WHERE i.ticker = o.ticker)": [("A",)],
    "SELECT q.ticker FROM (WITH w AS (SELECT ticker, year FROM panel) SELECT * FROM w WHERE year = 'FY2') q JOIN panel ON panel.ticker = q.ticker AND panel.year = q.year": [("A",)],
}


@pytest.mark.parametrize("sql", ALLOWED)
def test_names_in_their_scope_run(spark, tables, sql):
    assert sorted(map(tuple, sqlsurface.execute(spark, sql, tables).collect())) == sorted(ALLOWED[sql])
