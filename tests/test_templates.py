from collections import Counter

from pyspark.sql import functions as F

from quillstone.operators import templates
from quillstone.sqlsurface import statements


def panel(spark):
    rows = [(f"T{i}", f"FY{y}", float(i * 100 + y), None if (i + y) % 3 == 0 else float(i - y)) for i in range(6) for y in range(2019, 2024)]
    return spark.createDataFrame([*rows, ("T9", "FY2020", None, None), (None, "FY2020", 1.0, 1.0), ("T8", None, 1.0, 1.0)], "ticker string, year string, total_revenue double, net_income double")


def test_pairs_are_bounded_the_same_at_any_partitioning_and_have_answers(spark):
    p, called = panel(spark), {"total_revenue": "revenue", "net_income": "net income"}
    got = templates.generated_pairs(p, called, 3)
    rows = sorted(map(tuple, got.collect()))
    assert rows == sorted(map(tuple, templates.generated_pairs(p.repartition(5, F.rand(3)), called, 3).collect()))
    counts = Counter((r[0], r[1]) for r in rows)
    assert set(counts) == {(k, c) for k in templates.KINDS for c in called} and max(counts.values()) == 3
    assert all("{" not in r[2] + r[3] and "None" not in r[2] for r in rows)
    results = {r.sql: r for r in statements.statement_results(got, {"panel": p}).collect()}
    assert all(results[r[3]].n_rows > 0 for r in rows), [r for r in rows if not results[r[3]].n_rows]
    assert templates.generated_pairs(p.limit(0), called, 3).count() == 0


ASKED = [
    templates.Asked("ratio", ("net_income",), "What is {ticker}'s ratio for {year}?"),
    templates.Asked("returns", ("total_revenue", "net_income"), "How much did {ticker} return in {year}?"),
    templates.Asked("best in class", ("net_income",), "Which company had the best ratio in {year}?", best=1),
]


def test_asked_pairs_have_answers(spark):
    p = panel(spark).union(spark.createDataFrame([("O'N", "FY2020", 4.0, 4.0)], panel(spark).schema))
    rows = templates.asked_pairs(p, ASKED, 4).collect()
    assert Counter(r.kind for r in rows) == {"ratio": 4, "returns": 4, "best in class": 4}
    assert {r.column for r in rows} == {"net_income", "total_revenue+net_income"}
    every = templates.asked_pairs(p, ASKED, 1000)
    filled = sum(r.net_income is not None and r.ticker is not None and r.year is not None for r in p.collect())
    assert Counter(r.kind for r in every.collect()) == {"ratio": filled, "returns": filled, "best in class": 5}
    assert {r.n_rows for r in statements.statement_results(every, {"panel": p}).collect()} == {1}
    assert templates.asked_pairs(p.limit(0), ASKED, 3).count() == 0


def test_filing_pairs_have_answers(spark):
    filed = [("A'B", "Ab Inc", "10-K", "2020-03-01"), ("A'B", "Ab Inc", "10-K", "2021-03-01"), ("C", None, "8-K", "2020-03-01"), ("C", None, "8-K", "soon"), (None, "x", "8-K", "2020-01-01"), ("D", "x", None, "2020-01-01"), ("D", "x", "8-K", None)]
    f = spark.createDataFrame(filed, "ticker string, company string, filing_type string, date string")
    pairs = templates.filing_pairs(f, 100)
    counts = Counter((r.kind, r.column) for r in pairs.collect())
    assert counts == {("last filing", "10-K"): 1, ("last filing", "8-K"): 1, ("filing count", "10-K"): 1, ("filing count", "8-K"): 1, ("filings of a year", "any"): 4, ("filings since", "10-K"): 2, ("filings since", "8-K"): 1, ("company", "any"): 1}
    assert all(r.n_rows > 0 for r in statements.statement_results(pairs, {"filing_metadata": f}).collect())
    assert templates.filing_pairs(f.limit(0), 3).count() == 0


def test_threshold_is_the_exact_quantile_of_many_values(spark):
    many = spark.range(60_001).select(F.concat(F.lit("T"), "id").alias("ticker"), F.lit("FY2020").alias("year"), (F.col("id") * 7 % 60_001).cast("double").alias("total_revenue"))
    got = templates.generated_pairs(many, {"total_revenue": "revenue"}, 3).where("kind = 'filter'").collect()
    assert [r.question for r in got] == ["Which companies had revenue of at least 45000 in FY2020?"]
