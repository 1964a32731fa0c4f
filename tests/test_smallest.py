"""The pairs with the smallest hashes: exact, also where far more beginnings of hashes occur than pairs are wanted, and few are sorted."""

import hashlib

from pyspark.sql import functions as F

from quillstone.operators import templates


def _wanted(rows, n):
    found = {}
    for r in {tuple(r) for r in rows}:
        found.setdefault(r[:2], []).append(r)
    key = lambda r: (hashlib.md5("|".join(("pairs", r[0], r[2])).encode()).hexdigest(), r[2], r[3])
    return sorted(r for some in found.values() for r in sorted(some, key=key)[:n])


def test_smallest_are_exact_at_any_number_of_beginnings(spark, monkeypatch):
    rows = [(k, c, f"question {i % 700 if k == 'a' else i % 3}", f"sql {i % 1400}") for k in "ab" for c in "xy" for i in range(2000)]
    pairs = spark.createDataFrame(rows, 'kind string, column string, question string, sql string')
    for digits in (1, 4):
        monkeypatch.setattr(templates, "DIGITS", digits)
        assert sorted(map(tuple, templates._smallest(pairs, 5, "pairs").collect())) == _wanted(rows, 5)


def test_only_candidates_are_sorted(spark):
    pairs = spark.range(200_000).select(F.lit("k").alias("kind"), F.lit("c").alias("column"), F.concat(F.lit("q"), "id").alias("question"), F.lit("s").alias("sql"))
    found = templates._smallest(pairs, 3, "pairs")
    assert found.count() == 3
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Aggregate") < plan.index("Join"), "pairs are made distinct only after those beyond the last beginning are left out"


def test_values_that_look_like_names_stay(spark):
    f = spark.createDataFrame([("A{year}", "x", "8-K", "2020-01-01")], "ticker string, company string, filing_type string, date string")
    assert {r.question for r in templates.filing_pairs(f, 9).where("kind = 'filings of a year'").collect()} == {"List A{year}'s filings from 2020."}
