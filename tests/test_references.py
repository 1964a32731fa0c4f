from pyspark.sql import functions as F

from quillstone.operators import references


def test_amounts(spark):
    wanted = {None: "", -2.5e9: "-$2.500B (net loss)", -1234567.0: "-$1,234,567", 3.21e12: "$3.210T", 1.5e9: "$1.500B", 2.34e6: "$2.3M", 0.1234: "12.34%", 0.0: "0.00%", 1234.5: "$1,234.50", float("nan"): "", -0.5: "-$0", -1.5: "-$2"}
    rows = spark.createDataFrame([(k, v) for k, v in wanted.items()], "v double, w string").select("v", "w", references.shown_amount(F.col("v")).alias("s")).collect()
    assert [(r.v, r.s) for r in rows if r.s != r.w] == []


def test_prompts_by_kind(spark):
    cases = spark.createDataFrame([
        (1, "Type1-ranking", "Revenue of FY2023?", 2.0e9, ["Apple", "b", "c", "d"]), (2, "type1", "Who?", None, ["x", "y", "z", "w"]), (3, "Type2", "Risks in FY2020 and FY2021?", None, ["k"] * 5),
        (4, "Type2", "Risks?", 1.0, None), (5, "TYPE3", "Hello FY2020", None, ["a", "b"]), (6, None, None, float("nan"), []), (7, "Type1+Type2", "q", 5.0, None),
    ], "id int, category string, question string, expected_value double, keywords array<string>")
    contexts = spark.createDataFrame([(3, "[Apple 10-K 2020]\ntext"), (1, "unused")], "query_id int, context string")
    r = {x.id: x for x in references.reference_prompts(cases, contexts).collect()}
    assert [(r[i].kind, r[i].year, r[i].key_word, r[i].prom_answer) for i in range(1, 8)] == [
        ("Type1", "FY2023", "Apple", "$2.000B"), ("Type1", "", "x, y, z", None), ("Type2", "FY2020", "k, k, k, k", None), ("Type2", "", "", None), ("Type3", None, "a, b", None), ("Type1", "", "", None), ("Type1", "", "", "$5.00"),
    ]
    assert "$2.000B (2000000000.0000)" in r[1].prompt and "Apple, b, c\n" in r[1].prompt and "unused" not in r[1].prompt
    assert "[Apple 10-K 2020]\ntext" in r[3].prompt and "Context" not in r[4].prompt and r[6].prompt.startswith("Question: \n")
    assert references.reference_prompts(cases.limit(0)).count() == 0 and "Context" not in {x.id: x for x in references.reference_prompts(cases).collect()}[3].prompt


def test_contexts_cite_their_sources(spark):
    corpus = spark.createDataFrame([(1, [1.0, 0.0], "abcdef", "Co", "10-K", "2020"), (2, [1.0, 0.1], "xyz", None, "8-K", None), (3, [1.0, 0.0], None, "Co", "10-K", "2020"), (4, [0.0, 1.0], "far", "F", "F", "F")], "chunk_id long, vec array<double>, text string, company string, filing_type string, date string")
    asked = spark.createDataFrame([(9, [1.0, 0.0]), (8, None)], "query_id long, qvec array<double>")
    assert [tuple(r) for r in references.cited_contexts(asked, corpus, n=2, chars=4).collect()] == [(9, "[Co 10-K 2020]\nabcd\n\n---\n\n[8-K]\nxyz")]


def test_batches_and_spot_checks(spark):
    open_, done = spark.createDataFrame([(i, 1) for i in range(100)], "id long, more int"), spark.range(0, 100, 2)
    got = references.next_batch(open_.union(spark.createDataFrame([(None, 1)], open_.schema)), done, "id", 10, 0.85).collect()
    assert [r.id for r in got] == list(range(1, 20, 2)) and {type(r.train) for r in got} == {bool}
    panel = spark.createDataFrame([("A", "FY1", 1234567.6, None, 1), ("A", "FY2", 1.0, 2.0, 1), ("B", "FY1", 0.5, -2e6, 1)], "ticker string, year string, x double, y double, z int")
    wanted = spark.createDataFrame([("A", "FY1"), ("A", "FY1"), ("B", "FY1"), ("C", "FY1")], "ticker string, year string")
    assert sorted(map(tuple, references.spot_checks(panel, wanted).collect())) == [("A", "FY1", "x", "1,234,568"), ("A", "FY1", "y", "NULL"), ("B", "FY1", "x", "0.5000"), ("B", "FY1", "y", "-2,000,000")]


def test_amounts_round_the_double_itself(spark):
    # 18.755 and 2.675 lie below the half as doubles; 12.5/100 and 0.00005 are taken as they are stored.
    wanted = {0.18755: f"{0.18755 * 100:.2f}%", 2.675: "$2.67", 1.0625e9: "$1.062B", 1.25e6: "$1.2M"}
    rows = spark.createDataFrame([(k, v) for k, v in wanted.items()], "v double, w string").select("v", "w", references.shown_amount(F.col("v")).alias("s")).collect()
    assert [(r.v, r.s) for r in rows if r.s != r.w] == []
    panel = spark.createDataFrame([("A", "FY1", 0.03125, 1.00005)], "ticker string, year string, x double, y double")
    assert sorted(r.shown for r in references.spot_checks(panel, panel).collect()) == ["0.0312", f"{1.00005:.4f}"]
