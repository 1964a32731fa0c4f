import math

from pyspark.sql import functions as F

from quillstone.operators import dataset, retrieval, store, text
from quillstone.operators import evaluation as ev
from quillstone.sources import tables

COLUMNS = [c for c in dataset.COLUMNS["panel"] if c not in ("ticker", "year")]


def values(spark, items, f, kind="string"):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(items)], f"i int, x {kind}")
    return [r.y for r in rows.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


def test_domain_filter(spark):
    asked = ["What is AAPL up to?", "what is aapl up to?", "Apple's plans", "net margin?", "In FY2021 what?", "the team's revenue", "hello there", "", None]
    assert values(spark, asked, dataset.is_domain_question) == [True, False, True, True, True, False, False, False, False]


def test_schema_and_pair_checks(spark):
    sql = ["SELECT cash FROM panel", "SELECT a FROM Nowhere", "SELECT one, two, three FROM panel", "SELECT one, two FROM panel WHERE year = 'FY2023'", "SELECT 1", "", None]
    assert values(spark, sql, dataset.schema_ok) == [True, False, False, True, True, True, None]
    pairs = [" select a from b", "SELECT 1", "SELECT updated FROM t", "WITH x AS (SELECT 1) SELECT * FROM x", "", None]
    assert values(spark, pairs, dataset.pair_ok) == [True, False, False, False, False, False]


def test_sql_scores(spark):
    rows = spark.createDataFrame(
        [(0, "select cash from panel where ticker='AB' and year='FY2020' -- why\n;", "SELECT cash FROM panel WHERE ticker='AB' AND year='FY2020'", "Cash of AB in 2020?"),
         (1, "SELECT 'cash' FROM financials JOIN panel", "x", "Cash?"), (2, None, None, None), (3, "", "", "")], "i int, p string, e string, q string")
    found = dataset.score_sql(F.col("p"), F.col("e"), F.col("q"), ["panel", "filing_metadata"], COLUMNS)
    got = [tuple(r)[1:] for r in rows.select("i", *found.values()).orderBy("i").collect()]
    assert list(found) == ["valid_sql", "correct_table", "correct_column", "period_format", "keyword_match", "exact_match"]
    assert got == [(1, 1, 1, 1, 1, 0), (1, 0, 0, 1, 1, 0), (0, 0, 0, 0, 0, 0), (0, 0, 0, 1, 1, 1)]


def test_runs_with_rows(spark):
    tables = {"panel": spark.createDataFrame([("A", 1.0)], "ticker string, cash double")}
    sql = ["SELECT cash FROM panel", "SELECT cash FROM panel WHERE cash > 9", "SELECT nothing FROM panel", "SELECT FROM", "DROP TABLE panel", "SELECT 1 FROM other"]
    assert [dataset.runs_with_rows(spark, s, tables) for s in sql] == [True, False, False, False, False, False]


def test_text_lists_and_references(spark):
    raw = ['[" a ", "", "b"]', 'so: ["x"] and ["y"]', '[1, "a"]', "[]", '{"k": ["z"]}', "none", '["a", null]', "", None]
    assert values(spark, raw, dataset.text_list) == [["a", "b"], ["x"], None, [], ["z"], None, None, None, None]
    many = "1. The first line is long enough\nshort\n2) A second line that is long too"
    assert values(spark, ['["p","q","r","s"]', many, None], lambda x: dataset.references(x, F.lit("F"))) == [
        ["p", "q", "r"], ["The first line is long enough", "A second line that is long too", "F"], ["F", "F", "F"],
    ]


def test_chat_rows(spark):
    m = dataset.chat_example("S", F.lit("q"), F.lit(" SELECT 1;; "))
    parts = dataset.prompt_and_completion(m, "<e>")
    r = spark.range(1).select(parts["prompt"].alias("p"), parts["completion"].alias("c")).first()
    assert ([(x.role, x.content) for x in r.p], r.c) == ([("system", "S"), ("user", "q")], "SELECT 1;<e>")


def test_perplexity(spark):
    rows = [("a", -1.0), ("a", -2.0), ("a", None), ("a", -math.inf), ("b", -1.0), ("c", None), (None, -1.0), (None, -1.0)]
    out = ev.perplexity(spark.createDataFrame(rows, "g string, lp double"), ["g"], "lp")
    assert {r.g: r.perplexity for r in out.collect()} == {"a": round(math.exp(1.5), 3), "b": None, "c": None, None: 2.718}
    assert ev.perplexity(spark.createDataFrame([], "g string, lp double"), ["g"], "lp").count() == 0


def test_burst(spark):
    rows = [("a", float(x), True) for x in range(1, 21)] + [("a", 99.0, False), ("b", 5.0, False), ("b", 6.0, None)]
    df = spark.createDataFrame(rows, "g string, latency double, ok boolean")
    every = {r.g: r for r in ev.burst(df, "g", "latency", F.col("ok"), F.max(F.lit(10.0))).collect()}
    a, b = every["a"], every["b"]
    assert (a.total_requests, a.errors, a.qps, a.latency_mean, a.latency_p50, a.latency_p95, a.latency_min, a.latency_max) == (21, 1, 2.1, 10.5, 11.0, 20.0, 1.0, 20.0)
    assert (b.total_requests, b.errors, b.latency_mean, b.latency_p50, b.latency_p95) == (2, 2, 0.0, 0.0, 0.0)
    assert ev.burst(df, "g", "latency", F.col("ok"), F.max(F.lit(10.0)), only_good=True).where("g = 'b'").first().qps == 0.0


def test_references_and_similarity(spark):
    got = values(spark, [2.5e9, 0.25, 12.5, None], lambda v: ev.build_reference(F.lit("Q?"), F.array(F.lit("k")), v), "double")
    assert got == ["Q? Answer: k, $2.5 billion", "Q? Answer: k, 25.0%", "Q? Answer: k, 12.5", "Q? Answer: k"]
    assert values(spark, [None], lambda v: ev.build_reference(F.lit("Q?"), F.lit(None).cast("array<string>"), v), "double") == ["Q?"]
    unit = F.array(F.lit(1.0), F.lit(0.0))
    assert values(spark, [[[0.6, 0.8], [-1.0, 0.0]], [[-1.0, 0.0]], [], None], lambda r: ev.best_similarity(unit, r), "array<array<double>>") == [0.6, 0.0, 0.0, 0.0]


def test_aggregate_and_summary(spark):
    df = spark.createDataFrame([("Type1", 1, 0.0), ("type2", 0, 2.0), ("Type2", None, 4.0), (None, None, None)], "category string, ok int, lat double")
    agg = {r.type: (r.n, r.ok) for r in ev.aggregate_scores(df, "category", {"ok": "ok"}).collect()}
    assert agg == {"Type1": (2, 1.0), "Type2": (2, 0.0), "all": (4, 0.5)}
    s = {r.category: (r.n, r.ok_fails, r.ok, r.lat) for r in ev.category_summary(df, "category", {"ok": "ok"}, {"lat": "lat"}).collect()}
    assert s == {"Type1": (1, 0, 1.0, None), "type2": (1, 1, 0.0, 2.0), "Type2": (1, 0, None, 4.0), None: (1, 0, None, None)}


def test_intent(spark):
    asked = ["Hi there", "history of it", "What is Apple's revenue?", "what is the current ratio?", "what is a lease", "define goodwill", "Why is cash flow important?", "", None]
    assert values(spark, asked, ev.fast_intent) == ["Type3", None, None, "Type3", "Type3", "Type3", "Type3", None, None]
    assert values(spark, ["Apple's revenue", "Apple's risks", ""], ev.fallback_intent) == ["Type1", "Type2", "Type2"]
    assert values(spark, ["It is Type3.", "unsure"], lambda x: ev.fallback_intent(F.lit("cash"), x)) == ["Type3", "Type1"]


def test_cases(spark):
    rows = [("A", f"FY{y}", v) for y, v in ((2019, 1.0), (2020, 2.5e9), (2021, None), (2022, 2e13), (2023, 3e6))] + [("A", "2020-03", 5.0)]
    panel = spark.createDataFrame(rows, "ticker string, year string, cash double")
    cases = ev.point_cases(panel, [("cash", "{name} {fy}?"), ("cash", "{name} {fy}?")]).collect()
    assert [(r.question, r.expected_value, r.keywords, r.template) for r in cases] == [("A FY2023?", 3e6, ["a", "3"], 0)]
    changes = ev.change_cases(panel.where("year like 'FY%'"), "cash", "{name} {fy1} {fy2}").orderBy("question").collect()
    assert [(r.question, r.change) for r in changes] == [("A FY2019 FY2020", 2.5e9 - 1.0), ("A FY2022 FY2023", 3e6 - 2e13)]


def test_context_and_counts(spark):
    chunks = spark.createDataFrame([(1, 7, 2, None, "10-K", "2020", "b"), (1, 8, 1, "A", None, "2021", "a"), (2, 9, 1, "B", "8-K", None, None)], "query_id int, chunk_id int, rank int, ticker string, filing_type string, date string, text string")
    got = {r.query_id: r.context for r in retrieval.context_block(chunks).collect()}
    assert got == {1: "[1] Source: A ? 2021\na\n\n[2] Source: ? 10-K 2020\nb", 2: "[1] Source: B 8-K ?\n"}
    n = retrieval.stage_counts(chunks, chunks.where("chunk_id <> 8"), cap=1).orderBy("query_id").collect()
    assert [tuple(r)[1:] for r in n] == [(2, 1, 2, 1), (1, 1, 1, 1)]


def test_files_and_filings(spark):
    assert values(spark, ["a.PDF", "a.htm", "a.HTML", "a.txt", "", None], text.extractor_kind) == ["pdf", "html", "html", "html?", "html?", "html?"]
    old = spark.createDataFrame([("x", "10-K", 4), ("y", "8-K", None)], "accession_number string, filing_type string, chunk_count int")
    new = spark.createDataFrame([("x", "10-Q", None, 1)], "accession_number string, filing_type string, chunk_count int, seq int")
    got = store.upsert_filings(old.withColumn("seq", F.lit(0)), new, ["seq"]).orderBy("accession_number").collect()
    assert [(r.accession_number, r.filing_type, r.section_count, r.chunk_count) for r in got] == [("x", "10-Q", 0, 0), ("y", "8-K", 0, 0)]


def test_files_round_trip(spark, tmp_path):
    rows = [(1, 'a "q", b\nline'), (2, ""), (3, None), (4, "é\\x")]
    df = spark.createDataFrame(rows, "i int, t string")
    tables.write_json_lines(df, f"{tmp_path}/j")
    tables.write_csv(df, f"{tmp_path}/c")
    assert sorted(map(tuple, tables.read_json_lines(spark, f"{tmp_path}/j", "i int, t string").collect())) == rows
    back = tables.read_csv(spark, f"{tmp_path}/c", "i int, t string").collect()
    assert sorted(map(tuple, back)) == [(i, t or None) for i, t in rows]
    (tmp_path / "a.json").write_text('[{"i": 1, "t": "x"}, {"i": 2}]')
    assert sorted(map(tuple, tables.read_json_arrays(spark, f"{tmp_path}/a.json", "i int, t string").collect())) == [(1, "x"), (2, None)]
    assert [tuple(r) for r in tables.describe(df).orderBy("position").collect()] == [(0, "i", "int", 4), (1, "t", "string", 3)]


def test_json_arrays_of_many_parts_lose_no_row(spark, tmp_path):
    tables.write_json_arrays(spark.range(1000).withColumn("t", F.concat(F.lit("é\n"), "id")), f"{tmp_path}/many", rows=25)
    back = tables.read_json_arrays(spark, f"{tmp_path}/many", "id long, t string")
    assert sorted(map(tuple, back.collect())) == [(k, f"é\n{k}") for k in range(1000)]
