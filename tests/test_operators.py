import pytest
from pyspark.sql import functions as F

from quillstone import sqlsurface
from quillstone.operators import evaluation, metrics, panel, retrieval, store, text


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("cell", "value"),
    [("(1,234.5)", -1234.5), ("1,234.5", 1234.5), ("--", None), ("N/A", None), ("—", None), ("*", None), ("", None), ("25%", 25.0), ("$(1,234)", None), ("(12", 12.0), ("nan", None), ("inf", None), ("1d", None), (" $7 ", 7.0)],
)
def test_parse_number(spark, cell, value):
    assert one(spark, text.parse_number(F.lit(cell))) == value


def _chunks(sentences, size, overlap):
    out, current = [], []
    for s in sentences:
        if current and sum(map(len, current)) + len(s) > size:
            out.append(" ".join(current))
            kept = []
            for t in reversed(current):
                if sum(map(len, kept)) + len(t) > overlap:
                    break
                kept.insert(0, t)
            current = kept
        current.append(s)
    return out + [" ".join(current)] if current else out


def test_chunks_match_a_plain_loop(spark):
    words = [f"Sentence number {k} has {'x' * (k * 7 % 90)} in it." for k in range(60)]
    body = " ".join(words)
    assert one(spark, text.chunks(F.lit(body), 120, 30)) == _chunks(words, 120, 30)
    assert one(spark, text.chunks(F.lit(""), 120, 30)) == []
    assert one(spark, text.sentences(F.lit("A b. C\n\nd! E"))) == ["A b.", "C", "d!", "E"]


def test_labels_scales_and_statements(spark):
    assert one(spark, text.clean_label(F.lit("(iv) Net  income:"))) == "Net income"
    assert one(spark, text.detect_scale(F.lit("in thousands, except billions"))) == 1e9
    assert one(spark, text.infer_statement(F.lit("Total assets; goodwill"))) == "balance_sheet"
    assert one(spark, text.infer_statement(F.lit("goodwill"))) == "unknown"
    assert one(spark, text.chunk_id(F.lit("d"), F.lit("p"), F.lit(123456))).endswith("__123456")


def test_metric_key_is_idempotent(spark):
    assert one(spark, metrics.metric_key(F.lit("Net sales, total"))) == "sales"
    key = metrics.metric_key(F.lit("Cost of goods sold & other"))
    assert one(spark, metrics.metric_key(key)) == one(spark, key) == "cost goods other sold"


def test_upsert_replaces_with_null_and_is_idempotent(spark):
    old = spark.createDataFrame([("a", 1.0, 0), ("b", 2.0, 0)], "k string, v double, seq int")
    new = spark.createDataFrame([("a", 5.0, 1), ("a", None, 2), ("c", 3.0, 1)], "k string, v double, seq int")
    once = store.upsert(old, new, ["k"], ["seq"])
    twice = store.upsert(once, new, ["k"], ["seq"])
    want = {("a", None), ("b", 2.0), ("c", 3.0)}
    assert {(r.k, r.v) for r in once.collect()} == {(r.k, r.v) for r in twice.collect()} == want


def test_ratios_treat_zero_as_missing(spark):
    row = spark.createDataFrame([(0.0, 2.0, 1.0, 4.0, 8.0, 0.0)], "current_assets double, current_liabilities double, net_income double, total_revenue double, total_assets double, total_liabilities double")
    r = panel.add_ratios(row).first()
    assert (r.current_ratio, r.net_margin, r.debt_to_assets) == (None, 0.25, None)
    assert panel.add_ratios(row, zero_is_missing=False).first().current_ratio == 0.0


def test_repair_gate_and_execution(spark):
    fixed, repairs = sqlsurface.repair("SELECT revenue FROM panel WHERE ticker = 'GOOGL' AND note = 'revenue'")
    assert fixed == "SELECT total_revenue FROM panel WHERE ticker = 'GOOG' AND note = 'revenue'"
    assert repairs == [("revenue", "total_revenue"), ("GOOGL", "GOOG")]
    refused = ["DROP TABLE panel", "SELECT 1; DROP TABLE panel", "SELECT * FROM parquet.`/etc`", "WITH a AS (SELECT 1) DELETE FROM panel", "SELECT * FROM panel, secret", "SELECT * FROM panel, parquet.`/any/path`"]
    refused += ["SELECT * FROM panel CROSS JOIN/**/secret", "SELECT reflect('java.lang.System', 'getProperty', 'user.dir') FROM panel", "SELECT * FROM panel WHERE a IN (SELECT x FROM secret)", "SELECT (SELECT max(x) FROM secret) FROM panel"]
    refused += ["SELECT * FROM range(10)", "WITH a AS (SELECT * FROM secret) SELECT * FROM a", "SELECT * FROM panel WHERE EXISTS (SELECT 1 FROM secret)", "SELECT", "", "SELECT input_file_name() FROM panel", "SELECT * FROM other.panel", "CACHE TABLE panel", "SELECT * FROM VALUES (1) AS t(a) UNION SELECT x FROM secret"]
    for bad in refused:
        with pytest.raises(sqlsurface.Refused):
            sqlsurface.check(spark, bad, {"panel"})
    for good in ("SELECT created FROM panel WHERE a = 'DROP'", "WITH a AS (SELECT x FROM panel) SELECT p.x FROM a JOIN PANEL p ON a.x = p.x", "SELECT max(x) FROM (SELECT x FROM panel ORDER BY x LIMIT 3) q HAVING count(*) > 1"):
        sqlsurface.check(spark, good, {"panel"})
    frame = spark.createDataFrame([("A", 3.0)], "ticker string, total_revenue double")
    spark.range(1).createOrReplaceTempView("panel")
    assert sqlsurface.execute(spark, "SELECT sales FROM panel;", {"panel": frame}).first()[0] == 3.0
    assert sqlsurface.execute(spark, "SELECT panel.sales, '{x}' AS c FROM panel, panel b WHERE panel.sales IN (SELECT sales FROM panel)", {"panel": frame}).collect() == [(3.0, "{x}")]
    assert spark.table("panel").columns == ["id"]  # the caller's view is as it was
    spark.catalog.dropTempView("panel")
    assert sqlsurface.postprocess(spark, "SELECT sales FROM panel", {"panel"}) == ("SELECT sales FROM panel", "SELECT total_revenue FROM panel", ["sales -> total_revenue"], True, "")
    assert sqlsurface.postprocess(spark, "DROP TABLE panel", {"panel"})[3:] == (False, "Only SELECT statements allowed: DropTable, UnresolvedIdentifier")


def test_formatting_shapes_and_periods(spark):
    assert one(spark, sqlsurface.format_value(F.lit(1234567.0))) == "1,234,567"
    assert one(spark, sqlsurface.format_value(F.lit(0.25))) == "0.25"
    assert one(spark, sqlsurface.repair_period(F.lit("p = 'F2023' OR p LIKE 'F2022%'"))) == "p = 'FY2023' OR p LIKE 'FY2022%'"
    assert one(spark, sqlsurface.query_shape(F.lit("select a from b order by c limit 3"))) == "ranking"


def test_result_differences_are_multisets(spark):
    a = spark.createDataFrame([(1.00001, None), (1.00001, None)], "x double, y string")
    b = spark.createDataFrame([(1.00002, None)], "p double, q string")
    assert [r.only_in for r in sqlsurface.result_differences(a, b).collect()] == ["a"]


def test_trigrams_and_mmr(spark):
    assert one(spark, retrieval.trigram_jaccard(F.lit("ab"), F.lit("abc"))) == 0.0
    assert one(spark, retrieval.trigram_jaccard(F.lit("abcd"), F.lit("abc"))) == 0.5
    rows = spark.createDataFrame([(1, 1, "the same text here", 1.0), (1, 2, "the same text here", 0.9), (1, 3, "something else", 0.1)], "query_id long, chunk_id long, text string, relevance double")
    assert [r.chunk_id for r in retrieval.mmr_select(rows).orderBy("mmr_rank").collect()] == [1, 3]


def test_percentiles_take_the_floor_index(spark):
    rows = spark.createDataFrame([("a", float(v)) for v in (1, 3, 5, 9)] + [("a", None)], "g string, v double")
    assert evaluation.percentiles(rows, "g", "v", {"p50": 0.5, "p100": 1.0}).first()[1:] == (5.0, 9.0)
    assert evaluation.percentiles(rows, "g", "v", {"x": 0.5, "lo": 0.0, "hi": 1.0}).first().asDict() == {"g": rows.first().g, "x": 5.0, "lo": rows.agg(F.min("v")).first()[0], "hi": rows.agg(F.max("v")).first()[0]}


def test_smoothing_is_recursive(spark):
    got = one(spark, evaluation.smooth(F.array(*map(F.lit, (1.0, 2.0, 3.0)))))
    assert got == pytest.approx([1.0, 1.4, 0.6 * 1.4 + 0.4 * 3])


def test_names_stand_alone_unless_in_compat_mode(spark):
    asked = ["How do groups report artificial intelligence?", "Did Intel grow?", "ask upstream about metadata", "What is Bank of America's plan for 2023?"]
    d = spark.createDataFrame(list(enumerate(asked)), "k int, q string")
    got = [(r.w, r.c) for r in d.orderBy("k").select(retrieval.question_filters(F.col("q"))["ticker"].alias("w"), retrieval.question_filters(F.col("q"), mode="compat")["ticker"].alias("c")).collect()]
    assert got == [(None, "INTC"), ("INTC", "INTC"), (None, "META"), ("BAC", "BAC")]


def test_dense_top_k_in_blocks_matches_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    x = rng.integers(-2, 3, (300, 6)).astype(float)
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(900, None), (901, [float("nan")] * 6), (902, [1.0])]
    corpus = spark.createDataFrame(rows, "chunk_id long, vec array<double>").repartition(4)
    queries = corpus.where("chunk_id % 10 = 0 or chunk_id > 800").select(F.col("chunk_id").alias("query_id"), F.col("vec").alias("qvec"))
    unit = {k: v / np.linalg.norm(v) for k, v in enumerate(x) if np.linalg.norm(v) > 0}
    want = {k: sorted(unit, key=lambda c: (-round(float(unit[k] @ unit[c]), 6), c))[:7] for k in unit if k % 10 == 0}
    for block in (1000, 7):
        got = {}
        for r in retrieval.dense_top_k(queries, corpus, 7, decimals=6, block=block).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append(r.chunk_id)
        assert {k: v for k, v in got.items() if k < 800} == want


def test_hybrid_retrieval_selects_as_a_plain_loop_does(spark):
    """The registered query against greedy selection over its own candidates."""
    from quillstone.plans import registry

    sf = "/root/testdata/sf0.001"
    got = {}
    for r in registry.queries()["R11_R12_hybrid_mmr"](spark, sf).orderBy("query_id", "mmr_rank").collect():
        got.setdefault(r.query_id, []).append(r.chunk_id)
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    grams = lambda t: {t[i : i + 3] for i in range(len(t) - 2)}
    same = lambda a, b: len(a & b) / len(a | b) if a and b else 0.0
    candidates = {}
    for r in registry.queries()["R8_R12_filtered_candidates"](spark, sf).collect():
        candidates.setdefault(r.query_id, []).append((r.chunk_id, r.relevance, grams(text[r.chunk_id])))
    for q, left in candidates.items():
        chosen = []
        while left and len(chosen) < 3:
            value = lambda c: 0.7 * c[1] - 0.3 * max(same(c[2], o[2]) for o in chosen) if chosen else c[1]  # noqa: E731, B023
            fit = [c for c in left if all(same(c[2], o[2]) < 0.85 for o in chosen)]
            if not fit:
                break
            best = min(fit, key=lambda c: (-value(c), -c[1], c[0]))
            chosen.append(best)
            left.remove(best)
        assert got[q] == [c[0] for c in chosen]
