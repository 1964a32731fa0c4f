"""Registered queries over question and SQL pairs, scores of answers, stores, and plain relational patterns."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillstone.operators import dataset, metrics, panel, retrieval, store, text
from quillstone.operators import evaluation as ev
from quillstone.plans.domain import CASES, FILINGS, PANEL, facts, frame
from quillstone.plans.registry import CA, FA, FI, P, _surface, query
from quillstone.sources import tables


def _documents(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet")


def _conversations(spark, d):
    return spark.read.parquet(f"{d}/conversations.parquet")


# Relational patterns through the surface.
for _name, _sql in (
    ("Q5_not_null_guard", "SELECT ticker, year, net_margin FROM panel WHERE net_margin IS NOT NULL AND total_liabilities IS NOT NULL"),
    ("J1_year_over_year", "SELECT a.ticker, a.total_assets AS now, b.total_assets AS before FROM panel a JOIN panel b ON a.ticker = b.ticker WHERE a.year = 'FY1998' AND b.year = 'FY1996'"),
    ("A2_filtered_count", "SELECT count(*) AS n FROM filing_metadata WHERE filing_type = '10-K' AND date >= '1996-01-01'"),
    ("A6_modal_form", "SELECT ticker, filing_type FROM (SELECT ticker, filing_type, row_number() OVER (PARTITION BY ticker ORDER BY count(*) DESC, filing_type) AS n FROM filing_metadata GROUP BY ticker, filing_type) q WHERE n = 1"),
    ("L3_order_by_subquery", "SELECT p.ticker, p.total_revenue FROM panel p JOIN (SELECT ticker, max(net_income) AS best FROM panel GROUP BY ticker) b ON p.ticker = b.ticker WHERE p.year = 'FY1997' ORDER BY b.best DESC, p.ticker LIMIT 5"),
    ("U5_execute_raw", "SELECT ticker, statement, count(*) AS n FROM financials WHERE value > 100000 GROUP BY ticker, statement"),
):
    _surface(_name, _sql, _sql)


@query(f"WITH p AS {P} SELECT t.ticker, y.year, p.total_revenue FROM (SELECT DISTINCT ticker FROM p) t CROSS JOIN (SELECT DISTINCT year FROM p) y LEFT JOIN p ON p.ticker = t.ticker AND p.year = y.year")
def J3_J4_full_grid(spark, d):
    rows = frame(spark, d, PANEL).select("ticker", F.col("year").alias("period"), "total_revenue")
    return panel.densify(rows).select("ticker", F.col("period").alias("year"), "total_revenue")


@query("SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def J6_membership(spark, d):
    good = spark.read.parquet(f"{d}/labels.parquet").where("quality = 1").select("doc_id")
    return _documents(spark, d).select("doc_id", "source").join(good, "doc_id", "left_semi")


@query("SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def J7_not_stored(spark, d):
    return _documents(spark, d).select("doc_id", "source").join(spark.read.parquet(f"{d}/labels.parquet").select("doc_id"), "doc_id", "left_anti")


@query("SELECT d.doc_id, d.lang, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def J9_lookup(spark, d):
    return _documents(spark, d).select("doc_id", "lang").join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id", "left")


@query(f"WITH f AS {FA}, r AS (SELECT *, row_number() OVER (PARTITION BY ticker, metric ORDER BY value DESC, period) AS n FROM f) SELECT ticker, metric, period, value FROM r WHERE n = 1")
def W1_rank_then_first(spark, d):
    return store.latest_per_key(facts(spark, d), ["ticker", "metric"], [F.desc("value"), "period"]).select("ticker", "metric", "period", "value")


@query("SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) - 1 AS index FROM conversations")
def W4_renumbered(spark, d):
    w = Window.partitionBy("conv_id", "role").orderBy("turn")
    return _conversations(spark, d).select("conv_id", "turn", (F.row_number().over(w) - 1).cast("bigint").alias("index"))


@query("SELECT item_id AS id, 'benchmark' AS origin FROM benchmark UNION ALL SELECT doc_id AS id, 'documents' AS origin FROM documents")
def X1_bag_union(spark, d):
    a = spark.read.parquet(f"{d}/benchmark.parquet").select(F.col("item_id").alias("id"), F.lit("benchmark").alias("origin"))
    return a.unionByName(_documents(spark, d).select(F.col("doc_id").alias("id"), F.lit("documents").alias("origin")))


# Metric names.
@query(f"SELECT f.period, count(DISTINCT ticker) AS tickers, count(DISTINCT ticker) / (SELECT count(DISTINCT ticker) FROM {FA} g) AS share FROM {FA} f WHERE value IS NOT NULL GROUP BY 1")
def A7_M3_ticker_share(spark, d):
    f = facts(spark, d)
    everyone = F.broadcast(f.agg(F.countDistinct("ticker").alias("everyone")))  # one row
    share = (F.col("tickers") / F.col("everyone")).alias("share")
    return f.where("value is not null").groupBy("period").agg(F.countDistinct("ticker").alias("tickers")).crossJoin(everyone).select("period", "tickers", share)


@query(f"SELECT DISTINCT metric, array_to_string(list_transform(list_distinct_in_order, lambda w: upper(w[1]) || w[2:]), ' ') AS name FROM (SELECT metric, list_filter(string_split(lower(metric), ' '), lambda w, i: list_position(string_split(lower(metric), ' '), w) = i) AS list_distinct_in_order FROM {FA} f) q")
def M2_display_name(spark, d):
    return facts(spark, d).select("metric", metrics.display_name(F.lower("metric")).alias("name")).distinct()


# Question and SQL pairs made from the panel; years are moved to 20xx and tickers to capitals.
PAIRS = f"""
SELECT p.ticker, p.year, concat('What was the revenue of ', p.t, ' in ', p.y, '?') AS question,
  concat('SELECT total_revenue FROM panel WHERE ticker = ', chr(39), p.t, chr(39), ' AND year = ', chr(39), 'FY', p.y, chr(39)) AS expected,
  CASE p.kind WHEN 0 THEN concat('select  total_revenue from panel where ticker = ', chr(39), p.t, chr(39), ' and year = ', chr(39), 'FY', p.y, chr(39), ' ;;')
    WHEN 1 THEN concat('SELECT value FROM financials WHERE ticker = ', chr(39), p.t, chr(39))
    WHEN 2 THEN concat('SELECT a.foo, b.bar, c.baz FROM panel WHERE year = ', chr(39), p.y, chr(39))
    WHEN 3 THEN 'DROP TABLE panel' ELSE concat('SELECT net_income FROM other JOIN filing_metadata USING (ticker) -- FY', p.y) END AS predicted
FROM (SELECT q.ticker, q.year, translate(q.ticker, '0123456789', 'ABCDEFGHIJ') AS t, CAST(CAST(substr(q.year, 3, 4) AS INT) + 20 AS STRING) AS y,
  (CAST(substr(q.year, 3, 4) AS INT) + length(q.ticker)) % 5 AS kind FROM ({PANEL}) q) p
"""
_SCORED_COLUMNS = [c for c in dataset.COLUMNS["panel"] if c not in ("ticker", "year")]


#: DuckDB's word boundaries know ASCII letters alone, so accented ones become x in its patterns.
_LATIN = r"regexp_replace({0}, '[\x{{C0}}-\x{{24F}}]', 'x', 'g')"


def _sql_list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


_IN = r"list_distinct(regexp_extract_all(lower(predicted), '\b(?:from|join)\s+(\w+)', 1))"
_NORM = r"lower(regexp_replace(trim(regexp_replace(regexp_replace({0}, '--[^\n]*', '', 'g'), '\s+', ' ', 'g')), ';+$', ''))"


@query(rf"""WITH p AS ({PAIRS}), x AS (SELECT *, regexp_extract_all(question, '\b(20\d{{2}})\b', 1) AS ys, regexp_extract_all(question, '\b([A-Z]{{2,5}})\b', 1) AS ts, {_IN} AS tabs,
regexp_extract_all(lower(regexp_replace(predicted, '''[^'']*''', ' ', 'g')), '\b(\w+)\b', 1) AS words FROM p)
SELECT ticker, year, regexp_matches(upper(predicted), '^\s*SELECT\b.*\bFROM\b')::INT AS valid_sql,
(list_has_any(tabs, ['panel', 'filing_metadata']) AND NOT regexp_matches(upper(predicted), '\bFROM\s+FINANCIALS\b'))::INT AS correct_table,
list_has_any(words, {_sql_list(_SCORED_COLUMNS)})::INT AS correct_column, contains(upper(predicted), 'FY' || ys[1])::INT AS period_format,
(len(list_filter(ts, lambda t: NOT contains(upper(predicted), t))) = 0 AND contains(predicted, ys[1]))::INT AS keyword_match,
({_NORM.format('predicted')} = {_NORM.format('expected')})::INT AS exact_match FROM x""")
def N13_sql_scores(spark, d):
    scores = dataset.score_sql(F.col("predicted"), F.col("expected"), F.col("question"), ["panel", "filing_metadata"], _SCORED_COLUMNS)
    return frame(spark, d, PAIRS).select("ticker", "year", *(c.alias(n) for n, c in scores.items()))


_PASSED = [*dataset.COLUMNS, *dataset.SQL_WORDS, *dataset.PASSED_OVER]
_STRANGE = " AND ".join(f"NOT (list_contains(tabs, '{t}') AND len(list_filter(words, lambda w: NOT list_contains({_sql_list([*c, *_PASSED])}, w))) > 2)" for t, c in dataset.COLUMNS.items())


@query(rf"""WITH p AS ({PAIRS}), x AS (SELECT *, {_IN} AS tabs, list_distinct(regexp_extract_all(lower(predicted), '\b([a-z_][a-z0-9_]*)\b', 1)) AS words FROM p)
SELECT ticker, year, len(list_filter(tabs, lambda t: NOT list_contains({_sql_list(dataset.COLUMNS)}, t))) = 0 AND {_STRANGE} AS ok FROM x""")
def N7_schema_check(spark, d):
    return frame(spark, d, PAIRS).select("ticker", "year", dataset.schema_ok(F.col("predicted")).alias("ok"))


@query(f"SELECT ticker, year, starts_with(upper(predicted), 'SELECT') AND contains(upper(predicted), 'FROM') AS ok FROM ({PAIRS}) p")
def N16_pair_filter(spark, d):
    return frame(spark, d, PAIRS).select("ticker", "year", dataset.pair_ok(F.col("predicted")).alias("ok"))


@query(f"""SELECT ticker, year, 'system' AS first_role, question AS user_text, regexp_replace(trim(predicted), ';+$', '') || ';<end>' AS completion FROM ({PAIRS}) p""")
def Y11_Y12_chat_pairs(spark, d):
    rows = frame(spark, d, PAIRS).withColumn("messages", dataset.chat_example("Answer with SQL.", F.col("question"), F.col("predicted")))
    parts = dataset.prompt_and_completion(F.col("messages"), "<end>")
    return rows.select("ticker", "year", parts["prompt"][0]["role"].alias("first_role"), parts["prompt"][1]["content"].alias("user_text"), parts["completion"].alias("completion"))


_KNOWN = rf"regexp_matches(text, '\b({'|'.join(dataset.DOMAIN_TICKERS)})\b') OR regexp_matches(lower(text), '{'|'.join((*dataset.DOMAIN_COMPANIES, *dataset.TERMS))}') OR regexp_matches(text, '\bFY20\d{{2}}\b')"


@query(f"SELECT doc_id, NOT regexp_matches(lower(text), '{'|'.join(dataset.NOISE)}') AND ({_KNOWN}) AS ok FROM (SELECT doc_id, {_LATIN.format('text')} AS text FROM documents) d WHERE text IS NOT NULL")
def N10_domain_filter(spark, d):
    return _documents(spark, d).where("text is not null").select("doc_id", dataset.is_domain_question(F.col("text")).alias("ok"))


_RAW = """SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN concat('[" ', lang, '", "', source, '", " "]') WHEN 1 THEN concat('Sure: ["', source, '"], ["x"]') WHEN 2 THEN lang
WHEN 3 THEN '[1, "a"]' ELSE concat('{"k": ["', lang, '"]}') END AS raw FROM documents"""


@query("SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN lang || '|' || source WHEN 1 THEN source WHEN 4 THEN lang END AS items FROM documents")
def N15_text_lists(spark, d):
    return frame(spark, d, _RAW).select("doc_id", F.array_join(dataset.text_list(F.col("raw")), "|").alias("items"))


# Scores.
@query("SELECT event_type, CASE WHEN count(lp) >= 2 THEN round(exp(-(sum(lp) / count(lp))), 3) END AS perplexity FROM (SELECT event_type, user_id, CAST(-value / 20 AS DECIMAL(20,9)) AS lp FROM events WHERE user_id % 4 <> 0) e GROUP BY 1")
def A14_perplexity(spark, d):
    tokens = spark.read.parquet(f"{d}/events.parquet").withColumn("lp", -F.col("value") / 20)
    return ev.perplexity(tokens, ["event_type"], "lp", F.col("user_id") % 4 != 0)


_BURST = """WITH e AS (SELECT event_type, event_type <> 'error' OR user_id % 2 = 0 AS ok, value, ts FROM events), g AS (SELECT event_type, count(*) AS total_requests, count(*) FILTER (NOT ok) AS errors,
(epoch_us(max(ts)) // 1000000 - epoch_us(min(ts)) // 1000000) AS wall, coalesce(list_sort(list(value) FILTER (ok)), []) AS l, sum(CAST(value AS DECIMAL(20,6))) FILTER (ok) AS s FROM e GROUP BY 1)
SELECT event_type, total_requests, errors, round(wall::DOUBLE, 3) AS wall_time_s, round(({n}) / wall, 3) AS qps, round((s / len(l))::DOUBLE, 3) AS latency_mean, round(l[1], 3) AS latency_min, round(l[-1], 3) AS latency_max,
round(l[CAST(floor(len(l) * 0.5) AS INT) + 1], 3) AS latency_p50, round(l[least(CAST(floor(len(l) * 0.95) AS INT), len(l) - 1) + 1], 3) AS latency_p95 FROM g"""


def _burst(spark, d, only_good):
    e = spark.read.parquet(f"{d}/events.parquet")
    seconds = F.unix_seconds(F.col("ts").cast("timestamp"))
    wall = (F.max(seconds) - F.min(seconds)).cast("double")
    return ev.burst(e, "event_type", "value", (F.col("event_type") != "error") | (F.col("user_id") % 2 == 0), wall, only_good)


@query(_BURST.format(n="total_requests"))
def E11_Y7_burst(spark, d):
    return _burst(spark, d, False)


@query(_BURST.format(n="total_requests - errors"))
def Y5_burst_of_good(spark, d):
    return _burst(spark, d, True)


@query("""SELECT doc_id, concat('Quality of ', source, '? Answer: ', lang, CASE WHEN quality IS NULL THEN '' ELSE ', ' || CASE WHEN quality = 0 THEN '25.0%' WHEN n_chars % 2 = 0 THEN '$2.5 billion' ELSE '12.5' END END) AS reference
FROM documents LEFT JOIN labels USING (doc_id)""")
def E5_references(spark, d):
    j = _documents(spark, d).select("doc_id", "source", "lang", "n_chars").join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id", "left")
    value = F.when(F.col("quality") == 0, 0.25).when(F.col("quality").isNotNull(), F.when(F.col("n_chars") % 2 == 0, 2.5e9).otherwise(12.5))
    return j.select("doc_id", ev.build_reference(F.concat(F.lit("Quality of "), F.col("source"), F.lit("?")), F.array("lang"), value).alias("reference"))


@query("SELECT vec_id, round(greatest(list_dot_product(v, list_reverse(v)), list_dot_product(v, list_transform(v, lambda x: -x)), 0), 6) AS similarity FROM (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings) e")
def E6_best_similarity(spark, d):
    v = F.col("embedding").cast("array<double>")
    refs = F.array(F.reverse(v), F.transform(v, lambda x: -x))
    return spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", F.round(ev.best_similarity(v, refs), 6).alias("similarity"))


@query(f"""WITH c AS (SELECT *, CASE WHEN contains(category, 'Type3') THEN 'Type3' WHEN contains(category, 'Type2') AND NOT contains(category, 'Type1') THEN 'Type2' ELSE 'Type1' END AS type FROM {CA} c)
SELECT coalesce(type, 'all') AS type, count(*) AS n, round(avg(value_correct), 4) AS value_accuracy, round(avg(intent_correct), 4) AS intent_accuracy, round(avg(latency), 4) AS latency_mean FROM c GROUP BY ROLLUP (type)""")
def A10_E9_aggregate(spark, d):
    return ev.aggregate_scores(frame(spark, d, CASES), "category", {"value_accuracy": "value_correct", "intent_accuracy": "intent_correct", "latency_mean": "latency"})


@query(f"SELECT category, count(*) AS n, count(*) FILTER (value_correct = 0) AS value_fails, count(*) FILTER (intent_correct = 0) AS intent_fails, round(avg(value_correct), 3) AS value, round(avg(intent_correct), 3) AS intent, round(avg(nullif(latency % 7, 0)), 3) AS latency FROM {CA} c GROUP BY 1")
def Y3_category_summary(spark, d):
    cases = frame(spark, d, CASES).withColumn("latency", F.col("latency") % 7)
    return ev.category_summary(cases, "category", {"value": "value_correct", "intent": "intent_correct"}, {"latency": "latency"})


_TEMPLATES = [("total_revenue", "What was {name}'s total revenue in {fy}?"), ("net_income", "How much profit did {name} earn in {fy}?"), ("total_assets", "What were {name}'s total assets in {fy}?")]


@query(f"""WITH p AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY year DESC) AS n FROM {P} p), r AS (SELECT * FROM p WHERE n <= 3),
q AS (SELECT ticker, concat('What was ', ticker, '''s total revenue in ', year, '?') AS question, total_revenue AS v FROM r UNION ALL SELECT ticker, concat('How much profit did ', ticker, ' earn in ', year, '?'), net_income FROM r
UNION ALL SELECT ticker, concat('What were ', ticker, '''s total assets in ', year, '?'), total_assets FROM r)
SELECT question, v AS expected_value, lower(ticker) || CASE WHEN abs(v) >= 1e9 THEN '|' || round_even(v / 1e9, 0)::BIGINT WHEN abs(v) >= 1e6 THEN '|' || round_even(v / 1e6, 0)::BIGINT ELSE '' END AS keywords FROM q WHERE abs(v) <= 1e13""")
def E12_point_cases(spark, d):
    return ev.point_cases(frame(spark, d, PANEL), _TEMPLATES).select("question", "expected_value", F.array_join("keywords", "|").alias("keywords"))


@query(f"""WITH w AS (SELECT ticker, year, total_revenue AS v, lead(year) OVER o AS year2, lead(total_revenue) OVER o AS v2 FROM {P} p WINDOW o AS (PARTITION BY ticker ORDER BY year))
SELECT ticker, concat('How did ', ticker, '''s revenue change from ', year, ' to ', year2, '?') AS question, v2 - v AS change FROM w WHERE v IS NOT NULL AND v2 IS NOT NULL""")
def E12_change_cases(spark, d):
    return ev.change_cases(frame(spark, d, PANEL), "total_revenue", "How did {name}'s revenue change from {fy1} to {fy2}?")


_ASKED = "SELECT conv_id, turn, concat(CASE turn % 4 WHEN 0 THEN 'What is ' WHEN 1 THEN 'Define ' WHEN 2 THEN 'What is Apple ' ELSE '' END, text) AS q FROM conversations"


@query(f"""SELECT conv_id, turn, CASE WHEN regexp_matches(q, '(?i)^\\s*({ev._TALK.replace("'", "''")})\\b') OR regexp_matches(q, '(?i)^\\s*what is \\b') AND NOT regexp_matches(q, '(?i)^\\s*what is ({ev._NAMED})') THEN 'Type3'
WHEN regexp_matches(q, '(?i)\\b({ev._FIGURES})\\b') THEN 'Type1' ELSE 'Type2' END AS intent FROM (SELECT conv_id, turn, {_LATIN.format('q')} AS q FROM ({_ASKED}) a) c""")
def E13_intent(spark, d):
    q = F.col("q")
    return frame(spark, d, _ASKED).select("conv_id", "turn", F.coalesce(ev.fast_intent(q), ev.fallback_intent(q)).alias("intent"))


# Retrieval, extraction, store.
@query(r"""WITH p AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, turn, role, text FROM conversations)
SELECT conv_id AS query_id, string_agg('[' || n || '] Source: ' || CASE WHEN turn = 0 THEN '?' ELSE role END || ' turn ' || turn || E'\n' || coalesce(text, ''), E'\n\n' ORDER BY n) AS context FROM p WHERE n <= 3 GROUP BY 1""")
def R15_context(spark, d):
    top = _conversations(spark, d).withColumn("n", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))).where("n <= 3")
    ticker = F.when(F.col("turn") != 0, F.col("role")).alias("ticker")
    chunks = top.select(F.col("conv_id").alias("query_id"), F.col("turn").alias("chunk_id"), F.col("n").alias("rank"), ticker, F.lit("turn").alias("filing_type"), F.col("turn").cast("string").alias("date"), "text")
    return retrieval.context_block(chunks)


@query("SELECT page_id, CASE WHEN ends_with(lower(u), '.pdf') THEN 'pdf' WHEN regexp_matches(lower(u), '\\.html?$') THEN 'html' ELSE 'html?' END AS kind FROM (SELECT page_id, concat(url, CASE page_id % 3 WHEN 0 THEN '.PDF' WHEN 1 THEN '.htm' ELSE '' END) AS u FROM pages) p")
def T7_extractor_kind(spark, d):
    named = F.concat("url", F.when(F.col("page_id") % 3 == 0, ".PDF").when(F.col("page_id") % 3 == 1, ".htm").otherwise(""))
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", text.extractor_kind(named).alias("kind"))


@query(f"SELECT accession_number, CASE WHEN date >= '1997-01-01' THEN '10-K/A' ELSE filing_type END AS filing_type, 0 AS section_count, CASE WHEN date >= '1997-01-01' THEN 3 ELSE 0 END AS chunk_count, 0 AS sql_row_count FROM {FI} f")
def U6_upsert_filings(spark, d):
    old = frame(spark, d, FILINGS).withColumn("seq", F.lit(0))
    new = old.where("date >= '1997-01-01'").withColumns({"filing_type": F.lit("10-K/A"), "chunk_count": F.lit(3), "seq": F.lit(1)})
    return store.upsert_filings(old, new, ["seq"]).select("accession_number", "filing_type", "section_count", "chunk_count", "sql_row_count")


# Files of rows: written to the shared folder and read back.
_FACT_ROW = "ticker string, period string, statement string, metric string, value double, unit string"


@query(f"SELECT ticker, period, metric, value FROM {FA} f")
def S11_json_lines(spark, d):
    at = tables.work_folder(spark, "facts-json")
    tables.write_json_lines(facts(spark, d), at)
    return tables.read_json_lines(spark, at, _FACT_ROW).select("ticker", "period", "metric", "value")


@query(f"SELECT ticker, year, total_revenue, net_income, net_margin FROM {P} p")
def S13_csv(spark, d):
    at = tables.work_folder(spark, "panel-csv")
    tables.write_csv(frame(spark, d, PANEL).select("ticker", "year", "total_revenue", "net_income", "net_margin"), at)
    return tables.read_csv(spark, at, "ticker string, year string, total_revenue double, net_income double, net_margin double")


@query(f"SELECT 0 AS position, 'ticker' AS name, 'string' AS type, count(*) AS n_values FROM {P} p UNION ALL SELECT 1, 'year', 'string', count(*) FROM {P} p UNION ALL SELECT 2, 'net_margin', 'double', count(net_margin) FROM {P} p")
def S14_S16_replace_and_describe(spark, d):
    at = tables.work_folder(spark, "panel")
    rows = frame(spark, d, PANEL).select("ticker", "year", "net_margin")
    tables.replace_table(rows.limit(1), at)  # the old contents that the table loses
    tables.replace_table(rows, at)
    return tables.describe(spark.read.parquet(at))
