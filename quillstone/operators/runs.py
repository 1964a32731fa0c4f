"""Records of evaluation runs: scored sides, run tables, training logs, calibration samples, case generation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.operators import evaluation as ev

CASE = ["config", "category", "intent_correct", "value_correct", "keyword_hit_rate", "total_s"]


def scored_side(answer: Column, keywords: Column, expected: Column, decimals: int = 3) -> Column:
    """struct<answer, value_correct, keyword_hit_rate, fluency> of one side of a case; null where it gave no answer. The answer
    is cut to 300 characters after it is scored."""
    return F.when(
        answer.isNotNull(),
        F.struct(F.substring(answer, 1, 300).alias("answer"), ev.value_correct(answer, expected).alias("value_correct"), F.round(ev.keyword_hit_rate(answer, keywords), decimals).alias("keyword_hit_rate"), ev.fluency(answer).alias("fluency")),
    )


def failure_record(error: Column, answer: Column, scores: dict[str, Column]) -> list[Column]:
    """Columns of a scored answer where a case may have failed: then the answer is empty, the intent right, the value wrong, the
    fluency 1 and the other scores 0. Answers are cut to 300 characters."""
    failed = {"intent_correct": F.lit(True), "value_correct": F.lit(False), "fluency_score": F.lit(1)}
    kept = [F.when(error.isNotNull(), failed.get(n, F.lit(0.0))).otherwise(c).alias(n) for n, c in scores.items()]
    return [F.when(error.isNotNull(), "").otherwise(F.substring(answer, 1, 300)).alias("answer"), *kept, error.alias("error")]


def cases_of_side(runs: DataFrame, config: str, side: str, latency: str, sure_intent: bool = False) -> DataFrame:
    """Comparable cases out of records with a struct a side; a side that does no routing counts as right in intent."""
    s = F.col(side)
    intent = F.lit(True) if sure_intent else s["intent_correct"]
    return runs.select(F.lit(config).alias("config"), "category", intent.alias("intent_correct"), s["value_correct"].alias("value_correct"), s["keyword_hit_rate"].alias("keyword_hit_rate"), F.col(latency).alias("total_s"))


def cases_of_file(files: DataFrame, config: str) -> DataFrame:
    """Comparable cases out of records that hold an array of cases."""
    return files.select(F.explode("cases").alias("c")).select(F.lit(config).alias("config"), "c.category", "c.intent_correct", "c.value_correct", "c.keyword_hit_rate", F.col("c.timings.total_s").alias("total_s"))


def run_table(cases: DataFrame, weights: dict = ev.FINAL_WEIGHTS) -> DataFrame:
    """One row a configuration: cases, mean composite score, also by type, and latencies by floor index, to 4 and 3 decimals."""
    scored = cases.withColumn("type", ev.map_category(F.col("category"))).withColumn("score", ev.case_score(F.col("category"), F.col("intent_correct"), F.col("value_correct"), F.col("keyword_hit_rate"), weights=weights).cast("decimal(10,4)"))
    by_type = [F.round(F.avg(F.when(F.col("type") == t, F.col("score"))).cast("double"), 4).alias(t.lower()) for t in weights]
    total = scored.groupBy("config").agg(F.count("*").alias("n_cases"), F.round(F.avg("score").cast("double"), 4).alias("composite_score"), *by_type, F.round(F.avg(F.col("total_s").cast("decimal(20,6)")).cast("double"), 3).alias("latency_mean_s"))
    points = ev.percentiles(scored, "config", "total_s", {"p50": 0.5, "p95": 0.95})
    return total.join(points.select("config", F.round("p50", 3).alias("latency_p50_s"), F.round("p95", 3).alias("latency_p95_s")), "config", "left")


def sweep_table(sweeps: DataFrame) -> DataFrame:
    """One row a configuration of (config, concurrency, qps, latency_p50): the latency of single requests, and the peak rate with
    the smallest concurrency that reaches it."""
    peak = F.max_by(F.struct("qps", "concurrency"), F.struct("qps", (-F.col("concurrency")).alias("c")))
    return sweeps.groupBy("config").agg(F.min(F.when(F.col("concurrency") == 1, F.col("latency_p50"))).alias("single_req_p50"), peak.alias("p")).select("config", "single_req_p50", F.col("p.qps").alias("peak_qps"), F.col("p.concurrency").alias("peak_concurrency"))


def against_baseline(runs: DataFrame, sweeps: DataFrame, order: list[str], concurrency: int = 8) -> DataFrame:
    """The last run of each quantisation by ``order`` beside the sweep's row of the same one at ``concurrency``."""
    last = runs.groupBy("quant").agg(F.max_by(F.struct("qps", "latency_p50"), F.struct(*order)).alias("r")).select("quant", "r.*")
    base = sweeps.where(F.col("concurrency") == concurrency).groupBy("quant").agg(F.min("qps").alias("base_qps"), F.min("latency_p50").alias("base_p50"))
    return last.join(base, "quant", "left").withColumn("speedup", F.try_divide("qps", "base_qps"))


def score_table(base: DataFrame, tuned: DataFrame, metrics: list[str]) -> DataFrame:
    """(metric, base, tuned, delta): means in per cent; nulls count as 0."""
    mean = lambda d, name: d.agg(*((F.sum(F.coalesce(F.col(m).cast("double"), F.lit(0.0))) / F.count("*") * 100).alias(m) for m in metrics)).unpivot([], metrics, "metric", name)
    both = mean(base, "base").join(F.broadcast(mean(tuned, "tuned")), "metric")
    return both.withColumn("delta", F.col("tuned") - F.col("base"))


LOG = "log_history array<struct<step:bigint, epoch:double, loss:double, mean_token_accuracy:double, eval_loss:double, eval_mean_token_accuracy:double>>"


def training_log(states: DataFrame, json_col: str = "json") -> DataFrame:
    """(part, step, epoch, loss, accuracy) of a trainer's states: entries with an evaluation loss are 'eval', other entries with a
    loss 'train', with accuracy 0 where it is missing; others are left out."""
    e = states.select(F.explode(F.from_json(json_col, LOG)["log_history"]).alias("e")).select("e.*")
    part = F.when(F.col("eval_loss").isNotNull(), "eval").when(F.col("loss").isNotNull(), "train")
    accuracy = F.when(F.col("eval_loss").isNotNull(), F.col("eval_mean_token_accuracy")).otherwise(F.coalesce("mean_token_accuracy", F.lit(0.0)))
    return e.select(part.alias("part"), "step", "epoch", F.coalesce("eval_loss", "loss").alias("loss"), accuracy.alias("accuracy")).where("part is not null")


def calibration_sample(first: DataFrame, more: DataFrame, n: int, order: str = "id", text: str = "text", shortest: int = 50) -> DataFrame:
    """(position, text) for n positions: texts of ``first`` in order, then those of ``more`` of at least ``shortest`` characters,
    and all again from the start where these are too few; no rows if there are none."""
    one = first.select(F.lit(0).alias("source"), order, text)
    two = more.where(F.length(F.trim(text)) >= shortest).select(F.lit(1).alias("source"), order, text)
    few = one.orderBy(order).limit(n).union(two.orderBy(order).limit(n)).orderBy("source", order).limit(n)
    numbered = few.withColumn("k", F.row_number().over(Window.orderBy("source", order)) - 1)
    total = numbered.agg(F.count("*").alias("n"))
    repeated = numbered.crossJoin(F.broadcast(total)).withColumn("position", F.explode(F.sequence(F.col("k").cast("long"), F.lit(n - 1).cast("long"), F.greatest("n", F.lit(1)))))
    return repeated.select("position", text)


def filter_report(rows: DataFrame, keep: Column, changed: Column, group: str) -> DataFrame:
    """Rows before and after a filter, and of those kept how many a rewrite changed."""
    kept = F.coalesce(keep, F.lit(False))
    return rows.groupBy(group).agg(F.count("*").alias("total"), F.count_if(kept).alias("kept"), F.count_if(kept & changed).alias("fixed"), F.count_if(~kept).alias("discarded"))


def scalar(result: DataFrame) -> DataFrame:
    """The first cell of a result as a double in one row; null where there is no row or no number."""
    return result.limit(1).agg(F.first(F.col(f"`{result.columns[0]}`").cast("string")).try_cast("double").alias("value"))


def spot_check(panel: DataFrame, ticker: str, year: str) -> DataFrame:
    """(col, shown) of one row: numbers over a million without decimals and with separators, missing ones as NULL."""
    row = panel.where((F.col("ticker") == ticker) & (F.col("year") == year))
    numbers = [c for c, t in panel.dtypes if t == "double"]
    cells = row.select(*numbers).unpivot([], numbers, "col", "value")
    return cells.select("col", F.when(F.col("value").isNull(), "NULL").when(F.abs("value") > 1e6, F.format_number("value", 0)).otherwise(F.col("value").cast("string")).alias("shown"))


def with_cik(rows: DataFrame, registry: DataFrame) -> DataFrame:
    """``rows`` with the ten digits of their ticker's CIK, in any case of letters; a ticker that isn't registered fails the job
    and is named."""
    from quillstone.sources.filings import padded_cik

    known = registry.groupBy(F.upper("ticker").alias("__ticker")).agg(F.max("cik").alias("__cik"))
    joined = rows.join(known, F.upper("ticker") == F.col("__ticker"), "left")
    missing = F.raise_error(F.concat(F.lit("CIK not found for ticker "), F.coalesce("ticker", F.lit("NULL"))))
    return joined.withColumn("cik", F.when(F.col("__cik").isNotNull(), padded_cik(F.col("__cik"))).otherwise(missing)).drop("__ticker", "__cik")


def comparison_cases(panel: DataFrame, tickers: list[str], templates: list[tuple[str, str]]) -> DataFrame:
    """Questions on two companies of a stated short list, with their last common year, where both have the (column, template with
    {n1}, {n2} and {fy}); a question comes once."""
    p = panel.where(F.col("ticker").isin(tickers))
    columns = sorted({c for c, _ in templates})
    a, b = (p.select(F.col("ticker").alias(n), F.col("year").alias("fy"), F.struct(*columns).alias(f"v{n}")) for n in ("n1", "n2"))
    pairs = a.join(b, "fy").where("n1 < n2")
    last = pairs.groupBy("n1", "n2").agg(F.max_by(F.struct("fy", "vn1", "vn2"), "fy").alias("p")).select("n1", "n2", "p.*")

    def filled(t: str) -> Column:
        q = F.lit(t)
        for c in ("n1", "n2", "fy"):
            q = F.replace(q, F.lit(f"{{{c}}}"), F.col(c))
        return q

    made = F.array(*(F.struct(F.lit(c).alias("metric"), filled(t).alias("question"), (F.col("vn1")[c].isNotNull() & F.col("vn2")[c].isNotNull()).alias("both")) for c, t in templates))
    return last.select("n1", "n2", "fy", F.inline(made)).where("both").drop("both").dropDuplicates(["question"])


def compound_cases(panel: DataFrame, templates: list[tuple[list[str], str]], years: int = 2) -> DataFrame:
    """Questions on several columns of a company in its last years, where it has all of them; {name} and {fy} are filled in."""
    recent = Window.partitionBy("ticker").orderBy(F.desc("year"))
    rows = panel.withColumn("__n", F.row_number().over(recent)).where(F.col("__n") <= years)
    filled = lambda t: F.replace(F.replace(F.lit(t), F.lit("{name}"), F.col("ticker")), F.lit("{fy}"), F.col("year"))
    made = F.array(*(F.struct(filled(t).alias("question"), F.array(*(F.col(c).isNotNull() for c in cs)).alias("has")) for cs, t in templates))
    return rows.select("ticker", "year", F.inline(made)).where(F.forall("has", lambda x: x)).drop("has").dropDuplicates(["question"])


def named_tickers(statements: DataFrame, sql_col: str = "sql", top: int = 10) -> DataFrame:
    """The tickers that statements compare with, the ``top`` most frequent (ties: the ticker)."""
    found = statements.select(F.explode(F.regexp_extract_all(sql_col, F.lit(r"(?i)ticker\s*=\s*'(\w[\w-]*)'"), F.lit(1))).alias("ticker"))
    return found.groupBy("ticker").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "ticker").limit(top)


def question_pairs(panel: DataFrame, templates: list[tuple[str, str, str]], share: float = 1.0, seed: str = "pairs") -> DataFrame:
    """(question, sql) pairs: templates (name, question, sql) with {ticker} and {year} over the rows of a panel. A pair is taken by
    the hash of its question, so the same ones are at any partitioning."""
    filled = lambda t: F.replace(F.replace(F.lit(t), F.lit("{ticker}"), F.col("ticker")), F.lit("{year}"), F.col("year"))
    made = F.array(*(F.struct(F.lit(n).alias("template"), filled(q).alias("question"), filled(s).alias("sql")) for n, q, s in templates))
    part = F.conv(F.substring(F.md5(F.concat(F.lit(seed), "question")), 1, 8), 16, 10).cast("long")
    return panel.select("ticker", "year", F.inline(made)).where(part < int(share * (1 << 32)))


def long_form(sql: Column, columns: dict[str, str]) -> Column:
    """A single-column statement on the wide panel as one on the long facts: the column becomes ``value`` under a condition on its
    metric, ``year`` the period; a statement of another form is null."""
    shape = r"(?is)^\s*SELECT\s+(\w+)\s+FROM\s+panel\s+WHERE\s+(.*)$"
    column, rest = F.lower(F.regexp_extract(sql, shape, 1)), F.regexp_extract(sql, shape, 2)
    metric = F.get(F.filter(F.array(*(F.struct(F.lit(c).alias("c"), F.lit(m).alias("m")) for c, m in columns.items())), lambda p: p["c"] == column), F.lit(0))["m"]
    period = F.regexp_replace(rest, r"(?i)\byear\b", "period")
    return F.when(metric.isNotNull(), F.concat(F.lit("SELECT value FROM financials WHERE metric = '"), metric, F.lit("' AND "), period))
