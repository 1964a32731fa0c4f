"""What a model is asked for reference answers: prompts by kind of case, the context they are grounded in, batches of open work,
and spot checks of panel rows."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quillstone.operators.evaluation import map_category
from quillstone.operators.retrieval import dense_top_k
from quillstone.operators.store import hash_split


def _amount(v: float) -> str:
    if v < 0:
        return f"-${-v / 1e9:.3f}B (net loss)" if -v >= 1e9 else f"-${-v:,.0f}"
    for size, decimals, unit in ((1e12, 3, "T"), (1e9, 3, "B"), (1e6, 1, "M")):
        if v >= size:
            return f"${v / size:.{decimals}f}{unit}"
    return f"{v * 100:.2f}%" if v < 1 else f"${v:,.2f}"


# Spark's own formats round a double's shortest decimal form (18.755), Python's the double (18.75499...).
@F.pandas_udf(StringType())
def _amounts(values: pd.Series) -> pd.Series:
    return values.map(lambda v: "" if pd.isna(v) else _amount(v)).astype(object)


@F.pandas_udf(StringType())
def _cells(values: pd.Series) -> pd.Series:
    return values.map(lambda v: "NULL" if pd.isna(v) else f"{v:,.0f}" if abs(v) > 1e6 else f"{v:.4f}").astype(object)


def shown_amount(value: Column) -> Column:
    """An amount as an answer shows it: T, B and M from a trillion, billion and million on, shares below one in percent, losses
    with their sign. Null and NaN are empty. The double itself is rounded, and halves to even."""
    return _amounts(value)


def cited_contexts(queries: DataFrame, corpus: DataFrame, n: int = 5, chars: int = 600, decimals: int = 9) -> DataFrame:
    """(query_id, context): the first ``chars`` characters of the n nearest chunks of each (query_id, qvec), each below its
    source. ``corpus`` has chunk_id, vec, text, company, filing_type and date; a chunk without text is no context."""
    top = dense_top_k(queries, corpus.where("text is not null").select("chunk_id", "vec"), n, decimals)
    source = F.trim(F.concat_ws(" ", *(F.coalesce(c, F.lit("")) for c in ("company", "filing_type", "date"))))
    parts = corpus.select("chunk_id", F.concat(F.lit("["), source, F.lit("]\n"), F.substring("text", 1, chars)).alias("part"))
    cited = top.join(parts, "chunk_id").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "part"))).alias("parts"))  # n of a query
    return cited.select("query_id", F.array_join(F.transform("parts", lambda p: p["part"]), "\n\n---\n\n").alias("context"))


def reference_prompts(cases: DataFrame, contexts: DataFrame | None = None) -> DataFrame:
    """(id, kind, year, key_word, prom_answer, prompt) of cases (id, category, question, expected_value, keywords).

    Figures (Type1) are asked with their exact value, or with what is to be named where there is none; texts (Type2) from their
    context in ``contexts`` (query_id, context), or freely where there is none; Type3 as chat. ``year`` is the first FY and four
    digits of the question; null questions are empty and null keywords none.
    """
    joined = cases.withColumn("context", F.lit(None).cast("string")) if contexts is None else cases.join(contexts.withColumnRenamed("query_id", "id"), "id", "left")
    question, words = F.coalesce("question", F.lit("")), F.coalesce("keywords", F.array().cast("array<string>"))
    kind, first = map_category(F.col("category")), lambda k: F.array_join(F.slice(words, 1, k), ", ")
    valued = F.col("expected_value").isNotNull() & ~F.isnan("expected_value")
    amount, grounded = shown_amount(F.col("expected_value")), F.col("context").isNotNull()
    text = lambda *parts: F.concat(F.lit("Question: "), question, *(p if isinstance(p, Column) else F.lit(p) for p in parts))
    every = F.array_join(words, ", ")
    exact = F.coalesce(F.col("expected_value").try_cast("decimal(30,4)").cast("string"), F.col("expected_value").cast("string"))
    prompt = (
        F.when((kind == "Type1") & valued, text("\nAnswer: ", amount, " (", exact, ")", "\nMention: ", first(3), "\n\nWrite three full sentences that answer it, each with this very number."))
        .when(kind == "Type1", text("\nMention: ", every, "\n\nWrite three full sentences with the companies, values or ranks that are asked for."))
        .when((kind == "Type2") & grounded, text("\n\nContext:\n", F.col("context"), "\n\nMention: ", every, "\n\nWrite three answers of two to four sentences from this context alone; say so where it isn't enough."))
        .when(kind == "Type2", text("\nMention: ", every, "\n\nWrite three answers of two to four sentences."))
        .otherwise(text("\nMention where it fits: ", every, "\n\nWrite three short replies of an assistant."))
    )
    key = F.when((kind == "Type1") & valued, first(1)).when(kind == "Type1", first(3)).when(kind == "Type2", first(4)).otherwise(every)
    year = F.when(kind != "Type3", F.regexp_extract(question, r"FY\d{4}", 0))
    return joined.select("id", kind.alias("kind"), year.alias("year"), key.alias("key_word"), F.when((kind == "Type1") & valued, amount).alias("prom_answer"), prompt.alias("prompt"))


def next_batch(open_: DataFrame, done: DataFrame, key: str, n: int, share: float) -> DataFrame:
    """The first n rows of ``open_`` by key that ``done`` doesn't have, and whether each is for training: about a ``share`` of all
    keys is, the same ones in every batch. Rows with a null key are left out."""
    left = open_.where(F.col(key).isNotNull()).join(done.select(key), key, "left_anti")
    return left.orderBy(key).limit(n).withColumn("train", hash_split(F.col(key), share))


def spot_checks(panel: DataFrame, wanted: DataFrame) -> DataFrame:
    """(ticker, year, col, shown): all numbers of the panel rows that ``wanted`` (ticker, year) names: over a million without
    decimals and with separators, others with four decimals, missing ones as NULL."""
    numbers = [c for c, t in panel.dtypes if t == "double"]
    cells = panel.join(wanted.select("ticker", "year").distinct(), ["ticker", "year"], "left_semi").select("ticker", "year", *numbers).unpivot(["ticker", "year"], numbers, "col", "value")
    return cells.select("ticker", "year", "col", _cells("value").alias("shown"))
