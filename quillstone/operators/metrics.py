"""Metric frequency over companies: key normalisation, the 0/1 matrix, the canonical set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.operators.sizes import broadcast_if_small

# Words that don't tell one metric from another.
FILLERS = (
    "net", "total", "less", "add", "plus", "gross", "consolidated", "and", "of", "the", "in", "for", "from", "attributable", "continuing", "operations", "per",
    "share", "diluted", "basic", "weighted", "average",
)


def metric_key(label: Column) -> Column:
    """Lower case, letters only, no fillers, no one-letter words, sorted; repeated words stay."""
    letters = F.regexp_replace(F.lower(label), r"[^a-z\s]", " ")
    words = F.filter(F.split(letters, r"\s+"), lambda w: (F.length(w) > 1) & ~w.isin(*FILLERS))
    return F.array_join(F.array_sort(words), " ")


def display_name(key: Column) -> Column:
    return F.initcap(F.array_join(F.array_distinct(F.split(key, " ")), " "))


def registered(facts: DataFrame) -> DataFrame:
    """Facts that count: with a value and a key of 4 letters or more."""
    return facts.withColumn("key", metric_key(F.col("metric"))).where("value is not null and length(key) >= 4")


def frequency_matrix(facts: DataFrame) -> DataFrame:
    """The 0/1 matrix in long form, one row a 1: (key, ticker), so that its width is not bounded by columns."""
    return registered(facts).select("key", "ticker").distinct()


def canonical_metrics(facts: DataFrame, threshold: float) -> DataFrame:
    """Keys that at least ``threshold`` of all companies report, with the most frequent statement (ties: its name)."""
    everyone = facts.agg(F.countDistinct("ticker").alias("n_tickers"))
    rows = registered(facts)
    modal = rows.groupBy("key", "statement").agg(F.count("*").alias("n")).groupBy("key").agg(F.min_by("statement", F.struct((-F.col("n")).alias("n"), "statement")).alias("statement"))
    found = rows.groupBy("key").agg(F.countDistinct("ticker").alias("ticker_count")).crossJoin(F.broadcast(everyone))
    found = found.where(F.col("ticker_count") / F.col("n_tickers") >= threshold).join(modal, "key")
    pct = (F.col("ticker_count") / F.col("n_tickers")).alias("ticker_pct")
    return found.select(F.col("key").alias("metric"), "statement", "ticker_count", pct, display_name(F.col("key")).alias("canonical_name"))


def metric_summary(canonical: DataFrame) -> DataFrame:
    """The table of canonical metrics as shown: shares in per cent with one decimal."""
    return canonical.select("metric", "statement", "ticker_count", F.format_string("%.1f%%", F.col("ticker_pct") * 100).alias("ticker_pct"))


def in_canonical(facts: DataFrame, canonical: DataFrame) -> DataFrame:
    """Facts whose metric has a canonical key; the set of keys is broadcast behind a check of its size."""
    keyed = facts.withColumn("__key", metric_key(F.col("metric")))
    return keyed.join(broadcast_if_small(canonical.select(F.col("metric").alias("__key"))), "__key", "left_semi").drop("__key")


def two_pass(facts: DataFrame, threshold: float, forms: tuple[str, ...] = ("10-K",)) -> tuple[DataFrame, DataFrame]:
    """Canonical metrics from the facts of the given forms, and the facts of all forms that have them. Write ``facts`` first where
    it is costly: it is read twice."""
    canonical = canonical_metrics(facts.where(F.col("filing_type").isin(*forms)), threshold)
    return canonical, in_canonical(facts, canonical)
