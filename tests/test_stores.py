import os
import uuid

import pytest
from pyspark.sql import functions as F

from quillstone.operators import lexical_index, retrieval, store
from quillstone.operators.versions import Versioned


@pytest.fixture
def root(tmp_path):
    return f"file://{tmp_path}/{uuid.uuid4().hex}"


def files(root):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(root.removeprefix("file://") + "/data") for f in names if f.endswith(".parquet")}


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_an_upsert_of_one_ticker_rewrites_its_bucket_only(spark, root):
    facts = spark.range(4000).select(F.concat(F.lit("T"), F.col("id") % 40).alias("ticker"), F.concat(F.lit("FY"), F.col("id") / 40).alias("period"), F.col("id").cast("double").alias("value"))
    t = Versioned(spark, root, ["ticker", "period"], by=["ticker"], buckets=16)
    assert t.upsert(facts.withColumn("seq", F.lit(0)), ["seq"]) == 1
    before, folders = files(root), t.folders()
    new = spark.createDataFrame([("T3", "FY0", 1.0, 0), ("T3", "FY0", None, 1), ("T3", "new", 5.0, 0)], "ticker string, period string, value double, seq int")
    assert t.upsert(new, ["seq"]) == 2
    assert {b for b, f in t.folders().items() if folders.get(b) != f} == set(t.buckets_of(ticker="T3"))
    assert all(files(root).get(f) == at for f, at in before.items())  # old files are as they were
    want = store.upsert(facts.withColumn("seq", F.lit(-1)), new, ["ticker", "period"], ["seq"]).drop("seq")
    assert rows(t.read().select("ticker", "period", "value")) == rows(want)
    assert rows(t.read(version=1).select("ticker", "period", "value")) == rows(facts)
    assert t.upsert(new.limit(0), ["seq"]) == 2
    assert t.delete(ticker="T3") == (3, t.read(version=2).where("ticker = 'T3'").count()) and t.delete(ticker="none") == (3, 0)
    assert t.read().where("ticker = 'T3'").count() == 0 and t.read().count() == 3900
    assert t.vacuum() >= 1 and t.read().count() == 3900
    t.replace(facts.limit(5))
    assert t.read().count() == 5


def test_a_hot_ticker_is_split_and_a_failed_change_is_not_seen(spark, root):
    facts = spark.range(900).select(F.lit("HOT").alias("ticker"), F.col("id").alias("n"), F.lit(None).cast("string").alias("note"))
    t = Versioned(spark, root, ["ticker", "n"], by=["ticker"], buckets=4, split=8)
    t.upsert(facts, [])
    assert len(t.folders()) == 8
    t.upsert(facts.where("n = 17").withColumn("note", F.lit("x")), [])
    assert len(set(t.folders().values())) == 2 and t.read().where("note = 'x'").count() == 1
    with pytest.raises(Exception, match="no luck|NO_LUCK|USER_RAISED"):
        t.change(list(t.folders()), lambda old: old.withColumn("note", F.raise_error(F.lit("no luck")).cast("string")))
    assert t.version() == 2 and t.read().count() == 900


TEXTS = [(1, "the quick brown fox", "a"), (2, "the lazy dog and the quick cat", "b"), (3, None, "a"), (4, "", "b"), (5, "fox fox fox", "a"), (6, "nothing in common", None), (7, "Brown DOG", "b")]
ASKED = [(1, "quick fox"), (2, "the dog the"), (3, "absent"), (4, ""), (5, "brown brown")]


def best(spark, index, queries, **more):
    return rows(index.search(queries, 3, **more).select("query_id", "chunk_id", "score", "rank"))


def plain(chunks, queries, k=3):
    return rows(retrieval.top_k(retrieval.bm25_scores(queries, chunks.select("chunk_id", "text")), k).select("query_id", "chunk_id", "score", "rank"))


def test_the_index_gives_what_scoring_the_texts_gives_after_each_change(spark, root):
    chunks = spark.createDataFrame(TEXTS, "chunk_id long, text string, kind string")
    queries = spark.createDataFrame(ASKED, "query_id long, text string")
    index = lexical_index.LexicalIndex(spark, root, buckets=4)
    assert best(spark, index, queries) == []
    index.add(chunks.where("chunk_id < 4"))
    assert best(spark, index, queries) == plain(chunks.where("chunk_id < 4"), queries)
    index.add(chunks.where("chunk_id >= 4"))
    assert best(spark, index, queries) == plain(chunks, queries)
    index.remove(spark.createDataFrame([(2,), (99,), (None,)], "chunk_id long"))
    assert best(spark, index, queries) == plain(chunks.where("chunk_id <> 2"), queries)
    index.add(spark.createDataFrame([(1, "the quick dog", "a"), (None, "fox", "a")], "chunk_id long, text string, kind string"))
    now = chunks.where("chunk_id > 2").union(spark.createDataFrame([(1, "the quick dog", "a")], "chunk_id long, text string, kind string"))
    want = plain(now, queries)
    assert best(spark, index, queries) == want
    index.compact()
    assert best(spark, index, queries) == want
    assert best(spark, lexical_index.LexicalIndex(spark, root, buckets=4), queries) == want
    kept = best(spark, index, queries.withColumn("want", F.lit("a")), fits=F.col("kind") == F.col("want"))
    assert kept and {r[1] for r in kept} <= {1, 3, 5}


def test_a_search_reads_the_buckets_of_its_terms(spark, root):
    index = lexical_index.LexicalIndex(spark, root, buckets=32)
    index.add(spark.range(500).select(F.col("id").alias("chunk_id"), F.concat_ws(" ", F.sequence(F.col("id"), F.col("id") + 5)).alias("text")))
    one = index._live([3])._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(bucket" in one.replace("#", "").replace("  ", " ") or "PartitionFilters: [" in one
    assert index._live([3]).select("bucket").distinct().count() <= 1
