import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstone.operators import retrieval
from quillstone.operators.vector_index import VectorIndex
from quillstone.sources.tables import work_folder

SCHEMA = "chunk_id long, vec array<double>, ticker string"


@pytest.fixture(scope="module")
def corpus(spark):
    """Forty groups of near vectors, a third of all rows equal, and rows without a direction."""
    rng = np.random.default_rng(5)
    centers = rng.normal(size=(40, 16))
    rows = [(i, (centers[i % 40] + 0.05 * rng.normal(size=16)).tolist(), f"T{i % 3}") for i in range(1200)]
    rows += [(i, [1.0] + [0.0] * 15, "T1") for i in range(2000, 2600)]
    bad = [(5000, None, "T0"), (5001, [0.0] * 16, "T0"), (5002, [float("nan")] * 16, "T0"), (5003, [1.0, 2.0], "T0"), (5004, [], "T0"), (5005, [None] * 16, "T0")]
    return spark.createDataFrame(rows + bad, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def queries(spark, corpus):
    some = corpus.where("chunk_id % 97 = 0 or chunk_id in (2000, 5000, 5001, 5003)").select(F.col("chunk_id").alias("query_id"), F.col("vec").alias("qvec"))
    return some.union(spark.createDataFrame([(-1, [0.1 * i for i in range(16)]), (-2, [-1.0] + [0.0] * 15)], "query_id long, qvec array<double>"))


def ranks(df):
    return sorted((r.query_id, r["rank"], r.chunk_id, r.score) for r in df.collect())


@pytest.fixture(scope="module")
def index(spark, corpus):
    made = VectorIndex(spark, work_folder(spark, "vector-index"))
    made.build(corpus.where("chunk_id % 4 <> 1"))
    made.add(corpus.where("chunk_id % 4 = 1"))
    return made


@pytest.mark.parametrize("k, block", [(10, 9), (700, 1000), (5000, 1000)])
def test_equals_a_full_scan(index, corpus, queries, k, block):
    sound = corpus.where("size(vec) = 16")  # an index has vectors of one length
    assert ranks(index.search(queries, k, block=block)) == ranks(retrieval.dense_top_k(queries, sound, k))
    if k == 10:
        assert all(read <= total for read, total in index.cells_read)
        assert len(index.cells_read) > 1  # several blocks


def test_reads_few_cells_for_one_query(index, queries):
    assert index.search(queries.where("query_id = 97"), 10).count() == 10
    (read, total), = index.cells_read
    assert total > 20 and read < total / 3


def test_conditions_and_several_queries(index, corpus, queries):
    one = corpus.where("ticker = 'T2'")
    assert ranks(index.search(queries, 25, where=F.col("ticker") == "T2")) == ranks(retrieval.dense_top_k(queries, one, 25))
    assert index.search(queries, 5, where=F.col("ticker") == "none").count() == 0
    got = {(r.chunk_id, r["rank"]) for r in index.search_multi_query(queries, 5).collect()}
    assert got == {(r.chunk_id, r["rank"]) for r in retrieval.search_multi_query(queries, corpus.where("size(vec) = 16"), 5).collect()}


def test_empty_and_tiny(spark, corpus, queries):
    for some in (corpus.limit(0), corpus.where("chunk_id >= 5000")):
        empty = VectorIndex(spark, work_folder(spark, "vector-index"))
        empty.build(some)
        assert empty.search(queries, 3).count() == 0
    one = VectorIndex(spark, work_folder(spark, "vector-index"))
    one.build(corpus.where("chunk_id = 3"), cells=9)
    assert {r.chunk_id for r in one.search(queries, 3).collect()} == {3}
    assert one.search(queries.limit(0), 3).count() == 0
