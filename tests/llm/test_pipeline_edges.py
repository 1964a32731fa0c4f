"""The pipeline and each stage over nulls, repeated rows and ids, empty and long texts, clashing columns and empty tables."""

from collections import Counter

import pytest

import corpus_pipeline
from tests.llm.test_llm_operators import plain_ids

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "plain good words of a text that reads well and goes on with number"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("tables"))
    rows = [(k, f"{WORDS} {k} and value {k * 7919 % 1000} then {k * 31 % 97} more {k * k}", "en", "hot" if k % 3 else f"s{k % 4}", 1) for k in range(90)]
    rows += [(200, None, None, None, None), (201, "", "en", "hot", 0), (202, " \n", "en", "hot", 0), (203, "long " + " ".join(f"w{k}" for k in range(30_000)), "en", "hot", 1)]
    rows += [rows[0], rows[0], (5, "another text under an id that is taken already, mail a.b@mail.example.com", "en", "hot", 2), (None, "without an id but with a text of its own", "en", None, 3), (None, rows[1][1], "en", None, 3)]
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{at}/documents.parquet")
    labels = [(k, k % 5 != 0, 0) for k in range(60)] + [(None, 1, 0), (61, None, 0), (999, 1, 0), (3, 1, 0)]
    spark.createDataFrame([(k, None if q is None else int(q), t) for k, q, t in labels], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at


@pytest.fixture(scope="module")
def none(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("none"))
    spark.createDataFrame([], DOCS).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at


def test_pipeline_takes_hostile_tables(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stages, now = dict(corpus_pipeline.STAGES), docs
    kept = stages["quality classifier"](spark, docs, folder)
    assert kept.columns == docs.columns and not Counter(kept.collect()) - Counter(docs.collect())
    texts = {t for t in (r.text for r in docs.collect())}
    single = stages["SimHash near-dedup"](spark, now, folder)
    left = [r.text for r in single.collect()]
    assert {" ".join((t or "").split()) for t in texts} == {" ".join((t or "").split()) for t in left} and len(left) == len({" ".join((t or "").split()) for t in left})
    hidden = stages["PII pseudonyms"](spark, docs, folder)
    assert hidden.count() == docs.count() and "a.b@mail" not in "".join(r.text or "" for r in hidden.collect())
    mixed = stages["temperature mixing"](spark, docs, folder)
    assert not Counter(docs.collect()) - Counter(mixed.collect()) and mixed.columns == docs.columns
    packed = Counter()
    for r in stages["packing"](spark, docs, folder).collect():
        packed[r.doc_id] += r.length
    want = Counter()
    for r, ids in zip(docs.collect(), plain_ids([r.text for r in docs.collect()])):
        want[r.doc_id] += len(ids)
    assert packed == want
    assert corpus_pipeline.run(spark, folder).count() > 0


def test_pipeline_of_empty_tables_is_empty(spark, none):
    assert corpus_pipeline.run(spark, none).count() == 0


def test_stages_keep_columns_named_like_their_own(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = ["pii_work", "mix_source", "mix_block", "mix_copy", "of", "hash", "rep", "node", "component", "score", "key"]
    wide = docs.selectExpr("*", *(f"{k} as {n}" for k, n in enumerate(names)))
    for name, stage in corpus_pipeline.STAGES[1:4]:
        out = stage(spark, wide, folder)
        assert out.columns == wide.columns, name
        assert {tuple(r[n] for n in names) for r in out.collect()} == {tuple(range(len(names)))}, name
