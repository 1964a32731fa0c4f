import os
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillstone.llm import pii, quality
from quillstone.llm.queries import pii_key, queries, trained_quality_model, vocabulary
from tests.llm.test_llm_operators import plain_components, plain_fingerprint, plain_ids
from tests.llm.test_similar import plain_set

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


def test_stages_match_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    weights = trained_quality_model(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    kept = stages["quality classifier"](spark, docs, SF)
    scores = {r.doc_id: r.s for r in docs.select("doc_id", quality.quality_score(docs, weights).alias("s")).collect()}
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {k for k, s in scores.items() if s >= 0.3}
    texts = {r.doc_id: r.text for r in kept.collect()}
    sets = {k: plain_set(t, 5) for k, t in texts.items()}
    label = plain_components(list(sets), [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])])
    single = stages["SimHash near-dedup"](spark, kept, SF)
    assert single.columns == docs.columns and {r.doc_id for r in single.collect()} == {k for k, c in label.items() if k == c}
    hidden = stages["PII pseudonyms"](spark, single, SF)
    assert hidden.columns == docs.columns and hidden.count() == single.count()
    mixed = stages["temperature mixing"](spark, hidden, SF)
    uses = Counter(r.doc_id for r in mixed.collect())
    assert mixed.columns == docs.columns and set(uses) == {r.doc_id for r in hidden.collect()} and max(uses.values()) <= 2
    new = {r.doc_id: r.text for r in hidden.collect()}
    got = Counter()
    for r in corpus_pipeline.run(spark, SF).collect():
        got[r.doc_id] += r.length
    assert got == {k: uses[k] * len(ids) for k, ids in zip(uses, plain_ids([new[k] for k in uses]))}


def test_pii_of_the_table_is_gone(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = r"[a-z]+\.[0-9]+@mail[0-9]\.example\.com|\+1 \([0-9]{3}\) [0-9]{3}-[0-9]{4}"
    before, after = ([v for r in d.select(F.regexp_extract_all("text", F.lit(found), F.lit(0)).alias("v")).collect() for v in r.v] for d in (docs, pii.pseudonymise(docs, pii_key(spark))))
    assert before and len(before) == len(after) and not set(before) & set(after) and len(set(before)) == len(set(after))


def test_contract_queries(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    ids = dict(zip(docs, plain_ids(list(docs.values()))))
    start = 0
    for r in sorted(queries()["op2_token_files"](spark, SF).collect()):
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids[r.doc_id]), zlib.crc32(np.array(ids[r.doc_id], "<u4").tobytes()))
        start += r.n_tokens
    for r in queries()["op7_packed_sequences"](spark, SF).collect():
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes()) and r.doc_tokens == len(ids[r.doc_id])
    fp = {k: plain_fingerprint(t, 3) for k, t in docs.items()}
    label = plain_components(list(fp), [(a, b) for a in fp for b in fp if a < b and (fp[a] ^ fp[b]).bit_count() <= 3])
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in queries()["op4_simhash_duplicates"](spark, SF).collect()} == {(k, f"{fp[k]:016x}", label[k]) for k in docs}
    talk = {r.conv_id: r for r in queries()["op3_chat_examples"](spark, SF).collect()}
    assert (talk[-1].n_turns, talk[-1].loss_chars) == (2, len("<|im_end|><|im_start|>assistant ok"))
    assert vocabulary().endswith("word_bpe_49k.json")


def test_quality_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    scored = queries()["op10_quality_scores"](spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    good = [r.predicted for r in scored if r.quality == 1]
    assert sum(good) / len(good) > 0.97 and np.mean([r.predicted == r.quality for r in scored]) > 0.95
