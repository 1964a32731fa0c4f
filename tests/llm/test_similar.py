import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from quillstone.llm import simhash
from tests.llm.test_llm_operators import plain_components


def plain_set(text, n):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[k : k + n]) for k in range(max(1, len(words) - n + 1))} if words else set()


def test_half_masks_cover_the_radius():
    masks, rng = simhash.part_masks(11), np.random.default_rng(0)
    assert len(masks) == 126 and {m.bit_count() for m in masks} == {16, 32}
    for _ in range(2000):
        flips = sum(1 << int(p) for p in rng.choice(64, 11, replace=False))
        assert any(flips & m == 0 for m in masks)


def test_stage_finds_what_brute_force_jaccard_finds(spark):
    """Copies with a few changed words: similarity 0.8 or more, and most of them further apart than 3 bits."""
    rng = np.random.default_rng(2)
    rows = []
    for g in range(60):
        base = [f"w{x}" for x in rng.integers(0, 400, int(rng.integers(60, 300)))]
        for c in range(4):
            words = list(base)
            for p in rng.choice(len(words), int(len(words) * 0.025 * c / 2), replace=False):
                words[p] = f"new{rng.integers(1 << 40)}"
            rows.append((len(rows), " ".join(words)))
    rows += [(500, None), (501, ""), (502, " \n"), (503, rows[0][1]), (None, rows[0][1]), (504, "one two"), (505, "one two")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("source", F.lit("s")).repartition(3)
    sets = {k: plain_set(t, 5) for k, t in rows if k is not None}
    alike = lambda a, b: len(a & b) >= 0.8 * len(a | b)
    linked = [(a, b) for a in sets for b in sets if a < b and alike(sets[a], sets[b])]
    fp = {k: simhash.fingerprint(t, 3) for k, t in rows if k is not None}
    assert sum((fp[a] ^ fp[b]).bit_count() > 3 for a, b in linked) > 20
    label = plain_components(list(sets), linked)
    got = {r.doc_id: r.rep.doc_id for r in simhash.similar_documents(docs).collect() if r.doc_id is not None}
    missed = sum(got[a] != got[b] for a, b in linked)
    assert missed <= 0.02 * len(linked) and all(label[k] == label[c] for k, c in got.items())
    kept = corpus_pipeline.simhash_stage(spark, docs, "")
    ids = [r.doc_id for r in kept.collect()]
    assert kept.columns == docs.columns and sorted(ids) == sorted(k for k, c in got.items() if k == c)
    assert {500, 504} <= set(ids) and not {501, 502, 503, 505, None} & set(ids)


def test_rows_are_dropped_by_row_and_not_by_id(spark):
    """Ids and texts that repeat, null ids and columns named like the operator's own: unique texts stay, copies go."""
    rows = [(1, "a b c d e f", "x"), (2, "a b c d e f", "x"), (2, "totally different words here now ok", "x"), (3, "one and the same row of words", "x"), (3, "one and the same row of words", "x")]
    rows += [(4, "same id and text but another source", "p"), (4, "same id and text but another source", "q"), (None, "a b c d e f", "x"), (None, "only a null id has this text", "x"), (None, "only a null id has this text", "y"), (5, None, None), (6, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, hash string").withColumn("of", F.lit(1)).withColumn("rep", F.lit(2)).repartition(3)
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.text) for r in simhash.without_similar(docs).collect())
    assert got == [(-1, "only a null id has this text"), (1, rows[0][1]), (2, rows[2][1]), (3, rows[3][1]), (4, rows[5][1]), (5, None)]
    assert simhash.without_similar(docs).columns == docs.columns and simhash.without_similar(docs.limit(0)).count() == 0


def test_a_group_of_very_many_near_copies(spark):
    rng = np.random.default_rng(4)
    base = [f"w{x}" for x in rng.integers(0, 900, 200)]
    rows = []
    for k in range(1500):
        words = list(base)
        words[int(rng.integers(200))] = f"v{k}"
        rows.append((k, " ".join(words)))
    kept = simhash.without_similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [r.doc_id for r in kept] == [0]


def test_no_row_of_a_long_bucket_is_left_out():
    """600 rows of one key, only the first and the last are candidates: both go on, as does every row of the bucket."""
    n = 600
    fp = np.array([(k * 0x9E3779B97F4A7C15 ^ k << 40) & (1 << 64) - 1 for k in range(n)], np.uint64)
    fp[-1] = fp[0] ^ np.uint64(7)
    rows = {"key": np.zeros(n, np.int64), "fp": fp.view(np.int64), "fp2": fp.view(np.int64), "node": np.arange(n), "component": np.arange(n)}
    batches = lambda: iter(pa.record_batch(rows).slice(k, 100) for k in range(0, n, 100))
    came = {r["a"] for b in simhash._sampled(11, 18)(batches()) for r in b.to_pylist()}
    assert came == set(range(n))
    links = [(r["a"], r["b"]) for b in simhash._spanning(11, 18)(batches()) for r in b.to_pylist()]
    assert (n - 1, 0) in links


def test_result_is_the_same_however_few_neighbours_are_looked_at(spark):
    rng = np.random.default_rng(6)
    rows = []
    for g in range(40):
        base = [f"w{x}" for x in rng.integers(0, 300, 140)]
        for c in range(6):
            words = list(base)
            words[int(rng.integers(140))] = f"v{g}x{c}"
            rows.append((len(rows), " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    few, all_ = ({(r.doc_id, r.rep.doc_id) for r in simhash.similar_documents(docs, most=m).collect()} for m in (2, 1 << 30))
    assert few == all_ and len({c for _, c in all_}) == 40


def test_a_large_group_is_not_connected_anew_in_each_table(spark, monkeypatch):
    """400 near texts that are no copies meet in most of the 126 tables, and stay apart."""
    rng = np.random.default_rng(8)
    base, rows, given = [f"w{x}" for x in rng.integers(0, 900, 200)], [], []
    for k in range(400):
        words = list(base)
        for p in rng.choice(200, 4, replace=False):
            words[p] = f"v{k}x{p}"
        rows.append((k, " ".join(words)))
    find = simhash.connected_components
    monkeypatch.setattr(simhash, "connected_components", lambda edges: given.append(edges.count()) or find(edges))
    kept = simhash.without_similar(spark.createDataFrame(rows, "doc_id long, text string")).count()
    sets = [plain_set(t, 5) for _, t in rows]
    linked = [(a, b) for a in range(400) for b in range(a + 1, 400) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    assert len(set(plain_components(list(range(400)), linked).values())) == kept > 200
    assert 400 < max(given) < 8 * 400
