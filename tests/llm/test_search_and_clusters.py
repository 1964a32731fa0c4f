"""op11, op12 and op13 against brute force on small tables with nulls, repeats, ties, empty and very long texts."""

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from quillstone.llm import bisectors, bloom_search, fm_index, terms

PATTERN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(text):
    return PATTERN.findall((text or "").translate(LOWER))


def made_texts(rng, n, most=120):
    pool = ["alpha", "Beta", "GAMMA", "déjà", "ÉTÉ", "été", "x1", "1", "z", "word_word", "a-b", "語", "the", "of"]
    texts = [" ".join(rng.choice(pool, rng.integers(0, most))) for _ in range(n)]
    return [*texts, None, "", "  \t\n", "...", texts[0], texts[0], "one\x00two\x7fthree", "the " * 5000]


def rows_of(texts, first=0):
    return [(i + first, t, "x", 1.5) for i, t in enumerate(texts)]


# Words.
def test_words_are_cut_at_ascii_marks_and_equal_words_hash_alike(monkeypatch):
    texts = made_texts(np.random.default_rng(1), 40)
    plain = [words(t) for t in texts]
    for piece in (1 << 20, 5, 64):
        monkeypatch.setattr(terms, "PIECE", piece)
        h, bounds = terms.row_words(pa.array(texts))
        assert np.diff(bounds).tolist() == [len(w) for w in plain]
        known = {}
        assert all(known.setdefault(w, k) == k for w, k in zip([w for row in plain for w in row], h.tolist()))
        assert len(set(known.values())) == len(known)
    assert terms.row_words(pa.array([], pa.string()))[1].tolist() == [0]
    assert len(terms.text_hashes(None)) == 0


# op12.
@pytest.mark.parametrize("seed", range(6))
def test_suffixes_are_sorted(seed):
    rng = np.random.default_rng(seed)
    s = rng.integers(2, 3 + seed, 200)
    s[rng.integers(0, 199, 9)] = fm_index.GAP
    s[-1] = fm_index.END
    assert fm_index.suffix_array(s).tolist() == sorted(range(200), key=lambda i: s[i:].tolist())


def test_a_long_repeat_is_sorted():
    s = np.append(np.full(5000, 2), 0)
    assert fm_index.suffix_array(s).tolist() == list(range(5000, -1, -1))


def plain_hits(texts, items, n=10):
    out = []
    for _, t, *_ in texts:
        w, hit, found = words(t), set(), set()
        for i, item in items:
            v = words(item)
            for win in [v[k : k + n] for k in range(max(1, len(v) - n + 1))] if v else []:
                for at in range(len(w) - len(win) + 1):
                    if w[at : at + len(win)] == win:
                        hit |= set(range(at, at + len(win)))
                        found.add(i)
        spans = []
        for k in sorted(hit):
            if spans and spans[-1][1] == k:
                spans[-1][1] = k + 1
            else:
                spans.append([k, k + 1])
        out.append((len(w), spans, found))
    return out


@pytest.mark.parametrize(("shard_words", "rate", "block"), [(1 << 20, 16, 200_000), (64, 4, 200_000), (25, 1, 7)])
def test_contamination_equals_brute_force(spark, shard_words, rate, block):
    rng = np.random.default_rng(3)
    texts = made_texts(rng, 25, 60)
    texts[-1] = "the " * 300
    items = [(i, " ".join(words(t)[5:25])) for i, t in enumerate(texts[:8])] + [(8, "ÉTÉ"), (8, "x1 z"), (9, None), (10, "--"), (11, "the " * 12), (12, "nowhere at all"), (None, "three")]
    docs = spark.createDataFrame(rows_of(texts) + rows_of(texts[:3]), "doc_id long, text string, row string, n_words double")
    index = fm_index.build_index(docs, shard_words=shard_words, rate=rate)
    windows = fm_index.item_windows(spark.createDataFrame(items, "item_id long, text string"))
    got = [(r.doc_id, r.n_words, [list(s) for s in r.spans], set(r["items"])) for r in fm_index.contaminated(index, windows, block).orderBy("row").collect()]
    want = plain_hits(rows_of(texts) + rows_of(texts[:3]), items)
    assert [g[1:] for g in got] == want
    assert [g[0] for g in got] == [*range(len(texts)), 0, 1, 2]
    assert any(len(x[1]) > 1 for x in want) and any(None in x[2] for x in want)


def test_contamination_of_empty_tables_and_null_ids(spark):
    docs = spark.createDataFrame([(None, "a b"), (None, "a b"), (3, None)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "b")], "item_id long, text string")
    index = fm_index.build_index(docs)
    found = fm_index.contaminated(index, fm_index.item_windows(items)).collect()
    assert sorted((r.doc_id is None, r.n_words, len(r.spans)) for r in found) == [(False, 0, 0), (True, 2, 1), (True, 2, 1)]
    none = fm_index.contaminated(index, fm_index.item_windows(items.limit(0))).collect()
    assert [len(r.spans) for r in none] == [0, 0, 0]
    assert fm_index.contaminated(fm_index.build_index(docs.limit(0)), fm_index.item_windows(items)).count() == 0


def test_one_index_serves_several_benchmarks(spark):
    index = fm_index.build_index(spark.createDataFrame([(1, "p q r s t u v w x y z"), (2, "z y x")], "doc_id long, text string"))
    for item, hits in (("p q r s t u v w x y", {1: 10}), ("y x", {2: 2}), ("x y", {1: 2})):
        windows = fm_index.item_windows(spark.createDataFrame([(1, item)], "item_id long, text string"))
        assert {r.doc_id: sum(s.stop - s.start for s in r.spans) for r in fm_index.contaminated(index, windows).collect() if r.spans} == hits


# op11.
def plain_search(texts, items, top):
    bags = [(i, Counter(words(t))) for i, t, *_ in texts if words(t)]
    n, total = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        scored = []
        for d, b in bags:
            m = 75 + 25 * sum(b.values()) * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * b[t] // (1000 * b[t] + 12 * m)) for t in words(text))
            scored += [(-score, d is None, d or 0)] if score > 0 else []
        out += [(item, k + 1, None if gone else d, -s) for k, (s, gone, d) in enumerate(sorted(scored)[:top])]
    return out


@pytest.mark.parametrize(("rows", "top", "block"), [(1024, 20, 1 << 17), (3, 4, 40), (1, 1000, 1 << 17)])
def test_ranks_equal_brute_force(spark, rows, top, block):
    texts = rows_of(made_texts(np.random.default_rng(5), 60)) + [(None, "alpha beta", "y", 0.0), (7, "alpha beta", "y", 0.0)]
    items = [(1, "alpha ALPHA déjà"), (2, "the of"), (3, None), (4, ""), (5, "not there"), (6, "one two three 語"), (6, "x1"), (None, "z z z z 1")]
    docs = spark.createDataFrame(texts, "doc_id long, text string, score string, rank double")
    found = bloom_search.search(bloom_search.build_index(docs, rows=rows), spark.createDataFrame(items, "item_id long, text string"), top, block)
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(map(tuple, found.collect()), key=key) == sorted(plain_search(texts, items, top), key=key)


def test_bounds_are_never_below_scores():
    rng = np.random.default_rng(9)
    pool = rng.integers(1, 1 << 63, 300, dtype=np.uint64)
    texts = []
    for k in range(70):
        t, c = np.unique(rng.choice(pool, rng.integers(1, 400)), return_counts=True)
        c[0] += 600 * (k % 3 == 0)
        texts.append((k, int(c.sum()), t, c))
    block = bloom_search._block(texts, 2048)
    block |= {c: np.array(block[c], np.int64) for c in ("length", "stops")}
    known = np.unique(pool)
    df = np.array([sum(t in set(x[2].tolist()) for x in texts) for t in known.tolist()])
    asked = bloom_search.Asked([(i, rng.choice(pool, 30)) for i in range(12)], known, df, 70, int(block["length"].sum()))
    bound, score = asked.bounds(2048, block["slices"], block["length"]), asked.scores(np.arange(70), block)
    assert (bound >= score).all() and (score > 0).any()
    assert (bound > score).any()  # false positives


def test_search_in_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a")], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    for d, i in ((docs.limit(0), items), (docs, items.limit(0)), (spark.createDataFrame([(1, None), (2, "-")], "doc_id long, text string"), items)):
        assert bloom_search.search(bloom_search.build_index(d), i).collect() == []


def test_an_item_beyond_doubles_is_summed_in_integers():
    n = 100_000
    asked = bloom_search.Asked([(1, np.arange(1, n + 1, dtype=np.uint64))], np.arange(1, n + 1, dtype=np.uint64), np.zeros(n, int), 10**17, 10**18)
    assert asked.kind is np.float64
    many = bloom_search.Asked([(1, np.repeat(np.arange(1, n + 1, dtype=np.uint64), 5))], np.arange(1, n + 1, dtype=np.uint64), np.zeros(n, int), 10**17, 10**18)
    assert many.kind is np.int64


# op13.
def plain_clusters(rows, k, rounds):
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    draw = lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1])
    c = [v for _, v in sorted(kept, key=draw)[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda v: min((far(v, x), j) for j, x in enumerate(c))
    for _ in range(rounds):
        of = [near(v)[1] for _, v in kept]
        for j in range(len(c)):
            mine = [v for (_, v), o in zip(kept, of) if o == j]
            c[j] = [sum(x) // len(mine) for x in zip(*mine)] if mine else c[j]
    last = [(i, *near(v)) for i, v in kept]
    by = Counter()
    for _, d, j in last:
        by[j] += d
    return [(i, j, d, by[j], sum(by.values()), hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for i, d, j in last]


@pytest.mark.parametrize("n", [0, 1, 9, 150])
def test_clusters_equal_brute_force(spark, n):
    rng = np.random.default_rng(n)
    rows = [(i, [round(x, 2) for x in rng.normal(rng.integers(-2, 3), 0.4, 64).tolist()]) for i in range(n)]
    rows += rows[:20] + [(None, v) for _, v in rows[:1]]  # repeated rows, a null id, ties
    rows += [(900, None), (901, []), (902, [1.0] * 63), (903, [None] * 64), (904, [float("nan")] + [0.0] * 63), (905, [float("inf")] * 64)]
    table = spark.createDataFrame([(i, v, 3, "v") for i, v in rows], "vec_id long, embedding array<double>, cluster int, v string")
    got = bisectors.with_inertia(*bisectors.centroid_clusters(bisectors.grid_vectors(table))).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted(map(tuple, got), key=key) == sorted(plain_clusters(rows, 16, 3), key=key)


def test_the_tournament_keeps_the_smaller_number_of_a_tie():
    t = bisectors.Tournament(np.array([[5, 0], [0, 0], [10, 0], [0, 0], [2, 0]]))
    v = np.array([[0, 0], [1, 0], [5, 7], [8, 0], [7, 0], [100, 0], [3, 0]])
    want = [min(range(5), key=lambda j: (int(((x - t.centroids[j]) ** 2).sum()), j)) for x in v]
    assert t.winners(v).tolist() == want


def test_components_whose_distances_fit_no_long_are_refused(spark):
    table = spark.createDataFrame([(1, [3e6] * 64), (2, [1e300] * 64)], "vec_id long, embedding array<double>")
    with pytest.raises(ValueError, match="beyond"):
        bisectors.centroid_clusters(bisectors.grid_vectors(table))
    assert bisectors.centroid_clusters(bisectors.grid_vectors(spark.createDataFrame([(1, [-2e6] * 64)], "vec_id long, embedding array<double>")))[0].count() == 1


def test_readers_of_the_index_hold_a_few_of_its_rows(spark):
    """Rows of megabytes: a row group, which a task holds at a time, has some 16 MB of them."""
    docs = spark.range(60).selectExpr("id as doc_id", "array_join(transform(sequence(1, 60000), x -> concat(id, 'w', x)), ' ') as text").coalesce(1)
    index = bloom_search.build_index(docs, rows=1)
    files = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in index.inputFiles()]
    groups = [m.row_group(k) for m in files for k in range(m.num_row_groups)]
    assert sum(g.num_rows for g in groups) == 60 and sum(g.total_byte_size for g in groups) > 40e6
    assert max(g.total_byte_size for g in groups) < 32e6
