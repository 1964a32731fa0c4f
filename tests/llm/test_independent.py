"""Operators that SQL can't express, held against plain second versions written from their descriptions alone."""

import hashlib
import math
import os
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quillstone.llm import mixing, ngram_lm, pii, quality, tiff
from quillstone.llm.queries import CONTEXT_SHARE, MAX_LOSS, MAX_REPEATS, pii_key, queries
from tests.llm.test_llm_operators import luhn, plain_ids

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


def documents(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


# op1: the keyed permutation.
def draw(key, tweak, *parts):
    return int(hashlib.sha256("|".join([key, tweak, *map(str, parts)]).encode()).hexdigest()[:13], 16)


def plain_feistel(left, n_left, right, n_right, key, tweak, back=False):
    for i in reversed(range(1, 11)) if back else range(1, 11):
        sign = -1 if back else 1
        if i % 2:
            left = (left + sign * draw(key, tweak, i, right)) % n_left
        else:
            right = (right + sign * draw(key, tweak, i, left)) % n_right
    return left, right


def test_pseudonyms_are_the_keyed_permutation_and_can_be_undone(spark):
    rng = np.random.default_rng(8)
    cards = []
    while len(cards) < 40:
        d = "4" + "".join(map(str, rng.integers(0, 10, 15)))
        cards += [d] if luhn(d) else []
    addresses = [".".join(map(str, rng.integers(0, 256, 4))) for _ in range(40)]
    ssns = [f"{a:03d}-{g:02d}-{s:04d}" for a, g, s in zip(rng.integers(1, 666, 40), rng.integers(1, 100, 40), rng.integers(1, 10000, 40))]
    d = spark.createDataFrame(list(enumerate(cards + addresses + ssns)), "doc_id long, text string")
    new = [r.text for r in pii.pseudonymise(d, "secret").orderBy("doc_id").collect()]
    for old, got in zip(cards, new[:40]):
        a, b = plain_feistel(int(old[1:8]), 10**7, int(old[8:15]), 10**7, "secret", "card")
        assert got[:-1] == f"4{a:07d}{b:07d}" and luhn(got)
        assert plain_feistel(a, 10**7, b, 10**7, "secret", "card", back=True) == (int(old[1:8]), int(old[8:15]))
    for old, got in zip(addresses, new[40:80]):
        p = list(map(int, old.split(".")))
        a, b = plain_feistel(p[0] * 256 + p[1], 65536, p[2] * 256 + p[3], 65536, "secret", "ipv4")
        assert got == f"{a // 256}.{a % 256}.{b // 256}.{b % 256}"
    for old, got in zip(ssns, new[80:]):
        area, group, serial = map(int, old.split("-"))
        a, b = plain_feistel(area - 1, 898, (group - 1) * 9999 + serial - 1, 99 * 9999, "secret", "ssn")
        assert got == f"{a + 1 + (a >= 665):03d}-{b // 9999 + 1:02d}-{b % 9999 + 1:04d}"


def test_op1_changes_its_findings_alone(spark):
    texts, key = documents(spark), pii_key(spark)
    got = {r.doc_id: r for r in queries()["op1_pii_pseudonyms"](spark, SF).collect()}
    changed = 0
    for k, t in texts.items():
        cut = lambda x: re.sub(r"[0-9A-Za-z._%+-]+@|[0-9]+", "#", x)
        assert cut(got[k].text) == cut(t) and (got[k].n_replaced > 0) == (got[k].text != t)
        for a, b in zip(re.findall(r"\+1 \(([0-9]{3})\) ([0-9]{3})-([0-9]{4})", t), re.findall(r"\+1 \(([0-9]{3})\) ([0-9]{3})-([0-9]{4})", got[k].text)):
            line, new = int(a[1] + a[2]), int(b[1] + b[2])
            la, sa = (200, 800) if int(a[0]) >= 200 else (0, 200)
            ll, sl = (2_000_000, 8_000_000) if line >= 2_000_000 else (0, 2_000_000)
            x, y = plain_feistel(int(a[0]) - la, sa, line - ll, sl, key, "phone")
            assert (int(b[0]), new) == (x + la, y + ll)
            changed += 1
    assert changed > 0 and len(got) == len(texts)


# op5: the mixture's weights and scores.
def plain_model(rows, eval_, held):
    texts = [(k, [w.decode("latin1") for w in (t or "").encode().lower().split()] + ["\0end"]) for k, t in rows]
    uni, bi, uni_h, bi_h = Counter(), Counter(), Counter(), Counter()
    for k, w in texts:
        if eval_(k):
            continue
        pairs = list(zip(["\0end", *w[:-1]], w))
        uni.update(w)
        bi.update(pairs)
        if held(k):
            uni_h.update(w)
            bi_h.update(pairs)
    n, v = sum(uni.values()), len(uni)
    kept = n - sum(uni_h.values())
    bucket = lambda c: min(math.frexp(c)[1], ngram_lm.CONTEXTS - 1)
    rounded = lambda f: 2.0 ** (round(math.log2(f * (v + 1)) * 8) / 8) if f > 0 else 0.0
    cells = []
    for k, w in texts:
        if not eval_(k) and held(k):
            for a, b in zip(["\0end", *w[:-1]], w):
                before = uni[a] - uni_h[a]
                cells.append((bucket(before), rounded((bi[a, b] - bi_h[a, b]) / max(before, 1)), rounded((uni[b] - uni_h[b]) / max(kept, 1))))
    weights = [[0.0, 0.9, 0.1]] + [[0.4, 0.5, 0.1] for _ in range(ngram_lm.CONTEXTS - 1)]
    for _ in range(12):
        sums = {}
        for c, f2, f1 in cells:
            p = [weights[c][0] * f2, weights[c][1] * f1, weights[c][2]]
            s = sums.setdefault(c, [0.0, 0.0, 0.0])
            for j in range(3):
                s[j] += p[j] / sum(p)
        for c, s in sums.items():
            s = [s[0] + 1e-6, s[1] + 1e-6, s[2] + 1e-3]
            weights[c] = [x / sum(s) for x in s]
        weights[0][0] = 0.0
        weights = [[x / sum(w) for x in w] for w in weights]
    score = {}
    for k, w in texts:
        total = 0.0
        for a, b in zip(["\0end", *w[:-1]], w):
            m = weights[bucket(uni[a])]
            total += math.log10(m[0] * bi[a, b] / max(uni[a], 1) + m[1] * uni[b] / n + m[2] / (v + 1))
        score[k] = total
    # Each context's probabilities of all known words and one unknown word add up to one.
    for a in list(uni)[:3]:
        m = weights[bucket(uni[a])]
        assert sum(m[0] * bi[a, b] / uni[a] + m[1] * uni[b] / n + m[2] / (v + 1) for b in uni) + m[2] / (v + 1) == pytest.approx(1.0)
    return score


def test_op5_scores_match_a_plain_model(spark):
    texts = documents(spark)
    fold = {k: zlib.crc32(str(k).encode()) % 7 for k in texts}
    want = plain_model(list(texts.items()), lambda k: fold[k] == 2, lambda k: fold[k] == 3)
    got = {r.doc_id: r for r in queries()["op5_ngram_scores"](spark, SF).collect()}
    assert got.keys() == want.keys()
    for k, s in want.items():
        assert got[k].score == pytest.approx(s, rel=1e-9)
    out = [r for r in got.values() if r.held_out]
    assert out and sum(r.score for r in out) > sum(r.base_score for r in out)


# op8: the schedule.
def spark_hash(*values):
    h = 42
    for v in values:
        h = xxhash.xxh64_intdigest(struct.pack("<i" if isinstance(v, np.int32) else "<q", int(v)), h)
    return h


def test_op8_schedule_matches_a_plain_one(spark):
    rows = [(r.doc_id, r.source or "", len(re.findall(r"\S+", r.text or "", re.ASCII)) + 1) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    tokens = Counter()
    for _, s, n in rows:
        tokens[s] += n
    total = sum(tokens.values())
    share = {s: n / total for s, n in tokens.items()}
    lo, hi = 0.0, 1.0
    for _ in range(60):  # bisection of the exponent
        x = (lo + hi) / 2
        r = [p ** (x - 1) for p in share.values()]
        lo, hi = (lo, x) if max(r) / min(r) <= MAX_REPEATS else (x, hi)
    raised = {s: p**hi for s, p in share.items()}
    norm = sum(raised.values())
    budget = max(tokens[s] / raised[s] for s in tokens) * norm
    repeats = {s: raised[s] / norm * budget / tokens[s] for s in tokens}
    assert max(repeats.values()) == pytest.approx(MAX_REPEATS, abs=1e-6) and min(repeats.values()) == pytest.approx(1)
    place = {k: spark_hash(np.int32(17), k) >> 1 for k, _, _ in rows}
    want = Counter()
    for s in tokens:
        rest = round((repeats[s] - round(repeats[s])) * tokens[s]) if abs(repeats[s] - round(repeats[s])) < 1e-9 else round((repeats[s] - math.floor(repeats[s])) * tokens[s])
        for k, _, n in sorted((r for r in rows if r[1] == s), key=lambda r: place[r[0]]):
            want[k] += math.floor(repeats[s] + 1e-9)
            rest -= n
            want[k] += rest >= 0
    got = queries()["op8_mixing_schedule"](spark, SF).collect()
    assert Counter(r.doc_id for r in got) == +want
    blocks = math.ceil(budget / 1_000_000)
    for r in got:
        progress = (r.copy + place[r.doc_id] / 2**63) / r.repeats
        assert r.block == min(math.floor(progress * blocks), blocks - 1) and r.weight == pytest.approx(raised[r.source] / norm, rel=1e-6)
    for b in {r.block for r in got}:
        mine = sorted((r for r in got if r.block == b), key=lambda r: r.position)
        signed = lambda h: h - (1 << 64) if h >> 63 else h
        keys = [(signed(spark_hash(np.int32(18), r.doc_id, np.int32(r.copy))), r.doc_id, r.copy) for r in mine]
        assert keys == sorted(keys) and [r.position for r in mine] == list(range(len(mine)))


def test_mixing_stops_at_a_target_entropy(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    s = mixing.mixing_schedule(d, target_entropy=1.0, budget_tokens=30_000).collect()
    w = {r.source: r.weight for r in s}
    assert -sum(x * math.log(x) for x in w.values()) >= 1.0 - 1e-6 or len(w) < 3


# op10: features, updates and scores.
def plain_features(text, bits):
    words = re.findall(rb"[a-z0-9\x80-\xff]+|[^\sa-z0-9\x80-\xff]+", (text or "").encode().lower())
    m = (1 << 64) - 1
    h = [xxhash.xxh64_intdigest(w) for w in words]
    pairs = [(a * 0x9E3779B97F4A7C15 + b) & m for a, b in zip(h, h[1:])]
    found = Counter(x >> 64 - bits for x in h)
    found.update(((p ^ p >> 31) * 0xD6E8FEB86659FD93 & m) >> 64 - bits for p in pairs)
    size = math.sqrt(sum(c * c for c in found.values()))
    return {s: c / size for s, c in found.items()}


def plain_ftrl(rows, bits, alpha=0.3, beta=1.0, l1=0.001, l2=0.1):
    z, n = Counter(), Counter()

    def weight(i):
        return 0.0 if abs(z[i]) <= l1 else -(z[i] - math.copysign(l1, z[i])) / ((beta + math.sqrt(n[i])) / alpha + l2)

    for x, y in rows:
        x = {**x, "bias": 1.0}
        w = {i: weight(i) for i in x}
        p = 1 / (1 + math.exp(-max(-35, min(35, sum(w[i] * v for i, v in x.items())))))
        for i, v in x.items():
            g = (p - y) * v
            z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / alpha * w[i]
            n[i] += g * g
    return {i: weight(i) for i in z}


def test_op10_scores_match_plain_updates(spark):
    texts, bits = documents(spark), 18
    labels = {}
    for r in spark.read.parquet(f"{SF}/labels.parquet").collect():
        if r.doc_id in texts and r.quality in (0, 1) and zlib.crc32(str(r.doc_id).encode()) % 5:
            labels[r.doc_id] = min(labels.get(r.doc_id, 1), r.quality)
    x = {k: plain_features(t, bits) for k, t in texts.items()}
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    order = sorted(labels, key=lambda k: signed(spark_hash(k)))
    w = plain_ftrl([(x[k], labels[k]) for _ in range(2) for k in order], bits)
    for r in queries()["op10_quality_scores"](spark, SF).collect():
        want = 1 / (1 + math.exp(-(sum(w.get(i, 0.0) * v for i, v in x[r.doc_id].items()) + w["bias"])))
        assert r.score == pytest.approx(want, abs=1e-5) and r.predicted == (r.score >= 0.3) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)


def test_op10_repeated_ids_give_one_model(spark):
    rows = [(1, "good words here"), (1, "bad $$$ words"), (2, "bad $$$ $$$"), (None, "x")]
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1)], "doc_id long, quality int")
    first, second = (quality.train_quality_model(spark.createDataFrame(r, "doc_id long, text string").repartition(n), labels, bits=10) for r, n in ((rows, 1), (rows[::-1], 3)))
    assert np.array_equal(first, second)


# op7 and op9 on the given tables: every limit and every decoder is in use.
def test_op7_covers_each_id_once_within_all_limits(spark):
    texts = documents(spark)
    ids = dict(zip(texts, plain_ids(list(texts.values()))))
    got = queries()["op7_packed_sequences"](spark, SF).collect()
    by_sequence, covered = {}, {k: np.zeros(len(v), int) for k, v in ids.items()}
    for r in got:
        by_sequence.setdefault(r.sequence_id, []).append(r)
        covered[r.doc_id][r.start : r.start + r.length] += 1
        context = int(r.doc_tokens * CONTEXT_SHARE)
        assert r.doc_tokens == len(ids[r.doc_id]) and r.loss_tokens == min(r.length, max(0, r.start + r.length - context))
    assert all((c == 1).all() for c in covered.values())
    for parts in by_sequence.values():
        parts.sort(key=lambda r: r.offset)
        total = sum(r.length for r in parts)
        assert [r.offset for r in parts] == [sum(p.length for p in parts[:k]) for k in range(len(parts))]
        assert total <= 4096 and len(parts) <= 256 and sum(r.loss_tokens for r in parts) <= MAX_LOSS
        assert {r.padded_length for r in parts} == {total if total & (total - 1) == 0 else 4096}
    assert any(sum(r.loss_tokens for r in parts) == MAX_LOSS for parts in by_sequence.values())
    padding = sum(parts[0].padded_length for parts in by_sequence.values()) - sum(map(len, ids.values()))
    assert padding <= 0.02 * sum(map(len, ids.values()))


def test_op9_uses_every_decoder_and_gives_the_payload_back(spark):
    texts = documents(spark)
    codes, predictors, tiled, pages, orders = Counter(), Counter(), Counter(), Counter(), Counter()
    for t in texts.values():
        raw = (t or "").encode()
        raw = raw.ljust(max(1, -(-len(raw) // 192)) * 192, b" ")
        file = tiff.text_file(raw)
        orders[file[:2]] += 1
        n = 0
        for _, tags in tiff._directories(file):
            codes[tags[tiff.COMPRESSION][0]] += 1
            predictors[tags[tiff.PREDICTOR][0]] += 1
            tiled[tiff.TILE_OFFSETS in tags] += 1
            n += 1
        pages[n] += 1
        assert b"".join(p.tobytes() for p in tiff.read_pages(file)) == raw
    assert set(codes) == {tiff.NONE, tiff.LZW, tiff.DEFLATE, tiff.OLD_DEFLATE, tiff.PACKBITS} and set(predictors) == {1, 2} and set(tiled) == {True, False} and len(pages) > 1 and len(orders) == 2
    for r in queries()["op9_tiff_pages"](spark, SF).collect():
        raw = (texts[r.doc_id] or "").encode()
        pay = raw.ljust(max(1, -(-len(raw) // 192)) * 192, b" ")
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(pay), hashlib.sha256(pay).hexdigest(), zlib.crc32(pay[-16:]))
        media = tiff.text_file(pay)
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())


def test_packing_of_very_many_one_token_items_takes_seconds():
    import time

    from quillstone.llm import packing

    one, began = np.ones(250_000, np.int64), time.process_time()
    placed = packing.pack_window(one, one, 4096, 256, 4096)
    assert len(placed) == 250_000 and time.process_time() - began < 20


def test_packing_prompts_bear_no_loss(spark):
    from quillstone.llm import packing
    from quillstone.llm.queries import END_ID, vocabulary

    rows = [(k, f"question {k} " * (k % 9), f"answer number {k} " * (1 + k % 5)) for k in range(200)] + [(200, None, None), (201, "only a prompt", "")]
    d = spark.createDataFrame(rows, "doc_id long, prompt string, text string")
    got = packing.pack_documents(d, vocabulary(), END_ID, max_tokens=64, max_segments=4, max_loss=24, prompt_col="prompt").collect()
    whole = {k: plain_ids([p])[0][:-1] + plain_ids([t])[0] for k, p, t in rows}
    replies = {k: len(plain_ids([t])[0]) for k, _, t in rows}
    sequences, loss, seen = Counter(), Counter(), Counter()
    for r in got:
        assert r.ids_crc32 == zlib.crc32(np.array(whole[r.doc_id][r.start : r.start + r.length], "<u4").tobytes())
        assert r.loss_tokens == min(r.length, max(0, r.start + r.length - (len(whole[r.doc_id]) - replies[r.doc_id])))
        sequences[r.sequence_id] += r.length
        loss[r.sequence_id] += r.loss_tokens
        seen[r.doc_id] += r.length
    assert max(sequences.values()) <= 64 and max(loss.values()) == 24 and seen == Counter({k: len(v) for k, v in whole.items()})
