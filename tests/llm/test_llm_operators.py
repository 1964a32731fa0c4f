import datetime
import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quillstone.llm import chat, components, mixing, ngram_lm, packing, pii, quality, simhash, tiff, token_files, vectors
from quillstone.llm.queries import END_ID, queries, vocabulary
from quillstone.llm.wordtok import PieceTokenizer

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double"
LONG = " ".join(f"wörter{k % 911} The, end." for k in range(20_000))


@pytest.fixture(scope="module")
def docs(spark):
    """Nulls in every column, empty, blank and very long texts, repeated rows, and an extra column named like a result."""
    rows = [(k, f"Some words {k} are here, and {k % 7} more. Mail bob.{k}@mail.example.com", "en", "hot" if k % 3 else f"s{k % 5}", 1, 0.5) for k in range(40)]
    rows += [(40, None, None, None, None, None), (41, "", "en", "hot", 0, 0.1), (42, " \n\t ", "en", "hot", 0, 0.1), (43, LONG, "de", "hot", 1, 0.2), (44, LONG, "de", "s1", 1, 0.2)]
    rows += [(None, "no id here", "en", "hot", 3, 0.0), rows[0], rows[0]]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def rows_of(docs):
    return [(r.doc_id, r.text) for r in docs.collect()]


def plain_ids(texts):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(vocabulary())
    return [tok.encode(t or "", add_special_tokens=False).ids + [END_ID] for t in texts]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


# Tokens, files, packing.
def test_piece_tokenizer_equals_the_library():
    texts = ["İSTANBUL Ångström Å ΣΑΣ, Σ.", "don't we'll .. a., b,, x?! 12,5 ½.", "<|endoftext|> a<|startoftext|>b", "tab\tand\r\nline  two", "", None, "é \x1c q", LONG[:5000]]
    tok = PieceTokenizer(vocabulary(), END_ID, max_pieces=50)
    for _ in range(2):
        ids, n = tok.encode(texts)
        assert [p.tolist() for p in np.split(ids, np.cumsum(n)[:-1])] == plain_ids(texts)


def test_token_files_round_trip(spark, docs, none):
    manifest = token_files.write_token_files(docs, vocabulary(), END_ID, seq_len=64, batch_rows=8, shards=4)
    got = sorted((r.start, -1 if r.doc_id is None else r.doc_id, r.n_tokens, r.ids_crc32) for r in token_files.read_documents(manifest).collect())
    want, start = [], 0
    for key, text in sorted(rows_of(docs), key=lambda r: (-1 if r[0] is None else r[0])):
        ids = plain_ids([text])[0]
        want.append((start, -1 if key is None else key, len(ids), crc(ids)))
        start += len(ids)
    assert got == want
    shard = token_files.TokenShard(manifest.orderBy(F.desc("n_tokens")).first().path)
    ids, mask = shard.sequence(len(shard) - 1)
    assert len(ids) == 64 and not ids.flags.owndata and np.array_equal(shard.sequence(9)[0], shard.ids()[9 * 64 : 10 * 64])
    assert (ids[~mask] == 0).all()
    assert token_files.read_documents(token_files.write_token_files(none, vocabulary(), END_ID)).count() == 0


def test_packing_places_every_id_once(docs, none):
    got = packing.pack_documents(docs, vocabulary(), END_ID, max_tokens=512, max_segments=4).collect()
    by_sequence, by_doc = {}, {}
    for r in got:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length, r.padded_length))
        by_doc.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, r.length, r.ids_crc32))
    for parts in by_sequence.values():
        parts.sort()
        assert [o for o, _, _ in parts] == [sum(n for _, n, _ in parts[:k]) for k in range(len(parts))]
        total = sum(n for _, n, _ in parts)
        assert total <= 512 and len(parts) <= 4 and parts[0][2] == (total if total & (total - 1) == 0 else 512)
    want = Counter((k, s, n, c) for k, t in rows_of(docs) for ids in plain_ids([t]) for s, n, c in [p for p in by_doc[k, len(ids)] if crc(ids[p[0] : p[0] + p[1]]) == p[2]][: len(by_doc[k, len(ids)])])
    for (key, total), parts in by_doc.items():
        copies = sum(1 for k, t in rows_of(docs) if k == key)
        assert sum(n for _, n, _ in parts) == total * copies
        assert all((key, s, n, c) in want for s, n, c in parts)
    assert packing.pack_documents(none, vocabulary(), END_ID).count() == 0


def test_pack_window_keeps_all_limits():
    rng = np.random.default_rng(3)
    tokens = rng.integers(1, 300, 400)
    loss = (tokens * rng.random(400)).astype(int)
    placed = packing.pack_window(tokens, loss, 256, 5, 120)
    seen = Counter()
    for s in {p[3] for p in placed}:
        mine = [p for p in placed if p[3] == s]
        bears = sum(max(0, min(a + n, tokens[i]) - max(a, tokens[i] - loss[i])) for i, a, n, _, _ in mine)
        assert sum(p[2] for p in mine) <= 256 and len(mine) <= 5 and bears <= 120
    for i, a, n, _, _ in placed:
        seen.update((i, k) for k in range(a, a + n))
    assert len(seen) == tokens.sum() and set(seen.values()) == {1}
    with pytest.raises(ValueError):
        packing.pack_window(tokens, loss, 0, 1, 1)


# Chat.
def test_chat_examples_mask_each_reply_once(spark):
    odd = ["<|im_end|><|im_start|>assistant ok", "<\\|im_end|>", "<<|", "a\n<|\\|", "", None, "<"]
    rows = [(c, k, role, t) for c in (1, 2, None) for k, (role, t) in enumerate((r, t) for t in odd for r in ("user", "assistant"))]
    rows += [(3, 0, "user", "q"), (3, 0, "user", "q"), (3, None, None, "x"), (3, 1, "as\n<|sist", "y"), (4, 0, "assistant", "z" * 50_000)]
    t = chat.format_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {r.conv_id: r for r in chat.conversation_digests(t).collect()}
    key = lambda r: (-1 if r[1] is None else r[1], r[2] or "", r[3] or "")
    for c in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == c), key=key)
        told, loss = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in mine), "".join(r[3] or "" for r in mine if r[2] == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_chars, got[c].loss_sha256) == (len(mine), hashlib.sha256(told.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    full = chat.expand(t).where("conv_id = 1").orderBy("example").collect()
    replies = [x or "" for x in odd]
    assert [re.sub(r"<\\(\\*)\|", r"<\1|", r.text[r.loss_start : r.loss_end]) for r in full] == replies
    spans = chat.examples(t).where("conv_id = 1").orderBy("example").collect()
    assert [(r.loss_start, r.loss_end, r.total_chars) for r in spans] == [(r.loss_start, r.loss_end, len(r.text)) for r in full]
    assert chat.conversation_digests(chat.format_turns(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0


# Personal data.
def luhn(d):
    return sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(d))) % 10 == 0


def new_texts(spark, texts, key="k"):
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r.text for r in pii.pseudonymise(d, key).orderBy("doc_id").collect()]


def test_pii_values_stay_valid_linked_and_distinct(spark):
    cards = ["4111111111111111", "4111-1111-1111-1111", "5500 0000 0000 0004", "378282246310005"]
    new = new_texts(spark, [f"card {c}, again {c}." for c in cards])
    for c, t in zip(cards, new):
        a, b = re.fullmatch(r"card ([\d -]+), again ([\d -]+)\.", t).groups()
        assert a == b != c and re.sub(r"\d", "0", a) == re.sub(r"\d", "0", c) and luhn(re.sub(r"\D", "", a)) and a[0] == c[0]
    days = [str(datetime.date(2023, 1, 1) + datetime.timedelta(k)) for k in range(400)]
    moved = new_texts(spark, days)
    assert len(set(moved)) == 400 and all(datetime.date.fromisoformat(d).year in range(1900, 2100) for d in moved) and sum(a == b for a, b in zip(days, moved)) < 3
    addresses = [f"10.0.{k // 256}.{k % 256}" for k in range(300)]
    hidden = new_texts(spark, addresses)
    assert len(set(hidden)) == 300 and all(max(map(int, a.split("."))) < 256 for a in hidden)
    ssns = new_texts(spark, [f"{a:03d}-01-0001" for a in (1, 665, 667, 899)])
    assert len(set(ssns)) == 4 and all(re.fullmatch(r"(?!000|666|9)\d{3}-(?!00)\d\d-(?!0000)\d{4}", s) for s in ssns)
    mail, phone = new_texts(spark, ["write Bob.Smith9@mail8.example.com now", "call +1 (988) 555-2485, ok"])
    assert re.fullmatch(r"write [A-Z][a-z]{2}\.[A-Z][a-z]{4}\d@mail8\.example\.com now", mail) and "Bob" not in mail
    assert re.fullmatch(r"call \+1 \([2-9]\d\d\) [2-9]\d\d-\d{4}, ok", phone) and "988" not in phone
    iban = new_texts(spark, ["DE89370400440532013000", "GB82 WEST 1234 5698 7654 32"])
    for s, old in zip(iban, ("DE89370400440532013000", "GB82 WEST 1234 5698 7654 32")):
        p = s.replace(" ", "")
        assert s != old and int("".join(str(int(c, 36)) for c in p[4:] + p[:4])) % 97 == 1 and re.sub(r"[A-Z]", "A", re.sub(r"\d", "0", s)) == re.sub(r"[A-Z]", "A", re.sub(r"\d", "0", old))
    assert new_texts(spark, ["4111111111111111"], "k") != new_texts(spark, ["4111111111111111"], "other")


def test_pii_leaves_what_does_not_validate(spark, docs, none):
    clean = ["4111111111111112", "2023-02-30", "999.1.1.1", "666-12-1234", "DE00370400440532013000", "version 3.", "a @ b", "1234", "", "13/13/2020"]
    assert new_texts(spark, clean) == clean
    out = pii.pseudonymise(docs, "k", count_col="n")
    got = {(r.doc_id, r.lang, r.score): (r.text, r.n) for r in out.collect()}
    assert out.columns == [*docs.columns, "n"] and out.count() == docs.count()
    assert got[40, None, None] == (None, 0) and got[41, "en", 0.1] == ("", 0) and got[43, "de", 0.2] == (LONG, 0) and got[5, "en", 0.5][1] == 1
    assert pii.pseudonymise(none, "k").count() == 0
    both = new_texts(spark, ["12/31/2020", "5/6/2021", "31/12/2020", "31.12.2020"])
    assert all(re.fullmatch(r"\d{1,2}[/.]\d{1,2}[/.]\d{4}", d) for d in both) and int(both[2][:2]) > 12
    with pytest.raises(ValueError):
        pii.pseudonymise(docs, "")


# SimHash and components.
def plain_fingerprint(text, n):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[k : k + n]) for k in range(max(1, len(words) - n + 1))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(nodes, linked):
    label = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return label


def test_fingerprints_and_spark_hash_agree(spark, docs):
    for r in docs.select("text", simhash.fingerprints("text").alias("fp")).collect():
        assert r.fp & (1 << 64) - 1 == plain_fingerprint(r.text, 3)
    assert spark.range(1).select(F.xxhash64(F.lit("a b c")).alias("h")).first().h & (1 << 64) - 1 == xxhash.xxh64_intdigest(b"a b c", 42)


@pytest.mark.parametrize("bits", range(4))
def test_every_pair_within_the_radius_meets(bits):
    masks, rng = simhash.covering_masks(list(range(64)), 3), np.random.default_rng(bits)
    assert len(masks) == 15
    for _ in range(300):
        flips = sum(1 << int(p) for p in rng.choice(64, bits, replace=False))
        assert any(flips & m == 0 for m in masks)


@pytest.mark.parametrize("cap", [4096, 3])
def test_fingerprint_components_match_brute_force(spark, cap):
    rng = np.random.default_rng(5)
    base = [int(x) for x in rng.integers(0, 1 << 63, 20)]
    fps = sorted({b ^ sum(1 << int(p) for p in rng.choice(64, rng.integers(0, 9), replace=False)) for b in base for _ in range(25)} | {0})
    linked = [(a, b) for k, a in enumerate(fps) for b in fps[k + 1 :] if (a ^ b).bit_count() <= 3]
    table = spark.createDataFrame([(int(np.uint64(f).astype(np.int64)),) for f in fps], "fp long")
    links = [(a & (1 << 64) - 1, b & (1 << 64) - 1) for a, b in simhash.fingerprint_links(table, 3, cap).collect()]
    assert set(links) and all((a ^ b).bit_count() <= 64 for a, b in links)
    assert plain_components(fps, links) == plain_components(fps, linked)


def test_near_duplicates_edge_cases(spark, docs, none):
    got = {}
    for r in simhash.near_duplicates(docs).collect():
        got.setdefault(r.doc_id, set()).add((r.fp, r.component_id))
    assert all(len(v) == 1 for v in got.values()) and simhash.near_duplicates(docs).count() == docs.count()
    assert got[40] == got[41] == got[42] == {(0, 40)} and {c for _, c in got[44]} == {43}
    assert simhash.near_duplicates(none).count() == 0


def test_components_of_a_long_chain_and_a_hub(spark):
    edges = [(k, k + 1) for k in range(60)] + [(1000, k) for k in range(1001, 1200)] + [(5, 5), (7, None)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(61)}, **{k: 1000 for k in range(1000, 1200)}}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# Language model.
def test_language_model_against_plain_counts(spark, docs, none):
    got = ngram_lm.score_documents(docs, F.col("doc_id") % 7 == 2, F.col("doc_id") % 7 == 3, block_tokens=3_000).collect()
    texts = [(k, (t or "").encode().lower().split() + [None]) for k, t in rows_of(docs)]
    train = [w for k, w in texts if k is None or k % 7 != 2]
    c = Counter(x for w in train for x in w)
    n, v = sum(c.values()), len(c)
    want = {k: (len(w), sum(c[x] > 0 for x in w), sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w)) for k, w in texts}
    assert len(got) == len(texts)
    for r in got:
        tokens, known, base = want[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (tokens, known, n, r.doc_id is not None and r.doc_id % 7 == 2)
        assert r.base_score == pytest.approx(base) and r.score < 0
    out = [r for r in got if r.held_out and r.n_tokens > 3]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)
    assert ngram_lm.score_documents(none, F.col("doc_id") % 7 == 2, F.col("doc_id") % 7 == 3).count() == 0


# Vectors.
@pytest.mark.parametrize("cap", [1024, 8])
def test_vector_links_match_brute_force(spark, cap):
    rng = np.random.default_rng(1)
    base = rng.standard_normal((30, 16))
    x = np.concatenate([base[k % 30] + 0.08 * rng.standard_normal(16) for k in range(240)]).reshape(-1, 16)
    rows = [(k, v.tolist(), 1) for k, v in enumerate(x)] + [(500 + k, x[0].tolist(), k) for k in range(40)]
    bad = [(900, None, 1), (901, [0.0] * 16, 1), (902, [math.nan] * 16, 1), (903, [1.0, None] * 8, 1), (904, [math.inf] * 16, 1), (905, [], 1), (906, [1.0, 2.0], None), (None, x[0].tolist(), 1)]
    d = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>, label int").withColumn("kept", F.lit("clash"))
    got = {r.vec_id: r for r in vectors.embedding_duplicates(d, max_bucket=cap).collect()}
    ids, m = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    m /= np.linalg.norm(m, axis=1)[:, None]
    near = (m @ m.T) >= 0.95
    found, exact = sum(got[k].n_links for k in ids), near.sum() - len(ids)
    assert exact * 0.98 <= found <= exact
    label = plain_components(ids.tolist(), [(int(ids[i]), int(ids[j])) for i, j in np.argwhere(near)])
    assert np.mean([got[k].component_id == label[k] for k in label]) > 0.98
    for k in range(900, 907):
        assert (got[k].n_links, got[k].component_id, got[k].kept) == (0, k, True)
    assert (got[None].n_links, got[None].component_id, got[None].kept) == (0, None, False) and len(got) == len(rows + bad)
    assert vectors.embedding_duplicates(d.limit(0)).count() == 0


# Mixing.
def test_mixture_meets_its_limits(spark, none):
    d = spark.createDataFrame([(k, "w " * (k % 11 + 1), "big" if k % 10 else ("small" if k % 20 else None)) for k in range(4000)] + [(None, None, "big")], "doc_id long, text string, source string").withColumn("weight", F.lit("clash"))
    s = mixing.mixing_schedule(d, max_repeats=1.5, block_tokens=2_000).toPandas()
    full = {r.doc_id: (r.source or "", len((r.text or "").split()) + 1) for r in d.collect()}
    assert set(s.doc_id.astype("Int64").fillna(-1)) == {-1 if k is None else k for k in full}
    budget = s.n_tokens.sum()
    for name, part in s.groupby("source"):
        own = sum(n for src, n in full.values() if src == name)
        r = part.repeats.iloc[0]
        assert 1 <= r <= 1.5 + 1e-6 and abs(part.n_tokens.sum() - r * own) <= 13 and part.weight.iloc[0] == pytest.approx(part.n_tokens.sum() / budget, abs=0.002)
    assert s.repeats.max() == pytest.approx(1.5, abs=1e-3)
    for _, block in s.groupby("block"):
        assert sorted(block.position) == list(range(len(block))) and block.n_tokens.sum() < 3_500
    mixed = mixing.mix_documents(d, max_repeats=1.5)
    assert mixed.columns == d.columns and Counter(r.doc_id for r in mixed.collect()) == Counter(None if k == -1 else k for k in s.doc_id.astype("Int64").fillna(-1))
    flat = mixing.mixing_schedule(d, target_entropy=0.9, budget_tokens=5_000).toPandas()
    shares = flat.groupby("source").weight.first()
    assert -(shares * np.log(shares)).sum() == pytest.approx(0.9, abs=1e-4) and abs(flat.n_tokens.sum() - 5_000) < 40
    assert mixing.mixing_schedule(none, max_repeats=2.0).count() == 0 and mixing.mix_documents(none, max_repeats=2.0).count() == 0
    with pytest.raises(ValueError):
        mixing.mixing_schedule(d)


# TIFF.
@pytest.mark.parametrize("code", [tiff.NONE, tiff.LZW, tiff.DEFLATE, tiff.OLD_DEFLATE, tiff.PACKBITS])
@pytest.mark.parametrize("tile", [0, 16])
@pytest.mark.parametrize("big", [False, True])
def test_tiff_pages_round_trip(code, tile, big):
    rng = np.random.default_rng(code + tile)
    pages = [rng.integers(0, 9, (75, 41)).astype(np.uint8), (np.arange(90 * 64) % 251).astype(np.uint8).reshape(90, 64), rng.integers(0, 256, (200, 100)).astype(np.uint8)]
    for predictor in (1, 2):
        raw = tiff.write_pages([(p, code, predictor, tile) for p in pages], strip_bytes=300, big_endian=big)
        back = list(tiff.read_pages(raw))
        assert len(back) == 3 and all(np.array_equal(a, b[:, :, 0]) for a, b in zip(pages, back))


def test_broken_tiff_is_an_error_row(spark, docs, none):
    good = tiff.write_pages([(np.zeros((3, 4), np.uint8), tiff.DEFLATE, 1, 0)])
    rows = [(1, 1, bytearray(b"nothing")), (2, 1, bytearray(good[:20])), (3, 1, None), (4, 1, bytearray(good))]
    got = {r.doc_id: r for r in tiff.tiff_pages(spark.createDataFrame(rows, "doc_id long, n_bytes long, media binary")).collect()}
    assert all(got[k].error and got[k].page is None for k in (1, 2, 3)) and got[4].error is None and got[4].payload_bytes == 12
    pages = tiff.tiff_pages(tiff.text_media(docs)).where("page = 0").collect()
    want = Counter()
    for k, t in rows_of(docs):
        raw = (t or "").encode()
        pay = raw.ljust(max(1, -(-len(raw) // 192)) * 192, b" ")
        want[k, len(raw), len(pay), hashlib.sha256(pay).hexdigest(), zlib.crc32(pay[-16:])] += 1
    assert Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in pages) == want
    assert tiff.tiff_pages(tiff.text_media(none)).count() == 0


# Quality.
def test_quality_learns_and_handles_nulls(spark, docs, none):
    good, bad = "the plain words of a text that reads well number", "click | now %%% buy | $$$ | cheap"
    d = spark.createDataFrame([(k, (good if k % 2 else bad) + f" {k}") for k in range(400)] + [(1000, None), (1001, "")], "doc_id long, text string").withColumn("quality", F.lit(7))
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(200)] + [(None, 1, 0), (201, None, 0), (5000, 1, 0), (3, 1, 0)], "doc_id long, quality int, toxic int")
    w = quality.train_quality_model(d, labels, bits=14)
    s = {r.doc_id: r.s for r in d.select("doc_id", quality.quality_score(d, w).alias("s")).collect()}
    assert all((s[k] > 0.5) == (k % 2 == 1) for k in range(200, 400)) and s[1000] == s[1001]
    assert np.array_equal(w, quality.train_quality_model(d, labels, bits=14))
    zero = quality.train_quality_model(none, labels, bits=8)
    assert not zero.any() and {r.s for r in docs.select(quality.quality_score(docs, zero).alias("s")).collect()} == {0.5}


def test_queries_are_complete():
    assert [re.match(r"op(\d+)_", n)[1] for n in queries()] == [str(k) for k in range(1, 11)]
