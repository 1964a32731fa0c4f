"""Deleted interpolation: a bigram language model over whole texts.

P(w | v) = a c(v w) / c(v) + b c(w) / N + (1 - a - b) / (V + 1), where the weights depend on the bucket of the context's
frequency c(v) and are learned by expectation-maximisation on a held-out part of the training documents, whose n-grams
are taken out of the counts for that; the final model then counts all training documents.

Texts become blocks of documents with word numbers. Each block sends its distinct n-grams, as sorted 64-bit hashes with
counts, to hash buckets; a bucket adds up and sends each block the counts of its own n-grams, in the same order. So
what is shuffled is compressed arrays, a frequent word costs one entry a block, and texts and tokens never meet in one
task. The number of buckets grows with the tokens, which bounds what a task holds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.llm.store import n_buckets, released, save, small_batches

END = b" "  # no word holds a blank
EVAL, HELD, TRAIN = 0, 1, 2
CONTEXTS = 16
CELL = 8  # cells of the held-out ratios per factor of two
_BIGRAM_SHIFT = np.uint64(8)  # bigrams have 56-bit keys

_BLOCKS = "block long, fold int, doc_ids array<long>, lengths binary, words binary, tokens binary, n_tokens long"
_SENT = "bucket int, block long, fold int, uni binary, uni_n binary, bi binary, bi_n binary"
_COUNTED = "block long, fold int, bucket int, uni binary, uni_held binary, bi binary, bi_held binary, distinct long"


def _press(a: np.ndarray) -> bytes:
    """Length, width and the zstd-compressed byte planes of an unsigned array."""
    a = np.ascontiguousarray(a)
    planes = a.view(np.uint8).reshape(-1, a.itemsize).T.tobytes()
    return np.array([len(a), a.itemsize], "<i8").tobytes() + pa.Codec("zstd", 1).compress(planes, asbytes=True)


def _unpress(raw: bytes) -> np.ndarray:
    n, width = np.frombuffer(raw, "<i8", 2).tolist()
    if not n:
        return np.zeros(0, f"<u{width}")
    planes = np.frombuffer(pa.Codec("zstd").decompress(raw[16:], n * width, asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(width, n).T).view(f"<u{width}").ravel()


def _press_sorted(a: np.ndarray) -> bytes:
    return _press(np.diff(a, prepend=np.uint64(0)))


def _unpress_sorted(raw: bytes) -> np.ndarray:
    return np.cumsum(_unpress(raw), dtype=np.uint64)


class _Block:
    def __init__(self):
        self.index: dict[bytes, int] = {END: 0}
        self.ids: list = []
        self.lengths: list[int] = []
        self.tokens: list[np.ndarray] = []
        self.size = 0

    def add(self, ids: list, texts: list[str | None]) -> None:
        index, flat = self.index, []
        for text in texts:
            words = (text or "").encode().lower().split()
            flat += [index.setdefault(w, len(index)) for w in words]
            flat.append(0)
            self.lengths.append(len(words) + 1)
        self.ids += ids
        self.tokens.append(np.array(flat, np.uint32))
        self.size += len(flat)

    def row(self, block: int, fold: int) -> pa.RecordBatch:
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, self.index), np.uint64, len(self.index))
        return pa.record_batch({
            "block": pa.array([block]), "fold": pa.array([fold], pa.int32()), "doc_ids": pa.array([self.ids], pa.list_(pa.int64())),
            "lengths": pa.array([_press(np.array(self.lengths, np.uint32))], pa.binary()), "words": pa.array([_press(hashes)], pa.binary()),
            "tokens": pa.array([_press(np.concatenate(self.tokens))], pa.binary()), "n_tokens": pa.array([self.size]),
        })


def _blocks(block_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, open_ = TaskContext.get().partitionId() << 32, {}
        for b in batches:
            folds = b.column("fold").to_numpy()
            for k in range(0, b.num_rows, 512):
                part, fold = b.slice(k, 512), folds[k : k + 512]
                for f in np.unique(fold).tolist():
                    mine = part.filter(pa.array(fold == f))
                    block = open_.setdefault(f, _Block())
                    block.add(mine.column("doc_id").to_pylist(), mine.column("text").to_pylist())
                    if block.size >= block_tokens:
                        yield open_.pop(f).row(number, f)
                        number += 1
        for f in sorted(open_):
            yield open_[f].row(number, f)
            number += 1

    return released(run)


def _bigrams(words: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """The key of each token with the token before it; documents begin after an end."""
    h = words[tokens]
    before = np.concatenate([words[:1], h[:-1]])
    key = before * np.uint64(0x9E3779B97F4A7C15) + h
    key = (key ^ key >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return (key ^ key >> np.uint64(29)) >> _BIGRAM_SHIFT


def _cuts(keys: np.ndarray, buckets: int, bits: int) -> np.ndarray:
    """Where each bucket begins in sorted keys; buckets are ranges of the keys' highest bits."""
    edges = np.array([(k << bits) // buckets for k in range(1, buckets)], np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])


def _send(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                words, tokens = _unpress(r["words"]), _unpress(r["tokens"])
                order = np.argsort(words)
                uni, uni_n = words[order], np.bincount(tokens, minlength=len(words))[order].astype(np.uint32)
                bi, bi_n = np.unique(_bigrams(words, tokens), return_counts=True)
                bi_n = bi_n.astype(np.uint32)
                u, v = _cuts(uni, buckets, 64), _cuts(bi, buckets, 56)
                parts = [(_press_sorted(uni[u[k] : u[k + 1]]), _press(uni_n[u[k] : u[k + 1]]), _press_sorted(bi[v[k] : v[k + 1]]), _press(bi_n[v[k] : v[k + 1]])) for k in range(buckets)]
                columns = [pa.array(c, pa.binary()) for c in zip(*parts)]
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(buckets), pa.int32()), pa.array([r["block"]] * buckets), pa.array([r["fold"]] * buckets, pa.int32()), *columns], ["bucket", "block", "fold", "uni", "uni_n", "bi", "bi_n"])

    return released(run)


def _add_up(keys: list[np.ndarray], counts: list[np.ndarray], folds: list[int]) -> tuple[list[bytes], list[bytes], int]:
    stops = np.cumsum([len(k) for k in keys])
    _, at = np.unique(np.concatenate(keys), return_inverse=True)
    n, fold = np.concatenate(counts).astype(np.float64), np.repeat(folds, [len(k) for k in keys])
    train = np.bincount(at, weights=n * (fold != EVAL)).astype(np.uint64)
    held = np.bincount(at, weights=n * (fold == HELD)).astype(np.uint64)
    mine = np.split(at, stops[:-1])
    return [_press(train[m]) for m in mine], [_press(held[m]) for m in mine], int(np.count_nonzero(train))


def _count(table: pa.Table) -> pa.Table:
    t = table.to_pydict()
    uni, uni_held, distinct = _add_up([_unpress_sorted(x) for x in t["uni"]], [_unpress(x) for x in t["uni_n"]], t["fold"])
    bi, bi_held, _ = _add_up([_unpress_sorted(x) for x in t["bi"]], [_unpress(x) for x in t["bi_n"]], t["fold"])
    binary = lambda x: pa.array(x, pa.binary())
    return pa.table({
        "block": table.column("block"), "fold": table.column("fold"), "bucket": table.column("bucket"), "uni": binary(uni), "uni_held": binary(uni_held),
        "bi": binary(bi), "bi_held": binary(bi_held), "distinct": pa.array([distinct] + [0] * (len(uni) - 1), pa.int64()),
    })


def _per_token(block: dict, counts: pa.Table, names: tuple[str, str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each token of a block: the counts of its bigram, of the token before and of itself."""
    rows = counts.sort_by("bucket")
    uni, bi = (np.concatenate([_unpress(x) for x in rows.column(n).to_pylist()]).astype(np.int64) for n in names)
    words, tokens = _unpress(block["words"]), _unpress(block["tokens"])
    by_word = np.empty(len(words), np.int64)
    by_word[np.argsort(words)] = uni
    _, at = np.unique(_bigrams(words, tokens), return_inverse=True)
    return bi[at], by_word[np.concatenate([[0], tokens[:-1]])], by_word[tokens]


def context_bucket(c: np.ndarray) -> np.ndarray:
    """0 for a context that was never seen, then one bucket a factor of two."""
    return np.minimum(np.frexp(c.astype(float))[1], CONTEXTS - 1)


def _held_out_cells(n_kept: int, n_types: int):
    def run(blocks: pa.Table, counts: pa.Table) -> pa.Table:
        schema = pa.schema([("context", pa.int32()), ("r2", pa.int32()), ("r1", pa.int32()), ("n", pa.int64())])
        if not blocks.num_rows or not counts.num_rows:
            return schema.empty_table()
        block = blocks.to_pylist()[0]
        kept = [a - h for a, h in zip(_per_token(block, counts, ("uni", "bi")), _per_token(block, counts, ("uni_held", "bi_held")))]
        both, before, own = kept
        ratio = lambda f: np.where(f > 0, np.round(np.log2(np.maximum(f, 1e-300) * (n_types + 1)) * CELL), -(1 << 20)).astype(np.int64)
        r2, r1 = ratio(both / np.maximum(before, 1)), ratio(own / max(n_kept, 1))
        cell, n = np.unique(np.stack([context_bucket(before), r2, r1]), axis=1, return_counts=True)
        return pa.table([pa.array(c, pa.int32()) for c in cell] + [pa.array(n, pa.int64())], schema=schema)

    return run


def _score(weights: np.ndarray, n_train: int, n_types: int):
    def run(blocks: pa.Table, counts: pa.Table) -> pa.Table:
        block = blocks.to_pylist()[0]
        both, before, own = _per_token(block, counts, ("uni", "bi"))
        lengths = _unpress(block["lengths"]).astype(np.int64)
        first = np.cumsum(lengths) - lengths
        w = weights[context_bucket(before)]
        p = w[:, 0] * (both / np.maximum(before, 1)) + w[:, 1] * (own / max(n_train, 1)) + w[:, 2] / (n_types + 1)
        total = lambda x: np.add.reduceat(x, first)
        return pa.table({
            "doc_id": pa.array(block["doc_ids"], pa.int64()), "held_out": pa.array(np.full(len(lengths), block["fold"] == EVAL)), "n_tokens": lengths,
            "n_known": total((own > 0).astype(np.int64)), "base_score": total(np.log10((own + 1) / (n_train + n_types + 1))), "score": total(np.log10(p)),
        })

    return run


def learn_weights(cells: DataFrame, rounds: int = 12) -> np.ndarray:
    """EM over held-out cells (context, r2, r1, n): rows are context buckets, columns the weights of the bigram, the word
    and the uniform part. Each round is one grouped sum, of which the driver gets a row a bucket."""
    w = np.tile([0.4, 0.5, 0.1], (CONTEXTS, 1))
    w[0] = [0.0, 0.9, 0.1]
    f2, f1 = (F.when(F.col(c) > -(1 << 20), F.pow(F.lit(2.0), F.col(c) / CELL)).otherwise(0.0) for c in ("r2", "r1"))
    cells = cells.select("context", "n", f2.alias("f2"), f1.alias("f1"))
    for _ in range(rounds):
        a, b, c = (F.get(F.array(*(F.lit(float(x)) for x in w[:, k])), F.col("context")) for k in range(3))
        parts = cells.select("context", "n", (a * F.col("f2")).alias("p2"), (b * F.col("f1")).alias("p1"), c.alias("p0"))
        all_ = F.col("p2") + F.col("p1") + F.col("p0")
        sums = parts.groupBy("context").agg(*(F.sum(F.col("n") * F.col(p) / all_).alias(p) for p in ("p2", "p1", "p0"))).collect()
        for r in sums:
            share = np.array([r.p2, r.p1, r.p0]) + [1e-6, 1e-6, 1e-3]  # no part of the mixture ever vanishes
            w[r.context] = share / share.sum()
        w[0, 0] = 0.0
        w /= w.sum(axis=1, keepdims=True)
    return w


def score_documents(docs: DataFrame, held_out: Column, deleted: Column, id_col: str = "doc_id", text_col: str = "text", block_tokens: int = 4_000_000, bucket_tokens: int = 16_000_000) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, base_score, score, train_tokens) for every row, scores in log10.

    ``held_out`` rows are only scored; of the others, ``deleted`` ones are those that the mixture weights are learned from.
    A condition that is null counts as false. Words are separated by ASCII white space, A-Z are lowered, and each text
    ends with one end token; null and empty texts are that token alone. Repeated rows are counted and scored each. An
    empty table gives no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    fold = F.when(held_out, EVAL).when(deleted, HELD).otherwise(TRAIN)
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), fold.alias("fold"))
    blocks = save(d.mapInArrow(_blocks(block_tokens), _BLOCKS), "lm-blocks", compression="none")
    sums = blocks.agg(*(F.coalesce(F.sum(F.when(F.col("fold") == f, F.col("n_tokens"))), F.lit(0)) for f in (HELD, TRAIN, EVAL))).first()
    buckets = max(n_buckets(spark), -(-sum(sums) // bucket_tokens))
    sent = blocks.select("block", "fold", "words", "tokens").mapInArrow(_send(buckets), _SENT)
    counts = save(sent.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(_count, _COUNTED), "lm-counts", compression="none")
    n_types = counts.agg(F.coalesce(F.sum("distinct"), F.lit(0))).first()[0]
    held = [t.where(F.col("fold") == HELD).groupBy("block") for t in (blocks.select("block", "fold", "words", "tokens"), counts)]
    cells = held[0].cogroup(held[1]).applyInArrow(_held_out_cells(sums[1], n_types), "context int, r2 int, r1 int, n long")
    weights = learn_weights(save(cells.groupBy("context", "r2", "r1").agg(F.sum("n").alias("n")), "lm-cells"))
    n_train = sums[0] + sums[1]
    scored = blocks.groupBy("block").cogroup(counts.select("block", "bucket", "uni", "bi").groupBy("block"))
    made = scored.applyInArrow(_score(weights, n_train, n_types), "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return made.withColumn("train_tokens", F.lit(n_train).cast("long"))
