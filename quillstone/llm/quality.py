"""Quality classifier: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader updates.

Features are counts of words and of adjacent word pairs, hashed to ``2**bits`` slots and scaled to unit length; a word
is a run of letters and digits or a run of one other kind of character. Training takes at most ``max_rows`` labelled rows,
those with the smallest keyed hash of their id, so its cost doesn't grow with the corpus; scoring is one sparse dot
product a document.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.llm.store import released, small_batches

_WORD = re.compile(rb"[a-z0-9\x80-\xff]+|[^\sa-z0-9\x80-\xff]+")
_hashes: dict[bytes, int] = {}


def features(texts: list[str | None], bits: int, max_cached: int = 200_000) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slots and values of each text, one text after another, and the number of slots of each."""
    if len(_hashes) > max_cached:
        _hashes.clear()
    words: list[bytes] = []
    stops = np.empty(len(texts), np.int64)
    for k, t in enumerate(texts):
        if t:
            words += _WORD.findall(t.encode().lower())
        stops[k] = len(words)
    for w in set(words).difference(_hashes):
        _hashes[w] = xxhash.xxh64_intdigest(w)
    h = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    doc = np.repeat(np.arange(len(texts)), np.diff(stops, prepend=0))
    inside = doc[1:] == doc[:-1]
    pairs = (h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:])[inside]
    pairs ^= pairs >> np.uint64(31)
    slot = np.concatenate([h, pairs * np.uint64(0xD6E8FEB86659FD93)]) >> np.uint64(64 - bits)
    code = np.concatenate([doc, doc[1:][inside]]) << bits | slot.astype(np.int64)
    code, count = np.unique(code, return_counts=True)
    doc, slot = code >> bits, code & (1 << bits) - 1
    size = np.bincount(doc, weights=np.square(count, dtype=float), minlength=len(texts))
    return slot, count / np.sqrt(size)[doc], np.bincount(doc, minlength=len(texts))


def train_ftrl(rows: Iterator[tuple[np.ndarray, np.ndarray, int]], bits: int, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.001, l2: float = 0.1) -> np.ndarray:
    """Per-coordinate FTRL-proximal over (slots, values, label); the last weight is the bias."""
    z, n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)

    def weight(i):
        return np.where(np.abs(z[i]) <= l1, 0.0, -(z[i] - np.sign(z[i]) * l1) / ((beta + np.sqrt(n[i])) / alpha + l2))

    for slot, value, label in rows:
        i, x = np.append(slot, 1 << bits), np.append(value, 1.0)
        w = weight(i)
        p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
        g = (p - label) * x
        z[i] += g - (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha * w
        n[i] += g * g
    return weight(np.arange(len(z))).astype(np.float32)


def _feature_rows(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            slot, value, n = features(b.column("text").to_pylist(), bits)
            stop = np.cumsum(n)
            cut = lambda a, kind: pa.array([a[s - k : s].astype(kind).tobytes() for s, k in zip(stop, n)], pa.binary())
            yield pa.record_batch({"key": b.column("key"), "label": b.column("label"), "slots": cut(slot, "<i4"), "values": cut(value, "<f4")})
        _hashes.clear()

    return released(run)


def _trainer(bits: int, epochs: int):
    def run(table: pa.Table) -> pa.Table:
        t = table.sort_by("key")
        rows = list(zip(t.column("slots").to_pylist(), t.column("values").to_pylist(), t.column("label").to_pylist()))
        stream = ((np.frombuffer(s, "<i4"), np.frombuffer(v, "<f4"), y) for _ in range(epochs) for s, v, y in rows)
        return pa.table({"weights": pa.array([train_ftrl(stream, bits).tobytes()], pa.binary())})

    return run


def train_quality_model(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", bits: int = 18, max_rows: int = 8_000, epochs: int = 2) -> np.ndarray:
    """Weights from ``labels`` (id, label 0 or 1) joined with the texts; at most ``max_rows`` rows are taken.

    Rows with a null id or label are left out, and so are ids without a text row. Of an id's repeated labels the
    smallest counts, and of its texts the first in order. Without any rows all weights are 0, so that every score is 0.5.
    """
    small_batches(docs.sparkSession)
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.min(label_col).cast("int").alias("label"))
    key = F.xxhash64("id")
    sample = known.withColumn("key", key).orderBy("key", "id").limit(max_rows)
    d = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = d.join(F.broadcast(sample), "id").groupBy("id", "key", "label").agg(F.min("text").alias("text")).select("key", "label", "text")
    made = rows.mapInArrow(_feature_rows(bits), "key long, label int, slots binary, values binary")
    row = made.groupBy(F.lit(0).alias("all")).applyInArrow(_trainer(bits, epochs), "weights binary").first()
    return np.frombuffer(row.weights, np.float32) if row else np.zeros((1 << bits) + 1, np.float32)


def quality_score(docs: DataFrame, weights: np.ndarray, text: str | Column = "text") -> Column:
    """The probability of label 1 for each whole text; null and empty texts have only the bias."""
    bits, shared = (len(weights) - 1).bit_length() - 1, docs.sparkSession.sparkContext.broadcast(weights)
    small_batches(docs.sparkSession)

    def scores(texts: pd.Series) -> pd.Series:
        w, out = shared.value, []
        for k in range(0, len(texts), 512):
            part = texts.iloc[k : k + 512].tolist()
            slot, value, n = features(part, bits)
            dot = np.bincount(np.repeat(np.arange(len(part)), n), weights=w[slot] * value, minlength=len(part)) + w[-1]
            out.append(1 / (1 + np.exp(-np.clip(dot, -35, 35))))
        return pd.Series(np.concatenate(out) if out else np.zeros(0))

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from released(lambda them: map(scores, them))(batches)
        _hashes.clear()

    return score(text)
