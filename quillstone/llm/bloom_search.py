"""Ranked lexical search over bit-sliced Bloom signatures.

``build_index`` puts texts of one size class into blocks of up to ``rows`` texts. A block has one bitmap of its texts a
signature bit: a term sets ``PROBES`` bits, and so does "this term at least 2, 3, 5, 9, ... times", so the bitmaps of a
term's bits, intersected, never miss a text that has the term so often. The same row has the exact terms and frequencies of
its texts, which only rescoring looks at. The index is a saved table.

``search`` goes over the index three times for a block of items. Once for the exact statistics of their terms. Once for
upper bounds, which add a term's weight times its greatest possible part for each slice that a text is in; the most
promising texts of each block of the index are scored exactly, and the 20th best score of all is an item's threshold. And
once more, to score exactly every text whose bound isn't below the threshold. No text is left out that might rank.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstone.llm.store import WIDE_ROWS, n_buckets, released, save, small_batches
from quillstone.llm.terms import row_words

#: Bits a term sets, bits a signature has for each entry (rounded up to a power of two), and frequencies with entries of their own.
PROBES, BITS = 3, 8
STEPS = np.array([1, 2, 3, 5, 9, 17, 33, 65, 129, 257])
#: Greatest number of ids and terms in a block's exact part: a longer text has a block for itself.
BLOCK_TERMS = 1 << 18
#: Terms and texts that are looked at together: at most so many cells of 8 bytes.
CELLS = 1 << 21
#: The most texts of a block of the index that are scored for an item to find its threshold.
PROMISING = 4

_INDEX_SQL = "bits long, slices binary, doc_id array<long>, length array<long>, stops array<long>, terms binary, counts binary"
_INDEX = pa.schema([("bits", pa.int64()), ("slices", pa.binary()), ("doc_id", pa.list_(pa.int64())), ("length", pa.list_(pa.int64())), ("stops", pa.list_(pa.int64())), ("terms", pa.binary()), ("counts", pa.binary())])


def places(terms: np.ndarray, step: int, bits: int) -> np.ndarray:
    """The signature bits of terms at one frequency: an array of ``PROBES`` columns."""
    h = terms + np.uint64(step * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    h = (h ^ h >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    a, b = h & np.uint64(0xFFFFFFFF), h >> np.uint64(32) | np.uint64(1)
    return (np.stack([a + np.uint64(k) * b for k in range(PROBES)], axis=1) & np.uint64(bits - 1)).astype(np.int64)


def _entries(counts: np.ndarray) -> int:
    return int(np.searchsorted(STEPS, counts, "right").sum())


def _block(texts: list[tuple], bits: int) -> dict:
    """A row of the index; texts are (doc_id, length, terms in order, counts)."""
    table = np.zeros((bits, -(-len(texts) // 8)), np.uint8)
    for k, (_, _, terms, counts) in enumerate(texts):
        for step in STEPS:
            some = terms[counts >= step]
            if not len(some):
                break
            table[places(some, int(step), bits).ravel(), k // 8] |= np.uint8(1 << k % 8)
    return {
        "bits": bits, "slices": table.tobytes(), "doc_id": [t[0] for t in texts], "length": [t[1] for t in texts],
        "stops": np.cumsum([len(t[2]) for t in texts]).tolist(), "terms": np.concatenate([t[2] for t in texts]).tobytes(), "counts": np.concatenate([t[3] for t in texts]).astype(np.uint32).tobytes(),
    }


def _indexed(rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list, int]] = {}  # by size of signature

        def made(bits: int) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([_block(held.pop(bits)[0], bits)], _INDEX)

        for b in batches:
            hashes, bounds = row_words(b.column("text"))
            for k, doc_id in enumerate(b.column("doc_id").to_pylist()):
                mine = hashes[bounds[k] : bounds[k + 1]]
                if not len(mine):
                    continue
                terms, counts = np.unique(mine, return_counts=True)
                bits = 1 << max(6, (BITS * _entries(counts) - 1).bit_length())
                texts, size = held.setdefault(bits, ([], 0))
                if texts and (size + len(terms) > BLOCK_TERMS or len(texts) == rows):
                    yield made(bits)
                    texts, size = [], 0
                texts.append((doc_id, len(mine), terms, counts))
                held[bits] = (texts, size + len(terms))
        for bits in list(held):
            yield made(bits)

    return released(run)


def build_index(docs: DataFrame, rows: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The saved index, one row a block of texts that have terms. Null ids and repeated rows are texts like others."""
    small_batches(docs.sparkSession)
    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return save(named.mapInArrow(_indexed(rows), _INDEX_SQL), "bloom-index", **WIDE_ROWS)


def _counted(terms: np.ndarray):
    """In how many texts of the task each of some sorted terms is; -1: all texts, -2: all their words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, texts, words = np.zeros(len(terms), np.int64), 0, 0
        for b in batches:
            for raw, length in zip(b.column("terms"), b.column("length")):
                t = np.frombuffer(raw.as_buffer(), np.uint64)
                at = np.minimum(np.searchsorted(terms, t), max(0, len(terms) - 1))
                if len(terms):
                    df += np.bincount(at[terms[at] == t], minlength=len(terms))
                texts, words = texts + len(length), words + sum(length.as_py())
        some = np.flatnonzero(df)
        yield pa.record_batch({"term": np.concatenate([some, [-1, -2]]), "n": np.concatenate([df[some], [texts, words]])})

    return released(run)


class Asked:
    """A block of items: sorted terms, integer weights, and a row of summed weights an item."""

    def __init__(self, items: list[tuple[int | None, np.ndarray]], terms: np.ndarray, df: np.ndarray, n: int, words: int):
        self.ids, self.n, self.words = [i for i, _ in items], n, words
        weight = [math.floor(1000 * math.log((2 * n + 2) / (2 * int(d) + 1))) for d in df]
        at = [np.unique(np.searchsorted(terms, own), return_counts=True) for _, own in items]
        sums = [times * np.array([weight[t] for t in a.tolist()], np.int64) for a, times in at]
        # Scores stay below 10^6 times these sums: doubles are exact, and quick, as far as they reach.
        self.kind = np.float64 if max(int(x.sum()) for x in sums) * 1_000_000 < 1 << 53 else np.int64
        self.terms, self.weights = terms, np.zeros((len(items), len(terms)), self.kind)
        for row, (a, _), x in zip(self.weights, at, sums):
            row[a] = x

    def norms(self, length: np.ndarray) -> np.ndarray:
        return 75 + 25 * length * self.n // self.words

    @staticmethod
    def part(times: np.ndarray | int, norm: np.ndarray) -> np.ndarray:
        return 1_000_000_000 * times // (1000 * times + 12 * norm)

    def bounds(self, bits: int, slices: bytes, length: np.ndarray) -> np.ndarray:
        """Upper bounds (item, text) of a block's texts."""
        table, norm, size = np.frombuffer(slices, np.uint8).reshape(bits, -1), self.norms(length), max(1, CELLS // len(length))
        return sum(self.weights[:, k : k + size] @ self._most(self.terms[k : k + size], table, length, norm) for k in range(0, len(self.terms), size))

    def _most(self, terms: np.ndarray, table: np.ndarray, length: np.ndarray, norm: np.ndarray) -> np.ndarray:
        """The greatest part (term, text) that the slices allow."""
        total, left, inside, before = np.zeros((len(terms), len(length)), self.kind), np.arange(len(terms)), None, 0
        for k, step in enumerate(STEPS):
            at = places(terms[left], int(step), len(table))
            having = reduce(np.bitwise_and, (table[at[:, j]] for j in range(PROBES)))
            inside = having if inside is None else inside & having
            some = inside.any(axis=1)
            left, inside = left[some], inside[some]
            if not len(left):
                break
            upto = self.part(np.minimum(length, STEPS[k + 1] - 1) if k + 1 < len(STEPS) else length, norm)
            total[left] += np.unpackbits(inside, axis=1, bitorder="little")[:, : len(length)] * (upto - before)
            before = upto
        return total

    def scores(self, which: np.ndarray, block: dict) -> np.ndarray:
        """Exact scores (item, text) of some texts of a block."""
        terms, counts = np.frombuffer(block["terms"], np.uint64), np.frombuffer(block["counts"], np.uint32)
        stops, size, out = block["stops"], max(1, CELLS // len(self.terms)), []
        for first in range(0, len(which), size):
            few = which[first : first + size]
            part = np.zeros((len(self.terms), len(few)), self.kind)
            for k, d in enumerate(few):
                own = slice(int(stops[d - 1]) if d else 0, int(stops[d]))
                at = np.searchsorted(self.terms, terms[own])
                at[at == len(self.terms)] = 0
                known = self.terms[at] == terms[own]
                part[at[known], k] = self.part(counts[own][known].astype(np.int64), self.norms(block["length"][d]))
            out.append((self.weights @ part).astype(np.int64))
        return np.concatenate(out, axis=1)


def _ranked(asked: Asked, top: int, least: np.ndarray | None):
    """The best texts of a task for each item, with exact scores. With ``least``, every text whose bound reaches an item's
    least score is scored; without, a few of each block are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[np.ndarray] = [np.zeros((0, 3), np.int64) for _ in asked.ids]  # score, doc_id, 1 if that is null
        for b in batches:
            for r in range(b.num_rows):
                block = {c: b.column(c)[r].as_py() for c in b.schema.names}
                block |= {c: np.array(block[c], np.int64) for c in ("length", "stops")}
                bound = asked.bounds(block["bits"], block["slices"], block["length"])
                if least is None:
                    few = min(PROMISING, bound.shape[1])
                    chosen = np.zeros(bound.shape, bool)
                    np.put_along_axis(chosen, np.argpartition(-bound, few - 1, axis=1)[:, :few], True, axis=1)
                else:
                    chosen = (bound >= least[:, None]) & (bound > 0)
                which = np.flatnonzero(chosen.any(axis=0))
                if not len(which):
                    continue
                score = asked.scores(which, block)
                ids = np.array([[0, 1] if block["doc_id"][d] is None else [block["doc_id"][d], 0] for d in which], np.int64)
                for i in np.flatnonzero(chosen.any(axis=1)).tolist():
                    mine = np.flatnonzero(chosen[i, which] & (score[i] > 0))
                    rows = np.concatenate([best[i], np.column_stack([score[i, mine], ids[mine]])])
                    best[i] = rows[np.lexsort((rows[:, 1], rows[:, 2], -rows[:, 0]))[:top]]
        rows = np.concatenate(best) if best else np.zeros((0, 3), np.int64)
        item = np.repeat(np.arange(len(best), dtype=np.int64), [len(x) for x in best])
        yield pa.record_batch({"item": item, "doc_id": pa.array(rows[:, 1], mask=rows[:, 2] == 1), "score": rows[:, 0]})

    return released(run)


def _best(rows: DataFrame, top: int, groups: int) -> DataFrame:
    """The best rows of each item by score (ties: doc_id, null ids last), first within hashed parts of an item."""
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    parts = rows.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(groups)))
    few = parts.withColumn("rank", F.row_number().over(Window.partitionBy("item", "part").orderBy(*order))).where(F.col("rank") <= top)
    return few.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= top).drop("part")


def search(index: DataFrame, items: DataFrame, top: int = 20, block: int = 1 << 17, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` best texts of each item with a score above 0, equal scores by doc_id.

    The score adds, for each of an item's terms, repeats included, w * (10^9 tf div (1000 tf + 12 m)), with the weight w =
    floor(1000 ln((2N + 2) / (2 df + 1))) and m = 75 + (25 n N div L). Items are taken in blocks of about ``block``
    characters; null and wordless ones have no rows, repeated ids are items each, and so are null ids.
    """
    spark = items.sparkSession
    small_batches(spark)
    asked = save(items.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).alias("text")).where("text is not null"), "bloom-items")
    blocks, found = max(1, -(-(asked.agg(F.sum(F.length("text"))).first()[0] or 0) // block)), []
    for k in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).toArrow()
        h, bounds = row_words(rows.column("text").combine_chunks())
        mine = [(i, h[bounds[j] : bounds[j + 1]]) for j, i in enumerate(rows.column("item_id").to_pylist()) if bounds[j + 1] > bounds[j]]
        terms = np.unique(h)
        counts = index.select("terms", "length").mapInArrow(_counted(terms), "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
        known = {r["term"]: r["n"] for r in counts.collect()}  # a row a term of the block of items
        if not mine or not known.get(-1):
            continue
        a = Asked(mine, terms, np.array([known.get(j, 0) for j in range(len(terms))]), known[-1], known[-2])
        schema, groups = "item long, doc_id long, score long", n_buckets(spark)
        tried = _best(index.mapInArrow(_ranked(a, top, None), schema), top, groups).where(F.col("rank") == top).collect()  # a row an item at most
        least = np.zeros(len(mine))
        for r in tried:
            least[r["item"]] = r["score"]
        ranked = _best(index.mapInArrow(_ranked(a, top, least), schema), top, groups)
        ids = F.get(F.array(*(F.lit(i).cast("long") for i in a.ids)), F.col("item").cast("int"))
        found.append(save(ranked.select(ids.alias("item_id"), "rank", "doc_id", "score"), "bloom-ranked"))
    return reduce(DataFrame.union, found) if found else spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
