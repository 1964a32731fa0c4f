"""Benchmark decontamination with an FM-index a shard of the training texts.

``build_index`` numbers the words of up to ``shard_words`` words of consecutive texts, sorts their suffixes by doubling,
and keeps the Burrows-Wheeler transform as a wavelet matrix (bit levels from the lowest bit up, so that following a
symbol's bits down the levels is the step from last to first column) with every ``rate``-th suffix position. The index
is a table of one row a shard, written once and searched as often as there are benchmarks. Texts stay in their tasks.

``contaminated`` takes test items to windows of words, searches all windows of a block at once backwards through each
shard, locates every occurrence by stepping to the next sampled position, and merges occurrences to removal spans.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.llm.store import released, save, small_batches
from quillstone.llm.terms import row_words

#: Symbols below the words': the end of a shard, and what stands between texts.
END, GAP, FIRST = 0, 1, 2
#: A shard's longest sequence; three numbers of this size make one sorting key.
LONGEST = 1 << 21


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Suffixes of ``s`` in order, by doubling; each round sorts only suffixes that are still tied. A suffix that is a prefix
    of another comes first. Fewer than 2^21 symbols."""
    n, bits = len(s), np.uint64(21)
    counts = np.bincount(s)
    rank = (np.cumsum(counts) - counts)[s]  # of a tie, the first place it may take
    tied, step = np.flatnonzero(counts[s] > 1), 1
    while len(tied):
        ahead = tied + step
        second = np.where(ahead < n, rank[np.minimum(ahead, n - 1)] + 1, 0)
        key = (rank[tied].astype(np.uint64) << bits | second.astype(np.uint64)) << bits | tied.astype(np.uint64)
        key.sort()
        pair = key >> bits
        first, at = (pair >> bits).astype(np.int64), (key & np.uint64(LONGEST - 1)).astype(np.int64)
        new = np.concatenate([[True], pair[1:] != pair[:-1]])
        group = np.concatenate([[True], first[1:] != first[:-1]])
        place = np.arange(len(key))
        rank[at] = first + np.maximum.accumulate(np.where(new, place, 0)) - np.maximum.accumulate(np.where(group, place, 0))
        tied = at[~(new & np.concatenate([new[1:], [True]]))]
        step *= 2
    sa = np.empty(n, np.int64)
    sa[rank] = np.arange(n)
    return sa


class Bits:
    """A bit sequence with ranks, 64 bits a word."""

    def __init__(self, raw: bytes):
        self.words = np.frombuffer(raw, np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])

    @staticmethod
    def packed(bits: np.ndarray) -> bytes:
        """At least one bit of padding, so that a rank may be asked at the end."""
        padded = np.zeros((len(bits) // 64 + 1) * 64, bool)
        padded[: len(bits)] = bits
        return np.packbits(padded, bitorder="little").tobytes()

    def ones(self, i: np.ndarray) -> np.ndarray:
        """How many of the first i bits are set."""
        low = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[i >> 6] + np.bitwise_count(self.words[i >> 6] & low)

    def at(self, i: np.ndarray) -> np.ndarray:
        return self.words[i >> 6] >> (i & 63).astype(np.uint64) & np.uint64(1) == 1


class Shard:
    """One shard's index, read from its row."""

    def __init__(self, n: int, vocabulary: bytes, levels: list[bytes], zeros: list[int], sampled: bytes, samples: bytes):
        self.n, self.vocabulary = n, np.frombuffer(vocabulary, np.uint64)
        self.levels, self.zeros = [Bits(x) for x in levels], zeros
        self.sampled, self.samples = Bits(sampled), np.frombuffer(samples, np.int32)

    def symbols(self, words: np.ndarray) -> np.ndarray:
        """Symbols of hashed words; -1: the shard doesn't have the word."""
        if not len(self.vocabulary):
            return np.full(words.shape, -1, np.int64)
        k = np.minimum(np.searchsorted(self.vocabulary, words), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[k] == words, k + FIRST, -1)

    def step(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Row i of the last column to the first: symbols below plus occurrences of the symbol above row i."""
        for k, (level, zeros) in enumerate(zip(self.levels, self.zeros)):
            ones = level.ones(i)
            i = np.where(symbol >> k & 1, zeros + ones, i - ones)
        return i

    def back(self, i: np.ndarray) -> np.ndarray:
        """The row of the suffix that begins one symbol earlier."""
        for level, zeros in zip(self.levels, self.zeros):
            ones = level.ones(i)
            i = np.where(level.at(i), zeros + ones, i - ones)
        return i

    def search(self, windows: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Backward search of windows of hashed words (rows padded at the right): those that occur, and their rows' bounds."""
        code = self.symbols(windows)
        width = np.arange(windows.shape[1])
        left = np.flatnonzero(((code >= 0) | (width >= lengths[:, None])).all(axis=1))
        low, high = np.zeros(len(left), np.int64), np.full(len(left), self.n)
        for k in range(windows.shape[1]):
            place = lengths[left] - 1 - k
            on = place >= 0
            c = code[left, np.maximum(place, 0)]
            low, high = np.where(on, self.step(c, low), low), np.where(on, self.step(c, high), high)
            some = high > low
            left, low, high = left[some], low[some], high[some]
        return left, low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions of suffixes."""
        found, todo, steps = np.zeros(len(rows), np.int64), np.arange(len(rows)), 0
        while len(todo):
            known = self.sampled.at(rows)
            found[todo[known]] = self.samples[self.sampled.ones(rows[known])] + steps
            rows, todo, steps = self.back(rows[~known]), todo[~known], steps + 1
        return found


def _index_row(words: list[np.ndarray], entries: list[tuple], rate: int) -> dict:
    """The index of one shard; entries are (row, doc_id, n_words, skip, core, place): of the entry's words, ``core``
    after the first ``skip`` are its own, from word ``place`` of the text on, and others are context."""
    sizes = np.array([len(w) for w in words], np.int64)
    starts = np.cumsum(sizes + 1) - sizes - 1
    vocabulary, code = np.unique(np.concatenate(words), return_inverse=True)
    s = np.full(int(sizes.sum()) + len(sizes) + 1, GAP, np.int64)
    s[np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))] = code + FIRST
    s[-1] = END
    sa = suffix_array(s)
    last, levels, zeros = s[sa - 1].astype(np.int32), [], []
    for k in range(int(s.max()).bit_length()):
        bit = (last >> k & 1).astype(bool)
        levels.append(Bits.packed(bit))
        last = np.concatenate([last[~bit], last[bit]])
        zeros.append(len(bit) - int(bit.sum()))
    sampled = sa % rate == 0
    columns = list(zip(*entries))
    return {
        "n": len(s), "vocabulary": vocabulary.tobytes(), "levels": levels, "zeros": zeros, "sampled": Bits.packed(sampled), "samples": sa[sampled].astype(np.int32).tobytes(),
        "starts": starts.tolist(), "row": columns[0], "doc_id": columns[1], "n_words": columns[2], "skip": columns[3], "core": columns[4], "place": columns[5],
    }


_INDEX = pa.schema(
    [("n", pa.int64()), ("vocabulary", pa.binary()), ("levels", pa.list_(pa.binary())), ("zeros", pa.list_(pa.int64())), ("sampled", pa.binary()), ("samples", pa.binary())]
    + [(c, pa.list_(pa.int64())) for c in ("starts", "row", "doc_id", "n_words", "skip", "core", "place")]
)
_INDEX_SQL = "n long, vocabulary binary, levels array<binary>, zeros array<long>, sampled binary, samples binary, starts array<long>, row array<long>, doc_id array<long>, n_words array<long>, skip array<long>, core array<long>, place array<long>"


def _indexed(shard_words: int, context: int, rate: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, entries, held = [], [], 0
        for b in batches:
            hashes, bounds = row_words(b.column("text"))
            for k, (row, doc_id) in enumerate(zip(b.column("row").to_pylist(), b.column("doc_id").to_pylist())):
                mine = hashes[bounds[k] : bounds[k + 1]]
                for at in range(0, max(1, len(mine)), shard_words):  # a longer text is cut, with context on both sides
                    core = min(shard_words, len(mine) - at)
                    low = max(0, at - context)
                    piece = mine[low : at + core + context]
                    if entries and held + len(piece) + 1 > shard_words:
                        yield pa.RecordBatch.from_pylist([_index_row(words, entries, rate)], _INDEX)
                        words, entries, held = [], [], 0
                    words.append(piece.copy())
                    entries.append((row, doc_id, len(mine), at - low, core, at))
                    held += len(piece) + 1
        if entries:
            yield pa.RecordBatch.from_pylist([_index_row(words, entries, rate)], _INDEX)

    return released(run)


def build_index(docs: DataFrame, shard_words: int = 1 << 20, context: int = 9, rate: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The saved index of all texts, one row a shard. Null and wordless texts have entries without words; null and repeated
    ids are kept, a row each. A text over ``shard_words`` words is cut, with ``context`` words more at each cut, which is
    what windows of up to ``context`` + 1 words need."""
    if shard_words + 2 * context + 2 >= LONGEST or shard_words < 1:
        raise ValueError("shard_words is from 1 to somewhat under 2^21")
    small_batches(docs.sparkSession)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return save(rows.mapInArrow(_indexed(shard_words, context, rate), _INDEX_SQL), "fm-index")


def item_windows(items: DataFrame, words: int = 10, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, window array<long>): each run of ``words`` hashed words of an item, or all words of an item that has fewer;
    null and wordless items have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h, bounds = row_words(b.column("text"))
            ids, windows = [], []
            for k, i in enumerate(b.column("item_id").to_pylist()):
                mine = h[bounds[k] : bounds[k + 1]].view(np.int64).tolist()
                windows += [mine[j : j + words] for j in range(max(1, len(mine) - words + 1))] if mine else []
                ids += [i] * (len(windows) - len(ids))
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(windows, pa.list_(pa.int64()))], ["item_id", "window"])

    small_batches(items.sparkSession)
    named = items.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).alias("text"))
    return named.mapInArrow(run, "item_id long, window array<long>").distinct()


def _found(windows: np.ndarray, lengths: np.ndarray, items: list[int | None], all_entries: bool, at_once: int = 1 << 18):
    """Per text entry of a shard: merged spans of its own words that occurrences cover, and the items that occur. Window k
    is of item k; entries without occurrences come too where ``all_entries``."""

    def of(r: dict) -> Iterator[dict]:
        shard = Shard(*(r[c] for c in ("n", "vocabulary", "levels", "zeros", "sampled", "samples")))
        starts, skip, core, place = (np.array(r[c], np.int64) for c in ("starts", "skip", "core", "place"))
        which, low, high = shard.search(windows, lengths)
        many = high - low
        each = np.repeat(np.arange(len(which)), many)
        rows = np.arange(len(each)) + np.repeat(low - (np.cumsum(many) - many), many)
        marks, seen = np.zeros(r["n"] + 1, np.int32), [np.zeros((2, 0), np.int64)]
        for k in range(0, len(rows), at_once):
            w, at = which[each[k : k + at_once]], shard.locate(rows[k : k + at_once])
            np.add.at(marks, at, 1)
            np.add.at(marks, at + lengths[w], -1)
            seen.append(np.unique(np.stack([np.searchsorted(starts, at, "right") - 1, w]), axis=1))
        covered = np.concatenate([[False], np.cumsum(marks) > 0, [False]])
        edge = np.flatnonzero(covered[1:] != covered[:-1]).reshape(-1, 2)
        entry = np.searchsorted(starts, edge[:, 0], "right") - 1
        own = np.clip(edge - (starts + skip)[entry, None], 0, core[entry, None]) + place[entry, None]
        entry, own = entry[own[:, 1] > own[:, 0]], own[own[:, 1] > own[:, 0]]
        hits = np.concatenate(seen, axis=1)
        hits = hits[:, np.argsort(hits[0], kind="stable")]
        for e in range(len(starts)) if all_entries else np.unique(hits[0]).tolist():
            a, b = np.searchsorted(entry, [e, e + 1])
            c, d = np.searchsorted(hits[0], [e, e + 1])
            named = list({items[w] for w in hits[1, c:d].tolist()})
            yield {"row": r["row"][e], "doc_id": r["doc_id"][e], "n_words": r["n_words"][e], "starts": own[a:b, 0].tolist(), "stops": own[a:b, 1].tolist(), "items": named}

    schema = pa.schema([(c, pa.int64()) for c in ("row", "doc_id", "n_words")] + [(c, pa.list_(pa.int64())) for c in ("starts", "stops", "items")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                yield pa.RecordBatch.from_pylist(list(of(b.slice(k, 1).to_pylist()[0])), schema)

    return released(run)


def _merge(a: np.ndarray, b: np.ndarray) -> list[dict]:
    by = np.argsort(a, kind="stable")
    a, upto = a[by], np.maximum.accumulate(b[by]) if len(b) else b
    first = np.flatnonzero(np.concatenate([[True], a[1:] > upto[:-1]])) if len(a) else np.zeros(0, np.int64)
    last = np.append(first[1:] - 1, len(a) - 1) if len(a) else first
    return [{"start": int(a[i]), "stop": int(upto[j])} for i, j in zip(first, last)]


def merged_spans(starts: str | Column, stops: str | Column) -> Column:
    """array<struct<start, stop>>: spans of two arrays in order; those that overlap or touch become one."""

    @F.pandas_udf("array<struct<start: long, stop: long>>")
    def merged(starts: pd.Series, stops: pd.Series) -> pd.Series:
        return pd.Series([_merge(np.asarray(a, np.int64), np.asarray(b, np.int64)) for a, b in zip(starts, stops)])

    return merged(starts, stops)


def contaminated(index: DataFrame, windows: DataFrame, block: int = 200_000) -> DataFrame:
    """Searches ``item_windows`` in the index: one row a text with row, doc_id, n_words, spans (array of struct<start, stop>,
    words to remove, merged and in order) and items (ids of items with occurring windows; a null id is one).

    Windows go to the tasks in blocks of about ``block``, each searched in one pass over the index. Without windows no text
    is hit; an empty index gives no rows.
    """
    spark = index.sparkSession
    small_batches(spark)
    dealt = save(windows, "fm-windows")
    longest = dealt.agg(F.count("*").alias("n"), F.max(F.size("window")).alias("words")).first()
    blocks, found = max(1, -(-longest["n"] // block)), []
    for k in range(blocks):
        mine = dealt.where(F.pmod(F.xxhash64("window", "item_id"), F.lit(blocks)) == k).collect()
        lengths = np.array([len(r["window"]) for r in mine], np.int64)
        table = np.zeros((len(mine), longest["words"] or 1), np.int64)
        for row, r in zip(table, mine):
            row[: len(r["window"])] = r["window"]
        search = _found(table.view(np.uint64), lengths, [r["item_id"] for r in mine], all_entries=k == 0)
        found.append(save(index.mapInArrow(search, "row long, doc_id long, n_words long, starts array<long>, stops array<long>, items array<long>"), "fm-found"))
    each = reduce(DataFrame.union, found).groupBy("row", "doc_id", "n_words")
    texts = each.agg(*(F.flatten(F.collect_list(c)).alias(c) for c in ("starts", "stops", "items")))
    return texts.select("row", "doc_id", "n_words", merged_spans("starts", "stops").alias("spans"), F.array_distinct("items").alias("items"))
