"""Vector bin packing of token pieces into training sequences under limits on tokens, segments and loss-bearing tokens.

Items and limits are vectors. A sequence takes, again and again, the fitting item with the largest dot product of its
vector and the sequence's residual capacity, both as fractions of the limits (the dot-product heuristic). Where no item
fits whole, the one that fills most of the sequence is cut, so padding arises only where the segment or loss limit binds
and at the end of a task's documents.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.store import released, small_batches
from quillstone.llm.wordtok import tokenizer

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, padded_length long, loss_tokens long"


class _Classes:
    """Items by (tokens, loss): equal items are one class with a stack of (item, first token), so that what is looked at
    in each step grows with the distinct items of a window and not with their number."""

    def __init__(self, tokens: np.ndarray, loss: np.ndarray):
        order = np.lexsort((-np.arange(len(tokens)), -loss, -tokens))  # the earliest item of a class is on top of its stack
        order = order[tokens[order] > 0]
        n, b = tokens[order], loss[order]
        new = np.flatnonzero(np.concatenate([[True], (np.diff(n) != 0) | (np.diff(b) != 0)])) if len(n) else np.zeros(0, np.int64)
        self.n, self.b = n[new], b[new]
        self.stacks = [[(int(i), 0) for i in part] for part in np.split(order, new[1:])] if len(n) else []
        self.count = np.array([len(s) for s in self.stacks], np.int64)
        self.at = {(x, y): k for k, (x, y) in enumerate(zip(self.n.tolist(), self.b.tolist()))}

    def add(self, item: int, begin: int, n: int, b: int) -> None:
        k = self.at.get((n, b))
        if k is None:
            k = self.at[n, b] = len(self.stacks)
            self.stacks.append([])
            self.n, self.b, self.count = np.append(self.n, n), np.append(self.b, b), np.append(self.count, 0)
        self.stacks[k].append((item, begin))
        self.count[k] += 1

    def take(self, k: int, times: int) -> list[tuple[int, int]]:
        got = self.stacks[k][: -times - 1 : -1]
        del self.stacks[k][-times:]
        self.count[k] -= times
        return got

    def compact(self) -> None:
        live = np.flatnonzero(self.count)
        self.n, self.b, self.count, self.stacks = self.n[live], self.b[live], self.count[live], [self.stacks[k] for k in live.tolist()]
        self.at = {(x, y): k for k, (x, y) in enumerate(zip(self.n.tolist(), self.b.tolist()))}


def pack_window(tokens: np.ndarray, loss: np.ndarray, max_tokens: int, max_segments: int, max_loss: int) -> list[tuple[int, int, int, int, int]]:
    """Packs one bounded window of items; returns (item, start, length, sequence, offset) with sequences from 0.

    ``tokens``: length of each item, at least 1. ``loss``: how many of the item's last ids bear loss. The last, partly
    filled sequence is cut into lengths that are powers of two, which need no padding. An item is taken as many times at
    once as it stays the best choice, which is what single steps would do.
    """
    if min(max_tokens, max_segments, max_loss) < 1:
        raise ValueError("limits must be at least 1")
    out: list[tuple[int, int, int, int, int]] = []
    n = np.asarray(tokens, np.int64)
    items = _Classes(n, np.minimum(np.asarray(loss, np.int64), n))
    left, sequence = int(items.count.sum()), 0
    while left:
        if np.count_nonzero(items.count) * 2 < len(items.count):
            items.compact()
        t_room, s_room, l_room, offset, placed = max_tokens, max_segments, max_loss, 0, []
        while left and t_room and s_room:
            n, b = items.n, items.b
            alive = items.count > 0
            fits = np.flatnonzero(alive & (n <= t_room) & (b <= l_room))
            if len(fits):
                nf, bf = n[fits], b[fits]
                score = nf * (t_room / max_tokens**2) + bf * (l_room / max_loss**2)
                best = int(np.argmax(score))
                k, nk, bk = int(fits[best]), int(nf[best]), int(bf[best])
                rate = (nf - nk) * (nk / max_tokens**2) + (bf - bk) * (bk / max_loss**2)
                worse = rate < 0
                stays = np.inf if not worse.any() else float(((score[worse] - score[best]) / rate[worse]).min())
                times = min(int(items.count[k]), s_room, t_room // nk, l_room // bk if bk else s_room, int(min(stays, 1e9)) + 1)
                placed += [(i, a, nk, offset + j * nk) for j, (i, a) in enumerate(items.take(k, times))]
                t_room, s_room, l_room, offset, left = t_room - times * nk, s_room - times, l_room - times * bk, offset + times * nk, left - times
                continue
            fill = np.where(alive, np.minimum(t_room, n - b + l_room), 0)
            most = int(fill.max())
            if not most:
                break  # the loss limit is reached and no item begins with ids that bear none
            k = int(np.argmax(np.where(fill == most, n, -1)))
            nk, bk = int(n[k]), int(b[k])
            ((i, a),) = items.take(k, 1)
            bears = max(0, most - (nk - bk))
            placed.append((i, a, most, offset))
            t_room, s_room, l_room, offset = t_room - most, s_room - 1, l_room - bears, offset + most
            items.add(i, a + most, nk - most, bk - bears)
        if left or offset == max_tokens:
            out += [(i, s, m, sequence, o) for i, s, m, o in placed]
            sequence += 1
        else:
            sequence = _powers_of_two(placed, offset, sequence, out)
    return out


def _powers_of_two(placed, total: int, sequence: int, out: list) -> int:
    sizes = [1 << k for k in range(total.bit_length() - 1, -1, -1) if total >> k & 1]
    at, used = 0, 0
    for i, s, m, _ in placed:
        while m:
            take = min(m, sizes[at] - used)
            out.append((i, s, take, sequence + at, used))
            s, m, used = s + take, m - take, used + take
            if used == sizes[at]:
                at, used = at + 1, 0
    return sequence + len(sizes)


def padded(length: int, max_tokens: int) -> int:
    """The stored length of a sequence: its own at a power of two, otherwise the limit."""
    return length if length & (length - 1) == 0 else max_tokens


def _packed(vocab: str, end_id: int, max_tokens: int, max_segments: int, max_loss: int, window: int, window_items: int, context_share: float):
    def emit(held, first):
        ids, counts, loss = (np.concatenate([h[k] for h in held]) for k in range(3))
        keys = pa.concat_arrays([h[3] for h in held])
        p = np.array(pack_window(counts, loss, max_tokens, max_segments, max_loss), np.int64).reshape(-1, 5)
        begin = np.cumsum(counts) - counts
        length = np.bincount(p[:, 3], weights=p[:, 2]).astype(np.int64)
        crc = [zlib.crc32(ids[a : a + m].astype("<u4")) for a, m in zip((begin[p[:, 0]] + p[:, 1]).tolist(), p[:, 2].tolist())]
        full = np.array([padded(int(x), max_tokens) for x in length], np.int64)
        bears = np.clip(p[:, 1] + p[:, 2] - (counts - loss)[p[:, 0]], 0, p[:, 2])
        return len(length), pa.record_batch({"doc_id": keys.take(pa.array(p[:, 0])), "start": p[:, 1], "length": p[:, 2], "ids_crc32": pa.array(crc, pa.int64()), "doc_tokens": counts[p[:, 0]], "sequence_id": first + p[:, 3], "offset": p[:, 4], "padded_length": full[p[:, 3]], "loss_tokens": bears})

    def encoded(tok, part):
        if "prompt" not in part.schema.names:
            ids, counts = tok.encode(part.column("text"))
            return ids, counts, counts - (counts * context_share).astype(np.int64)
        ids, both = tok.encode([t for pair in zip(part.column("prompt").to_pylist(), part.column("text").to_pylist()) for t in pair])
        ids = np.delete(ids, both.cumsum()[::2] - 1)  # a prompt has no end of its own
        return ids, both[::2] - 1 + both[1::2], both[1::2] - (both[1::2] * context_share).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, first = tokenizer(vocab, end_id), TaskContext.get().partitionId() << 36
        held: list = []
        size = rows = 0
        for b in batches:
            for k in range(0, b.num_rows, 1024):
                part = b.slice(k, 1024)
                held.append((*encoded(tok, part), part.column("doc_id")))
                size, rows = size + len(held[-1][0]), rows + len(held[-1][1])
                if size >= window or rows >= window_items:
                    n, out = emit(held, first)
                    yield out
                    first, held, size, rows = first + n, [], 0, 0
        if held:
            yield emit(held, first)[1]
        tok.forget()

    return released(run)


def pack_documents(docs: DataFrame, vocab: str, end_id: int, max_tokens: int = 4096, max_segments: int = 256, max_loss: int | None = None, context_share: float = 0.0, prompt_col: str | None = None, window_tokens: int = 4_000_000, window_items: int = 262_144, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece of a document, with the sequence that holds it, its place there and how many of its ids bear loss.

    Each task packs its own documents, ``window_tokens`` or ``window_items`` at a time, so nothing is shuffled and no group
    can grow. Ids of ``prompt_col`` come before the text's and bear no loss; neither does the first ``context_share`` of a
    text's ids, which are only context for the rest. Null and empty texts are one piece with the end id; a null doc_id
    stays null; repeated rows are packed each; an empty table gives no rows.
    """
    if not 0 <= context_share < 1:
        raise ValueError("context_share must be at least 0 and below 1")
    small_batches(docs.sparkSession)
    cols = [F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")]
    if prompt_col:
        cols.append(F.col(prompt_col).cast("string").alias("prompt"))
    return docs.select(*cols).mapInArrow(_packed(vocab, end_id, max_tokens, max_segments, max_loss or max_tokens, window_tokens, window_items, context_share), PIECES)
