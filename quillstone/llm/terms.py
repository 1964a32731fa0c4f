"""Words of whole texts as 64-bit hashes, cut and hashed by array operations on their UTF-8 bytes.

A word is a maximal run of 0-9, a-z and characters from U+0080 on, after A-Z are lowered; that is every byte of ``WORD``.
Its hash adds a random number a byte value times a power of the byte's place, and mixes the sum; words of one shape that
differ get different hashes but for about one pair in 2^64.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Bytes that are looked at together; a longer word is looked at whole.
PIECE = 1 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
WORD = np.zeros(256, bool)
WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_BASE = 0x9E3779B97F4A7C15
_VALUE = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64)[LOWER]


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's powers modulo 2^64 and their inverses."""
    up, down = np.full(n, _BASE, np.uint64), np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def _hashes(data: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of each word of ``data``; no word reaches over the places ``firsts``."""
    inside = WORD[data]
    before = np.concatenate([[False], inside[:-1]])
    before[firsts] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.concatenate([inside[1:], [False]])
    after[firsts[firsts > 0] - 1] = False
    stops = np.flatnonzero(inside & ~after) + 1
    up, down = _powers(max(PIECE, 1 << max(0, len(data) - 1).bit_length()))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_VALUE[data] * up[: len(data)], out=sums[1:])
    h = (sums[stops] - sums[starts]) * down[starts]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ h >> np.uint64(29), starts


def word_hashes(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pieces of a column of strings, in order: the words' hashes and the row of each word. Null texts have no words."""
    texts = texts.cast(pa.large_string())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    at = 0
    while at < len(data):
        stop = min(at + PIECE, len(data))
        while stop < len(data) and WORD[data[stop - 1]] and WORD[data[stop]]:  # to the end of the word
            run = np.flatnonzero(~WORD[data[stop : stop + PIECE]])
            stop += int(run[0]) if len(run) else min(PIECE, len(data) - stop)
        inner = ends[np.searchsorted(ends, at, "right") : np.searchsorted(ends, stop, "left")] - at
        h, starts = _hashes(data[at:stop], inner)
        yield h, np.searchsorted(ends, starts + at, "right") - 1
        at = stop


def row_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All words' hashes of a batch of texts and the bounds of each row among them (one more than rows)."""
    pieces = list(word_hashes(texts))
    h = np.concatenate([p[0] for p in pieces]) if pieces else np.zeros(0, np.uint64)
    rows = np.concatenate([p[1] for p in pieces]) if pieces else np.zeros(0, np.int64)
    return h, np.searchsorted(rows, np.arange(len(texts) + 1))


def text_hashes(text: str | None) -> np.ndarray:
    """The words' hashes of one text."""
    return row_words(pa.array([text], pa.string()))[0]
