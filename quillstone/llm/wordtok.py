"""Whole texts to token ids with the tokenizers library, each distinct piece of a batch encoded once.

The library spends about a microsecond a byte on every occurrence of a word. Texts are cut at ASCII white space, which no
token crosses, and Arrow numbers the distinct pieces; those that aren't known yet are cut further where the vocabulary's
own splitting cuts, and only the distinct words that remain are encoded. Numpy then gathers the ids of whole batches.

All this holds for vocabularies with the normalizer and splitter below. With any other, whole texts go to the library.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: How word_bpe_49k.json normalizes and splits. Any vocabulary that differs here is encoded text by text.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLITTER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
WORD_END = "</w>"

#: The same splitting for lower-case text, with the blank between two pieces as a word of its own. A run of letters can hold
#: numerals that aren't decimal digits; such runs go to the library as they are.
_WORDS = re.compile(r" |'(?:[stmd]|re|ve|ll)|[^\W\d_]+|\d|(?:[^\w\s]|_)+")
#: Pieces whose lower case or splitting Python and the library may see differently: final sigma, dotted I, odd separators.
_ODD = re.compile("[Σİ\x1c-\x1f\x85᠎]")
#: Words of basic Latin and its two supplements without numerals, which need no normalizer.
_PLAIN = re.compile("[!-~¡-±´-¸º»¿-ɏ]+")


class PieceTokenizer:
    """``encode(texts)`` returns the ids of all texts (a list or an Arrow column) one after another, each text followed by
    ``end_id``, and the number of ids of each text with that end. A null or empty text has the end id alone.

    Two tables live until ``forget``, which tasks call when they end: pieces that a batch has more than once, and the words of the other pieces.
    Each starts anew beyond ``max_pieces``, which changes speed only.
    """

    def __init__(self, path: str, end_id: int, max_pieces: int = 200_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self._tok = Tokenizer.from_file(path)
        self._plain = Tokenizer(self._tok.model)
        self.dtype = _id_type(self._tok)
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        added = [t["content"] for t in told["added_tokens"]]
        self.by_piece = told["normalizer"] == NORMALIZER and told["pre_tokenizer"] == SPLITTER and told["model"]["end_of_word_suffix"] == WORD_END and not any(re.search(r"\s", t) for t in added)
        # Words that are in lower case and cut already need neither the normalizer nor the pattern.
        self._plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocab = self._tok.get_vocab()
        self._final = np.zeros(max(vocab.values()) + 1, bool)
        self._final[[i for t, i in vocab.items() if t.endswith(WORD_END)]] = True
        self._special = re.compile("|".join(map(re.escape, added)) or r"(?!)")
        self._end, self._max = end_id, max_pieces
        self.forget()

    def forget(self) -> None:
        """Drops the tables: a worker process that waits for its next task, of whatever kind, is to be small."""
        self._reset()
        self._reset_words()

    def _reset(self) -> None:
        self._index: dict[str, int] = {}
        self._ids, self._len = np.array([self._end], self.dtype), np.array([1], np.int64)  # row 0: the end

    def _reset_words(self) -> None:
        self._known: dict[str, int] = {" ": 0}
        self._word_ids, self._word_len = np.zeros(0, self.dtype), np.zeros(1, np.int64)  # row 0: the gap between pieces

    def encode(self, texts) -> tuple[np.ndarray, np.ndarray]:
        column = (texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts) if isinstance(texts, (pa.Array, pa.ChunkedArray)) else pa.array(texts, pa.string())
        if not len(column):
            return np.zeros(0, self.dtype), np.zeros(0, np.int64)
        if not self.by_piece:
            return self._whole(column)
        cut = pc.ascii_split_whitespace(pc.fill_null(column, "").cast(pa.large_string()))
        numbered = cut.flatten().dictionary_encode()
        pieces, which = numbered.dictionary.to_numpy(zero_copy_only=False).tolist(), numbered.indices.to_numpy()
        row = np.fromiter(map(self._index.get, pieces, repeat(-1)), np.int64, len(pieces))
        new = np.flatnonzero(row < 0)
        ids, n = self._ids, self._len
        if len(new):
            more, lengths = self._spelled([pieces[k] for k in new.tolist()])
            row[new] = len(n) + np.arange(len(new))
            ids, n = np.concatenate([ids, more]), np.concatenate([n, lengths])
        stops = np.diff(cut.offsets.to_numpy()).cumsum()
        at = np.insert(row[which], stops, 0)
        flat = _gather(ids, n, at)
        counts = np.diff(n[at].cumsum()[stops + np.arange(len(stops))], prepend=0)
        self._keep(pieces, new, np.bincount(which, minlength=len(pieces)), row, ids, n)
        return flat, counts

    def _keep(self, pieces: list[str], new: np.ndarray, uses: np.ndarray, row: np.ndarray, ids: np.ndarray, n: np.ndarray) -> None:
        again = new[uses[new] > 1]
        if len(self._index) + len(again) > self._max:
            self._reset()
        if len(again):
            first = len(self._len)
            self._index.update(zip([pieces[k] for k in again.tolist()], range(first, first + len(again))))
            self._ids = np.concatenate([self._ids, _gather(ids, n, row[again])])
            self._len = np.concatenate([self._len, n[row[again]]])

    def _spelled(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pieces one after another, and the number of ids of each."""
        joined = " ".join(pieces)
        odd: list[int] = []
        if not joined.isascii() and (_ODD.search(joined) or not unicodedata.is_normalized("NFC", joined)) or self._special.search(joined) or _ODD.search(joined):
            odd = [k for k, p in enumerate(pieces) if _ODD.search(p) or self._special.search(p) or not unicodedata.is_normalized("NFC", p)]
            left = pieces.copy()
            for k in odd:
                left[k] = "_"  # stands for the piece until its own ids are put in below
            joined = " ".join(left)
        words = _WORDS.findall(joined.lower())
        if len(self._known) > self._max:
            self._reset_words()
        new = list(dict.fromkeys(words).keys() - self._known.keys())
        if new:
            ids, n = self._words(new)
            self._known.update(zip(new, range(len(self._known), len(self._known) + len(new))))
            self._word_ids, self._word_len = np.concatenate([self._word_ids, ids]), np.concatenate([self._word_len, n])
        n = self._word_len
        at = np.fromiter(map(self._known.__getitem__, words), np.int64, len(words))
        gap = np.concatenate([np.flatnonzero(at == 0), [len(at)]])
        total = np.concatenate([[0], n[at].cumsum()])
        lengths = np.diff(total[gap], prepend=0)
        flat = _gather(self._word_ids, n, at)
        if not odd:
            return flat, lengths
        parts, starts = [], lengths.cumsum() - lengths
        own = {k: np.array(e.ids, self.dtype) for k, e in zip(odd, self._tok.encode_batch_fast([pieces[k] for k in odd], add_special_tokens=False))}
        done = 0
        for k in odd:
            parts += [flat[done : starts[k]], own[k]]
            done = starts[k] + lengths[k]
            lengths[k] = len(own[k])
        return np.concatenate([*parts, flat[done:]]), lengths

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words in their order. Plain words and words of letters are encoded in rows of 500, and the rows cut at the
        tokens that end a word; a row with more or fewer ends than words, and all other words, are encoded one by one."""
        flags = list(map(_PLAIN.fullmatch, words))
        plain, other = [k for k, m in enumerate(flags) if m], [k for k, m in enumerate(flags) if not m]
        full, single = [k for k in other if words[k].isalpha()], [k for k in other if not words[k].isalpha()]
        order, parts, lengths = [], [np.zeros(0, self.dtype)], [np.zeros(0, np.int64)]
        for tok, mine in ((self._plain, plain), (self._tok, full)):
            runs = [mine[k : k + 500] for k in range(0, len(mine), 500)]
            for run, e in zip(runs, tok.encode_batch_fast([" ".join([words[k] for k in r]) for r in runs], add_special_tokens=False)):
                ids = np.array(e.ids, self.dtype)
                ends = np.flatnonzero(self._final[ids]) + 1
                if len(ends) != len(run) or ends[-1] != len(ids):
                    single += run
                    continue
                order += run
                parts.append(ids)
                lengths.append(np.diff(ends, prepend=0))
        for k, e in zip(single, self._tok.encode_batch_fast([words[k] for k in single], add_special_tokens=False)):
            order.append(k)
            parts.append(np.array(e.ids, self.dtype))
            lengths.append(np.array([len(e.ids)], np.int64))
        ids, n, back = np.concatenate(parts), np.concatenate(lengths), np.empty(len(words), np.int64)
        back[order] = np.arange(len(words))
        return _gather(ids, n, back), n[back]

    def _whole(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        found = [np.array([*e.ids, self._end], self.dtype) for e in self._tok.encode_batch_fast([t or "" for t in column.to_pylist()], add_special_tokens=False)]
        return np.concatenate(found), np.array([len(f) for f in found], np.int64)


def _gather(ids: np.ndarray, n: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The ids of the rows ``at`` one after another; row k has n[k] ids and follows row k-1."""
    start, m = (n.cumsum() - n)[at], n[at]
    source = np.repeat(start - (m.cumsum() - m), m)
    source += np.arange(len(source))
    return ids[source]


def _id_type(tok) -> np.dtype:
    return np.dtype("<u2") if tok.get_vocab_size() <= 1 << 16 else np.dtype("<u4")


def id_width(path: str) -> int:
    """Bytes of an id of a vocabulary."""
    from tokenizers import Tokenizer

    return _id_type(Tokenizer.from_file(path)).itemsize


_shared: dict[tuple, PieceTokenizer] = {}


def tokenizer(path: str, end_id: int) -> PieceTokenizer:
    """The worker process's own encoder for a vocabulary file."""
    key = (path, end_id)
    if key not in _shared:
        _shared[key] = PieceTokenizer(path, end_id)
    return _shared[key]
