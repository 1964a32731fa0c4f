import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quillstone.llm.queries import END_ID, vocabulary
from quillstone.llm.wordtok import PieceTokenizer

KNOWN = Tokenizer.from_file(vocabulary())
ALPHABET = st.sampled_from(list("abcXYZ'sdlv.,;!?_-#$%09½²ªµßéÅİΣσςıжщ中文ไทย̧́̇K​᠎ \u0085\x1c \t\n")) | st.sampled_from(["'re", "'LL", " don't", "<|endoftext|>", "the ", "Σ "]) | st.characters(exclude_categories=["Cs"])


@settings(max_examples=400, deadline=None)
@given(st.lists(st.lists(ALPHABET, max_size=25).map("".join), min_size=1, max_size=6))
def test_any_text_gets_the_ids_of_the_library(texts):
    tok = PieceTokenizer(vocabulary(), END_ID, max_pieces=20) if len(texts) == 1 else TOK
    ids, n = tok.encode(texts)
    want = [e.ids + [END_ID] for e in KNOWN.encode_batch(texts, add_special_tokens=False)]
    assert [p.tolist() for p in np.split(ids, np.cumsum(n)[:-1])] == want


TOK = PieceTokenizer(vocabulary(), END_ID)


def test_another_vocabulary_gets_whole_texts():
    path = public_tokenizers.path("byte_bpe_50k.json")
    tok, texts = PieceTokenizer(path, 50256), ["Two words, then  blanks", None, "", "tab\there"]
    assert not tok.by_piece and TOK.by_piece
    ids, n = tok.encode(texts)
    plain = Tokenizer.from_file(path)
    assert [p.tolist() for p in np.split(ids, np.cumsum(n)[:-1])] == [plain.encode(t or "", add_special_tokens=False).ids + [50256] for t in texts]


@pytest.mark.parametrize("texts", [pa.array([], pa.string()), pa.array([None, ""]), pa.array(["a b", "c", "a b"]).slice(1)])
def test_arrow_columns(texts):
    ids, n = TOK.encode(texts)
    assert n.tolist() == [len(KNOWN.encode(t or "", add_special_tokens=False).ids) + 1 for t in texts.to_pylist()] and len(ids) == n.sum()
