"""Piece-wise encoding and merge counting against the libraries over whole texts."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

pytest.importorskip("public_tokenizers")
import public_tokenizers as P  # noqa: E402

from meteoqc.llm.pieces import CUT, PieceEncoder  # noqa: E402
from meteoqc.llm.token_counts import PieceCounter  # noqa: E402

ODD = st.text(alphabet=st.sampled_from(list("ab Zç,.!\n 'sétll\n\t\r 　\x85\x1c᠎​é́.!?19%<|>Σςİßﬁ▁ǅ中")), max_size=40)
ANY = st.one_of(ODD, st.text(max_size=40), st.sampled_from(
    ["<|endoftext|>", "a <|endoftext|> b", "x<|endoftext|>y", "  a   b \n\n c", "<s> </s><unk>", "a" * 3000, " " * 50, "", "́ é"]))


@pytest.fixture(scope="module")
def byte_level():
    return PieceEncoder(P.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def word_level():
    return PieceEncoder(P.path("word_bpe_49k.json"), spaced=False)


@pytest.fixture(scope="module")
def counter():
    return PieceCounter(P.path("piece_bpe_32k.model"))


def whole(enc, strings):
    return [enc.library(s) for s in strings]


@settings(max_examples=400, deadline=None)
@given(st.lists(ANY, min_size=1, max_size=4))
def test_byte_level_pieces(byte_level, strings):
    assert byte_level.encode(strings) == whole(byte_level, strings)


@settings(max_examples=400, deadline=None)
@given(st.lists(ANY, min_size=1, max_size=4))
def test_word_level_pieces(word_level, strings):
    assert word_level.encode(strings) == whole(word_level, strings)


@settings(max_examples=400, deadline=None)
@given(ANY)
def test_merge_counts(counter, text):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    assert counter.count(text) == len(sp.encode(text))


def test_cut_patterns_lose_nothing():
    s = "a  b\n\tc   "
    assert "".join(CUT.findall(s)) == s
