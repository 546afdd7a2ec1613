"""Encoding whole texts through a bounded memo of their white-space separated pieces.

A text is cut in front of each run of white space that follows other characters. The public
tokenizers used here never form a token across such a cut, so the ids of a text are the ids of its
pieces in order; tests compare this with encoding the text at once. Texts with characters on which
definitions of white space differ are encoded at once.

A new piece that is one Latin word with closing marks is put together from the ids of the word and
of the marks, which these tokenizers always keep apart; any other piece goes to the library whole.
"""

from __future__ import annotations

import os
import re
import sys
from array import array

import numpy as np

#: White_Space of Unicode, and characters that only some definitions add to it
SPACES = "\t\n\x0b\x0c\r \x85\xa0 " + "".join(map(chr, range(0x2000, 0x200B))) + "    　"
DOUBTFUL = tuple("\x1c\x1d\x1e\x1f᠎​﻿")
#: whatever keeps a text from being single spaces and line ends between words
UNEVEN = tuple(c for c in SPACES if c not in " \n") + ("  ", " \n", "\n ", "\n\n")
CUT = re.compile(f"[{SPACES}]*[^{SPACES}]+|[{SPACES}]+")
WORD = re.compile(r"(\n?)([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?*%$&#|]*)")
MEMO_PIECES, MEMO_WORDS, MEMO_CHARS = 600_000, 400_000, 48


class PieceEncoder:
    """Texts to little-endian ids in the narrowest unsigned type the vocabulary fits.

    ``spaced``: white space counts and stands in front of its word; else it only separates.
    """

    def __init__(self, path: str, spaced: bool = True):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.dtype = id_type(self.tokenizer.get_vocab_size(with_added_tokens=True))
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        assert sys.byteorder == "little" and array(self.code).itemsize == self.dtype.itemsize
        self.spaced = spaced
        self.memo: dict[str, bytes] = {}    # piece, without its single space in front, to ids
        self.words: dict[str, bytes] = {}   # what the library's model makes of a word or of marks
        self.letters = {i: c for i, c in enumerate(_byte_letters())}

    def _pack(self, ids: list[int]) -> bytes:
        return array(self.code, ids).tobytes()

    def library(self, text: str) -> bytes:
        """The whole text as the tokenizers library encodes it."""
        return self._pack(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _word(self, word: str) -> bytes:
        if (got := self.words.get(word)) is None:
            if len(self.words) > MEMO_WORDS:
                self.words.clear()
            if word.isascii() and word[0] != "\n":
                form = self.letters[32] + word[1:] if word[0] == " " else word
            else:
                form = word.encode().decode("latin-1").translate(self.letters)
            got = self.words[word] = array(self.code, [t.id for t in self.model.tokenize(form)]).tobytes()
        return got

    def _new(self, piece: str) -> bytes:
        if len(piece) > MEMO_CHARS:
            return self.library(piece if piece[0] == "\n" or not self.spaced else " " + piece)
        if m := WORD.fullmatch(piece):
            line, word, marks = m.groups()
            if not self.spaced:
                got = self._word(word.lower())
            else:
                got = self._word("\n") + self._word(word) if line else self._word(" " + word)
            if marks:
                got += self._word(marks)
        else:
            got = self.library(piece if piece[0] == "\n" or not self.spaced else " " + piece)
        if len(self.memo) > MEMO_PIECES:
            self.memo.clear()
        self.memo[piece] = got
        return got

    def _one(self, text: str) -> bytes:
        if any(c in text for c in DOUBTFUL):
            return self.library(text)
        if not self.spaced:
            return self._joined(text.split())
        if text[0] in SPACES or text[-1] in SPACES or any(c in text for c in UNEVEN):
            first, *rest = CUT.findall(text)
            return self.library(first) + b"".join(map(self._any, rest))
        first, *rest = text.replace("\n", " \n").split(" ")
        return self.library(first) + self._joined(rest)

    def _any(self, piece: str) -> bytes:
        """A piece with all of its white space."""
        if len(piece) > 1 and piece[0] == " " and piece[1] not in SPACES:
            piece = piece[1:]
        elif not (len(piece) > 1 and piece[0] == "\n" and piece[1] not in SPACES):
            return self.library(piece)
        return self.memo.get(piece) or self._new(piece)

    def _joined(self, pieces: list[str]) -> bytes:
        got = list(map(self.memo.get, pieces))
        if None in got:
            got = [self._new(p) if x is None else x for p, x in zip(pieces, got)]
        return b"".join(got)

    def encode(self, strings: list[str]) -> list[bytes]:
        """Ids of each text as bytes of ``dtype``."""
        one = self._one
        return [one(s) if s else b"" for s in strings]


def _byte_letters() -> list[str]:
    """The printable letter that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


_ENCODERS: dict[tuple[str, bool], PieceEncoder] = {}


def encoder(path: str, spaced: bool = True) -> PieceEncoder:
    """One encoder for each Python worker, so its memo outlives a task."""
    if (path, spaced) not in _ENCODERS:
        _ENCODERS[path, spaced] = PieceEncoder(path, spaced)
    return _ENCODERS[path, spaced]


def id_type(vocabulary: int) -> np.dtype:
    return np.dtype("<u2" if vocabulary <= 1 << 16 else "<u4")
