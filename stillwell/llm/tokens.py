"""Whole-text encoding with a public tokenizer, with word pieces of text encoded once per worker."""

from __future__ import annotations

import os
import re
import sys
from array import array

if sys.byteorder != "little" or array("I").itemsize != 4:
    raise RuntimeError("ids are kept as little-endian 32-bit numbers")

#: Texts with any other white space, an information separator or a special token's opening are encoded in one go.
UNUSUAL = re.compile(r"[^\S \t\n\r]|<\|")
#: A pre-token of the byte tokenizer never runs from a non-space into a space, so a text may be cut before a space.
BYTE_PIECES = re.compile(r"[ \t\n\r]*[^ \t\n\r]+|[ \t\n\r]+")
#: The word tokenizer drops white space, so a text may be cut at it.
WORD_PIECES = re.compile(r"[^ \t\n\r]+")
#: Below this, composition changes nothing and lower case goes by single characters.
PLAIN_BELOW = "\u0130"
BEYOND_PLAIN = re.compile(f"[^\0-{chr(ord(PLAIN_BELOW) - 1)}]")
#: A run of these at the end of a piece is a pre-token of its own if a letter comes before it.
CLOSING = ".,!?"
LONGEST_KEPT = 64


def byte_letters() -> dict[int, str]:
    """The letter of byte-level vocabularies for each byte, as a table for str.translate on Latin-1.

    Printable bytes stand for themselves, the others for the code points from 256 on, in order.
    """
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    other = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(other)}


class PieceEncoder(dict):
    """Little-endian 32-bit ids of text pieces, remembered in two generations of at most ``limit`` pieces.

    A piece that is one word goes to the tokenizer's merges directly, a word with closing marks is put together from
    both, and any other piece is encoded in full.
    """

    def __init__(self, path: str, pieces: re.Pattern, limit: int):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.merges = self.tokenizer.model
        self.pieces, self.limit, self.older = pieces, limit, {}
        self.lowers, self.letters = pieces == WORD_PIECES, byte_letters()

    def whole(self, text: str) -> bytes:
        """The ids of a text as the tokenizers library gives them in one call."""
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def word(self, word: str) -> bytes:
        """The ids of one pre-token."""
        letters = word.encode().decode("latin-1").translate(self.letters)
        return array("I", [token.id for token in self.merges.tokenize(letters)]).tobytes()

    def fresh(self, piece: str) -> bytes:
        stem = piece.rstrip(CLOSING)
        # by its last letter as it is encoded: lower case may leave a mark there, which joins what follows
        end = stem[-1:].lower() if self.lowers else stem[-1:]
        if stem != piece and end.isalpha():
            return self[stem] + self[piece[len(stem):]]
        if self.lowers:
            return self.word(piece) if piece.isalpha() and piece.islower() and max(piece) < PLAIN_BELOW else self.whole(piece)
        if piece[0] in "\n\t\r" and piece[1:].isalpha():
            return self[piece[0]] + self[piece[1:]]
        return self.word(piece) if piece.removeprefix(" ").isalpha() else self.whole(piece)

    def __missing__(self, piece: str) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            ids = self.fresh(piece)
            if len(piece) > LONGEST_KEPT:
                return ids
        if len(self) >= self.limit:
            self.older = dict(self)
            self.clear()
        self[piece] = ids
        return ids

    def encode(self, text: str | None) -> bytes:
        """The ids of a whole text, the same as ``whole``; a null text is empty."""
        if not text:
            return b""
        if UNUSUAL.search(text):
            return self.whole(text)
        if self.lowers and not BEYOND_PLAIN.search(text):
            text = text.lower()
        return b"".join(map(self.__getitem__, self.pieces.findall(text)))


_ENCODERS: dict[tuple, PieceEncoder] = {}


def encoder(path: str, pieces: re.Pattern, limit: int = 500_000) -> PieceEncoder:
    """This worker's encoder for a tokenizer file; it lives as long as the worker, so tasks share its memory."""
    key = (path, pieces.pattern, limit)
    if key not in _ENCODERS:
        _ENCODERS[key] = PieceEncoder(path, pieces, limit)
    return _ENCODERS[key]
