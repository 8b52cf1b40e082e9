"""Encoding whole texts with the tokenizers library, each distinct token string only once.

Both kinds of vocabulary first split a text into pre-tokens by a pattern and then encode each
pre-token on its own. For texts of common letters, digits, marks and ASCII white space the split
is made here, and the library's model encodes each pre-token the first time a worker meets it;
afterwards it is looked up. Other texts are cut where their tokenizer can never join two sides,
and the pieces with uncommon characters go to the library as they are; where no cut is
certain the whole text does. The ids are those the library gives for the whole text. Ids must fit
in 16 bits.
"""

from __future__ import annotations

import re
from array import array

import numpy as np

# Strings in a generation of a worker's cache; two generations are kept.
CACHE_LIMIT = {"word": 600_000, "byte": 400_000}
CACHED_LENGTH = 64  # longer strings are encoded each time

# White space to Python but not to the tokenizers: cut these texts nowhere.
_ODD_FOR_SPLIT = re.compile("[\x1c-\x1f]")
# For the byte-level kind only single blanks and line feeds between other characters are sure.
_ODD_FOR_BYTES = re.compile(r"[^\S \n]|[ \n][ \n]|\A[ \n]|[ \n]\Z|\x01")
# Composed letters whose lower case is one letter, and marks; none takes part in normalisation.
_LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f"
_MARKS = "!-/:-@\\[-`{-~\u00a1\u00a7\u00ab\u00bb\u00bf\u2013\u2014\u2018-\u201e\u2022\u2026\u20ac"
_UNCOMMON = re.compile(f"[^{_LETTERS}0-9{_MARKS} \t-\r]")
# How the strings of special tokens begin; the library finds them inside words too.
_SPECIAL = "<|"
# The pre-token patterns of the two kinds (fixed values of the vocabularies) over those characters.
_SHORT = "'s|'t|'re|'ve|'m|'ll|'d"
_SPLIT = {
    "word": re.compile(f"{_SHORT}|[{_LETTERS}]+|[0-9]|[{_MARKS}]+").findall,
    "byte": re.compile(f"{_SHORT}| ?[{_LETTERS}]+| ?[0-9]+| ?[{_MARKS}]+|\\s+(?!\\S)|\\s+").findall,
}


def _byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies: printable
    Latin-1 characters for themselves, the others in order from U+0100."""
    keep = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in keep else chr(next(spare)) for b in range(256)]


_LETTER = _byte_letters()


class Memo(dict):
    """Values of the pieces met lately; a new piece is computed on first use."""

    def __init__(self, compute, limit: int) -> None:
        self.compute, self.limit, self.older = compute, limit, {}

    def __missing__(self, piece):
        value = self.older.get(piece)
        if value is None:
            value = self.compute(piece)
        if len(piece) <= CACHED_LENGTH:
            self[piece] = value
        return value

    def age(self) -> None:
        """A full generation becomes the older one, and that is forgotten."""
        if len(self) > self.limit:
            self.older = dict(self)
            self.clear()


class PieceEncoder:
    """Encodes texts; ``kind`` is "word" (lower case, white space dropped) or "byte" (all counts)."""

    def __init__(self, path: str, kind: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids do not fit in 16 bits")
        self.model = self.tokenizer.model
        self.kind, self.split = kind, _SPLIT[kind]
        self.tokens = Memo(self._token, CACHE_LIMIT[kind])
        self.pieces = Memo(self._piece, CACHE_LIMIT[kind])

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u2").tobytes()

    def _token(self, token: str) -> bytes:
        """Ids of one pre-token, given to the model in its byte letters."""
        if not (token.isascii() and token.isprintable() and token[0] != " "):
            token = "".join([_LETTER[b] for b in token.encode()])
        return array("H", [t.id for t in self.model.tokenize(token)]).tobytes()

    def _common(self, text: str) -> bytes:
        """Ids of a text of common characters."""
        return b"".join(map(self.tokens.__getitem__, self.split(text.lower() if self.kind == "word" else text)))

    def _piece(self, piece: str) -> bytes:
        return self.whole(piece) if _UNCOMMON.search(piece) or _SPECIAL in piece else self._common(piece)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian 16-bit ids of each text; null is empty."""
        self.tokens.age()
        self.pieces.age()
        return [self._encode(t) if t else b"" for t in texts]

    def _encode(self, text: str) -> bytes:
        if self.kind == "word":  # most words come again, so they are looked up with their marks
            return self.whole(text) if _ODD_FOR_SPLIT.search(text) else b"".join(map(self.pieces.__getitem__, text.split()))
        if _SPECIAL in text:
            return self.whole(text)
        if not _UNCOMMON.search(text):
            return self._common(text)
        if _ODD_FOR_BYTES.search(text):
            return self.whole(text)
        # Cut before each blank and line feed, each piece keeping its own.
        return b"".join(map(self.pieces.__getitem__, text.replace("\n", "\x01\n").replace(" ", "\x01 ").split("\x01")))


_LOADED: dict[str, PieceEncoder] = {}


def load(path: str, kind: str) -> PieceEncoder:
    """The worker's encoder for a tokenizer file."""
    if path not in _LOADED:
        _LOADED[path] = PieceEncoder(path, kind)
    return _LOADED[path]
