"""Exact ids of the subword vocabulary ``word_bpe_49k`` through bounded caches.

The vocabulary's splitter cuts a text into pieces that the BPE model encodes one by one, and
pieces repeat. A text of printable Latin-1 characters and white space is folded and split here
by the vocabulary's own rules, and the library's model encodes each new piece. Any other text
is taken chunk by chunk between white space, across which nothing is joined: plain chunks as
above, others through the library whole. tests/llm holds this against the library on whole
texts and on random strings.
"""

from __future__ import annotations

import re
from array import array

import numpy as np

#: White space as the vocabulary's splitter knows it; str.split() also splits at \x1c-\x1f.
_CHUNK = re.compile("[^\t-\r \x85\xa0  -     　]+")
_OTHER = "\x1c\x1d\x1e\x1f"
_PLAIN = re.compile("[\t-\r -~\xa1-\xac\xae-\xff]*").fullmatch
_LETTER, _NUMBER = "a-zªµºß-öø-ÿ", "0-9²³¹¼½¾"
#: The vocabulary's splitting pattern, within folded Latin-1.
_PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_NUMBER}]|[^\t-\r {_LETTER}{_NUMBER}]+").findall
_SHOWN = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
#: Byte-level alphabet: bytes that can't be shown get the characters from 256 on.
_ALPHABET = {b: chr(b) for b in _SHOWN} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _SHOWN)}


class _Cache(dict):
    """Two generations: when full, the entries become the old ones, and those used come back."""

    def __init__(self, make, limit: int):
        super().__init__()
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, key: str) -> bytes:
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        found = self.old.get(key)
        value = self[key] = self.make(key) if found is None else found
        return value


class ChunkEncoder:
    def __init__(self, path: str, limit: int = 400_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.pieces, self.chunks = _Cache(self._piece, limit), _Cache(self._chunk, limit // 4)

    def _piece(self, piece: str) -> bytes:
        if not piece.isascii():
            piece = "".join(map(_ALPHABET.__getitem__, piece.encode()))
        return array("I", [t.id for t in self.model.tokenize(piece)]).tobytes()

    def _chunk(self, chunk: str) -> bytes:
        if _PLAIN(chunk) and "<|" not in chunk:
            return b"".join(map(self.pieces.__getitem__, _PIECES(chunk.lower())))
        return array("I", self.tokenizer.encode(chunk, add_special_tokens=False).ids).tobytes()

    def forget(self) -> None:
        """Empties the caches: a worker outlives its task and waits beside other stages."""
        for cache in (self.pieces, self.chunks):
            cache.clear()
            cache.old = {}

    def raw(self, text: str) -> bytes:
        """Ids of the whole text, as native 32-bit numbers."""
        if _PLAIN(text) and "<|" not in text:
            return b"".join(map(self.pieces.__getitem__, _PIECES(text.lower())))
        chunks = _CHUNK.findall(text) if any(c in text for c in _OTHER) else text.split()
        return b"".join(map(self.chunks.__getitem__, chunks))

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(self.raw(text), np.uint32)

    def count(self, text: str) -> int:
        return len(self.raw(text)) // 4


_loaded: dict[str, ChunkEncoder] = {}


def encoder(path: str) -> ChunkEncoder:
    """One encoder for each worker process and vocabulary file."""
    if path not in _loaded:
        _loaded[path] = ChunkEncoder(path)
    return _loaded[path]
