"""Byte-level BPE encoding of whole texts with the tokenizers library, exact and cached.

A single blank between two non-blank characters is always a boundary of the byte-level pre-tokenizer, so a text
is cut there and the ids of a text are one join over a dictionary of chunks. A chunk not seen yet is cut into
pre-tokens (letters, then one mark: by rule; else by the pre-tokenizer's pattern; characters beyond U+02AF: the
library's whole pipeline), each encoded by the library's BPE model. Ids are kept as little-endian unsigned 32-bit
bytes. Both dictionaries are bounded, so memory does not grow with the corpus.
"""

from __future__ import annotations

import os
import re

DEFAULT_TOKENIZER = "byte_bpe_50k.json"
_SAFE_CUT = re.compile(r"(?<=\S) (?=\S)")
_LAST_LATIN = "ʯ"
_MARKS = frozenset(".,;:?")
_DOOR = (1 << 21) - 1


def tokenizer_path(name: str = DEFAULT_TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_alphabet() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for U+0100 onwards."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(other)}


class _Unsafe(Exception):
    """A chunk is empty or begins or ends with a blank: the blank before it need not be a boundary."""


class _Pieces(dict):
    """pre-token -> id bytes."""

    def __init__(self, tokenizer, limit: int):
        super().__init__()
        self._limit, self._alphabet, self._tokenize = limit, _byte_alphabet(), tokenizer.model.tokenize
        self._bytes = [i.to_bytes(4, "little") for i in range(max(tokenizer.get_vocab().values(), default=-1) + 1)]

    def mapped(self, piece: str) -> bytes:
        """Ids of a piece that is written in the byte alphabet."""
        table = self._bytes
        return b"".join([table[t.id] for t in self._tokenize(piece)])

    def encode(self, piece: str) -> bytes:
        return self.mapped(piece.encode("utf-8").decode("latin-1").translate(self._alphabet))

    def __missing__(self, piece: str) -> bytes:
        found = self.encode(piece)
        if len(self) < self._limit and len(piece) < 64:
            self[piece] = found
        return found


class _Chunks(dict):
    """chunk -> id bytes; ``prefix`` is put before a chunk when it is encoded, ``bare`` holds those without."""

    def __init__(self, tokenizer, pieces: _Pieces, prefix: str, limit: int, bare: _Chunks | None = None):
        import public_tokenizers
        import regex

        super().__init__()
        self._tokenizer, self._pieces, self._prefix, self._limit = tokenizer, pieces, prefix, limit
        self._cut = regex.compile(public_tokenizers.PATTERN).findall
        special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        self.bare, self._line_end = self if not prefix else bare, pieces["\n"]
        self._special = regex.compile("|".join(map(regex.escape, special)) or r"(?!)").search
        self._plain = not any(t.isalpha() or t[:-1].isalpha() for t in special)  # then no word is one
        self._seen = bytearray(_DOOR + 1)
        self._lead = prefix.translate(_byte_alphabet())  # ASCII letters stand for themselves in the byte alphabet

    def __missing__(self, chunk: str) -> bytes:
        if self._plain:  # the usual cases, without a further call
            if chunk.isalpha():
                if chunk.isascii():
                    return self._keep(chunk, self._pieces.mapped(self._lead + chunk))
                if max(chunk) <= _LAST_LATIN:
                    return self._keep(chunk, self._pieces.encode(self._prefix + chunk))
            elif chunk[-1:] in _MARKS:
                word = chunk[:-1]
                if word.isalpha() and (word.isascii() or max(word) <= _LAST_LATIN):
                    return self._keep(chunk, self[word] + self._pieces[chunk[-1]])
        if not chunk or chunk[0].isspace() or chunk[-1].isspace():
            raise _Unsafe
        return self.add(chunk)

    def _keep(self, chunk: str, found: bytes) -> bytes:
        """A chunk is kept from the second time on, as far as a table of hashes tells: most chunks come once."""
        at = hash(chunk) & _DOOR
        if not self._seen[at]:
            self._seen[at] = 1
        elif len(self) < self._limit and len(chunk) < 64:
            self[chunk] = found
        return found

    def _lines(self, chunk: str) -> bytes | None:
        """A single line end between two other characters is a pre-token of its own, and what follows has no prefix."""
        first, *rest = chunk.split("\n")
        try:
            return self[first] + b"".join([self._line_end + self.bare[x] for x in rest])
        except _Unsafe:
            return None

    def add(self, chunk: str) -> bytes:
        """The ids of any chunk; what begins or ends with a blank is not kept, as ``__missing__`` must refuse it."""
        if "\n" in chunk and (found := self._lines(chunk)) is not None:
            return found  # not kept: it seldom comes again, and its parts are
        if chunk and max(chunk) <= _LAST_LATIN and not self._special(chunk):
            found = b"".join([self._pieces[p] for p in self._cut(self._prefix + chunk)])
        else:
            ids = self._tokenizer.encode(self._prefix + chunk, add_special_tokens=False).ids
            found = b"".join([i.to_bytes(4, "little") for i in ids])
        return found if not chunk or chunk[0].isspace() or chunk[-1].isspace() else self._keep(chunk, found)


class Encoder:
    """``encode(text)`` gives the ids as bytes (uint32, little-endian), equal to the library's own on the whole text."""

    def __init__(self, path: str, cache: int = 300_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        pieces = _Pieces(tokenizer, cache // 7)
        self._first = _Chunks(tokenizer, pieces, "", cache // 7)
        self._next = _Chunks(tokenizer, pieces, " ", cache, self._first)

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        first, *rest = text.split(" ")
        try:
            return self._first[first] + b"".join(map(self._next.__getitem__, rest))
        except _Unsafe:
            first, *rest = _SAFE_CUT.split(text)
            return self._first.add(first) + b"".join([self._next.get(p) or self._next.add(p) for p in rest])


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder a Python worker, kept between tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
