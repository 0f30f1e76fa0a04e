"""Fast exact encoding of whole texts with a vocabulary file of the tokenizers library."""

from __future__ import annotations

import os
import re
import sys
from array import array

#: White space as the vocabulary files' patterns see it: Python's, without U+001C to U+001F.
SPACE = r"[^\S\x1c-\x1f]"
CHUNK = re.compile(rf"{SPACE}*(?:\S|[\x1c-\x1f])+|{SPACE}+")
CONTROL = re.compile(r"[\x1c-\x1f]")
#: A line end or a space or neither, letters, and ASCII signs: the patterns of both kinds of files part these.
PARTS = re.compile(r"(\n?)( ?[^\W\d_]+)([!-/:-@\[-^`{-~]*)")
#: Bytes that a chunk in memory takes besides its letters and ids.
ENTRY = 190


def load(path: str, specials: bool = False):
    """A tokenizer; `specials`: whether a special token's string inside a text has that token's id, as the library's plain
    call gives it, or is ordinary text."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = not specials
    return tokenizer


def packed(ids: list[int]) -> bytes:
    """ids as little-endian unsigned 32-bit numbers."""
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


class Encoder:
    """Encodes texts as little-endian unsigned 32-bit ids.

    No merge crosses from a word into the white space after it, so a text is the concatenation of its
    chunks (white space and the word behind it), and each distinct chunk is encoded once. Chunks are remembered
    in two generations of `room` / 2 bytes each: when the younger one is full it becomes the older one, whose chunks
    go unless they are met again, so that frequent words stay and rare ones leave.
    """

    def __init__(self, path: str, room: int = 48 << 20, specials: bool = False):
        self.tokenizer = load(path, specials)
        self.tokenize = self.tokenizer.model.tokenize
        self.room = room
        #: Whether this vocabulary drops white space, so that " a" and "a" have the same ids.
        self.spaceless = self.ids(" a") == self.ids("a") and self.ids("\n") == []
        self.letters = self._byte_letters()
        self.signs: dict[str, bytes] = {}
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.left = room // 2

    def ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    @staticmethod
    def _byte_letters() -> dict[int, str]:
        """The printable letter that byte-level vocabularies use for each byte."""
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        others = (b for b in range(256) if b not in plain)
        return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}

    @staticmethod
    def _plain(chunk: str) -> bool:
        """Whether no letter of a chunk may fall apart, or meet its neighbour, when it is normalised."""
        return chunk.isascii() or max(chunk) < "İ"

    def _letters(self, chunk: str) -> bytes | None:
        """Ids of a chunk that is one run of letters, with one space before it or none, if that is certain; None else."""
        if not self._plain(chunk):
            return None
        if self.spaceless:
            chunk = chunk.lstrip(" ").lower()
        chunk = chunk.encode().decode("latin-1").translate(self.letters)
        return packed([t.id for t in self.tokenize(chunk)])

    def _sign(self, signs: str) -> bytes:
        """Ids of a run of signs or of a line end, which are few."""
        got = self.signs.get(signs)
        if got is None:
            got = packed(self.ids(signs))
            if len(self.signs) < 4096 and len(signs) < 16:
                self.signs[signs] = got
        return got

    def _parts(self, chunk: str) -> bytes | None:
        """Ids of a chunk by its parts, where these are certain; None else."""
        if (chunk[1:] if chunk[0] == " " else chunk).isalpha():
            return self._letters(chunk)
        found = PARTS.fullmatch(chunk)
        if not found:
            return None
        line, core, signs = found.groups()
        if line and core[0] == " " or signs and signs[0] == "'" or not core.lstrip(" ").isalpha() or not self._plain(core):
            return None
        got = self.known.get(core) or self.older.get(core) or self._letters(core)
        if got is None:
            return None
        if signs:
            got += self._sign(signs)
        return self._sign(line) + got if line else got

    def _learn(self, chunks: set[str]) -> None:
        """Puts chunks into the younger generation."""
        known, older, parts, rest, left = self.known, self.older, self._parts, [], self.left
        for c in chunks:
            got = older.get(c) or parts(c)
            if got is None:
                rest.append(c)
            else:
                known[c] = got
                left -= len(c) + len(got) + ENTRY
        if rest:
            for c, e in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False), strict=True):
                known[c] = got = packed(e.ids)
                left -= len(c) + len(got) + ENTRY
        self.left = left

    def chunks(self, text: str) -> list[str]:
        words = text.split()
        if " ".join(words) == text:  # words apart by one space
            return words if self.spaceless else [words[0], *map(" ".__add__, words[1:])]
        if self.spaceless and text.isascii() and not CONTROL.search(text):
            return words
        return CHUNK.findall(text)

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.left < 0:
            self.known, self.older, self.left = {}, self.known, self.room // 2
        chunks = self.chunks(text)
        out = list(map(self.known.get, chunks))
        if None in out:
            self._learn({c for c, o in zip(chunks, out, strict=True) if o is None})
            known = self.known
            out = [known[c] if o is None else o for c, o in zip(chunks, out, strict=True)]
        return b"".join(out)


_ENCODERS: dict[tuple[str, int, bool], Encoder] = {}


def encoder(path: str, room: int = 48 << 20, specials: bool = False) -> Encoder:
    """One encoder for each vocabulary file, reading of special strings and worker process; `room` bounds its memory of chunks, in bytes."""
    if (path, room, specials) not in _ENCODERS:
        _ENCODERS[path, room, specials] = Encoder(path, room, specials)
    return _ENCODERS[path, room, specials]
