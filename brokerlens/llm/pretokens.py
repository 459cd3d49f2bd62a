"""Ids of whole texts from the ids of their pretokens, each different one encoded once."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from itertools import chain

import regex

#: Entries of a generation of the memo; there are two. Longer pieces are not remembered.
MEMO_ENTRIES = 600_000
LONGEST_KEPT = 64
PART_CHARS = 1_000_000
#: Where cutting at every blank, full stop and comma would not fall between pretokens.
_UNSAFE = re.compile(r"[.,\s\x00](?:(?<=\s\s)|(?<=[\W_][.,])|(?<=\x00))")


class PretokenCache:
    """Encodes texts with a function over pretokens, whose ids are little-endian unsigned 32-bit integers.

    A pattern of the kind used for byte-level BPE never lets a pretoken cross from a non-blank to a blank, nor from a
    letter or digit to a full stop or comma. So most texts may first be cut there, which is quicker than matching
    the pattern; what is left to match are the different pieces. These repeat a lot, and the ids of recent ones are
    remembered: when a generation is full, the one before it is given up.
    """

    def __init__(self, pattern: str, encode: Callable[[list[str]], list[bytes]]):
        self.pattern = regex.compile(pattern)
        self.encode = encode
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def texts(self, texts: Iterable[str | None]) -> list[bytes]:
        out: list[bytes] = []
        part: list[list[str]] = []
        size = 0
        for text in texts:
            part.append(self._cut(text or ""))
            size += len(text or "")
            if size >= PART_CHARS:
                out += self._joined(part)
                part, size = [], 0
        return out + self._joined(part)

    def _cut(self, text: str) -> list[str]:
        if _UNSAFE.search(text):
            return self.pattern.findall(text)
        marked = text.replace(" ", "\x00 ").replace("\n", "\x00\n\x00").replace(".", "\x00.").replace(",", "\x00,")
        return marked.split("\x00")

    def _joined(self, part: list[list[str]]) -> list[bytes]:
        if len(self.young) >= MEMO_ENTRIES:
            self.old, self.young = self.young, {}
        young, old = self.young, self.old
        unknown = set(chain.from_iterable(part)).difference(young)
        found: dict[str, list[str]] = {}
        for piece in unknown:
            ids = old.get(piece)
            if ids is not None:
                young[piece] = ids
            elif piece.isalpha() or (piece[:1] == " " and piece[1:].isalpha()):
                found[piece] = [piece]
            else:
                found[piece] = self.pattern.findall(piece)
        new = list({t for tokens in found.values() for t in tokens if t not in young})
        own = dict(zip(new, self.encode(new)))
        for piece, tokens in found.items():
            own[piece] = b"".join([own[t] if t in own else young[t] for t in tokens])
        young.update(own)
        out = [b"".join(map(young.__getitem__, pieces)) for pieces in part]
        for piece in own:
            if len(piece) > LONGEST_KEPT:
                del young[piece]
        return out
