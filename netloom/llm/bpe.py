"""Exact byte-pair encoding in linear time (problem 6): backtracking over Aho-Corasick longest matches.

A sequence of tokens is what the merges give exactly if every two neighbours are *compatible*: encoding the two tokens'
bytes together gives the two tokens back. So the encoder walks a piece from left to right, takes the longest token that
starts here (from one Aho-Corasick pass over the piece), and keeps it if it is compatible with the token before; else
it tries the next shorter token that is a prefix, and if none is left it takes back the token before. A bit per
position remembers dead ends, so no position is tried twice.

Compatibility is decided by undoing merges of the two tokens along the seam in order of rank; decisions are cached.
Decoding slices one byte string through a table of offsets.
"""

from __future__ import annotations

import json
from array import array
from functools import lru_cache

import ahocorasick
import numpy as np
import regex

#: Splits a text into pieces before merging. Fixed value of the public vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces up to this many characters are remembered, and at most so many of them.
CACHED_CHARS, CACHED_PIECES = 48, 200_000


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies use for bytes: printable bytes stand for themselves, the rest follow from 256."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder(dict):
    """Encoder of a byte-level vocabulary; as a dict it maps a piece of text to its ids as int32 bytes."""

    def __init__(self, path: str):
        super().__init__()
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        to_byte = _byte_alphabet()
        raw = {t: bytes(to_byte[c] for c in t) for t in model["vocab"] if all(c in to_byte for c in t)}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        vocab = model["vocab"]
        #: Ids by rank: bytes first, then the merges in order.
        made = [a + b for a, b in merges]
        base = [t for t in raw if len(raw[t]) == 1]
        self.ids = array("i", [vocab[t] for t in [*base, *made]])
        rank = {t: i for i, t in enumerate([*base, *made])}
        self.tokens = [raw[t] for t in [*base, *made]]
        self.split = [(i, i) for i in range(len(base))] + [(rank[a], rank[b]) for a, b in merges]
        self.pairs = {p: i for i, p in enumerate(self.split) if i >= len(base)}
        by_bytes = {t: i for i, t in enumerate(self.tokens)}
        #: Longest token that is a proper prefix of each token, -1 for none.
        self.shorter = array("i", [next((by_bytes[t[:k]] for k in range(len(t) - 1, 0, -1) if t[:k] in by_bytes), -1) for t in self.tokens])
        self.sizes = array("i", map(len, self.tokens))
        self.automaton = ahocorasick.Automaton()
        for t, i in by_bytes.items():
            self.automaton.add_word(t.decode("latin-1"), i)
        self.automaton.make_automaton()
        self.pieces = regex.compile(PATTERN).findall
        self.compatible = lru_cache(1 << 18)(self._compatible)
        top = max(self.ids) + 1
        self.text = b"".join(self.tokens)
        self.offsets = np.zeros((top, 2), dtype=np.int64)
        at = 0
        for i, t in enumerate(self.tokens):
            self.offsets[self.ids[i]] = at, at + len(t)
            at += len(t)

    def _compatible(self, left: int, right: int) -> bool:
        """No merge across the seam comes before the merges that make up the two tokens."""
        pairs, split = self.pairs, self.split
        limit = len(split)
        while True:
            joined = pairs.get((left, right))
            if joined is not None and joined < limit:
                return False
            # undo the later of the two tokens' merges; what was made later than a seam merge would have lost to it
            if left > right:
                limit = left
                left = split[left][1]
                if left == limit:  # a single byte: the right one is next
                    limit, right = right + 1, split[right][0]
                    if right + 1 == limit:
                        return True
            else:
                limit = right + 1
                right = split[right][0]
                if right + 1 == limit:
                    limit, left = left, split[left][1]
                    if left == limit:
                        return True

    def ranks(self, data: bytes) -> list[int]:
        """Tokens (by rank) of one piece."""
        n = len(data)
        longest = array("i", [-1]) * n
        size = self.sizes
        for end, tok in self.automaton.iter(data.decode("latin-1")):
            start = end - size[tok] + 1
            best = longest[start]
            if best < 0 or size[best] < size[tok]:
                longest[start] = tok
        out: list[int] = []
        dead = bytearray(n + 1)
        at, tok = 0, longest[0] if n else -1
        while tok >= 0:
            end = at + size[tok]
            if not dead[end] and (not out or self.compatible(out[-1], tok)):
                out.append(tok)
                at = end
                tok = longest[at] if at < n else -1
                continue
            tok = self.shorter[tok]
            if tok < 0:
                dead[at] = 1
                tok = out.pop()
                at -= size[tok]
        return out

    def __missing__(self, piece: str) -> bytes:
        ids = array("i", [self.ids[r] for r in self.ranks(piece.encode("utf-8"))]).tobytes()
        if len(piece) <= CACHED_CHARS:
            if len(self) >= CACHED_PIECES:
                self.clear()
            self[piece] = ids
        return ids

    def encode_bytes(self, text: str | None) -> bytes:
        """Ids of a text as int32 bytes; nothing for null and empty texts."""
        return b"".join(map(self.__getitem__, self.pieces(text))) if text else b""

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text; an empty list for null and empty texts."""
        return np.frombuffer(self.encode_bytes(text), dtype=np.int32).tolist()

    def count(self, text: str | None) -> int:
        """Number of ids of a text."""
        return len(self.encode_bytes(text)) // 4

    def decode(self, ids) -> bytes:
        """Bytes of the ids, cut from one byte string through the offset table."""
        return b"".join(self.text[a:b] for a, b in self.offsets[np.asarray(ids, dtype=np.int64)].tolist())


@lru_cache(2)
def encoder(path: str) -> Encoder:
    """The encoder of a vocabulary file, built once in each Python worker."""
    return Encoder(path)
