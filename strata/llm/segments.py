"""Texts cut where no byte-level or piece tokenizer joins anything, so that each
distinct segment is encoded once.

A cut lies in front of a run of ASCII white space that follows another
character. Segments are found and hashed on Arrow buffers; what they encode to
is kept in flat arrays, and the ids of whole texts are gathered from them.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

import numpy as np

from strata.llm import bytescan

#: white space beyond ASCII; a pattern's ``\\s+`` joins it with ASCII white space behind it
WIDE_SPACE = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


def starts(raw: np.ndarray, off: np.ndarray, carriage_return: bool = True) -> np.ndarray:
    """Where segments of the texts begin: at white space behind another byte, and where a text that is not empty does.

    Without ``carriage_return`` none begins at one (nor at white space behind it).
    """
    space = bytescan.SPACE[raw]
    first = space.copy() if carriage_return else space & (raw != 0x0D)
    first[1:] &= ~space[:-1]
    heads = off[:-1]
    first[heads[heads < len(raw)]] = True
    return np.flatnonzero(first)


def places(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The places ``start[i] .. start[i] + n[i] - 1`` of all i, one after the other."""
    ends = np.cumsum(n)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - n), n)


class TokenBytes:
    """The bytes of a vocabulary's tokens, by id."""

    def __init__(self, token: Sequence[bytes]):
        self.length = np.array([len(t) for t in token], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.raw = np.frombuffer(b"".join(token), np.uint8)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        return self.raw[places(self.start[ids], self.length[ids])]


class Texts:
    """The distinct segments of a batch of texts and which text has which."""

    def __init__(self, raw: np.ndarray, off: np.ndarray, carriage_return: bool = True):
        self.raw, self.off = raw, off
        begin = starts(raw, off, carriage_return)
        end = np.append(begin[1:], len(raw)) if len(begin) else begin
        self.hashes, at, self.which = np.unique(bytescan.span_hashes(raw, begin, end), return_index=True, return_inverse=True)
        self.begin, self.end, self.of_text = begin[at], end[at], np.searchsorted(begin, off)
        self._data = raw.tobytes()

    def strings(self, some: np.ndarray) -> list[str]:
        return [self._data[a:b].decode() for a, b in zip(self.begin[some].tolist(), self.end[some].tolist(), strict=True)]


def true_texts(texts: Texts, ids: np.ndarray, ends: np.ndarray, tokens: TokenBytes) -> np.ndarray:
    """Which texts' bytes are those of their tokens joined (segments whose hashes clash are found by this)."""
    size = np.concatenate([[0], np.cumsum(tokens.length[ids])])[ends]
    good = np.diff(size) == np.diff(texts.off)
    differs = tokens.joined(ids[np.repeat(good, np.diff(ends))]) != texts.raw[np.repeat(good, np.diff(texts.off))]
    if differs.any():
        good[np.repeat(np.arange(len(good))[good], np.diff(texts.off)[good])[differs]] = False
    return good


class Store:
    """Ids of segments by the segment's hash; ``encode`` is asked once per segment, until the store is full and emptied."""

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], limit: int = 1 << 19, at_once: int = 2048):
        self.encode, self.limit, self.at_once = encode, limit, at_once
        self.clear()

    def clear(self) -> None:
        self.known, self.row = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.ids, self.start, self.n, self.used = np.zeros(1 << 16, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64), 0

    def rows(self, texts: Texts) -> np.ndarray:
        """A row for each distinct segment."""
        if len(self.known) > self.limit or self.used > 8 * self.limit:
            self.clear()
        at = np.minimum(np.searchsorted(self.known, texts.hashes), max(len(self.known) - 1, 0))
        seen = self.known[at] == texts.hashes if len(self.known) else np.zeros(len(texts.hashes), bool)
        out = np.empty(len(texts.hashes), np.int64)
        out[seen] = self.row[at[seen]]
        new = np.flatnonzero(~seen)
        out[new] = len(self.n) + np.arange(len(new))
        for k in range(0, len(new), self.at_once):  # a library's own results are large objects
            ids, n = self.encode(texts.strings(new[k:k + self.at_once]))
            if self.used + len(ids) > len(self.ids):
                self.ids = np.concatenate([self.ids[:self.used], np.zeros(max(len(self.ids) // 2, len(ids)), np.int32)])
            self.ids[self.used:self.used + len(ids)] = ids
            self.start = np.append(self.start, self.used + np.cumsum(n) - n)
            self.n = np.append(self.n, n)
            self.used += len(ids)
        known = np.concatenate([self.known, texts.hashes[new]])
        order = np.argsort(known, kind="stable")
        self.known, self.row = known[order], np.concatenate([self.row, out[new]])[order]
        return out

    def ids_of(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts and the offsets of the texts among them."""
        row = self.rows(texts)[texts.which]
        n = self.n[row]
        return self.ids[places(self.start[row], n)], np.concatenate([[0], np.cumsum(n)])[texts.of_text]
