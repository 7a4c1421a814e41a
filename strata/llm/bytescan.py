"""Words of whole texts, found and hashed on Arrow buffers with numpy.

The texts of an Arrow batch lie in one byte buffer. Words (runs of bytes other
than 0x20 and 0x09-0x0D), their offsets and 64-bit hashes come from array
operations on that buffer; no Python object is made per word. Work is done in
slices of a few megabytes, so memory does not follow the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 32

_BLOCK = 1 << 18


def _mix(x: np.ndarray) -> np.ndarray:
    """Finalising bit mixer on uint64 (splitmix64's)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = 0x2545F4914F6CDD1D
_BASE_INV = pow(_BASE, -1, 1 << 64)
_pow = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_pow[0]) < n:
        n = max(n, _BLOCK + 4096)
        for k, base in enumerate((_BASE, _BASE_INV)):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            _pow[k] = np.multiply.accumulate(p)
    return _pow[0], _pow[1]


def buffer_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and the n + 1 offsets of the texts in them. A null text is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    n = len(texts)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset:texts.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0]:off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


def slices(batch: pa.RecordBatch, text: str, max_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of the batch with at most ``max_bytes`` of text, or one longer row."""
    col = batch.column(batch.schema.get_field_index(text))
    n = batch.num_rows
    if n == 0:
        return
    wide = pa.types.is_large_string(col.type)
    off = np.frombuffer(col.buffers()[1], np.int64 if wide else np.int32)[col.offset:col.offset + n + 1]
    at = 0
    while at < n:
        to = int(np.searchsorted(off, int(off[at]) + max_bytes, "right")) - 1
        to = min(n, max(at + 1, to))
        yield batch.slice(at, to - at)
        at = to


def words(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``starts, ends`` (bytes) of all words and the n + 1 offsets of the texts among them."""
    if not len(raw):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(off), np.int64)
    solid = ~SPACE[raw]
    cut = np.zeros(len(raw) + 1, bool)
    cut[off] = True
    starts = solid.copy()
    starts[1:] &= ~solid[:-1] | cut[1:-1]
    ends = solid
    ends[:-1] &= ~solid[1:] | cut[1:-1]
    s, e = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return s, e, np.searchsorted(s, off)


LETTER = np.zeros(256, bool)
LETTER[ord("a"):ord("z") + 1] = LETTER[ord("A"):ord("Z") + 1] = LETTER[0x80:] = True
ALNUM = LETTER.copy()
ALNUM[ord("0"):ord("9") + 1] = True


def core_words(raw: np.ndarray, off: np.ndarray, edge: np.ndarray = ALNUM,
               head: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The bytes in lower case, and start, end and text number of each word
    without the bytes around it that are not in ``edge`` (in front: not in
    ``head``, a superset); a word of such bytes alone is left out."""
    low = LOWER[raw] if len(raw) else raw
    s, e, at = words(raw, off)
    text = np.repeat(np.arange(len(off) - 1), np.diff(at))
    is_edge = edge[low]
    where = np.flatnonzero(is_edge)
    upto = np.concatenate([[0], np.cumsum(is_edge)])
    has = upto[e] > upto[s]
    s, e, text = s[has], e[has], text[has]
    if len(s):
        e = where[upto[e] - 1] + 1
        if head is None:
            s = where[upto[s]]
        else:
            is_head = head[low]
            s = np.flatnonzero(is_head)[np.concatenate([[0], np.cumsum(is_head)])[s]]
    return low, s, e, text


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash (uint64) of each byte span; spans are sorted and apart from each other."""
    out = np.empty(len(starts), np.uint64)
    i, n = 0, len(starts)
    while i < n:
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + _BLOCK, "right")))
        a, b = int(starts[i]), int(ends[j - 1])
        up, down = _powers(b - a + 1)
        total = np.zeros(b - a + 1, np.uint64)
        np.cumsum(_BYTE[raw[a:b]] * up[:b - a], out=total[1:])
        s, e = starts[i:j] - a, ends[i:j] - a
        out[i:j] = _mix((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64))
        i = j
    return out


def runs(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k consecutive entries of h."""
    n = len(h) - k + 1
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + h[i:i + n])
    return out
