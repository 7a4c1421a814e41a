"""Byte-level BPE by dynamic programming over prefixes.

Byte-pair merging gives every string exactly one token sequence, and a sequence
is that one if and only if each pair of neighbours is what merging makes of the
pair's own bytes. So each prefix of a piece has exactly one valid last token:
the token t that ends there such that t fits the last token of the prefix in
front of it. The table of these last tokens is built from left to right, one
entry a byte, and an encoding is read off it from the end.

An entry depends only on the bytes and entries of the longest token before it.
Appended bytes therefore never change a table, and after an edit the table is
as before again once it agrees over the length of the longest token; texts are
re-encoded near an edit alone, with the result of a full encoding.

Texts are first split into pieces by the vocabulary's pattern, as its library
does; each piece is encoded by itself.
"""

from __future__ import annotations

import base64
import itertools
import struct
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm import bytescan, segments

#: Fixed value: how the byte-level vocabularies split text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: characters beyond a piece on which its end can depend ('ll is tried on two letters)
AHEAD = 2


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ids of a vocabulary file (base64 token, blank, id per line)."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge(ranks: dict[bytes, int], data: bytes, down_to: int = 1) -> list[bytes]:
    """The tokens of a short string by merging its lowest-ranked pair, leftmost first, again and again (or until ``down_to`` are left)."""
    parts = [data[i:i + 1] for i in range(len(data))]
    while len(parts) > down_to:
        rank, i = min((ranks.get(a + b, 1 << 62), i) for i, (a, b) in enumerate(itertools.pairwise(parts)))
        if rank == 1 << 62:
            break
        parts[i:i + 2] = [parts[i] + parts[i + 1]]
    return parts


def last_merges(ranks: dict[bytes, int]) -> dict[int, int]:
    """For each token of several bytes, the length of its left half at its last merge; 0 if no merges make it."""
    out = {}
    for t, i in ranks.items():
        if len(t) > 1:
            halves = merge(ranks, t, 2)
            out[i] = len(halves[0]) if len(halves) == 2 else 0
    return out


class PrefixCoder:
    """Encoder and decoder of pieces (bytes) by a vocabulary of ranks that holds all single bytes."""

    def __init__(self, ranks: dict[bytes, int], halves: dict[int, int] | None = None, memory: int = 1 << 18):
        self.ranks, self.memory, self.size = ranks, memory, len(ranks) + max(ranks.values())
        self.halves = last_merges(ranks) if halves is None else halves
        self.token = {i: t for t, i in ranks.items()}
        self.longest = max(map(len, ranks))
        ends: dict[bytes, set[int]] = {}
        for t, i in ranks.items():
            if len(t) == 1 or self.halves[i]:
                ends.setdefault(t[-4:], set()).add(len(t))
        # for the last four bytes (fewer where no token ends in so many) the lengths of tokens that may end there, the longest first
        for key in sorted(ends, key=len):
            for k in range(1, len(key)):
                ends[key] |= ends.get(key[k:], set()) if k == 1 or key[k - 1:] not in ends else set()
        self.lengths = {k: tuple(sorted(v, reverse=True)) for k, v in ends.items()}
        self._fits: dict[int, bool] = {}
        self._pieces: dict[str, bytes] = {}
        self._spines: dict[tuple[int, bool], list[bytes]] = {}

    def _spine(self, token: int, right: bool) -> list[bytes]:
        """The tokens at one edge of a token while it is merged, from its byte up to itself."""
        got = self._spines.get((token, right))
        if got is None:
            data, got = self.token[token], []
            while True:
                got.append(data)
                if len(data) == 1:
                    break
                cut = self.halves[self.ranks[data]]
                data = data[cut:] if right else data[:cut]
            got.reverse()
            self._spines[token, right] = got
        return got

    def fits(self, a: int, b: int) -> bool:
        """Whether token b may follow token a, that is, merging the pair's own bytes gives the pair.

        Merges inside a and b go by rank, whatever the other does. So it is enough to go up
        the two edges that meet in rank order and see that their tokens never merge with
        each other before one of them is taken up by its own side (the left one on ties).
        """
        left, right = self._spine(a, True), self._spine(b, False)
        ranks, none = self.ranks, 1 << 62
        i = j = 0
        while True:
            up_left = ranks[left[i + 1]] if i + 1 < len(left) else none
            up_right = ranks[right[j + 1]] if j + 1 < len(right) else none
            across = ranks.get(left[i] + right[j], none)
            if across < up_left and across <= up_right and across != none:
                return False
            if up_left == up_right == none:
                return True
            if up_left <= up_right:
                i += 1
            else:
                j += 1

    def extend(self, data: bytes, table: array, end: int | None = None) -> array:
        """Append the entries of ``data`` from ``len(table)`` to ``end``, in place.

        The last token of a prefix is the one of those that end there that fits the
        last token of the prefix in front of it; there is exactly one.
        """
        ranks, known, size, lengths = self.ranks, self._fits, self.size, self.lengths
        for stop in range(len(table) + 1, (len(data) if end is None else end) + 1):
            low = stop - 4 if stop > 4 else 0
            here = (lengths.get(data[low:stop]) or lengths.get(data[low + 1:stop]) or lengths.get(data[low + 2:stop]) or lengths.get(data[low + 3:stop])
                    or lengths[data[stop - 1:stop]])
            for n in here:
                start = stop - n
                if start < 0:
                    continue
                t = ranks.get(data[start:stop])
                if t is None:
                    continue
                if not start:
                    table.append(t)
                    break
                key = table[start - 1] * size + t
                fits = known.get(key)
                if fits is None:
                    if len(known) >= self.memory:
                        known.clear()
                    fits = known[key] = self.fits(table[start - 1], t)
                if fits:
                    table.append(t)
                    break
            else:
                raise ValueError("the vocabulary lacks a byte")
        return table

    def table(self, data: bytes) -> array:
        """The last token of every prefix of ``data``."""
        return self.extend(data, array("i"))

    def edit(self, old: array, start: int, stop: int, new: bytes, data: bytes) -> array:
        """The table of ``data``, the old bytes with ``[start:stop]`` replaced by ``new``.

        Entries before the edit stay. Behind it they are computed until as many
        as the longest token is long agree with the old ones; the rest is copied.
        """
        table, shift, same = old[:start], stop - start - len(new), 0
        while len(table) < len(data):
            self.extend(data, table, len(table) + 1)
            if len(table) > start + len(new):
                same = same + 1 if table[-1] == old[len(table) - 1 + shift] else 0
                if same == self.longest:
                    table.extend(old[len(table) + shift:])
        return table

    def read(self, table: array) -> list[int]:
        """The tokens of a piece off its table."""
        out, end = [], len(table)
        while end:
            t = table[end - 1]
            out.append(t)
            end -= len(self.token[t])
        return out[::-1]

    def encode(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)  # as the library does, also for tokens that no merge reaches
        return [whole] if whole is not None else self.read(self.table(piece))

    def known_pieces(self) -> dict[str, bytes]:
        return self._pieces

    def learn(self, pieces: set[str]) -> None:
        """Remember the ids of many pieces. In the order of their bytes, a piece takes over the
        table of the one before as far as they have a prefix in common."""
        if len(self._pieces) + len(pieces) > self.memory:
            self._pieces.clear()
        before, table = b"", array("i")
        for data in sorted(p.encode() for p in pieces):
            whole = self.ranks.get(data)
            if whole is None:
                k, most = 0, min(len(before), len(data))
                while k < most and before[k] == data[k]:
                    k += 1
                before, table = data, self.extend(data, table[:k])
                ids = self.read(table)
            else:
                ids = [whole]
            self._pieces[data.decode()] = struct.pack(f"<{len(ids)}I", *ids)

    def packed(self, piece: str) -> bytes:
        """The ids of a piece as little-endian 32-bit integers; pieces that recur are remembered."""
        got = self._pieces.get(piece)
        if got is None:
            ids = self.encode(piece.encode())
            got = struct.pack(f"<{len(ids)}I", *ids)
            if len(piece) <= 64:
                if len(self._pieces) >= self.memory:
                    self._pieces.clear()
                self._pieces[piece] = got
        return got


def _runs_of(points: list[int]) -> str:
    """Code points as ranges of a character class."""
    out = []
    for _, g in itertools.groupby(enumerate(points), lambda x: x[1] - x[0]):
        g = [c for _, c in g]
        out.append(f"\\U{g[0]:08x}-\\U{g[-1]:08x}")
    return "".join(out)


def newer_letters() -> tuple[str, str]:
    """Character classes of the code points that Python's tables count as letters and as
    numbers and the library's older ones do not, measured by asking both."""
    import tiktoken
    single = {bytes([i]): i for i in range(256)}
    points = [c for c in range(0x80, 0x110000) if not 0xD800 <= c < 0xE000]
    out = []
    for kind in (r"\p{L}", r"\p{N}"):
        theirs = tiktoken.Encoding("probe", pat_str=kind, mergeable_ranks=single, special_tokens={})
        ours = regex.compile(kind)
        mine = [c for c in points if ours.match(chr(c))]
        out.append(_runs_of([c for c in mine if not theirs.encode_ordinary(chr(c))]))
    return out[0], out[1]


class Splitter:
    """Pieces of a text by :data:`PATTERN`, as the library's tables of letters and numbers have them."""

    def __init__(self, newer: tuple[str, str], window: int = 1 << 20):
        letters, numbers = newer
        self.window = window
        self.usual = regex.compile(PATTERN)
        self.odd = regex.compile(f"[{letters}{numbers}]") if letters or numbers else None
        if self.odd:
            letter = rf"[\p{{L}}--[{letters}]]" if letters else r"\p{L}"
            number = rf"[\p{{N}}--[{numbers}]]" if numbers else r"\p{N}"
            other = rf"[[^\s\p{{L}}\p{{N}}]||[{letters}{numbers}]]"
            self.exact = regex.compile(PATTERN.replace(r"[^\s\p{L}\p{N}]", other).replace(r"\p{L}+", letter + "+").replace(r"\p{N}+", number + "+"), regex.V1)

    def pieces(self, text: str, start: int = 0) -> Iterator[list[str]]:
        """The pieces from ``start`` (a piece's start), in lists; a long text goes window by window.

        A window's last pieces, whose end may depend on what follows, are found again in the next.
        """
        pattern = self.exact if self.odd and not text.isascii() and self.odd.search(text) else self.usual
        size = self.window
        while start < len(text):
            got = pattern.findall(text[start:start + size] if start or size < len(text) else text)
            if start + size < len(text):
                spare = 0
                while got and spare <= AHEAD:
                    spare += len(got.pop())
                if not got:
                    size *= 2
                    continue
                size = self.window
            yield got
            start += sum(map(len, got))


class TextState:
    """A text with its pieces and their tables; edits give the state of the edited text."""

    def __init__(self, text: str, pieces: list[str], tables: list[array]):
        self.text, self.pieces, self.tables = text, pieces, tables

    @classmethod
    def of(cls, text: str, coder: PrefixCoder, splitter: Splitter) -> TextState:
        pieces = list(itertools.chain.from_iterable(splitter.pieces(text)))
        return cls(text, pieces, [coder.table(p.encode()) for p in pieces])

    def ids(self, coder: PrefixCoder) -> list[int]:
        """The tokens of the text (each piece that is a token as a whole is that token)."""
        out = []
        for p, t in zip(self.pieces, self.tables, strict=True):
            whole = coder.ranks.get(p.encode())
            out += [whole] if whole is not None else coder.read(t)
        return out

    def edit(self, start: int, stop: int, new: str, coder: PrefixCoder, splitter: Splitter) -> TextState:
        """The state after the characters ``[start:stop]`` are replaced by ``new``.

        Pieces whose end cannot depend on the edit are kept, and so are the ones
        from where old and new pieces start at the same place behind it. The first
        new piece takes up the table of the old one as far as their bytes agree.
        """
        text = self.text[:start] + new + self.text[stop:]
        begins = [0, *itertools.accumulate(map(len, self.pieces))]
        head = 0
        while head < len(self.pieces) and begins[head + 1] + AHEAD <= start:
            head += 1
        shift = len(new) - (stop - start)
        later = {b + shift: i for i, b in enumerate(begins) if b >= stop}
        pieces, tables, at = self.pieces[:head], self.tables[:head], begins[head]
        for p in itertools.chain.from_iterable(splitter.pieces(text, at)):
            if at in later and at >= start + len(new):
                tail = later[at]
                pieces, tables = pieces + self.pieces[tail:], tables + self.tables[tail:]
                break
            data, i = p.encode(), len(pieces)
            if i == head and i < len(self.pieces):
                tables.append(_resumed(coder, self.pieces[i].encode(), self.tables[i], data))
            else:
                tables.append(coder.table(data))
            pieces.append(p)
            at += len(p)
        return TextState(text, pieces, tables)


def _resumed(coder: PrefixCoder, old: bytes, table: array, data: bytes) -> array:
    """The table of ``data`` from that of ``old``: equal bytes in front and behind are one edit in between."""
    least = min(len(old), len(data))
    front = next((i for i in range(least) if old[i] != data[i]), least)
    back = next((i for i in range(least - front) if old[-1 - i] != data[-1 - i]), least - front)
    return coder.edit(table, front, len(old) - back, data[front:len(data) - back], data)


def _shared(spark: SparkSession, path: str):
    """The vocabulary for tasks, with the halves of its tokens; its size is that of the file, whatever the texts."""
    ranks = load_ranks(path)
    return spark.sparkContext.broadcast((ranks, last_merges(ranks), newer_letters()))


def _token_bytes(ranks: dict[bytes, int]) -> segments.TokenBytes:
    token = {i: t for t, i in ranks.items()}
    if any(i not in token for i in range(len(token))):
        raise ValueError("the vocabulary's ids have gaps")
    return segments.TokenBytes([token[i] for i in range(len(token))])


def encode_documents(docs: DataFrame, path: str, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``<id_col>, n_tokens long, ids binary`` (little-endian unsigned 32-bit token ids), one row per row.

    Whole texts, no special tokens: the ids that the vocabulary's library gives
    for each piece of the text by itself. A null text is an empty one without
    tokens. Null and repeated ids are kept, other columns are not read, and an
    empty table gives none. No shuffle.
    """
    shared = _shared(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, halves, newer = shared.value
        coder, splitter = PrefixCoder(ranks, halves), Splitter(newer)

        def packed(text: str) -> bytes:
            return b"".join(b"".join(map(coder.packed, p)) for p in splitter.pieces(text))

        def encode(some: list[str]) -> tuple[np.ndarray, np.ndarray]:
            pieces = [list(itertools.chain.from_iterable(splitter.pieces(x))) for x in some]
            known = coder.known_pieces()
            coder.learn({p for row in pieces for p in row if p not in known and len(p) <= 64})
            found = [b"".join(map(coder.packed, row)) for row in pieces]
            return np.frombuffer(b"".join(found), "<i4"), np.array([len(x) // 4 for x in found], np.int64)

        # no piece goes on from another character to white space behind it, so segments are encoded by themselves
        store, tokens = segments.Store(encode, at_once=1 << 15), _token_bytes(ranks)
        for batch in batches:
            for part in bytescan.slices(batch, "text", 2 << 20):
                texts, cut = part.column("text"), segments.Texts(*bytescan.buffer_of(part.column("text")))
                ids, ends = store.ids_of(cut)
                true = segments.true_texts(cut, ids, ends, tokens)
                data = ids.astype("<i4").tobytes()
                rows = [data[4 * a:4 * b] for a, b in itertools.pairwise(ends.tolist())]
                for i, text in enumerate(texts.to_pylist()):
                    if text and (not true[i] or not text.isascii() and segments.WIDE_SPACE.search(text)):
                        rows[i] = packed(text)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array([len(x) // 4 for x in rows], pa.int64()), pa.array(rows, pa.binary())],
                                                 [id_col, "n_tokens", "ids"])
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")).mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, ids binary")


def decode_documents(encoded: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """The rows of ``encoded`` with ``decoded binary``, the bytes of their tokens joined; null ids give null.

    An id that the vocabulary lacks is an error. Bytes need not be valid UTF-8:
    ids cut anywhere decode to the bytes they stand for.
    """
    shared = _shared(encoded.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _token_bytes(shared.value[0])
        for batch in batches:
            for part in bytescan.slices(batch, "ids", 4 << 20):
                data = [None if x is None else known.joined(np.frombuffer(x, "<u4")).tobytes() for x in part.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("row"), part.column("ids"), pa.array(data, pa.binary())], ["row", "ids", "decoded"])

    rest = [c for c in encoded.columns if c != ids]
    packed = encoded.select(F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(rest)], F.lit(0).alias("c")).alias("row"), F.col(ids).alias("ids"))
    inner = ", ".join([*(f"c{i}: {encoded.schema[c].dataType.simpleString()}" for i, c in enumerate(rest)), "c: int"])
    out = packed.mapInArrow(run, f"row struct<{inner}>, ids binary, decoded binary")
    return out.select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(rest)], F.col("ids").alias(ids), "decoded")


def edit_documents(docs: DataFrame, edits: DataFrame, path: str) -> DataFrame:
    """``doc_id, text, ids binary, n_tokens, n_kept``: each document after each of its edits.

    ``docs`` has ``doc_id, text``, ``edits`` has ``doc_id, start, stop, new``: the
    characters ``[start:stop]`` (clamped to the text; null is 0 for start and the
    text's end for stop) become ``new`` (null: nothing). An append is start and
    stop at or beyond the end. Only pieces near the edit are encoded anew;
    ``n_kept`` counts the pieces taken over. Several edits of an id give a row
    each; ids that are null or in one table alone give none.
    """
    shared = _shared(docs.sparkSession, path)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, halves, newer = shared.value
        coder, splitter = PrefixCoder(ranks, halves), Splitter(newer)
        for batch in batches:
            for part in bytescan.slices(batch, "text"):
                out = []
                for row in part.to_pylist():
                    text = row["text"] or ""
                    start = min(max(row["start"] or 0, 0), len(text))
                    stop = len(text) if row["stop"] is None else min(max(row["stop"], start), len(text))
                    before = TextState.of(text, coder, splitter)
                    after = before.edit(start, stop, row["new"] or "", coder, splitter)
                    known = set(map(id, before.tables))
                    ids = np.array(after.ids(coder), "<u4")
                    out.append({"doc_id": row["doc_id"], "text": after.text, "ids": ids.tobytes(), "n_tokens": len(ids),
                                "n_kept": sum(id(t) in known for t in after.tables)})
                yield from pa.Table.from_pylist(out, pa.schema([part.schema.field("doc_id"), ("text", pa.string()), ("ids", pa.binary()),
                                                                ("n_tokens", pa.int64()), ("n_kept", pa.int64())])).to_batches()
    pairs = docs.select("doc_id", "text").join(edits.select("doc_id", F.col("start").cast("long"), F.col("stop").cast("long"), "new"), "doc_id")
    return pairs.mapInArrow(run, f"doc_id {kind}, text string, ids binary, n_tokens long, n_kept long")
