"""Alignment of two tokenizers over the same texts.

Both token sequences of a text cover the same bytes. Every token points to its
farthest-right overlapping token; a chain of such pointers ends at the last
token of the stretch in which the two sequences share no inner boundary.
Successor doubling (``next = next[next]`` until nothing moves) takes all tokens
of many texts to that terminal token at once, in as many rounds as the
logarithm of the longest chain; tokens with one terminal are one group.

Counts of linked id pairs are partial sums of each task, added up by one
aggregate. The commonest pairs (a bounded number) go to the tasks that read the
documents; the others meet their documents in an equi-join.
"""

from __future__ import annotations

import itertools
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm import bytescan, segments
from strata.llm.shared import Scratch

#: distinct pairs that a task of the count holds before it hands them on
HELD = 2_000_000


#: ASCII white space, of which all but the carriage return may begin a segment (side B has tokens such as ";" and it)
_SPACE, _CUT = " \t\n\x0b\x0c\r", " \t\n\x0b\x0c"


class SideA:
    """A tokenizer in the ``tokenizers`` library's JSON, whose entries are byte-level encoded."""

    def __init__(self, data: bytes):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self.coder = Tokenizer.from_buffer(data)
        self.coder.encode_special_tokens = True  # their strings inside a text are plain text
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]  # bytes that stand for themselves
        hidden = [b for b in range(256) if b not in set(shown)]
        byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
        size = max(self.coder.get_vocab(with_added_tokens=True).values(), default=-1) + 1
        names = [self.coder.id_to_token(i) or "" for i in range(size)]
        self.token = [bytes(byte[c] for c in t) if all(c in byte for c in t) else t.encode() for t in names]
        spec = json.loads(data)
        split = spec.get("pre_tokenizer") or {}
        #: texts split at white space by the byte-level pattern alone
        self.by_segment = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space") and not spec.get("normalizer")

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Whole texts, each with a space in front."""
        return self.encode_segments([" " + t for t in texts])

    def encode_segments(self, segments: list[str]) -> list[list[int]]:
        return [e.ids for e in self.coder.encode_batch_fast(segments, add_special_tokens=False)]


class SideB:
    """A SentencePiece model, which puts the space in front of a text by itself."""

    def __init__(self, data: bytes):
        import sentencepiece
        self.coder = sentencepiece.SentencePieceProcessor(model_proto=data)
        pieces = [self.coder.id_to_piece(i) for i in range(self.coder.vocab_size())]
        self.token = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in pieces]
        # no piece goes on from another character to white space, and a line feed joins with nothing
        inner = re.compile(f"(?s)[^{_SPACE}][{_CUT}]|\n.|.\n")
        self.by_segment = not any(inner.search(p.replace("▁", " ")) for p in pieces) and [pieces[i] for i in self.coder.encode("\n")] == ["▁", "<0x0A>"]

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Whole texts; the model adds the space."""
        return self.coder.encode(texts, num_threads=1)

    def encode_segments(self, segments: list[str]) -> list[list[int]]:
        # the model's own space is the segment's, or stands apart before a line feed
        plain = [s[1:] if s[:1] == " " else "\n" + s for s in segments]
        return [ids if s[:1] == " " else ids[2:] for s, ids in zip(segments, self.coder.encode(plain, num_threads=1), strict=True)]


class _Tokens:
    """One side's ids of a batch of texts, flat with offsets, whose bytes are checked against the texts'."""

    def __init__(self, side):
        self.side, self.bytes, self.store = side, segments.TokenBytes(side.token), segments.Store(self._encode, 1 << 18)

    def _encode(self, some: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = self.side.encode_segments(some)
        n = np.array([len(x) for x in found], np.int64)
        return np.fromiter((t for x in found for t in x), np.int32, int(n.sum())), n

    def of(self, texts: segments.Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, offsets and which texts' bytes are those of their tokens; texts that are not have no ids here."""
        ids, ends = self.store.ids_of(texts)
        good = segments.true_texts(texts, ids, ends, self.bytes)
        n = np.where(good, np.diff(ends), 0)
        return ids[np.repeat(good, np.diff(ends))], np.concatenate([[0], np.cumsum(n)]), good

    def whole(self, text: str) -> np.ndarray | None:
        """The ids of a text asked for as a whole, if their bytes are its."""
        ids = np.array(self.side.encode([text])[0], np.int32)
        return ids if self.bytes.joined(ids).tobytes() == b" " + text.encode() else None


def _spaced(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes with a space in front of each."""
    to = off + np.arange(len(off))
    out = np.full(len(raw) + len(off) - 1, 0x20, np.uint8)
    body = np.ones(len(out), bool)
    body[to[:-1]] = False
    out[body] = raw
    return out, to


def tokenize_both(docs: DataFrame, a_file: bytes, b_file: bytes) -> DataFrame:
    """``doc_id, a binary, b binary``: the ids of both sides (:func:`packed`), one row per row of ``docs``.

    A text that is null or empty, or whose joined bytes of a side differ from
    the space and the text, has no tokens on either side. Neither tokenizer
    joins a character with white space behind it, so texts are cut there and
    each distinct segment of a task is encoded once (remembered up to a bound);
    a text with other than ASCII white space, and one whose bytes then differ,
    is encoded as a whole, and so is every text if a vocabulary breaks the rule.
    """
    shared = docs.sparkSession.sparkContext.broadcast((a_file, b_file))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = [_Tokens(kind(data)) for kind, data in zip((SideA, SideB), shared.value, strict=True)]
        by_segment = all(s.side.by_segment for s in sides)
        for batch in batches:
            for part in bytescan.slices(batch, "text", 1 << 20):
                texts = part.column("text")
                cut = segments.Texts(*_spaced(*bytescan.buffer_of(texts)), carriage_return=False)
                found = [s.of(cut) for s in sides]
                good = found[0][2] & found[1][2] & by_segment
                rows = [[ids[x:y] for x, y in itertools.pairwise(ends.tolist())] for ids, ends, _ in found]
                for i, text in enumerate(texts.to_pylist()):
                    if not text:
                        good[i] = False
                    elif not good[i] or not text.isascii() and segments.WIDE_SPACE.search(text):
                        whole = [s.whole(text) for s in sides]
                        good[i] = whole[0] is not None and whole[1] is not None
                        for r, x in zip(rows, whole, strict=True):
                            r[i] = x
                cols = [packed([x if ok else _NONE for x, ok in zip(r, good.tolist(), strict=True)]) for r in rows]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *cols], ["doc_id", "a", "b"])
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, a binary, b binary")


_NONE = np.zeros(0, np.int32)


def packed(rows: list[np.ndarray]) -> pa.Array:
    """Ids per row as little-endian integers: of 16 bits behind a zero byte, or of 32 behind a one."""
    out = []
    for ids in rows:
        wide = len(ids) > 0 and int(ids.max()) > 0xFFFF
        out.append((b"\x01" if wide else b"\x00") + ids.astype("<u4" if wide else "<u2").tobytes())
    return pa.array(out, pa.binary())


def unpacked(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all rows and the offsets of the rows among them."""
    rows = [np.frombuffer(x, "<u4" if x[0] else "<u2", offset=1) for x in col.to_pylist()]
    return np.concatenate([_NONE, *rows]).astype(np.int64), np.concatenate([[0], np.cumsum([len(x) for x in rows])]).astype(np.int64)


class Aligned:
    """Groups and links of the texts of a batch; a text's tokens of both sides cover the same bytes."""

    def __init__(self, a: np.ndarray, a_off: np.ndarray, b: np.ndarray, b_off: np.ndarray, a_length: np.ndarray, b_length: np.ndarray):
        self.a, self.b, self.a_off, self.b_off = a, b, a_off, b_off
        self.a_end, self.b_end = np.cumsum(a_length[a]), np.cumsum(b_length[b])
        # of each A token, the first and last B token that it shares a byte with
        self.first = np.searchsorted(self.b_end, self.a_end - a_length[a], "right")
        self.last = np.searchsorted(self.b_end, self.a_end, "left")
        self.n_text = len(a_off) - 1

    def terminals(self) -> np.ndarray:
        """For each A token, then each B token: the A token that ends its group."""
        n = len(self.a)
        own = np.arange(n)
        reaches = self.b_end[self.last] > self.a_end if n else np.zeros(0, bool)
        # an A token points to the B token over its end, or to itself where both end; a B token to the A token over its end
        after = np.concatenate([np.where(reaches, n + self.last, own), np.searchsorted(self.a_end, self.b_end, "left")])
        while True:
            further = after[after]
            if np.array_equal(further, after):
                return after
            after = further

    def linked(self) -> tuple[np.ndarray, np.ndarray]:
        """A and B positions of all overlapping occurrences, in order of A."""
        n = self.last - self.first + 1
        i = np.repeat(np.arange(len(self.a)), n)
        return i, self.first[i] + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)

    def text_pairs(self, b_size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text number, pair code (A id x ``b_size`` + B id) and links of each distinct pair of each text, in order."""
        i, j = self.linked()
        text = np.searchsorted(self.a_off, i, "right") - 1
        code = self.a[i] * b_size + self.b[j]
        span = int(code.max()) + 1 if len(code) else 1
        both, n = np.unique(text * span + code, return_counts=True)
        return both // span, both % span, n

    def groups(self, terminal: np.ndarray) -> tuple[np.ndarray, list[str]]:
        """Groups of each text, and written as ``a1,a2|b1;a3|b2,b3``."""
        n = len(self.a)
        ends = terminal[:n] == np.arange(n)
        count = np.concatenate([[0], np.cumsum(ends)])
        group_a = count[:-1]
        group_b = count[terminal[n:]]
        # a token's place: its own side's tokens before it and the other side's of earlier groups (for B, of its own too)
        b_before = np.searchsorted(group_b, group_a, "left")
        a_before = np.searchsorted(group_a, group_b, "right")
        mark_a = np.where(ends, 1, 0)
        mark_b = np.ones(len(self.b), np.int64) * 0
        if len(self.b):
            mark_b[np.concatenate([group_b[1:] != group_b[:-1], [True]])] = 2
            last = self.b_off[1:][np.diff(self.b_off) > 0] - 1
            mark_b[last] = 3
        code = np.empty(n + len(self.b), np.int64)
        code[np.arange(n) + b_before] = self.a * 4 + mark_a
        code[np.arange(len(self.b)) + a_before] = self.b * 4 + mark_b
        off = (self.a_off + self.b_off).tolist()
        codes = code.tolist()
        written = ["".join(map(_written, codes[x:y])) for x, y in zip(off, off[1:], strict=False)]
        return count[self.a_off[1:]] - count[self.a_off[:-1]], written


class _Decimal(dict):
    """id * 4 + mark -> the id in decimal digits and the sign behind it."""

    def __missing__(self, code: int) -> str:
        got = self[code] = str(code >> 2) + (",", "|", ";", "")[code & 3]
        return got


def _parts(batches: Iterator[pa.RecordBatch], a_length: np.ndarray, b_length: np.ndarray) -> Iterator[tuple[pa.RecordBatch, Aligned]]:
    """Parts of bounded size of all batches (``a``, ``b`` packed), aligned."""
    for batch in batches:
        for part in bytescan.slices(batch, "a", 1 << 19):
            yield part, Aligned(*unpacked(part.column("a")), *unpacked(part.column("b")), a_length, b_length)


def _count_pairs(shared, b_size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(pairs: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(n)], ["pair", "c"])

        held: list[tuple[np.ndarray, np.ndarray]] = []

        def merged() -> tuple[np.ndarray, np.ndarray]:
            keys, inverse = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
            return keys, np.bincount(inverse, np.concatenate([n for _, n in held]), len(keys)).astype(np.int64)

        for _, x in _parts(batches, *shared.value):
            held.append(np.unique(x.text_pairs(b_size)[1], return_counts=True))
            if len(held) >= 16:
                held[:] = [merged()]
                if len(held[0][0]) > HELD:
                    yield rows(*held.pop())
        if held:
            yield rows(*merged())
    return run


def pair_counts(tokens: DataFrame, a_length: np.ndarray, b_length: np.ndarray) -> DataFrame:
    """``pair, c``: in how many rows of ``tokens`` (``a``, ``b``) a pair of ids is linked, as A id x |B| + B id."""
    shared = tokens.sparkSession.sparkContext.broadcast((a_length, b_length))
    return (tokens.select("a", "b").mapInArrow(_count_pairs(shared, len(b_length)), "pair long, c long")
            .groupBy("pair").agg(F.sum("c").alias("c")))


def _most_common(pairs: DataFrame, heavy: int) -> int:
    """The least power of two that at most ``heavy`` counts are not below; a row per power of two is gathered."""
    found = pairs.groupBy(F.floor(F.log2("c")).alias("p")).count().collect()
    least = 1
    for r in sorted(found, key=lambda r: -r["p"]):
        heavy -= r["count"]
        if heavy < 0:
            return 1 << (r["p"] + 1)
    return least


def align_documents(docs: DataFrame, a_path: str, b_path: str, heavy: int = 1 << 20) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum`` (long) and ``groups_sha256``,
    one row per row of ``docs`` (``doc_id, text``).

    Side A is the tokenizer in ``a_path`` on a space and the text, side B the model in
    ``b_path`` on the text. Groups end where tokens of both end. A link is an overlapping
    pair of occurrences; the count of its ids is the number of rows that hold such a link.
    ``n_best`` counts links whose count is the highest of their A id, ties included, and
    ``count_sum`` adds the counts of all links. ``groups_sha256`` is the digest of the
    groups as ``a1,a2|b1;a3|b2,b3``.

    Null, empty and other texts without tokens (see :func:`tokenize_both`) have zeros and
    ''. Rows that repeat an id each count, null ids too. An empty table gives none. At most
    ``heavy`` pairs are broadcast, the commonest; the result is the same for any number.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "align")
    files = []
    for path in (a_path, b_path):
        with open(path, "rb") as f:
            files.append(f.read())
    lengths = [segments.TokenBytes(kind(data).token).length for kind, data in zip((SideA, SideB), files, strict=True)]
    b_size = len(lengths[1])
    tokens = scratch.table(tokenize_both(docs, *files).withColumn("rid", F.monotonically_increasing_id()), "tokens")
    counts = scratch.table(pair_counts(tokens, *lengths), "counts")
    a_id = F.floor(F.col("pair") / F.lit(b_size)).cast("int")
    # one row per id of A: bounded by its vocabulary
    top = counts.groupBy(a_id.alias("a")).agg(F.max("c").alias("top"))
    pairs = (counts.withColumn("a", a_id).join(F.broadcast(top), "a").select("pair", "c", (F.col("c") == F.col("top")).cast("long").alias("best")))
    pairs = scratch.table(pairs, "pairs")
    least = _most_common(pairs, heavy)
    common = pairs.where(F.col("c") >= least).toArrow()
    keys, c, best = (common.column(n).to_numpy() for n in ("pair", "c", "best"))
    order = np.argsort(keys)
    shared = spark.sparkContext.broadcast((*lengths, keys[order], c[order], best[order]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a_length, b_length, keys, c, best = shared.value
        for part, x in _parts(batches, a_length, b_length):
            n = part.num_rows
            text, pair, links = x.text_pairs(b_size)
            at = np.minimum(np.searchsorted(keys, pair), max(len(keys) - 1, 0))
            known = keys[at] == pair if len(keys) else np.zeros(len(pair), bool)
            per = lambda w: _summed(text[known], w, n)  # noqa: E731, B023
            hit = at[known]
            n_groups, groups = x.groups(x.terminals())
            rare = np.concatenate([[0], np.cumsum(np.bincount(text[~known], minlength=n))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [part.column("rid"), part.column("doc_id"), pa.array(np.diff(x.a_off)), pa.array(np.diff(x.b_off)), pa.array(n_groups.astype(np.int64)),
                 pa.array(_summed(text, links, n)), pa.array(per(links[known] * best[hit])), pa.array(per(links[known] * c[hit])), pa.array(groups),
                 pa.ListArray.from_arrays(pa.array(rare), pa.array(pair[~known])), pa.ListArray.from_arrays(pa.array(rare), pa.array(links[~known]))],
                ["rid", "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups", "rare", "links"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    found = tokens.mapInArrow(run, f"rid long, doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long,"
                                   " groups string, rare array<long>, links array<long>")
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))
    found = scratch.table(found.withColumn("groups_sha256", digest).drop("groups"), "found")
    rest = (found.select("rid", F.inline(F.arrays_zip(F.col("rare").alias("pair"), F.col("links").alias("n"))))
            .join(pairs.where(F.col("c") < least), "pair"))
    rest = rest.groupBy("rid").agg(F.sum(F.col("n") * F.col("best")).alias("_best"), F.sum(F.col("n") * F.col("c")).alias("_sum"))
    out = found.drop("rare", "links").join(rest, "rid", "left")
    more = lambda a, b: (F.col(a) + F.coalesce(F.col(b), F.lit(0))).cast("long").alias(a)
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", more("n_best", "_best"), more("count_sum", "_sum"), "groups_sha256")


_written = _Decimal().__getitem__


def _summed(text: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """Whole-number sums of ``weight`` per text (``text`` ascending)."""
    run = np.concatenate([[0], np.cumsum(weight, dtype=np.int64)])
    ends = np.searchsorted(text, np.arange(n + 1))
    return run[ends[1:]] - run[ends[:-1]]
