"""The prefix encoder against the library of its vocabulary, exact round trips, appends and edits."""

import random

import numpy as np
import pytest
import regex
import tiktoken

from strata.llm import prefix_bpe as B
from strata.llm.queries import vocabulary

PATH = vocabulary("byte_bpe_multi_50k.tiktoken")
PARTS = [" ", "  ", "\n", "'", "'l", "l", "'s", "a", "B", "é", "ü", "漢", "字", "1", "²", "!", "?", "\t", " ", "՘", "\U000323b0", "😀", "ß", "　", "\r\n",
         "and", "the", "ing", "<|endoftext|>", "\x00"]
ODD = [(1, "the cat sat"), (1, "the cat sat"), (2, None), (3, ""), (None, "no id"), (4, " \n \t\n"), (5, "word " * 30_000 + "x" * 50_000), (6, " " * 9000), (7, "é漢😀" * 500)]


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=B.PATTERN, mergeable_ranks=B.load_ranks(PATH), special_tokens={})


@pytest.fixture(scope="module")
def coder():
    return B.PrefixCoder(B.load_ranks(PATH), memory=300)  # small, so that what is remembered is dropped on the way


@pytest.fixture(scope="module")
def newer():
    return B.newer_letters()


def joined(rng, n):
    return "".join(rng.choice(PARTS) for _ in range(rng.randrange(n)))


def encoded(text, coder, splitter):
    return [i for p in splitter.pieces(text) for x in p for i in np.frombuffer(coder.packed(x), "<u4").tolist()]


@pytest.mark.parametrize("window", [8, 1 << 20])
def test_as_the_library(library, coder, newer, window):
    rng, splitter = random.Random(window), B.Splitter(newer, window)
    for text in [joined(rng, 80) for _ in range(600)] + ["a" * 5000, "ab" * 4000, " " * 3000, "漢字" * 900]:
        assert encoded(text, coder, splitter) == library.encode_ordinary(text)


def test_every_prefix_has_one_valid_last_token(coder):
    data = "thereinafter understandings 'll".encode()
    table = coder.table(data)
    for end in range(1, len(data) + 1):
        start = end - len(coder.token[table[end - 1]])
        assert data[start:end] == coder.token[table[end - 1]]
        valid = [t for b, t in coder.ranks.items() if data[:end].endswith(b) and (len(b) == end or coder.fits(table[end - len(b) - 1], t))]
        assert valid == [table[end - 1]]
        assert coder.read(table[:end]) == [coder.ranks[t] for t in B.merge(coder.ranks, data[:end])]


def test_pairs_against_merging(coder):
    rng, ids = random.Random(9), list(coder.token)
    pairs = [(rng.choice(ids), rng.choice(ids)) for _ in range(3000)]
    whole = [t for t in coder.ranks if len(t) > 1]
    for t in rng.sample(whole, 3000):  # halves of tokens, which often merge
        at = rng.randrange(1, len(t))
        pairs += [(coder.ranks[t[:at]], coder.ranks[t[at:]])] if t[:at] in coder.ranks and t[at:] in coder.ranks else []
    fit = 0
    for a, b in pairs:
        want = B.merge(coder.ranks, coder.token[a] + coder.token[b]) == [coder.token[a], coder.token[b]]
        assert coder.fits(a, b) == want
        fit += want
    assert 500 < fit < len(pairs) - 500


def test_appends_and_edits_are_exact(library, coder, newer):
    rng, splitter = random.Random(5), B.Splitter(newer)
    for _ in range(400):
        text = joined(rng, 60)
        state = B.TextState.of(text, coder, splitter)
        for _ in range(4):
            at = rng.choice([len(state.text), rng.randrange(len(state.text) + 1)])
            to = min(len(state.text), at + rng.randrange(6))
            state = state.edit(at, to, joined(rng, 5), coder, splitter)
            assert state.ids(coder) == library.encode_ordinary(state.text)


def test_an_edit_inside_a_long_piece_computes_few_entries(coder):
    data = b"abcdefgh" * 4000
    table, done = coder.table(data), []

    class Counting(B.PrefixCoder):
        def extend(self, data, table, end=None):
            done.extend(range(len(table), len(data) if end is None else end))
            return super().extend(data, table, end)

    counting = Counting(coder.ranks, coder.halves)
    new = data[:9000] + b"Q" + data[9003:]
    assert counting.edit(table, 9000, 9003, b"Q", new) == coder.table(new)
    assert len(done) < 20 * coder.longest


def test_documents(spark, library):
    df = spark.createDataFrame([(d, t, 9, "own") for d, t in ODD], "doc_id long, text string, n_tokens int, ids string").repartition(3)
    rows = B.decode_documents(B.encode_documents(df, PATH), PATH).collect()
    got = sorted(((r.doc_id, r.n_tokens, np.frombuffer(r.ids, "<u4").tolist(), bytes(r.decoded)) for r in rows), key=repr)
    want = [(d, library.encode_ordinary(t or ""), (t or "").encode()) for d, t in ODD]
    assert got == sorted(((d, len(i), i, b) for d, i, b in want), key=repr)
    assert B.encode_documents(df.limit(0), PATH).collect() == []


def test_cut_and_foreign_ids(spark):
    ids = [[220], [0, 255, 128], []]
    df = spark.createDataFrame([(np.array(i, "<u4").tobytes(), k) for k, i in enumerate(ids)] + [(None, 3)], "ids binary, row int")
    token = {i: t for t, i in B.load_ranks(PATH).items()}
    got = {r.row: r.decoded and bytes(r.decoded) for r in B.decode_documents(df, PATH).collect()}
    assert got == {0: token[220], 1: token[0] + token[255] + token[128], 2: b"", 3: None}


def test_edited_documents(spark, library):
    docs = spark.createDataFrame([(1, "some words of a text " * 50), (2, None), (3, "abc"), (4, "unedited"), (None, "x")], "doc_id long, text string")
    edits = [(1, 30, 34, "WORDS"), (1, 10_000, None, " appended"), (2, None, None, "new"), (3, 1, 2, None), (3, -5, 99, "all"), (None, 0, 0, "y"), (7, 0, 0, "z")]
    got = B.edit_documents(docs, spark.createDataFrame(edits, "doc_id long, start int, stop int, new string"), PATH).collect()
    long = "some words of a text " * 50
    want = sorted([(1, long[:30] + "WORDS" + long[34:]), (1, long + " appended"), (2, "new"), (3, "ac"), (3, "all")])
    assert sorted((r.doc_id, r.text) for r in got) == want
    for r in got:
        assert np.frombuffer(r.ids, "<u4").tolist() == library.encode_ordinary(r.text) and r.n_tokens == len(r.ids) // 4
        assert r.doc_id != 1 or r.n_kept > 240


def test_pattern_is_the_library_files():
    import public_tokenizers
    assert B.PATTERN == public_tokenizers.PATTERN


def test_clashing_hashes_are_found():
    import pyarrow as pa

    from strata.llm import bytescan, segments
    cut = segments.Texts(*bytescan.buffer_of(pa.array(["ab cd", "", "ab xy", "cd"])))
    tokens = segments.TokenBytes([b"ab", b" cd", b" xy", b"cd", b" c"])
    good = lambda *rows: segments.true_texts(cut, np.array([i for r in rows for i in r], np.int32), np.cumsum([0, *map(len, rows)]), tokens).tolist()
    assert good([0, 1], [], [0, 2], [3]) == [True] * 4
    assert good([0, 2], [], [0, 2], [3]) == [False, True, True, True]
    assert good([0, 4], [], [0, 1], [3]) == [False, True, False, True]


def test_newer_letters_are_split_as_the_library_does(newer):
    splitter = B.Splitter(newer)
    assert splitter.odd and splitter.odd.search("՘")
    assert [x for p in splitter.pieces("a՘b") for x in p] == ["a", "՘", "b"]
    assert regex.findall(B.PATTERN, "a՘b") == ["a՘b"]
