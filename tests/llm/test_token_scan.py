"""Flat files against direct counts, over block sizes that cut documents anywhere."""

import numpy as np
import pytest

from strata.llm import token_scan as T

TEXTS = ["the cat sat", "", None, "a" * 5000, "über alles <|endoftext|> x", " \n\n ", "one two three four five six seven"] * 3


@pytest.mark.parametrize("block", [1, 7, 64, 1 << 22])
def test_round_trip(spark, block):
    import tiktoken
    coder = tiktoken.Encoding("t", pat_str=T.PATTERN, mergeable_ranks=T.load_ranks(T.VOCABULARY), special_tokens={})
    rows = [*enumerate(TEXTS if block > 1 else TEXTS[:6]), (None, "null id"), (1, "the cat")]
    df = spark.createDataFrame([(d, t, "p", 7) for d, t in rows], "doc_id long, text string, path string, number int")
    got = sorted(((r.doc_id, r.n_tokens) for r in T.document_token_counts(df, block_tokens=block).collect()), key=repr)
    assert got == sorted(((d, len(coder.encode_ordinary(t or ""))) for d, t in rows), key=repr)


@pytest.mark.parametrize("block", [1, 3, 1000])
@pytest.mark.parametrize("width", [2, 4])
def test_foreign_files(spark, tmp_path, block, width):
    files = {"a": [5, 9, 9, 1, 2, 3], "b": [], "c": [9], "d": [1, 2, 3, 4], "e": [9, 9, 9], "f": [1] * 50 + [9] + [2] * 20 + [9]}
    want = []
    for k, ids in files.items():
        (tmp_path / f"{k}.bin").write_bytes(np.array(ids, f"<u{width}").tobytes() + (b"x" if k == "d" else b""))
        docs, now = [], 0
        for i in ids:
            if i == 9:
                docs.append((now, True))
                now = 0
            else:
                now += 1
        docs += [(now, False)] if now else []
        want += [(k, n, size, closed) for n, (size, closed) in enumerate(docs)]
    got = T.scan_token_files(T.list_files(spark, str(tmp_path)), end_id=9, width=width, block_tokens=block).collect()
    assert sorted((r.path.rsplit("/", 1)[1][0], r.number, r.n_tokens, r.closed) for r in got) == sorted(want)


def test_empty_table(spark):
    assert T.document_token_counts(spark.createDataFrame([], "doc_id long, text string")).collect() == []
