"""A task's strings are gathered in memory that does not follow its batch."""

import tracemalloc

import numpy as np
import pyarrow as pa

from strata.llm import ppm


def test_gathering_holds_little_beside_the_text():
    rng = np.random.default_rng(3)
    words = ["".join(chr(97 + c) for c in rng.integers(0, 26, 6)) for _ in range(300)]
    texts = [" ".join(words[i] for i in rng.integers(0, 300, 150)) for _ in range(8000)]  # 8 MB
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    tracemalloc.start()
    rows = sum(b.num_rows for b in ppm._gather(5)(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows > 10_000
    assert peak < 120 << 20
