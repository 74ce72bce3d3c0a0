"""Exact scores of outlying queries."""

import numpy as np

from linewright.llm import topk


def test_outlying_query():
    """A query far larger than a block of small rows still gets exact scores."""
    rng = np.random.default_rng(1)
    rows = rng.integers(-64, 65, (300, 64))
    block = topk.Lists(np.arange(300), rows)
    nothing = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for most in (100, 300_000, 150_000_000, 1 << 46):
        query = rng.integers(-most, most, 64)
        scores, ids = block.search(query, -1, 20, nothing)
        want = rows @ query
        by = np.lexsort((np.arange(300), -want))[:20]
        assert scores.tolist() == want[by].tolist() and ids.tolist() == by.tolist()
