"""Sorted distinct values without hashing."""

import time

import numpy as np

from kerbside.llm import arrays as A


def test_distinct():
    rng = np.random.default_rng(1)
    for n in (0, 1, 5, 4_000):
        values = rng.integers(0, 1 + n // 2, n).astype(np.uint64)
        assert (A.distinct(values) == sorted(set(values.tolist()))).all()


def test_distinct_sorts_a_block_in_no_time():
    values = np.random.default_rng(2).integers(0, 1 << 63, 2_000_000).astype(np.uint64)
    begin = time.process_time()
    assert len(A.distinct(values)) > 1_999_000
    assert time.process_time() - begin < 1.5
