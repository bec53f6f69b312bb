"""Bitmaps of the similarity join."""

import numpy as np
import pytest

pytest.importorskip("trajspark.llm.queries")

from trajspark.llm import jaccard_join  # noqa: E402


def test_bitmaps_take_two_bits_a_shingle_at_most_and_lose_no_link():
    rng = np.random.default_rng(6)
    for n in (1, 40, 65, 129, 300, 1000, 5000):
        base = rng.integers(0, 1 << 63, 2 * n, dtype=np.uint64)
        one = base[:n]
        assert 8 * len(jaccard_join.parity_bits(one)) <= max(64, 2 * n)
        for keep in range(0, n, max(1, n // 37)):
            two = np.concatenate([one[keep:], base[n : n + keep // 2]])
            both = n - keep
            linked = 100 * both >= 80 * (n + len(two) - both)
            bits = jaccard_join.folded([jaccard_join.parity_bits(one), jaccard_join.parity_bits(two)])
            fits = jaccard_join.slack(np.array([n, len(two)]), bits, np.array([0]), np.array([1]), 80)[0] >= 0
            assert fits or not linked
            # far ones still fall to the bitmaps
            assert not (fits and n >= 300 and both < 0.5 * n)
