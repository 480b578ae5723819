"""Packing of blocks above 200 items where best fit misses the bound."""

import numpy as np
import pytest

from quadloom.llm import packing
from tests.llm.test_packing import check


@pytest.mark.parametrize("seed, n, cap", [(1, 389, 150), (11, 254, 100)])
def test_large_blocks_reach_the_bound(seed, n, cap):
    rng = np.random.default_rng(seed)
    assert int(rng.integers(201, 600)) == n and int(rng.choice([100, 150, 1000])) == cap
    low, high = cap // int(rng.integers(4, 8)), cap // 2 + int(rng.integers(0, cap // 4))
    sizes = [int(x) for x in rng.integers(low, high, n)]
    bins = packing.pack(sizes, cap)
    check(sizes, bins, cap)
    assert len(bins) == -(-sum(sizes) // cap) < len(packing.best_fit_decreasing(sizes, cap))


@pytest.mark.parametrize("low, high, gain", [(0.2, 0.5, 0.03), (0.25, 0.5, 0.05), (0.13, 0.66, 0.005)])
def test_production_blocks_beat_best_fit(low, high, gain):
    cap = packing.CAPACITY
    rng = np.random.default_rng(3)
    sizes = [int(x) for x in rng.integers(int(low * cap), int(high * cap), packing.BLOCK_ITEMS)]
    bins = packing.pack(sizes, cap)
    check(sizes, bins, cap)
    fit = len(packing.best_fit_decreasing(sizes, cap))
    assert packing.least_containers(sizes, cap) <= len(bins) <= fit * (1 - gain)


def test_bound_counts_sizes_that_cannot_meet():
    assert packing.least_containers([60] * 5, 100) == 5 and packing.least_containers([60, 60, 40, 40, 10], 100) == 3
    assert packing.least_containers([51] * 4 + [30] * 3, 100) == 4 and packing.least_containers([], 100) == 0


def test_dominated_fillings_are_left_out():
    bag = packing.Multiset([50, 30, 28, 20, 19])
    got = packing.completions(bag, 60, 60)
    # 30 + 28 and 50 alone are undominated; 30 + 20 and 30 + 19 could be replaced by 50
    assert set(got) == {(50,), (30, 28)} and got[0] == (30, 28)
