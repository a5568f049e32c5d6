"""Plans of the configuration program against best fit, over histograms of several shapes."""

import numpy as np
import pytest

from runlens.llm import packing

SIZE = 2048


def histogram(low, high, n, seed=3):
    counts = np.zeros(SIZE + 1, np.int64)
    np.add.at(counts, np.random.default_rng(seed).integers(low, high + 1, n), 1)
    return counts


def number(plan):
    return sum(n for _, n in plan)


@pytest.mark.parametrize("low, high, n, held", [(900, 1500, 8000, 0.2), (400, 800, 8000, 0.9), (1, 2047, 6000, 0.0), (30, 600, 6000, 0.9), (7, 7, 5000, 0.9), (1, 2047, 5, 0.0)])
def test_never_more_sequences_than_best_fit(low, high, n, held):
    counts = histogram(low, high, n)
    plan, tokens = packing.plan(counts, SIZE)
    placed = np.zeros(SIZE + 1, np.int64)
    for pattern, k in plan:
        assert sum(l * c for l, c in pattern) <= SIZE
        for l, c in pattern:
            placed[l] += k * c
    assert (placed == counts).all()
    assert number(plan) <= number(packing.best_fit(counts, SIZE))
    assert tokens >= held * (counts * np.arange(SIZE + 1)).sum()


def test_program_beats_best_fit_where_it_matters():
    counts = histogram(400, 800, 8000)
    assert number(packing.plan(counts, SIZE)[0]) < 0.97 * number(packing.best_fit(counts, SIZE))


def test_nothing_and_parts_given_back():
    assert packing.plan(np.zeros(SIZE + 1, np.int64), SIZE) == ([], 0)
    plan = [(((1000, 2),), 3), (((2000, 1), (40, 1)), 4)]
    kept, counts = packing.given_back(plan, np.zeros(SIZE + 1, np.int64), 0.5)
    assert kept == [(((1000, 2),), 3)] and counts[2000] == counts[40] == 4
    assert packing.given_back(plan, np.zeros(SIZE + 1, np.int64), 1)[0] == []
