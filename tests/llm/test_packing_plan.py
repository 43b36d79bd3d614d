"""The plan of packing: complete, never worse than best fit alone, mostly by patterns."""

import random

import numpy as np
import pytest
from glasshouse.llm import packing


def histogram(lengths, size=2048):
    return np.bincount(lengths, minlength=size + 1)


def sequences(packed):
    return sum(n for _, n in packed)


@pytest.mark.parametrize("seed", range(12))
def test_uses_every_piece_and_no_more_sequences_than_best_fit(seed):
    rng = random.Random(seed)
    kind = [lambda: rng.randrange(1, 2049), lambda: min(2048, int(rng.lognormvariate(5.5, 1.2)) + 1), lambda: rng.choice([683, 700, 1024, 1025, 2048]), lambda: rng.randrange(1000, 1050)][seed % 4]
    h = histogram([kind() for _ in range(rng.choice([1, 7, 300, 3000]))])
    packed = packing.plan(h)
    used = np.zeros_like(h)
    for lengths, n in packed:
        assert sum(lengths) <= 2048 and n > 0
        for v in lengths:
            used[v] += n
    assert (used == h).all()
    assert sequences(packed) <= sequences(packing.best_fit(h))


def test_the_bound_is_met_where_best_fit_meets_it_and_patterns_place_most():
    rng = random.Random(1)
    h = histogram([min(2048, int(rng.lognormvariate(6, 1)) + 1) for _ in range(4000)])
    bound = -(-int((h * np.arange(len(h))).sum()) // 2048)
    assert sequences(packing.best_fit(h)) == bound and sequences(packing.plan(h)) == bound
    full = sum(n * len(lengths) for lengths, n in packing.plan(h) if sum(lengths) == 2048 and len(lengths) <= 3)
    assert full > 0.6 * h.sum()  # many of these are too short for any three to fill a sequence


def test_none():
    assert packing.plan(np.zeros(2049, dtype=np.int64)) == []
