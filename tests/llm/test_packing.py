"""Operator 4's plan against the exact optimum of small histograms."""

import random
from functools import lru_cache

import numpy as np

from leadloom.llm import packing

SIZE = 24


def least(histogram):
    """The least number of sequences for whole tails, by trying all patterns for the largest tail that is left."""
    lengths = sorted(histogram, reverse=True)

    def patterns(left, room, i):
        if i == len(lengths):
            yield ()
            return
        for n in range(min(left[i], room // lengths[i]), -1, -1):
            for rest in patterns(left, room - n * lengths[i], i + 1):
                yield (n, *rest)

    @lru_cache(maxsize=None)
    def of(left):
        first = next((i for i, n in enumerate(left) if n), None)
        if first is None:
            return 0
        return 1 + min(of(tuple(a - b for a, b in zip(left, p, strict=True))) for p in patterns(left, SIZE, 0) if p[first])

    return of(tuple(histogram[k] for k in lengths))


def test_small_histograms_against_the_optimum(monkeypatch):
    calls, priced, better, own = [], packing.best_patterns, 0, random.Random(21)
    monkeypatch.setattr(packing, "best_patterns", lambda *a: calls.append(1) or priced(*a))
    for _ in range(200):
        histogram = {k: own.randint(1, 4) for k in own.sample(range(2, SIZE), own.randint(1, 5))}
        lengths, demand = np.array(sorted(histogram)), np.array([histogram[k] for k in sorted(histogram)], float)
        calls.clear()
        found, bound = packing.linear_program(lengths, demand, SIZE)
        value, greedy = sum(n for n, _ in found), packing.first_patterns(lengths, demand, SIZE)[1].sum()
        assert np.allclose(sum(n * p for n, p in found), demand) and all(p @ lengths <= SIZE for _, p in found)
        plan = packing.plan(histogram, SIZE)
        for k in histogram:
            assert sum(n * p.get(k, 0) for n, p in plan) == histogram[k]
        optimum = least(histogram)
        assert packing.rounded_up(bound) <= optimum and value <= optimum + 1e-6
        assert optimum <= sum(n for n, _ in plan) <= optimum + 1
        if packing.rounded_up(greedy) > packing.rounded_up(value):
            better += 1
            assert calls  # columns were generated wherever the greedy start is beaten
        assert packing.rounded_up(value) == packing.rounded_up(bound) or not packing.best_patterns(np.linalg.lstsq(np.array([p for _, p in found], float), np.ones(len(found)), rcond=None)[0], lengths, SIZE)[1]
    assert better >= 3


def test_columns_are_generated_on_full_histograms(monkeypatch):
    """Where the greedy start is beyond the bound, columns bring the program down, on any size."""
    calls, priced = [], packing.best_patterns
    monkeypatch.setattr(packing, "best_patterns", lambda *a: calls.append(1) or priced(*a))
    for seed, most in ((1, 3), (2, 40), (3, 5000)):
        own = random.Random(seed)
        histogram = {k: own.randint(1, most) for k in range(90, 1000, 7)}
        lengths, demand = np.array(sorted(histogram)), np.array([histogram[k] for k in sorted(histogram)], float)
        greedy = packing.first_patterns(lengths, demand, 1024)[1].sum()
        calls.clear()
        found, bound = packing.linear_program(lengths, demand, 1024)
        value = sum(n for n, _ in found)
        print(f"{most}: {demand.sum():.0f} tails, greedy {greedy:.2f}, program {value:.2f}, bound {bound:.2f}, {len(calls)} pricings")
        assert bound <= value + 1e-6 and value <= greedy + 1e-6 and (calls or packing.rounded_up(greedy) == packing.rounded_up(bound))
        assert sum(n for n, _ in packing.plan(histogram, 1024)) <= value + len(lengths) / 4
