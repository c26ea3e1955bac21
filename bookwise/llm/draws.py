"""Exact random draws of counts, on the driver, over tables whose size is a parameter."""

from __future__ import annotations

import math

import numpy as np


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of ``n`` items drawn without replacement are good.

    Inversion of the distribution over 12 standard deviations around its mode
    (what lies outside has less than 1e-30 of the mass), built from the ratios of
    neighbouring probabilities, so populations of any size can be drawn from.
    """
    low, high = max(0, n - bad), min(n, good)
    if low == high:
        return low
    total = good + bad
    mode = min(max((n + 1) * (good + 1) // (total + 2), low), high)
    spread = math.sqrt(n * (good / total) * (bad / total) * (total - n) / max(1, total - 1))
    width = int(12 * spread) + 30
    first, last = max(low, mode - width), min(high, mode + width)
    k = np.arange(first, last, dtype=np.float64)
    steps = np.log(good - k) + np.log(n - k) - np.log(k + 1) - np.log(bad - n + k + 1)
    logs = np.concatenate([[0.0], np.cumsum(steps)])
    mass = np.cumsum(np.exp(logs - logs.max()))
    return first + min(int(np.searchsorted(mass, rng.random() * mass[-1], side="right")), last - first)


def multivariate(rng: np.random.Generator, colours: list[int], n: int) -> list[int]:
    """Counts per colour of ``n`` items drawn without replacement."""
    left, drawn = sum(colours), []
    for count in colours:
        left -= count
        drawn.append(hypergeometric(rng, count, left, n))
        n -= drawn[-1]
    return drawn


def communication_matrix(rng: np.random.Generator, sources: list[int], targets: list[int]) -> list[list[int]]:
    """How many items go from each source to each target under a uniform permutation of all items."""
    left, matrix = list(targets), []
    for count in sources:
        row = multivariate(rng, left, count)
        left = [a - b for a, b in zip(left, row)]
        matrix.append(row)
    return matrix


def splitting_tree(rng: np.random.Generator, quotas: list[int], sizes: list[int]) -> list[list[int]]:
    """Quotas per source, split over the shards: one list of counts per shard.

    A node holds the quotas of a run of shards. Its left half takes a multivariate
    hypergeometric draw of exactly as many items as its shards hold, the right
    half the rest.
    """
    if len(sizes) == 1:
        return [list(quotas)]
    half = len(sizes) // 2
    left = multivariate(rng, quotas, sum(sizes[:half]))
    right = [a - b for a, b in zip(quotas, left)]
    return splitting_tree(rng, left, sizes[:half]) + splitting_tree(rng, right, sizes[half:])


def even(total: int, parts: int) -> list[int]:
    """``total`` in ``parts`` sizes at most one apart."""
    return [total // parts + (i < total % parts) for i in range(parts)]
