"""Signature trees: nodes hold OR-combined bitmaps and size ranges, and a dual traversal drops the pairs of nodes
whose largest possible overlap is too small."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

LEAF, FAN = 8, 4


@dataclass
class Level:
    bits: np.ndarray  # (nodes, words)
    low: np.ndarray  # sizes of the smallest and largest set below
    high: np.ndarray
    spare: np.ndarray  # the most members of a set below that share a bit with others of it


def _above(level: Level, fan: int) -> Level:
    at = np.arange(0, len(level.low), fan)
    return Level(np.bitwise_or.reduceat(level.bits, at), np.minimum.reduceat(level.low, at), np.maximum.reduceat(level.high, at), np.maximum.reduceat(level.spare, at))


def _count(bits: np.ndarray) -> np.ndarray:
    return np.bitwise_count(bits).sum(1, dtype=np.int64)


def enough(overlap: np.ndarray, sizes: np.ndarray, percent: int) -> np.ndarray:
    """Whether 100 * intersection >= percent * union, for sets whose sizes add up to `sizes`."""
    return (100 + percent) * overlap >= percent * sizes


def _kept(a: Level, b: Level, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs of nodes may hold a link, by sizes, then by their bitmaps."""
    good = (100 * b.high[j] >= percent * a.low[i]) & (100 * a.high[i] >= percent * b.low[j])
    at = np.flatnonzero(good)
    i, j = i[at], j[at]
    words = max(1, a.bits.shape[1])
    for k in range(0, len(at), max(1, 2_000_000 // words)):
        part = slice(k, k + max(1, 2_000_000 // words))
        most = _count(a.bits[i[part]] & b.bits[j[part]]) + np.minimum(a.spare[i[part]], b.spare[j[part]])
        most = np.minimum(most, np.minimum(a.high[i[part]], b.high[j[part]]))
        good[at[part]] = enough(most, a.low[i[part]] + b.low[j[part]], percent)
    return good


def linked_pairs(bits: np.ndarray, sizes: np.ndarray, percent: int, exact: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows (i < j) that may be similar enough; with exact bitmaps (no two members share a bit, and bits
    that only one row has may be left out) those that are."""
    order = np.argsort(sizes, kind="stable")
    bits, sizes = bits[order], sizes[order]
    spare = np.zeros(len(sizes), np.int64) if exact else sizes - _count(bits)
    levels = [Level(bits, sizes, sizes, spare)]
    while len(levels[-1].low) > 1:
        levels.append(_above(levels[-1], LEAF if len(levels) == 1 else FAN))
    i = j = np.zeros(1, np.int64)
    for depth in range(len(levels) - 1, 0, -1):
        below, fan = levels[depth - 1], LEAF if depth == 1 else FAN
        step = np.arange(fan)
        i, j = (np.broadcast_to(x, (len(i), fan, fan)).ravel() for x in ((i[:, None] * fan + step)[:, :, None], (j[:, None] * fan + step)[:, None, :]))
        there = (i < len(below.low)) & (j < len(below.low)) & ((i <= j) if depth > 1 else (i < j))
        i, j = i[there], j[there]
        good = _kept(below, below, i, j, percent)
        i, j = i[good], j[good]
    if len(sizes) < 2:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    if not exact:  # members of one set whose bits the other lacks cannot be shared
        good = np.ones(len(i), bool)
        for k in range(0, len(i), 50_000):
            a, b = bits[i[k : k + 50_000]], bits[j[k : k + 50_000]]
            most = np.minimum(sizes[i[k : k + 50_000]] - _count(a & ~b), sizes[j[k : k + 50_000]] - _count(b & ~a))
            good[k : k + 50_000] = enough(most, sizes[i[k : k + 50_000]] + sizes[j[k : k + 50_000]], percent)
        i, j = i[good], j[good]
    i, j = order[i], order[j]
    return np.minimum(i, j), np.maximum(i, j)


def spanning(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n rows the smallest row it reaches over the pairs."""
    label = np.arange(n)
    while len(i):
        before = label.copy()
        np.minimum.at(label, i, label[j])
        np.minimum.at(label, j, label[i])
        label = label[label]
        if (label == before).all():
            break
    return label
