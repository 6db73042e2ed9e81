"""Isolation forests in numpy: many small trees of many sources, built and read level by level without recursion.

A tree is a complete binary heap of ``depth`` levels; a node that isolates its sample early sends everything left with a
path length that no longer grows. Score: 2 ** -(mean path / c(sample)), in (0, 1], higher is more unusual. The random
numbers come from one table per seed, so a sample gives the same trees whichever others it is built with.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import lru_cache

import numpy as np


def usual_path(n: np.ndarray | int) -> np.ndarray:
    """Mean path of an unsuccessful search in a binary tree over ``n`` values: 0 up to one, 1 for two."""
    n = np.asarray(n, float)
    out = 2.0 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649015329) - 2.0 * (n - 1) / np.maximum(n, 1)
    return np.where(n <= 1, 0.0, np.where(n == 2, 1.0, out))


@lru_cache(maxsize=8)
def _table(seed: int, what: int, shape: tuple[int, ...]) -> np.ndarray:
    return np.random.default_rng([seed, what]).random(shape)


class Forest:
    """Trees over one sample, made by :func:`grown`."""

    def __init__(self, feature: np.ndarray, cut: np.ndarray, path: np.ndarray, rows: int) -> None:
        self.feature, self.cut, self.path, self.rows = feature, cut, path, rows
        self.depth = int(np.log2(cut.shape[1]))

    def score(self, x: np.ndarray) -> np.ndarray:
        """A score per row of ``x``; 0.5 if the sample had one row only."""
        if self.rows < 2:
            return np.full(len(x), 0.5)
        x = np.ascontiguousarray(x, float)
        trees, slots = self.cut.shape
        base = np.arange(trees)[:, None] * slots
        node = np.ones((trees, len(x)), np.int64)
        cell = np.arange(len(x))[None, :] * x.shape[1]
        flat, feature, cut = x.ravel(), self.feature.ravel(), self.cut.ravel()
        for _ in range(self.depth):
            at = base + node
            node = 2 * node + (flat[cell + feature[at]] >= cut[at])
        mean = self.path.ravel()[base + node - slots].mean(axis=0)
        return np.exp2(-mean / max(float(usual_path(self.rows)), 1e-9))


def grown(samples: Sequence[np.ndarray], trees: int = 16, rows: int = 32, seed: int = 0) -> list[Forest]:
    """A forest per sample (rows by features, no NaN); each tree sees up to ``rows`` of the sample's rows. All are built together."""
    if not samples:
        return []
    width, many = samples[0].shape[1], np.array([len(s) for s in samples])
    used, deepest, longest = np.minimum(rows, many), max(1, int(np.ceil(np.log2(max(rows, 2))))), int(many.max())
    x = np.full((len(samples), longest, width), np.nan)
    for i, s in enumerate(samples):
        x[i, : len(s)] = s
    keys = np.where(np.arange(longest)[None, None] < many[:, None, None], _table(seed, 0, (trees, longest))[None], 2.0)
    pick = np.argsort(keys, axis=2)[:, :, : min(rows, longest)]
    x = x[np.arange(len(samples))[:, None, None], pick]  # forest, tree, row, feature
    x[np.broadcast_to(np.arange(x.shape[2])[None, None] >= used[:, None, None], x.shape[:3])] = np.nan
    count = len(samples) * trees
    x = x.reshape(count, -1, width)
    real = ~np.isnan(x[:, :, 0])
    slots, tree = 1 << deepest, np.arange(count)[:, None]
    feature, cut, path = np.zeros((count, slots), np.int64), np.full((count, slots), np.inf), np.full((count, 2 * slots), -1.0)
    node = np.ones(x.shape[:2], np.int64)
    for level in range(deepest):
        now = 1 << level
        order = np.argsort(node, axis=1, kind="stable")
        flat = (tree * now + np.take_along_axis(node, order, 1) - now).ravel()
        sorted_x = np.take_along_axis(x, order[:, :, None], 1).reshape(-1, width)
        start = np.flatnonzero(np.r_[True, flat[1:] != flat[:-1]])
        low, high = np.full((count * now, width), np.nan), np.full((count * now, width), np.nan)
        size = np.zeros(count * now, np.int64)
        low[flat[start]], high[flat[start]] = np.fmin.reduceat(sorted_x, start), np.fmax.reduceat(sorted_x, start)
        size[flat[start]] = np.add.reduceat(np.take_along_axis(real, order, 1).ravel().astype(np.int64), start)
        spread = high > low
        choice = np.tile(_table(seed, 2 * level + 1, (trees, now, width)), (len(samples), 1, 1)).reshape(-1, width)
        f = np.argmax(np.where(spread, choice, -1.0), axis=1)  # one feature that still varies
        at = np.arange(len(f))
        split = spread[at, f] & (size > 1)
        place = np.tile(_table(seed, 2 * level + 2, (trees, now)), (len(samples), 1)).ravel()
        with np.errstate(invalid="ignore"):
            value = low[at, f] + place * (high[at, f] - low[at, f])
        nodes = slice(now, 2 * now)
        known = path[:, nodes].ravel()
        known = np.where((known < 0) & ~split, level + usual_path(size), known)
        path[:, 2 * now : 4 * now] = np.repeat(known, 2).reshape(count, -1)
        feature[:, nodes], cut[:, nodes] = f.reshape(count, -1), np.where(split, value, np.inf).reshape(count, -1)
        right = np.take_along_axis(x, feature[tree, node][:, :, None], 2)[:, :, 0] >= cut[tree, node]
        node = 2 * node + right
    ends, left = path[:, slots:], np.bincount((tree * slots + node - slots).ravel(), weights=real.ravel(), minlength=count * slots)
    path = np.where(ends < 0, deepest + usual_path(left.reshape(count, -1)), ends)
    cut_of = lambda a: a.reshape(len(samples), trees, slots)
    return [Forest(*parts, int(n)) for *parts, n in zip(cut_of(feature), cut_of(cut), cut_of(path), used, strict=True)]
