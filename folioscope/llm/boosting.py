"""Gradient-boosted trees for yes-or-no questions, in numpy: small enough to train on the driver and to broadcast."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

CELLS = 32


@dataclass
class Boosted:
    """Trees of fixed depth on binned features; scores are log-odds."""

    rounds: int = 60
    depth: int = 3
    rate: float = 0.2
    smooth: float = 1.0
    edges: list[np.ndarray] = field(default_factory=list)
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)
    base: float = 0.0

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], 1)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        x, y = np.asarray(x, float), np.asarray(y, float)
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, CELLS)[1:-1])) for j in range(x.shape[1])]
        cells = self._binned(x)
        share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(share / (1 - share)))
        score = np.full(len(y), self.base)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            slope, curve = y - p, p * (1 - p)
            tree = self._tree(cells, slope, curve)
            self.trees.append(tree)
            score += self._value(tree, cells)
        return self

    def _tree(self, cells: np.ndarray, slope: np.ndarray, curve: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        inner = 2**self.depth - 1
        by, at = np.zeros(inner, int), np.full(inner, CELLS + 1)
        node = np.zeros(len(slope), int)
        for level in range(self.depth):
            first = 2**level - 1
            for k in range(first, first + 2**level):
                own = node == k
                if own.sum() < 10:
                    continue
                g, h = slope[own].sum(), curve[own].sum()
                best = 1e-6
                for j in range(cells.shape[1]):
                    left_g = np.cumsum(np.bincount(cells[own, j], slope[own], CELLS + 1))[:-1]
                    left_h = np.cumsum(np.bincount(cells[own, j], curve[own], CELLS + 1))[:-1]
                    gain = left_g**2 / (left_h + self.smooth) + (g - left_g) ** 2 / (h - left_h + self.smooth) - g**2 / (h + self.smooth)
                    c = int(gain.argmax())
                    if gain[c] > best:
                        best, by[k], at[k] = gain[c], j, c
            node = 2 * node + 1 + (cells[np.arange(len(node)), by[node]] > at[node])
        leaf = node - inner
        g, h = np.bincount(leaf, slope, inner + 1), np.bincount(leaf, curve, inner + 1)
        return by, at, self.rate * g / (h + self.smooth)

    def _value(self, tree: tuple, cells: np.ndarray) -> np.ndarray:
        by, at, leaves = tree
        node, rows = np.zeros(len(cells), int), np.arange(len(cells))
        for _ in range(self.depth):
            node = 2 * node + 1 + (cells[rows, by[node]] > at[node])
        return leaves[node - len(by)]

    def probability(self, x: np.ndarray) -> np.ndarray:
        """Calibrated on the training rows, as the loss is the likelihood."""
        x = np.asarray(x, float)
        if not len(x):
            return np.empty(0)
        cells = self._binned(x)
        score = np.full(len(x), self.base) + sum(self._value(t, cells) for t in self.trees)
        return 1 / (1 + np.exp(-score))
