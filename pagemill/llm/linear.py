"""Hashed sparse logistic regression by follow-the-regularised-leader updates."""

from __future__ import annotations

import zlib
from collections.abc import Iterable

import numpy as np


class Hashes(dict):
    """Word to hash, worked out once for each word; starts anew when it is full."""

    def __init__(self, most: int = 300_000):
        super().__init__()
        self.most = most

    def __missing__(self, word) -> int:
        if len(self) >= self.most:
            self.clear()
        h = self[word] = zlib.crc32(word if isinstance(word, bytes) else word.encode())
        return h

    def of(self, words: list) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


class Ftrl:
    """Per-coordinate FTRL-proximal. Weights stay exactly zero until the evidence passes ``l1``."""

    def __init__(self, size: int, alpha: float = 0.1, beta: float = 1.0, l1: float = 0.1, l2: float = 0.1):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(size), np.zeros(size)

    def at(self, idx: np.ndarray) -> np.ndarray:
        z = self.z[idx]
        w = (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(self.n[idx])) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def update(self, idx: np.ndarray, value: np.ndarray, label: int) -> None:
        """One example; ``idx`` has no repeats."""
        w = self.at(idx)
        g = (sigmoid(float(w @ value)) - label) * value
        n = self.n[idx]
        self.z[idx] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[idx] = n + g * g

    def weights(self) -> np.ndarray:
        return self.at(np.arange(len(self.z)))


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit(size: int, examples: list[tuple[np.ndarray, np.ndarray]], labels: Iterable[int], epochs: int = 4, **params) -> np.ndarray:
    """Weights after ``epochs`` passes in the given order."""
    model = Ftrl(size, **params)
    labels = [int(y) for y in labels]
    for _ in range(epochs):
        for (idx, value), y in zip(examples, labels, strict=True):
            model.update(idx, value, y)
    return model.weights()
