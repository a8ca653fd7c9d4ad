"""Additive quantisation: full-dimensional codebooks, beam-search codes, stored norms and lookup-table scores."""

from __future__ import annotations

import numpy as np


def _kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    centres = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        near = np.argmin((centres**2).sum(1) - 2 * x @ centres.T, axis=1)
        counts = np.bincount(near, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        used = counts > 0
        centres[used] = sums[used] / counts[used, None]
        if not used.all():  # an empty cell starts anew at a far point
            far = np.argsort(-((x - centres[near]) ** 2).sum(1))[: (~used).sum()]
            centres[np.flatnonzero(~used)[: len(far)]] = x[far]
    return centres


class Quantiser:
    """books: (M, K, d). A vector is approximated by the sum of one codeword from each book."""

    def __init__(self, books: np.ndarray, beam: int = 8) -> None:
        self.books, self.beam = np.ascontiguousarray(books, np.float32), beam
        m, k, d = self.books.shape
        flat = self.books.reshape(m * k, d)
        self._dots = (flat @ flat.T).reshape(m, k, m, k)
        self._squares = (flat**2).sum(1).reshape(m, k)

    @classmethod
    def fit(cls, x: np.ndarray, books: int = 24, words: int = 256, rounds: int = 8, seed: int = 0) -> Quantiser:
        """Each book is fitted on what the ones before leave of the vectors."""
        rng, rest, found = np.random.default_rng(seed), np.array(x, np.float32), []
        for _ in range(books):
            c = _kmeans(rest, max(1, min(words, len(rest))), rounds, rng)
            rest -= c[np.argmin((c**2).sum(1) - 2 * rest @ c.T, axis=1)]
            found.append(c)
        return cls(np.stack(found))

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes (n, M) and norms of the approximations (n). Keeps the best `beam` partial sums in each step."""
        parts = [self._encode(x[a : a + 1024]) for a in range(0, len(x), 1024)]
        m = len(self.books)
        return (np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])) if parts else (np.empty((0, m), np.uint8), np.empty(0, np.float32))

    def _encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        m, k, d = self.books.shape
        inner = (np.asarray(x, np.float32) @ self.books.reshape(m * k, d).T).reshape(len(x), m, k)
        rows = np.arange(len(x))[:, None]
        codes, costs = np.zeros((len(x), 1, 0), np.int64), np.zeros((len(x), 1), np.float32)
        for step in range(m):
            grown = costs[:, :, None] + (self._squares[step] - 2 * inner[:, step])[:, None, :]
            for j in range(step):
                grown += 2 * self._dots[j, codes[:, :, j], step]
            flat = grown.reshape(len(x), -1)
            keep = min(self.beam, flat.shape[1])
            best = np.argpartition(flat, keep - 1, axis=1)[:, :keep]
            codes = np.concatenate((codes[rows, best // k], (best % k)[:, :, None]), axis=2)
            costs = flat[rows, best]
        top = np.argmin(costs, axis=1)
        codes = codes[np.arange(len(x)), top]
        return codes.astype(np.uint8), np.sqrt((self.decode(codes) ** 2).sum(1))

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return sum(self.books[j, codes[:, j]] for j in range(len(self.books)))

    def scores(self, query: np.ndarray, codes: np.ndarray, norms: np.ndarray) -> np.ndarray:
        """<q, y> / |y| for each approximation y: larger is nearer. One table of M x K products, then lookups and the stored norms."""
        tables = self.books @ np.asarray(query, np.float32)
        out = np.zeros(len(codes), np.float32)
        for j in range(len(tables)):
            out += tables[j][codes[:, j]]
        return np.divide(out, norms, out=np.zeros_like(out), where=norms > 0)
