"""Shingle sets of whole texts as sorted 64-bit hashes, and their parity sketches."""

from __future__ import annotations

import numpy as np
import xxhash

_P = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit (a finaliser of the usual multiply and shift kind)."""
    x = x.astype(np.uint64, copy=True)
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(by)
    x ^= x >> np.uint64(31)
    return x


def words_of(text: str | None) -> list[bytes]:
    """Maximal runs of characters other than space, tab, line feed, vertical tab, form feed and return, A-Z lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingle_hashes(text: str | None, k: int) -> np.ndarray:
    """The distinct k-word shingles, hashed and sorted; with fewer words the whole sequence is the one shingle."""
    words = words_of(text)
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    size = min(k, len(words))
    out = np.full(len(words) - size + 1, size, np.uint64)
    for j in range(size):
        out = mix(out * _P + h[j : j + len(out)])
    return np.unique(out)


def set_digest(hashes: np.ndarray) -> tuple[int, int]:
    """128 bits of a shingle set as two signed longs."""
    d = xxhash.xxh3_128_intdigest(hashes.tobytes())
    return tuple((d >> s & (1 << 64) - 1) - (1 << 63) for s in (64, 0))


def parity_sketch(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Each hash flips one of 2^j bits. The Hamming distance of two sketches is at most the sets' symmetric difference."""
    odd = np.bincount((mix(hashes) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def fold(sketch: np.ndarray, words: int) -> np.ndarray:
    """A sketch as it would be with fewer bits."""
    while len(sketch) > words:
        sketch = sketch[: len(sketch) // 2] ^ sketch[len(sketch) // 2 :]
    return sketch


class Bands:
    """Size bands for a threshold in percent: linked sets lie in the same or in adjacent bands.

    A band b holds sizes first[b] to first[b + 1] - 1. Its plan serves pairs whose smaller set is in it: differ[b] bounds
    their symmetric difference, and blocks[b] is larger than that by some, so that at least one block of the hash space
    holds the same shingles, and not none, in both sets.
    """

    def __init__(self, percent: int, largest: int = 1 << 31) -> None:
        if not 0 < percent <= 100:
            raise ValueError("percent must be in 1..100")
        self.percent, self.first, self.differ, self.blocks = percent, [1], [], []
        while self.first[-1] <= largest:
            a = self.first[-1]
            b = max(a + 1, (a - 1) * 100 // percent + 1)
            most = b - 1 + (b - 1) * 100 // percent
            d = most * (100 - percent) // (100 + percent)
            self.first.append(b)
            self.differ.append(d)
            self.blocks.append(d + 2 + int(1.5 * (d + 1) * np.exp(-a / (d + 1))))
        self._first = np.array(self.first)

    def of(self, size: int) -> int:
        return int(np.searchsorted(self._first, size, "right")) - 1

    def keys(self, hashes: np.ndarray) -> np.ndarray:
        """The block keys of a set under the plans of its own band and of the one below it.

        The hashes are sorted and a block is a range of them. A block's signature is the exclusive or of 64 bits for each
        shingle: a parity sketch so wide that only equal blocks agree. Empty blocks are left out where enough others remain.
        """
        own, out = self.of(len(hashes)), []
        for band in {own, max(0, own - 1)}:
            d, k = self.differ[band], self.blocks[band]
            if d == 0:
                continue  # such sets are linked only if they are equal
            block = ((hashes >> np.uint64(32)) * np.uint64(k)) >> np.uint64(32)
            starts = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1])))
            signs, at = np.bitwise_xor.reduceat(mix(hashes), starts), block[starts]
            if k - len(at) > k - d - 1:
                empty = np.setdiff1d(np.arange(k, dtype=np.uint64), at)
                signs, at = np.concatenate((signs, np.zeros(len(empty), np.uint64))), np.concatenate((at, empty))
            out.append(mix(signs + mix((np.uint64(band) << np.uint64(32)) + at)))
        return np.concatenate(out) if out else np.empty(0, np.uint64)
