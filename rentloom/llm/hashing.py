"""64-bit hashes of words and of runs of words, on NumPy arrays modulo 2**64."""

from __future__ import annotations

import numpy as np
import xxhash

from rentloom.llm.batches import Memo

BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)    # odd, so that they have inverses


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every input bit over the whole word (a bijection)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes:
    """Hashes of the words of a text."""

    def __init__(self) -> None:
        self.seen = Memo(xxhash.xxh3_64_intdigest)

    def __call__(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.seen.__getitem__, words), np.uint64, len(words))


class RunHashes:
    """Hashes of any runs of words in constant time each, from running sums of one text."""

    def __init__(self, base: int = BASES[0]) -> None:
        self.base = base
        self._grow(1024)

    def _grow(self, n: int) -> None:
        def powers(b: int) -> np.ndarray:
            steps = np.full(n + 1, b, np.uint64)
            steps[0] = 1
            return np.cumprod(steps, dtype=np.uint64)
        self.up, self.down = powers(self.base), powers(pow(self.base, -1, 1 << 64))

    def sums(self, hashes: np.ndarray) -> np.ndarray:
        if len(hashes) >= len(self.up):
            self._grow(2 * len(hashes))
        out = np.zeros(len(hashes) + 1, np.uint64)
        np.cumsum(hashes * self.up[:len(hashes)], out=out[1:])
        return out

    def runs(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """One hash per run [start, end); equal content gives equal hashes wherever it stands."""
        return mix((sums[end] - sums[start]) * self.down[start] + (end - start).astype(np.uint64))

    def windows(self, hashes: np.ndarray, width: int) -> np.ndarray:
        """Hashes of all runs of ``width`` words, in order; none if the text is shorter."""
        if len(hashes) < width:
            return np.zeros(0, np.uint64)
        start = np.arange(len(hashes) - width + 1)
        return self.runs(self.sums(hashes), start, start + width)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every run of ``width`` values, by doubling."""
    reach, out = 1, values
    while reach * 2 <= width:
        out = np.minimum(out[:-reach], out[reach:])
        reach *= 2
    rest = width - reach
    return np.minimum(out[:len(out) - rest], out[rest:]) if rest else out


def anchors(hashes: np.ndarray, width: int) -> np.ndarray:
    """Position of the smallest hash in every run of ``width``; the leftmost of equal ones.

    The order uses the upper 40 bits, then the position, so equal runs choose
    the same place. Runs are handled in pieces of 2**24 positions.
    """
    piece, out = (1 << 24) - width, []
    for low in range(0, max(len(hashes) - width + 1, 0), piece):
        part = hashes[low:low + piece + width - 1]
        keys = (part & ~np.uint64(0xFFFFFF)) | np.arange(len(part), dtype=np.uint64)
        out.append((sliding_min(keys, width) & np.uint64(0xFFFFFF)).astype(np.int64) + low)
    return np.concatenate(out) if out else np.zeros(0, np.int64)
