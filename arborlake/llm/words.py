"""Hashes of runs of a text's words, without a step for each word."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
BYTE_BASE, WORD_BASE = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of an odd base modulo 2**64, and of its inverse."""
    if base not in _POWERS or len(_POWERS[base][0]) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        table = lambda b: np.cumprod(np.where(np.arange(size) == 0, np.uint64(1), np.uint64(b)), dtype=np.uint64)
        _POWERS[base] = table(base), table(pow(base, -1, 1 << 64))
    a, b = _POWERS[base]
    return a[:n], b[:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """A text's lower-cased, blank-separated words: byte spans, and 64-bit hashes of any runs of them.

    Sums of bytes times powers of an odd number give the hash of any word or
    run by one subtraction, so nothing is done word by word.
    """

    def __init__(self, text: bytes):
        raw = np.frombuffer(text.lower(), np.uint8)
        edge = np.diff(np.concatenate([[True], BLANK[raw], [True]]).astype(np.int8))
        self.starts, self.ends = np.nonzero(edge == -1)[0], np.nonzero(edge == 1)[0]
        up, down = powers(BYTE_BASE, len(raw) + 1)
        zero = np.zeros(1, np.uint64)
        sums = np.concatenate([zero, np.cumsum((raw + np.uint64(1)) * up[:-1], dtype=np.uint64)])
        hashes = mix((sums[self.ends] - sums[self.starts]) * down[self.starts])
        up, self.down = powers(WORD_BASE, len(hashes) + 1)
        self.sums = np.concatenate([zero, np.cumsum(hashes * up[:-1], dtype=np.uint64)])
        self.line = np.searchsorted(np.nonzero(raw == 10)[0], self.starts)

    def __len__(self) -> int:
        return len(self.starts)

    def run(self, i: np.ndarray | int, j: np.ndarray | int) -> np.ndarray:
        """Hashes of words i..j-1."""
        return mix((self.sums[j] - self.sums[i]) * self.down[i])

    def grams(self, n: int) -> np.ndarray:
        """Hashes of every run of ``n`` words; of the whole if there are fewer."""
        m = len(self)
        if m <= n:
            return self.run(np.zeros(min(m, 1), np.int64), np.full(min(m, 1), m))
        at = np.arange(m - n + 1)
        return self.run(at, at + n)

    def anchors(self, n: int, spread: int) -> np.ndarray:
        """Places of the least ``n``-gram of every ``spread`` consecutive ones: the same wherever the same words stand."""
        grams = self.grams(n)
        if len(self) < n or len(grams) < spread:
            return np.empty(0, np.int64)
        least = np.lib.stride_tricks.sliding_window_view(grams, spread).argmin(axis=1)
        return np.unique(least + np.arange(len(least)))


def parts(batch: pa.RecordBatch, text: int, rows: int, most: int = 1 << 24) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of ``rows`` rows or fewer, with at most ``most`` bytes in column ``text`` unless one text has more."""
    size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    lo, held = 0, 0
    for k in range(batch.num_rows):
        if k > lo and (k - lo >= rows or held + size[k] > most):
            yield batch.slice(lo, k - lo)
            lo, held = k, 0
        held += int(size[k])
    if batch.num_rows > lo:
        yield batch.slice(lo)


def release() -> None:
    """Gives memory that a task has freed back to the system: the worker lives on beside other tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim:
        trim(0)
