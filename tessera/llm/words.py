"""Words of many texts as arrays: one pass of numpy over their bytes.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D, so
``[^\\x20\\x09-\\x0D]+`` finds the same words. Words are known by a 64-bit hash
of their bytes: random values of the bytes, weighted by powers of an odd number.
"""

from __future__ import annotations

import ctypes
import gc

import numpy as np

_LIBC = ctypes.CDLL(None)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_VALUE = np.random.default_rng(20240917).integers(0, 2**64, 256, dtype=np.uint64) | np.uint64(1)
_ODD, _INVERSE = 0xD1342543DE82EF95, pow(0xD1342543DE82EF95, -1, 2**64)
_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)
#: Bytes that are hashed at a time.
STRIDE = 1 << 18


def give_back() -> None:
    """Hand freed memory back to the system: Python workers outlive their tasks, beside those of the next stage."""
    gc.collect()
    if hasattr(_LIBC, "malloc_trim"):  # glibc keeps what is freed otherwise
        _LIBC.malloc_trim(0)


def _grown(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverses
    if len(_powers) < n:
        n = max(n, STRIDE + (1 << 16))
        _powers = np.multiply.accumulate(np.r_[np.uint64(1), np.full(n - 1, _ODD, np.uint64)])
        _inverses = np.multiply.accumulate(np.r_[np.uint64(1), np.full(n - 1, _INVERSE, np.uint64)])
    return _powers, _inverses


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread every bit of x over all 64 bits (a bijection)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def encoded(texts) -> list[bytes]:
    return [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts]


def spans(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all texts in a row, starts and ends of their words, and the number of words of each text."""
    raw = np.frombuffer(b"\n" + b"\n".join(texts) + b"\n", np.uint8)
    space = _SPACE[raw]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    starts, ends = edge[::2], edge[1::2]
    firsts = np.cumsum([1, *(len(t) + 1 for t in texts)])
    counts = np.diff(np.searchsorted(starts, firsts))
    return raw, starts, ends, counts


def hashes(texts: list[bytes], lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every word of the texts, in order, and the number of words of each text."""
    out, sizes, batch, held = [], [], [], 0
    for i, text in enumerate(texts):
        batch.append(text)
        held += len(text) + 1
        if held >= STRIDE or i == len(texts) - 1:
            raw, starts, ends, counts = spans(batch)
            value = _VALUE[_LOWER[raw] if lower else raw]
            power, inverse = _grown(len(raw) + 1)
            total = np.cumsum(value * power[: len(raw)])
            h = (total[ends - 1] - total[starts - 1]) * inverse[starts]
            out.append(mixed(h + (ends - starts).astype(np.uint64)))
            sizes.append(counts)
            batch, held = [], 0
    if not out:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(out), np.concatenate(sizes)


def shingles(word: np.ndarray, counts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of n words within a text, and how many each text has (none if it has fewer words)."""
    if len(word) < n:
        return np.zeros(0, np.uint64), np.zeros(len(counts), np.int64)
    rolled = np.zeros(len(word) - n + 1, np.uint64)
    for j in range(n):
        rolled = mixed(rolled * np.uint64(31) + word[j : len(word) - n + 1 + j])
    ends = np.cumsum(counts)
    left = np.repeat(ends, counts)[: len(rolled)] - np.arange(len(rolled))
    return rolled[left >= n], np.maximum(counts - n + 1, 0)
