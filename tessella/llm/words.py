"""Words and hashes of words, on the Python side.

A word is a run of [^\\x20\\x09-\\x0D]: what bytes.split() yields from UTF-8.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import xxhash

_GOLD = np.uint64(0x9E3779B97F4A7C15)
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_S30, _S27, _S31 = np.uint64(30), np.uint64(27), np.uint64(31)


def split_words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split() if text else []


class WordHashes(dict):
    """word -> 64-bit hash, kept for the words of one task; emptied when it has grown large."""

    LARGEST = 200_000

    def __init__(self, seed: int) -> None:
        super().__init__()
        self.seed = seed

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LARGEST:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word, self.seed)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = (x ^ (x >> _S30)) * _MIX[0]
    x = (x ^ (x >> _S27)) * _MIX[1]
    return x ^ (x >> _S31)


def chain(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hash of a sequence from the hashes of its two parts."""
    with np.errstate(over="ignore"):
        return mix(left * _GOLD + right)


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive words, by doubling; len(h) - k + 1 of them."""
    if len(h) < k:
        return h[:0]
    power, width, done, have = h, 1, None, 0
    while True:
        if k & width:
            part = power[have:] if have else power
            done = part if done is None else chain(done[: len(part)], part[: len(done)])
            have += width
        if have == k:
            return done
        power, width = chain(power[:-width], power[width:]), 2 * width


def sliding_min(h: np.ndarray, n: int) -> np.ndarray:
    """Smallest of every n consecutive values."""
    width = 1
    while 2 * width <= n:
        h = np.minimum(h[:-width], h[width:])
        width *= 2
    return np.minimum(h[: len(h) - (n - width)], h[n - width :]) if n > width else h


def covered(starts: Iterable[int], ends: Iterable[int], n: int) -> np.ndarray:
    """Which of n words lie in one of the ranges [start, end)."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, np.asarray(starts, np.int64), 1)
    np.add.at(step, np.asarray(ends, np.int64), -1)
    return np.cumsum(step[:n]) > 0


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
