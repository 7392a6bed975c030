"""Words of whole texts as 64-bit hashes, and hashes of runs of words."""

from __future__ import annotations

import numpy as np
from xxhash import xxh3_64_intdigest

_STEP, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_HALF = np.uint64(32)


def split(text: str | None) -> list[bytes]:
    """Runs of anything but ASCII white space (\\x20, \\x09-\\x0D), as UTF-8."""
    return text.encode().split() if text else []


class _Known(dict):
    """Hashes of words seen before, which saves half of the time; a bounded number."""

    LIMIT = 300_000

    def __missing__(self, word: bytes) -> int:
        got = xxh3_64_intdigest(word)
        if len(self) < self.LIMIT:
            self[word] = got
        return got


_known = _Known()


def hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_known.__getitem__, words), np.uint64, len(words))


#: Bits of a place next to the bits of a value that are compared.
_PLACE = np.uint64((1 << 32) - 1)


def first_minima(values: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Runs of windows of ``width`` values with their minimum at the same place, the leftmost of equal ones: the
    first window of each run and that place. The upper halves of the values are compared, so a window's
    minimum is where its values say, whatever surrounds it."""
    low, size = values & ~_PLACE | np.arange(len(values), dtype=np.uint64), 1
    while size < width:
        step = min(size, width - size)
        low, size = np.minimum(low[:-step], low[step:]), size + step
    places = (low & _PLACE).astype(np.int64)
    starts = np.flatnonzero(np.append(True, places[1:] != places[:-1]))
    return starts, places[starts]


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of each value; one to one."""
    x = (x ^ (x >> _HALF)) * _MIX
    x = (x ^ (x >> _HALF)) * _MIX
    return x ^ (x >> _HALF)


def runs(word_hashes: np.ndarray, size: int, seed: int = 0) -> np.ndarray:
    """A hash for each run of ``size`` consecutive words; none if there are fewer words."""
    n = len(word_hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, seed, np.uint64)
    for i in range(size):
        out = out * _STEP + word_hashes[i:n + i]
    return mixed(out)
