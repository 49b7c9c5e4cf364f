"""Words of texts as numpy arrays. A word is a run of bytes other than space and 0x09 to 0x0D."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import xxhash

#: bytes.split() without an argument cuts at exactly these bytes.
SPACES = b" \t\n\r\x0b\x0c"


class Numbering(defaultdict):
    """Numbers words in order of first sight; exact, so equal numbers mean equal words."""

    def __init__(self) -> None:
        super().__init__()
        self.default_factory = self.__len__

    def ids(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))

    def lengths(self) -> np.ndarray:
        """Code points of each word, by number."""
        return np.fromiter((len(w.decode("utf-8", "replace")) for w in self), np.int64, len(self))

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word, by number; the same in every task."""
        return np.fromiter(map(xxhash.xxh3_64_intdigest, self), np.uint64, len(self))


#: Odd factor of the rolling hash (a fixed value, the golden ratio in 64 bits).
FACTOR = np.uint64(0x9E3779B97F4A7C15)


def mixed(values: np.ndarray) -> np.ndarray:
    """Bits of a 64-bit hash spread, so that its order and its remainders are as good as random."""
    values = values ^ (values >> np.uint64(32))
    values = values * np.uint64(0xD6E8FEB86659FD93)
    return values ^ (values >> np.uint64(32))


def rolling(values: np.ndarray, n: int, factor: np.uint64 = FACTOR) -> np.ndarray:
    """Polynomial hash of each run of `n` values, modulo 2**64.

    The hash of a run of 2k is made of two hashes of k, so n runs cost about 2 log n passes.
    """
    if len(values) < n:
        return np.zeros(0, np.uint64)
    done, size = None, 0
    power, width, f = values.astype(np.uint64), 1, factor
    while True:
        if n & width:
            if done is None:
                done, size = power, width
            else:
                m = len(values) - size - width + 1
                done = power[:m] + f * done[width : width + m]
                size += width
        if size == n:
            return done
        m = len(power) - width
        power = power[:m] + f * power[width : width + m]
        f, width = f * f, width * 2
