"""Hashes of all parts of a byte or code point sequence at once, in numpy's 64-bit arithmetic."""

from __future__ import annotations

import numpy as np

_ODD = 0x9E3779B97F4A7C15
BASE = 0xD6E8FEB86659FD93


def mixed(x: np.ndarray) -> np.ndarray:
    """The finishing steps of SplitMix64."""
    x = x + np.uint64(_ODD)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    """base ** i and base ** -i modulo 2 ** 64, grown as needed."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> None:
        if n >= len(self.up):
            size = max(n + 1, 2 * len(self.up), 1 << 20)
            steps = np.full(size, BASE, np.uint64)
            steps[0] = 1
            self.up = np.cumprod(steps)
            steps[1:] = pow(BASE, -1, 1 << 64)
            self.down = np.cumprod(steps)


POWERS = _Powers()
_BYTES = mixed(np.arange(256, dtype=np.uint64))


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """S, one longer than values: the hash of values[a:b] is (S[b] - S[a]) * base ** -a, mixed."""
    POWERS.to(len(values))
    sums = np.zeros(len(values) + 1, np.uint64)
    each = _BYTES[values] if values.dtype == np.uint8 else mixed(values.astype(np.uint64))
    np.cumsum(each * POWERS.up[: len(values)], out=sums[1:])
    return sums


def part_hashes(sums: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mixed((sums[b] - sums[a]) * POWERS.down[a] + (b - a).astype(np.uint64) * np.uint64(_ODD))
