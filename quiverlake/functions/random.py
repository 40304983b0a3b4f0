"""The seeded stream that rotations and k-means draw from: SplitMix64 into xoshiro256**."""

from __future__ import annotations

import math

import numpy as np

from ..errors import NumericError

_M = (1 << 64) - 1


class Stream:
    """Same seed, same numbers, on every machine."""

    def __init__(self, seed: float | int):
        if isinstance(seed, float) and not math.isfinite(seed):
            raise NumericError("INVALID_SEED", f"seed must be finite, got {seed}")
        z, state = math.trunc(seed) & _M, []
        for _ in range(4):
            # SplitMix64's increment and multipliers.
            z = (z + 0x9E3779B97F4A7C15) & _M
            x = ((z ^ z >> 30) * 0xBF58476D1CE4E5B9) & _M
            x = ((x ^ x >> 27) * 0x94D049BB133111EB) & _M
            state.append(x ^ x >> 31)
        self._state = state
        self._spare: float | None = None

    def word(self) -> int:
        a, b, c, d = self._state
        x = b * 5 & _M
        out = ((x << 7 | x >> 57) & _M) * 9 & _M
        c ^= a
        d ^= b
        self._state = [a ^ d, b ^ c, c ^ (b << 17 & _M), (d << 45 | d >> 19) & _M]
        return out

    def u32(self) -> int:
        return self.word() >> 32

    def uniform(self) -> float:
        """In [0, 1), of 53 bits."""
        return (self.word() >> 11) * 2.0**-53

    def below(self, n: int) -> int:
        return min(n - 1, int(self.uniform() * n))

    def normal(self) -> float:
        """Box-Muller; the cosine first, its sine next time."""
        if self._spare is not None:
            out, self._spare = self._spare, None
            return out
        r = math.sqrt(-2 * math.log(max(self.uniform(), 2.0**-52)))
        t = 2 * math.pi * self.uniform()
        self._spare = r * math.sin(t)
        return r * math.cos(t)

    def normals(self, *shape: int) -> np.ndarray:
        return np.array([self.normal() for _ in range(math.prod(shape))]).reshape(shape)
