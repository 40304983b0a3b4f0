"""Fixed random rotations: signed Hadamard rounds where the dimension is a power of two, else a Haar matrix."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from ..errors import NumericError
from .random import Stream

ROUNDS = 3


def is_power_of_two(n: int) -> bool:
    return n > 0 and not n & (n - 1)


def next_power_of_two(n: int) -> int:
    return 1 << max(0, n - 1).bit_length()


def walsh_hadamard(x: np.ndarray) -> np.ndarray:
    """Unnormalised transform over the last axis: applied twice it multiplies by the length."""
    n = x.shape[-1]
    if not is_power_of_two(n):
        raise NumericError("INVALID_LENGTH", f"a power of two is needed, got {n}")
    out = np.array(x, np.float64)
    for width in (1 << b for b in range(n.bit_length() - 1)):
        pairs = out.reshape(*x.shape[:-1], n // (2 * width), 2, width)
        out = np.stack([pairs[..., 0, :] + pairs[..., 1, :], pairs[..., 0, :] - pairs[..., 1, :]], -2).reshape(x.shape)
    return out


@lru_cache(64)
def hadamard_signs(dim: int, seed: int) -> np.ndarray:
    draw = Stream(seed)
    return np.array([[-1.0 if draw.uniform() < 0.5 else 1.0 for _ in range(dim)] for _ in range(ROUNDS)])


@lru_cache(16)
def dense_matrix(dim: int, seed: int) -> np.ndarray:
    """Orthonormal factor of a Gaussian matrix whose triangular factor has no negative diagonal; 32-bit entries."""
    q, r = np.linalg.qr(Stream(seed).normals(dim, dim))
    return (q * np.where(np.diag(r) < 0, -1.0, 1.0)).astype(np.float32).astype(np.float64)


class Rotation:
    def __init__(self, dim: int, seed: int = 0):
        if dim < 1:
            raise NumericError("INVALID_DIM", f"dim must be positive, got {dim}")
        self.dim, self.seed, self.fast = dim, seed, is_power_of_two(dim)

    def apply(self, x: np.ndarray) -> np.ndarray:
        """Rotates the rows of x."""
        self._check(x)
        if not self.fast:
            return x @ dense_matrix(self.dim, self.seed).T
        for sign in hadamard_signs(self.dim, self.seed):
            x = walsh_hadamard(x * sign) / np.sqrt(self.dim)
        return x

    def invert(self, y: np.ndarray) -> np.ndarray:
        self._check(y)
        if not self.fast:
            return y @ dense_matrix(self.dim, self.seed)
        for sign in hadamard_signs(self.dim, self.seed)[::-1]:
            y = walsh_hadamard(y) / np.sqrt(self.dim) * sign
        return y

    def matrix(self) -> np.ndarray:
        """Q with y = Q x."""
        return self.apply(np.eye(self.dim)).T

    def _check(self, x: np.ndarray) -> None:
        if x.shape[-1] != self.dim:
            raise NumericError("INVALID_LENGTH", f"vectors of {self.dim} coordinates are needed, got {x.shape[-1]}")
