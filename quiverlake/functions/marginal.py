"""The distribution of one coordinate of a random unit vector, and its optimal scalar quantizers.

A coordinate X of a uniform unit vector in d dimensions is 2 T - 1 with T ~ Beta((d-1)/2, (d-1)/2). All
integrals are Gauss-Legendre sums over panels, which these smooth densities need few of.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

from ..errors import NumericError

BITS = (2, 3, 4)
_NODES, _WEIGHTS = np.polynomial.legendre.leggauss(40)


def log_gamma(x: float) -> float:
    return math.lgamma(x)


def integrate(f: Callable[[np.ndarray], np.ndarray], lo: float, hi: float, tol: float = 1e-12) -> float:
    """Panels are doubled until two sums agree."""
    before = math.nan
    for panels in (1 << n for n in range(12)):
        edges = np.linspace(lo, hi, panels + 1)
        half = np.diff(edges)[:, None] / 2
        now = float((f((edges[:-1, None] + half) + half * _NODES) * _WEIGHTS * half).sum())
        if not math.isfinite(now):
            break
        if abs(now - before) <= tol * max(1.0, abs(now)):
            return now
        before = now
    raise NumericError("NO_CONVERGENCE", f"the integral from {lo} to {hi} does not settle")


def beta_pdf(x: float, a: float, b: float) -> float:
    if not (a > 0 and b > 0):
        raise NumericError("INVALID_ARGUMENT", "a and b must be positive")
    if x < 0 or x > 1:
        return 0.0
    if x in (0.0, 1.0):
        p = a if x == 0 else b
        return math.inf if p < 1 else (b if x == 0 else a) if p == 1 else 0.0
    return math.exp((a - 1) * math.log(x) + (b - 1) * math.log1p(-x) - log_gamma(a) - log_gamma(b) + log_gamma(a + b))


def beta_cdf(x: float, a: float, b: float) -> float:
    """Regularized incomplete beta, over the angle with x = sin^2."""
    if not (a > 0 and b > 0):
        raise NumericError("INVALID_ARGUMENT", "a and b must be positive")
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    if x > a / (a + b):  # the smaller tail is the exact one
        return 1 - beta_cdf(1 - x, b, a)
    c = log_gamma(a + b) - log_gamma(a) - log_gamma(b) + math.log(2)
    # sin^(2a-1) cos^(2b-1) over theta = top v^6, which smooths any root at zero.
    top = math.asin(math.sqrt(x))

    def f(v: np.ndarray) -> np.ndarray:
        t = top * v**6
        with np.errstate(divide="ignore"):
            return np.exp(c + (2 * a - 1) * np.log(np.sin(t)) + (2 * b - 1) * np.log(np.cos(t))) * 6 * top * v**5

    return integrate(f, 0.0, 1.0)


def beta_quantile(q: float, a: float, b: float) -> float:
    if not 0 <= q <= 1:
        raise NumericError("INVALID_ARGUMENT", f"a probability is needed, got {q}")
    if q in (0, 1):
        return float(q)
    lo, hi = 0.0, 1.0
    while hi - lo > 1e-13:
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if beta_cdf(mid, a, b) < q else (lo, mid)
    return (lo + hi) / 2


def _shape(dim: int) -> float:
    if not isinstance(dim, int) or dim < 2:
        raise NumericError("INVALID_DIM", f"dim must be an integer from 2 on, got {dim}")
    return (dim - 1) / 2


def coord_pdf(x: float, dim: int) -> float:
    return beta_pdf((x + 1) / 2, _shape(dim), _shape(dim)) / 2


def coord_cdf(x: float, dim: int) -> float:
    return beta_cdf((x + 1) / 2, _shape(dim), _shape(dim))


@lru_cache(4096)
def coord_quantile(q: float, dim: int) -> float:
    return 2 * beta_quantile(q, _shape(dim), _shape(dim)) - 1


@dataclass(frozen=True)
class Codebook:
    """boundaries t_0 = -1 < ... < t_n = 1 and levels, both rounded to 32-bit floats; cell i is [t_i, t_{i+1})."""

    boundaries: np.ndarray
    levels: np.ndarray

    @property
    def inner(self) -> np.ndarray:
        return self.boundaries[1:-1]


def _moments(edges: np.ndarray, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mass, first and second moment of each cell. The density is smooth but narrow: 64 panels a cell, within 12 sigma."""
    reach = min(1.0, 12 / math.sqrt(dim))
    edges = np.clip(edges, -reach, reach)
    cuts = np.linspace(edges[:-1], edges[1:], 65, axis=1)
    half = np.diff(cuts, axis=1)[..., None] / 2
    x = cuts[:, :-1, None] + half + half * _NODES
    log_c = log_gamma(dim / 2) - log_gamma((dim - 1) / 2) - 0.5 * math.log(math.pi)
    with np.errstate(divide="ignore"):
        f = np.exp(log_c + (dim - 3) / 2 * np.log1p(-(x**2))) * _WEIGHTS * half
    return f.sum((1, 2)), (f * x).sum((1, 2)), (f * x * x).sum((1, 2))


@lru_cache(256)
def codebook(dim: int, bits: int) -> Codebook:
    """Lloyd-Max: boundaries are midpoints of levels, levels are means of cells, until nothing moves."""
    if not isinstance(dim, int) or dim <= 0 or dim % 8:
        raise NumericError("INVALID_DIM", f"dim must be a positive multiple of 8, got {dim}")
    if bits not in BITS:
        raise NumericError("INVALID_ARGUMENT", f"bits must be one of {BITS}, got {bits}")
    n = 1 << bits
    levels = np.array([coord_quantile((i + 0.5) / n, dim) for i in range(n)])
    for _ in range(1000):
        edges = np.concatenate([[-1], (levels[1:] + levels[:-1]) / 2, [1]])
        mass, first, _ = _moments(edges, dim)
        moved = np.where(mass > 0, first / np.where(mass > 0, mass, 1), levels)
        moved = (moved - moved[::-1]) / 2  # the density is even
        done, levels = np.abs(moved - levels).max() < 1e-12, moved
        if done:
            break
    edges = np.concatenate([[-1], (levels[1:] + levels[:-1]) / 2, [1]])
    return Codebook(edges.astype(np.float32).astype(np.float64), levels.astype(np.float32).astype(np.float64))


def distortion(dim: int, bits: int) -> float:
    """Mean squared error of one coordinate."""
    book = codebook(dim, bits)
    mass, first, second = _moments(book.boundaries, dim)
    return float((second - 2 * book.levels * first + book.levels**2 * mass).sum())
