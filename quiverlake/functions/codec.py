"""Vectors to codes and back, on NumPy blocks: what the Arrow operators run on each batch."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from ..errors import EncodeError, IndexError_, NumericError, SearchError
from .marginal import BITS, codebook, coord_quantile
from .rotation import Rotation

METRICS = ("dot", "cosine", "euclidean")
P_LOW, P_HIGH, FLAT = 0.05, 0.95, 1e-6  # calibration: quantiles that are matched, and the range of a flat coordinate


@dataclass(frozen=True)
class Calibration:
    """Coordinates are coded as (x + shift) * scale."""

    shift: tuple[float, ...]
    scale: tuple[float, ...]

    @staticmethod
    def identity(dim: int) -> Calibration:
        return Calibration((0.0,) * dim, (1.0,) * dim)

    @staticmethod
    def from_quantiles(low: np.ndarray, high: np.ndarray) -> Calibration:
        """Maps the quantiles of each coordinate onto those that a random rotation would give."""
        dim = len(low)
        target = coord_quantile(P_LOW, dim), coord_quantile(P_HIGH, dim)
        span = np.asarray(high, np.float64) - low
        flat = span < FLAT
        scale = np.where(flat, 1.0, (target[1] - target[0]) / np.where(flat, 1.0, span))
        shift = np.where(flat, 0.0, target[0] / scale - low)
        narrow = lambda x: tuple(x.astype(np.float32).astype(np.float64).tolist())
        return Calibration(narrow(shift), narrow(scale))


@dataclass(frozen=True)
class IndexSpec:
    """What codes depend on; rotation and codebook are functions of it and never stored."""

    dim: int
    bits: int = 4
    metric: str = "cosine"
    seed: int = 0
    calibration: Calibration | None = None

    def __post_init__(self) -> None:
        if not isinstance(self.dim, int) or self.dim <= 0 or self.dim % 8:
            raise IndexError_("INVALID_DIM", f"dim must be a positive multiple of 8, got {self.dim}")
        if self.bits not in BITS:
            raise IndexError_("INVALID_BITS", f"bits must be one of {BITS}, got {self.bits}")
        if self.metric not in METRICS:
            raise SearchError("INVALID_METRIC", f"metric must be one of {METRICS}, got {self.metric}")
        if not np.isfinite(self.seed):
            raise IndexError_("INVALID_SEED", f"seed must be finite, got {self.seed}")
        object.__setattr__(self, "seed", int(self.seed))

    @property
    def rotation(self) -> Rotation:
        return Rotation(self.dim, self.seed)

    @property
    def code_bytes(self) -> int:
        return self.dim * self.bits // 8


def quantize(x: np.ndarray, dim: int, bits: int) -> np.ndarray:
    """Cell of each coordinate; what lies outside goes to the end cells."""
    return np.searchsorted(codebook(dim, bits).inner, x, side="right").astype(np.uint8)


def pack(codes: np.ndarray, bits: int) -> np.ndarray:
    """Rows of codes to bytes, least significant bit first, codes running on across bytes."""
    if bits not in BITS:
        raise NumericError("INVALID_ARGUMENT", f"bits must be one of {BITS}, got {bits}")
    if codes.size and codes.max() >> bits:
        raise NumericError("INVALID_CODE", f"codes must be below {1 << bits}")
    planes = codes[..., None] >> np.arange(bits, dtype=np.uint8) & 1
    return np.packbits(planes.reshape(*codes.shape[:-1], -1).astype(np.uint8), axis=-1, bitorder="little")


def unpack(packed: np.ndarray, bits: int, n: int) -> np.ndarray:
    if packed.shape[-1] != -(-n * bits // 8):
        raise NumericError("INVALID_LENGTH", f"{-(-n * bits // 8)} bytes hold {n} codes, got {packed.shape[-1]}")
    planes = np.unpackbits(packed, axis=-1, count=n * bits, bitorder="little").reshape(*packed.shape[:-1], n, bits)
    return (planes << np.arange(bits, dtype=np.uint8)).sum(-1, dtype=np.uint8)


@dataclass(frozen=True)
class Encoded:
    codes: np.ndarray
    scale: np.ndarray
    norm: np.ndarray
    #: Rows that have no code: the projection on their own levels isn't positive.
    degenerate: np.ndarray


def check(x: np.ndarray, dim: int) -> None:
    if x.ndim != 2 or x.shape[1] != dim:
        raise EncodeError("INVALID_LENGTH", f"vectors of {dim} coordinates are needed")
    if not np.isfinite(x).all():
        raise EncodeError("INVALID_LENGTH", "vectors must be finite")
    if not (x != 0).any(1).all():
        raise EncodeError("ZERO_VECTOR", "a zero vector has no direction")


def encode(x: np.ndarray, spec: IndexSpec) -> Encoded:
    check(x, spec.dim)
    norm = np.sqrt((x**2).sum(1))
    turned = spec.rotation.apply(x / norm[:, None])
    levels = codebook(spec.dim, spec.bits).levels
    if spec.calibration is None:
        codes = quantize(turned, spec.dim, spec.bits)
        inner = (turned * levels[codes]).sum(1)
    else:
        shift, scale = np.array(spec.calibration.shift), np.array(spec.calibration.scale)
        codes = quantize((turned + shift) * scale, spec.dim, spec.bits)
        inner = (turned * (levels[codes] / scale - shift)).sum(1)
    bad = ~(inner > 0)
    return Encoded(codes, (norm / np.where(bad, 1.0, inner)).astype(np.float32), norm.astype(np.float32), bad)


def query_frame(q: np.ndarray, spec: IndexSpec) -> tuple[np.ndarray, np.ndarray]:
    """Queries in the frame of the levels, and what calibration takes off each projection."""
    turned = spec.rotation.apply(q)
    if spec.calibration is None:
        return turned, np.zeros(len(q))
    return turned / np.array(spec.calibration.scale), turned @ np.array(spec.calibration.shift)


def value(metric: str, projection: np.ndarray, scale: np.ndarray, norm: np.ndarray, q_norm: np.ndarray) -> np.ndarray:
    """Metric from projections: similarities, or squared distances."""
    if metric == "dot":
        return scale * projection
    if metric == "cosine":
        return scale * projection / (q_norm * norm)
    return q_norm**2 + norm**2 - 2 * scale * projection


def rank_key(metric: str, values: np.ndarray) -> np.ndarray:
    return -values if metric == "euclidean" else values


def coarse_projection(q_framed: np.ndarray, codes: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """Projections of rows from 8-bit tables with one affine map a query and 16-bit sums: the fast first look."""
    dim = codes.shape[1]
    out = np.empty((len(codes), len(q_framed)))
    top = min(255, 65535 // dim)
    for k, q in enumerate(q_framed):
        table = (q[:, None] * levels).astype(np.float32).astype(np.float64)
        low, span = table.min(), np.ptp(table)
        small = np.clip(np.floor((table - low) * (top / span if span > 0 else 0) + 0.5), 0, top).astype(np.uint16)
        sums = small[np.arange(dim), codes].sum(1, dtype=np.uint32)
        out[:, k] = sums * (span / top if span > 0 else 0) + dim * low
    return out
