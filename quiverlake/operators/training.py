"""What is learnt from data: calibration quantiles and coarse cells."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..errors import IndexError_, NumericError
from ..functions.codec import P_HIGH, P_LOW, Calibration, IndexSpec
from ..functions.random import Stream
from .encode import matrix, with_fields

CALIBRATION_FROM = 1000  # a smaller first batch isn't calibrated
PER_LIST = 64  # training rows to a cell
MOST_CELLS = 1 << 22
#: Fixed value: keeps the k-means stream apart from the rotation's.
CELL_STREAM = 0x49564631


def rotated(vectors: DataFrame, spec: IndexSpec, column: str = "vector", inverse: bool = False, unit: bool = True) -> DataFrame:
    """vectors with a column ``rotated`` of doubles: the rotation, or its inverse, of the (unit) vectors."""
    keep = [c for c in vectors.columns if c != column]
    schema = with_fields(vectors, keep, "rotated array<double>")
    wanted = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = matrix(b.column(len(keep)), spec.dim)
            x = x / np.sqrt((x**2).sum(1))[:, None] if unit else x
            y = spec.rotation.invert(x) if inverse else spec.rotation.apply(x)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1, dtype=np.int32) * spec.dim), pa.array(y.ravel()))
            yield pa.RecordBatch.from_arrays([*(b.column(i).cast(wanted[i].type) for i in range(len(keep))), lists.cast(wanted[len(keep)].type)], schema=wanted)

    return vectors.select(*keep, F.col(column).cast("array<double>").alias(column)).mapInArrow(run, schema)


def calibration_quantiles(vectors: DataFrame, spec: IndexSpec, column: str = "vector") -> DataFrame:
    """(coord, low, high): order statistics at floor(p (m - 1)) of each rotated coordinate, exactly.

    Values are counted per coordinate before the shuffle's sort; the order statistics come from running
    counts within a coordinate's buckets of values, so no task sorts a whole coordinate of a large batch.
    """
    values = rotated(vectors.select(column), spec, column).select(F.posexplode("rotated").alias("coord", "x"))
    values = values.select("coord", F.col("x").cast("float").alias("x"))
    m = vectors.count()
    lows, highs = math.floor(P_LOW * (m - 1)), math.floor(P_HIGH * (m - 1))
    # Buckets of equal width over [-1, 1]; their counts (dim x 4096 rows) tell which hold the two ranks.
    placed = values.withColumn("bucket", F.least(F.lit(4095), F.floor((F.col("x") + 1) * 2048)).cast("int"))
    counts = placed.groupBy("coord", "bucket").agg(F.count(F.lit(1)).alias("n"))
    running = counts.withColumn("upto", F.sum("n").over(Window.partitionBy("coord").orderBy("bucket"))).withColumn("before", F.col("upto") - F.col("n"))
    holds = running.where(((F.col("before") <= lows) & (F.col("upto") > lows)) | ((F.col("before") <= highs) & (F.col("upto") > highs)))
    few = placed.join(F.broadcast(holds.select("coord", "bucket", "before")), ["coord", "bucket"])  # at most 2 dim rows
    ranked = few.withColumn("rank", F.col("before") + F.row_number().over(Window.partitionBy("coord", "bucket").orderBy("x")) - 1)
    return ranked.groupBy("coord").agg(F.max(F.when(F.col("rank") == lows, F.col("x"))).alias("low"), F.max(F.when(F.col("rank") == highs, F.col("x"))).alias("high"))


def fit_calibration(vectors: DataFrame, spec: IndexSpec, column: str = "vector") -> Calibration:
    rows = sorted(calibration_quantiles(vectors, spec, column).collect())  # dim rows
    if len(rows) != spec.dim:
        raise NumericError("INVALID_LENGTH", "there is nothing to fit a calibration on")
    return Calibration.from_quantiles(np.array([r.low for r in rows], np.float64), np.array([r.high for r in rows], np.float64))


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.sqrt((x**2).sum(-1, keepdims=True))
    return np.divide(x, n, out=x.copy(), where=n > 0)


def _far(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of rows to one point or each to its own."""
    return ((x - c) ** 2).sum(-1)


def seed_centroids(x: np.ndarray, k: int, draw: Stream) -> np.ndarray:
    """k-means++: each next centre by squared distance to the nearest so far; uniform where all are zero."""
    chosen = [draw.below(len(x))]
    near = _far(x, x[chosen[0]])
    while len(chosen) < k:
        mass = near.cumsum()
        pick = int(np.searchsorted(mass, draw.uniform() * mass[-1], "right")) if mass[-1] > 0 else draw.below(len(x))
        chosen.append(min(pick, len(x) - 1))
        near = np.minimum(near, _far(x, x[chosen[-1]]))
    return x[chosen].copy()


def nearest_cell(x: np.ndarray, centroids: np.ndarray, spherical: bool) -> np.ndarray:
    """Largest product, or smallest squared distance; the first of equals."""
    s = x @ centroids.T
    return (s if spherical else 2 * s - (centroids**2).sum(1)).argmax(1)


def kmeans(x: np.ndarray, k: int, draw: Stream, spherical: bool, iterations: int = 25) -> tuple[np.ndarray, np.ndarray]:
    """Centroids and the cell of each row. An empty cell takes the row farthest from its own cell's centre."""
    if x.ndim != 2 or not len(x) or not x.shape[1]:
        raise NumericError("INVALID_LENGTH", "k-means needs rows")
    if not isinstance(k, int) or not 2 <= k <= len(x):
        raise NumericError("INVALID_K", f"k must be from 2 to {len(x)}, got {k}")
    centres = seed_centroids(x, k, draw)
    centres = _unit(centres) if spherical else centres
    cell = np.full(len(x), -1)
    for _ in range(iterations):
        now = nearest_cell(x, centres, spherical)
        moved, cell = int((now != cell).sum()), now
        size = np.bincount(cell, minlength=k)
        sums = np.stack([np.bincount(cell, x[:, j], k) for j in range(x.shape[1])], 1)
        means = sums / np.maximum(size, 1)[:, None]
        centres = np.where(size[:, None] > 0, _unit(means) if spherical else means, centres)
        for empty in np.flatnonzero(size == 0):
            spare = np.where(size[cell] > 1, _far(x, centres[cell]), -1.0)
            row = int(spare.argmax())
            size[cell[row]] -= 1
            cell[row], size[empty] = empty, 1
            centres[empty] = _unit(x[row]) if spherical else x[row]
            moved += 1
        if not moved:
            break
    return centres.astype(np.float32).astype(np.float64), cell


def default_probes(cells: int) -> int:
    return max(1, math.ceil(cells / 8))


def check_cells(cells: int, probes: int | None = None) -> None:
    if not isinstance(cells, int) or not 2 <= cells <= MOST_CELLS:
        raise IndexError_("INVALID_NLIST", f"the number of cells must be from 2 to {MOST_CELLS}, got {cells}")
    check_probes(cells, probes)


def check_probes(cells: int, probes: int | None) -> None:
    if probes is not None and (not isinstance(probes, int) or isinstance(probes, bool) or not 1 <= probes <= cells):
        raise IndexError_("INVALID_NPROBE", f"the number of probes must be from 1 to {cells}, got {probes}")


def train_cells(vectors: DataFrame, spec: IndexSpec, cells: int, order: Column | str = "slot", column: str = "vector") -> np.ndarray:
    """Centroids from a bounded sample (PER_LIST rows a cell), deterministic for a seed and an order of rows.

    The sample is the rows first by a hash of their order key and the seed, so no draw depends on how many
    rows there are or where they lie.
    """
    check_cells(cells)
    key = F.col(order) if isinstance(order, str) else order
    taken = vectors.orderBy(F.xxhash64(key, F.lit(spec.seed)), key).limit(PER_LIST * cells).select(F.col(column).cast("array<double>")).collect()
    x = np.array([r[0] for r in taken], np.float64).reshape(len(taken), -1)
    spherical = spec.metric != "euclidean"
    x = x[(x != 0).any(1)] if len(x) else x
    return kmeans(_unit(x) if spherical else x, cells, Stream(spec.seed ^ CELL_STREAM), spherical)[0]


def assign(vectors: DataFrame, centroids: np.ndarray, spec: IndexSpec, column: str = "vector", to: str = "cell") -> DataFrame:
    """vectors with the cell of each; centroids are broadcast (their number is bounded, see ``check_cells``)."""
    shared = vectors.sparkSession.sparkContext.broadcast(centroids)
    schema = with_fields(vectors, vectors.columns, f"{to} int")
    wanted = to_arrow_schema(schema)
    at, spherical = vectors.columns.index(column), spec.metric != "euclidean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                own = nearest_cell(matrix(b.column(at), spec.dim), shared.value, spherical).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*(c.cast(f.type) for c, f in zip(b.columns, wanted, strict=False)), pa.array(own)], schema=wanted)

    return vectors.mapInArrow(run, schema)


def probe(queries: np.ndarray, centroids: np.ndarray, probes: int, spherical: bool) -> np.ndarray:
    """The cells to look into for each query, best first; ties to the smaller cell."""
    s = queries @ centroids.T
    keys = s if spherical else 2 * s - (centroids**2).sum(1)
    return np.argsort(-keys, axis=1, kind="stable")[:, :probes]
