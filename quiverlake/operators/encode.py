"""Encoding vector columns to packed codes: a stateless map over Arrow batches, batch or streaming."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..errors import EncodeError
from ..functions import codec
from ..functions.codec import IndexSpec

CODES = "codes binary, scale float, norm float"


def with_fields(df: DataFrame, keep: list[str], more: str) -> T.StructType:
    return T.StructType([df.schema[c] for c in keep] + T._parse_datatype_string(more).fields)


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """An array column as rows of doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(flat) != len(column) * dim:
        raise EncodeError("INVALID_LENGTH", f"vectors of {dim} coordinates are needed")
    return flat.reshape(len(column), dim)


def binaries(rows: np.ndarray) -> pa.Array:
    """Rows of bytes as a binary column, without a Python object a row."""
    n, width = rows.shape
    offsets = pa.array(np.arange(n + 1, dtype=np.int32) * width).buffers()[1]
    return pa.Array.from_buffers(pa.binary(), n, [None, offsets, pa.py_buffer(np.ascontiguousarray(rows).tobytes())])


def code_matrix(column: pa.Array, spec: IndexSpec) -> np.ndarray:
    raw = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), spec.code_bytes)
    return codec.unpack(raw, spec.bits, spec.dim)


def problem(v: Column, dim: int) -> Column:
    """Why a vector can't be coded, null if it can: INVALID_LENGTH (also what isn't finite) or ZERO_VECTOR."""
    odd = v.isNull() | (F.size(v) != dim) | F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(odd, "INVALID_LENGTH").when(F.forall(v, lambda x: x == 0), "ZERO_VECTOR")


def validate(vectors: DataFrame, dim: int, column: str = "vector") -> None:
    """Raises for the first kind of bad vector there is; one aggregate over the batch."""
    bad = vectors.agg(F.min(problem(F.col(column), dim))).first()[0]
    if bad:
        raise EncodeError(bad, f"column {column} holds a vector that can't be coded")


def encode(vectors: DataFrame, spec: IndexSpec, column: str = "vector", strict: bool = True) -> DataFrame:
    """vectors with ``column`` replaced by codes, scale and norm.

    strict: a degenerate row (see ``codec.Encoded``) raises, else it is left out.
    """
    keep = [c for c in vectors.columns if c != column]
    schema = with_fields(vectors, keep, CODES)
    wanted = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            made = codec.encode(matrix(b.column(len(keep)), spec.dim), spec)
            if strict and made.degenerate.any():
                raise EncodeError("DEGENERATE", "a vector has no positive projection on its own levels")
            columns = [b.column(i).cast(wanted[i].type) for i in range(len(keep))]
            columns += [binaries(codec.pack(made.codes, spec.bits)), pa.array(made.scale), pa.array(made.norm)]
            yield pa.RecordBatch.from_arrays(columns, schema=wanted).filter(pa.array(~made.degenerate))

    return vectors.select(*keep, F.col(column).cast("array<double>").alias(column)).mapInArrow(run, schema)
