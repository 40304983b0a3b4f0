"""Vector files and synthetic vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql import types as T


def read_vecs(spark: SparkSession, path: str, integers: bool = False) -> DataFrame:
    """(file, at, vector) from .fvecs or .ivecs files: records of a 32-bit count and as many 32-bit numbers.

    ``at`` is the record's place in its file. A file is read by one task, as its format can't be cut.
    """
    schema = T._parse_datatype_string(f"file string, at long, vector array<{'int' if integers else 'float'}>")
    wanted = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, raw in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                words = np.frombuffer(raw.as_buffer(), "<i4")
                if not words.size:
                    continue
                dim = int(words[0])
                if dim <= 0 or words.size % (dim + 1) or (words[:: dim + 1] != dim).any():
                    raise ValueError(f"{name}: records must all have the same number of coordinates")
                body = words.reshape(-1, dim + 1)[:, 1:]
                body = body if integers else np.ascontiguousarray(body).view("<f4")
                for s in range(0, len(body), 8192):
                    part = body[s : s + 8192]
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32) * dim), pa.array(np.ascontiguousarray(part).ravel()))
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(part), wanted[0].type), pa.array(np.arange(s, s + len(part))), lists.cast(wanted[2].type)], schema=wanted)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, schema)


def _rows(spark: SparkSession, n: int, dim: int, seed: int, made) -> DataFrame:
    schema = T._parse_datatype_string("id long, vector array<float>")
    wanted = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_numpy()
            # A generator a row: a row is the same whatever the partitioning.
            x = np.array([made(np.random.default_rng([seed, int(i)]), int(i)) for i in ids], np.float32).reshape(len(ids), dim)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1, dtype=np.int32) * dim), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), lists.cast(wanted[1].type)], schema=wanted)

    return spark.range(n).mapInArrow(run, schema)


def anisotropic(spark: SparkSession, n: int, dim: int, decay: float = 0.3, seed: int = 1) -> DataFrame:
    """(id, vector): independent normal coordinates, the i-th of deviation decay ** (i / dim)."""
    sigma = decay ** (np.arange(dim) / dim)
    return _rows(spark, n, dim, seed, lambda draw, _: draw.normal(size=dim) * sigma)


def mixture(spark: SparkSession, clusters: int, per: int, dim: int, spread: float = 10.0, seed: int = 1) -> DataFrame:
    """(id, vector): ``per`` unit-normal points about each of ``clusters`` centres of deviation ``spread``."""
    centres = np.random.default_rng(seed).normal(size=(clusters, dim)) * spread
    return _rows(spark, clusters * per, dim, seed + 1, lambda draw, i: centres[i // per] + draw.normal(size=dim))


def read_embeddings(spark: SparkSession, path: str, id_col: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(id, vector) of a Parquet table."""
    return spark.read.parquet(path).select(F.col(id_col).alias("id"), F.col(column).alias("vector"))
