"""Search that looks into the nearest cells only: codes meet the queries of their cell where they are read."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.codec import IndexSpec
from .encode import matrix, with_fields
from .search import CHUNK, check_k, search
from .training import check_probes, default_probes, probe


def probes_of(queries: DataFrame, centroids: np.ndarray, spec: IndexSpec, probes: int, query_id: str = "qid", column: str = "vector") -> DataFrame:
    """(qid, cell, place): by the index's own metric, whatever a query's is."""
    shared = queries.sparkSession.sparkContext.broadcast(centroids)
    schema = with_fields(queries, [query_id], "cells array<int>")
    wanted = to_arrow_schema(schema)
    spherical = spec.metric != "euclidean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                found = probe(matrix(b.column(1), spec.dim), shared.value, probes, spherical)
                yield pa.RecordBatch.from_arrays([b.column(0).cast(wanted[0].type), pa.array(found.astype(np.int32).tolist(), wanted[1].type)], schema=wanted)

    listed = queries.select(query_id, F.col(column).cast("array<double>")).mapInArrow(run, schema)
    return listed.select(F.col(query_id).alias("qid"), F.posexplode("cells").alias("place", "cell"))


def search_cells(
    codes: DataFrame, queries: DataFrame, centroids: np.ndarray, spec: IndexSpec, k: int, probes: int | None = None, metric: str | None = None,
    where: Column | None = None, id_col: str = "id", query_id: str = "qid", column: str = "vector",
) -> DataFrame:
    """(qid, rank, id, score) from codes with a cell column. All cells probed is a flat search, ties and all.

    Queries go out in blocks, each with the list of queries by cell; a task scores the rows of a cell against
    that cell's queries only. No code is shuffled, and cells that no query of a block looks into aren't read.
    """
    check_k(k)
    cells = len(centroids)
    check_probes(cells, probes)
    probes = probes or default_probes(cells)
    if probes == cells:
        return search(codes, queries, spec, k, metric, where, id_col, query_id, column)
    step, spherical = max(1, CHUNK // cells), spec.metric != "euclidean"

    def asked(q: np.ndarray) -> dict[int, np.ndarray]:
        cell = np.concatenate([probe(q[i : i + step], centroids, probes, spherical) for i in range(0, len(q), step)])
        query = np.repeat(np.arange(len(q)), cell.shape[1])[order := np.argsort(cell.ravel(), kind="stable")]
        own, start = np.unique(cell.ravel()[order], return_index=True)
        return dict(zip(own.tolist(), np.split(query, start[1:]), strict=True))

    return search(codes, queries, spec, k, metric, where, id_col, query_id, column, asked=asked)
