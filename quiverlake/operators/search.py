"""Top-k search over codes, in batches of queries.

Queries of a block (at most ``BLOCK`` rows, a checked size) are broadcast; each partition of codes is
scanned once, scored by a matrix product and reduced to k rows a query before anything is shuffled. Blocks
beyond the first are further scans. Filters belong on the codes before the search, where Catalyst prunes
columns, partitions and row groups.

Order is total: rank key (double precision) descending, then id ascending; keys that aren't numbers are
left out. Scores are reported as 32-bit floats.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..errors import SearchError
from ..functions import codec
from ..functions.codec import METRICS, IndexSpec
from ..functions.columns import doubles, exact_metric
from ..functions.marginal import codebook
from .encode import code_matrix, with_fields

BLOCK = 4096  # queries that are broadcast at once
CHUNK = 1 << 22  # scores that a task holds at once
DIGITS = 12  # of a rank key: a matrix product's last bits depend on the batch, and ties must not


@dataclass(frozen=True)
class Queries:
    """A block of queries in the frame of the levels; the whole of what is broadcast."""

    ids: list
    framed: np.ndarray
    bias: np.ndarray
    norm: np.ndarray
    asked: dict[int, np.ndarray] | None = None  # the queries that look into a cell; None: all rows count for all


def check_k(k: int) -> None:
    if not isinstance(k, int) or isinstance(k, bool) or k <= 0:
        raise SearchError("INVALID_K", f"k must be a positive integer, got {k}")


def check_queries(q: np.ndarray, dim: int) -> None:
    if q.ndim != 2 or q.shape[1] != dim or not np.isfinite(q).all():
        raise SearchError("INVALID_LENGTH", f"queries must be {dim} finite coordinates")
    if not (q != 0).any(1).all():
        raise SearchError("ZERO_QUERY", "a zero query has no direction")


def blocks(queries: DataFrame, spec: IndexSpec, query_id: str = "qid", column: str = "vector", block: int = BLOCK, asked: Callable[[np.ndarray], dict] | None = None) -> Iterator[Queries]:
    """The queries in blocks of at most ``block`` rows, read one after the other. asked: the cells of a block's vectors."""
    held: list[tuple] = []

    def made() -> Queries:
        q = np.array([np.asarray(v, np.float64) for _, v in held]) if len({len(v) for _, v in held}) == 1 else np.empty((0, 0))
        check_queries(q, spec.dim)
        framed, bias = codec.query_frame(q, spec)
        return Queries([i for i, _ in held], framed, bias, np.sqrt((q**2).sum(1)), asked(q) if asked else None)

    for row in queries.select(query_id, doubles(F.col(column))).toLocalIterator():
        if row[1] is None:
            raise SearchError("INVALID_LENGTH", "a query is null")
        held.append((row[0], row[1]))
        if len(held) == block:
            yield made()
            held = []
    if held:
        yield made()


def top_rows(df: DataFrame, k: int, key: Column, *ties: str, by: str = "qid") -> DataFrame:
    """rank from 1 within ``by``, at most k; Spark keeps k rows a task before the shuffle."""
    order = Window.partitionBy(by).orderBy(key.desc(), *ties)
    return df.where(~F.isnan(key)).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _scan(codes: DataFrame, spec: IndexSpec, q: Queries, k: int, metric: str, id_col: str, keep: list[str], coarse: bool, query_type: str) -> DataFrame:
    """(qid, key, id, keep...): at most k rows a query and partition."""
    shared = codes.sparkSession.sparkContext.broadcast(q)
    names = [id_col, *keep]
    schema = with_fields(codes, names, f"qid {query_type}, key double")
    wanted = to_arrow_schema(schema)

    def scored(c: np.ndarray, scale: np.ndarray, norm: np.ndarray, of: np.ndarray | slice) -> np.ndarray:
        own, levels = shared.value, codebook(spec.dim, spec.bits).levels
        s = codec.coarse_projection(own.framed[of], c, levels) if coarse else levels[c] @ own.framed[of].T
        values = codec.value(metric, s - own.bias[of], scale[:, None], norm[:, None], own.norm[of])
        keys = codec.rank_key(metric, values)
        return np.round(np.where(np.isnan(keys), -np.inf, keys), DIGITS)

    def fit(keys: np.ndarray, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and queries of the keys that may be among the k best: ties are settled by id later."""
        if len(keys) > k and not np.isfinite(floor).all():
            floor = np.maximum(floor, np.partition(keys, len(keys) - k, axis=0)[len(keys) - k])
        return np.nonzero((keys >= floor) & (keys > -np.inf))

    def parts(b: pa.RecordBatch) -> Iterator[tuple[np.ndarray | None, np.ndarray | slice]]:
        """Rows and the queries that they count for: all, or cell by cell."""
        if shared.value.asked is None:
            yield None, slice(None)
            return
        cell = b.column("cell").to_numpy()
        order = np.argsort(cell, kind="stable")
        for rows in np.split(order, np.flatnonzero(np.diff(cell[order])) + 1):
            if rows.size and (of := shared.value.asked.get(int(cell[rows[0]]))) is not None:
                yield rows, of

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(shared.value.ids)
        best: pa.Table | None = None  # k rows a query at most
        floor = np.full(n, -np.inf)  # the k-th of them
        for whole in batches:
            step = max(1, CHUNK // max(n, spec.dim))
            for at in range(0, whole.num_rows, step):
                b = whole.slice(at, step)
                codes_, scale, norm = code_matrix(b.column("codes"), spec), *(b.column(x).to_numpy().astype(np.float64) for x in ("scale", "norm"))
                hits = []
                for rows, of in parts(b):
                    keys = scored(codes_, scale, norm, of) if rows is None else scored(codes_[rows], scale[rows], norm[rows], of)
                    row, query = fit(keys, floor[of])
                    hits.append((row if rows is None else rows[row], query if rows is None else of[query], keys[row, query]))
                if not sum(x[0].size for x in hits):
                    continue
                row, query, key = (np.concatenate(x) for x in zip(*hits, strict=True))
                found = pa.table([b.column(x).take(pa.array(row)) for x in names] + [pa.array(query), pa.array(key)], names=[*names, "q", "key"])
                found = found if best is None else pa.concat_tables([best, found])
                order = pyarrow.compute.sort_indices(found, [("q", "ascending"), ("key", "descending"), (id_col, "ascending")])
                found = found.take(order)
                q_of = found.column("q").to_numpy()
                place = np.arange(len(q_of)) - np.searchsorted(q_of, q_of)
                last = place == k - 1
                floor[q_of[last]] = found.column("key").to_numpy()[last]
                best = found.filter(pa.array(place < k)).combine_chunks()
        if best is not None and best.num_rows:
            ids = shared.value.ids
            columns = [best.column(x).combine_chunks().cast(wanted.field(x).type) for x in names]
            columns += [pa.array([ids[i] for i in best.column("q").to_pylist()], wanted.field("qid").type), best.column("key").combine_chunks()]
            yield from pa.Table.from_arrays(columns, schema=wanted).to_batches()

    read = list(dict.fromkeys([*names, "codes", "scale", "norm", *(["cell"] if q.asked is not None else [])]))
    return codes.select(*read).mapInArrow(run, schema)


def search(
    codes: DataFrame, queries: DataFrame, spec: IndexSpec, k: int, metric: str | None = None, where: Column | None = None, id_col: str = "id",
    query_id: str = "qid", column: str = "vector", keep: tuple[str, ...] = (), coarse: bool = False, block: int = BLOCK, asked: Callable[[np.ndarray], dict] | None = None,
) -> DataFrame:
    """(qid, rank, id, score, keep...): the k best of codes (id, codes, scale, norm) for each query, best first.

    where: rows to consider (a mask, an id predicate, a compiled filter). coarse: score by 8-bit tables.
    asked: the cells that queries look into; codes have a cell column then, and other cells aren't read.
    """
    metric = metric or spec.metric
    check_k(k)
    if metric not in METRICS:
        raise SearchError("INVALID_METRIC", f"metric must be one of {METRICS}, got {metric}")
    kept = codes if where is None else codes.where(where)
    query_type = queries.schema[query_id].dataType.simpleString()
    held = lambda q: kept if q.asked is None else kept.where(F.col("cell").isin([*q.asked]))
    parts = [_scan(held(q), spec, q, k, metric, id_col, list(keep), coarse, query_type) for q in blocks(queries, spec, query_id, column, block, asked)]
    if not parts:
        parts = [kept.select(id_col, *keep, F.lit(None).cast(query_type).alias("qid"), F.lit(0.0).alias("key")).where(F.lit(False))]
    top = top_rows(reduce(DataFrame.unionByName, parts), k, F.col("key"), id_col)
    score = (-F.col("key") if metric == "euclidean" else F.col("key")).cast("float")
    return top.select("qid", "rank", id_col, score.alias("score"), *keep)


def pool_size(k: int) -> int:
    return max(4 * k, k + 64)


def two_stage(codes: DataFrame, queries: DataFrame, spec: IndexSpec, k: int, metric: str | None = None, where: Column | None = None, id_col: str = "id", query_id: str = "qid", column: str = "vector") -> DataFrame:
    """A pool by 8-bit tables and integer sums, then exact scores of the pool only (its codes ride along)."""
    if spec.bits != 4:
        return search(codes, queries, spec, k, metric, where, id_col, query_id, column)
    metric = metric or spec.metric
    check_k(k)
    pool = search(codes, queries, spec, pool_size(k), metric, where, id_col, query_id, column, keep=("codes", "scale", "norm"), coarse=True)
    return rescore(pool, queries, spec, k, metric, id_col, query_id, column)


def rescore(pool: DataFrame, queries: DataFrame, spec: IndexSpec, k: int, metric: str, id_col: str = "id", query_id: str = "qid", column: str = "vector") -> DataFrame:
    """Exact top-k of (qid, id, codes, scale, norm): pairs meet their query by a join on qid."""
    pairs = pool.select("qid", id_col, "codes", "scale", "norm").join(queries.select(F.col(query_id).alias("qid"), doubles(F.col(column)).alias("vector")), "qid")
    schema = with_fields(pairs, ["qid", id_col], "key double")
    wanted = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = codebook(spec.dim, spec.bits).levels
        for b in batches:
            if not b.num_rows:
                continue
            q = b.column("vector").flatten().to_numpy().reshape(b.num_rows, -1)
            framed, bias = codec.query_frame(q, spec)
            s = (levels[code_matrix(b.column("codes"), spec)] * framed).sum(1) - bias
            values = codec.value(metric, s, b.column("scale").to_numpy().astype(np.float64), b.column("norm").to_numpy().astype(np.float64), np.sqrt((q**2).sum(1)))
            yield pa.RecordBatch.from_arrays([b.column("qid").cast(wanted[0].type), b.column(id_col).cast(wanted[1].type), pa.array(np.round(codec.rank_key(metric, values), DIGITS))], schema=wanted)

    top = top_rows(pairs.mapInArrow(run, schema), k, F.col("key"), id_col)
    return top.select("qid", "rank", id_col, (-F.col("key") if metric == "euclidean" else F.col("key")).cast("float").alias("score"))


def exact(vectors: DataFrame, queries: DataFrame, k: int, metric: str = "cosine", id_col: str = "id", query_id: str = "qid", column: str = "vector", block: int = BLOCK) -> DataFrame:
    """(qid, rank, id, score double) on the vectors themselves, queries broadcast in blocks; ground truth for recall."""
    check_k(k)
    if metric not in METRICS:
        raise SearchError("INVALID_METRIC", f"metric must be one of {METRICS}, got {metric}")
    query_type = queries.schema[query_id].dataType.simpleString()
    schema = with_fields(vectors, [id_col], f"qid {query_type}, key double")
    wanted = to_arrow_schema(schema)
    parts = []
    for q in _plain_blocks(queries, query_id, column, block):
        shared = vectors.sparkSession.sparkContext.broadcast(q)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, x = shared.value
            least = np.full(len(ids), -np.inf)  # the k-th best key of each query so far, or a bound below it
            for whole in batches:
                step = max(1, CHUNK // max(1, len(ids)))
                for at in range(0, whole.num_rows, step):
                    b = whole.slice(at, step)
                    v = b.column(1).flatten().to_numpy().reshape(b.num_rows, -1)
                    keys = v @ x.T
                    if metric == "cosine":
                        with np.errstate(divide="ignore", invalid="ignore"):
                            keys /= np.sqrt((v**2).sum(1))[:, None] * np.sqrt((x**2).sum(1))
                    elif metric == "euclidean":
                        keys = 2 * keys - (v**2).sum(1)[:, None] - (x**2).sum(1)
                    keys = np.where(np.isnan(keys), -np.inf, np.round(keys, DIGITS))  # a zero vector has no angle
                    if len(keys) >= k:
                        least = np.maximum(least, np.partition(keys, len(keys) - k, axis=0)[len(keys) - k])
                    row, query = np.nonzero((keys >= least) & (keys > -np.inf))
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)).cast(wanted[0].type), pa.array([ids[i] for i in query], wanted[1].type), pa.array(keys[row, query])], schema=wanted)

        parts.append(vectors.select(id_col, doubles(F.col(column))).mapInArrow(run, schema))
    if not parts:
        parts = [vectors.select(id_col, F.lit(None).cast(query_type).alias("qid"), F.lit(0.0).alias("key")).where(F.lit(False))]
    top = top_rows(reduce(DataFrame.unionByName, parts), k, F.col("key"), id_col)
    return top.select("qid", "rank", id_col, (-F.col("key") if metric == "euclidean" else F.col("key")).alias("score"))


def _plain_blocks(queries: DataFrame, query_id: str, column: str, block: int) -> Iterator[tuple[list, np.ndarray]]:
    held: list = []
    for row in queries.select(query_id, doubles(F.col(column))).toLocalIterator():
        held.append(row)
        if len(held) == block:
            yield [r[0] for r in held], np.array([r[1] for r in held])
            held = []
    if held:
        yield [r[0] for r in held], np.array([r[1] for r in held])


def exact_pairs(pairs: DataFrame, metric: str, a: str = "a", b: str = "b") -> Column:
    """The metric of two vector columns of the same row, as a Catalyst expression."""
    return exact_metric(metric, doubles(F.col(a)), doubles(F.col(b)))


def recall_at_k(found: DataFrame, truth: DataFrame, k: int, id_col: str = "id") -> DataFrame:
    """(recall): mean share of each query's true k best that were found."""
    true = truth.where(F.col("rank") <= k).select("qid", id_col)
    hits = true.join(found.where(F.col("rank") <= k).select("qid", id_col, F.lit(1).alias("hit")), ["qid", id_col], "left")
    return hits.groupBy("qid").agg((F.count("hit") / F.count(F.lit(1))).alias("r")).agg(F.avg("r").alias("recall"))


def compression(spec: IndexSpec) -> dict[str, float]:
    """Bytes of a stored row (codes, scale, norm) against 32-bit floats."""
    row = spec.code_bytes + 8
    return {"bytes_per_vector": row, "float_bytes": 4 * spec.dim, "ratio": 4 * spec.dim / row}
