"""Indexes: positional, by id, and collections of points with payloads.

State is a DataFrame of codes in shared storage; every change writes a new table and never overwrites one
that is being read, so a failed change leaves the index as it was. The rotation and codebook follow from
the spec; calibration and cells are decided at the first non-empty batch and then stay.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import replace
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import EncodeError, IdMapError, IndexError_
from ..functions import codec
from ..functions.codec import IndexSpec
from ..sources import binary, tables
from .encode import code_matrix, encode, validate
from .filters import compile_filter
from .payloads import plain, united
from .ivf import search_cells
from .search import search, two_stage
from .training import CALIBRATION_FROM, assign, check_cells, default_probes, fit_calibration, train_cells

SLOT = "slot"


def dense_slots(df: DataFrame, order_by: Iterable[Column | str], first: int = 0) -> DataFrame:
    """df with a column slot: first, first + 1, ... in the order given, without one task seeing all rows."""
    ranged = tables.materialize(df.repartitionByRange(*order_by).withColumn("_part", F.spark_partition_id()), "ranged")
    sizes = {r._part: r.n for r in ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a partition
    offsets, at = {}, first
    for part in sorted(sizes):
        offsets[part], at = at, at + sizes[part]
    if not offsets:
        return ranged.drop("_part").withColumn(SLOT, F.lit(None).cast("long"))
    before = F.from_json(F.lit(str({str(k): v for k, v in offsets.items()}).replace("'", '"')), "map<string,long>")
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*order_by))
    return ranged.withColumn(SLOT, F.element_at(before, F.col("_part").cast("string")) + within - 1).drop("_part")


def queries_frame(spark: SparkSession, vectors: Iterable[Iterable[float]]) -> DataFrame:
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, "qid long, vector array<double>")


class VectorIndex:
    """What positional and id-keyed indexes share. ``key`` is the column that rows go by."""

    key = SLOT

    def __init__(self, spark: SparkSession, dim: int, bits: int = 4, metric: str = "cosine", seed: int = 0, calibrate: bool = False, cells: int | None = None, probes: int | None = None, two_stage: bool = False):
        self.spark, self.spec = spark, IndexSpec(dim, bits, metric, seed)
        if cells is not None:
            check_cells(cells, probes)
        self.calibrate, self.cells, self.probes, self.two_stage = calibrate, cells, probes, two_stage
        self.centroids: np.ndarray | None = None
        self.decided = False
        self.payloads: DataFrame | None = None
        self._set([])

    # ---- changes

    def _set(self, parts: list[tuple[DataFrame, int]]) -> None:
        """The index's tables with their rows, the largest first: one assignment switches to them."""
        self.parts = [p for p in parts if p[1]]
        self.size = sum(n for _, n in self.parts)
        self.codes: DataFrame | None = reduce(DataFrame.unionByName, (c for c, _ in self.parts)) if self.parts else None

    def _table(self, codes: DataFrame) -> tuple[DataFrame, int]:
        held = tables.materialize(codes, "codes", "cell" if "cell" in codes.columns else None)
        return held, held.count()

    def _prepare(self, batch: DataFrame, n: int, order: str) -> None:
        """Calibration and cells, decided once by the first non-empty batch of an index that has no rows."""
        if self.decided or self.size or not n:
            return
        spec = self.spec
        if self.calibrate and n >= CALIBRATION_FROM:
            spec = replace(spec, calibration=fit_calibration(batch, spec))
        centroids = train_cells(batch, spec, self.cells, order) if self.cells is not None and n >= self.cells else None
        self.spec, self.centroids, self.decided = spec, centroids, True

    def _encoded(self, batch: DataFrame) -> DataFrame:
        held = assign(batch, self.centroids, self.spec) if self.centroids is not None else batch
        return encode(held, self.spec)

    def _replace(self, codes: DataFrame | None) -> None:
        self._set([] if codes is None else [self._table(codes)])

    def _grown(self, parts: list[tuple[DataFrame, int]], batch: DataFrame, n: int) -> list[tuple[DataFrame, int]]:
        """parts and the n rows of batch. Tables less than twice as large as what comes after them are written again with it:
        there are at most log2(rows) tables, and a row is rewritten as often, however small the batches."""
        kept, new = list(parts), self._encoded(batch)
        while kept and kept[-1][1] < 2 * n:
            codes, rows = kept.pop()
            new, n = codes.unionByName(new), n + rows
        return [*kept, self._table(new)]

    def _append(self, batch: DataFrame, n: int) -> None:
        self._set(self._grown(self.parts, batch, n))

    def clear(self) -> None:
        """No rows; what was trained stays."""
        self._set([])
        self.payloads = None

    # ---- search

    def _found(self, codes: DataFrame | None, queries: DataFrame, k: int, metric: str | None, where: Column | None, probes: int | None, keep: str) -> DataFrame:
        if codes is None or not self.size:
            raise self._empty()
        if self.centroids is not None:
            own = probes if probes is not None else self.probes or default_probes(len(self.centroids))
            return search_cells(codes, queries, self.centroids, self.spec, k, own, metric, where, keep)
        if self.two_stage and self.spec.bits == 4:
            return two_stage(codes, queries, self.spec, k, metric, where, keep)
        return search(codes, queries, self.spec, k, metric, where, keep)

    def _empty(self) -> Exception:
        return IndexError_("EMPTY", "the index has no vectors")

    def search(self, queries: DataFrame, k: int, metric: str | None = None, where: Column | None = None, probes: int | None = None) -> DataFrame:
        """(qid, rank, key, score) for queries (qid, vector). where: rows to consider. probes: ignored without cells."""
        return self._found(self.codes, queries, k, metric, where, probes, self.key)

    # ---- storage

    def _payload(self) -> binary.Payload:
        """All rows on the driver, in slot order: the binary form is one file by definition."""
        rows = self.codes.orderBy(SLOT).toArrow() if self.codes is not None else None
        n, spec = (rows.num_rows, self.spec) if rows is not None else (0, self.spec)
        column = lambda c: rows.column(c).combine_chunks() if n else None
        codes = code_matrix(column("codes"), spec) if n else np.zeros((0, spec.dim), np.uint8)
        number = lambda c, kind: column(c).to_numpy() if n else np.zeros(0, kind)
        out = binary.Payload(spec, codes, number("scale", "f4"), number("norm", "f4"))
        if self.centroids is not None:
            out.centroids, out.cells = self.centroids, number("cell", "u4")
            out.probes = self.probes or default_probes(len(self.centroids))
        return out

    def to_bytes(self) -> bytes:
        return binary.dumps(self._payload())

    def _restore(self, p: binary.Payload, ids: list | None, id_type: str) -> None:
        packed = codec.pack(p.codes, p.spec.bits)
        rows = [
            (i, *((ids[i],) if ids is not None else ()), bytes(packed[i]), float(p.scales[i]), float(p.norms[i]), *((int(p.cells[i]),) if p.centroids is not None else ()))
            for i in range(len(packed))
        ]
        schema = f"{SLOT} long, " + (f"id {id_type}, " if ids is not None else "") + "codes binary, scale float, norm float" + (", cell int" if p.centroids is not None else "")
        self.spec, self.decided, self.two_stage = p.spec, True, False
        self.centroids, self.probes = (None if p.centroids is None else p.centroids.astype(np.float64)), p.probes
        self._replace(self.spark.createDataFrame(rows, schema) if rows else None)

    def save(self, path: str) -> None:
        """codes/, cells/ and meta/ as Parquet."""
        cells = None
        if self.centroids is not None:
            cells = self.spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(self.centroids)], "cell int, centroid array<double>")
        codes = self.codes if self.codes is not None else self.spark.createDataFrame([], self._schema())
        settings = {"id_kind": getattr(self, "id_kind", None), "calibrate": self.calibrate, "n_cells": self.cells, "two_stage": self.two_stage, "has_payloads": self.payloads is not None}
        tables.save(codes, self.spec, path, cells, self.payloads, kind=type(self).__name__, probes=self.probes, **settings)

    def _schema(self) -> str:
        return f"{SLOT} long, codes binary, scale float, norm float" + (", cell int" if self.centroids is not None else "")

    @classmethod
    def load(cls, spark: SparkSession, path: str):
        codes, spec, cells, more = tables.load(spark, path)
        if more["kind"] != cls.__name__:
            raise (IdMapError if cls is IdIndex else IndexError_)("WRONG_KIND", f"this is a {more['kind']}")
        out = cls(spark, spec.dim, spec.bits, spec.metric, spec.seed, **({"id_kind": more["id_kind"]} if more["id_kind"] else {}))
        out.spec, out.decided, out.probes = spec, True, more["probes"]
        out.calibrate, out.cells, out.two_stage = more["calibrate"], more["n_cells"], more["two_stage"]
        if more["has_payloads"]:
            out.payloads = tables.materialize(spark.read.parquet(f"{path}/payloads"), "payloads")
        if cells is not None:
            out.centroids = np.array([r.centroid for r in cells.orderBy("cell").collect()])
        out._replace(codes)
        return out


class PositionalIndex(VectorIndex):
    """Rows go by their slot, 0 to size - 1, in the order they came in."""

    def add(self, vectors: DataFrame, order_by: str = "id", column: str = "vector") -> None:
        """vectors: rows with ``column``; slots go on in the order of ``order_by``. All or nothing."""
        batch = vectors.select(F.col(order_by).alias("_order"), F.col(column).alias("vector"))
        try:
            validate(batch, self.spec.dim)
        except EncodeError as e:
            raise IndexError_("INVALID_LENGTH" if e.code == "INVALID_LENGTH" else "INVALID_VECTOR", str(e)) from None
        slotted = tables.materialize(dense_slots(batch, ["_order"], self.size).drop("_order"), "batch")
        n = slotted.count()
        if n:
            self._prepare(slotted, n, SLOT)
            self._append(slotted.select(SLOT, "vector"), n)

    def add_one(self, vector: Iterable[float]) -> None:
        """A row that decides nothing about calibration or cells."""
        one = self.spark.createDataFrame([(self.size, [float(x) for x in vector])], f"{SLOT} long, vector array<double>")
        validate(one, self.spec.dim)
        self._append(one, 1)

    def swap_remove(self, slot: int) -> None:
        """The last row takes the place of the one that goes."""
        if not isinstance(slot, int) or not 0 <= slot < self.size:
            raise IndexError_("INVALID_INDEX", f"slots go from 0 to {self.size - 1}, got {slot}")
        last = self.size - 1
        self._replace(self.codes.where(F.col(SLOT) != slot).withColumn(SLOT, F.when(F.col(SLOT) == last, F.lit(slot)).otherwise(F.col(SLOT)).cast("long")))

    @classmethod
    def from_bytes(cls, spark: SparkSession, data: bytes) -> PositionalIndex:
        p = binary.loads(data)
        if p.ids is not None:
            raise IndexError_("WRONG_KIND", "this index has ids")
        out = cls(spark, p.spec.dim, p.spec.bits, p.spec.metric, p.spec.seed)
        out._restore(p, None, "")
        return out


#: How ids of each kind are held.
ID_TYPES = {"number": "double", "integer": "bigint", "string": "string", "bigint": "decimal(38,0)"}


class IdIndex(VectorIndex):
    """Rows go by an id; slots follow the order in which rows came in."""

    key = "id"

    def __init__(self, spark: SparkSession, dim: int, bits: int = 4, metric: str = "cosine", seed: int = 0, id_kind: str = "integer", **more):
        super().__init__(spark, dim, bits, metric, seed, **more)
        if id_kind not in ID_TYPES:
            raise IdMapError("INVALID_ID_TYPE", f"ids are {', '.join(ID_TYPES)}, got {id_kind}")
        self.id_kind = id_kind

    def _empty(self) -> Exception:
        return IdMapError("EMPTY", "the index has no vectors")

    def _schema(self) -> str:
        return f"{SLOT} long, id {ID_TYPES[self.id_kind]}, codes binary, scale float, norm float" + (", cell int" if self.centroids is not None else "")

    def _batch(self, points: DataFrame) -> DataFrame:
        """(id, vector), checked by aggregates: ids' type, repeats, vectors."""
        kind = points.schema["id"].dataType
        whole = isinstance(kind, T.IntegralType)
        fits = {"number": isinstance(kind, T.NumericType), "integer": whole, "string": isinstance(kind, T.StringType), "bigint": whole or isinstance(kind, T.DecimalType)}
        if not fits[self.id_kind]:
            raise IdMapError("INVALID_ID_TYPE", f"ids are of type {kind.simpleString()}, not {self.id_kind}")
        batch = points.select(F.col("id").cast(ID_TYPES[self.id_kind]).alias("id"), F.col("vector").cast("array<double>").alias("vector"))
        held = F.col("id").isNull() | (F.isnan("id") | (F.abs("id") == float("inf")) if self.id_kind == "number" else F.lit(False))
        if batch.agg(F.max(held)).first()[0]:
            raise IdMapError("INVALID_ID_TYPE", "ids must not be null or non-finite")
        if batch.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count():
            raise IdMapError("DUPLICATE_ID", "an id occurs twice in the batch")
        try:
            validate(batch, self.spec.dim)
        except EncodeError as e:
            raise IdMapError("INVALID_LENGTH" if e.code == "INVALID_LENGTH" else "INVALID_VECTOR", str(e)) from None
        return batch

    def add_with_ids(self, points: DataFrame) -> None:
        """points: (id, vector). All or nothing."""
        batch = self._batch(points)
        if self.codes is not None and batch.join(self.codes.select("id"), "id", "left_semi").limit(1).count():
            raise IdMapError("DUPLICATE_ID", "an id is in the index already")
        self._extend(batch)

    def _extend(self, batch: DataFrame) -> None:
        slotted = tables.materialize(dense_slots(batch, ["id"], self.size), "batch")
        n = slotted.count()
        if n:
            self._prepare(slotted, n, SLOT)
            self._append(slotted.select(SLOT, "id", "vector"), n)

    def remove(self, id_) -> None:
        if not self.has(id_):
            raise IdMapError("UNKNOWN_ID", f"there is no {id_!r}")
        self._drop([id_])

    def _drop(self, ids: list) -> None:
        """Rows of these ids go; the others close ranks in their order."""
        if self.codes is None:
            return
        left = self.codes.where(~F.col("id").isin(ids)) if ids else self.codes
        self._replace(dense_slots(left.withColumnRenamed(SLOT, "_old"), ["_old"]).drop("_old").select(*self.codes.columns))

    def has(self, id_) -> bool:
        return self.codes is not None and bool(self.codes.where(F.col("id") == F.lit(id_)).limit(1).count())

    def ids(self) -> DataFrame:
        """(slot, id)"""
        return (self.codes if self.codes is not None else self.spark.createDataFrame([], self._schema())).select(SLOT, "id").orderBy(SLOT)

    def _payload(self) -> binary.Payload:
        out = super()._payload()
        wrap: Callable = {"number": float, "integer": float, "string": str, "bigint": lambda x: binary.BigId(int(x))}[self.id_kind]
        out.ids = [wrap(r.id) for r in self.ids().collect()]
        return out

    @classmethod
    def from_bytes(cls, spark: SparkSession, data: bytes) -> IdIndex:
        p = binary.loads(data)
        if p.ids is None:
            raise IdMapError("WRONG_KIND", "this index has no ids")
        first = p.ids[0] if p.ids else 0.0
        kind = "string" if isinstance(first, str) else "bigint" if isinstance(first, binary.BigId) else "number"
        out = cls(spark, p.spec.dim, p.spec.bits, p.spec.metric, p.spec.seed, kind)
        import decimal

        out._restore(p, [decimal.Decimal(int(x)) for x in p.ids] if kind == "bigint" else list(p.ids), ID_TYPES[kind])
        return out


class Collection(IdIndex):
    """Points with payloads: upsert, delete, filtered search. The payload is a struct column."""

    def __init__(self, *args, **more):
        super().__init__(*args, **more)

    def upsert(self, points: DataFrame) -> None:
        """points: (id, vector) and maybe payload (a struct). Replaces points of the same ids, payload and all.

        Payloads of any shape share a collection: a key that points hold with unlike types becomes a variant. New
        tables are written first and taken over together, so a failure leaves points and payloads as they were.
        """
        batch = tables.materialize(self._batch(points), "upsert")
        gone = batch.select("id")
        before = self.spec, self.centroids, self.decided
        try:
            parts = self.parts
            if self.codes is not None and self.codes.join(gone, "id", "left_semi").limit(1).count():
                left = self.codes.join(gone, "id", "left_anti").withColumnRenamed(SLOT, "_old")
                parts = [p for p in [self._table(dense_slots(left, ["_old"]).drop("_old").select(*self.codes.columns))] if p[1]]
            slotted = tables.materialize(dense_slots(batch, ["id"], sum(n for _, n in parts)), "batch")
            n = slotted.count()
            if n:
                self._prepare(slotted, n, SLOT)
                parts = self._grown(parts, slotted.select(SLOT, "id", "vector"), n)
            payloads = self.payloads.join(gone, "id", "left_anti") if self.payloads is not None else None
            if "payload" in points.columns:
                new = points.select(F.col("id").cast(ID_TYPES[self.id_kind]).alias("id"), "payload")
                payloads = new if payloads is None else united(payloads, new, "payload")
            payloads = tables.materialize(payloads, "payloads") if payloads is not None else None
        except Exception:
            self.spec, self.centroids, self.decided = before
            raise
        self._set(parts)
        self.payloads = payloads

    def _drop(self, ids: list) -> None:
        payloads = self.payloads
        if payloads is not None and ids:
            payloads = tables.materialize(payloads.where(~F.col("id").isin(ids)), "payloads")
        super()._drop(ids)
        self.payloads = payloads

    def delete(self, ids) -> None:
        """Unknown ids don't matter."""
        ids = list(ids) if isinstance(ids, (list, tuple, set)) else [ids]
        if ids and self.codes is not None:
            self._drop(ids)

    def points(self) -> DataFrame:
        """Codes with their payload, if there are payloads: what filters see. Columns that a plan doesn't use aren't read."""
        return self.codes.join(self.payloads, "id", "left") if self.payloads is not None else self.codes

    def search_points(self, queries: DataFrame, filter: dict | None = None, limit: int = 10, with_payload: bool = True, metric: str | None = None, probes: int | None = None) -> DataFrame:
        """(qid, rank, id, score, payload). Payloads join the hits, not the rows that are scanned."""
        payload = self.payloads is not None
        if self.codes is None or not self.size:
            return self.spark.createDataFrame([], f"qid {queries.schema['qid'].dataType.simpleString()}, rank int, id {ID_TYPES[self.id_kind]}, score float")
        codes = self.codes
        if filter is not None:
            seen = self.points() if payload else codes.withColumn("payload", F.struct(F.lit(None).cast("void").alias("_")))
            codes = seen.where(compile_filter(filter, seen.schema, "id", "payload")).drop("payload")
        found = self._found(codes, queries, limit, metric, None, probes, "id")
        return found.join(self.payloads, "id", "left").select("qid", "rank", "id", "score", "payload") if payload and with_payload else found

    def get(self, id_) -> dict | None:
        """{"id", "payload"}; None if there is no such point. Keys that the point lacks, or has null, are left out."""
        if not self.has(id_):
            return None
        row = self.payloads.where(F.col("id") == F.lit(id_)).first() if self.payloads is not None else None
        return {"id": id_, "payload": plain(row.payload) if row is not None else None}

