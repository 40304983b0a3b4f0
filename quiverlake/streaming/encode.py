"""Streams of vectors: encoding needs no state, so it is the batch operator; sinks append or upsert."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..functions.codec import IndexSpec
from ..operators.encode import encode, problem
from ..operators.indexes import Collection


def encode_stream(stream: DataFrame, spec: IndexSpec, column: str = "vector") -> DataFrame:
    """The stream with its vectors coded. Rows that can't be coded are left out; see ``rejected_stream``."""
    return encode(stream.where(problem(stream[column], spec.dim).isNull()), spec, column, strict=False)


def rejected_stream(stream: DataFrame, spec: IndexSpec, column: str = "vector") -> DataFrame:
    """The rows that can't be coded, with the reason."""
    return stream.withColumn("reason", problem(stream[column], spec.dim)).where("reason IS NOT NULL")


def append_codes(stream: DataFrame, spec: IndexSpec, path: str, checkpoint: str, column: str = "vector", **trigger) -> StreamingQuery:
    """Codes of the stream as a Parquet table under path, exactly once."""
    return encode_stream(stream, spec, column).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(**(trigger or {"availableNow": True})).start()


def upsert_stream(stream: DataFrame, collection: Collection, checkpoint: str, **trigger) -> StreamingQuery:
    """Micro-batches of (id, vector, payload) into a collection; the last row of an id in a batch must be its only one."""

    def one(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            collection.upsert(batch)

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
