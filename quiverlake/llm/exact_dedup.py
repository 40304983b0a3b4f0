"""Exact dedup with a heavy-hitter split.

Misra-Gries summaries of the digests find the candidates for frequent digests. Their exact groups are
aggregated (partial sums before a small shuffle) and, at most ``counters`` of them, broadcast: rows of
frequent digests are decided map-side and never shuffled. The other digests use an ordinary shuffle; none
of them holds more than about rows / counters of the rows.

Defined results: null text counts as empty; a null id never wins against an id; of rows repeated with the
same id and text all carry ``kept`` alike (``drop_duplicates`` leaves one of them); an empty table gives an
empty result; columns beyond id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import arrow_schema, cut, text_of, unused

COUNTERS = 1024


def misra_gries(keys: Iterator, counters: int) -> dict:
    """Keys that may occur in more than len / (counters + 1) places, with lower bounds of their counts."""
    held: dict = {}
    for k in keys:
        if k in held:
            held[k] += 1
        elif len(held) < counters:
            held[k] = 1
        else:
            held = {x: n - 1 for x, n in held.items() if n > 1}
    return held


def merged_counts(parts: Iterator[np.ndarray], counters: int) -> dict:
    """``misra_gries`` of whole numbers, a batch at a time: counts are added up, and the largest that has no place is taken off all."""
    held, n = np.empty(0, np.int64), np.empty(0, np.int64)
    for part in parts:
        own, size = np.unique(part, return_counts=True)
        held, at = np.unique(np.concatenate([held, own]), return_inverse=True)
        n = np.bincount(at, np.concatenate([n, size])).astype(np.int64) if held.size else n
        if held.size > counters:
            n = n - np.partition(n, held.size - counters - 1)[held.size - counters - 1]
            held, n = held[n > 0], n[n > 0]
    return dict(zip(held.tolist(), n.tolist(), strict=True))


def frequent(keyed: DataFrame, key: str, counters: int = COUNTERS) -> DataFrame:
    """Candidates for keys with more than about rows / counters rows; at most ``counters`` rows.

    A key above that share is above it in some partition's rows too, so its summary there keeps it; merged
    lower bounds order the candidates.
    """
    schema = f"{key} {keyed.schema[key].dataType.simpleString()}, bound long"
    wanted = arrow_schema(schema)

    def summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if pa.types.is_int64(wanted[0].type):
            held = merged_counts((b.column(0).drop_null().to_numpy() for b in batches), counters)
        else:
            held = misra_gries((k for b in batches for k in b.column(0).to_pylist()), counters)
        # One occurrence in a partition says nothing: such keys would only be shuffled in vain.
        rows = [(k, n) for k, n in held.items() if n > 1]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(wanted)], schema=wanted)

    found = keyed.select(key).mapInArrow(summaries, schema).groupBy(key).agg(F.sum("bound").alias("bound"))
    return found.orderBy(F.desc("bound"), key).limit(counters).select(key)


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = COUNTERS) -> DataFrame:
    """One row per document: its id, keep_id, group_size, kept, text_sha256."""
    keyed = cut(docs.select(F.col(id_col).alias("doc_id"), F.unhex(F.sha2(text_of(text_col), 256)).alias("digest")), "digests")
    hot = frequent(keyed, "digest", counters)
    summed = [F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")]
    # Verified winners: exact maxima and counts of at most ``counters`` digests; a group of one is no winner.
    winners = cut(keyed.join(F.broadcast(hot), "digest", "left_semi").groupBy("digest").agg(*summed), "winners")
    few = F.broadcast(winners)
    heavy = keyed.join(few, "digest")
    rest = keyed.join(few.select("digest"), "digest", "left_anti")
    light = rest.join(rest.groupBy("digest").agg(*summed), "digest")
    return heavy.unionByName(light).select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the copies: of equal texts the row with the largest id stays, with all its columns.

    Rows repeated with the same id and text leave one row. One shuffle of the documents, by a hash of id and
    text, which no group of copies makes uneven.
    """

    def key(doc_id: Column, sha: Column) -> Column:
        return F.sha2(F.concat_ws(" ", F.coalesce(doc_id.cast("string"), F.lit("null")), sha), 256)

    mark = unused(docs, "_kept")
    kept = groups(docs, id_col, text_col).where("kept").select(key(F.col("doc_id"), F.col("text_sha256")).alias(mark))
    marked = docs.withColumn(mark, key(F.col(id_col), F.sha2(text_of(text_col), 256)))
    return marked.join(kept, mark, "left_semi").dropDuplicates([mark]).drop(mark)


SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
