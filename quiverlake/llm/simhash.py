"""SimHash near-dedup with deletion-variant signatures.

A fingerprint of 64 bits is cut into two segments. If two fingerprints differ in three bits at most, one of
their segments differs in one bit at most; clearing that bit in both makes the segments equal. So every
distinct fingerprint is indexed under the 64 variants that clear one bit of one segment, rows meet by
equality of the variant, and the meeting is verified on whole fingerprints.

What meets under a variant is linked without emitting its pairs: a block-wise comparison gives the
components within the variant's rows, and each member is linked with the smallest of its component. Equal
fingerprints are collapsed before. Rows of one variant share 31 bits and are distinct, and a cluster of
near copies has some thousands of distinct fingerprints at most in reach of each other; beyond
``PROBE_FROM`` rows, neighbours are looked up by flipping bits, in time linear in the rows.

Defined results: null text is empty; a text without words has fingerprint zero, linked like any other;
repeated rows each get their row; null ids are never the smallest id unless there is no other; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import arrow_schema, cut, text_of, unused
from .components import components

BITS = 64
REACH = 3  # differing bits that still link
BLOCK = 1 << 22  # pairs compared at once
PROBE_FROM = 400_000
PIECE = 1 << 18  # shingles hashed at once


def _counts(h: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit."""
    return np.unpackbits(h.astype("<u8").view(np.uint8), bitorder="little").reshape(-1, BITS).sum(0, dtype=np.int64)


def _majority(counts: np.ndarray, n: int) -> int:
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def of_hashes(h: np.ndarray) -> int:
    """The fingerprint of shingles given by their hashes."""
    return _majority(sum((_counts(h[i : i + PIECE]) for i in range(0, h.size, PIECE)), np.zeros(BITS, np.int64)), h.size)


def fingerprint(text: str, words_in_shingle: int = 3, seed: int = 42) -> int:
    """Bit i is 1 if it is set in over half of the hashes of the text's shingles."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < words_in_shingle:
        shingles: Iterator[bytes] = iter((b" ".join(words),))
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(words_in_shingle)), strict=False))
    counts, n = np.zeros(BITS, np.int64), 0
    hashed = map(xxhash.xxh64_intdigest, shingles, itertools.repeat(seed))
    while (h := np.fromiter(itertools.islice(hashed, PIECE), np.uint64)).size:
        counts += _counts(h)
        n += h.size
    return _majority(counts, n)


def fingerprints(docs: DataFrame, words_in_shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long."""
    schema = f"doc_id {docs.schema[id_col].dataType.simpleString()}, fp long"
    wanted = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t, words_in_shingle) for t in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0).cast(wanted[0].type), pa.array(fps)], schema=wanted)

    return docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text")).mapInArrow(run, schema)


def _flips(reach: int) -> list[int]:
    return [sum(1 << i for i in c) for n in range(1, reach + 1) for c in itertools.combinations(range(BITS), n)]


def linked_within(fps: np.ndarray, reach: int = REACH, probe_from: int = PROBE_FROM) -> np.ndarray:
    """For distinct sorted fingerprints: the position of the smallest that each reaches over links."""
    label = np.arange(fps.size)

    def merge(found: np.ndarray) -> None:
        if (roots := np.unique(label[found])).size > 1:
            label[np.isin(label, roots[1:])] = roots[0]

    if fps.size < probe_from:
        rows = max(1, BLOCK // max(1, fps.size))
        for i in range(0, fps.size, rows):
            near = np.bitwise_count(fps[i : i + rows, None] ^ fps[None, :]) <= reach
            for row in near:  # holds the row's own place
                merge(np.flatnonzero(row))
        return label
    for mask in _flips(reach):
        other = fps ^ np.uint64(mask)
        at = np.minimum(np.searchsorted(fps, other), fps.size - 1)
        for i in np.flatnonzero((fps[at] == other) & (label[at] != label)).tolist():
            merge(np.array([i, at[i]]))
    return label


def links(distinct: DataFrame) -> DataFrame:
    """(u, v) between distinct fingerprints (fp), enough to connect what links connect."""
    segment = F.expr("(fp >> cast(32 * (k div 32) as int)) & 4294967295L")
    variants = (
        distinct.select("fp", F.explode(F.sequence(F.lit(0), F.lit(BITS - 1))).alias("k"))
        .select(F.expr("shiftleft(cast(k as long), 32)").bitwiseOR(segment.bitwiseAND(F.expr("~shiftleft(1L, k % 32)"))).alias("variant"), "fp")
        .repartition("variant")
        .sortWithinPartitions("variant", "fp")
    )
    schema = "u long, v long"
    wanted = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_key, keep_fp = np.empty(0, np.int64), np.empty(0, np.int64)
        for b in itertools.chain(batches, [None]):
            key, fp = (keep_key, keep_fp) if b is None else (np.concatenate([keep_key, b.column(0).to_numpy()]), np.concatenate([keep_fp, b.column(1).to_numpy()]))
            if not key.size:
                continue
            edges = np.flatnonzero(np.diff(key)) + 1
            starts, ends = np.concatenate([[0], edges]), np.concatenate([edges, [key.size]])
            if b is not None:  # the last variant may go on in the next batch
                keep_key, keep_fp = key[starts[-1] :], fp[starts[-1] :]
                starts, ends = starts[:-1], ends[:-1]
            several = ends - starts > 1
            us, vs = [], []
            pair = several & (ends - starts == 2)
            a, c = fp[starts[pair]], fp[starts[pair] + 1]
            close = np.bitwise_count((a ^ c).view(np.uint64)) <= REACH
            us.append(c[close])
            vs.append(a[close])
            for s, e in zip(starts[several & ~pair].tolist(), ends[several & ~pair].tolist(), strict=True):
                own = np.sort(fp[s:e].view(np.uint64))
                root = linked_within(own)
                moved = root != np.arange(own.size)
                us.append(own[moved].view(np.int64))
                vs.append(own[root[moved]].view(np.int64))
            u, v = np.concatenate(us), np.concatenate(vs)
            if u.size:
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], schema=wanted)

    return variants.mapInArrow(run, schema)


def groups(docs: DataFrame, words_in_shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id (the smallest id reachable)."""
    fps = cut(fingerprints(docs, words_in_shingle, id_col, text_col), "fingerprints")
    distinct = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("low")), "distinct")
    roots = cut(components(cut(links(distinct.select("fp")).distinct(), "meetings")), "roots")
    rooted = distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    lowest = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    by_fp = cut(rooted.join(lowest, "root").select("fp", "component_id"), "by_fingerprint")
    return fps.join(by_fp, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), BITS // 4, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, words_in_shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document of each component: the one with the smallest id, with all its columns.

    Rows that share the id of a document that stays, stay; so do rows with a null id.
    """
    found = groups(docs, words_in_shingle, id_col, text_col)
    staying = found.where("doc_id = component_id").select("doc_id")
    going = cut(found.where("doc_id <> component_id").select("doc_id").join(staying, "doc_id", "left_anti").distinct(), "going")
    other = unused(docs, "_going")
    return docs.join(going.withColumnRenamed("doc_id", other), F.col(id_col) == F.col(other), "left_anti")
