"""Near copies: SimHash fingerprints of five-word shingles and what they can't reach, held to an exact Jaccard similarity.

Texts whose fingerprints ``simhash`` links by deletion variants meet first. At Jaccard 0.8 two fingerprints of 64
bits differ in about ten, which no index by variants reaches. So texts meet by MinHash too: in each of ``BANDS``
bands, texts whose ``ROWS`` smallest hashes are equal share a bucket; two texts of similarity 0.8 share none with a
chance of 3e-5. Whatever meets is compared on whole shingle sets: first each text with the one that its fingerprint
is linked with and with its bucket's smallest, then those of a bucket that are still in
different components, in blocks of ``BLOCK`` texts: a task gets two blocks, compares their sketches (a byte of each
of the hashes), then the whole sets of those that agree in ``AGREE`` bytes, and emits links that join components, not
pairs. Two texts of similarity 0.8 agree in fewer bytes with a chance of 1e-4. Texts with equal sets are one node.

Defined results: null text is empty; texts without words are copies of each other; a text of fewer than five words is one shingle;
rows with a null id stay and take no part; rows that share the id of a document that stays, stay; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import arrow_schema, cut, text_of, unused
from .components import components
from .simhash import links as fingerprint_links
from .simhash import of_hashes
from .substring_dedup import WordHashes, kmers

WORDS, SIMILARITY = 5, 0.8
BANDS, ROWS = 20, 4
BLOCK, BLOCK_BYTES = 1024, 16 << 20
AGREE = 51  # of BANDS * ROWS bytes
_RNG = np.random.default_rng(17)
_ODD = _RNG.integers(1 << 63, size=BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(1 << 63, size=BANDS * ROWS, dtype=np.uint64)


def shingles(words: np.ndarray, n: int = WORDS) -> np.ndarray:
    """The distinct shingles' hashes, ascending."""
    return np.unique(kmers(words, min(n, words.size))) if words.size else np.zeros(1, np.uint64)


def node_of(own: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(own.tobytes())


def least_of(own: np.ndarray) -> np.ndarray:
    return np.array([((own ^ (own >> np.uint64(31))) * a + b).min() for a, b in zip(_ODD, _ADD, strict=True)], np.uint64)


def bands_of(least: np.ndarray) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(least[i : i + ROWS].tobytes(), i) for i in range(0, least.size, ROWS)], np.uint64)


def sketch_of(least: np.ndarray) -> bytes:
    return ((least * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(56)).astype(np.uint8).tobytes()


def _nodes(texts: DataFrame) -> DataFrame:
    """(doc_id, node, fp, bands, sketch) for (doc_id, text)"""
    schema = f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, node long, fp long, bands array<long>, sketch binary"
    wanted = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in batches:
            sets = [shingles(hashes.of(t.as_py())) for t in b.column(1)]
            nodes = np.array([node_of(s) for s in sets], np.uint64).view(np.int64)
            fps = np.array([of_hashes(s) for s in sets], np.uint64).view(np.int64)
            least = [least_of(s) for s in sets]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(wanted[0].type), pa.array(nodes), pa.array(fps), pa.array([bands_of(x).view(np.int64) for x in least], wanted[3].type), pa.array([sketch_of(x) for x in least], pa.binary())], schema=wanted)

    return texts.mapInArrow(run, schema)


def _sets(texts: DataFrame, distinct: DataFrame, asked: DataFrame) -> DataFrame:
    """(node, own): the asked nodes' whole shingle sets."""
    schema = "node long, own binary"
    wanted = arrow_schema(schema)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in batches:
            sets = [shingles(hashes.of(t.as_py())) for t in b.column(1)]
            nodes = np.array([node_of(s) for s in sets], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array([s.tobytes() for s in sets], pa.binary())], schema=wanted)

    lows = distinct.join(asked, "node", "left_semi").select(F.col("low").alias("doc_id"))
    sets = texts.join(lows, "doc_id", "left_semi").select("doc_id", "text").mapInArrow(made, schema)
    return cut(sets.join(asked, "node", "left_semi").dropDuplicates(["node"]), "sets")


def _linked(distinct: DataFrame) -> DataFrame:
    """(u, v): each node with the least of its fingerprint, and those with the one that their fingerprint is linked with."""
    leads = cut(distinct.groupBy("fp").agg(F.min("node").alias("lead")), "leads")
    same = distinct.select("node", "fp").join(leads, "fp").where("node <> lead").select(F.col("node").alias("u"), F.col("lead").alias("v"))
    near = fingerprint_links(leads.select("fp")).distinct()
    near = near.join(leads.select(F.col("fp").alias("u"), F.col("lead").alias("a")), "u").join(leads.select(F.col("fp").alias("v"), F.col("lead").alias("b")), "v")
    return same.unionByName(near.select(F.col("a").alias("u"), F.col("b").alias("v")))


def alike(x: np.ndarray, y: np.ndarray, similarity: float) -> bool:
    least, most = sorted((x.size, y.size))
    if least < similarity * most:
        return False
    common = np.intersect1d(x, y, assume_unique=True).size
    return common >= similarity * (x.size + y.size - common)


def _similar(texts: DataFrame, distinct: DataFrame, pairs: DataFrame, similarity: float) -> DataFrame:
    """The pairs (u, v) whose whole shingle sets have the similarity."""
    asked = cut(pairs.select(F.col("u").alias("node")).unionByName(pairs.select(F.col("v").alias("node"))).distinct(), "asked")
    sets = _sets(texts, distinct, asked)
    both = pairs.join(sets.select(F.col("node").alias("u"), F.col("own").alias("a")), "u").join(sets.select(F.col("node").alias("v"), F.col("own").alias("b")), "v").select("u", "v", "a", "b")
    linked = arrow_schema("u long, v long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [alike(np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64), similarity) for a, b in zip(batch.column(2), batch.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays(batch.columns[:2], schema=linked).filter(pa.array(keep, pa.bool_()))

    return cut(both.mapInArrow(run, "u long, v long"), "similar")


def _apart(named: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(u, v): links that connect what similar nodes of a bucket connect beyond their labels. named: (key, node, label, sketch)."""
    sizes = named.join(sets.select("node", F.octet_length("own").alias("bytes")), "node").groupBy("key").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("bytes") / BLOCK_BYTES)).cast("int").alias("blocks"))
    own = named.join(sizes, "key").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).join(sets, "node")
    dealt = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = dealt.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "node", "label", "sketch", "own")
    wanted = arrow_schema("u long, v long")

    def compared(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        node, label = (np.array([r[k] for r in rows], np.int64) for k in (0, 1))
        sketch = np.frombuffer(b"".join(r[2] for r in rows), np.uint8).reshape(len(rows), -1)
        columns, held, links = np.ascontiguousarray(sketch.T), [np.frombuffer(r[3], np.uint64) for r in rows], []
        for i in range(len(rows)):
            near = np.zeros(len(rows) - i, np.uint8)
            for c in columns:
                near += c[i:] == c[i]
            for k in (i + np.flatnonzero((near >= AGREE) & (label[i:] != label[i]))).tolist():
                if label[k] != label[i] and alike(held[i], held[k], similarity):
                    label[label == label[k]] = label[i]
                    links.append((node[i], node[k]))
        if links:
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], schema=wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, rows = None, []  # of one cell: two blocks at most
        for b in batches:
            for key, i, j, *row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (key, i, j) != cell and rows:
                    yield from compared(rows)
                    rows = []
                cell = key, i, j
                rows.append(tuple(row))
        if rows:
            yield from compared(rows)

    return cut(cells.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "node").mapInArrow(run, "u long, v long").distinct(), "apart")


def drop_near_copies(docs: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document of each component of similar texts: the one with the smallest id, with all its columns."""
    texts = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    nodes = cut(_nodes(texts), "nodes")
    distinct = cut(nodes.groupBy("node").agg(F.min("doc_id").alias("low"), F.min("fp").alias("fp"), F.min("bands").alias("bands"), F.min("sketch").alias("sketch")), "distinct")
    rows = distinct.select("node", F.explode("bands").alias("key"))
    several = rows.groupBy("key").agg(F.min("node").alias("lead"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    buckets = cut(rows.join(several, "key"), "buckets")
    leads = buckets.where("node <> lead").select(F.col("node").alias("u"), F.col("lead").alias("v"))
    first = cut(_linked(distinct).unionByName(leads).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "first")
    links = _similar(texts, distinct, first, similarity)
    labels = cut(components(links), "labels")
    named = cut(buckets.join(labels, "node", "left").select("key", "node", F.coalesce("root", "node").alias("label")), "named")
    open_ = named.groupBy("key").agg(F.min("label").alias("a"), F.max("label").alias("b")).where("a < b").select("key")
    named = cut(named.join(open_, "key", "left_semi").join(distinct.select("node", "sketch"), "node"), "open")
    sets = _sets(texts, distinct, cut(named.select("node").distinct(), "asked"))
    links = links.unionByName(_apart(named, sets, similarity))
    roots = cut(components(links), "roots")
    rooted = distinct.join(roots, "node", "left").select("node", "low", F.coalesce("root", "node").alias("root"))
    staying = cut(rooted.groupBy("root").agg(F.min("low").alias("doc_id")).select("doc_id"), "staying")
    going = cut(nodes.select("doc_id").join(staying, "doc_id", "left_anti").distinct(), "going")
    other = unused(docs, "_going")
    return docs.join(going.withColumnRenamed("doc_id", other), F.col(id_col) == F.col(other), "left_anti")
