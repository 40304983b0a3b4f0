"""Best-fit packing after a dominance reduction.

Documents become token pieces of at most ``capacity`` tokens. Pieces of one length are interchangeable, so
the packing is decided on the histogram of lengths (at most ``capacity`` numbers, whatever the corpus) on
the driver: first the reduction fixes bins that dominate all alternatives for their largest piece, with
multiplicity, then best-fit decreasing packs what is left. The decision is a list of bin patterns with
counts, kept as intervals of ranks within a length.

A piece's rank within its length is taken without gathering a length in one task: pieces are dealt to
buckets by a hash, ranks run within (length, bucket), and the buckets' counts are summed up before. Each
piece then finds its interval, and from it its sequence and offset, by binary search in the broadcast plan.

Dominance (Martello and Toth): for the largest piece j with room r = capacity - j, a set F holding j
dominates if every feasible set with j can be exchanged for F piece by piece. Used here:
- nothing fits beside j: {j};
- the largest piece k that fits fills the room: {j, k};
- no two pieces fit beside j: {j, k};
- no three fit, and the best two sum to k at most: {j, k};
- no three fit, and with b the largest beside k, no two fitting pieces are both larger than b: {j, k, b}.

Defined results: null text is empty and is its end token alone; a null id is carried; repeated rows are
documents of their own; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import bisect
import struct
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import arrow_schema, count_rows, cut, text_of
from .word_ids import of_worker

CAPACITY = 4096
PER_BUCKET = 2048  # pieces to a bucket, about
PIECES = "doc_id {kind}, piece int, start long, length long, ids_crc32 long"

Pattern = tuple[int, ...]


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document's ids and its end token."""
    schema = PIECES.format(kind=docs.schema[id_col].dataType.simpleString())
    wanted = arrow_schema(schema)
    end = struct.pack("<I", end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = of_worker(tokenizer)
        for b in batches:
            whose, rows = [], []
            for i, text in enumerate(b.column(1)):
                ids = words.encode(text.as_py()) + end
                for n, at in enumerate(range(0, len(ids), 4 * capacity)):
                    own = ids[at : at + 4 * capacity]
                    whose.append(i)
                    rows.append((n, at // 4, len(own) // 4, zlib.crc32(own)))
            columns = [b.column(0).cast(wanted[0].type).take(pa.array(whose, pa.int64())), *(pa.array([r[k] for r in rows], f.type) for k, f in enumerate(list(wanted)[1:]))]
            yield pa.RecordBatch.from_arrays(columns, schema=wanted)
        words.forget()

    return docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text")).mapInArrow(run, schema)


class Histogram:
    """Counts by length, with the lengths in order."""

    def __init__(self, counts: dict[int, int]):
        self.counts = {k: n for k, n in counts.items() if n > 0}
        self.lengths = sorted(self.counts)

    def take(self, length: int, n: int) -> None:
        self.counts[length] -= n
        if not self.counts[length]:
            del self.counts[length]
            del self.lengths[bisect.bisect_left(self.lengths, length)]

    def largest(self, most: int, but: Pattern = ()) -> int | None:
        """The largest length up to ``most`` of which a piece is left beside those in ``but``."""
        i = bisect.bisect_right(self.lengths, most) - 1
        while i >= 0 and self.counts[self.lengths[i]] <= but.count(self.lengths[i]):
            i -= 1
        return self.lengths[i] if i >= 0 else None

    def smallest(self, n: int, but: Pattern = (), above: int = 0) -> list[int]:
        """The n smallest pieces longer than ``above`` beside those in ``but``, fewer if there are no more."""
        out: list[int] = []
        for x in self.lengths[bisect.bisect_right(self.lengths, above) :]:
            out += [x] * min(n - len(out), self.counts[x] - but.count(x))
            if len(out) >= n:
                break
        return out

    def best_pair(self, room: int, but: Pattern) -> int:
        """The largest sum of two pieces up to ``room``; 0 if no two fit."""
        best, lo, hi = 0, 0, bisect.bisect_right(self.lengths, room) - 1
        left = lambda x: self.counts[x] - but.count(x)
        while lo <= hi:
            a, b = self.lengths[lo], self.lengths[hi]
            if left(a) < 1:
                lo += 1
            elif left(b) < 1 or a + b > room:
                hi -= 1
            else:
                if a != b or left(a) > 1:
                    best = max(best, a + b)
                lo += 1
        return best


def dominating(h: Histogram, j: int, capacity: int) -> Pattern | None:
    """A set that dominates every other for a piece of length j; None if these rules show none."""
    room, but = capacity - j, (j,)
    k = h.largest(room, but)
    if k is None:
        return (j,)
    if k == room:
        return (j, k)
    few = h.smallest(3, but)
    if len(few) < 2 or few[0] + few[1] > room:
        return (j, k)
    if len(few) > 2 and sum(few) <= room:
        return None
    if h.best_pair(room, but) <= k:
        return (j, k)
    b = h.largest(room - k, (j, k))
    if b is not None:
        two = h.smallest(2, but, above=b)
        if len(two) < 2 or sum(two) > room:
            return (j, k, b)
    return None


def reduce(h: Histogram, capacity: int) -> list[tuple[Pattern, int]]:
    """Fixes dominating sets, taking them from h, for as long as a pass finds any."""
    fixed: list[tuple[Pattern, int]] = []
    found = True
    while found:
        found, j = False, h.largest(capacity)
        while j is not None:
            if (bin_ := dominating(h, j, capacity)) is None:
                j = h.largest(j - 1)
                continue
            n = min(h.counts[x] // bin_.count(x) for x in set(bin_))
            for x in bin_:
                h.take(x, n)
            fixed.append((bin_, n))
            found, j = True, h.largest(j)
    return fixed


def best_fit(h: Histogram, capacity: int) -> list[tuple[Pattern, int]]:
    """Best-fit decreasing of what h holds, bins of one kind at once."""
    open_: dict[int, list[tuple[Pattern, int]]] = defaultdict(list)
    rooms: list[int] = []

    def put(pattern: Pattern, n: int) -> None:
        room = capacity - sum(pattern)
        if n and not open_[room]:
            bisect.insort(rooms, room)
        if n:
            open_[room].append((pattern, n))

    for j in reversed(h.lengths):
        left = h.counts[j]
        while left:
            at = bisect.bisect_left(rooms, j)
            room, (pattern, n) = (rooms[at], open_[rooms[at]].pop()) if at < len(rooms) else (capacity, ((), left))
            if at < len(rooms) and not open_[room]:
                del rooms[at]
            each = min(room // j, left)  # a bin that takes one is the best fit for the next, as long as one fits
            bins = min(n, left // each)
            put(pattern + (j,) * each, bins)
            if pattern:
                put(pattern, n - bins)
            left -= bins * each
    return [x for found in open_.values() for x in found]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> dict[str, np.ndarray]:
    """Intervals of ranks, by length: in an interval each bin takes ``each`` pieces in a row, from ``offset`` on."""
    h = Histogram(counts)
    used: dict[int, int] = defaultdict(int)
    rows, first = [], 0
    for pattern, n in reduce(h, capacity) + best_fit(h, capacity):
        offset = 0
        for length in sorted(set(pattern), reverse=True):
            each = pattern.count(length)
            rows.append((length, used[length], first, each, offset))
            used[length] += each * n
            offset += each * length
        first += n
    return dict(zip(("length", "rank", "first", "each", "offset"), np.array(sorted(rows), np.int64).reshape(-1, 5).T.copy(), strict=True))


def placed(p: dict[str, np.ndarray], length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of the pieces of these lengths and ranks."""
    wide = np.int64(1) << 44
    at = np.searchsorted(p["length"] * wide + p["rank"], length * wide + rank, "right") - 1
    own = rank - p["rank"][at]
    return p["first"][at] + own // p["each"][at], p["offset"][at] + own % p["each"][at] * length


def pack(cut_pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """cut_pieces (see ``pieces``) with sequence_id and offset."""
    held = cut(cut_pieces, "pieces")
    buckets = max(16, count_rows(held) // PER_BUCKET)
    dealt = held.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32"), F.lit(buckets)))
    cells = cut(dealt.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n")), "cells")
    lengths = {r.length: r.n for r in cells.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``capacity`` rows
    decided = held.sparkSession.sparkContext.broadcast(plan(lengths, capacity))
    before = cells.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")).drop("n")
    within = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "start", "ids_crc32"))
    ranked = dealt.withColumn("within", within).join(before, ["length", "bucket"]).withColumn("rank", F.col("before") + F.col("within") - 1)
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    schema = PIECES.format(kind=held.schema["doc_id"].dataType.simpleString()) + ", sequence_id long, offset long"
    wanted = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sequence, offset = placed(decided.value, b.column("length").to_numpy(), b.column("rank").to_numpy())
            yield pa.RecordBatch.from_arrays([*(b.column(n).cast(wanted.field(n).type) for n in names), pa.array(sequence), pa.array(offset)], schema=wanted)

    return ranked.select(*names, "rank").mapInArrow(run, schema)


def packed(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(pieces(docs, tokenizer, capacity, end_id, id_col, text_col), capacity)
