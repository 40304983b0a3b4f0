"""Substring dedup by collinear chaining.

A document's words (ASCII lower case) give k-mers; the k-mers that are minimal in a window of ``window``
k-mers are its seeds, so a common run of window + k - 1 words always has a common seed. Documents that
share a seed meet its first document, not each other, so rows of a seed stay linear in its occurrences, and a
seed's rows stream past. Seeds with many rows (at most ``COUNTERS`` of them, found by Misra-Gries summaries) meet
their first document map-side, by a broadcast.

The first holder of a seed may hold a part of the passage only. So what no repeat explains meets again, along
longer keys: the seeds in a row, with their distances, that span ``SPANS`` words. A verbatim run of ``min_words``
words has a key of the shorter span in common wherever it stands. A repeat that no first holder shows is not found;
tests hold the result against all pairs.

The matches of two documents are chained in order: a chain's score is the words of its seeds less a gap
cost in proportion to the words skipped on either side, and the best predecessor comes from a Fenwick tree
of prefix maxima. Chains that may span ``min_words`` are aligned: both passages, padded by the seeds'
distance, are fetched from their documents, all their common k-mers are chained again, gaps are closed by
comparing words, and stretches of at least ``min_words`` words on both sides whose k-mers agree by
``similarity`` (Jaccard) are repeats. The later document, by id, holds the repeat.

Defined results: null text is empty; a text with fewer than ``min_words`` words has no repeats; a document
is its id and text, so rows with one id and different texts are documents of their own (by id, then a hash of the
text), and rows repeated with the same id and text are one document; a document isn't compared with itself; rows
with a null id are kept by ``remove_repeats`` and take no part otherwise; ids may be of any type that has an
order; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.indexes import SLOT, dense_slots
from ._common import arrow_schema, cut, text_of, unused
from .exact_dedup import frequent

K, WINDOW = 5, 16
MIN_WORDS, SIMILARITY = 50, 0.8
GAP = 0.05  # cost of a skipped word, in words
BREAK = 12  # words skipped in an alignment that end a passage
COUNTERS = 8192
SPANS = (WINDOW - 1, 2 * WINDOW - 2)  # words from the first to the last seed of a key, at least
CACHED = 100_000

_word = re.compile(r"[^\x20\x09-\x0D]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)

PAIR = "late long, early long, at_late int, at_early int, span int"
MET = f"seed long, {PAIR}"
HELD = "seed long, doc long, at int, span int, open boolean"
CHAIN = "late long, early long, late_from int, late_to int, early_from int, early_to int"
REPEAT = "doc long, start_word int, end_word int, match long, match_start int, match_end int, similarity double"


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHED:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h

    def of(self, text: str) -> np.ndarray:
        words = text.encode("utf-8", "surrogatepass").lower().split()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def kmers(words: np.ndarray, k: int = K) -> np.ndarray:
    """Hashes of the runs of k words."""
    if words.size < k:
        return np.empty(0, np.uint64)
    h = np.zeros(words.size - k + 1, np.uint64)
    for i in range(k):
        h = (h * _MIX) ^ words[i : words.size - k + 1 + i]
        h ^= h >> np.uint64(29)
    h *= _MIX
    return h ^ (h >> np.uint64(32))


def minimizers(h: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Positions that are the first minimum of some window; of the whole, if it is shorter than one."""
    if h.size <= window:
        return np.array([h.argmin()]) if h.size else np.empty(0, np.int64)
    views = np.lib.stride_tricks.sliding_window_view(h, window)
    return np.unique(np.concatenate([views[i : i + 65536].argmin(1) + np.arange(i, min(i + 65536, len(views))) for i in range(0, len(views), 65536)]))


def numbered(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame | None]:
    """(doc, text), doc in the order of ids; and (doc, id, mark), or None if doc is the id.

    Ids that are whole numbers and occur once are taken as they are. Else distinct ids and texts are numbered.
    """
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    if isinstance(docs.schema[id_col].dataType, T.IntegralType) and not rows.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count():
        return rows.select(F.col("id").cast("long").alias("doc"), "text"), None
    marked = rows.withColumn("mark", F.sha2("text", 256))
    names = cut(dense_slots(marked.select("id", "mark").distinct(), ["id", "mark"]).withColumnRenamed(SLOT, "doc"), "names")
    once = marked.dropDuplicates(["id", "mark"]).join(names, ["id", "mark"]).select("doc", "text")
    return cut(once, "numbered"), names


def seeds(texts: DataFrame, min_words: int) -> DataFrame:
    """(seed, doc, at) of (doc, text)"""
    schema = "seed long, doc long, at int"
    wanted = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in batches:
            keys, docs_, places = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], [np.empty(0, np.int32)]
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                words = hashes.of(text.as_py())
                if words.size >= min_words:
                    h = kmers(words)
                    at = minimizers(h)
                    keys.append(h[at])
                    docs_.append(np.full(at.size, doc))
                    places.append(at.astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(docs_)), pa.array(np.concatenate(places))], schema=wanted)

    return texts.mapInArrow(run, schema)


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[np.ndarray]]:
    """The columns of sorted batches, cut where the first ``keys`` columns change: each item holds whole groups."""
    held: list[list[np.ndarray]] = []  # parts of the last group, joined once it ends

    def joined() -> list[np.ndarray]:
        return [np.concatenate(x) for x in zip(*held, strict=True)]

    for b in batches:
        own = [c.to_numpy() for c in b.columns]
        if not own[0].size:
            continue
        if held and any(x[0] != y[-1] for x, y in zip(own[:keys], held[-1], strict=False)):
            yield joined()
            held = []
        last = np.logical_and.reduce([c == c[-1] for c in own[:keys]])
        at = int(np.argmax(last))  # sorted: the last group begins here
        if at:
            held.append([c[:at] for c in own])
            yield joined()
            held = []
        held.append([c[at:] for c in own])
    if held:
        yield joined()


def _starts(columns: list[np.ndarray], keys: int) -> np.ndarray:
    return np.concatenate([[0], np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in columns[:keys]])) + 1])


def matches(found: DataFrame) -> DataFrame:
    """MET rows: every open occurrence of a seed against the seed's first document. found: HELD rows."""
    hot = F.broadcast(cut(frequent(found, "seed", COUNTERS), "hot"))
    heavy = found.join(hot, "seed", "left_semi")
    firsts = F.broadcast(cut(heavy.groupBy("seed").agg(F.min(F.struct("doc", "at")).alias("lo")), "firsts"))
    names = [f.name for f in arrow_schema(MET)]
    to_first = heavy.where("open").join(firsts, "seed").where("doc > lo.doc").select("seed", F.col("doc").alias("late"), F.col("lo.doc").alias("early"), F.col("at").alias("at_late"), F.col("lo.at").alias("at_early"), "span").select(*names)
    wanted = arrow_schema(MET)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] = []  # the last seed's first row
        for b in batches:
            own = [c.to_numpy(zero_copy_only=False) for c in b.columns]
            old = kept[0].size if kept else 0
            seed, doc, at, span, is_open = own = [np.concatenate(x) for x in zip(kept, own, strict=True)] if kept else own
            if not seed.size:
                continue
            place = np.arange(seed.size)
            starts = np.append(True, seed[1:] != seed[:-1])
            first = np.maximum.accumulate(np.where(starts, place, 0))
            late = np.flatnonzero(is_open & (doc > doc[first]) & (place >= old))
            if late.size:
                early = first[late]
                columns = seed[late], doc[late], doc[early], at[late], at[early], span[late]
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, wanted, strict=True)], schema=wanted)
            kept = [c[first[-1:]] for c in own]

    cold = found.join(hot, "seed", "left_anti").select("seed", "doc", "at", "span", "open")
    return to_first.unionByName(cold.repartition("seed").sortWithinPartitions("seed", "doc", "at").mapInArrow(run, MET))


def _spanning(at: np.ndarray, seed: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the runs of seeds that span so many words: the run's first and last seed, and a hash of its seeds and distances."""
    last = np.searchsorted(at, at + span)
    first = np.flatnonzero(last < at.size)
    last = last[first]
    h, j = np.zeros(first.size, np.uint64), first.copy()
    while (on := j <= last).any():
        own = j[on]
        x = (h[on] * _MIX) ^ seed[own].view(np.uint64) ^ ((at[own] - at[first[on]]).astype(np.uint64) * _MIX)
        h[on] = x ^ (x >> np.uint64(29))
        j[on] += 1
    return first, last, (h * _MIX).view(np.int64)


def _apart(key: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Places of the occurrences that don't overlap the last one kept of their key: a text that goes round and round has few."""
    order = np.lexsort((at, key))
    if not (again := key[order][1:] == key[order][:-1]).any():
        return order
    kept, last = [], 0
    for i, same in zip(order.tolist(), [False, *again.tolist()], strict=True):
        if not same or at[i] >= last:
            kept.append(i)
            last = at[i] + size[i]
    return np.array(kept)


def longer(shared: DataFrame, explained: DataFrame) -> DataFrame:
    """HELD rows of runs of seeds; open if a word that no repeat explains is in reach. shared: (seed, doc, at); explained: REPEAT rows."""
    wanted = arrow_schema(HELD)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc, held, spans in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True):
                flat = held.values
                at, seed = flat.field("at").to_numpy(), flat.field("seed").to_numpy()
                bare = np.ones(int(at[-1]) + K + WINDOW, np.int64)
                for s in spans or ():
                    bare[s["start_word"] : s["end_word"]] = 0
                bare = np.append(0, np.cumsum(bare))  # a repeat's outermost seeds are less than WINDOW from its ends
                for span in SPANS:
                    first, last, key = _spanning(at, seed, span)
                    own = at[last] - at[first] <= span + BREAK + K + 2 * WINDOW  # a repeat's matches lie closer, and each run of WINDOW of them has a seed
                    first, last, key = first[own], last[own], key[own]
                    own = _apart(key, at[first], at[last] - at[first] + K)
                    first, last, key = first[own], last[own], key[own]
                    out.append((key, np.full(first.size, doc), at[first], at[last] - at[first], bare[at[last] + K + WINDOW] > bare[np.maximum(0, at[first] - WINDOW)]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), f.type) for x, f in zip(zip(*out, strict=True), wanted, strict=True)], schema=wanted)

    spans = explained.groupBy("doc").agg(F.collect_set(F.struct("start_word", "end_word")).alias("spans"))
    return shared.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("at", "seed"))).alias("held")).join(spans, "doc", "left").select("doc", "held", "spans").mapInArrow(run, HELD)


class PrefixMaxima:
    """Fenwick tree: the largest (value, item) put at a place before another."""

    def __init__(self, n: int):
        self.best: list[tuple[float, int]] = [(-np.inf, -1)] * (n + 1)

    def put(self, place: int, item: tuple[float, int]) -> None:
        i = place + 1
        while i < len(self.best):
            if item > self.best[i]:
                self.best[i] = item
            i += i & -i

    def before(self, place: int) -> tuple[float, int]:
        found, i = (-np.inf, -1), place
        while i > 0:
            found = max(found, self.best[i])
            i -= i & -i
        return found


def chains(x: np.ndarray, y: np.ndarray, weight: float = K, gap: float = GAP) -> list[np.ndarray]:
    """Positions of the matches (x, y) in each chain, ascending in both; every match is in one chain at most. Input by x, then y."""
    if (x[0] - y[0] == x - y).all():  # one diagonal: no choice but where to break
        return np.split(np.arange(x.size), np.flatnonzero(2 * gap * np.diff(x) >= weight) + 1)
    rank = np.unique(y, return_inverse=True)[1].tolist()
    tree = PrefixMaxima(max(rank) + 1)
    score, back = [0.0] * x.size, [-1] * x.size
    cost = (gap * (x + y)).tolist()
    bounds = _starts([x], 1).tolist() + [x.size]
    for s, e in zip(bounds, bounds[1:], strict=False):  # matches with one x can't follow each other
        for i in range(s, e):
            value, j = tree.before(rank[i])
            if value - cost[i] > 0:
                score[i], back[i] = weight + value - cost[i], j
            else:
                score[i] = weight
        for i in range(s, e):
            tree.put(rank[i], (score[i] + cost[i], i))
    used, out = [False] * x.size, []
    for i in sorted(range(x.size), key=lambda i: (-score[i], i)):
        own = []
        while i >= 0 and not used[i]:
            used[i] = True
            own.append(i)
            i = back[i]
        if own:
            out.append(np.array(own[::-1]))
    return out


def chained(pairs: DataFrame, min_words: int) -> DataFrame:
    """CHAIN rows: padded passages that may hold a repeat of min_words words."""
    wanted = arrow_schema(CHAIN)
    pad = WINDOW + K

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in _runs(batches, 2):
            once = _starts(columns, 4)
            late, early, x, y = columns = [c[once] for c in columns]
            start = _starts(columns, 2)
            rows = []
            for s, e in zip(start.tolist(), np.append(start[1:], late.size).tolist(), strict=True):
                if e - s < 2:
                    continue
                for own in chains(x[s:e].astype(np.int64), y[s:e].astype(np.int64)):
                    a, b = s + own[0], s + own[-1]
                    if own.size > 1 and min(x[b] - x[a], y[b] - y[a]) + K + 2 * pad >= min_words:
                        rows.append((late[s], early[s], max(0, x[a] - pad), x[b] + K + pad, max(0, y[a] - pad), y[b] + K + pad))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(wanted)], schema=wanted)

    # A key of several seeds matches at its last one too.
    ends = pairs.where("span > 0").select("late", "early", (F.col("at_late") + F.col("span")).alias("at_late"), (F.col("at_early") + F.col("span")).alias("at_early"))
    both = pairs.select("late", "early", "at_late", "at_early").unionByName(ends)
    return both.repartition("late", "early").sortWithinPartitions("late", "early", "at_late", "at_early").mapInArrow(run, CHAIN)


def _filled(ka: np.ndarray, kb: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The chain with the matches on its diagonals put in, before, between and after its own; one path, ascending."""
    xs, ys = [], []

    def diagonal(x0: int, y0: int, n: int) -> None:
        same = np.flatnonzero(ka[x0 : x0 + n] == kb[y0 : y0 + n])
        xs.append(x0 + same)
        ys.append(y0 + same)

    before = min(int(x[0]), int(y[0]))
    diagonal(int(x[0]) - before, int(y[0]) - before, before)
    straight = np.diff(x) == np.diff(y)
    cuts = np.append(np.flatnonzero(~straight), x.size - 1)
    s = 0
    for e in cuts.tolist():  # from match s to match e along one diagonal
        diagonal(int(x[s]), int(y[s]), int(x[e] - x[s]) + 1)
        s = e + 1
    diagonal(int(x[-1]) + 1, int(y[-1]) + 1, min(ka.size - int(x[-1]), kb.size - int(y[-1])) - 1)
    return np.concatenate(xs), np.concatenate(ys)


def aligned(a: np.ndarray, b: np.ndarray, min_words: int, similarity: float) -> list[tuple[int, int, int, int, float]]:
    """(from, to, from, to, similarity) of the repeats in two passages of word hashes.

    A stretch whose k-mers agree too little is cut at its longest gap, and its sides are tried in turn; what
    is left at last are runs of equal words.
    """
    ka, kb = kmers(a), kmers(b)
    _, x, y = np.intersect1d(ka, kb, return_indices=True)
    if not x.size:
        return []
    order = np.argsort(x)
    x, y = x[order], y[order]
    out = []
    for own in chains(x, y, weight=1.0, gap=0.5 / BREAK):
        cx, cy = _filled(ka, kb, x[own], y[own])
        skipped = np.maximum(np.diff(cx), np.diff(cy)) - 1
        todo = [(0, cx.size)]
        while todo:
            lo, hi = todo.pop()
            n, m = int(cx[hi - 1] - cx[lo]) + 1, int(cy[hi - 1] - cy[lo]) + 1  # k-mers on either side
            if min(n, m) + K - 1 < min_words:
                continue
            jaccard = (hi - lo) / (n + m - (hi - lo))
            if jaccard >= similarity and skipped[lo : hi - 1].max(initial=0) <= BREAK + K:
                out.append((int(cx[lo]), int(cx[lo]) + n + K - 1, int(cy[lo]), int(cy[lo]) + m + K - 1, jaccard))
            else:
                at = lo + int(skipped[lo : hi - 1].argmax()) + 1
                todo += [(lo, at), (at, hi)]
    return out


def _passages(texts: DataFrame, asked: DataFrame) -> DataFrame:
    """(doc, start, stop, words): the word hashes of asked (doc, start, stop)."""
    schema = "doc long, start int, stop int, words binary"
    wanted = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in batches:
            rows = []
            for doc, text, spans in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True):
                words = hashes.of(text.as_py())
                rows += [(doc, s["start"], s["stop"], words[s["start"] : s["stop"]].tobytes()) for s in spans]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(wanted)], schema=wanted)

    spans = asked.distinct().groupBy("doc").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    return texts.join(spans, "doc").select("doc", "text", "spans").mapInArrow(run, schema)


def _verified(texts: DataFrame, candidates: DataFrame, min_words: int, similarity: float) -> DataFrame:
    """REPEAT rows of CHAIN rows."""
    ends = [candidates.select(F.col(x).alias("doc"), F.col(f"{x}_from").alias("start"), F.col(f"{x}_to").alias("stop")) for x in ("late", "early")]
    words = cut(_passages(texts, ends[0].unionByName(ends[1])), "passages")
    both = candidates
    for x in ("late", "early"):
        own = words.select(F.col("doc").alias(x), F.col("start").alias(f"{x}_from"), F.col("stop").alias(f"{x}_to"), F.col("words").alias(f"{x}_words"))
        both = both.join(own, [x, f"{x}_from", f"{x}_to"])
    wanted = arrow_schema(REPEAT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for late, early, x, y, a, c in zip(*(col.to_pylist() if k < 4 else col for k, col in enumerate(b.columns)), strict=True):
                p, q = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(c.as_buffer(), np.uint64)
                rows += [(late, x + s, x + e, early, y + t, y + f, j) for s, e, t, f, j in aligned(p, q, min_words, similarity)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(wanted)], schema=wanted)

    return both.select("late", "early", "late_from", "early_from", "late_words", "early_words").mapInArrow(run, REPEAT).distinct()


def _repeats(texts: DataFrame, min_words: int, similarity: float) -> DataFrame:
    """REPEAT rows of (doc, text)."""
    found = cut(seeds(texts, min_words), "seeds")
    met = cut(matches(found.select("seed", "doc", "at", F.lit(0).alias("span"), F.lit(True).alias("open"))), "met")
    chains_ = cut(chained(met, min_words).distinct(), "chains")
    known = cut(_verified(texts, chains_, min_words, similarity), "known")
    shared = met.select("seed", F.col("late").alias("doc"), F.col("at_late").alias("at")).unionByName(met.select("seed", F.col("early").alias("doc"), F.col("at_early").alias("at"))).distinct()
    left = chained(matches(cut(longer(shared, known), "longer")), min_words)
    more = cut(left.join(chains_, chains_.columns, "left_anti").distinct(), "more_chains")
    return known.unionByName(_verified(texts, more, min_words, similarity)).distinct()


def repeats(docs: DataFrame, min_words: int = MIN_WORDS, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, start_word, end_word, match_id, match_start, match_end, similarity: words of doc_id that repeat words of match_id, an earlier document."""
    texts, names = numbered(docs, id_col, text_col)
    found = _repeats(texts, min_words, similarity)
    kind = docs.schema[id_col].dataType
    if names is None:
        late, early = F.col("doc").cast(kind), F.col("match").cast(kind)
    else:
        found = cut(found, "repeats").join(names.select("doc", F.col("id").alias("late")), "doc").join(names.select(F.col("doc").alias("match"), F.col("id").alias("early")), "match")
        late, early = F.col("late"), F.col("early")
    return found.select(late.alias("doc_id"), "start_word", "end_word", early.alias("match_id"), "match_start", "match_end", "similarity")


def remove_repeats(docs: DataFrame, min_words: int = MIN_WORDS, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the repeats taken out of later documents' texts; documents of which nothing is left go."""
    other, own, held = unused(docs, "_id"), unused(docs, "_mark"), unused(docs, "_spans")
    texts, names = numbered(docs, id_col, text_col)
    gone = _repeats(texts, min_words, similarity).groupBy("doc").agg(F.collect_set(F.struct("start_word", "end_word")).alias(held))
    if names is None:
        joined = docs.join(gone.withColumnRenamed("doc", other), F.col(id_col).cast("long") == F.col(other), "left").drop(other)
    else:
        named = gone.join(names, "doc").select(F.col("id").alias(other), F.col("mark").alias(own), held)
        joined = docs.join(named, (F.col(id_col) == F.col(other)) & (F.sha2(text_of(text_col), 256) == F.col(own)), "left").drop(other, own)
    wanted = arrow_schema(docs.schema)
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, kept = [], []
            for text, spans in zip(b.column(place).to_pylist(), b.column(b.num_columns - 1).to_pylist(), strict=True):
                left = text if spans is None else without(text or "", [(s["start_word"], s["end_word"]) for s in spans])
                kept.append(spans is None or bool(left.strip()))
                texts.append(left)
            columns = [pa.array(texts, f.type) if k == place else b.column(k).cast(f.type) for k, f in enumerate(wanted)]
            yield pa.RecordBatch.from_arrays(columns, schema=wanted).filter(pa.array(kept))

    return joined.mapInArrow(run, docs.schema)


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """text without the words of the spans and the white space after them."""
    starts = [m.start() for m in _word.finditer(text)] + [len(text)]
    out, at = [], 0
    for s, e in sorted(spans):
        if s > at:
            out.append(text[starts[at] if at else 0 : starts[s]])
        at = max(at, e)
    out.append(text[starts[min(at, len(starts) - 1)] :])
    return "".join(out)
