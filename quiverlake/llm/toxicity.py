"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over block-max inverted indexes.

Terms are lower-cased words and their first four, five and six letters, so that inflected forms meet. The
vocabulary is bounded by its size alone: the ``VOCABULARY`` terms that tell toxic examples best, by log-likelihood
ratio, common or rare. (All terms at once put the topic before the tone: see the README's figures.) The first
``INDEXED`` labelled examples are TF-IDF vectors over it, in an inverted index whose postings lie in blocks of
``BLOCK`` examples, each with the largest weight per term; a search takes blocks by their upper bound and stops
once no block can hold a nearer example, so the ``k`` nearest are exact. Neighbours vote with their cosine, and
the vote is calibrated (isotonic) on the examples' own leave-one-out votes. Texts that share no term with
any example get the examples' rate of label 1 among such texts. Evidence is the nearest examples.

The examples are at most ``max_examples`` labelled rows (first by a hash of their id) outside the held-out
remainder; equal texts among them count once, under their smallest id. Terms are counted over all of them.
Scoring is one pass with the index broadcast. Nothing depends on partitions.

Defined results: null text is empty and has a score; rows whose label is null teach nothing; without labels
of both kinds every score is the share of label 1 (0 without any); ties among neighbours go to the smaller
id; repeated rows are scored alike; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import arrow_schema, cut, held_out, text_of
from .quality import examples

MAX_EXAMPLES = 20_000  # labelled rows that terms are counted over
INDEXED = 4000  # of them that are neighbours, first by a hash of their id
VOCABULARY = 2048  # terms at most
LEAST_TOXIC = 3  # toxic examples that hold a term, at least: fewer say nothing
NEIGHBOURS = 16
BLOCK = 64
GATHERED = 4096  # rows of postings gathered at once, into the same 2 MB
CACHED = 150_000

_word = re.compile(r"\w+")


def terms_of(word: str) -> list[str]:
    return [word, *(f"{word[:n]}~" for n in (4, 5, 6) if len(word) >= n)]


def _stated(text: str) -> list[str]:
    return _word.findall(text.lower())


class TermNumbers(dict):
    """The vocabulary numbers of a space-separated part's terms, mostly none."""

    def __init__(self, number: dict[str, int]):
        super().__init__()
        self.number = number
        self.heads = {t[:4] for t in number}  # a word that starts like no term has none

    def __missing__(self, part: str) -> tuple[int, ...]:
        if len(self) > CACHED:
            self.clear()
        self[part] = got = tuple(self.number[t] for w in _word.findall(part) if w[:4] in self.heads for t in terms_of(w) if t in self.number)
        return got


def term_counts(examples_: DataFrame, only: set[str] | None, schema: str = "term string, n long") -> DataFrame:
    """Number of texts that hold each term."""
    wanted = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        names = sorted(only or ())
        parts = TermNumbers({t: i for i, t in enumerate(names)})
        for b in batches:
            for text in b.column(0).to_pylist():
                if only is None:
                    counts.update({t for w in set(_stated(text)) for t in terms_of(w)})
                else:
                    counts.update({t for got in map(parts.__getitem__, set(text.lower().split())) for t in got})
        if only is not None:
            counts = Counter({names[i]: n for i, n in counts.items()})
        yield pa.RecordBatch.from_arrays([pa.array(counts.keys(), wanted[0].type), pa.array(counts.values(), wanted[1].type)], schema=wanted)

    return examples_.select("text").mapInArrow(run, schema).groupBy("term").agg(F.sum("n").alias("n"))


def ratio(k1: int, n1: int, k0: int, n0: int) -> float:
    """Signed log-likelihood ratio: positive if the term is likelier in the first kind."""
    p = (k1 + k0) / (n1 + n0)

    def ll(k: int, n: int, q: float) -> float:
        return (k * math.log(q) if k else 0) + ((n - k) * math.log(1 - q) if n - k else 0)

    g = 2 * (ll(k1, n1, k1 / n1) + ll(k0, n0, k0 / n0) - ll(k1, n1, p) - ll(k0, n0, p))
    return g if k1 * n0 > k0 * n1 else -g


class Vectors:
    """Texts as unit TF-IDF vectors over the vocabulary: (term numbers ascending, weights)."""

    def __init__(self, idf: dict[str, float]):
        self.idf = np.array([idf[t] for t in sorted(idf)])
        self.parts = TermNumbers({t: i for i, t in enumerate(sorted(idf))})

    def of(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        counts = Counter(t for got in map(self.parts.__getitem__, text.lower().split()) if got for t in got)
        if not counts:
            return _NONE
        terms = np.array(sorted(counts), np.int64)
        weights = (1 + np.log([counts[t] for t in terms.tolist()])) * self.idf[terms]
        return terms, weights / np.linalg.norm(weights)


_NONE = np.empty(0, np.int64), np.empty(0)


class BlockMaxIndex:
    """Postings by term, in blocks of examples; exact k nearest by cosine."""

    def __init__(self, ids: list[int], labels: list[int], vectors: list[tuple[np.ndarray, np.ndarray]], n_terms: int):
        order = sorted(range(len(ids)), key=lambda i: (-1 if not vectors[i][0].size else int(vectors[i][0][vectors[i][1].argmax()]), ids[i]))
        self.ids, self.labels = np.array([ids[i] for i in order], np.int64), np.array([labels[i] for i in order], np.int64)
        self.blocks = -(-len(ids) // BLOCK)
        term = np.concatenate([vectors[i][0] for i in order] or [np.empty(0, np.int64)])
        weight = np.concatenate([vectors[i][1] for i in order] or [np.empty(0)])
        place = np.repeat(np.arange(len(order)), [vectors[i][0].size for i in order])
        cell = term * self.blocks + place // BLOCK
        held = np.unique(cell)
        #: A block of postings is a row of BLOCK weights, zero where an example lacks the term; row 0 stands for cells without postings.
        self.row = np.zeros((n_terms, self.blocks), np.int32)
        self.row.reshape(-1)[held] = np.arange(1, held.size + 1)
        self.cell, self.within, self.weight = self.row.reshape(-1)[cell], place % BLOCK, weight
        self.most = np.zeros((n_terms, self.blocks))
        np.maximum.at(self.most.reshape(-1), cell, weight)
        self._rows: np.ndarray | None = None
        self._room: np.ndarray | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_rows": None, "_room": None}  # postings travel as they are

    @property
    def rows(self) -> np.ndarray:
        """At most 8 * BLOCK bytes for each of terms x blocks: 66 MB with the bounds above, once in a worker."""
        if self._rows is None:
            self._rows = np.zeros((int(self.row.max(initial=0)) + 1, BLOCK))
            self._rows[self.cell, self.within] = self.weight
        return self._rows

    def _cosines(self, terms: np.ndarray, weights: np.ndarray, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in the blocks with a positive cosine, and the cosines, from the postings of these terms."""
        rows, sums, step = self.rows, np.empty((blocks.size, BLOCK)), max(1, GATHERED // terms.size)
        if self._room is None or len(self._room) < terms.size * step:
            self._room = np.empty((max(GATHERED, terms.size), BLOCK))
        for i in range(0, blocks.size, step):
            at = self.row[terms[:, None], blocks[i : i + step]]
            got = np.take(rows, at.reshape(-1), axis=0, out=self._room[: at.size], mode="clip")
            sums[i : i + step] = (weights @ got.reshape(terms.size, -1)).reshape(-1, BLOCK)
        sums = sums.reshape(-1)
        own = np.flatnonzero(sums)
        return blocks[own // BLOCK] * BLOCK + own % BLOCK, sums[own]

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int, but: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Places and cosines of the k nearest with a positive cosine, nearest first, ties to the smaller id.

        Blocks are taken by their bound, twice as many each time, until no bound reaches the k-th cosine.
        """
        if not terms.size or not self.blocks:
            return _NONE
        bound = weights @ self.most[terms]
        order = np.argsort(-bound, kind="stable")
        order = order[: np.count_nonzero(bound > 0)]
        places, cosines, least, done, step = *_NONE, 0.0, 0, 4
        while done < order.size:
            own = order[done : done + step]
            if places.size >= k:
                own = own[bound[own] >= least - 1e-12]
                if not own.size:
                    break
            done, step = done + step, 2 * step
            found, values = self._cosines(terms, weights, own)
            if but is not None:
                other = self.ids[found] != but
                found, values = found[other], values[other]
            places, cosines = np.concatenate([places, found]), np.concatenate([cosines, values])
            if cosines.size > k:  # what is farther than the k-th, beyond a tie, needs no sorting
                near = cosines >= np.partition(cosines, -k)[-k] - 1e-11
                places, cosines = places[near], cosines[near]
            top = np.lexsort((self.ids[places], -np.round(cosines, 12)))[:k]
            places, cosines = places[top], cosines[top]
            least = cosines[-1] if cosines.size else 0.0
        return places, cosines


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Steps of the non-decreasing fit: at x or above, the value; each pooled with one example of its opposite."""
    order = np.argsort(x, kind="stable")
    steps: list[list[float]] = []  # lowest x, sum, number
    for a, b in zip(x[order].tolist(), y[order].tolist(), strict=True):
        steps.append([a, b, 1])
        while len(steps) > 1 and (steps[-2][0] == steps[-1][0] or steps[-2][1] / steps[-2][2] >= steps[-1][1] / steps[-1][2]):
            _, s, n = steps.pop()
            steps[-1][1] += s
            steps[-1][2] += n
    return np.array([s[0] for s in steps]), np.array([(s[1] + 0.1) / (s[2] + 0.2) for s in steps])


class Voter:
    """The index, and what votes mean."""

    def __init__(self, vectors: Vectors, index: BlockMaxIndex, k: int, names: list):
        self.vectors, self.index, self.k, self.names = vectors, index, k, names
        self.none, self.at, self.value = 0.0, np.empty(0), np.empty(0)

    def vote(self, terms: np.ndarray, weights: np.ndarray, but: int | None = None) -> tuple[float | None, np.ndarray, np.ndarray]:
        places, cosines = self.index.nearest(terms, weights, self.k, but)
        return (float(cosines @ self.index.labels[places] / cosines.sum()) if places.size else None), places, cosines

    def calibrate(self, ids: list[int], labels: list[int], vectors: list[tuple[np.ndarray, np.ndarray]]) -> None:
        votes = [self.vote(*v, but=i)[0] for i, v in zip(ids, vectors, strict=True)]
        none = [y for v, y in zip(votes, labels, strict=True) if v is None]
        self.none = sum(none) / len(none) if none else sum(labels) / max(1, len(labels))
        some = [(v, y) for v, y in zip(votes, labels, strict=True) if v is not None]
        self.at, self.value = isotonic(np.array([v for v, _ in some]), np.array([float(y) for _, y in some])) if some else (np.empty(0), np.empty(0))

    def score(self, text: str) -> tuple[float, list[tuple]]:
        vote, places, cosines = self.vote(*self.vectors.of(text))
        if vote is None or not self.at.size:
            return self.none, []
        s = self.value[max(0, np.searchsorted(self.at, vote, "right") - 1)]
        return float(s), [(self.names[self.index.ids[p]], float(c), int(self.index.labels[p])) for p, c in zip(places, cosines, strict=True)]


def fit(taught: DataFrame, k: int = NEIGHBOURS) -> Voter:
    """taught: (id, _label, text), bounded."""
    taught = cut(taught.groupBy("text", "_label").agg(F.min("id").alias("id")).select("id", "_label", "text"), "examples")
    size = {r._label: r.n for r in taught.groupBy("_label").agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows
    n1, n0 = size.get(1, 0), size.get(0, 0)
    idf: dict[str, float] = {}
    if n1 and n0:
        # Bounded: the terms of at most max_examples texts, those of LEAST_TOXIC texts and more.
        toxic = {r.term: r.n for r in term_counts(taught.where("_label = 1"), None).where(F.col("n") >= LEAST_TOXIC).collect()}
        clean = {r.term: r.n for r in term_counts(taught.where("_label = 0"), set(toxic)).collect()}
        found = sorted(((ratio(n, n1, clean.get(t, 0), n0), t) for t, n in toxic.items()), key=lambda x: (-x[0], x[1]))
        idf = {t: math.log((n1 + n0 + 1) / (toxic[t] + clean.get(t, 0) + 1)) for g, t in found[:VOCABULARY] if g > 0}
    vectors = Vectors(idf)
    schema = f"id {taught.schema['id'].dataType.simpleString()}, _label int, terms array<int>, weights array<double>"
    wanted = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [vectors.of(t) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([t.astype(np.int32) for t, _ in made], wanted[2].type), pa.array([w for _, w in made], wanted[3].type)], schema=wanted)

    order = F.xxhash64("id")
    last = taught.select(order.alias("order")).orderBy("order").limit(INDEXED).agg(F.max("order")).first()[0]
    rows = taught.where(order <= F.lit(last)).mapInArrow(run, schema).collect()  # bounded: INDEXED short vectors
    rows.sort(key=lambda r: (r.id, r._label, r.terms, r.weights))
    ids, labels = list(range(len(rows))), [r._label for r in rows]  # numbered in the order of ids
    own = [(np.asarray(r.terms, np.int64), np.asarray(r.weights, np.float64)) for r in rows]
    voter = Voter(vectors, BlockMaxIndex(ids, labels, own, len(idf)), k, [r.id for r in rows])
    voter.calibrate(ids, labels, own)
    vectors.parts.clear()
    return voter


def _model(docs: DataFrame, labels: DataFrame, label: str, out: tuple[int, int], max_examples: int, k: int, id_col: str, text_col: str) -> Broadcast:
    mine = docs.select(F.col(id_col), text_of(text_col).alias("_text"))
    taught = examples(mine, labels, label, out, max_examples, id_col).select(F.col("_id").alias("id"), "_label", F.col("_text").alias("text"))
    return docs.sparkSession.sparkContext.broadcast(fit(taught, k))


def toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", out: tuple[int, int] = (3, 1), threshold: float = 0.7, max_examples: int = MAX_EXAMPLES, k: int = NEIGHBOURS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, held_out, score, predicted, evidence [(doc_id, cosine, label)], nearest first."""
    model = _model(docs, labels, label, out, max_examples, k, id_col, text_col)
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, score double, evidence array<struct<doc_id: {labels.schema[id_col].dataType.simpleString()}, cosine: double, label: int>>"
    wanted = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voter = model.value
        for b in batches:
            made = [voter.score(t) for t in b.column(1).to_pylist()]
            evidence = pa.array([[dict(zip(("doc_id", "cosine", "label"), e, strict=True)) for e in found] for _, found in made], wanted[2].type)
            yield pa.RecordBatch.from_arrays([b.column(0).cast(wanted[0].type), pa.array([s for s, _ in made], pa.float64()), evidence], schema=wanted)
        voter.vectors.parts.clear()

    scored = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text")).mapInArrow(run, schema)
    return scored.select("doc_id", held_out(F.col("doc_id"), *out).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "evidence")


def drop_toxic(docs: DataFrame, labels: DataFrame, label: str = "toxic", out: tuple[int, int] = (3, 1), threshold: float = 0.7, max_examples: int = MAX_EXAMPLES, k: int = NEIGHBOURS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, with all their columns, that score below the threshold; one pass, nothing is shuffled."""
    model = _model(docs, labels, label, out, max_examples, k, id_col, text_col)
    wanted, place = arrow_schema(docs.schema), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voter = model.value
        for b in batches:
            keep = [voter.score(t or "")[0] < threshold for t in b.column(place).to_pylist()]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(b.columns, wanted, strict=True)], schema=wanted).filter(pa.array(keep, pa.bool_()))
        voter.vectors.parts.clear()

    return docs.mapInArrow(run, docs.schema)
