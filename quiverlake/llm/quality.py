"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

A text is a sparse vector: its words hashed into ``WORDS`` buckets (log counts, unit length), one cell for
the bin of each structure statistic, and one for the bin of its length as the table tells it (``n_chars``).
The score is the logistic of w0 + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j, with the pairwise part taken
in linear time as half of sum_f ((sum_i v_if x_i)^2 - sum_i (v_if x_i)^2).

The machine is fitted on the driver, on at most ``max_examples`` labelled rows (those first by a hash of
their id) outside the held-out remainder; scoring is one pass over the documents, with the model broadcast.

Defined results: null text is empty and has a score; rows whose label is null teach nothing; without labels
of both kinds every score is the share of label 1 (0.5 without any); several labels of one id all count;
repeated rows are scored alike; a null or missing ``n_chars`` counts as the text's own length; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import arrow_schema, held_out, text_of

MAX_EXAMPLES = 8000  # labelled rows that the machine is fitted on
WORDS = 1 << 12  # buckets of words
BINS = 10  # of each statistic
RANK = 8  # of the interactions
CACHED = 100_000  # words in a worker's cache

_CLASSES = ["upper", "lower", "digit", "blank", "exclaim", "symbol", "bar", "stop", "other", "wide"]
_STATS = [*_CLASSES, "repeated_next", "distinct", "commonest", "repeated_lines", "line_length", "word_length", "words", "n_chars"]


def _classes() -> np.ndarray:
    of = np.zeros((256, len(_CLASSES)), np.float64)
    for b in range(256):
        c = chr(b)
        k = 9 if b > 127 else 0 if c.isupper() else 1 if c.islower() else 2 if c.isdigit() else 3 if c.isspace() else 4 if c in "!?" else 5 if c in "#$%&*+=@^~<>\\_" else 6 if c in "|/" else 7 if c in ".,;:'\"()-" else 8
        of[b, k] = 1
    return of


_CLASS_OF = _classes()
SIZE = WORDS + len(_STATS) * BINS


class Hashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > CACHED:
            self.clear()
        self[word] = h = zlib.crc32(word.lower().encode("utf-8", "surrogatepass"))
        return h


def _share_bin(x: float) -> int:
    """0 for none, else by halves: BINS - 1 for a half or more."""
    return 0 if x <= 0 else max(1, min(BINS - 1, BINS + math.floor(math.log2(x))))


def _size_bin(x: float, step: float) -> int:
    return min(BINS - 1, int(math.log2(1 + x) / step))


def features(text: str, n_chars: int | None, hashes: Hashes) -> tuple[np.ndarray, np.ndarray]:
    """Cells, ascending, and values of the text's vector."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    shares = np.bincount(raw, minlength=256) @ _CLASS_OF / max(1, raw.size)
    words = text.split()
    h = np.fromiter(map(hashes.__getitem__, words), np.int64, len(words))
    counts = np.unique(h, return_counts=True)[1]
    lines = text.split("\n")
    n = max(1, h.size)
    bins = [_share_bin(x) for x in shares]
    bins += [_share_bin(np.count_nonzero(h[1:] == h[:-1]) / n), _share_bin(counts.size / n), _share_bin(counts.max(initial=0) / n)]
    bins += [_share_bin(1 - len(set(lines)) / len(lines)), _size_bin(len(text) / len(lines), 1.3), _size_bin(sum(map(len, words)) / n, 0.7), _size_bin(h.size, 1.7)]
    bins.append(_size_bin(len(text) if n_chars is None or n_chars < 0 else n_chars, 2))
    cells, per = np.unique(h % WORDS, return_counts=True)
    value = np.log1p(per)
    value /= np.linalg.norm(value) or 1
    return np.concatenate([cells, WORDS + BINS * np.arange(len(_STATS)) + bins]), np.concatenate([value, np.ones(len(_STATS))])


class Machine:
    """w0, w, v; fitted by AdaGrad on the logistic loss."""

    def __init__(self, w0: float, w: np.ndarray, v: np.ndarray):
        self.w0, self.w, self.v = w0, w, v

    def score(self, cells: np.ndarray, values: np.ndarray) -> float:
        xv = self.v[cells] * values[:, None]
        z = self.w0 + self.w[cells] @ values + 0.5 * float((xv.sum(0) ** 2).sum() - (xv**2).sum())
        return 1 / (1 + math.exp(-max(-35.0, min(35.0, z))))


def fit(vectors: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = 8, batch: int = 128, rate: float = 0.08, decay: float = 1e-4, seed: int = 7) -> Machine:
    share = float(labels.mean()) if labels.size else 0.5
    rng = np.random.default_rng(seed)
    w, v = np.zeros(SIZE), rng.normal(0, 0.02, (SIZE, RANK))
    if not 0 < share < 1:
        return Machine(0.0 if not labels.size else 6.0 * (2 * share - 1), w, np.zeros_like(v))
    w0, g0, gw, gv = math.log(share / (1 - share)), 1e-6, np.full(SIZE, 1e-6), np.full((SIZE, RANK), 1e-6)
    for _ in range(epochs):
        order = rng.permutation(labels.size)
        for s in range(0, labels.size, batch):
            own = order[s : s + batch]
            sizes = np.array([vectors[i][0].size for i in own])
            cells, x = np.concatenate([vectors[i][0] for i in own]), np.concatenate([vectors[i][1] for i in own])
            starts = np.cumsum(sizes) - sizes
            xv = v[cells] * x[:, None]
            sums = np.add.reduceat(xv, starts)
            z = w0 + np.add.reduceat(w[cells] * x, starts) + 0.5 * ((sums**2).sum(1) - np.add.reduceat((xv**2).sum(1), starts))
            d = (1 / (1 + np.exp(-np.clip(z, -35, 35))) - labels[own]) / own.size
            dx = np.repeat(d, sizes) * x
            grad = np.bincount(cells, dx, SIZE) + decay * w
            inner = np.repeat(sums, sizes, 0) - xv
            grads = np.stack([np.bincount(cells, dx * inner[:, f], SIZE) for f in range(RANK)], 1) + decay * v
            g0 += d.sum() ** 2
            gw += grad**2
            gv += grads**2
            w0 -= rate * d.sum() / math.sqrt(g0)
            w -= rate * grad / np.sqrt(gw)
            v -= rate * grads / np.sqrt(gv)
    return Machine(w0, w, v)


def _vectors(docs: DataFrame, label: str) -> DataFrame:
    schema = f"{label} int, _order long, cells array<int>, vals array<float>"
    wanted = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for b in batches:
            made = [features(t, n, hashes) for t, n in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([c.astype(np.int32) for c, _ in made], wanted[2].type), pa.array([v.astype(np.float32) for _, v in made], wanted[3].type)], schema=wanted)

    return docs.select(label, F.xxhash64("_id").alias("_order"), "_text", "_n").mapInArrow(run, schema)


def examples(docs: DataFrame, labels: DataFrame, label: str, out: tuple[int, int], most: int, id_col: str = "doc_id") -> DataFrame:
    """Labelled rows of docs to learn from, at most ``most``: _id, _label (0 or 1) and docs' other columns. out: modulus and held-out remainder.

    docs: the id, and columns other than _id and _label. Of rows with one id that with the smallest hash teaches.
    """
    known = labels.select(F.col(id_col).alias("_id"), F.col(label).cast("int").alias("_label")).where(F.col("_label").isin(0, 1) & F.col("_id").isNotNull() & ~held_out(F.col("_id"), *out))
    chosen = known.orderBy(F.xxhash64("_id"), "_id", "_label").limit(most)  # at most ``most`` pairs of numbers
    rest = [c for c in docs.columns if c != id_col]
    least = F.min(F.struct(F.xxhash64(*rest).alias("_hash"), *rest)).alias("_row")
    return docs.join(F.broadcast(chosen), docs[id_col] == F.col("_id")).groupBy("_id", "_label").agg(least).select("_id", "_label", *(F.col(f"_row.{c}") for c in rest))


def quality(docs: DataFrame, labels: DataFrame, label: str = "quality", out: tuple[int, int] = (4, 2), threshold: float = 0.7, max_examples: int = MAX_EXAMPLES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    length = F.col("n_chars").cast("long") if "n_chars" in docs.columns else F.lit(None).cast("long")
    mine = docs.select(F.col(id_col), text_of(text_col).alias("_text"), length.alias("_n"))
    taught = examples(mine, labels, label, out, max_examples, id_col).select("_id", "_label", "_text", "_n")
    # Bounded: max_examples sparse vectors, in an order that owes nothing to partitions.
    rows = _vectors(taught, "_label").collect()
    rows.sort(key=lambda r: (r._order, r._label, r.cells, r.vals))
    machine = fit([(np.asarray(r.cells, np.int64), np.asarray(r.vals, np.float64)) for r in rows], np.array([r._label for r in rows], np.float64))
    model = docs.sparkSession.sparkContext.broadcast((machine.w0, machine.w.astype(np.float32), machine.v.astype(np.float32)))
    schema = f"doc_id {docs.schema[id_col].dataType.simpleString()}, score double"
    wanted = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, hashes = Machine(*model.value), Hashes()
        for b in batches:
            scores = [own.score(*features(t, n, hashes)) for t, n in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(wanted[0].type), pa.array(scores, pa.float64())], schema=wanted)

    scored = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"), length.alias("n")).mapInArrow(run, schema)
    return scored.select("doc_id", held_out(F.col("doc_id"), *out).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
