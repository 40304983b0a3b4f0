"""Token counts by a two-tier map-side lookup.

The unit is a run of pre-tokens between single spaces (the pre-token pattern always cuts before a space
whose neighbours are not both white space, and texts where they are take the plain path). Every worker
counts the runs of its partitions and reports its most frequent ones; the sums of those reports give one
compact hash table of at most ``table_size`` runs and their token counts, which is broadcast. A second pass
looks every run up there, then in the worker's own bounded cache, and encodes only the misses with the
tokenizer library. No occurrence of a pre-token is shuffled, only the bounded reports.

The table and the caches decide speed, never the counts. Defined results: null text is empty (0 tokens);
rows keep their id, whatever it is; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import json
import os
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import arrow_schema, cut, most_frequent, text_of
from .word_ids import unit_bytes

TABLE_SIZE = 1 << 16  # runs in the broadcast table
REPORTED = 4096  # runs that a partition reports
LONGEST = 64  # characters of a run that is kept anywhere
CACHED = 500_000  # runs in a worker's cache
FOLD = 200_000  # runs counted at once in a worker

#: A space between two other white-space characters may stand inside one pre-token.
_inner = re.compile(r"\s \s")
#: The tokenizer's pre-token pattern, and characters that every Unicode version sees alike.
_pattern = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
_plain = re.compile("[\t\n\r -~¡-ɏ]*")


def splits_at_spaces(text: str, special: tuple[str, ...]) -> bool:
    return not _inner.search(text) and not any(s in text for s in special)


def frequent_runs(docs: DataFrame, text_col: str, table_size: int = TABLE_SIZE) -> list[str]:
    """The most frequent runs of all texts; first runs of texts, which have no space before them, don't count."""
    schema = "run string, n long"
    wanted = arrow_schema(schema)

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        for b in batches:
            for text in b.column(0):
                counts.update(text.as_py().split(" ")[1:])
                if len(counts) > FOLD:  # keeps memory bounded; only rare runs lose counts
                    counts = Counter(dict(counts.most_common(FOLD // 4)))
        rows = [(k, n) for k, n in counts.most_common(REPORTED) if n > 1 and len(k) <= LONGEST]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(wanted)], schema=wanted)

    found = docs.select(text_of(text_col).alias("text")).mapInArrow(report, schema).groupBy("run").agg(F.sum("n").alias("n"))
    return sorted(r.run for r in most_frequent(cut(found, "reports"), "run", table_size).toLocalIterator())  # at most table_size


class RunLengths(dict):
    """Token counts by run, for a space and the run; the frequent ones first, then what the worker has met.

    Runs of Latin letters and ASCII, where pre-tokenization is plain, are merged by the ranks of the
    tokenizer's own vocabulary; others go through the library, as do whole texts that don't split at spaces.
    """

    def __init__(self, path: str, known: dict[str, int], special: tuple[str, ...]):
        super().__init__(known)
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.library, self.base, self.special = Tokenizer.from_file(path), known, special
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            held = json.load(f)
        added = {x["content"] for x in held["added_tokens"]}
        byte_of = unit_bytes()
        ranks = {bytes(byte_of[c] for c in k): i for k, i in held["model"]["vocab"].items() if k not in added}
        self.merge = tiktoken.Encoding("runs", pat_str=".", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece

    def whole(self, text: str) -> int:
        return len(self.library.encode(text, add_special_tokens=False).ids)

    def _run(self, text: str) -> int:
        if not _plain.fullmatch(text):
            return self.whole(text)
        return sum(len(self.merge(w.encode())) for w in _pattern.findall(text))

    def __missing__(self, run: str) -> int:
        if len(self) > len(self.base) + CACHED:
            self.clear()
            self.update(self.base)
        n = self._run(f" {run}")
        if len(run) <= LONGEST:
            self[run] = n
        return n

    def count(self, text: str) -> int:
        if not text:
            return 0
        if not splits_at_spaces(text, self.special):
            return self.whole(text)
        first, *runs = text.split(" ")
        return self._run(first) + sum(map(self.__getitem__, runs))


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 512, special: tuple[str, ...] = ("<|",), id_col: str = "doc_id", text_col: str = "text", table_size: int = TABLE_SIZE) -> DataFrame:
    """Per document: doc_id, n_bytes, n_tokens, over_limit. tokenizer: path of a byte-level tokenizers file.

    special: no special string of the tokenizer lacks one of these; texts with one are encoded whole.
    """
    runs = frequent_runs(docs, text_col, table_size)
    own = RunLengths(tokenizer, {}, special)
    lengths = [own[x] for x in runs]
    known = docs.sparkSession.sparkContext.broadcast(dict(zip(runs, lengths, strict=True)))  # at most table_size short runs
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, n_bytes long, n_tokens long"
    wanted = arrow_schema(schema)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = RunLengths(tokenizer, known.value, special)
        for b in batches:
            n_bytes = pc.cast(pc.binary_length(b.column(1)), pa.int64())
            sizes = [held.count(x.as_py()) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(wanted[0].type), n_bytes, pa.array(sizes, pa.int64())], schema=wanted)

    counted = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text")).mapInArrow(count, schema)
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
