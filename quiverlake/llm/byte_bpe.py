"""Byte-level BPE: ranked merges folded by higher-order functions over distinct words, and decoding.

The commonest distinct words (pre-tokens) of the corpus are counted by Spark and encoded there:
``merged`` folds over the byte array of a word, each step merging the pair of lowest rank, with the ranks
in a literal array of small maps, so that a lookup is a hash and a short scan. The result, at most
``table_size`` short words, is broadcast. Documents are encoded in one map-side pass: a worker takes a text
apart at single spaces (where the pattern always cuts), keeps what it has encoded, and finds words in the
broadcast table. Words that are not in it (rare ones) get the same ranked merges in the worker; carrying
them to Spark and back would shuffle most of the corpus's rare words with their documents twice.

Decoding concatenates the binary pieces of the ids.

Defined results: null text is empty (no ids); rows keep their id, whatever it is; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import base64
import json
import re
import struct
import unicodedata
import zlib
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import arrow_schema, cut, most_frequent, text_of

TABLE_SIZE = 1 << 17  # words in the broadcast table
LONGEST = 48  # characters of a word that is folded or kept
SHARDS = 8192  # small maps of the rank literal
CACHED = 200_000  # parts in a worker's cache

#: The characters with the White_Space property.
SPACES = "\\u0009-\\u000d\\u0020\\u0085\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_inner = re.compile(r"\s \s")


def _same_kind() -> str:
    """The characters, as a class, in which every Unicode version sees the same: assigned since 3.2, of one kind ever since."""

    def kind(of: str) -> str:
        return of[0] if of[0] in "LNZ" else "other"

    def same(c: str) -> bool:
        was, now = unicodedata.ucd_3_2_0.category(c), unicodedata.category(c)
        return was not in ("Cn", "Cs", "Cc") and kind(was) == kind(now)

    return "\t-\r" + "".join(re.escape(c) for c in map(chr, range(1 << 16)) if same(c))


#: Words that are matched here; others are left to the library whole.
_plain = re.compile(f"[{_same_kind()}]*")


def spelled(pattern: str) -> str:
    """The pattern with white space spelled out, the same for every regular expression library."""
    return pattern.replace("[^\\s", f"[^{SPACES}").replace("\\S", f"[^{SPACES}]").replace("\\s", f"[{SPACES}]")


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def rank_literal(ranks: dict[bytes, int]) -> Column:
    """array<map<hex, rank>>: a piece's map is at the CRC-32 of its hex digits, modulo SHARDS."""
    shards: list[dict[str, int]] = [{} for _ in range(SHARDS)]
    for piece, rank in ranks.items():
        name = piece.hex().upper()
        shards[zlib.crc32(name.encode()) % SHARDS][name] = rank
    return F.from_json(F.lit(json.dumps(shards)), "array<map<string,int>>")  # constant-folded


def merged(word: Column, ranks: Column) -> Column:
    """The ids of a word: its bytes, with the pair of lowest rank merged for as long as there is one."""

    def rank(piece: Column) -> Column:
        return F.try_element_at(F.element_at(ranks, (F.crc32(piece.cast("binary")) % SHARDS + 1).cast("int")), piece)

    def step(pieces: Column) -> Column:
        pairs = F.transform(F.slice(pieces, 2, F.size(pieces)), lambda right, i: F.struct(rank(F.concat(F.element_at(pieces, i + 1), right)).alias("rank"), i.alias("i")))
        best = F.array_min(F.filter(pairs, lambda x: x["rank"].isNotNull()))

        def take(b: Column) -> Column:
            both = F.concat(F.element_at(pieces, b["i"] + 1), F.element_at(pieces, b["i"] + 2))
            return F.when(b.isNull(), pieces).otherwise(F.concat(F.slice(pieces, F.lit(1), b["i"]), F.array(both), F.slice(pieces, b["i"] + 3, F.size(pieces))))

        return F.element_at(F.transform(F.array(best), take), 1)

    single = F.regexp_extract_all(F.hex(word.cast("binary")), F.lit("(..)"), F.lit(1))
    steps = F.sequence(F.lit(1), F.greatest(F.lit(1), F.octet_length(word) - 1))
    return F.transform(F.aggregate(steps, single, lambda pieces, _: F.when(F.size(pieces) > 1, step(pieces)).otherwise(pieces)), rank)


def common_words(docs: DataFrame, pattern: str, text_col: str = "text", table_size: int = TABLE_SIZE) -> DataFrame:
    """The most frequent pre-tokens of all texts, ``table_size`` at most (partial counts before the shuffle)."""
    words = docs.select(F.explode(F.regexp_extract_all(text_of(text_col), F.lit(f"({spelled(pattern)})"), F.lit(1))).alias("word"))
    counted = words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where((F.col("n") > 1) & (F.char_length("word") <= LONGEST))
    return most_frequent(cut(counted, "counted"), "word", table_size)


class Encoder(dict):
    """Ids of the parts between spaces, as little-endian unsigned 32-bit integers; a part stands for a space and itself."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, table: dict[str, bytes]):
        super().__init__()
        import tiktoken

        self.table, self.find = table, regex.compile(spelled(pattern)).findall
        self.library = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.merge = self.library._core_bpe.encode_single_piece

    def words(self, text: str) -> bytes:
        if not _plain.fullmatch(text):
            ids = self.library.encode_ordinary(text)
            return struct.pack(f"<{len(ids)}I", *ids)
        return b"".join([self.table.get(w) or self._rare(w) for w in self.find(text)])

    def _rare(self, word: str) -> bytes:
        ids = self.merge(word.encode())
        return struct.pack(f"<{len(ids)}I", *ids)

    def __missing__(self, part: str) -> bytes:
        if len(self) > CACHED:
            self.clear()
        made = self.words(f" {part}")
        if len(part) <= LONGEST:
            self[part] = made
        return made

    def encode(self, text: str) -> bytes:
        if not text or _inner.search(text):
            return self.words(text)
        first, *parts = text.split(" ")
        return b"".join([self.words(first), *map(self.__getitem__, parts)])


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", table_size: int = TABLE_SIZE) -> DataFrame:
    """(doc_id, ids): ids as little-endian unsigned 32-bit integers in one binary."""
    ranks = read_ranks(ranks_path)
    # Not spread over more tasks by itself: few rows, but each is a long fold.
    words = cut(common_words(docs, pattern, text_col, table_size).repartition(64, "word"), "words")
    table = cut(words.select("word", merged(F.col("word"), rank_literal(ranks)).alias("ids")), "encoded")
    known = {r.word: struct.pack(f"<{len(r.ids)}I", *r.ids) for r in table.toLocalIterator()}  # at most table_size short words
    shared = docs.sparkSession.sparkContext.broadcast((ranks, known))
    schema = f"doc_id {docs.schema[id_col].dataType.simpleString()}, ids binary"
    wanted = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value[0], pattern, shared.value[1])
        for b in batches:
            for i in range(0, b.num_rows, 512):  # ids may take more room than text
                part = b.slice(i, 512)
                yield pa.RecordBatch.from_arrays([part.column(0).cast(wanted[0].type), pa.array([encoder.encode(t.as_py()) for t in part.column(1)], pa.binary())], schema=wanted)

    return docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text")).mapInArrow(run, schema)


def decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """(doc_id, ids, decoded) from (doc_id, ids): the concatenated binary pieces of the ids."""
    ranks = read_ranks(ranks_path)
    shared = encoded.sparkSession.sparkContext.broadcast([p for p, _ in sorted(ranks.items(), key=lambda x: x[1])])
    schema = f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, ids binary, decoded binary"
    wanted = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece = shared.value.__getitem__
        for b in batches:
            made = [b"".join(map(piece, memoryview(x.as_buffer()).cast("I"))) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(wanted[0].type), b.column(1), pa.array(made, pa.binary())], schema=wanted)

    return encoded.mapInArrow(run, schema)


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, **columns: str) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    both = decode(encode(docs, ranks_path, pattern, **columns), ranks_path)
    return both.select("doc_id", F.expr("cast(octet_length(ids) div 4 as long)").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
