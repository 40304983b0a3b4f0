"""Ids of a word-level BPE tokenizer (lower case, white space dropped, end-of-word pieces), by cached words.

White space never joins words and normalisation never crosses a space, so a text's ids are those of its
space-separated parts in order. A part's ids come from the worker's cache, else from the library; parts of
Latin letters, where pre-tokenization is plain, are merged by a rank table of the same vocabulary, with the
end of a word as a byte that UTF-8 never uses. Texts that may hold a special token are encoded whole.
"""

from __future__ import annotations

import functools
import json
import os
import re
import struct
import unicodedata

import regex

CACHED = 24 << 20  # bytes of parts and ids in a worker's cache, and as much again for the table that holds them
ENTRY = 200  # bytes that an entry takes beside its characters and ids
LONGEST = 64  # characters of a part that is kept
END = b"\xff"

#: The tokenizer's pre-token pattern.
_pattern = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: What the rank table is used for: ASCII but its control characters, and Latin-1 and Latin Extended-A letters.
_plain = re.compile("[!-~¿-įĲ-ž]*")


def unit_bytes() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones themselves, others from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class WordIds(dict):
    """Ids of parts as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, special: tuple[str, ...] = ("<|",)):
        super().__init__()
        self.room = CACHED
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.library, self.special = Tokenizer.from_file(path), special
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        byte_of, end = unit_bytes(), "</w>"
        ranks = {bytes(byte_of[c] for c in k.removesuffix(end)) + END * k.endswith(end): i for k, i in vocabulary.items()}
        self.merge = tiktoken.Encoding("words", pat_str=".", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece

    def whole(self, text: str) -> bytes:
        ids = self.library.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def __missing__(self, part: str) -> bytes:
        if _plain.fullmatch(part) and unicodedata.is_normalized("NFC", part):
            ids = [i for w in _pattern.findall(part.lower()) for i in self.merge(w.encode() + END)]
            packed = struct.pack(f"<{len(ids)}I", *ids)
        else:
            packed = self.whole(part)
        if len(part) <= LONGEST:
            self.room -= ENTRY + len(part) + len(packed)
            if self.room < 0:
                self.forget()
            self[part] = packed
        return packed

    def forget(self) -> None:
        self.clear()
        self.room = CACHED

    def encode(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return self.whole(text)
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))


@functools.cache
def of_worker(path: str) -> WordIds:
    """One for all partitions that a worker process gets: the tokenizer is read once, and never held twice."""
    return WordIds(path)
