"""Byte-level BPE encoding and decoding by monoid tree reduction.

A text is halved down to leaves. An element is an open string, in which no cut is certain, or ``(head, ids, tail)``: the
open strings at both ends and the ids between. A cut is certain before white space that follows something else: no
pre-token spans it, none before it looks beyond it, and matching starts afresh there. Joining neighbours re-encodes the
window of the left tail and the right head, which grows over open elements until it ends at certain cuts; the ids
outside it can't change. A text between certain cuts is split into pre-tokens; a long one, of letters of any script, digits,
signs or blanks, is halved likewise as bytes and joined by re-encoding a growing window of ids, until each id at its edges makes a
pair with its neighbour that BPE leaves as it is: a sequence of ids is its text's encoding exactly if all neighbours are such pairs.

Decoding halves the ids and concatenates the bytes up the tree.

Defined cases: null and empty texts have no ids and decode to the empty text; the longest texts are only split more
deeply; repeated rows are encoded alike; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import TOKENIZERS, long_id, parts, tidy
from .vocab import PATTERN, SPACES, WordEncoder, chunks

VOCABULARY = "byte_bpe_50k"
#: Characters of a leaf, and bytes of a pre-token from which it is halved too.
LEAF = 1_024
LONG = 1_024
_CUT = re.compile(f"(?<=[^{SPACES}])(?=[{SPACES}])")
_BLANK = frozenset(" \t\n\r\x0b\x0c\x85\xa0     　") | frozenset(map(chr, range(0x2000, 0x200B)))
_PRE_TOKEN = regex.compile(PATTERN)


class Tree:
    """Encodes and decodes; ``leaf`` and ``long`` may be made small to test the joins."""

    def __init__(self, vocabulary: str = VOCABULARY, folder: str = TOKENIZERS, leaf: int = LEAF, long: int = LONG):
        self.words = WordEncoder(vocabulary, folder)
        self.leaf, self.long, self.dtype = leaf, long, self.words.dtype
        self.run = re.compile(f"[^{SPACES}]{{{long},}}|[{SPACES}]{{{long},}}")
        e = self.words.encoding
        self.bytes_of = [b""] * (e.max_token_value + 1)
        for b in e.token_byte_values():
            self.bytes_of[e.encode_single_token(b)] = b
        self.piece = lru_cache(65536)(lambda b: e._encode_single_piece(b))

    # -- one pre-token

    def stays(self, a: int, b: int) -> bool:
        return list(self.piece(self.bytes_of[a] + self.bytes_of[b])) == [a, b]

    def join_ids(self, a: list[int], b: list[int]) -> list[int]:
        i = j = 1
        while True:
            i, j = min(i, len(a)), min(j, len(b))
            w = self.words.encoding._encode_single_piece(b"".join(self.bytes_of[t] for t in a[len(a) - i :] + b[:j]))
            left = i == len(a) or self.stays(a[len(a) - i - 1], w[0])
            right = j == len(b) or self.stays(w[-1], b[j])
            if left and right:
                return a[: len(a) - i] + w + b[j:]
            i, j = i + (0 if left else i), j + (0 if right else j)

    def one_piece(self, data: bytes) -> list[int]:
        if len(data) <= self.long:
            return self.words.encoding._encode_single_piece(data)
        half = len(data) // 2
        return self.join_ids(self.one_piece(data[:half]), self.one_piece(data[half:]))

    # -- texts

    def window(self, text: str) -> bytes:
        """Ids of a string between certain cuts."""
        if len(text) <= self.long or not self.run.search(text):
            return self.words.text(text)
        ids = []
        for c in chunks(text):
            if len(c) <= self.long:
                ids.append(self.words.text(c))
            else:
                ids += [np.array(self.one_piece(p.encode()), self.dtype).tobytes() for p in _PRE_TOKEN.findall(c)]
        return b"".join(ids)

    def element(self, text: str):
        if len(text) > self.leaf:
            half = len(text) // 2
            return self.join(self.element(text[:half]), self.element(text[half:]))
        first = _CUT.search(text)
        if not first:
            return text
        head, tail = first.start(), len(text) - 1
        while not self.certain(text[tail - 1], text[tail]):
            tail -= 1
        return text[:head], self.window(text[head:tail]), text[tail:]

    def join(self, a, b):
        """The monoid's product of two neighbours."""
        open_a, open_b = isinstance(a, str), isinstance(b, str)
        left, right = a if open_a else a[2], b if open_b else b[0]
        if open_a and open_b:
            return (a, b"", b) if self.certain(a, b) else a + b
        if open_a:
            return (a, self.window(right) + b[1], b[2]) if self.certain(a, right) else (a + right, b[1], b[2])
        if open_b:
            return (a[0], a[1] + self.window(left), b) if self.certain(left, b) else (a[0], a[1], left + b)
        return a[0], a[1] + self.window(left + right) + b[1], b[2]

    @staticmethod
    def certain(left: str, right: str) -> bool:
        """Whether the place between two strings is a certain cut."""
        return bool(left and right) and left[-1] not in _BLANK and right[0] in _BLANK

    def encode(self, text: str) -> bytes:
        """Ids as bytes of ``dtype``."""
        if len(text) <= self.leaf:
            return self.window(text)
        e = self.element(text)
        return self.window(e) if isinstance(e, str) else self.window(e[0]) + e[1] + self.window(e[2])

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) > self.leaf:
            half = len(ids) // 2
            return self.decode(ids[:half]) + self.decode(ids[half:])
        return b"".join(map(self.bytes_of.__getitem__, ids))


def encode(docs: DataFrame, vocabulary: str = VOCABULARY, folder: str = TOKENIZERS) -> DataFrame:
    """``(doc_id, n_tokens, tokens, round_trip)``: ``round_trip`` says whether the decoded ids are the text's bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = Tree(vocabulary, folder)
        for b in parts(batches):
            ids, same = [], []
            for t in b.column("text").to_pylist():
                ids.append(tree.encode(t))
                same.append(tree.decode(np.frombuffer(ids[-1], tree.dtype).tolist()) == t.encode())
            n = np.array([len(x) // tree.dtype.itemsize for x in ids], np.int64)
            values = pa.array(np.frombuffer(b"".join(ids), tree.dtype).astype(np.int32))
            offsets = pa.array(np.concatenate(([0], np.cumsum(n))).astype(np.int32))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n), pa.ListArray.from_arrays(offsets, values), pa.array(same, pa.bool_())], names=["doc_id", "n_tokens", "tokens", "round_trip"])

    return docs.select(long_id().alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(tidy(run), "doc_id long, n_tokens long, tokens array<int>, round_trip boolean")
