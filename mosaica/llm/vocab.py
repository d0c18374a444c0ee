"""Public vocabularies, and encoding by cached words. The files' folder is a parameter; nothing here is trained."""

from __future__ import annotations

import base64
import re
from functools import lru_cache
from pathlib import Path

import numpy as np

from .common import TOKENIZERS

#: GPT-2's split of a text into pre-tokens.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words that a worker remembers; then it starts afresh. Only speed depends on it.
CACHE_WORDS = 400_000
#: What the pattern takes for white space, as the inside of a character class.
SPACES = " \t\n\r\x0b\x0c\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_UNEVEN = re.compile(f"[{SPACES}] ")
_CHUNK = re.compile(f"[{SPACES}]*[^{SPACES}]+|[{SPACES}]+")


@lru_cache(4)
def encoding(vocabulary: str = "byte_bpe_50k", folder: str = TOKENIZERS):
    """The tiktoken encoding of ``<folder>/<vocabulary>.tiktoken``, without special tokens."""
    import tiktoken

    lines = (Path(folder) / f"{vocabulary}.tiktoken").read_bytes().splitlines()
    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x)}
    return tiktoken.Encoding(vocabulary, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def chunks(text: str) -> list[str]:
    """The text cut before each white space that follows something else.

    No pre-token spans such a place and none before it looks beyond it, so chunks are encoded one by one.
    """
    return _CHUNK.findall(text)


class WordEncoder(dict):
    """Encodes texts with a byte-level BPE vocabulary; token ids come as bytes of ``dtype``.

    As a dict it maps a word to the ids of a blank and that word.
    """

    def __init__(self, vocabulary: str = "byte_bpe_50k", folder: str = TOKENIZERS):
        super().__init__()
        self.encoding = encoding(vocabulary, folder)
        self.dtype = np.dtype("<u2" if self.encoding.max_token_value < 65536 else "<u4")

    def plain(self, text: str) -> bytes:
        return np.array(self.encoding.encode_ordinary(text), self.dtype).tobytes()

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHE_WORDS:
            self.clear()
        ids = self.plain(" " + word)
        if len(word) < 64:
            self[word] = ids
        return ids

    def text(self, text: str) -> bytes:
        """Ids of a whole text, the same as encoding it at once."""
        if _UNEVEN.search(text):
            return b"".join([self[c[1:]] if c[0] == " " else self.plain(c) for c in chunks(text)])
        head, *rest = text.split(" ")
        return self.plain(head) + b"".join(map(self.__getitem__, rest))


class Pieces(dict):
    """Word -> ids, as int32 bytes, of the word encoded alone by the byte-fallback vocabulary ``piece_bpe_32k``."""

    def __init__(self, folder: str = TOKENIZERS):
        import sentencepiece

        super().__init__()
        self.model = sentencepiece.SentencePieceProcessor(model_file=str(Path(folder) / "piece_bpe_32k.model"))
        self.size = self.model.get_piece_size()
        self.is_byte = np.array([self.model.is_byte(i) for i in range(self.size)])

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHE_WORDS:
            self.clear()
        ids = np.array(self.model.encode(word), np.int32).tobytes()
        if len(word) < 64:
            self[word] = ids
        return ids
