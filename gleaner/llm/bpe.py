"""Byte-level BPE encoding by prefix-sharing trie traversal, and decoding.

The BPE encoding of a prefix of a word is fixed by its last token: if the
encoding of a word ends in token ``t``, what stands before ``t`` is the
encoding of that shorter prefix, and a sequence of tokens is an encoding
exactly if each adjacent pair is the encoding of its own bytes. So the distinct
words of a batch go into a trie, and a depth-first traversal computes for each
node the last token of the prefix it stands for, once for all words that share
the prefix. A word's ids are read off by walking its last tokens back.

The trie is held as its sorted words: in that order each word leaves the branch
of the one before where their common prefix ends, which is the traversal, and
the branch at hand is all of the trie that has to be in memory.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Callable, Iterator

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped

# Fixed value: the pre-tokenizer's pattern.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in vocabulary files, reversed."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Bpe:
    """Encoder and decoder for a ``tokenizers`` file with a byte-level BPE model.

    ``cache`` words at most are remembered between batches, in two generations:
    when the younger is full the older is forgotten, so that memory stays
    bounded on any corpus and words that keep coming stay known.
    """

    def __init__(self, path: str, cache: int = 1_000_000) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        raw = lambda s: bytes(alphabet[c] for c in s)
        self.by_bytes = {raw(s): i for s, i in spec["model"]["vocab"].items()}
        self.by_id = {i: b for b, i in self.by_bytes.items()}
        self.longest = max(map(len, self.by_bytes))
        self.sizes = {i: len(b) for i, b in self.by_id.items()}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.by_id |= {i: s.encode() for s, i in self.special.items()}
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.rank = {(raw(a), raw(b)): i for i, (a, b) in enumerate(merges)}
        self.words = regex.compile(PATTERN)
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.cache = cache
        self.fits: dict[tuple[int, int], bool] = {}

    def merged(self, word: bytes) -> list[bytes]:
        """BPE by its definition: the adjacent pair of lowest rank merges first, leftmost on ties."""
        parts = [word[i : i + 1] for i in range(len(word))]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: (self.rank.get((parts[i], parts[i + 1]), 1 << 60), i))
            if (parts[best], parts[best + 1]) not in self.rank:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return parts

    def _fit(self, pair: tuple[int, int]) -> bool:
        """Whether two tokens (or -1 and one) are the encoding of their own bytes; remembered."""
        if len(self.fits) > 500_000:
            self.fits.clear()
        left, right = self.by_id[pair[0]] if pair[0] >= 0 else b"", self.by_id[pair[1]]
        self.fits[pair] = ok = self.merged(left + right) == ([left, right] if left else [right])
        return ok

    def encode_words(self, texts: list[str]) -> list[bytes]:
        """The ids of each distinct word, little-endian unsigned 32-bit."""
        words = [w.encode("utf-8", "replace") for w in texts]
        out = [b""] * len(words)
        by_bytes, longest, size, fits, fit = self.by_bytes.get, self.longest, self.sizes, self.fits.get, self._fit
        before, last = b"", [-1]  # the branch at hand, and the last token of each of its prefixes
        for number in sorted(range(len(words)), key=words.__getitem__):
            word, shared = words[number], 0
            for x, y in zip(before, word, strict=False):
                if x != y:
                    break
                shared += 1
            del last[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                for start in range(max(0, end - longest), end):
                    token = by_bytes(word[start:end])
                    if token is not None:
                        key = (last[start], token)
                        known = fits(key)
                        if fit(key) if known is None else known:
                            last.append(token)
                            break
                else:
                    raise ValueError(f"the vocabulary lacks byte {word[end - 1]:#x}")
            ids, at = [], len(word)
            while at:
                token = last[at]
                ids.append(token)
                at -= size[token]
            ids.reverse()
            out[number] = struct.pack(f"<{len(ids)}I", *ids)
            before = word
        return out

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers; null has none.

        A special token's string in a text becomes its id, as in the library.
        """
        pieces = [self._pieces(t) for t in texts]
        met = set().union(*pieces)
        new = met - self.known.keys()
        if len(self.known) + len(new) > self.cache // 2:
            self.older, self.known, new = self.known, {}, met
        again = new & self.older.keys()
        self.known.update((w, self.older[w]) for w in again)
        new -= again
        words = [w for w in new if w not in self.special]
        self.known.update((w, struct.pack("<I", self.special[w])) for w in new if w in self.special)
        self.known.update(zip(words, self.encode_words(words), strict=True))
        get = self.known.__getitem__
        return [b"".join(map(get, p)) for p in pieces]

    def _pieces(self, text: str | None) -> list[str]:
        if not text:
            return []
        if self.split is None or not any(s in text for s in self.special):
            return self.words.findall(text)
        return [w for part in self.split.split(text) if part for w in ([part] if part in self.special else self.words.findall(part))]

    def decode(self, ids: bytes) -> str:
        """The text of ids; bytes that are not UTF-8 become replacement characters, unknown ids nothing."""
        get = self.by_id.get
        return b"".join(get(i, b"") for i in np.frombuffer(ids, "<u4").tolist()).decode("utf-8", "replace")


_LOADED: dict[str, Bpe] = {}


def load(path: str) -> Bpe:
    """The tokenizer at ``path``, read once in each Python worker."""
    if path not in _LOADED:
        _LOADED[path] = Bpe(path)
    return _LOADED[path]


def _chunks(texts: list[str | None], chars: int = 1_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold about ``chars`` characters, so that memory doesn't follow the batch."""
    start, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t or "")
        if held >= chars:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def _map(df: DataFrame, column: str, add: str, fill: Callable[[list], list]) -> DataFrame:
    return mapped(df.withColumn("__in", F.col(column)), ["__in"], add, lambda values: ((range(a, b), fill(values[a:b])) for a, b in _chunks(values)))


def encode(df: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``df`` with ``ids_col``: every whole text's ids as binary, little-endian unsigned 32-bit.

    Null and empty texts have no ids (empty binary, never null). A column that
    already bears the name ``ids_col`` is replaced. Rows are independent, so
    repeated rows and very long texts need nothing of their own.
    """
    return _map(df, text_col, f"`{ids_col}` binary", lambda texts: [load(path).encode_batch(texts)])


def decode(df: DataFrame, path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """``df`` with ``text_col``: the text of binary ids; null ids have the empty text."""
    return _map(df, ids_col, f"`{text_col}` string", lambda blobs: [[load(path).decode(x or b"") for x in blobs]])


def round_trip(df: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids", decoded_col: str = "decoded") -> DataFrame:
    """``encode`` and ``decode`` in one pass of one Python worker, which is what an exactness check wants."""

    def fill(texts: list[str | None]) -> list[list]:
        bpe = load(path)
        ids = bpe.encode_batch(texts)
        return [ids, [bpe.decode(x) for x in ids]]

    return _map(df, text_col, f"`{ids_col}` binary, `{decoded_col}` string", fill)
