"""Best-fit packing of tokenized documents into sequences of bounded length.

Documents are tokenized where they lie; only the lengths of their pieces are
shuffled. Pieces are dealt by hash to groups of about ``group_pieces``, and each
group is packed in one pass by an online best-fit packer with a bounded number
of open bins, so a task's memory does not follow the size of its group. Pieces
arrive in the order of their hash, window after window, and the longest of a
window first: the bins that one window leaves open are filled by the next.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lineage import pin
from .bpe import PATTERN, _chunks, load
from .common import mapped


class FastBpe:
    """The ids that the ``tokenizers`` library gives for a byte-level BPE file, by the faster ``tiktoken``.

    Vocabulary, merge order and special tokens come from the same file: a
    token's id is its rank. What tiktoken's regular expressions cannot handle
    (white space by the hundred thousand) goes through the plain encoder.
    """

    def __init__(self, path: str) -> None:
        self.plain = load(path)
        self.fast = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=self.plain.by_bytes, special_tokens=self.plain.special)

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        try:
            return self.fast.encode_to_numpy(text, allowed_special="all").astype("<u4").tobytes()
        except ValueError:
            return self.plain.encode_batch([text])[0]


_LOADED: dict[str, FastBpe] = {}


def _tokenizer(path: str) -> FastBpe:
    """Read once in each Python worker."""
    if path not in _LOADED:
        _LOADED[path] = FastBpe(path)
    return _LOADED[path]


class OpenBins:
    """Bounded-space online best fit.

    Open bins are kept by their free space, and bit ``f`` of an integer says
    whether a bin with ``f`` tokens of space is open: the tightest bin for a
    piece is the lowest set bit from its length up. When a bin must be opened
    beyond the bound, the fullest one closes.
    """

    def __init__(self, capacity: int, most: int) -> None:
        self.capacity, self.most = capacity, most
        self.bits, self.open, self.made, self.closed = 0, 0, 0, 0
        self.by_space: dict[int, list[int]] = {}

    def _take(self, space: int) -> int:
        held = self.by_space[space]
        number = held.pop()
        if not held:
            del self.by_space[space]
            self.bits ^= 1 << space
        self.open -= 1
        return number

    def place(self, length: int) -> tuple[int, int]:
        """The bin's number and the offset in it of a piece of ``length`` tokens."""
        fitting = self.bits >> length
        if fitting:
            space = length + (fitting & -fitting).bit_length() - 1
            number = self._take(space)
        else:
            space, number = self.capacity, self.made
            self.made += 1
            if self.open == self.most and length < self.capacity:
                self._take((self.bits & -self.bits).bit_length() - 1)
                self.closed += 1
        left = space - length
        if left:
            self.by_space.setdefault(left, []).append(number)
            self.bits |= 1 << left
            self.open += 1
        return number, self.capacity - space


class _Packer:
    """Packs a partition's rows as they come, group after group; each task has a copy of its own."""

    def __init__(self, capacity: int, most: int) -> None:
        self.how, self.group = (capacity, most), None

    def take(self, groups: list[int], lengths: list[int]) -> Iterator[tuple[range, list]]:
        numbers, offsets = [], []
        for g, n in zip(groups, lengths, strict=True):
            if g != self.group:
                self.group, self.bins = g, OpenBins(*self.how)
            number, offset = self.bins.place(n)
            numbers.append((g << 40) + number)
            offsets.append(offset)
        yield range(len(groups)), [numbers, offsets]


def pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """``(id, piece, start, length, ids)`` of every document: its ids and ``end_id``, cut only if longer than ``capacity``.

    All pieces but the first have ``capacity`` tokens. A null or empty text is
    one piece that holds ``end_id`` alone. Null ids are kept; repeated rows are
    packed as often as they come. ``ids`` are little-endian unsigned 32-bit.
    """
    end = np.array([end_id], "<u4").tobytes()

    def make(texts: list[str | None]) -> Iterator[tuple[list[int], list]]:
        bpe = _tokenizer(path)
        for a, b in _chunks(texts):
            rows = []
            for i in range(a, b):
                blob = bpe.encode(texts[i]) + end
                n = len(blob) // 4
                edges = [0, *range((n - 1) % capacity + 1, n + 1, capacity)]
                rows += ((i, k, s, e - s, blob[4 * s : 4 * e]) for k, (s, e) in enumerate(zip(edges, edges[1:], strict=False)))
            at, *columns = zip(*rows, strict=True)
            yield at, columns

    return mapped(docs.select(F.col(id_col), F.col(text_col).alias("__in")), ["__in"], "piece int, start long, length long, ids binary", make)


def place(parts: DataFrame, length_col: str = "length", capacity: int = 2048, most_open: int = 1024, window_pieces: int = 2048, group_pieces: int = 65_536) -> DataFrame:
    """``parts`` with ``sequence_id`` and ``offset``; every row is placed, and rows keep all their columns.

    Windows take ``window_pieces`` rows and groups ``group_pieces`` on average,
    both dealt by a hash of the row. A group's windows go one after another
    through ``most_open`` bins, the longest rows of a window first. Sequence
    numbers of different groups differ. An empty table
    gives an empty result; columns already named ``sequence_id`` or ``offset``
    are replaced.
    """
    parts = pin(parts.drop("sequence_id", "offset"))
    rows = parts.count()
    groups, windows = (max(1, -(-rows // n)) for n in (group_pieces, window_pieces))
    names = parts.columns
    dealt = parts.withColumn("__order", F.xxhash64(*names)).withColumn("__window", F.pmod(F.xxhash64("__order"), F.lit(windows)))
    dealt = dealt.withColumn("__group", F.pmod("__window", F.lit(groups)))
    dealt = dealt.repartition(groups, "__group").sortWithinPartitions("__group", "__window", F.desc(length_col), "__order")
    dealt = dealt.withColumn("__length", F.col(length_col)).drop("__order", "__window")
    packer = _Packer(capacity, most_open)
    return mapped(dealt, ["__group", "__length"], "sequence_id long, offset long", packer.take)


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, with_ids: bool = False, **how: int) -> DataFrame:
    """Tokenize, cut and place: one row for each piece, with ``ids_crc32`` and, on demand, ``ids`` themselves.

    Without ``with_ids`` only lengths and checksums are shuffled.
    """
    parts = pieces(docs, path, id_col, text_col, capacity).withColumn("ids_crc32", F.crc32("ids"))
    return place(parts if with_ids else parts.drop("ids"), capacity=capacity, **how)
