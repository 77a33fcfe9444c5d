"""Language identification by prediction by partial matching (PPM).

Each language has a context tree of variable order over bytes: how often each
byte followed each context of 0 to ``order`` bytes. The statistics are frozen
after training. A byte is coded in the longest context that has been seen; if
it never followed there, an escape is coded (method C: distinct followers
against all occurrences, without exclusion) and the next shorter context is
tried, down to all bytes alike. A text's exact code length in each language
follows, and the language with the shortest is predicted.

Trees are held as hash tables of n-grams with a column for each language of a
panel, so that scoring is a table look-up for each byte and panel, in NumPy.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lineage import pin
from .common import mapped

#: Whole texts that training takes from each language at most, about; chosen by a hash of the text.
MAX_TRAIN_DOCS = 1000
#: And from all languages together, dealt evenly, which bounds the model however many there are.
MAX_TRAIN_TOTAL = 20_000
#: Languages that share hash tables; a table has a column for each, so more would mostly hold blanks.
PANEL = 4
#: Languages up to this number have their counts broadcast.
BROADCAST_LANGS = 10_000


class Table:
    """Open-addressed hash table from unsigned 32-bit keys to row numbers."""

    def __init__(self, keys: np.ndarray) -> None:
        self.bits = max(4, int(len(keys) * 4).bit_length())
        self.rows = np.full(1 << self.bits, -1, np.int32)
        self.keys = np.zeros(1 << self.bits, np.uint32)
        self.probes = 0
        slot, rest = self._slot(keys), np.arange(len(keys), dtype=np.int32)
        while len(rest):
            self.probes += 1
            free = self.rows[slot] < 0
            self.rows[slot[free]] = rest[free]
            won = self.rows[slot] == rest
            self.keys[slot[won]] = keys[rest[won]]
            slot, rest = (slot[~won] + 1) & ((1 << self.bits) - 1), rest[~won]

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint32) * np.uint32(2654435761) >> np.uint32(32 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row numbers; -1 where a key is missing."""
        slot = self._slot(keys)
        out = self.rows[slot]
        wrong = np.flatnonzero((out >= 0) & (self.keys[slot] != keys))
        for i in range(1, self.probes):
            if not len(wrong):
                return out
            at = (slot[wrong] + i) & ((1 << self.bits) - 1)
            rows = self.rows[at]
            hit = (rows < 0) | (self.keys[at] == keys[wrong])
            out[wrong[hit]] = rows[hit]
            wrong = wrong[~hit]
        out[wrong] = -1
        return out


def grams_of(text: str, order: int) -> np.ndarray:
    """The ``order + 1``-byte window that ends at each byte, as unsigned 32-bit; zero bytes stand before the text."""
    raw = np.frombuffer(b"\0" * order + text.encode("utf-8", "replace"), np.uint8).astype(np.uint32)
    n = len(raw) - order
    out = np.zeros(n, np.uint32)
    for i in range(order + 1):
        out = out << np.uint32(8) | raw[i : i + n]
    return out


class Panel:
    """Frozen context trees of a few languages, from counts of ``order + 1``-byte windows."""

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]], order: int) -> None:
        self.langs, self.order = sorted(counts), order
        self.seen: list[tuple[Table, np.ndarray]] = []
        self.escape: list[tuple[Table, np.ndarray]] = []
        for k in range(order + 1 if counts else 0):
            width = np.uint32((1 << 8 * (k + 1)) - 1)
            each = []
            for lang in self.langs:
                grams, n = counts[lang]
                keys, at = np.unique(grams.astype(np.uint32) & width, return_inverse=True)
                each.append((keys, np.bincount(at, n).astype(float)))
            keys = np.unique(np.concatenate([x for x, _ in each]))
            contexts = np.unique(keys >> np.uint32(8))
            cost, esc = (np.zeros((len(x), len(self.langs)), np.float32) for x in (keys, contexts))
            for j, (mine, n) in enumerate(each):
                ctx, at = np.unique(mine >> np.uint32(8), return_inverse=True)
                total, kinds = np.bincount(at, n), np.bincount(at)
                rows = np.searchsorted(contexts, ctx)
                esc[rows, j] = -np.log2(kinds / (total + kinds))
                cost[:, j] = np.nan
                cost[np.searchsorted(keys, mine), j] = -np.log2(n / (total + kinds)[at])
            self.escape.append((Table(contexts), esc))
            shorter = self._cost(keys & np.uint32(width >> np.uint32(8)), k - 1)
            below = esc[np.searchsorted(contexts, keys >> np.uint32(8))] + shorter
            self.seen.append((Table(keys), np.where(np.isnan(cost), below, cost)))

    def _cost(self, keys: np.ndarray, k: int) -> np.ndarray:
        """Bits of each window's last byte after its first k bytes, in each language."""
        if k < 0:
            return np.full((len(keys), len(self.langs)), 8, np.float32)
        table, cost = self.seen[k]
        rows = table.find(keys)
        out = cost[rows]
        if len(miss := np.flatnonzero(rows < 0)):
            table, esc = self.escape[k]
            ctx = table.find(keys[miss] >> np.uint32(8))
            shorter = self._cost(keys[miss] & np.uint32((1 << 8 * k) - 1), k - 1)
            out[miss] = shorter + np.where((ctx >= 0)[:, None], esc[ctx], 0)
        return out

    def costs(self, grams: np.ndarray) -> np.ndarray:
        return self._cost(grams, self.order)


class Ppm:
    """Frozen context trees of any number of languages (order 3 at most), ``PANEL`` languages to a panel."""

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]], order: int) -> None:
        self.langs, self.order = sorted(counts), order
        parts = (self.langs[i : i + PANEL] for i in range(0, len(self.langs), PANEL))
        self.panels = [Panel({x: counts[x] for x in part}, order) for part in parts]

    def lengths(self, texts: list[str], chunk: int = 1 << 17) -> np.ndarray:
        """Code lengths in bits: a row for each text, a column for each language."""
        out = np.zeros((len(texts), len(self.langs)))
        held: list[np.ndarray] = []
        owners: list[int] = []

        def flush() -> None:
            if held:
                grams, starts = np.concatenate(held), np.cumsum([0, *map(len, held[:-1])])
                for i, panel in enumerate(self.panels):
                    sums = np.add.reduceat(panel.costs(grams), starts, axis=0, dtype=np.float64)
                    np.add.at(out[:, i * PANEL : (i + 1) * PANEL], owners, sums)
                held.clear()
                owners.clear()

        size = 0
        for i, t in enumerate(texts):
            grams = grams_of(t, self.order)
            for a in range(0, len(grams), chunk):
                held.append(grams[a : a + chunk])
                owners.append(i)
                size += len(held[-1])
                if size >= chunk:
                    flush()
                    size = 0
        flush()
        return out


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", order: int = 3, max_docs: int = MAX_TRAIN_DOCS) -> Ppm:
    """Frozen statistics from rows whose language and text are not null.

    Of a language with more than ``max_docs`` distinct texts a sample of whole
    texts is taken, by a hash of the text, that has about ``max_docs``; of many
    languages about ``MAX_TRAIN_TOTAL`` in all, evenly: what is counted,
    gathered and broadcast is bounded by that, not by the corpus.
    """
    rows = docs.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).where("text is not null and lang is not null")
    totals = pin(rows.select("lang", F.xxhash64("text").alias("text")).distinct().groupBy("lang").count())
    langs = totals.count()
    share = F.least(F.lit(1.0), F.lit(float(min(max_docs, MAX_TRAIN_TOTAL / max(1, langs)))) / F.col("count"))
    few = langs <= BROADCAST_LANGS  # else the join is shuffled; skewed languages are split
    sample = rows.join(F.broadcast(totals) if few else totals, "lang").where(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < share * (1 << 20))
    sample = sample.select("lang", "text").distinct()  # or a text that a third of the rows copy would all be in

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for lang, texts in pdf.groupby("lang").text:
                grams, n = np.unique(np.concatenate([grams_of(t, order) for t in texts]), return_counts=True)
                yield pd.DataFrame({"lang": lang, "gram": grams.astype(np.int64), "n": n})

    counts = sample.mapInPandas(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    return Ppm({lang: (x.gram.to_numpy(np.uint32), x.n.to_numpy(float)) for lang, x in counts.groupby("lang")}, order)


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def score(model: Ppm, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, posterior probability (languages alike before), and bits a byte of each text.

    ``und`` with score 0 if a text is null or has no letter, or nothing was learned.
    """
    langs, scores, rate = ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
    good = [i for i, t in enumerate(texts) if model.langs and has_letter(t)]
    bits = model.lengths([texts[i] for i in good])
    for i, x in zip(good, bits, strict=True):
        j = int(x.argmin())
        langs[i], scores[i] = model.langs[j], 1 / np.exp2(np.maximum(x[j] - x, -1000)).sum()
        rate[i] = x[j] / len(texts[i].encode("utf-8", "replace"))
    return langs, scores, rate


def identify(docs: DataFrame, model: Ppm, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns with ``lang_pred``, ``score`` and ``bits_per_byte`` of every whole text.

    Rows are independent: nulls and letterless texts get ``und``, repeated rows
    the same answer. Equal code lengths go to the language first in order.
    """
    src = docs.select(*(F.col(c) for c in keep if c not in ("lang_pred", "score", "bits_per_byte")), F.col(text_col).alias("__text"))
    held = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the training sample
    return mapped(src, ["__text"], "lang_pred string, score double, bits_per_byte double", lambda texts: [(range(len(texts)), list(score(held.value, texts)))])
