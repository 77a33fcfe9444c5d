"""SimHash near-duplicates by meet-in-the-middle ball hashing.

A fingerprint has 64 bits. Two fingerprints at most ``radius`` bits apart share
a variant that is at most half the radius from either, so every distinct
fingerprint emits all variants within half the radius, the variants are
shuffled, and fingerprints that meet at one variant are verified. With radius
2 a variant is met by at most 65 fingerprints, whatever the size of the corpus.

``drop_near_dups`` keeps one text of each group by Jaccard similarity. Texts
whose fingerprints link are verified; as those are not all similar texts, the
rest meets by MinHash keys.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce
from itertools import combinations, pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..lineage import pin
from .common import components, mapped, small

_ROWS = 1 << 16
_ODD = np.uint64(0x9E3779B97F4A7C15)
#: Keys of a text in near-dedup, and MinHash values in a key.
KEYS, ROWS = 20, 4
#: Keys whose texts are compared before the others', which then have fewer to tell apart.
FIRST = 4
#: Shingles, about, of the texts that are compared with each other in a task; texts that go to every block of a key.
BLOCK, PIVOTS = 1 << 19, 64
_CHUNK = 4096
_XOR, _TIMES = (np.fromiter((xxhash.xxh64_intdigest(what, i) | odd for i in range(KEYS * ROWS)), np.uint64) for what, odd in ((b"xor", 0), (b"times", 1)))


def words_of(text: str | None) -> list[bytes]:
    """Runs of non-white-space bytes, A-Z lower-cased; null has none."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def shingles_of(words: list[bytes], size: int) -> list[bytes]:
    """``size``-word shingles with repeats; a shorter sequence is one shingle, none has none."""
    if not words:
        return []
    if len(words) <= size:
        return [b" ".join(words)]
    return [b" ".join(x) for x in zip(*(words[i:] for i in range(size)), strict=False)]


def _signs(hashes: np.ndarray, weights: np.ndarray | None) -> int:
    """The 64 majority bits of unsigned hashes; a bit is set by more than half of the weight."""
    sums = np.zeros(64)
    for i in range(0, len(hashes), _ROWS):
        bits = np.unpackbits(hashes[i : i + _ROWS].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        sums += bits.sum(0) if weights is None else weights[i : i + _ROWS] @ bits
    total = len(hashes) if weights is None else weights.sum()
    return int.from_bytes(np.packbits(2 * sums > total).tobytes(), "big")


def fingerprint(text: str | None, size: int = 3, seed: int = 42) -> int:
    """Unsigned 64-bit SimHash over ``size``-word shingles, repeats included; 0 for no words."""
    words = words_of(text)
    if not words:
        return 0
    if size == 1:
        counts = Counter(words)
        hashes = np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in counts), np.uint64, len(counts))
        return _signs(hashes, np.fromiter(counts.values(), np.float64, len(counts)))
    grams = shingles_of(words, size)
    return _signs(np.fromiter((xxhash.xxh64_intdigest(g, seed) for g in grams), np.uint64, len(grams)), None)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, text_col: str = "text", size: int = 3, seeds: tuple[int, ...] = (42,), keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and ``fps``, an array with a (signed) fingerprint for each seed.

    Null and wordless texts get fingerprint zero; texts of any length are read whole.
    """
    src = docs.select(*keep, F.col(text_col).alias("__text"))
    return mapped(src, ["__text"], "fps array<long>", lambda texts: [(range(len(texts)), [[[_signed(fingerprint(t, size, s)) for s in seeds] for t in texts]])])


def _variants(fps: DataFrame, half: int) -> DataFrame:
    flips = [0, *(sum(1 << i for i in c) for n in range(1, half + 1) for c in combinations(range(64), n))]
    return fps.select("fp", F.explode(F.array(*(F.col("fp").bitwiseXOR(F.lit(_signed(m)).cast("long")) for m in flips))).alias("variant"))


def links(fps: DataFrame, radius: int = 2, chain: bool = True) -> DataFrame:
    """Verified pairs ``(a, b)``, a < b, of distinct fingerprints (column ``fp``) at most ``radius`` bits apart.

    ``chain`` keeps, of the fingerprints that meet at a variant, only
    neighbours in order. With an even radius any two of them are within it, so
    that loses no component. Otherwise every pair is returned once.
    """
    met = _variants(fps, (radius + 1) // 2)
    w = Window.partitionBy("variant").orderBy("fp")
    if chain and radius % 2 == 0:
        pairs = met.select(F.lag("fp").over(w).alias("a"), F.col("fp").alias("b")).where("a is not null")
    else:
        near = met.select("variant", "fp", F.lag("fp").over(w).alias("p"), F.lead("fp").over(w).alias("q")).where("p is not null or q is not null")
        group = near.groupBy("variant").agg(F.sort_array(F.collect_set("fp")).alias("g"))  # 65 at most for radius 2
        group = group.select("g", F.posexplode("g").alias("i", "a"))
        pairs = group.select("a", F.explode(F.expr("slice(g, i + 2, size(g))")).alias("b"))
    return pairs.distinct().where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)


def near_dups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, radius: int = 2) -> DataFrame:
    """``(id, fingerprint, component_id)`` of every row; component_id is the smallest id reachable by links.

    Null or wordless texts have fingerprint zero and link like any other. Rows
    with a null id are returned and join the component of their fingerprint,
    but never name it (null if all its ids are null). Repeated rows are
    returned as often as they come. An empty table gives an empty result.
    """
    rows = pin(fingerprints(docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__t")), "__t", size, keep=("__id",)).select("__id", F.col("fps")[0].alias("fp")))
    fps = rows.groupBy("fp").agg(F.min("__id").alias("first"))
    comp = components(links(fps.select("fp"), radius))
    rooted = fps.join(comp, fps.fp == comp.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    rooted = pin(rooted)
    named = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = small(pin(rooted.join(named, "root").select("fp", "component_id")))
    return rows.join(named, "fp").select(F.col("__id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def hashed_shingles(words: list[bytes], size: int) -> np.ndarray:
    """Distinct 64-bit hashes of ``size``-word shingles, put together from the hashes of words; a shorter sequence is one."""
    if len(words) < size:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), size)] if words else [], np.uint64)
    known = {w: xxhash.xxh64_intdigest(w) for w in set(words)}
    each = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    out, n = np.zeros(len(words) - size + 1, np.uint64), len(words) - size + 1
    for j in range(size):
        out = out * _ODD + each[j : j + n]
    out = (out ^ out >> np.uint64(29)) * _ODD
    return np.unique(out ^ out >> np.uint64(32))


def jaccard(a: str | None, b: str | None, size: int = 5) -> float:
    """Similarity of the sets of ``size``-word shingles; 1.0 if neither text has a word."""
    x, y = (hashed_shingles(words_of(t), size) for t in (a, b))
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both) if len(x) or len(y) else 1.0


def minhashes(shingles: np.ndarray) -> np.ndarray:
    """``KEYS * ROWS`` smallest values of the shingles' hashes, each in another order."""
    least = np.full(len(_XOR), np.iinfo(np.uint64).max)
    for i in range(0, len(shingles), _CHUNK):
        least = np.minimum(least, ((shingles[None, i : i + _CHUNK] ^ _XOR[:, None]) * _TIMES[:, None]).min(1))
    return least


def keys_of(values: np.ndarray) -> list[int]:
    """``KEYS`` signed keys, each of ``ROWS`` of the MinHash values; texts of similarity s share a key with probability s ** ROWS each."""
    each, at = values.reshape(KEYS, ROWS), np.arange(KEYS, dtype=np.uint64)
    for j in range(ROWS):
        at = (at ^ each[:, j]) * _ODD
        at ^= at >> np.uint64(29)
    return at.view(np.int64).tolist()


def _outlines(docs: DataFrame, size: int) -> DataFrame:
    """``(id, k, n, fp, keys)`` of ``(id, k, t)``: how many shingles, their SimHash fingerprint, and MinHash keys; no fingerprint or key without words."""

    def make(texts: list[str | None]) -> Iterator[tuple[range, list]]:
        made: dict[str | None, tuple] = {}
        for t in texts:
            if t not in made:
                x = hashed_shingles(words_of(t), size)
                made[t] = (len(x), _signed(_signs(x, None)), keys_of(minhashes(x))) if len(x) else (0, None, [])
        yield range(len(texts)), [list(c) for c in zip(*(made[t] for t in texts), strict=True)]

    return mapped(docs.select("id", "k", "t"), ["t"], "n long, fp long, keys array<long>", make)


def drop_near_dups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs`` with one row of each near-duplicate group: that with the smallest id.

    Texts link if their ``size``-word shingles have a Jaccard similarity of at
    least ``similarity``; groups are what links connect, and texts without
    words are alike. Texts meet first in components of SimHash fingerprints
    over those shingles, found by ball hashing. That finds all but identical
    texts and not, for certain, others at 0.8; so texts of different groups meet
    again where they share one of ``KEYS`` keys of ``ROWS`` MinHash values,
    ``FIRST`` of them before the others.
    Then what is met depends on that similarity alone, not on the kind of edit
    or the length: a pair at 0.8 is missed with a probability of 3e-5.
    Similarities are exact. Any two texts that share a key are compared unless
    other links connect them. Equal texts are one group before that. Of rows with the same text
    and id one stays; null ids come last. All columns are returned unchanged;
    an empty table gives an empty one.
    """
    worded = F.coalesce(F.col(text_col).rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    key = F.when(worded, F.unhex(F.md5(text_col))).otherwise(F.lit(b""))
    keyed = docs.select(F.col(id_col).alias("id"), key.alias("k"), F.col(text_col).alias("t"))
    thin = pin(_outlines(keyed, size))
    texts = thin.groupBy("k").agg(F.min("id").alias("id"), *(F.first(c).alias(c) for c in ("n", "fp", "keys")))
    texts = pin(texts.withColumn("node", F.monotonically_increasing_id()))
    thin = thin.select("k", "id")
    comp = _groups(texts, keyed, size, similarity)
    rooted = texts.select("k", "id", "node").join(comp, "node", "left").select("k", "id", F.coalesce("root", "node").alias("root"))
    kept = rooted.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("z"), "id", "k")).alias("h")).select(F.col("h.k").alias("k"), F.col("h.id").alias("id"))
    rows = thin.groupBy("k", "id").agg(F.count("*").alias("n"))
    same = lambda x, y: (x.k == y.k) & x.id.eqNullSafe(y.id)
    gone = pin(rows.join(kept, same(rows, kept), "left_anti").select(F.col("k").alias("__k"), F.col("id").alias("__id")))
    again = pin(rows.where("n > 1").join(kept, same(rows, kept), "left_semi").select(F.col("k").alias("__k"), F.col("id").alias("__id")))
    at = lambda d: (key == d["__k"]) & F.col(id_col).eqNullSafe(d["__id"])
    out = docs.join(small(gone), at(gone), "left_anti")
    if again.isEmpty():
        return out
    first = Window.partitionBy("__key", "__row." + id_col).orderBy("__key")
    doubled = docs.join(small(again), at(again), "left_semi").select(F.struct(*docs.columns).alias("__row"), key.alias("__key"))
    doubled = doubled.withColumn("__n", F.row_number().over(first)).where("__n = 1").select("__row.*")
    return out.join(small(again), at(again), "left_anti").unionByName(doubled)


def _groups(texts: DataFrame, full: DataFrame, size: int, similarity: float) -> DataFrame:
    """``(node, root)`` of the texts that have a link, from ``(node, k, id, n, fp, keys)`` and the rows ``(k, id, t)``.

    Only texts that share a key with another are read again for their shingles.
    Of keys that are split into blocks, first each block and some pivots are
    compared, then what is not yet in the key's largest group with all the rest.
    """
    balls = texts.where("fp is not null").select("node", "n", "fp")
    near = components(links(balls.select("fp").distinct()))
    balls = balls.join(near.select(F.col("node").alias("fp"), "root"), "fp", "left").select("node", "n", F.coalesce("root", "fp").alias("key"))
    some = [texts.select("node", "n", F.explode(F.slice("keys", a + 1, b - a)).alias("key")) for a, b in pairwise((0, FIRST, KEYS))]
    rounds = [_met(keyed) for keyed in (balls, *some)]
    every = reduce(DataFrame.unionByName, rounds)
    shared = texts.join(every.select("node").distinct(), "node", "left_semi")
    shared = small(pin(shared.select("node", F.col("k").alias("__k"), F.col("id").alias("__id"))))
    rows = full.join(shared, (full.k == F.col("__k")) & full.id.eqNullSafe(F.col("__id"))).groupBy("node").agg(F.first("t").alias("t"))
    shingles = pin(mapped(rows, ["t"], "h binary", lambda ts: [(range(len(ts)), [[hashed_shingles(words_of(t), size).tobytes() for t in ts]])]))
    done, comp = [], None
    for met in rounds:
        done.append(pin(_linked(_apart(met, comp), shingles, similarity)))
        comp = pin(components(reduce(DataFrame.unionByName, done)))
    split = pin(_across(_apart(every.where("blocks > 1"), comp)))
    if split.isEmpty():
        return comp
    return components(reduce(DataFrame.unionByName, [*done, _linked(split, shingles, similarity)]))


def _met(keyed: DataFrame) -> DataFrame:
    """``(key, node, n, blocks, texts)`` of the texts ``(key, node, n)`` that share a key: into how many blocks it is split, and how many texts have it."""
    held = keyed.groupBy("key").agg(F.count("*").alias("texts"), F.sum("n").alias("size")).where("texts > 1")
    held = small(pin(held.select("key", "texts", F.ceil(F.col("size") / BLOCK).alias("blocks"))))
    return pin(keyed.join(held, "key"))


def _apart(met: DataFrame, comp: DataFrame | None) -> DataFrame:
    """``met`` with each text's ``root``, and ``x``, ``y`` to compare in; only of keys whose texts are in different groups.

    A key's texts are dealt into its blocks by hash; about ``PIVOTS`` of them go to every block.
    """
    met = met.withColumn("y", F.pmod(F.xxhash64("node"), F.col("blocks"))).withColumn("x", F.lit(-1).cast("long"))
    if comp is None:
        return met.withColumn("root", F.col("node"))
    met = met.join(small(comp), "node", "left").withColumn("root", F.coalesce("root", "node"))
    live = pin(met.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("key"))
    return met.join(small(live), "key", "left_semi")


def _across(met: DataFrame) -> DataFrame:
    """Rows to compare every text outside its key's largest group with every other text of the key, in pairs of blocks ``(x, y)``."""
    sizes = met.groupBy("key", "root").agg(F.count("*").alias("c"), F.sum("n").alias("s"))
    most = sizes.groupBy("key").agg(F.max(F.struct("c", "root")).alias("m"), F.sum("s").alias("s"), F.max(F.struct("c", "root", "s")).alias("t"))
    most = pin(most.select("key", F.col("m.root").alias("main"), F.ceil((F.col("s") - F.col("t.s")) / BLOCK).alias("outer")))
    met = met.join(small(most), "key").withColumn("out", F.col("root") != F.col("main"))
    every = met.withColumn("x", F.explode(F.sequence(F.lit(0).cast("long"), F.col("outer") - 1)))
    mine = met.where("out").withColumn("x", F.pmod(F.xxhash64("node"), F.col("outer"))).withColumn("y", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    return every.unionByName(mine).drop("main", "outer", "out")


def _linked(met: DataFrame, shingles: DataFrame, similarity: float) -> DataFrame:
    """``(a, b)``: verified links that connect what can be connected within each ``(key, x, y)`` of ``met``."""
    pivot = (F.col("x") < 0) & (F.col("blocks") > 1) & (F.pmod(F.xxhash64("node", F.lit(1)), F.col("texts")) < PIVOTS)
    met = met.withColumn("y", F.explode(F.when(pivot, F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).otherwise(F.array("y"))))
    dealt = met.select("key", "x", "y", "node", "root").join(shingles, "node").repartition("key", "x", "y").sortWithinPartitions("key", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[int, int]] = []
        held: list[pa.RecordBatch] = []

        def close() -> None:
            node, root = (np.concatenate([b.column(c).to_numpy() for b in held]) for c in ("node", "root"))
            if (root != root[0]).any():
                found.extend(forest(node, root, [np.frombuffer(v, np.uint64) for b in held for v in b.column("h").to_pylist()], similarity))
            held.clear()

        for batch in batches:
            group = np.stack([batch.column(c).to_numpy() for c in ("key", "x", "y")])
            edges = [0, *(np.flatnonzero((group[:, 1:] != group[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
            for s, e in pairwise(edges):
                if held and e > s and tuple(group[:, s]) != last:
                    close()
                if e > s:
                    held.append(batch.slice(s, e - s))
                    last = tuple(group[:, s])
            if len(found) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], ["a", "b"])
                found.clear()
        if held:
            close()
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], ["a", "b"])

    return dealt.mapInArrow(run, "a long, b long")


def forest(node: np.ndarray, root: np.ndarray, sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Links that connect all of the texts that links can connect, beyond those that share a ``root`` already.

    A text is compared with all others at once, by a count over the postings of
    its shingles. Texts of the largest group so far need not be, as all others are.
    """
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    if len(sets) == 2:
        both = len(np.intersect1d(*sets, assume_unique=True))
        return [(int(node[0]), int(node[1]))] if both / (sizes.sum() - both) >= similarity else []
    term = np.unique(np.concatenate(sets), return_inverse=True)[1]
    owner = np.repeat(np.arange(len(sets)), sizes)[np.argsort(term, kind="stable")]
    ends = np.cumsum(np.bincount(term))
    counts = np.diff(ends, prepend=0)
    starts = np.cumsum(sizes) - sizes
    group = np.unique(root, return_inverse=True)[1]
    seen, out = np.zeros(len(sets), bool), []
    while len(rest := np.flatnonzero(~seen & (group != np.bincount(group).argmax()))):
        i = rest[0]
        seen[i] = True
        mine = term[starts[i] : starts[i] + sizes[i]]
        n = counts[mine]
        postings = owner[np.repeat(ends[mine] - np.cumsum(n), n) + np.arange(n.sum())]
        both = np.bincount(postings, minlength=len(sets))
        for j in np.flatnonzero((both / (sizes[i] + sizes - both) >= similarity) & (group != group[i])):
            if group[i] != group[j]:
                out.append((int(node[i]), int(node[j])))
                group[group == group[j]] = group[i]
    return out
