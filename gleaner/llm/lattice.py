"""Near-duplicate vectors by E8 lattice hashing.

Each table projects the normalised vector to 8 dimensions by a random
orthonormal frame and decodes it to the nearest point of the E8 lattice; that
cell and the neighbouring cells nearest to the vector are its keys. Vectors
that share a key are compared by their exact cosine. Two vectors on either
side of a cell's border meet in a cell between them, as both probe.

Equal vectors with equal labels are one class throughout; a cell with many
classes is split into blocks, and every pair of blocks is a group of bounded
size with a task to itself. A pair that meets in several cells counts in the
smallest of its common keys alone, so groups return numbers of links, which
add up, and what connects their classes, but no pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, combinations, pairwise, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lineage import pin
from .common import components, kind_of, mapped, small


def e8_roots() -> np.ndarray:
    """The 240 shortest vectors of E8: which cells neighbour a cell."""
    out = []
    for i, j in combinations(range(8), 2):
        for s, t in product((1.0, -1.0), repeat=2):
            out.append(np.zeros(8))
            out[-1][[i, j]] = s, t
    out += [np.array(h) for h in product((0.5, -0.5), repeat=8) if sum(x < 0 for x in h) % 2 == 0]
    return np.array(out)


def _nearest_d8(x: np.ndarray) -> np.ndarray:
    """The nearest integer points with an even sum."""
    near = np.rint(x)
    off = x - near
    worst = np.abs(off).argmax(1)
    row = np.arange(len(x))
    odd = near.sum(1) % 2 != 0
    near[row[odd], worst[odd]] += np.where(off[row, worst] >= 0, 1.0, -1.0)[odd]
    return near


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """The nearest lattice point of each row: E8 is D8 and D8 moved by halves."""
    whole, half = _nearest_d8(x), _nearest_d8(x - 0.5) + 0.5
    closer = ((x - whole) ** 2).sum(1) <= ((x - half) ** 2).sum(1)
    return np.where(closer[:, None], whole, half)


class Hasher:
    """Keys of unit vectors of one dimension: ``tables`` x (1 + ``probes``) cells."""

    def __init__(self, dim: int, tables: int = 2, probes: int = 8, scale: float = 1.5, seed: int = 7) -> None:
        rng = np.random.default_rng([seed, dim])
        width = max(dim, 8)
        self.frames = [np.linalg.qr(rng.normal(size=(width, 8)))[0][:dim] * np.sqrt(width) / scale for _ in range(tables)]
        self.mix = rng.integers(1, 1 << 62, size=9, dtype=np.int64) * 2 + 1
        self.probes, self.roots = probes, e8_roots()

    def keys(self, unit: np.ndarray, salt: np.ndarray) -> np.ndarray:
        """A row of 64-bit keys for each vector; ``salt`` tells labels apart."""
        out = []
        for t, frame in enumerate(self.frames):
            x = unit @ frame
            home = nearest_e8(x)
            away = (((x - home)[:, None] - self.roots) ** 2).sum(2)
            near = np.argpartition(away, self.probes - 1, axis=1)[:, : self.probes]
            cells = np.concatenate([home[:, None], home[:, None] + self.roots[near]], axis=1)
            with np.errstate(over="ignore"):
                key = ((2 * cells).astype(np.int64) * self.mix[:8]).sum(2) + (salt[:, None] + t) * self.mix[8]
                key ^= key >> 29
                key *= self.mix[0]
                out.append(key ^ (key >> 32))
        return np.concatenate(out, axis=1)


def unit_of(v: object) -> np.ndarray | None:
    """The vector in double precision divided by its length; None if null, empty, zero or not finite."""
    if v is None:
        return None
    x = np.array([np.nan if c is None else c for c in v], np.float64)
    if not len(x) or not np.isfinite(x).all():
        return None
    top = np.abs(x).max()
    return x / top / np.sqrt(((x / top) ** 2).sum()) if top > 0 else None


def _hashed(vectors: DataFrame, how: dict) -> DataFrame:
    """``(id, salt, vec, keys)`` of ``(id, salt, bare, v)``: the vector's bytes and keys, both null where it takes no part."""
    kind = kind_of(vectors, "v")
    hashers: dict[int, Hasher] = {}

    def make(salts: list[int], bare: list[bool], vectors: list) -> Iterator[tuple[range, list]]:
        for a in range(0, len(vectors), 2048):
            part = range(a, min(a + 2048, len(vectors)))
            units = {i: u for i in part if not bare[i] and (u := unit_of(vectors[i])) is not None}
            keys: dict[int, np.ndarray] = {}
            for dim in {len(u) for u in units.values()}:
                rows = [i for i, u in units.items() if len(u) == dim]
                hasher = hashers.setdefault(dim, Hasher(dim, **how))
                keys |= zip(rows, hasher.keys(np.stack([units[i] for i in rows]), np.array([salts[i] for i in rows], np.int64)), strict=True)
            yield part, [[salts[i] for i in part], [np.asarray(vectors[i], kind).tobytes() if i in keys else None for i in part], [keys.get(i) for i in part]]

    return mapped(vectors, ["salt", "bare", "v"], "salt long, vec binary, keys array<long>", make)


def _links_in(key: int, apart: tuple[int, int], part: dict[str, np.ndarray], unit: np.ndarray, threshold: float) -> tuple[np.ndarray, ...] | None:
    """Of a group's pairs whose smallest common key is the group's: the classes with links, how many vectors each links with, and the least class it is connected with."""
    cid, salt, n, keys = (part[c] for c in ("cid", "salt", "n", "keys"))
    i, j = apart
    if i == j:
        a, b = np.nonzero(unit @ unit.T >= threshold)
        ok = cid[a] < cid[b]
    else:
        left, right = np.flatnonzero(part["block"] == i), np.flatnonzero(part["block"] == j)
        a, b = np.nonzero(unit[left] @ unit[right].T >= threshold)
        a, b = left[a], right[b]
        ok = cid[a] != cid[b]
    ok &= salt[a] == salt[b]
    a, b = a[ok], b[ok]
    first = np.zeros(len(a), bool)
    for s in range(0, len(a), 4096):
        x, y = keys[a[s : s + 4096]], keys[b[s : s + 4096]]
        common = (x[:, :, None] == y[:, None, :]).any(2)
        first[s : s + 4096] = np.where(common, x, np.iinfo(np.int64).max).min(1) == key
    a, b = a[first], b[first]
    if not len(a):
        return None
    more, least, before = np.zeros(len(cid), np.int64), cid.copy(), None
    np.add.at(more, a, n[b])
    np.add.at(more, b, n[a])
    while before is None or (least != before).any():
        before = least.copy()
        np.minimum.at(least, a, before[b])
        np.minimum.at(least, b, before[a])
    rows = np.flatnonzero(more)
    return cid[rows], more[rows], least[rows]


def _units(vectors: list[bytes], kind: str) -> np.ndarray:
    """Unit vectors, in double precision, of vectors' bytes of one size."""
    unit = np.frombuffer(b"".join(vectors), kind).astype(np.float64).reshape(len(vectors), -1)
    unit /= np.abs(unit).max(1, keepdims=True)
    unit /= np.sqrt((unit**2).sum(1, keepdims=True))
    return unit


def class_links(classes: DataFrame, threshold: float, kind: str = "f8", block_rows: int = 512) -> DataFrame:
    """``(cid, more, least)`` of classes ``(cid, salt, vec, keys, n)`` that have a cosine of ``threshold`` at least with another.

    A class has a row for each group in which it has links: how many vectors
    they lead to (every pair of classes counts in one group, so the sums are
    exact), and the least class of the group that they connect it with. No
    pairs are returned, so that rows do not grow with the square of a group.
    Only the cells that have to be split are counted out to the rows, so
    vectors are shuffled once, to the group they are compared in.
    """
    rows = classes.select("cid", "salt", "vec", "keys", "n", F.explode(F.array_distinct("keys")).alias("key"))
    large = classes.select(F.explode(F.array_distinct("keys")).alias("key")).groupBy("key").agg(F.count("*").alias("held")).where(F.col("held") > block_rows)
    large = small(pin(large.select("key", F.ceil(F.col("held") / block_rows).cast("int").alias("blocks"))))
    met = rows.join(large, "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("block", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    # a row of block b goes to the pairs of blocks (i, j), i <= j, that b is one of
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "cid", "salt", "vec", "keys", "n", F.octet_length("vec").alias("size_of"))
    by = ["key", "i", "j", "size_of"]
    dealt = met.repartition("key", "i", "j").sortWithinPartitions(*by)

    def groups(rows: pa.RecordBatch, edges: list[int]) -> Iterator[tuple[np.ndarray, ...]]:
        part = {c: rows.column(c).to_numpy() for c in ("key", "i", "j", "block", "cid", "salt", "n")}
        part["keys"] = rows.column("keys").flatten().to_numpy().reshape(rows.num_rows, -1)
        vec = rows.column("vec").to_pylist()
        for s, e in pairwise(edges):
            if e - s > 1:
                mine = {c: x[s:e] for c, x in part.items()}
                links = _links_in(mine["key"][0], (mine["i"][0], mine["j"][0]), mine, _units(vec[s:e], kind), threshold)
                if links:
                    yield links

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.RecordBatch | None = None
        for batch in chain(batches, [None]):
            rows = rest if batch is None else batch if rest is None else pa.concat_batches([rest, batch])
            if rows is None or not rows.num_rows:
                continue
            k = np.stack([rows.column(c).to_numpy() for c in by])
            edges = [0, *(np.flatnonzero((k[:, 1:] != k[:, :-1]).any(0)) + 1).tolist(), rows.num_rows]
            if batch is not None:  # the last group may go on
                rest = rows.slice(edges[-2])
                edges.pop()
            found = list(groups(rows, edges))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], ["cid", "more", "least"])

    return dealt.mapInArrow(run, "cid long, more long, least long")


def near_dups(vectors: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", tables: int = 2, probes: int = 8, scale: float = 1.5) -> DataFrame:
    """``(id, n_links, component_id, kept)`` of every row.

    Rows link if their labels are equal and not null and their cosine, in
    double precision, is ``threshold`` at least. Rows with a null label, or
    with a vector that is null, empty, zero or not finite, link with nothing;
    vectors of different dimension never do. Each row is a vector of its own:
    rows that repeat an id and a vector link with each other. A null id is
    returned, but names no component. An empty table gives an empty result.
    """
    rows = vectors.select(F.col(id_col).alias("id"), F.xxhash64(F.col(label_col).cast("string")).alias("salt"), F.col(label_col).isNull().alias("bare"), F.col(vector_col).alias("v"))
    kind = kind_of(rows, "v")
    rows = pin(_hashed(rows, {"tables": tables, "probes": probes, "scale": scale}))
    good = rows.where("vec is not null")
    classes = good.groupBy("salt", "vec").agg(F.min("id").alias("first"), F.count("*").alias("n"), F.first("keys").alias("keys"))
    classes = pin(classes.withColumn("cid", F.monotonically_increasing_id()))
    links = pin(class_links(classes.select("cid", "salt", "vec", "keys", "n"), threshold, kind))
    degree = links.groupBy(F.col("cid").alias("a")).agg(F.sum("more").alias("more"))
    comp = components(links, "cid", "least")
    full = classes.join(degree, classes.cid == degree.a, "left").join(comp, F.col("cid") == F.col("node"), "left")
    full = pin(full.select("salt", "vec", "first", (F.col("n") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"), F.coalesce("root", "cid").alias("root")))
    named = full.groupBy("root").agg(F.min("first").alias("component_id"))
    full = full.join(named, "root").select(F.col("salt").alias("s"), F.col("vec").alias("u"), "n_links", "component_id")
    out = rows.select("id", "salt", "vec").join(full, (F.col("salt") == F.col("s")) & (F.col("vec") == F.col("u")), "left")
    comp_id = F.when(F.col("u").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), comp_id.alias("component_id"), (F.col("id") == comp_id).alias("kept"))
