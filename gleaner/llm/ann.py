"""Approximate nearest neighbours: stable projections, kd-trees, a chi-square stopping test.

Largest inner products are smallest distances once every vector is given one
more component that brings it to the largest length of all. A Gaussian
(2-stable) projection to ``width`` dimensions turns a distance d into one whose
square, divided by d^2, is chi-square distributed; a kd-tree over the projected
points yields candidates by increasing projected distance. Candidates are
verified by their exact inner product until, by the chi-square distribution,
a point that lies beyond the next projected distance is closer than the k-th
found one with a probability of ``1 - confidence`` at most.

The tree's top is fitted on a bounded sample; its leaves split the corpus, and
large leaves are split further by hash, into shards that are a row each. Queries
near each other travel together, as a row for each shard that the stopping test
leaves open for some of them: first of the nearest leaf, then of the next few,
then of all others, with a tighter test each time.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..lineage import pin
from .common import kind_of

#: Rows that the top of the tree is fitted on at most, and its leaves at most: both bound what the driver holds.
FIT_ROWS, MAX_LEAVES = 8192, 4096
SHARD_ROWS, BLOCK_QUERIES, BUCKET = 4096, 2048, 128
#: Leaves that are searched between one stopping test and the next: the nearest, the next few, the rest.
ROUNDS = ((0, 1), (1, 4), (4, MAX_LEAVES))
#: Relative rounding that a matrix product may have against the sum of a vector's products in order.
_SLACK = 1e-10


def chi2_cdf(x: np.ndarray, freedom: int) -> np.ndarray:
    """Chi-square distribution function for an even number of degrees of freedom."""
    half = np.minimum(x, 1400.0) / 2
    term, total = np.ones_like(half), np.ones_like(half)
    for i in range(1, freedom // 2):
        term = term * half / i
        total = total + term
    return 1 - np.exp(-half) * total


class Top:
    """The kd-tree's top levels: median splits along the widest dimension of a sample."""

    def __init__(self, sample: np.ndarray, leaves: int) -> None:
        self.splits: list[tuple[int, float, int, int]] = []  # dimension, value, below (negative: a leaf), above
        self.leaves = 0
        self.root = self._grow(sample, leaves)

    def _grow(self, points: np.ndarray, leaves: int) -> int:
        spread = np.ptp(points, axis=0) if len(points) else np.zeros(1)
        if leaves < 2 or len(points) < 2 or not spread.max() > 0:
            self.leaves += 1
            return -self.leaves
        dim = int(spread.argmax())
        value = float(np.median(points[:, dim]))
        below = points[:, dim] < value
        if not below.any():
            value = float(points[:, dim][points[:, dim] > value].min())
            below = points[:, dim] < value
        at = len(self.splits)
        self.splits.append((0, 0.0, 0, 0))
        self.splits[at] = (dim, value, self._grow(points[below], leaves // 2), self._grow(points[~below], leaves - leaves // 2))
        return at

    def leaf_of(self, points: np.ndarray) -> np.ndarray:
        out = np.zeros(len(points), np.int64)
        stack = [(self.root, np.arange(len(points)))]
        while stack:
            node, rows = stack.pop()
            if node < 0:
                out[rows] = -node - 1
            else:
                dim, value, below, above = self.splits[node]
                low = points[rows, dim] < value
                stack += [(below, rows[low]), (above, rows[~low])]
        return out


def bucket_tree(points: np.ndarray, size: int = BUCKET) -> list[np.ndarray]:
    """Rows of a kd-tree's buckets."""
    out, stack = [], [np.arange(len(points))]
    while stack:
        rows = stack.pop()
        spread = np.ptp(points[rows], axis=0)
        if len(rows) <= size or not spread.max() > 0:
            out += [rows[i : i + size] for i in range(0, len(rows), size)]
            continue
        order = rows[np.argpartition(points[rows, spread.argmax()], len(rows) // 2)]
        stack += [order[: len(rows) // 2], order[len(rows) // 2 :]]
    return out


def box_distance(points: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distance of each point to each box."""
    out = np.zeros((len(points), len(low)))
    for d in range(points.shape[1]):
        x = points[:, d, None]
        out += np.maximum(np.maximum(low[:, d] - x, x - high[:, d]), 0) ** 2
    return out


class Search:
    """The k nearest of one shard for a block of queries, by incremental kd-tree search."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, projected: np.ndarray, top: float, k: int, confidence: float) -> None:
        self.ids, self.vectors, self.top, self.k, self.confidence = ids, vectors, top, k, confidence
        self.width = projected.shape[1]
        self.buckets = bucket_tree(projected)
        self.low = np.stack([projected[b].min(0) for b in self.buckets])
        self.high = np.stack([projected[b].max(0) for b in self.buckets])

    def closed(self, bound: np.ndarray, kth: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether the test holds: ``bound`` squared projected distances, ``kth`` best inner products, query lengths."""
        with np.errstate(divide="ignore", invalid="ignore"):
            # the query is brought to the length ``top`` too, which changes no order
            distance = 2 * self.top**2 - 2 * kth * np.where(length > 0, self.top / length, 0)
            return np.isfinite(kth) & (chi2_cdf(bound / np.maximum(distance, 1e-300), self.width) >= self.confidence)

    def scores(self, queries: np.ndarray, cand: np.ndarray, floor: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Inner products of at least ``floor``, else -inf; a matrix product leaves out most of the others."""
        rough = queries @ self.vectors[cand].T
        row, col = np.nonzero(rough >= (floor - _SLACK * length * self.top)[:, None])
        out = np.full(rough.shape, -np.inf)
        for a in range(0, len(row), 1 << 14):
            r, c = row[a : a + (1 << 14)], col[a : a + (1 << 14)]
            # summed in the same order wherever a vector stands, so that equal vectors tie exactly
            out[r, c] = np.einsum("pd,pd->p", queries[r], self.vectors[cand[c]])
        return out

    def run(self, ids: np.ndarray, vectors: np.ndarray, projected: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows (of the queries), candidate ids and scores; ``known`` are k-th best inner products from elsewhere."""
        n, k = len(ids), self.k
        best, who = np.full((n, k), -np.inf), np.full((n, k), np.iinfo(np.int64).max)
        length = np.sqrt((vectors**2).sum(1))
        near = box_distance(projected, self.low, self.high)
        order = near.argsort(1, kind="stable")
        live = np.arange(n)
        for step in range(len(self.buckets)):
            at = order[live, step]
            kth = np.maximum(best[live, -1], known[live])
            live_on = ~self.closed(near[live, at], kth, length[live])
            live, at, kth = live[live_on], at[live_on], kth[live_on]
            if not len(live):
                break
            by = at.argsort(kind="stable")
            for rows in np.split(by, np.flatnonzero(np.diff(at[by])) + 1):
                q, cand = live[rows], self.buckets[at[rows[0]]]
                score = self.scores(vectors[q], cand, kth[rows], length[q])
                score[ids[q][:, None] == self.ids[cand][None]] = -np.inf
                some = score.max(1) > -np.inf
                q, score = q[some], score[some]
                if not len(q):
                    continue
                score = np.concatenate([best[q], score], axis=1)
                name = np.concatenate([who[q], np.broadcast_to(self.ids[cand], (len(q), len(cand)))], axis=1)
                first = np.lexsort((name, -score), axis=1)[:, :k]
                best[q], who[q] = np.take_along_axis(score, first, 1), np.take_along_axis(name, first, 1)
        row, col = np.nonzero(np.isfinite(best))
        return row, who[row, col], best[row, col]


def _valid(v: object) -> np.ndarray | None:
    if v is None:
        return None
    x = np.array([np.nan if c is None else c for c in v], np.float64)
    return x if len(x) and np.isfinite(x).all() and x.any() else None


def _vectors(df: DataFrame, kind: str) -> DataFrame:
    """``(id, vec, dim, norm)`` of the rows that take part, repeated rows once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            made = [_valid(v) for v in pdf.v]
            ok = [x is not None for x in made]
            good = [x for x in made if x is not None]
            yield pd.DataFrame({"id": pdf.id[ok].to_numpy(np.int64), "vec": [x.astype(kind).tobytes() for x in good], "dim": [len(x) for x in good], "norm": [float(np.sqrt(x @ x)) for x in good]})

    return df.where("id is not null").mapInPandas(run, "id long, vec binary, dim int, norm double").distinct()


def _stack(column: pd.Series, dim: int, kind: str = "f8") -> np.ndarray:
    return np.frombuffer(b"".join(column), kind).astype(np.float64).reshape(-1, dim)


def _packed(df: DataFrame, by: list[str], columns: dict[str, str]) -> DataFrame:
    """A row for each group of ``by``, with ``columns`` (name to NumPy kind, or "" for bytes) put together in a blob each."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        made = {c: b"".join(pdf[c]) if not kind else pdf[c].to_numpy(kind).tobytes() for c, kind in columns.items()}
        return pd.DataFrame({**{c: pdf[c].iloc[:1] for c in by}, **{c: [v] for c, v in made.items()}})

    return df.groupBy(*by).applyInPandas(run, ", ".join([*(f"{c} long" for c in by), *(f"{c} binary" for c in columns)]))


def search(vectors: DataFrame, queries: F.Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", width: int = 8, confidence: float = 0.95, seed: int = 11) -> DataFrame:
    """``(query_id, rank, id, score)``: of every row for which ``queries`` holds, the k nearest other rows by inner product.

    Nearest first, ties to the smaller id; all candidates if fewer than k.
    Vectors that are null, empty, zero or not finite, and null ids, take no
    part; rows that repeat an id and a vector count once. Of equal vectors only
    the k + 1 with the smallest ids can be among a query's k nearest, so the
    others are left out before the search. Vectors of different dimension have
    no inner product: each dimension is searched by itself.
    """
    spark, kind = vectors.sparkSession, kind_of(vectors, vector_col)
    named = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"), F.coalesce(queries, F.lit(False)).alias("q"))
    rows = pin(_vectors(named.select("id", "v"), kind))
    wanted = named.where("q").select("id").distinct()
    parts = []
    for shape in rows.groupBy("dim").agg(F.count("*").alias("n"), F.max("norm").alias("top")).orderBy("dim").collect():
        found = _Dimension(shape["dim"], shape["top"], k, width, confidence, seed, kind).search(rows.where(F.col("dim") == shape["dim"]), wanted, shape["n"])
        parts.append(found.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), "score"))
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], f"query_id long, rank int, `{id_col}` long, score double")


def _blocks(counts: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """First block and number of blocks for each home leaf: neighbouring leaves share one, and a leaf with many queries has several."""
    out, block, held = [], 0, 0
    for home, n in sorted(counts):
        if held and held + n > BLOCK_QUERIES:
            block, held = block + 1, 0
        more = max(1, -(-n // BLOCK_QUERIES))
        out.append((home, block, more))
        block, held = (block + more, 0) if more > 1 else (block, held + n)
    return out


class _Dimension:
    """The search among vectors of one dimension, whose largest length is ``top``."""

    def __init__(self, dim: int, top: float, k: int, width: int, confidence: float, seed: int, kind: str) -> None:
        self.dim, self.top, self.k, self.width, self.confidence, self.kind = dim, top, k, width, confidence, kind
        self.frame = np.random.default_rng([seed, dim]).normal(size=(dim + 1, width))

    def project(self, vec: np.ndarray, norm: np.ndarray, is_query: bool) -> np.ndarray:
        if is_query:
            return (vec * (self.top / norm)[:, None]) @ self.frame[: self.dim]
        return vec @ self.frame[: self.dim] + np.sqrt(np.maximum(self.top**2 - norm**2, 0))[:, None] * self.frame[self.dim]

    def placed(self, df: DataFrame, tree: Top, is_query: bool) -> DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                if len(pdf):
                    p = self.project(_stack(pdf.vec, self.dim, self.kind), pdf.norm.to_numpy(), is_query)
                    yield pd.DataFrame({"id": pdf.id, "vec": pdf.vec, "proj": [x.tobytes() for x in p], "leaf": tree.leaf_of(p), "p": list(p)})

        return df.select("id", "vec", "norm").mapInPandas(run, "id long, vec binary, proj binary, leaf long, p array<double>")

    def search(self, rows: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
        """``(query_id, rank, id, score)`` for the rows whose id is in ``wanted``."""
        spark, k = rows.sparkSession, self.k
        first = Window.partitionBy("vec").orderBy("id")
        cand = rows.withColumn("r", F.row_number().over(first)).where(F.col("r") <= k + 1).drop("r")
        sample = cand.select("vec", "norm", "id").orderBy(F.xxhash64("id"), "id").limit(FIT_ROWS).toPandas()
        leaves = min(MAX_LEAVES, max(1, 1 << max(0, math.ceil(math.log2(max(1, n) / SHARD_ROWS)))))
        tree = Top(self.project(_stack(sample.vec, self.dim, self.kind), sample.norm.to_numpy(), False), leaves)
        cand = pin(self.placed(cand, tree, False))
        edge = [f(F.col("p")[d]).alias(f"{name}{d}") for d in range(self.width) for name, f in (("lo", F.min), ("hi", F.max))]
        boxes = cand.groupBy("leaf").agg(F.count("*").alias("n"), *edge).orderBy("leaf").toPandas()  # MAX_LEAVES rows at most
        shards = np.maximum(1, -(-boxes["n"].to_numpy() // SHARD_ROWS)).astype(np.int64)
        split = F.broadcast(spark.createDataFrame([(int(x), int(s)) for x, s in zip(boxes["leaf"], shards, strict=True)], "leaf long, shards long"))
        cand = cand.join(split, "leaf").withColumn("shard", F.pmod(F.xxhash64("id", "vec"), F.col("shards")))
        held = pin(_packed(cand.select("leaf", "shard", "id", "vec", "proj"), ["leaf", "shard"], {"id": "i8", "vec": "", "proj": ""}))

        asked = pin(self.placed(rows.join(wanted, "id"), tree, True).withColumnRenamed("leaf", "home").drop("p").withColumn("q", F.monotonically_increasing_id()))
        blocks = F.broadcast(spark.createDataFrame(_blocks(asked.groupBy("home").count().collect()), "home long, start long, blocks long"))  # MAX_LEAVES rows at most
        asked = asked.join(blocks, "home").withColumn("block", F.col("start") + F.pmod(F.xxhash64("q"), F.col("blocks"))).drop("home", "start", "blocks")
        nearest = Window.partitionBy("q").orderBy(F.desc("score"), "id")
        best, state = None, asked.withColumn("kth", F.lit(float("-inf")))
        for span in ROUNDS:
            if span[0] >= len(boxes):
                break
            found = self.visit(state, held, boxes, shards, span)
            found = found if best is None else best.drop("rank").unionByName(found)
            best = pin(found.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= k))
            kth = best.groupBy("q").agg(F.min("score").alias("kth"), F.count("*").alias("n")).where(F.col("n") == k).drop("n")
            state = asked.join(kth, "q", "left").withColumn("kth", F.coalesce("kth", F.lit(float("-inf"))))
        if best is None:
            return spark.createDataFrame([], "query_id long, rank int, id long, score double")
        return best.join(asked.select("q", F.col("id").alias("query_id")), "q").select("query_id", "rank", "id", "score")

    def visit(self, state: DataFrame, held: DataFrame, boxes: pd.DataFrame, shards: np.ndarray, span: tuple[int, int]) -> DataFrame:
        """``(q, id, score)`` from the leaves that are ``span`` in order of distance from a query and that its test leaves open."""
        low, high = (boxes[[f"{x}{d}" for d in range(self.width)]].to_numpy() for x in ("lo", "hi"))
        names = boxes["leaf"].to_numpy()
        test = Search.__new__(Search)
        test.top, test.width, test.confidence = self.top, self.width, self.confidence

        def decoded(row: object) -> list[np.ndarray]:
            q, asked = (np.frombuffer(x, np.int64) for x in (row.q, row.asked))
            return [q, asked, np.frombuffer(row.qvec, self.kind).reshape(len(q), -1), np.frombuffer(row.qproj).reshape(len(q), -1), np.frombuffer(row.kth)]

        def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for row in pdf.itertuples():
                    parts = decoded(row)
                    _, _, vec, proj, kth = parts
                    away = box_distance(proj, low, high)
                    length = np.sqrt((vec.astype(np.float64) ** 2).sum(1))
                    go = ~test.closed(away, kth[:, None], length[:, None])
                    rank = away.argsort(1, kind="stable").argsort(1, kind="stable")
                    go &= (rank >= span[0]) & (rank < span[1])
                    for j in np.flatnonzero(go.any(0)):
                        blobs = [x[go[:, j]].tobytes() for x in parts]
                        yield pd.DataFrame([(names[j], s, *blobs) for s in range(shards[j])], columns=["leaf", "shard", "q", "asked", "qvec", "qproj", "kth"])

        def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            at, there = None, None
            for pdf in batches:
                for row in pdf.itertuples():
                    if at != (row.leaf, row.shard):
                        ids = np.frombuffer(row.id, np.int64)
                        there = Search(ids, _stack([row.vec], self.dim, self.kind), _stack([row.proj], self.width), self.top, self.k, self.confidence)
                        at = (row.leaf, row.shard)
                    q, asked, vec, proj, kth = decoded(row)
                    i, who, score = there.run(asked, vec.astype(np.float64), proj, kth)
                    yield pd.DataFrame({"q": q[i], "id": who, "score": score})

        named = state.select("block", "q", F.col("id").alias("asked"), F.col("vec").alias("qvec"), F.col("proj").alias("qproj"), "kth")
        together = _packed(named, ["block"], {"q": "i8", "asked": "i8", "qvec": "", "qproj": "", "kth": "f8"})
        routed = together.mapInPandas(route, "leaf long, shard long, q binary, asked binary, qvec binary, qproj binary, kth binary")
        return routed.join(held, ["leaf", "shard"]).mapInPandas(look, "q long, id long, score double")
