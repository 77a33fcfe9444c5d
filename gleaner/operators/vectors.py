"""Centroids, drift and top-k similarity over keyed dense vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vector import cosine_distance, dot, unit


def mean_vectors(df: DataFrame, keys: list[str], vector: str, weight: Column | None = None) -> DataFrame:
    """``keys``, ``n`` and ``centroid``: the (weighted) mean of each group's vectors.

    Components are averaged by position with partial aggregation, so a group
    of any size is never gathered; only the result's components are.
    """
    w = F.lit(1.0) if weight is None else weight
    long = df.select(*keys, w.alias("__w"), F.posexplode(vector).alias("__i", "__x"))
    if weight is not None:
        long = long.where("__w is not null")
    mean = F.sum(F.col("__w") * F.col("__x").cast("double")) / F.sum("__w")
    parts = long.groupBy(*keys, "__i").agg(mean.alias("__m"), F.count("*").alias("n"))
    ordered = F.array_sort(F.collect_list(F.struct("__i", "__m")))
    return parts.groupBy(*keys).agg(F.max("n").alias("n"), F.transform(ordered, lambda x: x["__m"]).alias("centroid"))


def drift(centroids: DataFrame, order: str, partition: list[str] | None = None, keep_first: bool = True) -> DataFrame:
    """Cosine distance of each centroid to the one of the bin before that is present.

    One row for each bin; the first has null drift, or is left out.
    """
    w = Window.partitionBy(*(partition or [])).orderBy(order)
    out = centroids.withColumns({f"previous_{order}": F.lag(order).over(w), "__before": F.lag("centroid").over(w)})
    out = out.withColumn("centroid_drift", F.when(F.col("__before").isNotNull(), cosine_distance(F.col("__before"), F.col("centroid"))))
    out = out.withColumn("cosine_similarity", 1.0 - F.col("centroid_drift")).drop("__before")
    return out if keep_first else out.where(F.col(f"previous_{order}").isNotNull())


def normalized(centroids: DataFrame) -> DataFrame:
    return centroids.withColumn("centroid", unit(F.col("centroid")))


def top_k(vectors: DataFrame, query_id: int, k: int, id_col: str, vector: str, least: float = 0.0) -> DataFrame:
    """The k rows nearest to one row by inner product, ``(rank, id, score)``, without itself.

    Scores below ``least`` are dropped after the k are chosen, so there may be
    fewer. The query is one row, so it is sent to every task; the k best are
    kept in each task before they meet. KeyError if there is no such row.
    """
    query = vectors.where(F.col(id_col) == query_id).select(F.col(vector).alias("__q")).limit(1)
    if query.isEmpty():
        raise KeyError(query_id)
    scored = vectors.where(F.col(id_col) != query_id).crossJoin(F.broadcast(query)).select(F.col(id_col), dot(F.col(vector), F.col("__q")).alias("score"))
    best = scored.orderBy(F.desc("score"), id_col).limit(k)
    rank = F.row_number().over(Window.orderBy(F.desc("score"), id_col))  # k rows
    return best.select(rank.alias("rank"), id_col, "score").where(F.col("score") >= least)


def similarity_pairs(vectors: DataFrame, id_col: str, vector: str, rows: int = 500) -> DataFrame:
    """``(id_a, id_b, similarity)`` of all ordered pairs of different rows among the first ``rows`` by id: a fixed-size report."""
    some = vectors.orderBy(id_col).limit(rows)
    a, b = some.select(F.col(id_col).alias("id_a"), F.col(vector).alias("va")), some.select(F.col(id_col).alias("id_b"), F.col(vector).alias("vb"))
    return a.join(F.broadcast(b), F.col("id_a") != F.col("id_b")).select("id_a", "id_b", dot(F.col("va"), F.col("vb")).alias("similarity"))


def similarity_summary(pairs: DataFrame) -> DataFrame:
    return pairs.agg(F.countDistinct("id_a").alias("n_rows"), F.count("*").alias("n_pairs"), F.avg("similarity").alias("mean_similarity"), F.median("similarity").alias("median_similarity"))
