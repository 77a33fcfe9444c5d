"""What the corpus operators share: rows through Python, key tables, connected components."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..lineage import pin

_SLICE = 1024  # rows that are Python objects at a time
#: Edges a task takes, about, when components are contracted.
EDGES = 50_000


def mapped(df: DataFrame, inputs: list[str], add: str, make: Callable[..., Iterable[tuple[Any, list[Any]]]]) -> DataFrame:
    """``df`` without ``inputs`` and with the columns that ``add`` names, made from them in Python.

    ``make`` takes the inputs' values, a list for each, and yields row numbers
    with the new columns of those rows; a number may come any times. The other
    columns stay in Arrow, so that ids keep their type and value whether or not
    there are nulls among them.
    """
    new = T._parse_datatype_string(add)
    keep = [c for c in df.columns if c not in inputs and c not in new.names]
    kinds = to_arrow_schema(new)

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from (batch.slice(a, _SLICE) for a in range(0, batch.num_rows, _SLICE))
            pa.default_memory_pool().release_unused()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            held = part.select(keep) if keep else None
            for rows, columns in make(*(part.column(c).to_pylist() for c in inputs)):
                old = held.take(pa.array(rows, pa.int64())).columns if held is not None else []
                made = [pa.array(c, f.type) for c, f in zip(columns, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*old, *made], schema=pa.schema([*(part.schema.field(c) for c in keep), *kinds]))

    return df.select(*keep, *inputs).mapInArrow(run, T.StructType([*(df.schema[c] for c in keep), *new.fields]))


def kind_of(vectors: DataFrame, column: str) -> str:
    """NumPy's name for the vectors' components: floats travel as floats, all else as doubles."""
    return "f4" if isinstance(vectors.schema[column].dataType.elementType, T.FloatType) else "f8"


def small(keys: DataFrame, most: int = 500_000) -> DataFrame:
    """A pinned table of keys, to be broadcast if it has ``most`` rows at most (some 30 MB); else the join is shuffled."""
    return F.broadcast(keys) if keys.count() <= most else keys


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return row["n"], row["x"] or 0


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an undirected edge list, as ``(node, root)``.

    Alternates large-star and small-star contractions until the edge set is a
    forest of stars; ``root`` is the smallest node reachable. Only nodes that
    have an edge appear (loops and null ends are ignored). Every step is a
    join and a partially aggregated minimum, so no neighbourhood is ever
    gathered in one task, and each round is cut by a checkpoint.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    e = pin(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = _state(e)
    while before[0]:
        few = -(-before[0] // EDGES)  # tasks for the edges that are left; without effect where there are fewer already
        both = e.coalesce(few).unionByName(e.coalesce(few).select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).coalesce(few).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        e = pin(
            small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(small.select("u", F.col("m").alias("v"))).coalesce(few).distinct().coalesce(few)
        )
        after = _state(e)
        if after == before:
            break
        before = after
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
