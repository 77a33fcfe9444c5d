"""The corpus pipeline: from documents to packed training sequences.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last keep the columns of ``documents``. Nulls, empty tables and repeated rows
have the results that the operators state.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.lineage import scratch
from gleaner.llm import langid, linededup, packing, simhash

#: A text whose shortest code is longer than its bytes is in none of the learned languages.
MAX_BITS_PER_BYTE = 8.0


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language: no text, no letter, or worse coded by every language than by none.

    A null ``lang`` becomes the language predicted; a given one is left alone.
    """
    known = langid.identify(docs, langid.train(docs), keep=tuple(docs.columns))
    known = known.where((F.col("lang_pred") != "und") & (F.col("bits_per_byte") <= MAX_BITS_PER_BYTE))
    return known.select(*(F.coalesce("lang", "lang_pred").alias(c) if c == "lang" else F.col(c) for c in docs.columns))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines that are boilerplate on their source, where equal texts count as one page; ``n_chars`` follows the text."""
    kept = linededup.dedup_lines(docs, copies_once=True)
    return kept.select(*((F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(c)) for c in docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, that with the smallest doc_id, of each group of near-duplicates."""
    return simhash.drop_near_dups(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 2048 tokens."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("pack", pack)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is written to the shared folder before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            path = scratch(spark, name)
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
