"""Line dedup by site-relative frequency.

Lines are counted for each host by the pages that contain them; a line on more
than a given share of its host's pages is boilerplate there and is dropped from
them. DataFrame functions only: lines travel as 16-byte digests, counts are
combined before the shuffle, and texts are not shuffled at all while the
boilerplate lines are few enough to be sent to every executor.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lineage import pin

#: Boilerplate digests up to this number are broadcast (some 4 MB); beyond it the join is shuffled, with salt.
BROADCAST_LINES = 100_000
SALTS = 32


def _digest(line: F.Column) -> F.Column:
    return F.unhex(F.md5(line))


def boilerplate(docs: DataFrame, host_col: str = "source", text_col: str = "text", ratio: float = 0.08, min_pages: int = 5, copies_once: bool = False) -> DataFrame:
    """``(host, line, pages, host_pages)``: digests of lines on more than ``ratio`` of a host's pages, and on ``min_pages`` at least.

    A line counts once for each page. Blank lines and pages without a host
    don't count; a page without a text counts to its host's total.
    With ``copies_once`` pages of a host with equal texts count as one, in its
    total too; otherwise every row is a page.
    """
    filled = F.filter(F.split(F.col(text_col), "\n", -1), lambda x: F.trim(x) != "")
    digests = F.array_distinct(F.transform(filled, _digest))
    src = docs.select(F.col(host_col).alias("host"), digests.alias("lines"), _digest(F.coalesce(F.col(text_col), F.lit("\x00null"))).alias("page")).where("host is not null")
    pages = src.groupBy("host", "page").agg(F.first("lines").alias("lines")) if copies_once else src
    totals = pages.groupBy("host").agg(F.count("*").alias("host_pages"))
    lines = pages.select("host", F.explode("lines").alias("line"))
    counts = lines.groupBy("host", "line").agg(F.count("*").alias("pages")).where(F.col("pages") >= min_pages)
    return counts.join(totals, "host").where(F.col("pages") > ratio * F.col("host_pages"))


def dedup_lines(docs: DataFrame, host_col: str = "source", text_col: str = "text", ratio: float = 0.08, min_pages: int = 5, copies_once: bool = False) -> DataFrame:
    """``docs`` with boilerplate lines dropped from ``text_col``, and ``lines_kept`` and ``lines_dropped`` (blank lines count as kept).

    Every row stays: a text may become empty, a null text stays null with no
    lines, and rows with a null host are left alone. Of a host only
    ``1 / ratio`` times its mean number of lines can be boilerplate, which
    bounds what is gathered for it. Columns already named like the two counts
    are replaced. Without ``copies_once`` (see ``boilerplate``) a text that
    makes over ``ratio`` of its host's rows is boilerplate as a whole.
    """
    found = boilerplate(docs, host_col, text_col, ratio, min_pages, copies_once)
    found = pin(found.groupBy("host").agg(F.collect_list("line").alias("__drop")).withColumnRenamed("host", "__host"))
    small = (found.agg(F.sum(F.size("__drop"))).first()[0] or 0) <= BROADCAST_LINES
    docs = docs.drop("lines_kept", "lines_dropped")
    if small:
        joined = docs.join(F.broadcast(found), docs[host_col] == found["__host"], "left")
    else:
        salted = found.withColumn("__s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        dealt = docs.withColumn("__salt", F.pmod(F.xxhash64(*docs.columns), F.lit(SALTS)).cast("int"))
        joined = dealt.join(salted, (dealt[host_col] == salted["__host"]) & (dealt["__salt"] == salted["__s"]), "left")
    lines = F.split(F.col(text_col), "\n", -1)
    kept = F.filter(lines, lambda x: (F.trim(x) == "") | ~F.coalesce(F.array_contains("__drop", _digest(x)), F.lit(False)))
    text = F.when(F.col("__drop").isNull() | F.col(text_col).isNull(), F.col(text_col)).otherwise(F.array_join("__kept", "\n"))
    return joined.withColumn("__kept", kept).select(
        *((text.alias(c) if c == text_col else F.col(c)) for c in docs.columns),
        F.coalesce(F.size("__kept"), F.lit(0)).cast("long").alias("lines_kept"),
        F.coalesce(F.size(lines) - F.size("__kept"), F.lit(0)).cast("long").alias("lines_dropped"),
    )
