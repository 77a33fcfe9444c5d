"""Salary weights, sampling, retrieval evaluation, market value and cost projections."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.salary import annual_salary, usd_only
from ..lineage import pin

# --- salary -----------------------------------------------------------------


def salary_weights(df: DataFrame, month: str = "month", low: float = 0.25, high: float = 4.0) -> DataFrame:
    """``df`` with ``annual_salary``, ``salary_usable`` and ``salary_weight``: log1p over its month's mean, clipped."""
    usable = F.col("annual_salary").isNotNull() & usd_only(df.columns) & F.col(month).isNotNull()
    out = df.withColumn("annual_salary", annual_salary(df.columns)).withColumn("salary_usable", usable)
    raw = F.when(F.col("salary_usable"), F.log1p("annual_salary"))
    # the mean is joined from a partial aggregate: a window by month would gather a month in one task
    mean = out.select(month, raw.alias("__r")).where("__r is not null").groupBy(F.col(month).alias("__m")).agg(F.avg("__r").alias("__mean"))
    out = out.join(F.broadcast(mean), F.col(month) == F.col("__m"), "left")  # one row for each time bin
    weight = F.when((F.col("__mean") > 0) & raw.isNotNull(), F.least(F.greatest(raw / F.col("__mean"), F.lit(low)), F.lit(high)))
    return out.withColumn("salary_weight", weight).drop("__m", "__mean")


def salary_summary(weighted: DataFrame) -> DataFrame:
    """Rows used, coverage, rows excluded by currency, rows unusable."""
    return weighted.agg(
        F.count("salary_weight").alias("salary_rows_used"),
        F.when(F.count("*") > 0, F.count("salary_weight") / F.nullif(F.count("*"), F.lit(0))).otherwise(0.0).alias("salary_coverage"),
        F.count_if(F.col("annual_salary").isNotNull() & ~usd_only(weighted.columns)).alias("salary_non_usd_excluded"),
        F.count_if(~F.col("salary_usable")).alias("salary_missing_or_unusable"),
    )


def support_flags(df: DataFrame, support: str, low: int = 1000) -> DataFrame:
    """Plot data: a flag for low support and a marker size by the root of the share of the largest."""
    top = df.agg(F.max(support).alias("__top"))
    size = F.when(F.col("__top") > 0, 40.0 + 160.0 * F.sqrt(F.col(support) / F.col("__top"))).otherwise(40.0)
    return df.crossJoin(F.broadcast(top)).withColumns({"low_support": F.col(support) < low, "marker_size": size}).drop("__top")


# --- sampling ---------------------------------------------------------------


def stride_sample(df: DataFrame, n: int, ts: str, time_bin: str, id_col: str) -> DataFrame:
    """About n rows evenly over time, with each bin's first row if n allows; ties in time by id.

    Rows are numbered by a distributed sort and the counts of its partitions,
    so no task sees all of them.
    """
    if n <= 0:
        raise ValueError("the sample size must be positive")
    rows = df.where(F.col(ts).isNotNull())
    total = rows.count()
    firsts = rows.groupBy(time_bin).agg(F.min(F.struct(ts, id_col)).alias("__f"))
    bins = firsts.count()
    if not total:
        return rows
    if n >= bins:
        marked = rows.join(F.broadcast(firsts.select(F.col(f"__f.{id_col}").alias("__id"))), F.col(id_col) == F.col("__id"), "left").withColumn("__must", F.col("__id").isNotNull()).drop("__id")
        rest, slots = total - bins, n - bins
        numbered = number_rows(marked.where(~F.col("__must")), [ts, id_col])
        step = max(1, rest // slots) if slots > 0 else 1
        chosen = numbered.where((F.col("__n") % step == 0) & (F.col("__n") / step < slots)).drop("__n") if slots > 0 else numbered.where(F.lit(False)).drop("__n")
        return marked.where("__must").unionByName(chosen).drop("__must").orderBy(ts, id_col).limit(n)
    step = max(1, total // n)
    numbered = number_rows(rows, [ts, id_col])
    picked = numbered.where((F.col("__n") % step == 0) & (F.col("__n") / step < n))
    ends = rows.select(ts, id_col, time_bin).orderBy(F.desc(ts), F.desc(id_col)).first()
    last = picked.orderBy(F.desc("__n")).first()
    if last[time_bin] != ends[time_bin]:
        picked = picked.where(F.col("__n") != last["__n"]).unionByName(numbered.where(F.col("__n") == total - 1))
    return picked.drop("__n")


def number_rows(df: DataFrame, order: list[str]) -> DataFrame:
    """``df`` with ``__n``, its position from 0 in the given order: sorted in parts, whose sizes are added up.

    The parts are pinned, as a second range partitioning may be cut elsewhere.
    """
    parts = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__p", F.spark_partition_id())
    parts = parts.withColumn("__m", F.monotonically_increasing_id() - F.shiftleft(F.col("__p").cast("long"), 33))
    parts = pin(parts)
    sizes = {r["__p"]: r["n"] for r in parts.groupBy("__p").agg(F.count("*").alias("n")).collect()}
    start, at = [], 0
    for p in range(max(sizes, default=-1) + 1):
        start.append(at)
        at += sizes.get(p, 0)
    offset = F.get(F.array(*map(F.lit, start)).cast("array<long>"), F.col("__p")) if start else F.lit(0)
    return parts.withColumn("__n", (F.col("__m") + offset).cast("long")).drop("__p", "__m")


def hash_sample(df: DataFrame, n: int, id_col: str, seed: int = 42) -> DataFrame:
    """n rows by a hash of id and seed: the same ones however the table is partitioned."""
    return df.orderBy(F.xxhash64(F.col(id_col), F.lit(seed)), id_col).limit(n)


def head_sample(df: DataFrame, n: int, order: list[str]) -> DataFrame:
    return df.orderBy(*order).limit(n)


# --- retrieval evaluation ---------------------------------------------------


def rank_triplets(scores: DataFrame) -> DataFrame:
    """``(query_id, rank, label)`` from ``(query_id, label, score)``: best first, a tie ranks the positive first."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("label"))
    return scores.select("query_id", F.row_number().over(w).alias("rank"), "label")


def retrieval_metrics(ranked: DataFrame, k: int) -> DataFrame:
    """recall@k, MRR@k and nDCG@k (gain 2^label - 1, ideal over the full ranking), averaged over queries."""
    if k <= 0:
        raise ValueError("k must be positive")
    gain = (F.pow(F.lit(2.0), F.col("label")) - 1.0)
    ideal = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("label"), "rank"))
    rows = ranked.withColumn("ideal", ideal)
    hit = (F.col("label") > 0) & (F.col("rank") <= k)
    at = lambda r: F.sum(F.when(F.col(r) <= k, gain / F.log2(F.col(r) + 1.0)).otherwise(0.0))
    per = rows.groupBy("query_id").agg(F.max(hit.cast("int")).alias("recall"), F.min(F.when(hit, F.col("rank"))).alias("first"), at("rank").alias("dcg"), at("ideal").alias("idcg"))
    return per.agg(
        F.count("*").alias("n_queries"), F.coalesce(F.avg("recall"), F.lit(0.0)).alias("recall"),
        F.coalesce(F.avg(F.coalesce(1.0 / F.col("first"), F.lit(0.0))), F.lit(0.0)).alias("mrr"),
        F.coalesce(F.avg(F.when(F.col("idcg") > 0, F.col("dcg") / F.col("idcg")).otherwise(0.0)), F.lit(0.0)).alias("ndcg"),
    )


def hard_negative_error(scores: DataFrame) -> DataFrame:
    """The share of hard triplets ``(positive, negative, difficulty)`` whose negative scores no less; 0 of none."""
    hard = scores.where(F.lower("difficulty").contains("hard"))
    return hard.agg(F.count("*").alias("n_hard"), F.coalesce(F.avg((F.col("negative") >= F.col("positive")).cast("double")), F.lit(0.0)).alias("hard_negative_error_rate"))


# --- market value and costs -------------------------------------------------


def endpoint_bins(metrics: DataFrame, min_jobs: int = 100) -> DataFrame:
    """``(first_bin, last_bin)`` among bins with ``min_jobs`` jobs, else among all."""
    totals = metrics.groupBy("time_bin").agg(F.sum("n_jobs").alias("n"))
    ends = totals.agg(*(f(F.when(F.col("n") >= min_jobs, F.col("time_bin"))).alias(f"{x}1") for x, f in (("a", F.min), ("b", F.max))), *(f("time_bin").alias(f"{x}2") for x, f in (("a", F.min), ("b", F.max))))
    return ends.select(F.coalesce("a1", "a2").alias("first_bin"), F.coalesce("b1", "b2").alias("last_bin"))


#: Fixed value: the salary where no row has one.
DEFAULT_SALARY = 75_000.0


def market_value(metrics: DataFrame, total: float | None = None, min_jobs: int = 100) -> DataFrame:
    """Share x total x median salary of each label in the first and the last bin.

    A label has one salary at both ends: that of its last bin's row, or of its
    first's if it has none there. A missing salary is the median of all rows,
    or ``DEFAULT_SALARY`` if no row has one. ``total`` is, unless given, the
    sum over labels of the last bin's (else the first's) number of jobs, 1 at least.
    """
    ends = endpoint_bins(metrics, min_jobs)
    typical = metrics.agg(F.coalesce(F.median("salary_median"), F.lit(DEFAULT_SALARY)).alias("typical"))
    rows = metrics.crossJoin(F.broadcast(ends)).crossJoin(F.broadcast(typical)).where("time_bin in (first_bin, last_bin)")  # one row each
    rows = rows.withColumn("salary", F.coalesce("salary_median", "typical"))
    at = lambda c, b: F.max(F.when(F.col("time_bin") == F.col(b), F.col(c)))
    late = lambda c: F.coalesce(at(c, "last_bin"), at(c, "first_bin"))
    found = rows.groupBy("cluster_label").agg(at("share_jobs", "first_bin").alias("a"), at("share_jobs", "last_bin").alias("b"), late("salary").alias("salary"), late("n_jobs").alias("n_jobs"))
    jobs = found.agg(F.greatest(F.coalesce(F.sum("n_jobs"), F.lit(0)), F.lit(1)).alias("jobs"))
    size = F.lit(float(total)) if total is not None else F.col("jobs")
    value = lambda c: F.coalesce(c, F.lit(0.0)) * size * F.col("salary")
    found = found.crossJoin(F.broadcast(jobs)).select("cluster_label", "n_jobs", value(F.col("a")).alias("value_first"), value(F.col("b")).alias("value_last"))
    return found.withColumn("value_delta", F.col("value_last") - F.col("value_first"))


def tiered_cost(amount: F.Column, tiers: list[tuple[float, float, float]]) -> F.Column:
    """Sum over tiers (from, to, price) of what falls in each."""
    total = F.lit(0.0)
    for low, high, price in tiers:
        total = total + F.greatest(F.least(amount, F.lit(high)) - F.lit(low), F.lit(0.0)) * price
    return total


def storage_projection(spark, months: int, growth: float, jobs_per_month: float, gb_per_job: float, tiers: list[tuple[float, float, float]]) -> DataFrame:
    """Monthly jobs by compound growth, cumulative storage, and its tiered cost."""
    rows = spark.range(months).select(F.col("id").alias("month"), (F.lit(jobs_per_month) * F.pow(F.lit(1.0 + growth), F.col("id"))).alias("jobs"))
    w = Window.orderBy("month").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # one row for each month of the horizon
    rows = rows.withColumn("total_gb", F.sum(F.col("jobs") * gb_per_job).over(w))
    return rows.withColumn("monthly_cost", tiered_cost(F.col("total_gb"), tiers))


def step_price(month: F.Column, steps: list[tuple[str, float]]) -> F.Column:
    """The price of the last step whose first month is not after ``month``; the first step's before that."""
    price = F.lit(steps[0][1])
    for start, value in steps[1:]:
        price = F.when(month >= start, F.lit(value)).otherwise(price)
    return price


def salary_coverage_plot(by_month: DataFrame, low: int = 30) -> DataFrame:
    """Coverage clipped to 0..1 with a flag for few salaries, and the overall coverage: all salaries over all jobs."""
    overall = by_month.agg(F.when(F.sum("n_jobs") > 0, F.sum("n_salary_jobs") / F.nullif(F.sum("n_jobs"), F.lit(0))).otherwise(0.0).alias("overall_coverage"))
    clipped = F.least(F.greatest(F.col("salary_coverage"), F.lit(0.0)), F.lit(1.0))
    return by_month.crossJoin(F.broadcast(overall)).withColumns({"salary_coverage": clipped, "low_support": F.col("n_salary_jobs") < low})


def label_union(before: DataFrame, after: DataFrame, label: str, value: str) -> DataFrame:
    """Every label of either table with its value in both, 0 where it is absent."""
    a, b = before.select(label, F.col(value).alias(f"{value}_first")), after.select(label, F.col(value).alias(f"{value}_last"))
    out = a.join(b, label, "full_outer")
    return out.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in (f"{value}_first", f"{value}_last")})


def enrichment_candidates(jobs: DataFrame, domains: DataFrame, skills: str, n: int, id_col: str = "job_id") -> DataFrame:
    """The first n jobs by id that have no skills or an uncertain domain."""
    from ..functions.text import non_empty

    found = jobs.join(domains.select(id_col, "is_uncertain"), id_col, "left")
    return found.where(~non_empty(F.col(skills)) | F.coalesce("is_uncertain", F.lit(True))).orderBy(id_col).limit(n)
