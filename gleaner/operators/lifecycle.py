"""Durations, observed survival and exponential decay."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.time import days_between


def durations(df: DataFrame, posted: str, closed: str | None, last_seen: str | None = None, keys: tuple[str, ...] = ("cluster_id",)) -> DataFrame:
    """``keys``, ``duration_days``, ``event_observed``: days to closure, else to the last sighting, which observes no event.

    Rows without a duration, or with a negative one, are left out, so that in
    closure mode every row is an event. ValueError if neither column is given.
    """
    end = closed or last_seen
    if end is None:
        raise ValueError("no closure or last-seen column")
    out = df.select(*keys, days_between(F.col(posted), F.col(end)).alias("duration_days"), F.lit(closed is not None).alias("event_observed"))
    return out.where(F.col("duration_days") >= 0)


def exponential_decay(rows: DataFrame, key: str = "cluster_id", min_rows: int = 5, min_events: int = 1) -> DataFrame:
    """Events over time at risk for each group, with half-life and mean lifetime; null and a warning where data are too few."""
    found = rows.groupBy(key).agg(F.count("*").alias("n_rows"), F.count_if("event_observed").alias("n_events"), F.sum("duration_days").alias("total_time_at_risk_days"))
    enough = (F.col("n_rows") >= min_rows) & (F.col("n_events") >= min_events) & (F.col("total_time_at_risk_days") > 0)
    rate = F.when(enough, F.col("n_events") / F.col("total_time_at_risk_days"))
    some = F.when(rate > 0, rate)
    note = F.when(~enough, F.format_string("insufficient data: n=%d, events=%d", "n_rows", "n_events")).otherwise("")
    return found.select(
        key, "n_rows", "n_events", (F.col("n_rows") - F.col("n_events")).alias("n_censored"), "total_time_at_risk_days",
        rate.alias("lambda"), (F.log(F.lit(2.0)) / some).alias("half_life_days"), (1.0 / some).alias("mean_lifetime_days"), note.alias("warning"),
    )


def observed_survival(rows: DataFrame, key: str = "cluster_id") -> DataFrame:
    """``(key, duration_days, survival)``: products of 1 - events / at risk over event times.

    At risk are a group's rows less those censored before the time; earlier
    events stay in it, so this is not the Kaplan-Meier estimate. A group's
    curve starts at (0, 1); a group without events has none. Once a factor is
    zero, the curve is.
    """
    at = rows.groupBy(key, "duration_days").agg(F.count_if("event_observed").alias("events"), F.count_if(~F.col("event_observed")).alias("censored"), F.count("*").alias("n"))
    order = Window.partitionBy(key).orderBy("duration_days")
    before = F.coalesce(F.sum("censored").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    risk = F.greatest(F.sum("n").over(Window.partitionBy(key)) - before, F.lit(1))
    steps = at.withColumn("risk", risk).where("events > 0").withColumn("factor", F.greatest(F.lit(0.0), 1.0 - F.col("events") / F.col("risk")))
    run = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    logs = F.exp(F.sum(F.log(F.when(F.col("factor") > 0, F.col("factor")))).over(run))
    curve = steps.select(key, "duration_days", F.when(F.min("factor").over(run) <= 0, 0.0).otherwise(logs).alias("survival"))
    start = steps.select(key).distinct().select(key, F.lit(0.0).alias("duration_days"), F.lit(1.0).alias("survival"))
    return start.unionByName(curve)


def kaplan_meier(rows: DataFrame, key: str = "cluster_id") -> DataFrame:
    """``(key, duration_days, survival)`` with the usual risk set: rows that last at least as long."""
    at = rows.groupBy(key, "duration_days").agg(F.count_if("event_observed").alias("events"), F.count("*").alias("n"))
    after = Window.partitionBy(key).orderBy("duration_days").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    run = Window.partitionBy(key).orderBy("duration_days").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    steps = at.withColumn("factor", 1.0 - F.col("events") / F.sum("n").over(after)).where("events > 0")
    logs = F.exp(F.sum(F.log(F.when(F.col("factor") > 0, F.col("factor")))).over(run))
    return steps.select(key, "duration_days", F.when(F.min("factor").over(run) <= 0, 0.0).otherwise(logs).alias("survival"))


def dense_survival(curve: DataFrame, longest: float, points: int = 90, key: str = "cluster_id") -> DataFrame:
    """The curve's step function on an even grid and at its own steps: an as-of join by union and last value."""
    ends = curve.groupBy(key).agg(F.greatest(F.max("duration_days"), F.lit(float(longest))).alias("end"))
    grid = ends.select(key, F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i"), "end").select(key, (F.col("i") * F.col("end") / (points - 1)).alias("duration_days"), F.lit(None).cast("double").alias("survival"))
    steps = curve.groupBy(key, "duration_days").agg(F.min("survival").alias("survival"))  # of two at one time the later, which is lower
    both = grid.unionByName(steps).groupBy(key, "duration_days").agg(F.max("survival").alias("survival"))
    w = Window.partitionBy(key).orderBy("duration_days").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return both.select(key, "duration_days", F.coalesce(F.last("survival", ignorenulls=True).over(w), F.lit(1.0)).alias("survival"))


def axis_scale(longest: float) -> tuple[float, str]:
    """Hours if nothing lasts more than three days."""
    return (24.0, "hours") if longest <= 3.0 else (1.0, "days")
