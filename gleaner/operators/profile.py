"""Profiles of a jobs table."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..contracts import assert_columns
from ..functions.text import non_empty, split_profile, strip
from ..functions.time import valid_epoch_ms

# Columns that a profile reports on if they are there.
DATETIME = ("listed_time", "original_listed_time", "expiry", "closed_time")
SALARY = ("normalized_salary", "min_salary", "max_salary", "med_salary", "pay_period", "currency", "compensation_type")
LOCATION = ("location", "formatted_work_type", "formatted_experience_level", "work_type", "remote_allowed")


def token_counts(df: DataFrame, column: str, top: int | None = None) -> DataFrame:
    """``(token, n)`` of a comma-separated column, most frequent first, ties by token."""
    found = df.select(F.explode(split_profile(F.col(column))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    return found.orderBy(F.desc("n"), "token").limit(top) if top else found.orderBy(F.desc("n"), "token")


def value_counts(df: DataFrame, column: str, top: int | None = None) -> DataFrame:
    """``(value, n)`` of a column's non-blank values, most frequent first, ties by value."""
    found = df.select(strip(F.col(column)).alias("value")).where("value <> ''").groupBy("value").agg(F.count("*").alias("n"))
    found = found.orderBy(F.desc("n"), "value")
    return found.limit(top) if top else found


def parse_rate(column: str) -> tuple[F.Column, F.Column, F.Column]:
    """Rows with a value, rows with a valid epoch-millisecond time, and their ratio (1.0 of none)."""
    total, parsed = F.count(column), F.count_if(valid_epoch_ms(F.col(column)))
    return total.alias(f"{column}_n_total"), parsed.alias(f"{column}_n_parsed"), F.when(total > 0, F.round(parsed / F.nullif(total, F.lit(0)), 6)).otherwise(1.0).alias(f"{column}_parse_rate")


def summary(df: DataFrame) -> DataFrame:
    """One row of counts over the whole table, in a single aggregation."""
    timed = [c for c in ("listed_time", "expiry", "closed_time") if c in df.columns]
    return df.agg(
        F.count("*").alias("n_postings"), F.countDistinct("job_id").alias("n_unique_job_ids"),
        *(F.count_if(~non_empty(F.col(c))).alias(a) for c, a in (("title", "n_missing_titles"), ("description", "n_missing_descriptions"), ("skills_text", "n_jobs_without_skills"))),
        *(x for c in timed for x in parse_rate(c)),
        *(F.count(c).alias(f"{c}_non_null") for c in SALARY if c in df.columns),
    )


def profile(df: DataFrame) -> dict[str, Any]:
    """The whole profile as a dict; absent columns have None."""
    assert_columns(df, ("job_id", "title", "description", "skills_text"), "profile")
    one = summary(df).first().asDict()
    pairs = lambda d: [(r[0], r[1]) for r in d.collect()]
    have = lambda names: [c for c in names if c in df.columns]
    counts = lambda c: dict(pairs(value_counts(df, c))) if c in df.columns else None
    out: dict[str, Any] = {k: one[k] for k in ("n_postings", "n_unique_job_ids", "n_missing_titles", "n_missing_descriptions", "n_jobs_without_skills")}
    out["n_unique_skills"] = df.select(F.explode(split_profile(F.col("skills_text"))).alias("s")).agg(F.countDistinct("s")).first()[0]
    out["top_20_skills"] = [{"skill": s, "count": n} for s, n in pairs(token_counts(df, "skills_text", 20))]
    out["datetime_columns_present"] = have(DATETIME)
    for c in ("listed_time", "expiry", "closed_time"):
        out |= {f"{c}_{x}": one.get(f"{c}_{x}") for x in ("parse_rate", "n_total", "n_parsed")}
    out["salary_columns_present"] = have(SALARY)
    out["salary_non_null_counts"] = {c: one[f"{c}_non_null"] for c in have(SALARY)}
    out["location_columns_present"] = have(LOCATION)
    out["work_type_distribution"], out["experience_level_distribution"] = counts("formatted_work_type"), counts("formatted_experience_level")
    out["location_top_20"] = [{"location": s, "count": n} for s, n in pairs(value_counts(df, "location", 20))] if "location" in df.columns else None
    out["remote_allowed_distribution"] = counts("remote_allowed")
    return out
