"""Salary expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Pay periods in a year.
MULTIPLIERS = {"YEARLY": 1.0, "MONTHLY": 12.0, "WEEKLY": 52.0, "BIWEEKLY": 26.0, "HOURLY": 2080.0}


def annual_salary(columns: list[str]) -> Column:
    """Normalised salary, else the median's, else the range's middle, for a year; null unless positive.

    A normalised salary that is not positive hides the others: positivity is
    asked last. ``columns`` are those the table has.
    """
    value = lambda name: F.col(name).try_cast("double") if name in columns else F.lit(None).cast("double")
    period = F.upper(F.coalesce(F.col("pay_period").cast("string"), F.lit(""))) if "pay_period" in columns else F.lit("")
    times = F.try_element_at(F.create_map(*(F.lit(x) for kv in MULTIPLIERS.items() for x in kv)), period)
    found = F.coalesce(value("normalized_salary"), value("med_salary") * times, (value("min_salary") + value("max_salary")) / 2 * times)
    return F.when(found > 0, found)


def usd_only(columns: list[str]) -> Column:
    """Currency is USD; blank is not."""
    return F.upper(F.coalesce(F.col("currency").cast("string"), F.lit(""))) == "USD" if "currency" in columns else F.lit(False)


def usd_or_blank(columns: list[str]) -> Column:
    """Currency is USD or blank; all rows if there is no such column."""
    return F.upper(F.coalesce(F.col("currency").cast("string"), F.lit(""))).isin("USD", "") if "currency" in columns else F.lit(True)
