"""Coverage of time columns, volumes by bin, and the reliability gate."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..contracts import TEMPORAL
from ..functions.text import non_empty
from ..functions.time import iso_text, time_bin, with_time


def reliability(counts: dict[str, int], min_bins: int = 6, min_rows: int = 1000, unit: str = "month") -> dict[str, Any]:
    """How far bins of these sizes support statements about time."""
    bins = sorted(counts)
    low = {b: int(n) for b, n in sorted(counts.items()) if n < min_rows}
    notes: list[str] = []
    if len(bins) < 2:
        label = "demo_only"
        notes.append(f"Fewer than two valid {unit}s: drift cannot be compared.")
    elif len(bins) < min_bins:
        label = "limited_temporal_coverage"
        notes.append(f"Only {len(bins)} {unit}s: a comparison in time, not a stable trend.")
    else:
        label = "sufficient_temporal_coverage"
    limits: list[str] = []
    if len(bins) == 2:
        notes.append(f"Two {unit}s are a comparison of two buckets, not a trend.")
        limits.append(f"Two-{unit} output is not market evolution.")
    if low:
        notes.append(f"{unit.capitalize()}s below {min_rows} rows are noisy: " + ", ".join(f"{b}={n}" for b, n in low.items()))
    if bins and (bins[0] in low or bins[-1] in low):
        notes.append(f"The first or last {unit} has low support, so comparing them is noisy.")
    return {"label": label, "n_months": len(bins), "min_months_required": min_bins, "min_rows_per_month": min_rows, "low_support_months": low, "warnings": notes, "known_limitations": limits}


def volumes(df: DataFrame, ts: str = "ts", size: str = "M", label: str = "month") -> DataFrame:
    """``(label, rows)`` of rows that have a time."""
    return df.where(F.col(ts).isNotNull()).groupBy(time_bin(F.col(ts), size).alias(label)).agg(F.count("*").alias("rows"))


def coverage_by_bin(df: DataFrame, text: str | None, skills: str | None, ts: str = "ts", size: str = "M", label: str = "month") -> DataFrame:
    """Rows of each bin, how many have text and skills, and the shares; absent columns count as blank."""
    filled = lambda c: F.count_if(non_empty(F.col(c))) if c and c in df.columns else F.lit(0).cast("long")
    found = df.where(F.col(ts).isNotNull()).groupBy(time_bin(F.col(ts), size).alias(label)).agg(F.count("*").alias("rows"), filled(text).alias("text_non_empty"), filled(skills).alias("skills_non_empty"))
    share = lambda c: F.when(F.col("rows") > 0, F.col(c) / F.col("rows")).otherwise(0.0)
    return found.withColumns({"text_coverage": share("text_non_empty"), "skills_coverage": share("skills_non_empty")}).orderBy(label)


def column_coverage(df: DataFrame, columns: tuple[str, ...] = TEMPORAL) -> DataFrame:
    """One row for each time column that is there: valid rows, range, months, gate.

    The columns are unpivoted after parsing, so that one pass counts them all.
    """
    have = [c for c in columns if c in df.columns]
    parsed = df.select(*have)
    for c in have:
        parsed = with_time(parsed, c, f"ts_{c}", strict=True)
    spark = df.sparkSession
    schema = "time_column string, total_rows long, valid_rows long, invalid_or_missing_rows long, parse_success_rate double, min_date string, max_date string, number_of_months int, rows_per_month string, reliability_label string, warnings string"
    if not have:
        return spark.createDataFrame([], schema)
    long = parsed.select(F.explode(F.array(*(F.struct(F.lit(c).alias("c"), F.col(f"ts_{c}").alias("ts")) for c in have))).alias("x")).select("x.*")
    found = long.groupBy("c", time_bin(F.col("ts"), "M").alias("month")).agg(F.count("*").alias("n"), F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    found = found.withColumns({"lo": iso_text(F.col("lo")), "hi": iso_text(F.col("hi"))})
    rows = []
    held = found.collect()  # a row for each column and month
    for c in have:
        mine = [r for r in held if r["c"] == c]
        months = {r["month"]: r["n"] for r in sorted((r for r in mine if r["month"]), key=lambda r: r["month"])}
        total, valid = sum(r["n"] for r in mine), sum(months.values())
        gate = reliability(months)
        lows, highs = [r["lo"] for r in mine if r["lo"]], [r["hi"] for r in mine if r["hi"]]
        rows.append((c, total, valid, total - valid, valid / total if total else 0.0, min(lows, default=None), max(highs, default=None), len(months), json.dumps(months), gate["label"], json.dumps(gate["warnings"])))
    return spark.createDataFrame(rows, schema)


def audit(df: DataFrame, time_column: str = "listed_time", text: str = "job_card_text", skills: str = "skills_text") -> dict[str, Any]:
    """Summary, and the monthly, weekly, daily and column tables."""
    timed = with_time(df, time_column, "ts", strict=True)
    monthly = coverage_by_bin(timed, text, skills)
    total = timed.agg(F.count("*").alias("n"), F.count("ts").alias("valid"), iso_text(F.min("ts")).alias("lo"), iso_text(F.max("ts")).alias("hi")).first()
    months = {r["month"]: r["rows"] for r in monthly.select("month", "rows").collect()}
    gate = reliability(months)
    notes = gate["warnings"] + (["Fewer than 6 months: label temporal outputs as limited."] if len(months) < 6 else [])
    summary = {
        "time_column": time_column, "total_rows": total["n"], "valid_time_rows": total["valid"], "invalid_or_missing_time_rows": total["n"] - total["valid"],
        "parse_success_rate": total["valid"] / total["n"] if total["n"] else 0.0, "min_date": total["lo"], "max_date": total["hi"],
        "number_of_months": len(months), "rows_per_month": months, "warnings": notes, "reliability_label": gate["label"], "reliability": gate,
    }
    return {"summary": summary, "monthly": monthly, "weekly": volumes(timed, size="W", label="week").orderBy("week"), "daily": volumes(timed, size="D", label="day").orderBy("day"), "columns": column_coverage(df)}
