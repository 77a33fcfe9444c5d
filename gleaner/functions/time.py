"""Time expressions; the unit of numeric times is decided once for a whole column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _iso(c: Column) -> Column:
    return F.try_to_timestamp(F.when(~c.cast("string").rlike(r"^\s*[-+]?\d+(\.\d*)?\s*$"), c.cast("string")))


def _number(c: Column) -> Column:
    return F.expr(f"try_cast(`{c}` as double)") if isinstance(c, str) else c.try_cast("double")


def with_time(df: DataFrame, column: str, out: str = "ts", strict: bool = False) -> DataFrame:
    """``df`` with ``out``: the column's timestamp, or null where it has none.

    Timestamps are taken as they are. Of texts and numbers, ISO texts are read
    first; if the median year of what was read is before 1990 (a number is one
    too, as nanoseconds since 1970) or, unless ``strict``, nothing was read,
    the numbers are milliseconds or else seconds since 1970, if that gives the
    column a median year from 1990 to 2100. One aggregate decides for the
    column; rows are then read independently.
    """
    kind = df.schema[column].dataType
    c = F.col(column)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return df.withColumn(out, c.cast("timestamp"))
    numeric = isinstance(kind, T.NumericType)
    number = _number(c)
    iso = F.when(F.lit(numeric), F.timestamp_micros((number / 1000).cast("long"))).otherwise(_iso(c))
    span = 253402300799.0
    ms = F.when(F.abs(number) <= span * 1000, F.timestamp_millis(number.cast("long")))
    sec = F.when(F.abs(number) <= span, F.timestamp_seconds(number))
    median = lambda t: F.median(F.year(t))
    seen = df.agg(median(iso).alias("iso"), F.count(number).alias("n"), median(ms).alias("ms"), median(sec).alias("sec")).first()
    suspicious = (not strict) if seen["iso"] is None else seen["iso"] < 1990
    chosen = iso
    if seen["n"] and suspicious:
        for unit, expr in (("ms", ms), ("sec", sec)):
            if seen[unit] is not None and 1990 <= seen[unit] <= 2100:
                chosen = expr
                break
    return df.withColumn(out, chosen)


def time_bin(ts: Column, size: str = "M") -> Column:
    """Label of the hour, day, week (Monday/Sunday) or month; labels sort like time."""
    size = size.upper()
    if size == "H":
        return F.date_format(ts, "yyyy-MM-dd HH:00")
    if size == "D":
        return F.date_format(ts, "yyyy-MM-dd")
    if size == "W":
        start = F.date_trunc("week", ts)
        return F.concat_ws("/", F.date_format(start, "yyyy-MM-dd"), F.date_format(F.date_add(start, 6), "yyyy-MM-dd"))
    if size != "M":
        raise ValueError(f"unsupported time bin {size!r}")
    return F.date_format(ts, "yyyy-MM")


def bin_start(label: Column) -> Column:
    """The timestamp at which a bin's label starts; null if it is none."""
    first = F.split_part(label, F.lit("/"), F.lit(1))
    return F.coalesce(F.try_to_timestamp(first), F.try_to_timestamp(F.concat(first, F.lit("-01"))))


def valid_epoch_ms(c: Column) -> Column:
    """Whether a value is a number of milliseconds in the years 2000 to 2040."""
    return F.coalesce(c.try_cast("double").between(946684800000, 2240524799999), F.lit(False))


def days_between(start: Column, end: Column) -> Column:
    return (F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / F.lit(8.64e10)


def iso_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
