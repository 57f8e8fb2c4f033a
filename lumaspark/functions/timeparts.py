"""Date and time expressions: filters that reach the scan, labels, breadcrumbs, histograms."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumaspark.functions.paths import _col

GRANULARITIES = ("year", "month", "day", "hour", "minute")

_LABEL_FORMAT = {
    "year": "yyyy",
    "month": "yyyy-MM",
    "day": "yyyy-MM-dd",
    "hour": "yyyy-MM-dd HH:00",
    "minute": "yyyy-MM-dd HH:mm",
}


def _bounds(year, month, day, hour, minute):
    """Half-open range of a prefix of parts, or None when a later part is set without an earlier one."""
    parts = [month, day, hour, minute]
    depth = next((i for i, p in enumerate(parts) if p is None), 4)
    if any(p is not None for p in parts[depth:]):
        return None
    lo = datetime(year, month or 1, day or 1, hour or 0, minute or 0)
    try:
        if depth == 0:
            hi = datetime(year + 1, 1, 1)
        elif depth == 1:
            hi = datetime(year + month // 12, month % 12 + 1, 1)
        else:
            hi = lo + {2: timedelta(days=1), 3: timedelta(hours=1), 4: timedelta(minutes=1)}[depth]
    except (ValueError, OverflowError):  # the last instants of year 9999
        hi = None
    return lo, hi


def filter_datetime(
    df: DataFrame, year: int, month: int | None = None, day: int | None = None,
    hour: int | None = None, minute: int | None = None, ts: str = "last_modified",
) -> DataFrame:
    """Files of one year, month, day, hour or minute (months count from 1).

    A prefix of parts becomes a range on the bare column, which Parquet can use to
    skip row groups; scattered parts ("any year-day at 14h") stay part-wise.
    """
    c = F.col(ts)
    try:
        bounds = _bounds(year, month, day, hour, minute)
    except ValueError:  # such as month 13: no instant matches
        return df.where(F.lit(False))
    if bounds:
        dtype = df.schema[ts].dataType
        lo, hi = (b and F.lit(b.isoformat(sep=" ")).cast(dtype) for b in bounds)
        return df.where((c >= lo) if hi is None else (c >= lo) & (c < hi))
    tests = [F.year(c) == year]
    for want, part in ((month, F.month), (day, F.day), (hour, F.hour), (minute, F.minute)):
        if want is not None:
            tests.append(part(c) == want)
    keep = tests[0]
    for t in tests[1:]:
        keep = keep & t
    return df.where(keep)


def datetime_parts(c) -> Column:
    """Zero-padded parts, each a drill-down target."""
    c = _col(c)
    return F.struct(
        F.date_format(c, "yyyy").alias("year"),
        F.date_format(c, "MM").alias("month"),
        F.date_format(c, "dd").alias("day"),
        F.date_format(c, "HH").alias("hour"),
        F.date_format(c, "mm").alias("minute"),
    )


def range_label(c, granularity) -> Column:
    """Text of the range that holds an instant; the granularity may vary by row."""
    c = _col(c)
    if isinstance(granularity, str):
        return F.date_format(c, _LABEL_FORMAT[granularity])
    out = F.lit(None).cast("string")
    for g in reversed(GRANULARITIES):
        out = F.when(granularity == g, F.date_format(c, _LABEL_FORMAT[g])).otherwise(out)
    return out


def datetime_histogram(df: DataFrame, granularity: str, ts: str = "last_modified") -> DataFrame:
    """Number of files per range, labelled; one map-side combined aggregation."""
    bucket = F.date_trunc(granularity, F.col(ts))
    return (
        df.groupBy(bucket.alias("_bucket")).agg(F.count(F.lit(1)).alias("n"))
        .select(range_label("_bucket", granularity).alias("label"), "n")
    )
