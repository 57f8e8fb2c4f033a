"""View state carried in a URL fragment: a folder, or an instant at some granularity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumaspark.functions.paths import _col

# Fixed value: the accepted date and time fragment.
_DT_PATTERN = r"^(\d{4})-(\d{2})-(\d{2})(?:T(\d{2}))?(?::(\d{2}))?\z"

_TYPE = "struct<type:string,path:string,granularity:string,year:int,month:int,day:int,hour:int,minute:int>"


def parse_view_state(c) -> Column:
    """Struct of a fragment, null when it is empty or malformed.

    Months count from 1. A part outside its range (month 13) is null.
    """
    c = _col(c)
    dt = F.when(c.startswith("#dt:"), F.substring(c, 5, 64))
    ok = dt.rlike(_DT_PATTERN)
    # \\z: a newline after the fragment makes it malformed. The pattern fixes every place, so one match is enough and the parts are substrings
    has_hour = F.substring(dt, 11, 1) == "T"
    has_minute = F.when(has_hour, F.length(dt) == 16).otherwise(F.length(dt) == 13)

    def part(text: Column, top: int, low: int = 0) -> Column:
        v = text.try_cast("int")
        return F.when(v.between(low, top), v)

    none_i, none_s = F.lit(None).cast("int"), F.lit(None).cast("string")
    instant = F.struct(
        F.lit("datetime").alias("type"), none_s.alias("path"),
        F.when(has_minute, F.lit("minute")).when(has_hour, F.lit("hour")).otherwise(F.lit("day")).alias("granularity"),
        part(F.substring(dt, 1, 4), 9999, 1).alias("year"), part(F.substring(dt, 6, 2), 12, 1).alias("month"),
        part(F.substring(dt, 9, 2), 31, 1).alias("day"), part(F.when(has_hour, F.substring(dt, 12, 2)), 23).alias("hour"),
        part(F.when(has_minute, F.substring(dt, -2, 2)), 59).alias("minute"),
    ).cast(_TYPE)
    folder = F.struct(
        F.lit("folder").alias("type"), F.substring(c, F.lit(9), F.length(c)).alias("path"),
        none_s.alias("granularity"), none_i.alias("year"), none_i.alias("month"),
        none_i.alias("day"), none_i.alias("hour"), none_i.alias("minute"),
    ).cast(_TYPE)
    return F.when(c.startswith("#folder:"), folder).when(ok, instant)


def format_view_state(state) -> Column:
    """Inverse of parse_view_state; also writes year-only and month-only states."""
    s = _col(state)

    def padded(field: str, sep: str) -> Column:
        return F.concat(F.lit(sep), F.lpad(s[field].cast("string"), 2, "0"))

    month = F.when(s["month"].isNotNull(), padded("month", "-"))
    day = F.when(s["month"].isNotNull() & s["day"].isNotNull(), padded("day", "-"))
    hour = F.when(day.isNotNull() & s["hour"].isNotNull(), padded("hour", "T"))
    minute = F.when(hour.isNotNull() & s["minute"].isNotNull(), padded("minute", ":"))
    blank = F.lit("")
    instant = F.concat(
        F.lit("#dt:"), s["year"].cast("string"),
        *(F.coalesce(p, blank) for p in (month, day, hour, minute)),
    )
    return (
        F.when(s["type"] == "folder", F.concat(F.lit("#folder:"), s["path"]))
        .when(s["type"] == "datetime", instant)
        .otherwise(F.lit("#"))
    )
