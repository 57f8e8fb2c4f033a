"""Tag-map expressions: coordinates, presence and the labelled detail rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumaspark.functions.paths import _col

# Known tags and their labels, in display order.
EXIF_LABELS = (
    ("Make", "Camera Make"),
    ("Model", "Camera Model"),
    ("LensModel", "Lens"),
    ("FNumber", "Aperture"),
    ("ExposureTime", "Shutter Speed"),
    ("ISO", "ISO"),
    ("FocalLength", "Focal Length"),
    ("FocalLengthIn35mmFormat", "35mm Equiv."),
    ("DateTimeOriginal", "Date Taken"),
    ("CreateDate", "Date Created"),
    ("ImageWidth", "Width"),
    ("ImageHeight", "Height"),
    ("Orientation", "Orientation"),
    ("Flash", "Flash"),
    ("WhiteBalance", "White Balance"),
    ("ExposureMode", "Exposure Mode"),
    ("ExposureProgram", "Exposure Program"),
    ("MeteringMode", "Metering Mode"),
    ("ColorSpace", "Color Space"),
    ("Software", "Software"),
    ("Artist", "Artist"),
    ("Copyright", "Copyright"),
    ("latitude", "Latitude"),
    ("longitude", "Longitude"),
)


def _number(exif: Column, key: str) -> Column:
    return F.try_element_at(exif, F.lit(key)).try_cast("double")


def gps_of(exif) -> Column:
    """Coordinates when both are numbers, else null."""
    lat, lon = _number(_col(exif), "latitude"), _number(_col(exif), "longitude")
    return F.when(lat.isNotNull() & lon.isNotNull(), F.struct(lat.alias("latitude"), lon.alias("longitude")))


def _degrees(c: Column, decimals: int) -> Column:
    return F.when(c.isNotNull(), F.format_string(f"%.{decimals}f", F.round(c, decimals)))


def gps_text(gps) -> Column:
    g = _col(gps)
    return F.when(g.isNotNull(), F.concat(_degrees(g["latitude"], 5), F.lit(", "), _degrees(g["longitude"], 5)))


def gps_link(gps) -> Column:
    g = _col(gps)
    return F.when(
        g.isNotNull(),
        F.concat(
            F.lit("https://www.openstreetmap.org/?mlat="), _degrees(g["latitude"], 5),
            F.lit("&mlon="), _degrees(g["longitude"], 5), F.lit("&zoom=15"),
        ),
    )


def has_exif(exif) -> Column:
    return F.coalesce(F.size(F.map_keys(_col(exif))) > 0, F.lit(False))


def _display(exif: Column, key: str) -> Column:
    raw = F.try_element_at(exif, F.lit(key))
    if key == "FNumber":
        return F.concat(F.lit("f/"), raw)
    if key == "ExposureTime":
        seconds = raw.try_cast("double")
        share = F.round(F.lit(1.0) / F.nullif(seconds, F.lit(0.0)), 0).cast("bigint").cast("string")
        return F.when(seconds < 1, F.concat(F.lit("1/"), share, F.lit("s"))).otherwise(F.concat(raw, F.lit("s")))
    if key in ("FocalLength", "FocalLengthIn35mmFormat"):
        return F.concat(raw, F.lit("mm"))
    if key in ("latitude", "longitude"):
        return _degrees(raw.try_cast("double"), 6)
    return raw


def exif_rows(df: DataFrame, exif: str = "exif", key: str = "media_id") -> DataFrame:
    """One row per known, non-empty tag: its place, label and display text.

    The label list is fixed, so the map is unpivoted in place, with no join.
    """
    m = F.col(exif)
    rows = F.array(
        *(
            F.struct(F.lit(i).alias("ord"), F.lit(label).alias("label"),
                     F.when(F.try_element_at(m, F.lit(tag)) != "", _display(m, tag)).alias("value"))
            for i, (tag, label) in enumerate(EXIF_LABELS)
        )
    )
    return df.where(has_exif(exif)).select(key, F.inline(rows)).where(F.coalesce(F.col("value"), F.lit("")) != "")
