"""Path expressions. Built on substring functions only, so they stay inside codegen."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The media kinds that a catalogue accepts.
IMAGE_EXTS = ("jpg", "jpeg", "png", "gif", "webp", "avif", "bmp", "tiff", "tif", "heic", "heif")
VIDEO_EXTS = ("mp4", "webm")
MEDIA_EXTS = IMAGE_EXTS + VIDEO_EXTS

ROOT_LABEL = "(root)"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _last_segment(c: Column) -> Column:
    return F.substring_index(c, "/", -1)


def _parent(c: Column) -> Column:
    """Everything before the last slash, empty when there is none."""
    keep = F.length(c) - F.length(_last_segment(c)) - 1
    return F.substring(c, F.lit(1), F.greatest(keep, F.lit(0)))


def basename_of(c) -> Column:
    """Last path segment; a path that ends in a slash is its own basename."""
    c = _col(c)
    return F.coalesce(F.nullif(_last_segment(c), F.lit("")), c)


def folder_of(c) -> Column:
    return F.coalesce(F.nullif(_parent(_col(c)), F.lit("")), F.lit(ROOT_LABEL))


def media_ext(c) -> Column:
    """Lower-cased last dot part of the file name; a dotless name is its own extension."""
    return F.lower(F.substring_index(_last_segment(_col(c)), ".", -1))


def media_kind(c) -> Column:
    """'video', 'image' or null for anything a catalogue rejects."""
    ext = media_ext(c)
    return F.when(ext.isin(*VIDEO_EXTS), F.lit("video")).when(ext.isin(*IMAGE_EXTS), F.lit("image"))


def is_media(c, exts=MEDIA_EXTS) -> Column:
    return media_ext(c).isin(*exts)


def is_hidden(c) -> Column:
    """True when any segment of the path starts with a dot."""
    c = _col(c)
    return c.startswith(".") | c.contains("/.")


def path_prefixes(df: DataFrame, name: str = "name", key: str = "media_id") -> DataFrame:
    """Folder breadcrumbs: one row per ancestor folder with its target and parent target.

    A file at the root yields the single root crumb, which has no parent.
    """
    folders = F.split(_parent(F.col(name)), "/")
    crumbs = F.when(
        F.col(name).contains("/"),
        F.transform(
            F.sequence(F.lit(1), F.size(folders)),
            lambda i: F.struct(
                i.alias("depth"),
                F.get(folders, i - 1).alias("label"),
                F.array_join(F.slice(folders, F.lit(1), i), "/").alias("target"),
                F.array_join(F.slice(folders, F.lit(1), i - 1), "/").alias("parent"),
            ),
        ),
    ).otherwise(
        F.array(
            F.struct(
                F.lit(0).alias("depth"),
                F.lit(ROOT_LABEL).alias("label"),
                F.lit("").alias("target"),
                F.lit(None).cast("string").alias("parent"),
            )
        )
    )
    return df.select(key, F.inline(crumbs))
