"""Identity keys of a media file and the model namespaces of the vector cache."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumaspark.functions.paths import _col, basename_of


def _key(name: Column, size, modified) -> Column:
    return F.concat_ws(":", name, _col(size).cast("string"), F.unix_millis(_col(modified).cast("timestamp")).cast("string"))


def cache_key(name="name", size="size", modified="last_modified") -> Column:
    """Folder-independent key: basename, size and modification time in ms."""
    return _key(basename_of(name), size, modified)


def path_key(name="name", size="size", modified="last_modified") -> Column:
    """Full-path key used by sessions, captions and caches of older builds."""
    return _key(_col(name), size, modified)


def caption_key(name="name", size="size", modified="last_modified") -> Column:
    return F.concat(F.lit("@caption/"), path_key(name, size, modified))


def model_namespace(variant) -> Column:
    """Key prefix of a model variant."""
    v = _col(variant)
    return (
        F.when(v == "chrome-ai", F.lit("@chrome-ai/"))
        .when(v == "sapiens2-fp16", F.lit("@sapiens2/"))
        .when(v.startswith("sapiens2"), F.concat(F.lit("@"), v, F.lit("/")))
        .otherwise(F.lit(""))
    )
