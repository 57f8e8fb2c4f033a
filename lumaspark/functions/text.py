"""Sizes, colours, hosts, error classes and other small text expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumaspark.functions.paths import _col

# Cluster colours, in cluster order, and the colour of an unclustered file.
CLUSTER_COLORS = ("#f87171", "#fb923c", "#facc15", "#4ade80", "#38bdf8", "#818cf8", "#f472b6", "#a78bfa")
UNCLUSTERED_COLOR = "#6b7280"
TOP_COLOR = "#facc15"
SELECTED_COLOR = "#fff"

# Fixed value: lower-cased messages that mean a failed download.
_DOWNLOAD_ERROR = (
    r"download failed|failed to fetch|load failed|network ?error|could not locate|unauthorized|err_"
    r"|http error|status (4|5)\d\d|getaddrinfo|enotfound|\b(403|404|429|500|502|503|504)\b"
)

TASK_PREFIX = {"query": "search_query: ", "document": "search_document: "}


def _fixed(value: Column, decimals: int) -> Column:
    """Decimal text, halves rounded up."""
    return F.when(value.isNotNull(), F.format_string(f"%.{decimals}f", F.round(value, decimals)))


def format_size(c) -> Column:
    c = _col(c).cast("double")
    return F.when(c < 1048576, F.concat(_fixed(c / 1024, 0), F.lit(" KB"))).otherwise(
        F.concat(_fixed(c / 1048576, 1), F.lit(" MB"))
    )


def format_bytes(c) -> Column:
    c = _col(c).cast("double")
    return (
        F.when(c >= 1073741824, F.concat(_fixed(c / 1073741824, 1), F.lit(" GB")))
        .when(c >= 1048576, F.concat(_fixed(c / 1048576, 0), F.lit(" MB")))
        .otherwise(F.concat(_fixed(c / 1024, 0), F.lit(" KB")))
    )


def cluster_color(c) -> Column:
    """Palette colour by cluster number, grey when there is none."""
    palette = F.array(*(F.lit(x) for x in CLUSTER_COLORS))
    return F.coalesce(F.get(palette, F.pmod(_col(c), F.lit(len(CLUSTER_COLORS)))), F.lit(UNCLUSTERED_COLOR))


def normalize_host(c) -> Column:
    """Host without surrounding whitespace and trailing slashes; empty for null."""
    trimmed = F.regexp_replace(F.coalesce(_col(c), F.lit("")), r"^\s+|\s+$", "")
    return F.regexp_replace(trimmed, r"/+$", "")


def is_download_error(name, message) -> Column:
    """True for messages of a failed transfer; an abort by the user is not one."""
    text = F.lower(F.coalesce(_col(message), F.lit("")))
    return ~_col(name).eqNullSafe(F.lit("AbortError")) & text.rlike(_DOWNLOAD_ERROR)


def prefix_text(c, task: str) -> Column:
    return F.concat(F.lit(TASK_PREFIX[task]), _col(c))


def is_blank(c) -> Column:
    return F.regexp_replace(F.coalesce(_col(c), F.lit("")), r"\s", "") == ""
