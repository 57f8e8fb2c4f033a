"""Where files go on the map, and what a viewport shows of it."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumaspark.functions.paths import folder_of
from lumaspark.operators.blocks import BLOCK_ROWS, block_join
from lumaspark.operators.ordering import ordered_rank
from lumaspark.operators.summary import bounds, widest_folder

# Fixed values, in map units.
ITEM = 48.0  # edge of an item
PITCH = ITEM * 1.5  # between files of a folder
PLACEHOLDER_PITCH = 60.0  # between files that have no place yet
MARGIN = ITEM + 16  # kept free round the map, in screen pixels
ROOM = 1.4  # map growth per item


def normalize_layout(points: DataFrame, density: float = 1.0) -> DataFrame:
    """Points centred on their box and scaled so that the map grows with its items.

    The box is one row, known before the rows are moved, so this is a projection.
    """
    b = bounds(points).first()
    if not b["n"]:
        return points
    r = b["half"] if b["half"] and not math.isnan(b["half"]) else 1.0
    size = math.sqrt(b["n"]) * ITEM * ROOM * density
    return points.withColumn("x", (F.col("x") - b["cx"]) / r * size).withColumn("y", (F.col("y") - b["cy"]) / r * size)


def folder_layout(files: DataFrame, locale: str | None = "UNICODE") -> DataFrame:
    """Folders on a grid in name order; inside each, files by time on a square grid.

    ``locale`` is the collation of folder names; None compares bytes.
    """
    size = widest_folder(files).first()
    per_row = math.ceil(math.sqrt(size["n_folders"] * 1.5)) or 1
    step = per_row * ITEM * ((size["max_cols"] or 0) + 1)
    keyed = files.select("media_id", "last_modified", folder_of("name").alias("folder"))
    name_order = [F.collate("folder", locale), "folder"] if locale else ["folder"]
    folders = ordered_rank(keyed.select("folder").distinct(), [], name_order, "folder_no")
    placed = ordered_rank(keyed, ["folder"], ["last_modified", "media_id"], "_rn", "_files").join(folders, "folder")
    at, i = F.col("folder_no") - 1, F.col("_rn") - 1
    cols = F.ceil(F.sqrt("_files"))
    return placed.select(
        "media_id", "folder",
        ((at % per_row) * step + (i % cols) * PITCH).alias("x"),
        (F.floor(at / per_row) * step + F.floor(i / cols) * PITCH).alias("y"),
    )


def grid_layout(files: DataFrame, total: int, order: str = "media_id") -> DataFrame:
    """Places for the first files of a map that will hold ``total``, row by row."""
    cols = max(1, math.ceil(math.sqrt(total)))
    j = F.col("_rn") - 1
    return ordered_rank(files, [], [order], "_rn").select(
        *files.columns, ((j % cols) * PLACEHOLDER_PITCH).alias("x"), (F.floor(j / cols) * PLACEHOLDER_PITCH).alias("y")
    )


def fit_camera(points: DataFrame, width: float, height: float) -> DataFrame:
    """One row: the camera that shows every point."""
    b = bounds(points).where(F.col("n") > 0)

    def scale(free: float, lo: str, hi: str) -> Column:
        extent = F.col(hi) - F.col(lo)
        return F.lit(free - 2 * MARGIN) / F.when(extent == 0, 1.0).otherwise(extent)

    zoom = F.least(scale(width, "min_x", "max_x"), scale(height, "min_y", "max_y"))
    return b.select(F.col("cx").alias("x"), F.col("cy").alias("y"), zoom.alias("scale"))


def visible(points: DataFrame, camera, width: float, height: float) -> DataFrame:
    """Points whose item touches the canvas: a plain range on x and y, so it reaches the scan."""
    dx, dy = width / (2 * camera["scale"]) + ITEM / 2, height / (2 * camera["scale"]) + ITEM / 2
    return points.where(
        F.col("x").between(camera["x"] - dx, camera["x"] + dx) & F.col("y").between(camera["y"] - dy, camera["y"] + dy)
    )


def _distance2(x: float, y: float) -> Column:
    dx, dy = F.col("x") - x, F.col("y") - y
    return dx * dx + dy * dy


def draw_budget(points: DataFrame, camera, budget: int, ranks: DataFrame | None = None) -> DataFrame:
    """At most ``budget`` points to draw: the top 20 of a search first, then the nearest
    to the camera. This is the top-k of one frame; each task sends ``budget`` rows."""
    first = F.lit(20)
    if ranks is not None:
        top = F.broadcast(ranks.where(F.col("rank") < 20).select("media_id", F.col("rank").alias("_rank")))
        points = points.join(top, "media_id", "left")  # at most 20 rows
        first = F.coalesce("_rank", F.lit(20))
    return points.orderBy(first, _distance2(camera["x"], camera["y"]), "media_id").limit(budget).drop("_rank")


def nearest(points: DataFrame, x: float, y: float) -> DataFrame:
    """One row: the point nearest to a place, the lower id on ties."""
    d2 = _distance2(x, y)
    best = F.min(F.struct(d2.alias("d2"), F.col("media_id").alias("media_id")))
    return points.agg(best.alias("b")).select("b.media_id", "b.d2")


def tile(gx: Column, gy: Column) -> Column:
    return F.shiftleft(gx.cast("bigint"), 32) + gy.cast("bigint")


def tile_side(box, smallest: float, rows_per_tile: int) -> float:
    """Edge of tiles that hold about ``rows_per_tile`` points each, given their bounds."""
    if not box["n"]:
        return smallest
    extent = max(box["max_x"] - box["min_x"], box["max_y"] - box["min_y"], smallest)
    return max(smallest, extent * math.sqrt(rows_per_tile / box["n"]))


def own_tile(side: float) -> Column:
    return tile(F.floor(F.col("x") / side), F.floor(F.col("y") / side))


def reached_tiles(radius: float, side: float) -> Column:
    """Tiles that a disc touches."""
    def span(c: str) -> Column:
        return F.sequence(F.floor((F.col(c) - radius) / side), F.floor((F.col(c) + radius) / side))

    ys = span("y")
    return F.flatten(F.transform(span("x"), lambda gx: F.transform(ys, lambda gy: tile(gx, gy))))


def hit_test(taps: DataFrame, points: DataFrame, camera, width: float, height: float,
             rows_per_tile: int = 2048, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The item under each tap: the nearest point closer than one item, null when none is.

    Taps are in screen pixels (tap_id, px, py). Points meet only taps of their tile.
    """
    wx = (F.col("px") - width / 2) / camera["scale"] + camera["x"]
    wy = (F.col("py") - height / 2) / camera["scale"] + camera["y"]
    world = taps.select("tap_id", wx.alias("x"), wy.alias("y"))
    side = tile_side(bounds(points).first(), 2 * ITEM, rows_per_tile)
    left = world.withColumn("_cell", F.explode(reached_tiles(ITEM, side)))
    right = points.select("media_id", "x", "y", own_tile(side).alias("_cell"))

    def kernel(taps: pd.DataFrame, pts: pd.DataFrame) -> pd.DataFrame:
        out = {"tap_id": [], "d2": [], "media_id": []}
        if len(taps) and len(pts):
            pts = pts.sort_values("media_id")
            px, py, ids = pts["x"].to_numpy(), pts["y"].to_numpy(), pts["media_id"].to_numpy()
            for t, x, y in zip(taps["tap_id"], taps["x"], taps["y"]):
                d2 = (px - x) ** 2 + (py - y) ** 2
                i = int(np.argmin(d2))
                if d2[i] < ITEM * ITEM:
                    out["tap_id"].append(t)
                    out["d2"].append(d2[i])
                    out["media_id"].append(ids[i])
        return pd.DataFrame(out)

    found = block_join(left, right, kernel, "tap_id bigint, d2 double, media_id bigint", F.col("tap_id"), F.col("media_id"), block_rows)
    best = found.groupBy("tap_id").agg(F.min(F.struct("d2", "media_id")).alias("b"))
    return taps.join(best, "tap_id", "left").select("tap_id", F.col("b.media_id").alias("media_id"))
