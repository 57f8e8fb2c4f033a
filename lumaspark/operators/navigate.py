"""Steps between files: in a direction on the map, and forward or back in an order."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumaspark.functions.paths import folder_of
from lumaspark.operators.blocks import pair_groups
from lumaspark.operators.ordering import ordered_neighbours, slices
from lumaspark.session import materialize

# direction: (axis it moves along, sign)
DIRECTIONS = {"left": ("x", -1), "right": ("x", 1), "up": ("y", -1), "down": ("y", 1)}
DRIFT = 5.0  # weight of squared sideways distance
WRAP_DRIFT = 2.0  # weight of sideways distance when stepping over the edge
TILE_ROWS = 2048
ASKING_ROWS = 512  # stacks that a task compares with others at once
FEW_EDGES = 32  # up to here, wrapping steps are aggregates over the points


def next_in_direction(points: DataFrame, media_id: int, directions=tuple(DIRECTIONS)) -> DataFrame:
    """Where a step from one file leads, per direction: one pass over the points.

    Ahead, the cheapest point; with none ahead, the step wraps to the far side. Ties go
    to the lower id, and a lone file stays where it is.
    """
    cur = points.where(F.col("media_id") == media_id).select("x", "y").first()
    if cur is None:
        raise ValueError(f"no point {media_id}")
    vx, vy = F.col("x") - cur["x"], F.col("y") - cur["y"]
    others = points.where(F.col("media_id") != media_id)
    picks = []
    for d in directions:
        axis, sign = DIRECTIONS[d]
        proj, orth = (vx * sign, F.abs(vy)) if axis == "x" else (vy * sign, F.abs(vx))
        ahead = F.min(F.when(proj > 0, F.struct((proj * proj + orth * orth * DRIFT).alias("c"), F.col("media_id").alias("i"))))
        wrap = F.min(F.struct((proj + orth * WRAP_DRIFT).alias("c"), F.col("media_id").alias("i")))
        picks.append(F.struct(F.lit(d).alias("direction"), F.coalesce(ahead["i"], wrap["i"], F.lit(media_id)).alias("next_id")))
    return others.agg(F.array(*picks).alias("p")).select(F.inline("p"))


# ---- all points at once ----------------------------------------------------------------

def _interleave(c: Column) -> Column:
    """Spreads 20 bits so that another 20 fit between them."""
    v = c
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F),
                        (2, 0x3333333333333333), (1, 0x5555555555555555)):
        v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask))
    return v


def _tiles(stacks: DataFrame, box, tile_rows: int) -> tuple[DataFrame, int]:
    """Stacks cut along a space-filling curve into tiles of at most ``tile_rows``, numbered along it, and their number: even
    when most points crowd in one place, no tile is larger than another."""
    def grid(c: str, lo: float, hi: float) -> Column:
        return F.floor((F.col(c) - lo) / ((hi - lo) or 1.0) * 1048575).cast("bigint")

    code = _interleave(grid("x", box["min_x"], box["max_x"])).bitwiseOR(
        F.shiftleft(_interleave(grid("y", box["min_y"], box["max_y"])), 1))
    cut = slices(stacks.withColumn("_z", code), "_z", "x", "y")
    sizes = cut.groupBy("_slice").agg((F.floor(F.max("_pos") / tile_rows) + 1).alias("n"))
    before = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)  # one row per slice
    sizes = materialize(sizes.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0))))
    total = sizes.agg(F.sum("n")).first()[0] or 0
    tile = (F.col("first") + F.floor(F.col("_pos") / tile_rows)).cast("bigint")
    return cut.join(sizes, "_slice").withColumn("tile", tile).drop("_z", "_slice", "_pos", "first", "n"), total


_BOX = ("min_x", "max_x", "min_y", "max_y")
FAN = 8  # tiles, or groups of tiles, that the next level of the tree holds as one


def _levels(tiled: DataFrame, tiles: int) -> list[DataFrame]:
    """Boxes of the tiles, then of FAN neighbours along the curve as one, up to a single box: (node, min_x, ...)."""
    directory = materialize(tiled.groupBy(F.col("tile").alias("node")).agg(
        F.min("x").alias("min_x"), F.max("x").alias("max_x"), F.min("y").alias("min_y"), F.max("y").alias("max_y")))
    levels, width = [directory], tiles
    while width > 1:
        up = levels[-1].groupBy(F.floor(F.col("node") / FAN).cast("bigint").alias("node")).agg(
            *((F.min if c.startswith("min") else F.max)(c).alias(c) for c in _BOX))
        levels.append(materialize(up))
        width = -(-width // FAN)
    return levels


def _tile_pairs(tiled: DataFrame, tiles: int) -> DataFrame:
    """(tile, other, dirs): tile pairs that may hold the nearest point ahead, with the directions as bits.

    Down the tree of boxes, from the pair of the root with itself. A box wholly ahead bounds the cost for all points of the asking
    box; boxes whose lowest possible cost is above the best such bound, or that of the boxes above, drop out with all below them.
    A level is two joins by parent and one window over the candidates of each asking box.
    """
    levels = _levels(tiled, tiles)
    bound, bits = [f"_bound{i}" for i in range(4)], {d: 1 << i for i, d in enumerate(DIRECTIONS)}
    pairs = levels[-1].select(F.col("node").alias("q"), F.col("node").alias("o"), F.lit(15).alias("dirs"), *(F.lit(float("inf")).alias(b) for b in bound))
    for depth, level in enumerate(reversed(levels)):
        if depth:
            mine = level.select(F.floor(F.col("node") / FAN).cast("bigint").alias("q"), F.col("node").alias("nq"))
            theirs = level.select(F.floor(F.col("node") / FAN).cast("bigint").alias("o"), F.col("node").alias("no"))
            pairs = pairs.join(mine, "q").join(theirs, "o").select(F.col("nq").alias("q"), F.col("no").alias("o"), "dirs", *bound)
        q = level.select(F.col("node").alias("q"), *(F.col(c).alias(f"q_{c}") for c in _BOX))
        o = level.select(F.col("node").alias("o"), *(F.col(c).alias(f"o_{c}") for c in _BOX))
        pairs = pairs.join(q, "q").join(o, "o")
        asking, least, kept = Window.partitionBy("q"), {}, F.lit(0)
        for b, (name, (axis, sign)) in zip(bound, DIRECTIONS.items(), strict=True):
            other = "y" if axis == "x" else "x"
            one, two = ("o", "q") if sign > 0 else ("q", "o")
            closest = F.col(f"{one}_min_{axis}") - F.col(f"{two}_max_{axis}")
            farthest = F.col(f"{one}_max_{axis}") - F.col(f"{two}_min_{axis}")
            apart = [F.col(f"o_min_{other}") - F.col(f"q_max_{other}"), F.col(f"q_min_{other}") - F.col(f"o_max_{other}")]
            across = F.greatest(F.col(f"o_max_{other}") - F.col(f"q_min_{other}"), F.col(f"q_max_{other}") - F.col(f"o_min_{other}"))
            near, side = F.greatest(closest, F.lit(0.0)), F.greatest(*apart, F.lit(0.0))
            least[name] = near * near + side * side * DRIFT
            most = F.when(closest > 0, farthest * farthest + across * across * DRIFT).otherwise(F.lit(float("inf")))
            pairs = pairs.withColumn(b, F.least(F.col(b), F.min(most).over(asking)))
            alive = F.col("dirs").bitwiseAND(F.lit(bits[name])) > 0
            kept = kept + F.when(alive & (farthest > 0) & (least[name] <= F.col(b) * (1 + 1e-9)), bits[name]).otherwise(0)
        pairs = pairs.withColumn("dirs", kept.cast("int")).where("dirs > 0").select("q", "o", "dirs", *bound)
    return materialize(pairs.select(F.col("q").alias("tile"), F.col("o").alias("other"), "dirs"))


def _asked_together(pairs: DataFrame, asking: int, asked: int) -> DataFrame:
    """(block, part, other, dirs): ``asking`` neighbours along the curve ask as one block, ``asked`` tiles at a time. Small tiles ask many,
    mostly the same as their neighbours; more candidates than a tile needs change no minimum."""
    blocks = pairs.groupBy(F.floor(F.col("tile") / asking).cast("bigint").alias("block"), "other").agg(F.bit_or("dirs").alias("dirs"))
    per_block = Window.partitionBy("block").orderBy("other")  # a row per tile that is asked, not per stack
    return materialize(blocks.withColumn("part", F.floor((F.row_number().over(per_block) - 1) / asked).cast("int")))


def _step_kernel(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    empty = pd.DataFrame({"gid": [], "dir": [], "cost": [], "dst": []})
    if left.empty or right.empty:
        return empty
    right = right.sort_values("gid")
    rx, ry, ids = right["x"].to_numpy(), right["y"].to_numpy(), right["gid"].to_numpy()
    dirs, out = int(left["dirs"].iloc[0]), []
    for at in range(0, len(left), ASKING_ROWS):
        part = left.iloc[at:at + ASKING_ROWS]
        vx, vy = rx[None, :] - part["x"].to_numpy()[:, None], ry[None, :] - part["y"].to_numpy()[:, None]
        for bit, (name, (axis, sign)) in enumerate(DIRECTIONS.items()):
            if not dirs >> bit & 1:
                continue
            proj, orth = (vx * sign, vy) if axis == "x" else (vy * sign, vx)
            cost = np.where(proj > 0, proj * proj + orth * orth * DRIFT, np.inf)
            best = cost.argmin(axis=1)
            value = cost[np.arange(len(part)), best]
            ok = np.isfinite(value)
            out.append(pd.DataFrame({"gid": part["gid"].to_numpy()[ok], "dir": name, "cost": value[ok], "dst": ids[best][ok]}))
    return pd.concat(out) if out else empty


def _steps_ahead(stacks: DataFrame, box, tile_rows: int) -> DataFrame:
    """(gid, dir, dst) for every stack that has a point ahead of it."""
    tiled, tiles = _tiles(stacks, box, tile_rows)
    side = max(1, ASKING_ROWS // tile_rows)
    pairs = _asked_together(_tile_pairs(tiled, tiles), side, max(1, TILE_ROWS // tile_rows))
    parts = pairs.groupBy("block", "part").agg(F.bit_or("dirs").alias("dirs"))
    asking = tiled.withColumn("block", F.floor(F.col("tile") / side).cast("bigint")).join(parts, "block").select("block", "part", "dirs", "gid", "x", "y")
    asked = tiled.withColumnRenamed("tile", "other").join(pairs, "other").select("block", "part", "gid", "x", "y")
    found = pair_groups(asking, asked, ["block", "part"], _step_kernel, "gid bigint, dir string, cost double, dst bigint")
    best = found.groupBy("gid", "dir").agg(F.min(F.struct("cost", "dst")).alias("b"))
    return best.select("gid", "dir", F.col("b.dst").alias("dst"))


def _edge_stacks(stacks: DataFrame, box, most: int) -> list | None:
    """(gid, x, y) of the stacks with nothing ahead in some direction, or None if they are many."""
    outer = F.col("x").isin(box["min_x"], box["max_x"]) | F.col("y").isin(box["min_y"], box["max_y"])
    found = stacks.where(outer).select("gid", "x", "y").limit(most + 1).collect()
    return found if len(found) <= most else None


def _steps_from_few(stacks: DataFrame, box, few: list) -> DataFrame:
    """Wrapping steps of a bounded list of stacks: one aggregation over all points."""
    picks = []
    for s in few:
        for name, (axis, sign) in DIRECTIONS.items():
            if s[axis] != (box[f"max_{axis}"] if sign > 0 else box[f"min_{axis}"]):
                continue
            vx, vy = F.col("x") - s["x"], F.col("y") - s["y"]
            proj, orth = (vx * sign, F.abs(vy)) if axis == "x" else (vy * sign, F.abs(vx))
            best = F.min(F.when(F.col("gid") != s["gid"], F.struct((proj + orth * WRAP_DRIFT).alias("s"), F.col("gid").alias("i"))))
            picks.append(F.struct(F.lit(s["gid"]).alias("gid"), F.lit(name).alias("dir"), best["s"].alias("score"), best["i"].alias("dst")))
    return stacks.agg(F.array(*picks).alias("p")).select(F.inline("p")).where(F.col("dst").isNotNull())


def _steps_over_edge(stacks: DataFrame, box, axis: str) -> DataFrame:
    """(gid, dir, score, dst) for the stacks at either end of an axis, which have none ahead.

    With p the far point, the score is (p's place along the step) + 2 |sideways distance|:
    the lower envelope of cones. Sorted sideways, it is a running minimum from the left
    and one from the right. Slices run alone and take over the minimum of the slices
    before them; the stack itself is no candidate.
    """
    other = "y" if axis == "x" else "x"
    a, b = F.col(axis), F.col(other)
    cut = slices(stacks.select("gid", "x", "y"), other, axis, "gid")
    cones = {}
    for name, (ax, sign) in DIRECTIONS.items():
        if ax == axis:
            cones[name, "low"] = F.struct((a * sign - b * WRAP_DRIFT).alias("v"), F.col("gid").alias("i"))
            cones[name, "high"] = F.struct((a * sign + b * WRAP_DRIFT).alias("v"), F.col("gid").alias("i"))
    names = {k: f"_{k[0]}_{k[1]}" for k in cones}
    cut = cut.withColumns({names[k]: c for k, c in cones.items()})
    totals = cut.groupBy("_slice").agg(*(F.min(n).alias(n) for n in names.values()))

    def running(order: Column) -> object:
        return Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)

    carried = totals.select("_slice", *(  # one row per slice
        F.min(n).over(running(F.col("_slice").asc() if k[1] == "low" else F.col("_slice").desc())).alias(f"{n}_in")
        for k, n in names.items()))
    inside = Window.partitionBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    swept = cut.select("*", *(
        F.min(n).over(inside.orderBy(F.col("_pos").asc() if k[1] == "low" else F.col("_pos").desc())).alias(f"{n}_own")
        for k, n in names.items())).join(carried, "_slice")
    rows = []
    for name, (ax, sign) in DIRECTIONS.items():
        if ax != axis:
            continue
        edge = box[f"max_{axis}"] if sign > 0 else box[f"min_{axis}"]
        ends = []
        for part, back in (("low", 1), ("high", -1)):
            n = names[name, part]
            best = F.least(f"{n}_own", f"{n}_in")
            ends.append(F.when(best.isNotNull(), F.struct((best["v"] + b * (WRAP_DRIFT * back) - sign * edge).alias("s"), best["i"].alias("i"))))
        pick = F.least(*ends)
        rows.append(F.when((a == edge) & pick.isNotNull(), F.struct(
            F.lit(name).alias("dir"), pick["s"].alias("score"), pick["i"].alias("dst"))))
    flat = swept.where(a.isin(box[f"max_{axis}"], box[f"min_{axis}"])).select("gid", F.explode(F.array(*rows)).alias("r"))
    return flat.where(F.col("r").isNotNull()).select("gid", "r.*")


def nav_graph(points: DataFrame, tile_rows: int = TILE_ROWS, few_edges: int = FEW_EDGES) -> DataFrame:
    """Where a step in each direction leads, for every point: (media_id, left, right, up, down).

    Exactly what ``next_in_direction`` gives point by point. Points at one place form a
    stack; a stack asks only the tiles that can hold its answer. Wrapping steps, which only the
    outermost points need, are aggregates when few and a sorted sweep when many.
    """
    from lumaspark.operators.summary import bounds

    pts = points.select("media_id", "x", "y")
    per_place = Window.partitionBy("x", "y").orderBy("media_id")
    two = pts.withColumn("_rn", F.row_number().over(per_place)).where(F.col("_rn") <= 2)
    stacks = materialize(two.groupBy("x", "y").agg(F.min("media_id").alias("gid"), F.max("media_id").alias("second")))
    box = bounds(stacks).first()
    if not box["n"]:
        return pts.select("media_id", *(F.lit(None).cast("bigint").alias(d) for d in DIRECTIONS))
    ahead = _steps_ahead(stacks, box, tile_rows).select("gid", "dir", F.lit(True).alias("is_ahead"), F.lit(0.0).alias("score"), "dst")
    few = _edge_stacks(stacks, box, few_edges)
    if few is not None:
        over = _steps_from_few(stacks, box, few)
    else:
        over = _steps_over_edge(stacks, box, "x").unionByName(_steps_over_edge(stacks, box, "y"))
    over = over.select("gid", "dir", F.lit(False).alias("is_ahead"), "score", "dst")
    steps = ahead.unionByName(over).groupBy("gid").agg(*(
        F.max(F.when(F.col("dir") == d, F.struct("is_ahead", "score", "dst"))).alias(f"_{d}") for d in DIRECTIONS))
    rows = pts.join(stacks, ["x", "y"]).join(steps, "gid", "left")
    twin = F.when(F.col("media_id") != F.col("gid"), F.col("gid")).when(F.col("second") != F.col("gid"), F.col("second"))

    def step(d: str) -> Column:
        s = F.col(f"_{d}")
        wrap = F.least(
            F.when(s.isNotNull(), F.struct(s["score"].alias("s"), s["dst"].alias("i"))),
            F.when(twin.isNotNull(), F.struct(F.lit(0.0).alias("s"), twin.alias("i"))),
        )
        return F.when(s["is_ahead"], s["dst"]).otherwise(F.coalesce(wrap["i"], F.col("media_id"))).alias(d)

    return rows.select("media_id", *(step(d) for d in DIRECTIONS))


def sequence_nav(files: DataFrame, order: str = "time", locale: str | None = None) -> DataFrame:
    """Previous and next file with wrap-around: by time, or by folder then time ('viewer')."""
    if order == "viewer":
        files = files.withColumn("_folder", folder_of("name"))
        lead = [F.collate("_folder", locale), "_folder"] if locale else ["_folder"]
    else:
        lead = []
    keys = [*lead, "last_modified", "media_id"]
    out = ordered_neighbours(files, [], keys, "media_id", "prev_id", "next_id", wrap=True)
    return out.select("media_id", "prev_id", "next_id")
