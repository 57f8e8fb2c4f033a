"""Registered queries over the map: layout, viewport, overlap, navigation."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumaspark.operators import layout, navigate, spread, summary
from lumaspark.registry.data import (
    CATALOGUE_SQL, FOLDER_SQL, MAP_POINTS_SQL, POINTS_SQL, catalogue, map_points, points,
)

QUERIES: dict = {}
SQL: dict = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return add


def _xy(df, *more):
    return df.select("media_id", *more, F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query("map_bounds", f"""WITH {MAP_POINTS_SQL}, b AS (SELECT count(*) AS n, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y FROM mp)
SELECT n, min_x, max_x, min_y, max_y, round((min_x + max_x) / 2, 6) AS cx, round((min_y + max_y) / 2, 6) AS cy,
  round(greatest(max_x - (min_x + max_x) / 2, max_y - (min_y + max_y) / 2), 6) AS half FROM b""")
def map_bounds(spark, sf):
    b = summary.bounds(map_points(spark, sf))
    return b.select("n", "min_x", "max_x", "min_y", "max_y", *(F.round(c, 6).alias(c) for c in ("cx", "cy", "half")))


_NORM = """b AS (SELECT count(*) AS n, (min(x) + max(x)) / 2 AS cx, (min(y) + max(y)) / 2 AS cy,
  greatest(max(x) - (min(x) + max(x)) / 2, max(y) - (min(y) + max(y)) / 2) AS r FROM {src}),
norm AS (SELECT media_id, (x - cx) / r * (sqrt(n) * 48 * 1.4::DOUBLE * {density}) AS x, (y - cy) / r * (sqrt(n) * 48 * 1.4::DOUBLE * {density}) AS y FROM {src}, b)"""


@query("normalized_layout", f"WITH {MAP_POINTS_SQL}, {_NORM.format(src='mp', density='1.0::DOUBLE')} SELECT media_id, round(x, 6) AS x, round(y, 6) AS y FROM norm")
def normalized_layout(spark, sf):
    return _xy(layout.normalize_layout(map_points(spark, sf)))


@query("normalized_layout_dense", f"WITH {POINTS_SQL}, {_NORM.format(src='pts', density='0.4::DOUBLE')} SELECT media_id, round(x, 6) AS x, round(y, 6) AS y FROM norm")
def normalized_layout_dense(spark, sf):
    return _xy(layout.normalize_layout(points(spark, sf), 0.4))


_FOLDERS_SQL = f"""{CATALOGUE_SQL}, f AS (SELECT media_id, {FOLDER_SQL} AS folder, last_modified FROM cat),
g AS (SELECT folder, count(*) AS c, row_number() OVER (ORDER BY folder) - 1 AS idx FROM f GROUP BY folder),
d AS (SELECT ceil(sqrt(count(*) * 1.5::DOUBLE)) AS per_row, max(ceil(sqrt(c))) AS max_cols FROM g),
r AS (SELECT media_id, f.folder, c, idx, row_number() OVER (PARTITION BY f.folder ORDER BY last_modified, media_id) - 1 AS i FROM f JOIN g ON f.folder = g.folder),
fl AS (SELECT media_id, folder, (idx % per_row) * per_row * 48 * (max_cols + 1) + (i % ceil(sqrt(c))) * 72 AS x,
  floor(idx / per_row) * per_row * 48 * (max_cols + 1) + floor(i / ceil(sqrt(c))) * 72 AS y FROM r, d)"""


@query("folder_grid_layout", f"WITH {_FOLDERS_SQL} SELECT media_id, folder, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y FROM fl")
def folder_grid_layout(spark, sf):
    return layout.folder_layout(catalogue(spark, sf), locale=None).select("media_id", "folder", "x", "y")


@query("placeholder_grid", f"""WITH {CATALOGUE_SQL}, r AS (SELECT media_id, row_number() OVER (ORDER BY media_id) - 1 AS j, ceil(sqrt(count(*) OVER ())) AS cols FROM cat)
SELECT media_id, CAST((j % cols) * 60 AS DOUBLE) AS x, CAST(floor(j / cols) * 60 AS DOUBLE) AS y FROM r""")
def placeholder_grid(spark, sf):
    c = catalogue(spark, sf).select("media_id")
    return layout.grid_layout(c, c.count())


_CAMERA = """cam AS (SELECT (min(x) + max(x)) / 2 AS cx, (min(y) + max(y)) / 2 AS cy,
  least((1280 - 128) / CASE WHEN max(x) = min(x) THEN 1 ELSE max(x) - min(x) END, (720 - 128) / CASE WHEN max(y) = min(y) THEN 1 ELSE max(y) - min(y) END) AS s FROM norm)"""
_MAP = f"{MAP_POINTS_SQL}, {_NORM.format(src='mp', density='1.0::DOUBLE')}, {_CAMERA}"
# the viewport of the checks: the fitted camera, zoomed in eight times
_VIEW = _MAP + """, seen AS (SELECT media_id, x, y, (x - cx) * (x - cx) + (y - cy) * (y - cy) AS d2 FROM norm, cam
  WHERE (x - cx) * s * 8 + 640 + 24 * s * 8 >= 0 AND (x - cx) * s * 8 + 640 - 24 * s * 8 <= 1280
    AND (y - cy) * s * 8 + 360 + 24 * s * 8 >= 0 AND (y - cy) * s * 8 + 360 - 24 * s * 8 <= 720)"""


def _map(spark, sf):
    return layout.normalize_layout(map_points(spark, sf))


def _camera(pts, zoom=1.0):
    c = layout.fit_camera(pts, 1280, 720).first().asDict()
    c["scale"] *= zoom
    return c


@query("fitted_camera", f"WITH {_MAP} SELECT round(cx, 6) AS x, round(cy, 6) AS y, round(s, 9) AS scale FROM cam")
def fitted_camera(spark, sf):
    c = layout.fit_camera(_map(spark, sf), 1280, 720)
    return c.select(F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), F.round("scale", 9).alias("scale"))


@query("visible_items", f"WITH {_VIEW} SELECT media_id FROM seen")
def visible_items(spark, sf):
    m = _map(spark, sf)
    return layout.visible(m, _camera(m, 8), 1280, 720).select("media_id")


# search ranks of the budget check: files in order of size, largest first
@query("drawn_items", f"""WITH {_VIEW}, ranks AS (SELECT media_id, row_number() OVER (ORDER BY size DESC, media_id) - 1 AS rank FROM cat)
SELECT media_id FROM seen JOIN ranks USING (media_id) ORDER BY CASE WHEN rank < 20 THEN rank ELSE 20 END, d2, media_id LIMIT 50""")
def drawn_items(spark, sf):
    from pyspark.sql import Window

    m = _map(spark, sf)
    camera = _camera(m, 8)
    top = catalogue(spark, sf).orderBy(F.col("size").desc(), "media_id").limit(20)
    ranks = top.select("media_id", (F.row_number().over(Window.orderBy(F.col("size").desc(), "media_id")) - 1).alias("rank"))
    return layout.draw_budget(layout.visible(m, camera, 1280, 720), camera, 50, ranks).select("media_id")


@query("nearest_to_centre", f"WITH {_MAP} SELECT arg_min(media_id, ((x - cx) * (x - cx) + (y - cy) * (y - cy), media_id)) AS media_id, round(min((x - cx) * (x - cx) + (y - cy) * (y - cy)), 4) AS d2 FROM norm, cam")
def nearest_to_centre(spark, sf):
    m = _map(spark, sf)
    c = _camera(m)
    return layout.nearest(m, c["x"], c["y"]).select("media_id", F.round("d2", 4).alias("d2"))


# every customer account taps somewhere on the canvas, by key
@query("tapped_items", f"""WITH {_MAP}, taps AS (SELECT c_custkey AS tap_id, (c_custkey * 37) % 1280 AS px, (c_custkey * 91) % 720 AS py FROM customer),
w AS (SELECT tap_id, (px - 640) / s + cx AS wx, (py - 360) / s + cy AS wy FROM taps, cam),
near AS (SELECT tap_id, media_id, (x - wx) * (x - wx) + (y - wy) * (y - wy) AS d2 FROM w JOIN norm ON x > wx - 48 AND x < wx + 48 AND y > wy - 48 AND y < wy + 48)
SELECT w.tap_id, arg_min(media_id, (d2, media_id)) FILTER (d2 < 2304) AS media_id FROM w LEFT JOIN near ON w.tap_id = near.tap_id GROUP BY w.tap_id""")
def tapped_items(spark, sf):
    from lumaspark.registry.data import table

    m = _map(spark, sf)
    taps = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("tap_id"), ((F.col("c_custkey") * 37) % 1280).alias("px"), ((F.col("c_custkey") * 91) % 720).alias("py"))
    return layout.hit_test(taps, m, _camera(m), 1280, 720)


# ---- overlap --------------------------------------------------------------------------

_PUSH = """pairs AS (SELECT a.media_id, b.x - a.x AS dx, b.y - a.y AS dy, (b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y) AS d2
  FROM norm a JOIN norm b ON b.x > a.x - 48 AND b.x < a.x + 48 AND b.y > a.y - 48 AND b.y < a.y + 48),
hits AS (SELECT media_id, dx, dy, sqrt(d2) AS d FROM pairs WHERE d2 > 0 AND d2 < 2304),
moves AS (SELECT media_id, count(*) AS deg, -sum(dx / d * ((48 - d) / 2 + 0.1::DOUBLE)) AS px, -sum(dy / d * ((48 - d) / 2 + 0.1::DOUBLE)) AS py FROM hits GROUP BY 1)"""


@query("overlap_degrees", f"WITH {MAP_POINTS_SQL}, {_NORM.format(src='mp', density='1.0::DOUBLE')}, {_PUSH} SELECT norm.media_id, coalesce(deg, 0) AS n_close FROM norm LEFT JOIN moves USING (media_id)")
def overlap_degrees(spark, sf):
    return spread.overlap_degree(_map(spark, sf))


@query("spread_one_round", f"""WITH {MAP_POINTS_SQL}, {_NORM.format(src='mp', density='1.0::DOUBLE')}, {_PUSH}
SELECT norm.media_id, round(x + coalesce(px / greatest(1, deg / 2), 0), 5) AS x, round(y + coalesce(py / greatest(1, deg / 2), 0), 5) AS y
FROM norm LEFT JOIN moves USING (media_id)""")
def spread_one_round(spark, sf):
    out = spread.spread(map_points(spark, sf), max_rounds=1)
    return out.select("media_id", F.round("x", 5).alias("x"), F.round("y", 5).alias("y"))


@query("spread_layout")
def spread_layout(spark, sf):
    return _xy(spread.spread(points(spark, sf)))


# ---- navigation -----------------------------------------------------------------------

def _brute(points_cte: str, source: str, where: str) -> str:
    dirs = {"left": ("-vx", "abs(vy)"), "right": ("vx", "abs(vy)"), "up": ("-vy", "abs(vx)"), "down": ("vy", "abs(vx)")}
    cols = ", ".join(
        f"coalesce(arg_min(o, ({p} * {p} + {s} * {s} * 5, o)) FILTER ({p} > 0), arg_min(o, ({p} + {s} * 2, o)), media_id) AS \"{d}\""
        for d, (p, s) in dirs.items())
    return f"""{points_cte}, v AS (SELECT a.media_id, b.media_id AS o, b.x - a.x AS vx, b.y - a.y AS vy
  FROM {source} a JOIN {source} b ON a.media_id <> b.media_id {where}) SELECT media_id, {cols} FROM v GROUP BY media_id"""


@query("navigation_graph", "WITH " + _brute(POINTS_SQL, "pts", ""))
def navigation_graph(spark, sf):
    return navigate.nav_graph(points(spark, sf))


@query("navigation_graph_folders", "WITH " + _brute(_FOLDERS_SQL + ", cu AS (SELECT media_id, floor(x / 720) AS x, floor(y / 720) AS y FROM fl)", "cu", ""))
def navigation_graph_folders(spark, sf):
    """Navigation over blocks of the folder grid: all files, stacked by the dozen, with very many equal coordinates."""
    grid = layout.folder_layout(catalogue(spark, sf), locale=None)
    return navigate.nav_graph(grid.select("media_id", F.floor(F.col("x") / 720).cast("double").alias("x"), F.floor(F.col("y") / 720).cast("double").alias("y")), tile_rows=64)


@query("navigation_step", f"""WITH {MAP_POINTS_SQL}, st AS ({_brute('z AS (SELECT 1)', 'mp', 'AND a.media_id = 7').replace('z AS (SELECT 1), v AS', 'WITH v AS')})
SELECT unnest(['left', 'right', 'up', 'down']) AS direction, unnest(["left", "right", "up", "down"]) AS next_id FROM st""")
def navigation_step(spark, sf):
    return navigate.next_in_direction(map_points(spark, sf), 7)


@query("sequence_by_time", f"""WITH {CATALOGUE_SQL} SELECT media_id,
  coalesce(lag(media_id) OVER w, last_value(media_id) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS prev_id,
  coalesce(lead(media_id) OVER w, first_value(media_id) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS next_id
  FROM cat WINDOW w AS (ORDER BY last_modified, media_id)""")
def sequence_by_time(spark, sf):
    return navigate.sequence_nav(catalogue(spark, sf))


@query("sequence_by_folder", f"""WITH {CATALOGUE_SQL}, f AS (SELECT media_id, {FOLDER_SQL} AS folder, last_modified FROM cat) SELECT media_id,
  coalesce(lag(media_id) OVER w, last_value(media_id) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS prev_id,
  coalesce(lead(media_id) OVER w, first_value(media_id) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS next_id
  FROM f WINDOW w AS (ORDER BY folder, last_modified, media_id)""")
def sequence_by_folder(spark, sf):
    return navigate.sequence_nav(catalogue(spark, sf), "viewer")
