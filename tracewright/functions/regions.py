"""Regions of interest, ignore regions and tiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.functions import geometry as G
from tracewright.functions.labels import region_unit_scale
from tracewright.operators import spatial


def to_int(c: Column) -> Column:
    """Half-even rounding to a whole number; text that is no number gives null."""
    return F.bround(c.try_cast("double")).cast("bigint")


def roi_of_points(points: Column) -> Column:
    """Box around a list of [x, y] points, at least 1 wide and high; null below two points."""
    ok = F.filter(points, lambda p: (F.size(p) >= 2) & to_int(F.get(p, F.lit(0))).isNotNull() & to_int(F.get(p, F.lit(1))).isNotNull())
    px = F.transform(ok, lambda p: to_int(F.get(p, F.lit(0))))
    py = F.transform(ok, lambda p: to_int(F.get(p, F.lit(1))))
    one = F.lit(1).cast("bigint")
    box = F.struct(
        F.array_min(px).alias("x"), F.array_min(py).alias("y"),
        F.greatest(F.array_max(px) - F.array_min(px), one).alias("w"),
        F.greatest(F.array_max(py) - F.array_min(py), one).alias("h"),
    )
    return F.when((F.size(points) >= 2) & (F.size(ok) > 0), box)


def clip_roi(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> Column:
    """Region cut to the picture; null when nothing is left."""
    zero = F.lit(0).cast("bigint")
    x0, y0 = F.greatest(zero, x), F.greatest(zero, y)
    x1, y1 = F.least(width.cast("bigint"), x0 + w), F.least(height.cast("bigint"), y0 + h)
    box = F.struct(x0.alias("x"), y0.alias("y"), (x1 - x0).alias("width"), (y1 - y0).alias("height"))
    return F.when((w > 0) & (h > 0) & (x1 > x0) & (y1 > y0), box)


def _rect(points: Column) -> Column:
    a, b = F.get(points, F.lit(0)), F.get(points, F.size(points) - 1)
    ax, ay, bx, by = F.get(a, F.lit(0)), F.get(a, F.lit(1)), F.get(b, F.lit(0)), F.get(b, F.lit(1))
    left, right, top, bottom = F.least(ax, bx), F.greatest(ax, bx), F.least(ay, by), F.greatest(ay, by)
    return F.array(F.array(left, top), F.array(right, top), F.array(right, bottom), F.array(left, bottom))


def normalise_region(kind: Column, points: Column, width: Column, height: Column) -> Column:
    """Region as a polygon in pixels inside the picture, with the unit its points came in.

    Rectangles become four points; fewer than three points or no extent gives null.
    """
    poly = F.when(F.lower(kind) == "rect", F.when(F.size(points) >= 2, _rect(points))).otherwise(points)
    biggest = F.array_max(F.transform(poly, lambda p: F.greatest(F.get(p, F.lit(0)), F.get(p, F.lit(1)))))
    unit = region_unit_scale(biggest)
    sx = F.when(unit == "fraction", width.cast("double")).when(unit == "percent", width / 100.0).otherwise(1.0)
    sy = F.when(unit == "fraction", height.cast("double")).when(unit == "percent", height / 100.0).otherwise(1.0)
    inside = F.transform(
        poly,
        lambda p: F.array(
            F.greatest(F.lit(0.0), F.least(width.cast("double"), F.get(p, F.lit(0)) * sx)),
            F.greatest(F.lit(0.0), F.least(height.cast("double"), F.get(p, F.lit(1)) * sy)),
        ),
    )
    px = F.transform(inside, lambda p: F.get(p, F.lit(0)))
    py = F.transform(inside, lambda p: F.get(p, F.lit(1)))
    flat = (F.array_max(px) <= F.array_min(px)) | (F.array_max(py) <= F.array_min(py))
    return F.when((F.size(poly) >= 3) & ~flat, F.struct(unit.alias("unit"), inside.alias("points")))


def rescale_points(points: Column, from_w: Column, from_h: Column, to_w: Column, to_h: Column) -> Column:
    return F.transform(points, lambda p: F.array(F.get(p, F.lit(0)) * to_w / from_w, F.get(p, F.lit(1)) * to_h / from_h))


def tiles(images: DataFrame, rows: int, cols: int) -> DataFrame:
    """rows x cols tiles per picture; the last row and column take the remainder."""
    r, c = F.col("tile_row"), F.col("tile_col")
    tw, th = F.floor(F.col("width") / cols), F.floor(F.col("height") / rows)
    grid = (
        images.withColumn("tile_row", F.explode(F.sequence(F.lit(0), F.lit(rows - 1)).cast("array<bigint>")))
        .withColumn("tile_col", F.explode(F.sequence(F.lit(0), F.lit(cols - 1)).cast("array<bigint>")))
    )
    return grid.withColumns({
        "x1": c * tw, "y1": r * th,
        "x2": F.when(c == cols - 1, F.col("width")).otherwise(c * tw + tw),
        "y2": F.when(r == rows - 1, F.col("height")).otherwise(r * th + th),
    })


def outside_regions(boxes: DataFrame, regions: DataFrame, on: Sequence[str], ids: Sequence[str], share: float) -> DataFrame:
    """Boxes of which no single region covers `share` or more (box form)."""
    left = boxes.select(*ids, *on, *[F.col(c).alias("l_" + c) for c in "xywh"])
    right = regions.select(*on, *[F.col(c).alias("r_" + c) for c in "xywh"]).distinct()
    area = F.greatest(F.lit(1.0), F.col("l_w") * F.col("l_h"))
    hit = spatial.overlap_join(left, right, on).where(G.overlap_area(G.box("l_"), G.box("r_")) / area >= share)
    return boxes.join(hit.select(*ids).distinct(), list(ids), "left_anti")


def _edges(poly: Column) -> Column:
    """Edges (x1, y1, x2, y2) of a polygon."""
    n = F.size(poly)
    at = lambda i, k: F.get(F.get(poly, i % n), F.lit(k))
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(
        at(i, 0).alias("x1"), at(i, 1).alias("y1"), at(i + 1, 0).alias("x2"), at(i + 1, 1).alias("y2")))


def _row_spans(edges: Column, y: Column) -> Column:
    """Closed x spans that the polygon of these edges covers on the line `y`, border included.

    Crossings are taken once with the lower and once with the upper end of an edge
    left out, so corner rows are covered from either side; level edges add themselves.
    """
    def crossings(lower_in: bool) -> Column:
        def hit(e: Column) -> Column:
            lo, hi = F.least(e["y1"], e["y2"]), F.greatest(e["y1"], e["y2"])
            return ((lo <= y) & (y < hi)) if lower_in else ((lo < y) & (y <= hi))

        xs = F.transform(F.filter(edges, hit), lambda e: e["x1"] + (y - e["y1"]) * (e["x2"] - e["x1"]) / (e["y2"] - e["y1"]))
        return F.array_sort(xs)

    def spans(xs: Column) -> Column:
        firsts = F.filter(xs, lambda _, i: i % 2 == 0)
        return F.transform(firsts, lambda v, i: F.struct(v.alias("a"), F.coalesce(F.get(xs, 2 * i + 1), v).alias("b")))

    level = F.transform(F.filter(edges, lambda e: (e["y1"] == y) & (e["y2"] == y)),
                        lambda e: F.struct(F.least(e["x1"], e["x2"]).alias("a"), F.greatest(e["x1"], e["x2"]).alias("b")))
    return F.concat(spans(crossings(True)), spans(crossings(False)), level)


def outside_polygons(boxes: DataFrame, polygons: DataFrame, on: Sequence[str], ids: Sequence[str], share: float) -> DataFrame:
    """Boxes of which all polygons together cover less than `share` of the pixels.

    `boxes(*on, *ids, x, y, w, h, width, height)`, `polygons(*on, points)`. Only the
    lines a box shares with a polygon's extent are scanned; boxes without pixels stay.
    """
    x1, y1 = F.greatest(F.lit(0), to_int(F.col("x"))), F.greatest(F.lit(0), to_int(F.col("y")))
    x2, y2 = F.least("width", to_int(F.col("x") + F.col("w"))), F.least("height", to_int(F.col("y") + F.col("h")))
    b = boxes.select(*on, *ids, x1.alias("l_x"), y1.alias("l_y"), (x2 - x1).alias("l_w"), (y2 - y1).alias("l_h")).where("l_w > 0 AND l_h > 0")
    px = F.transform("points", lambda p: F.get(p, F.lit(0)))
    py = F.transform("points", lambda p: F.get(p, F.lit(1)))
    low_x, low_y = F.floor(F.array_min(px)), F.floor(F.array_min(py))
    p = polygons.where(F.size("points") >= 3).select(
        *on, _edges(F.col("points")).alias("_edges"), low_x.alias("r_x"), low_y.alias("r_y"), (F.ceil(F.array_max(px)) - low_x + 1).alias("r_w"), (F.ceil(F.array_max(py)) - low_y + 1).alias("r_h"))
    pair = spatial.overlap_join(b, p, on)
    top, bottom = F.greatest("l_y", "r_y"), F.least(F.col("l_y") + F.col("l_h"), F.col("r_y") + F.col("r_h")) - 1
    rows = pair.withColumn("_y", F.explode(F.sequence(top, bottom)))
    spans = rows.withColumn("_s", F.explode(_row_spans(F.col("_edges"), F.col("_y"))))
    a = F.greatest(F.ceil("_s.a"), F.col("l_x"))
    z = F.least(F.floor("_s.b"), F.col("l_x") + F.col("l_w") - 1)
    parts = spans.withColumns({"_a": a, "_z": z}).where("_a <= _z").select(*on, *ids, "_y", "_a", "_z", (F.col("l_w") * F.col("l_h")).alias("_area"))
    covered = merged_spans(parts, [*ids, "_y", "_area"]).groupBy(*ids, "_area").agg(F.sum(F.col("_z") - F.col("_a") + 1).alias("_n")).where(F.col("_n") / F.col("_area") >= share)
    return boxes.join(covered.select(*ids), list(ids), "left_anti")


def merged_spans(spans: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The closed whole-number spans [_a, _z] of each group as spans that neither overlap nor touch.

    A span begins a new one where it lies beyond the largest end before it.
    """
    order = Window.partitionBy(*keys).orderBy("_a", "_z")
    before = F.max("_z").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = spans.select(*keys, "_a", "_z", (before.isNull() | (F.col("_a") > before + 1)).cast("int").alias("_new"))
    numbered = new.withColumn("_k", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "_k").agg(F.min("_a").alias("_a"), F.max("_z").alias("_z")).drop("_k")


def polygon_lines(polygons: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(*keys, _y, _a, _z): the pixels of all polygons of a group, border included, as spans per line.

    `polygons(*keys, points)`; polygons of fewer than three points cover nothing, null
    keys are groups. Lines, not pixels, are the rows: a polygon of any width takes one or a few a line.
    """
    e = F.col("_e")
    rows = polygons.where(F.size("points") >= 3).select(*keys, "points").distinct().select(
        *keys, F.xxhash64("points").alias("_p"), F.explode(_edges(F.col("points"))).alias("_e")).select(
        *keys, "_p", "_e", F.least(e["y1"], e["y2"]).alias("_lo"), F.greatest(e["y1"], e["y2"]).alias("_hi"))
    lines = rows.where(F.ceil("_lo") <= F.floor("_hi")).withColumn("_y", F.explode(F.sequence(F.ceil("_lo"), F.floor("_hi"))))
    level = F.col("_lo") == F.col("_hi")
    # an edge counts once without its upper and once without its lower end; see _row_spans
    kinds = F.array_compact(F.array(F.when(F.col("_y") < F.col("_hi"), 0), F.when(F.col("_y") > F.col("_lo"), 1)))
    x = e["x1"] + (F.col("_y") - e["y1"]) * (e["x2"] - e["x1"]) / (e["y2"] - e["y1"])
    group = [*keys, "_p", "_y", "_kind"]
    hits = lines.where(~level).select(*keys, "_p", "_y", x.alias("_x"), F.explode(kinds).alias("_kind"))
    placed = hits.withColumn("_k", F.floor((F.row_number().over(Window.partitionBy(*group).orderBy("_x")) - 1) / 2))
    pairs = placed.groupBy(*group, "_k").agg(F.min("_x").alias("a"), F.max("_x").alias("b")).select(*keys, "_y", "a", "b")
    flat = lines.where(level).select(*keys, "_y", F.least(e["x1"], e["x2"]).alias("a"), F.greatest(e["x1"], e["x2"]).alias("b"))
    whole = pairs.unionByName(flat).select(*keys, "_y", F.ceil("a").alias("_a"), F.floor("b").alias("_z")).where("_a <= _z")
    return merged_spans(whole, [*keys, "_y"])
