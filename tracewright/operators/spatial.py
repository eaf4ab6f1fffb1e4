"""Grid-cell joins: rows meet only inside a shared cell, or in a group of few, never across a crowded group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.functions import geometry as G
from tracewright.session import stage


#: Cells of a level are so many times as wide as those of the level below.
RATIO = 4.0


def level_of(w: Column, h: Column) -> Column:
    """Smallest level whose cells are at least as wide and high as the box; null for a box without area."""
    return F.when((w > 0) & (h > 0), F.ceil(F.log(RATIO, F.greatest(w, h).cast("double"))).cast("int"))


def _cells(box: Sequence[Column], level: Column, tag: int) -> Column:
    """Cells (level, cx, cy, tag) of one level that the box touches."""
    size = F.pow(F.lit(RATIO), level)
    span = lambda lo, extent: F.sequence(F.floor(lo / size), F.floor((lo + extent) / size))
    return F.flatten(F.transform(span(box[0], box[2]), lambda cx: F.transform(span(box[1], box[3]), lambda cy: F.struct(
        level.alias("level"), cx.alias("cx"), cy.alias("cy"), F.lit(tag).alias("tag")))))


#: Boxes of both sides in a group whose boxes all meet directly; larger groups are cut into cells.
CROWD = 64


def overlap_join(left: DataFrame, right: DataFrame, on: Sequence[str], left_box: str = "l_", right_box: str = "r_",
                 counted: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Pairs of boxes with a common area, each once.

    The boxes of a group of few meet directly, a row per box; only the boxes of crowded
    groups are dealt over cells. `counted` may name cheaper tables whose groups are at
    least as large as those of the sides, such as a table before its copies were dropped.
    """
    if not on:
        return _cell_join(left, right, on, left_box, right_box)
    sizes = counted or (left, right)
    # a group lies on both sides or has no pairs, so the sizes are added up
    crowded = stage(sizes[0].select(*on).unionByName(sizes[1].select(*on)).groupBy(*on).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > CROWD).drop("n"))
    if crowded.isEmpty():
        return _meet(left, right, on, left_box, right_box)
    few, many = (lambda df: df.join(crowded, list(on), "left_anti")), (lambda df: df.join(crowded, list(on), "left_semi"))
    return _meet(few(left), few(right), on, left_box, right_box).unionByName(_cell_join(many(left), many(right), on, left_box, right_box))


def _common(a: Sequence[Column], b: Sequence[Column]) -> Column:
    """Whether two boxes have a common area."""
    return (F.least(a[0] + a[2], b[0] + b[2]) > F.greatest(a[0], b[0])) & (F.least(a[1] + a[3], b[1] + b[3]) > F.greatest(a[1], b[1]))


def _meet(left: DataFrame, right: DataFrame, on: Sequence[str], left_box: str, right_box: str) -> DataFrame:
    return left.join(right, list(on)).where(_common(G.box(left_box), G.box(right_box)))


def _cell_join(left: DataFrame, right: DataFrame, on: Sequence[str], left_box: str, right_box: str) -> DataFrame:
    """Pairs of boxes with a common area, found in cells.

    A box belongs to the level of its size and touches at most four cells there. Two
    boxes meet at the level of the larger one: the smaller asks in the cells around it
    of every level above its own that the other side has. Tags keep those who ask from
    meeting each other, so a large cell full of small boxes costs one row a box. A pair
    belongs to the cell of the top-left corner of the common area.
    """
    a, b = G.box(left_box), G.box(right_box)
    own_l, own_r = level_of(a[2], a[3]), level_of(b[2], b[3])
    # one row per level and side: sizes from a pixel to a whole plan are ten levels
    seen = left.select(F.lit("l").alias("side"), own_l.alias("v")).unionByName(right.select(F.lit("r").alias("side"), own_r.alias("v"))).distinct().collect()
    levels = {s: F.array(*[F.lit(v) for v in sorted(r.v for r in seen if r.side == s and r.v is not None)]).cast("array<int>") for s in "lr"}
    asked = lambda box, own, other, tag: F.flatten(F.transform(F.filter(levels[other], lambda v: v > own), lambda v: _cells(box, v, tag)))
    lc = left.where(own_l.isNotNull()).withColumn("_c", F.explode(F.concat(_cells(a, own_l, 0), asked(a, own_l, "r", 1))))
    rc = right.where(own_r.isNotNull()).withColumn("_c", F.explode(F.concat(_cells(b, own_r, 0), _cells(b, own_r, 1), asked(b, own_r, "l", 0))))
    flat = lambda df: df.select("*", *[F.col(f"_c.{c}").alias(f"_{c}") for c in ("level", "cx", "cy", "tag")]).drop("_c")
    x0, y0, size = F.greatest(a[0], b[0]), F.greatest(a[1], b[1]), F.pow(F.lit(RATIO), F.col("_level"))
    return (
        flat(lc).join(flat(rc), [*on, "_level", "_cx", "_cy", "_tag"])
        .where((F.floor(x0 / size) == F.col("_cx")) & (F.floor(y0 / size) == F.col("_cy")))
        .where(_common(a, b))
        .drop("_level", "_cx", "_cy", "_tag")
    )


def near_join(left: DataFrame, right: DataFrame, on: Sequence[str], radius_x: float, radius_y: float | None = None,
              left_xy: tuple[str, str] = ("l_x", "l_y"), right_xy: tuple[str, str] = ("r_x", "r_y"), few: str = "right") -> DataFrame:
    """Pairs of points no farther apart than the radius on either axis, each once.

    Cells are as wide as the radius, so the side named `few` goes to its own cell and
    the eight around it, the other side to one.
    """
    ry = radius_x if radius_y is None else radius_y
    lx, ly, rx, r_y = F.col(left_xy[0]), F.col(left_xy[1]), F.col(right_xy[0]), F.col(right_xy[1])
    around = F.array(*[F.lit(d) for d in (-1, 0, 1)])
    one = lambda df, x, y: df.withColumns({"_cx": F.floor(x / radius_x), "_cy": F.floor(y / ry)})
    nine = lambda df, x, y: df.withColumn("_cx", F.explode(F.transform(around, lambda d: F.floor(x / radius_x) + d))).withColumn(
        "_cy", F.explode(F.transform(around, lambda d: F.floor(y / ry) + d)))
    if few == "left":
        lc, rc = nine(left, lx, ly), one(right, rx, r_y)
    else:
        lc, rc = one(left, lx, ly), nine(right, rx, r_y)
    return (
        lc.join(rc, [*on, "_cx", "_cy"])
        .where((F.abs(lx - rx) <= radius_x) & (F.abs(ly - r_y) <= ry))
        .drop("_cx", "_cy")
    )


def reach_join(left: DataFrame, right: DataFrame, on: Sequence[str], left_reach: tuple[Column, Column],
               right_reach: tuple[Column, Column]) -> DataFrame:
    """Pairs whose centres lie within the sum of both reaches on each axis.

    A rule such as `distance <= k * max(own, other)` is covered when each side
    reaches k times its own size, so callers put the exact rule behind this join.
    Sides carry `l_cx, l_cy` and `r_cx, r_cy`.
    """
    def boxed(df: DataFrame, p: str, reach: tuple[Column, Column]) -> DataFrame:
        rx, ry = reach[0] + 1e-6, reach[1] + 1e-6
        return df.withColumns({f"_{p}x": F.col(f"{p}_cx") - rx, f"_{p}y": F.col(f"{p}_cy") - ry, f"_{p}w": 2 * rx, f"_{p}h": 2 * ry})

    out = overlap_join(boxed(left, "l", left_reach), boxed(right, "r", right_reach), on, "_l", "_r")
    return out.drop(*[f"_{p}{c}" for p in "lr" for c in "xywh"])
