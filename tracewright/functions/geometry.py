"""Box and polygon arithmetic as Column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Box = Sequence[Column]  # x, y, w, h


def box(prefix: str = "") -> list[Column]:
    return [F.col(prefix + c) for c in ("x", "y", "w", "h")]


def overlap_area(a: Box, b: Box) -> Column:
    zero = F.lit(0.0)
    dx = F.least(a[0] + a[2], b[0] + b[2]) - F.greatest(a[0], b[0])
    dy = F.least(a[1] + a[3], b[1] + b[3]) - F.greatest(a[1], b[1])
    return F.greatest(zero, dx.cast("double")) * F.greatest(zero, dy.cast("double"))


def iou(a: Box, b: Box) -> Column:
    inter = overlap_area(a, b)
    union = (a[2] * a[3]).cast("double") + (b[2] * b[3]).cast("double") - inter
    return F.when(union > 0, inter / union).otherwise(F.lit(0.0))


def centre(b: Box) -> tuple[Column, Column]:
    return b[0] + b[2] / F.lit(2.0), b[1] + b[3] / F.lit(2.0)


def distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2))


def box_metrics(b: Box) -> dict[str, Column]:
    """Area, aspect ratio (0 for a box without height) and diagonal."""
    w, h = b[2].cast("double"), b[3].cast("double")
    return {
        "area": w * h,
        "aspect_ratio": F.when(h > 0, w / h).otherwise(F.lit(0.0)),
        "diagonal": F.sqrt(w * w + h * h),
    }


def clamp(c: Column, lo: float = 0.0, hi: float = 1.0) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), c))


def rotated_corners(cx: Column, cy: Column, w: Column, h: Column, degrees: Column) -> Column:
    """Corners of a box turned about its centre, flat `[x1, y1, ... x4, y4]`.

    The order is left-top, right-top, right-bottom, left-bottom before turning.
    Pass a negated angle for the other screen orientation.
    """
    a = F.radians(degrees.cast("double"))
    hw, hh = w / F.lit(2.0), h / F.lit(2.0)
    out = []
    for sx, sy in ((-1, -1), (1, -1), (1, 1), (-1, 1)):
        dx, dy = hw * F.lit(float(sx)), hh * F.lit(float(sy))
        out += [cx + dx * F.cos(a) - dy * F.sin(a), cy + dx * F.sin(a) + dy * F.cos(a)]
    return F.array(*out)


def xs(flat: Column) -> Column:
    return F.filter(flat, lambda v, i: i % 2 == 0)


def ys(flat: Column) -> Column:
    return F.filter(flat, lambda v, i: i % 2 == 1)


def polygon_box(flat: Column) -> Column:
    """Axis-aligned `[x, y, w, h]` around a flat polygon."""
    px, py = xs(flat), ys(flat)
    return F.array(
        F.array_min(px), F.array_min(py), F.array_max(px) - F.array_min(px), F.array_max(py) - F.array_min(py)
    )


def polygon_area(flat: Column) -> Column:
    """Shoelace area of a flat polygon; 0 below three points."""
    px, py = xs(flat), ys(flat)
    n = F.least(F.size(px), F.size(py))
    total = F.aggregate(
        F.sequence(F.lit(0), n - 1),
        F.lit(0.0),
        lambda acc, i: acc
        + F.get(px, i) * F.get(py, (i + 1) % n)
        - F.get(px, (i + 1) % n) * F.get(py, i),
    )
    return F.when(n >= 3, F.abs(total) / 2.0).otherwise(F.lit(0.0))


def box_inside(b: Box, width: Column, height: Column, slack: float = 1e-6) -> Column:
    """Positive size, no negative origin, and inside the picture up to `slack`."""
    x, y, w, h = [c.cast("double") for c in b]
    ok = (w > 0) & (h > 0) & (x >= 0) & (y >= 0) & (x + w <= width + slack) & (y + h <= height + slack)
    return F.coalesce(ok, F.lit(False))


def scale_polygon(flat: Column, width: Column, height: Column, bounded: bool = True) -> Column:
    """Pixel polygon to fractions of the picture, clamped to [0, 1] when `bounded`."""
    def one(v: Column, i: Column) -> Column:
        f = v / F.when(i % 2 == 0, width).otherwise(height)
        return clamp(f) if bounded else f

    return F.transform(flat, one)


def point_in_polygon(px: Column, py: Column, flat: Column) -> Column:
    """Even-odd test with border points counted as inside."""
    vx, vy = xs(flat), ys(flat)
    n = F.size(vx)

    def step(acc: Column, i: Column) -> Column:
        x1, y1 = F.get(vx, i), F.get(vy, i)
        x2, y2 = F.get(vx, (i + 1) % n), F.get(vy, (i + 1) % n)
        cross = (x2 - x1) * (py - y1) - (y2 - y1) * (px - x1)
        on_edge = (
            (F.abs(cross) <= 1e-9)
            & (px >= F.least(x1, x2)) & (px <= F.greatest(x1, x2))
            & (py >= F.least(y1, y2)) & (py <= F.greatest(y1, y2))
        )
        crosses = ((y1 > py) != (y2 > py)) & (px < (x2 - x1) * (py - y1) / F.when(y2 == y1, None).otherwise(y2 - y1) + x1)
        return F.struct(
            (acc["edge"] | on_edge).alias("edge"), (acc["odd"] != F.coalesce(crosses, F.lit(False))).alias("odd")
        )

    start = F.struct(F.lit(False).alias("edge"), F.lit(False).alias("odd"))
    return F.aggregate(F.sequence(F.lit(0), n - 1), start, step, lambda acc: acc["edge"] | acc["odd"])
