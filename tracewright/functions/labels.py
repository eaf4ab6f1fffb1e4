"""Label text lines (`class x1 y1 x2 y2 ...`) and box unit conversions as Columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.functions import geometry as G

# fixed values: unrotated part sizes in pixels by class index
PART_SIZES = {0: (60, 20), 1: (20, 40), 2: (60, 20), 3: (40, 40), 4: (80, 60)}

# fixed values: default drawing size by part letter, and the size of unknown letters
DEFAULT_SIZES = {"R": (140, 40), "C": (100, 40), "L": (160, 50), "D": (120, 40), "A": (180, 120)}
OTHER_SIZE = (80, 50)


def lookup(key: Column, table: dict, pick: int | None = None, default=None) -> Column:
    """A short fixed table as one map literal, evaluated where the row is."""
    cells = []
    for k, v in table.items():
        cells += [F.lit(k), F.lit(v if pick is None else v[pick])]
    found = F.try_element_at(F.create_map(*cells), key)
    return found if default is None else F.coalesce(found, F.lit(default))


def class_index(categories: DataFrame) -> DataFrame:
    """(category_id, class_idx): position of an id among the sorted ids of the class list."""
    ids = categories.agg(F.array_sort(F.collect_set("category_id")).alias("ids"))
    return ids.select(F.posexplode("ids").alias("class_idx", "category_id"))


def fixed6(c: Column) -> Column:
    return F.format_string("%.6f", c)


def to_line(class_idx: Column, coords: Column) -> Column:
    return F.concat_ws(" ", class_idx.cast("string"), F.array_join(F.transform(coords, fixed6), " "))


def parts(line: Column) -> Column:
    return F.split(F.trim(line), r"\s+")


def line_class(line: Column) -> Column:
    return F.get(parts(line), F.lit(0)).cast("bigint")


def line_coords(line: Column) -> Column:
    """Coordinates of a line, null for lines with fewer than three fields."""
    p = parts(line)
    return F.when(F.size(p) >= 3, F.transform(F.slice(p, 2, F.size(p) - 1), lambda v: v.cast("double")))


def to_pixels(coords: Column, width: Column, height: Column) -> Column:
    return F.transform(coords, lambda v, i: F.bround(v * F.when(i % 2 == 0, width).otherwise(height), 2))


def centre_box(coords: Column) -> Column:
    """`[xc, yc, w, h]` around a polygon."""
    b = G.polygon_box(coords)
    x, y, w, h = (F.get(b, F.lit(i)) for i in range(4))
    return F.array(x + w / 2, y + h / 2, w, h)


def corners_to_centre_line(line: Column) -> Column:
    """Nine-field polygon line to `class xc yc w h`; other lines give null."""
    p = parts(line)
    coords = F.transform(F.slice(p, 2, 8), lambda v: v.cast("double"))
    return F.when(F.size(p) == 9, to_line(F.get(p, F.lit(0)), centre_box(coords)))


def percent_to_centre(x: Column, y: Column, w: Column, h: Column, max_size: float = 1.0) -> Column:
    """Percent box to clamped `[xc, yc, w, h]` fractions."""
    lo, hi = 0.0001, 0.9999
    return F.array(
        G.clamp((x + w / 2) / 100.0, lo, hi), G.clamp((y + h / 2) / 100.0, lo, hi),
        G.clamp(w / 100.0, lo, max_size), G.clamp(h / 100.0, lo, max_size),
    )


def percent_to_pixels(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> Column:
    """Percent box to integer `[x1, y1, x2, y2]`, at least one pixel wide and high."""
    def px(v: Column, size: Column) -> Column:
        return (v / 100.0 * size).cast("int")

    x1, y1 = px(x, width), px(y, height)
    return F.array(x1, y1, x1 + F.greatest(F.lit(1), px(w, width)), y1 + F.greatest(F.lit(1), px(h, height)))


def shift_label(coords: Column, class_idx: Column, width: Column, height: Column) -> Column:
    """Take half the part size off every vertex and clamp; unknown classes stay as they are."""
    w, h = lookup(class_idx, PART_SIZES, 0), lookup(class_idx, PART_SIZES, 1)
    moved = F.transform(
        coords,
        lambda v, i: G.clamp(v - F.when(i % 2 == 0, w / F.lit(2.0) / width).otherwise(h / F.lit(2.0) / height)),
    )
    return F.when(w.isNull(), coords).otherwise(moved)


def touches_edge(coords: Column) -> Column:
    return F.exists(coords, lambda v: (v == 0.0) | (v == 1.0))


def default_box(letter: Column, cx: Column, cy: Column, rotation: Column) -> Column:
    """`[x, y, w, h]` of a part without a given size, sides swapped when it stands upright."""
    key = F.upper(letter)
    w = lookup(key, DEFAULT_SIZES, 0, OTHER_SIZE[0]).cast("double")
    h = lookup(key, DEFAULT_SIZES, 1, OTHER_SIZE[1]).cast("double")
    upright = F.pmod(rotation, F.lit(180)) == 90
    ww, hh = F.when(upright, h).otherwise(w), F.when(upright, w).otherwise(h)
    return F.array(cx - ww / 2, cy - hh / 2, ww, hh)


def page_range(text: Column) -> Column:
    """`1,3-5,7` to sorted distinct page numbers; parts that are no numbers are ignored."""
    def numbers(part: Column) -> Column:
        cut = F.instr(part, "-")
        lo = F.trim(F.substring_index(part, "-", 1)).try_cast("int")
        hi = F.trim(F.substr(part, cut + 1)).try_cast("int")
        one = part.try_cast("int")
        empty = F.array().cast("array<int>")
        ranged = F.when((lo <= hi), F.sequence(lo, F.greatest(lo, hi))).otherwise(empty)
        single = F.when(one.isNotNull(), F.array(one)).otherwise(empty)
        return F.when(cut > 0, ranged).otherwise(single)

    trimmed = F.filter(F.transform(F.split(text, ","), lambda p: F.trim(p)), lambda p: p != "")
    return F.array_sort(F.array_distinct(F.flatten(F.transform(trimmed, numbers))))


def sector(comment: Column) -> Column:
    """First grid sector code A1..C3 that stands alone in the text."""
    return F.nullif(F.regexp_extract(F.upper(comment), r"\b([A-C][1-3])\b", 1), F.lit(""))


def region_unit_scale(max_coord: Column) -> Column:
    """Unit of a region's points: fraction up to 1, percent up to 100, else pixels."""
    return F.when(max_coord <= 1.0, "fraction").when(max_coord <= 100.0, "percent").otherwise("pixel")
