"""Annotation sets: format detection, merge with new ids, split, subset, mix."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.functions import geometry as G
from tracewright.operators import scale


def annotation_format(rotation: Column, bbox: Column) -> Column:
    return F.when(rotation.isNotNull(), "label_studio").when(F.size(bbox) == 5, "yolov8_obb").otherwise("coco_standard")


def file_format(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Format of a file = format of its last non-standard annotation."""
    odd = F.col("format") != "coco_standard"
    return rows.groupBy(*keys).agg(
        F.coalesce(F.max_by("format", F.when(odd, F.col("ann_id"))), F.lit("coco_standard")).alias("format"),
        F.count_if(odd).alias("rotated_count"),
        F.count(F.lit(1)).alias("total_count"),
    )


def to_polygon_rows(rows: DataFrame) -> DataFrame:
    """Rotated boxes get a polygon, five-value centre boxes also a corner box, plain boxes a rectangle."""
    b = F.col("bbox")
    x, y, w, h, turn = (F.get(b, F.lit(i)) for i in range(5))
    form = annotation_format(F.col("rotation"), b)
    missing = F.coalesce(F.size("segmentation") == 0, F.col("segmentation").isNull())
    rect = F.array(x, y, x + w, y, x + w, y + h, x, y + h)
    seg = (
        F.when(form == "label_studio", F.array(G.rotated_corners(x, y, w, h, F.col("rotation"))))
        .when(form == "yolov8_obb", F.array(G.rotated_corners(x, y, w, h, turn)))
        .when(missing, F.array(rect))
        .otherwise(F.col("segmentation"))
    )
    box = F.when(form == "yolov8_obb", F.array(x - w / 2, y - h / 2, w, h)).otherwise(b)
    return rows.withColumns({"format": form, "segmentation": seg, "bbox": box}).drop("rotation")


FILE_ORDER = ("file_idx", "pos")


def _order() -> list[Column]:
    return [F.col(c) for c in FILE_ORDER]


def merge_categories(categories: DataFrame, auto_map: bool) -> DataFrame:
    """(file_idx, old_id, name, new_id); with `auto_map` equal names share the first one's id."""
    if not auto_map:
        return scale.renumber(categories, _order(), "new_id")
    first = categories.groupBy("name").agg(F.min(F.struct("file_idx", "pos")).alias("f")).select("name", "f.*")
    ids = scale.renumber(first, _order(), "new_id").select("name", "new_id")
    return categories.join(ids, "name")


def merge_images(images: DataFrame) -> DataFrame:
    """Images of all files in (file, position) order with dense ids."""
    return scale.renumber(images, _order(), "new_id")


def merge_annotations(annotations: DataFrame, image_ids: DataFrame, category_ids: DataFrame) -> DataFrame:
    """Annotations with new image and category ids; those that resolve to neither are dropped."""
    im = image_ids.select("file_idx", F.col("old_id").alias("image_id"), F.col("new_id").alias("new_image_id"))
    cat = category_ids.select("file_idx", F.col("old_id").alias("category_id"), F.col("new_id").alias("new_category_id"))
    kept = annotations.join(im, ["file_idx", "image_id"]).join(cat, ["file_idx", "category_id"])
    return scale.renumber(kept, _order(), "new_id")


def repeated_names(images: DataFrame) -> DataFrame:
    """Images whose file name was used earlier in (file, position) order."""
    first = images.groupBy("file_name").agg(F.min(F.struct("file_idx", "pos")).alias("f"), F.count(F.lit(1)).alias("n"))
    return images.join(first.where("n > 1"), "file_name").where(F.struct("file_idx", "pos") > F.col("f")).drop("f", "n")


def shuffled(id_col: str, seed: int) -> Column:
    """Repeatable pseudo-random order key."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))


def split_by_ratio(items: DataFrame, id_col: str, seed: int, shares: Sequence[tuple[str, float]], rest: str,
                   within: Sequence[str] = ()) -> DataFrame:
    """Cut a shuffled order into named parts of floor(n * share); the remainder is `rest`.

    `within` cuts every stratum on its own.
    """
    keys = list(within)
    tagged = items.withColumn("_o", shuffled(id_col, seed))
    order = [F.col("_o"), F.col(id_col)]
    rank = scale.ranked(tagged, keys, order, "_k")
    if keys:
        sized = rank.join(items.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")), keys)
    else:
        sized = rank.withColumn("_n", F.lit(items.count()))
    done, part = F.lit(0).cast("bigint"), None
    for name, share in shares:
        done = done + F.floor(F.col("_n") * F.lit(share))
        part = F.when(F.col("_k") <= done, name) if part is None else part.when(F.col("_k") <= done, name)
    return sized.withColumn("split", part.otherwise(rest)).drop("_o", "_k", "_n")


def dominant_class(annotations: DataFrame) -> DataFrame:
    """Most frequent class of an image, smallest id on ties."""
    n = annotations.groupBy("image_id", "category_id").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("image_id").agg(F.min(F.struct(-F.col("n"), F.col("category_id"))).alias("m")).select(
        "image_id", F.col("m.category_id").alias("stratum"))


def first_n(items: DataFrame, order: Sequence[Column], n: int) -> DataFrame:
    return items.orderBy(*order).limit(n)


def last_wins(tasks: DataFrame, key: str, seq: str, keep: Sequence[str]) -> DataFrame:
    """One row per key with the values of its last row and the position of its first."""
    return tasks.groupBy(key).agg(
        F.min(seq).alias("first_pos"), F.max_by(F.struct(*keep), seq).alias("_r")
    ).select(key, "first_pos", "_r.*")


def renamed(image_id: Column, file_name: Column, lo: int, hi: int, by: int) -> Column:
    """File names of an id range moved up by `by` to make them unique."""
    number = F.regexp_extract(file_name, r"_(\d+)\.", 1).cast("bigint")
    return F.when(image_id.between(lo, hi), F.format_string("schematic_%03d.png", number + by)).otherwise(file_name)


def generated_labels(components: DataFrame, classes: dict[str, int], unknown: int | None = None) -> DataFrame:
    """Polygon labels of generated drawings: turned box, scaled to the canvas, clamped.

    Unknown types are left out, or get class `unknown` when it is given.
    """
    from tracewright.functions.labels import lookup

    corners = G.rotated_corners(F.col("x"), F.col("y"), F.col("w"), F.col("h"), F.col("rotation"))
    rows = components.withColumn("class_idx", lookup(F.col("type"), classes, None, unknown)).where("class_idx IS NOT NULL")
    return rows.withColumn("coords", G.scale_polygon(corners, F.col("width"), F.col("height")))


def synthetic_test_part(images: DataFrame, order: Sequence[Column], n: int) -> DataFrame:
    """The first `n` made test images, without those among them that were copied by hand before (`schemat` in the name)."""
    return first_n(images, order, n).where(~F.lower("file_name").contains("schemat"))
