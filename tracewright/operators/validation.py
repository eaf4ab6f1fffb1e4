"""Issue tables for annotation files, connectors and file content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.functions import geometry as G
from tracewright.functions import metadata as M
from tracewright.session import stage


def coco_issues(annotations: DataFrame, images: DataFrame, categories: DataFrame) -> DataFrame:
    """Unknown image, else unknown category and invalid box, one row per finding."""
    im = images.select("file_idx", F.col("old_id").alias("image_id"), "width", "height", F.lit(True).alias("_im"))
    cat = categories.select(F.col("old_id").alias("category_id"), F.lit(True).alias("_cat")).distinct()
    rows = annotations.join(im, ["file_idx", "image_id"], "left").join(cat, "category_id", "left")
    known = F.col("_im").isNotNull()
    codes = F.array_compact(F.array(
        F.when(~known, "unknown_image"),
        F.when(known & F.col("_cat").isNull(), "unknown_category"),
        F.when(known & ~G.box_inside(G.box(), F.col("width"), F.col("height")), "invalid_box"),
    ))
    return rows.withColumn("code", F.explode(codes)).drop("_im", "_cat", "width", "height")


def name_conflicts(categories: DataFrame) -> DataFrame:
    """Categories named otherwise than in the first file that has their id."""
    first = categories.groupBy("id").agg(F.min_by("name", "file_idx").alias("first_name"))
    return categories.join(first, "id").where("name <> first_name").select("file_idx", "id", "name", "first_name")


def connector_issues() -> Column:
    shape, points = F.col("geometry.type"), F.col("geometry.points")
    ok_shape = F.coalesce(shape.isin("polygon", "rect", "polyline"), F.lit(False))
    return M.issues(
        M.issue(~F.coalesce(F.col("edge_id").rlike(M.EDGE_ID_SHAPE), F.lit(False)), "error", "edge_id", "edge_id_format"),
        M.issue(~F.coalesce(F.col("page").rlike(M.PAGE_SHAPE), F.lit(False)), "error", "page", "page_format"),
        M.issue(~ok_shape, "error", "geometry", "geometry_type"),
        M.issue(ok_shape & (F.coalesce(F.size(points), F.lit(0)) < 2), "error", "geometry", "geometry_points"),
    )


def content_copies(files: DataFrame, id_col: str, content: Column) -> DataFrame:
    """Rows whose content occurs more than once, with the number of copies.

    Rows, not lists: a hash shared by very many files stays spread out.
    """
    hashed = stage(files.select(id_col, F.sha2(content, 256).alias("hash")))  # contents are hashed once
    many = hashed.groupBy("hash").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")
    return hashed.join(many, "hash")


def sample_checks(components: DataFrame, files: DataFrame) -> DataFrame:
    """Components, designators and values per sample, and whether its picture is there."""
    filled = lambda c: F.coalesce(F.trim(F.col(c)) != "", F.lit(False))
    per = components.groupBy("request_id", "image").agg(
        F.count(F.lit(1)).alias("comps"), F.count_if(filled("component")).alias("designators"), F.count_if(filled("value")).alias("filled"))
    have = files.select("image", F.lit(True).alias("_f")).distinct()
    return per.join(have, "image", "left").withColumn("image_missing", F.col("_f").isNull()).drop("_f")


# fixed values: picture types a fixture folder may hold
PICTURES = (".png", ".jpg", ".jpeg", ".tif", ".tiff", ".bmp", ".pdf")


def fixture_issues(files: DataFrame, annotations: DataFrame, max_bytes: int) -> DataFrame:
    """Fixture folder rules: type, size, annotation present and complete, no copies.

    `files(name, length, hash)`, `annotations(stem, has_image, has_annotations)`.
    """
    ext = F.lower(F.regexp_extract("name", r"(\.[^.]+)$", 1))
    stem = F.regexp_replace("name", r"\.[^.]+$", "")
    copies = files.groupBy("hash").agg(F.count(F.lit(1)).alias("copies"))
    rows = files.join(copies, "hash").withColumn("stem", stem).join(annotations.withColumn("_a", F.lit(True)), "stem", "left")
    present = F.col("_a").isNotNull()
    return rows.select("name", F.explode(M.issues(
        M.issue(~ext.isin(*PICTURES), "warning", "name", "extension"),
        M.issue(F.col("length") > max_bytes, "warning", "length", "too_large"),
        M.issue(~present, "warning", "annotation", "missing_annotation"),
        M.issue(present & ~(F.col("has_image") & F.col("has_annotations")), "error", "annotation", "missing_keys"),
        M.issue(F.col("copies") > 1, "warning", "hash", "duplicate"),
    )).alias("i")).select("name", "i.*")
