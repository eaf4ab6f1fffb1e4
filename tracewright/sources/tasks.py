"""Labelling-tool exports: tasks, their results, and what the results become."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright import schemas
from tracewright.functions import geometry as G
from tracewright.functions import metadata as M
from tracewright.functions.labels import lookup
from tracewright.sources import documents

_COLS = ["id", "file_upload", "data", "annotations", "completions", "predictions", "result"]


def read(spark: SparkSession, paths) -> DataFrame:
    """Tasks of export files: arrays of tasks, `{tasks: [...]}` objects, and single tasks of up to 64 MB.

    A file is cut into ranges, so one export of any size is read by many tasks.
    """
    found = documents.records(spark, paths)
    listed = found.where("key IS NULL OR key = 'tasks'").select("file_id", F.from_json("record", schemas.TASK).alias("t"))
    alone = found.where("key = ''").select("file_id", F.from_json("record", f"{schemas.TASK}, tasks array<string>").alias("t")).where("t.tasks IS NULL")
    return listed.select("file_id", *[f"t.{c}" for c in _COLS]).unionByName(alone.select("file_id", *[f"t.{c}" for c in _COLS]))


def _has(c: str) -> Column:
    return F.col(c).isNotNull() & (F.size(c) > 0)


def first_results(tasks: DataFrame) -> DataFrame:
    """One row per result of the first group that has any, else of the task itself: (..., idx, r)."""
    groups = F.when(_has("annotations"), F.col("annotations")).when(_has("completions"), F.col("completions")).otherwise(F.col("predictions"))
    some = lambda r: F.when(F.size(r) > 0, r)
    filled = F.filter(F.transform(groups, lambda g: F.coalesce(some(g["result"]), some(g["response"]))), lambda r: r.isNotNull())
    chosen = F.coalesce(F.get(filled, F.lit(0)), F.col("result"))
    return tasks.select(*[c for c in tasks.columns if c not in ("annotations", "completions", "predictions", "result")],
                        F.posexplode(chosen).alias("idx", "r"))


def all_results(tasks: DataFrame) -> DataFrame:
    """One row per result of every annotation group."""
    return tasks.select("*", F.explode("annotations").alias("_g")).select(*tasks.columns, F.explode("_g.result").alias("r"))


#: Endings of picture names; fixed values.
_ENDINGS = (".png", ".jpg", ".jpeg")


def image_reference() -> Column:
    """First value under any key of `data` that names a picture: by its ending, or a web address that holds one."""
    named = lambda v: F.lower(v).rlike("(" + "|".join(e.replace(".", "[.]") for e in _ENDINGS) + ")$") | (v.startswith("http") & v.rlike("|".join(e.replace(".", "[.]") for e in _ENDINGS)))
    return F.get(F.filter(F.map_values("data"), lambda v: v.isNotNull() & named(v)), F.lit(0))


def image_name() -> Column:
    return F.element_at(F.split(image_reference(), "/"), -1)


def component(r: Column) -> dict[str, Column]:
    """Label, value and box of a result; `designator` and `value` of its meta text come first."""
    v = r["value"]
    one = lambda c: F.get(c, F.lit(0))
    notes = M.comment_map(F.array_join(r["meta"]["text"], " "))
    label = F.coalesce(M.entry(notes, "designator"), one(v["rectanglelabels"]), one(v["labels"]), one(v["choices"]),
                       r["from_name"], r["annotationType"], r["type"])
    value = F.coalesce(F.nullif(v["text"], F.lit("")), M.entry(notes, "value"))
    box = F.array(v["x"], v["y"], v["width"], v["height"])
    return {"label": label, "value": value, "bbox": F.when(~F.exists(box, lambda c: c.isNull()), box)}


def _points(points: Column, width: Column, height: Column) -> Column:
    """Percent points to a flat pixel polygon."""
    return F.flatten(F.transform(points, lambda p: F.array(F.get(p, F.lit(0)) / 100 * width, F.get(p, F.lit(1)) / 100 * height)))


def _rect(v: Column, width: Column, height: Column) -> Column:
    x, y, w, h = v["x"] / 100 * width, v["y"] / 100 * height, v["width"] / 100 * width, v["height"] / 100 * height
    return G.rotated_corners(x + w / 2, y + h / 2, w, h, -F.coalesce(v["rotation"], F.lit(0.0)))


def polygons(results: DataFrame, classes: dict[str, int]) -> DataFrame:
    """Annotation rows from rectangles (turned, or given by points) and polygons.

    Needs r, width, height. `skipped` marks labels that are in no class; other
    result types give no row. The area is that of the box.
    """
    r, v = F.col("r"), F.col("r.value")
    width, height = F.col("width"), F.col("height")
    is_rect, is_poly = r["type"] == "rectanglelabels", r["type"] == "polygonlabels"
    has_points = v["points"].isNotNull()
    label = F.when(is_rect, F.get(v["rectanglelabels"], F.lit(0))).otherwise(F.get(v["polygonlabels"], F.lit(0)))
    seg = F.when(is_rect & ~has_points, _rect(v, width, height)).otherwise(_points(v["points"], width, height))
    method = F.when(is_poly, "polygon").when(has_points, "rectangle_as_polygon").otherwise("rotated_rectangle")
    out = results.where(is_rect | is_poly).withColumns({
        "category_id": lookup(label, classes), "segmentation": seg, "method": method,
        "rotation": F.when(method == "rotated_rectangle", F.coalesce(v["rotation"], F.lit(0.0)))})
    box = G.polygon_box(F.col("segmentation"))
    out = out.withColumn("bbox", box).withColumn("area", F.get("bbox", F.lit(2)) * F.get("bbox", F.lit(3)))
    return out.withColumn("skipped", F.col("category_id").isNull()).drop("r")


def ignore_regions(results: DataFrame, labels) -> DataFrame:
    """Rows for shapes under an ignore label: polygon points in pixels, or a brush placeholder."""
    r, v = F.col("r"), F.col("r.value")
    width, height = F.coalesce("width", F.lit(1000)), F.coalesce("height", F.lit(1000))
    one = lambda c: F.get(c, F.lit(0))
    label = F.coalesce(*[one(v[k]) for k in ("polygonlabels", "rectanglelabels", "brushlabels", "labels", "choices")])
    pts = (
        F.when((r["type"] == "polygonlabels") & v["points"].isNotNull(), _points(v["points"], width, height))
        .when((r["type"] == "rectanglelabels") & v["x"].isNotNull() & v["width"].isNotNull(), _rect(v, width, height)))
    kind = F.when(pts.isNotNull(), "polygon").when(r["type"] == "brushlabels", "brush")
    return results.withColumns({"label": label, "kind": kind, "points": pts}).where(F.col("label").isin(*labels) & F.col("kind").isNotNull()).drop("r")


def task_for_image(images: DataFrame, tasks: DataFrame) -> DataFrame:
    """First task whose upload name or picture reference contains the image name.

    `images(image, ...)`, `tasks(ord, file_upload, image_ref)`. References are short,
    so they are cut into all their pieces as long as some image name, and joined.
    """
    names = images.select("image").distinct()
    lengths = [r.n for r in names.select(F.length("image").alias("n")).distinct().collect() if r.n]  # a few dozen file-name lengths
    sides = tasks.select("ord", F.explode(F.array_compact(F.array("file_upload", "image_ref"))).alias("ref"))
    cut = sides.select("ord", "ref", F.explode(F.array(*[F.lit(n) for n in lengths]).cast("array<int>")).alias("n")).where(F.length("ref") >= F.col("n"))
    pieces = cut.select("ord", F.explode(F.transform(F.sequence(F.lit(1), F.length("ref") - F.col("n") + 1), lambda i: F.substring("ref", i, F.col("n")))).alias("image"))
    first = pieces.groupBy("image").agg(F.min("ord").alias("ord")).join(names, "image", "left_semi")
    return images.join(first, "image", "left")
