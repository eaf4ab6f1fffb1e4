"""Label text files: one file per image, one line per box or polygon."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.functions import labels as L


def read(spark: SparkSession, paths) -> DataFrame:
    """(stem, class_id, coords) of every line with at least three fields.

    The stem is the file name, or what stands before a tab in the line.
    """
    at = F.instr("value", "\t")
    raw = spark.read.text(paths).select(
        F.when(at > 0, F.substring_index("value", "\t", 1)).otherwise(F.regexp_replace(F.col("_metadata.file_name"), r"\.[^.]+$", "")).alias("stem"),
        F.when(at > 0, F.substring_index("value", "\t", -1)).otherwise(F.col("value")).alias("value"))
    coords = L.line_coords(F.col("value"))
    return raw.select("stem", L.line_class(F.col("value")).alias("class_id"), coords.alias("coords")).where("coords IS NOT NULL")


def write(lines: DataFrame, path: str) -> None:
    """Lines (split, stem, line_no, line) as `stem<tab>line` below split= folders; `read` gives them back.

    Rows are sorted inside each task; the number of files does not depend on the
    number of images.
    """
    ordered = lines.repartition("split", "stem").sortWithinPartitions("split", "stem", "line_no")
    ordered.select("split", F.concat_ws("\t", "stem", "line").alias("value")).write.mode("overwrite").partitionBy("split").text(path)


def write_class_list(categories: DataFrame, path: str) -> None:
    """`names:` list with dense indices in id order; the class list is short."""
    rows = categories.join(L.class_index(categories), "category_id").select("class_idx", F.format_string("  %d: %s", "class_idx", "name").alias("value"))
    rows.coalesce(1).sortWithinPartitions("class_idx").select("value").write.mode("overwrite").text(path)
