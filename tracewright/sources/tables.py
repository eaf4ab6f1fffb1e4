"""Logs, manifests, corrections, benchmark files and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright import schemas


def read_epochs(spark: SparkSession, paths) -> DataFrame:
    """Training log rows; column names hold slashes and brackets and need backticks."""
    return spark.read.schema(schemas.EPOCHS).option("header", True).option("ignoreLeadingWhiteSpace", True).csv(paths)


def read_corrections(spark: SparkSession, path: str, pattern: str = "*_corrections.json", lines: bool = False) -> DataFrame:
    """(request_id, component, value) of all matching files, one document a file or, with `lines`, one a line; broken ones are left out."""
    raw = spark.read.schema(schemas.CORRECTIONS).option("multiLine", not lines).option("pathGlobFilter", pattern).json(path)
    rows = raw.where("_corrupt_record IS NULL")
    return rows.select("request_id", F.explode("corrections").alias("c")).select("request_id", "c.*")


def append_corrections(corrections: DataFrame, path: str) -> None:
    """Add (request_id, component, value) rows with the time of this write to the store below `path`."""
    corrections.select("request_id", "component", "value", F.current_timestamp().alias("written")).write.mode("append").json(path)


def read_appended(spark: SparkSession, path: str) -> DataFrame:
    """(request_id, component, value) of what was appended; the last write of a request wins."""
    rows = spark.read.schema("request_id string, component string, value string, written timestamp").json(path)
    last = rows.groupBy("request_id").agg(F.max("written").alias("written"))
    return rows.join(last, ["request_id", "written"]).select("request_id", "component", "value")


def read_benchmarks(spark: SparkSession, path: str, pattern: str = "*.json") -> DataFrame:
    """Benchmark files of four shapes as one row type; unknown shapes and broken files keep a row."""
    raw = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(path)
    raw = raw.select(F.col("_metadata.file_path").alias("source_file"), F.try_parse_json("value").alias("d")).dropDuplicates(["source_file"])
    get = lambda v, p, t: F.try_variant_get(v, f"$.{p}", t)
    d = F.col("d")
    results, is_list = F.try_variant_get(d, "$.results", "array<variant>"), F.try_variant_get(d, "$", "array<variant>")
    kind = (
        F.when(d.isNull(), "error").when(results.isNotNull(), "1-ep-benchmark").when(get(d, "mean_latency_ms", "double").isNotNull(), "inference")
        .when(is_list.isNotNull(), "poc").when(get(d, "time_sec", "double").isNotNull(), "poc").otherwise("unknown"))
    items = F.when(results.isNotNull(), results).when(is_list.isNotNull(), is_list).otherwise(F.array(d))
    stem = lambda c: F.regexp_replace(F.element_at(F.split(c, "/"), -1), r"\.[^.]+$", "")
    rows = raw.withColumns({"type": kind, "i": F.explode_outer(items)})
    i = F.col("i")
    folder = F.element_at(F.split("source_file", "/"), -2)
    inf = F.col("type") == "inference"
    return rows.select(
        "source_file", "type",
        F.when(F.col("type") == "1-ep-benchmark", F.coalesce(get(d, "timestamp", "string"), stem(F.col("source_file"))))
        .when(inf, F.coalesce(F.element_at(F.split(get(d, "run_dir", "string"), "/"), -1), folder)).otherwise(stem(F.col("source_file"))).alias("run_name"),
        F.when(inf, stem(get(d, "weights", "string"))).otherwise(get(i, "model", "string")).alias("model"),
        get(i, "time_sec", "double").alias("time_sec"), get(i, "epochs", "int").alias("epochs"),
        F.coalesce(get(i, "batch", "int"), get(d, "batch", "int")).alias("batch"),
        get(d, "device", "string").alias("device"), get(d, "imgsz", "int").alias("imgsz"), get(d, "workers", "int").alias("workers"),
        *[get(d, c, "double").alias(c) for c in ("mean_latency_ms", "median_latency_ms", "std_latency_ms", "fps", "samples")])


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.MANIFEST).option("header", True).csv(path)


def append_manifest(rows: DataFrame, path: str) -> None:
    rows.select("filename", "label", "node_id", "degree", "position_row", "position_col", "timestamp").write.mode("append").option("header", True).csv(path)


def list_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, length, modified) of all files below a folder, contents unread."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return files.select("path", "length", F.col("modificationTime").alias("modified"))


def write_report(df: DataFrame, path: str, fmt: str = "json") -> None:
    """JSON lines or CSV with headers, a file per task."""
    w = df.write.mode("overwrite")
    w.option("header", True).csv(path) if fmt == "csv" else w.json(path)
