"""Annotation quality: statistics, outliers, coverage and issue tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.functions import geometry as G
from tracewright.functions import metadata as M
from tracewright.operators import scale


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Linearly interpolated quantiles per group, exact, with no group held by one task.

    Equal values are counted first; the running count over range slices then tells
    which value stands at each wanted position.
    """
    counts = df.groupBy(*keys, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    sliced = scale.slice_by_order(counts, keys, [F.col("_v")])
    run = scale.running(sliced, keys, [F.col("_v")], {"_end": F.col("_c")})
    totals = sliced.groupBy(*keys).agg(F.sum("_c").alias("_n"))
    rows = scale.beside(run, totals, keys) if keys else run.withColumn("_n", F.lit(totals.first()["_n"]))
    start = F.col("_end") - F.col("_c")
    aggs = []
    for name, p in probs.items():
        pos = (F.col("_n") - 1) * F.lit(p)
        for tag, at in (("lo", F.floor(pos)), ("hi", F.ceil(pos))):
            aggs.append(F.max(F.when((start <= at) & (at < F.col("_end")), F.col("_v"))).alias(f"_{tag}_{name}"))
        aggs.append(F.max(pos - F.floor(pos)).alias(f"_f_{name}"))
    out = rows.groupBy(*keys).agg(*aggs)
    return out.select(
        *keys,
        *[(F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * F.col(f"_f_{n}")).alias(n) for n in probs],
    )


def category_statistics(annotations: DataFrame, categories: DataFrame) -> DataFrame:
    """Count, mean, population std, min, max, median and quartiles of area, aspect,
    width and height per category; categories without rows report zeros."""
    m = G.box_metrics(G.box())
    cells = []
    for name, c in (("area", m["area"]), ("aspect_ratio", m["aspect_ratio"]),
                    ("width", F.col("w").cast("double")), ("height", F.col("h").cast("double"))):
        cells.append(F.struct(F.lit(name).alias("measure"), c.alias("value")))
    long = annotations.select("category_id", F.explode(F.array(*cells)).alias("m")).select("category_id", "m.*")
    keys = ["category_id", "measure"]
    flat = long.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"),
    )
    quant = exact_quantiles(long, keys, "value", {"q25": 0.25, "median": 0.5, "q75": 0.75})
    grid = categories.withColumn("measure", F.explode(F.array(*[F.lit(x) for x in ("area", "aspect_ratio", "width", "height")])))
    stats = ["mean", "std", "min", "max", "q25", "median", "q75"]
    out = grid.join(flat.join(quant, keys), keys, "left").na.fill(0.0, stats).na.fill(0, ["n"])
    total = F.lit(annotations.count())
    return out.withColumn("percent", F.when(total > 0, F.col("n") * 100.0 / total).otherwise(0.0))


def area_outliers(annotations: DataFrame, threshold: float) -> DataFrame:
    """Rows whose area lies more than `threshold` population deviations from the category mean."""
    rows = annotations.withColumn("area", G.box_metrics(G.box())["area"])
    per = rows.groupBy("category_id").agg(
        F.avg("area").alias("_mean"), F.stddev_pop("area").alias("_std"), F.count(F.lit(1)).alias("_n"))
    z = F.abs((F.col("area") - F.col("_mean")) / F.col("_std"))
    return (
        rows.join(per.where("_n >= 2 AND _std > 0"), "category_id")
        .withColumn("z_score", z).where(F.col("z_score") > threshold).drop("_mean", "_std", "_n")
    )


def coverage_grid(annotations: DataFrame, width: Column, height: Column, rows: int, cols: int) -> DataFrame:
    """Number of box centres in each of rows x cols cells, empty cells included.

    `width` and `height` may be one fixed picture size or each picture's own.
    """
    cx, cy = G.centre(G.box())
    gx = F.least(F.greatest((cx / width * cols).cast("int"), F.lit(0)), F.lit(cols - 1))
    gy = F.least(F.greatest((cy / height * rows).cast("int"), F.lit(0)), F.lit(rows - 1))
    hits = annotations.groupBy(gy.alias("gy"), gx.alias("gx")).agg(F.count(F.lit(1)).alias("n"))
    spark = annotations.sparkSession
    grid = spark.range(rows * cols).select(
        F.floor(F.col("id") / cols).cast("int").alias("gy"), (F.col("id") % cols).cast("int").alias("gx"))
    return grid.join(hits, ["gy", "gx"], "left").na.fill(0, ["n"])


def image_summary(images: DataFrame, annotations: DataFrame, categories: DataFrame) -> DataFrame:
    """Per image total and a `name=count; ...` text, images without rows kept."""
    named = annotations.join(categories, "category_id", "left").withColumn(
        "name", F.coalesce("name", F.concat(F.lit("unknown_"), F.col("category_id").cast("string"))))
    per = named.groupBy("image_id", "name").agg(F.count(F.lit(1)).alias("n"))
    # one short entry per class name of the image
    text = per.groupBy("image_id").agg(
        F.sum("n").alias("total"), F.array_sort(F.collect_list(F.struct("name", "n"))).alias("d"))
    detail = F.array_join(F.transform("d", lambda e: F.concat(e["name"], F.lit("="), e["n"].cast("string"))), "; ")
    out = images.join(text.select("image_id", "total", detail.alias("detail")), "image_id", "left")
    return out.na.fill(0, ["total"]).na.fill("", ["detail"])


def metadata_coverage(regions: DataFrame) -> DataFrame:
    """Regions, with comment, with designator and with value per category and in total (category null)."""
    m = regions.withColumn("_m", M.comment_map(F.col("region_comment")))
    has = F.col("region_comment").isNotNull() & (F.col("region_comment") != "")
    return m.rollup("category").agg(
        F.count(F.lit(1)).alias("regions"),
        F.count_if(has).alias("with_metadata"),
        F.count_if(has & M.entry(F.col("_m"), "designator").isNotNull()).alias("with_designator"),
        F.count_if(has & M.entry(F.col("_m"), "value").isNotNull()).alias("with_value"),
    )


def missing_pairs(present: DataFrame, outer: str, inner: DataFrame, inner_key: str) -> DataFrame:
    """(outer, inner) combinations that do not occur, for two short key lists."""
    names = inner.agg(F.array_sort(F.collect_set(inner_key)).alias("a")).first()["a"]
    every = F.array(*[F.lit(n) for n in names])
    seen = present.groupBy(outer).agg(F.collect_set(inner_key).alias("_seen"))
    return seen.select(outer, F.explode(F.array_except(every, "_seen")).alias(inner_key))


def issue_rows(df: DataFrame, ids: Sequence[str], rules: Column) -> DataFrame:
    """One row per violated rule."""
    return df.select(*ids, F.explode(rules).alias("_i")).select(*ids, "_i.*")


def issue_totals(found: DataFrame, file_col: str) -> DataFrame:
    """Issues per file and severity with file and grand totals (null = all)."""
    return found.rollup(file_col, "severity").agg(F.count(F.lit(1)).alias("n"))


def polygon_issues(rows: DataFrame) -> Column:
    """Rules for one polygon `seg` of a picture `width` x `height` and its box w, h."""
    s = F.col("seg")
    n = F.size(s)
    short = n < 6
    px, py = G.xs(s), G.ys(s)
    outside = (F.array_min(px) < 0) | (F.array_min(py) < 0) | (F.array_max(px) > F.col("width")) | (F.array_max(py) > F.col("height"))
    return M.issues(
        M.issue(F.greatest(F.col("w"), F.lit(0)) * F.greatest(F.col("h"), F.lit(0)) <= 0, "error", "bbox", "zero_area_box"),
        M.issue(s.isNull(), "error", "segmentation", "missing"),
        M.issue(short, "error", "segmentation", "few_points"),
        M.issue(~short & (n % 2 != 0), "error", "segmentation", "odd_length"),
        M.issue(~short & (G.polygon_area(s) <= 0), "error", "segmentation", "zero_area"),
        M.issue(~short & outside, "error", "segmentation", "out_of_bounds"),
    )


def duplicated(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
