"""Detector output against ground truth: matching, precision/recall, AP, suppression."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.functions import geometry as G
from tracewright.functions import regions as R
from tracewright.operators import scale, spatial
from tracewright.session import stage

# fixed values: IoU levels of the averaged AP
IOU_LEVELS = (0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95)

SHAPE = ["x", "y", "w", "h"]


def score_order() -> list[Column]:
    """Score descending; equal scores keep image and prediction order."""
    return [F.col("score").desc(), F.col("image_id"), F.col("pred_id")]


def _prefixed(df: DataFrame, prefix: str, cols: Sequence[str]) -> DataFrame:
    return df.select(*[F.col(c).alias(prefix + c) if c in cols else F.col(c) for c in df.columns])


def shape_pairs(preds: DataFrame, truth: DataFrame, on: Sequence[str], min_iou: float) -> DataFrame:
    """Distinct prediction shapes x distinct truth shapes with IoU >= `min_iou`.

    Copies of one box collapse first, so a pile of equal boxes costs one pair.
    """
    left = _prefixed(preds.select(*on, *SHAPE).distinct(), "l_", SHAPE)
    right = _prefixed(truth.select(*on, *SHAPE).distinct(), "r_", SHAPE)
    pairs = spatial.overlap_join(left, right, on, counted=(preds, truth))
    return pairs.withColumn("iou", G.iou(G.box("l_"), G.box("r_"))).where(F.col("iou") >= min_iou)


def best_truth(preds: DataFrame, truth: DataFrame, on: Sequence[str], min_iou: float) -> DataFrame:
    """Each prediction with its highest-IoU truth box (the first of equals), if any reaches `min_iou`."""
    first = truth.groupBy(*on, *SHAPE).agg(F.min("ann_id").alias("ann_id"))
    best = (
        shape_pairs(preds, truth, on, min_iou)
        .join(_prefixed(first, "r_", SHAPE), [*on, *["r_" + c for c in SHAPE]])
        .groupBy(*on, *["l_" + c for c in SHAPE])
        .agg(F.min(F.struct((-F.col("iou")).alias("n"), F.col("ann_id"))).alias("b"))
        .select(*on, *[F.col("l_" + c).alias(c) for c in SHAPE], F.col("b.ann_id"), (-F.col("b.n")).alias("iou"))
    )
    return preds.join(best, [*on, *SHAPE])


def true_positives(preds: DataFrame, truth: DataFrame, min_iou: float) -> DataFrame:
    """Predictions flagged `tp`: the first claimant, in score order, of its best box."""
    on = ["image_id", "category_id"]
    best = best_truth(preds, truth, on, min_iou)
    first = best.groupBy("model", "ann_id").agg(
        F.min(F.struct((-F.col("score")).alias("s"), F.col("image_id"), F.col("pred_id"))).alias("f")
    ).select("model", F.col("f.pred_id").alias("pred_id"), "ann_id", F.lit(True).alias("tp"))
    return preds.join(first, ["model", "pred_id"], "left").withColumn("tp", F.coalesce("tp", F.lit(False)))


def truth_counts(truth: DataFrame) -> DataFrame:
    return truth.groupBy("category_id").agg(F.count(F.lit(1)).alias("npos"))


def average_precision(preds: DataFrame, truth: DataFrame, levels: Sequence[float] = IOU_LEVELS) -> DataFrame:
    """AP per model, class and IoU level.

    A class is ranked once for all levels. Only true positives change recall, and
    precision peaks at them, so the envelope is taken over those rows alone.
    Classes seen only in predictions count with AP 0.
    """
    keys = ["model", "category_id"]
    order = score_order()
    sliced = scale.slice_by_order(preds, keys, order)
    rank = scale.running(sliced, keys, order, {"rank": F.lit(1).cast("bigint")})
    best = best_truth(rank, truth, ["image_id", "category_id"], min(levels))
    reach = F.filter(F.array(*[F.lit(float(v)) for v in levels]), lambda v: v <= F.col("iou"))
    hits = stage(
        best.withColumn("level", F.explode(reach))
        .groupBy("model", "category_id", "ann_id", "level")
        .agg(F.min(F.struct("rank", scale.SLICE)).alias("f"))
        .select("model", "category_id", "level", "f.rank", F.col(f"f.{scale.SLICE}").alias(scale.SLICE))
    )
    lkeys = [*keys, "level"]
    at = [F.col("rank")]
    cum = scale.running(hits, lkeys, at, {"tp_cum": F.lit(1).cast("bigint")})
    cum = cum.withColumn("precision", F.col("tp_cum") / F.col("rank"))
    env = scale.suffix_max(cum, lkeys, at, F.col("precision"), "envelope")
    area = env.groupBy(*lkeys).agg(F.sum("envelope").alias("area"))
    # every model is graded on every class of either side: two short lists of names
    names = (
        preds.select("model", "category_id").unionByName(truth.select(F.lit(None).cast("string").alias("model"), "category_id"))
        .agg(F.collect_set("model").alias("m"), F.collect_set("category_id").alias("c"))
    )
    seen = names.select(F.explode("m").alias("model"), "c").select("model", F.explode("c").alias("category_id"))
    grid = seen.withColumn("level", F.explode(F.array(*[F.lit(float(v)) for v in levels])))
    return (
        grid.join(area, lkeys, "left")
        .join(truth_counts(truth), "category_id", "left")
        .select(*lkeys, F.coalesce(F.col("npos"), F.lit(0)).alias("npos"),
                F.coalesce(F.col("area") / F.col("npos"), F.lit(0.0)).alias("ap"))
    )


def mean_ap(ap: DataFrame) -> DataFrame:
    """Mean over classes per level, plus the mean over all levels (level = null)."""
    per = ap.groupBy("model", "level").agg(F.avg("ap").alias("map"), F.count(F.lit(1)).alias("n_classes"))
    whole = per.groupBy("model").agg(F.avg("map").alias("map"), F.max("n_classes").alias("n_classes"))
    return per.unionByName(whole.withColumn("level", F.lit(None).cast("double")).select(*per.columns))


def class_mean_ap(ap: DataFrame) -> DataFrame:
    return ap.groupBy("model", "category_id").agg(F.avg("ap").alias("mean_ap"))


def free_box_matches(preds: DataFrame, truth: DataFrame, min_iou: float) -> DataFrame:
    """(model, pred_id, ann_id): one-to-one matches where each prediction of a model, in score order, takes its best free box.

    Boxes of one shape are one target with as many places; the place that a prediction
    gets, in score order, is the box with that number, so n equal predictions on m equal
    boxes are n rows. Only shapes that lie equally well for some prediction are taken
    box by box: there the first box decides, not the shape.
    """
    on = ["image_id", "category_id"]
    l_cols, r_cols = ["l_" + c for c in SHAPE], ["r_" + c for c in SHAPE]
    shapes = stage(shape_pairs(preds, truth, on, min_iou))
    equal = shapes.groupBy(*on, *l_cols, "iou").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    single = shapes.join(equal, [*on, *l_cols, "iou"], "left_semi").select(*on, *r_cols).distinct().withColumn("single", F.lit(True))
    piles = truth.groupBy(*on, *SHAPE).agg(F.count(F.lit(1)).alias("n"), F.min("ann_id").alias("first"))
    largest = piles.agg(F.max("n")).first()[0] or 0
    boxes = scale.placed(truth.select("ann_id", *on, *SHAPE), [*on, *SHAPE], [F.col("ann_id")], "place", largest)
    boxes = _prefixed(boxes, "r_", SHAPE).join(single, [*on, *r_cols], "left")
    # a target is a shape with its places, or a box of a shape in a tie
    target = F.struct(*on, *r_cols, F.when(F.col("single"), F.col("ann_id")).alias("box"))
    boxes = stage(boxes.select("ann_id", *on, *r_cols, target.alias("target"), F.when(F.col("single"), F.lit(1)).otherwise(F.col("place")).alias("place")))
    targets = boxes.groupBy(*on, *r_cols, "target").agg(F.max("place").alias("places"), F.min("ann_id").alias("first"))
    pairs = (
        shapes.join(targets, [*on, *r_cols])
        .join(_prefixed(preds, "l_", SHAPE), [*on, *l_cols])
        .select(F.struct("model", "pred_id").alias("pred"), F.struct("model", "target").alias("box"), "iou", "first", "places", "score", "image_id")
    )
    # every model has the boxes to itself
    rank = [(-F.col("score")).alias("s"), F.col("image_id"), F.col("pred.pred_id").alias("p")]
    got = scale.priority_matching(pairs, "pred", "box", rank, [(-F.col("iou")).alias("i"), F.col("first")], F.col("places"))
    return got.select("pred.*", "box.target", "place").join(boxes.select("target", "place", "ann_id"), ["target", "place"]).select("model", "pred_id", "ann_id")


def threshold_index(score: Column, steps: int = 100) -> Column:
    """Largest k with k/steps <= score, compared in doubles as an evenly spaced grid gives them."""
    width = F.lit(1.0 / steps)
    g = F.floor(score / width)
    return F.when((g + 1) * width <= score, g + 1).when(g * width <= score, g).otherwise(g - 1)


def threshold_curve(preds: DataFrame, truth: DataFrame, min_iou: float = 0.5, steps: int = 100) -> DataFrame:
    """Precision, recall and F1 per model and class at `steps + 1` score thresholds.

    The matching of all predictions, cut at a score, is the matching of that
    prefix, so one run serves every threshold; counts per threshold bin are tiny.
    """
    hit = free_box_matches(preds, truth, min_iou).select("model", "pred_id", F.lit(1).alias("hit"))
    bins = (
        preds.join(hit, ["model", "pred_id"], "left")
        .groupBy("model", "category_id", threshold_index(F.col("score"), steps).alias("k"))
        .agg(F.count("hit").alias("tp"), F.count(F.lit(1)).alias("n"))
    )
    # a class counts for every model, also for one that never names it
    models = [F.lit(r.model) for r in preds.select("model").distinct().collect()]
    every = truth_counts(truth).withColumn("model", F.explode(F.array(*models).cast("array<string>")))
    grid = every.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(steps)).cast("array<bigint>")))
    down = Window.partitionBy("model", "category_id").orderBy(F.col("k").desc())  # steps + 1 rows per class
    cum = (
        grid.join(bins, ["model", "category_id", "k"], "left")
        .withColumn("tp", F.sum(F.coalesce("tp", F.lit(0))).over(down))
        .withColumn("n", F.sum(F.coalesce("n", F.lit(0))).over(down))
    )
    p = F.when(F.col("n") > 0, F.col("tp") / F.col("n")).otherwise(F.lit(0.0))
    r = F.when(F.col("npos") > 0, F.col("tp") / F.col("npos")).otherwise(F.lit(0.0))
    out = cum.withColumns({"precision": p, "recall": r})
    total = F.col("precision") + F.col("recall")
    return out.withColumn(
        "f1", F.when(total > 0, 2 * F.col("precision") * F.col("recall") / total).otherwise(F.lit(0.0))
    )


def best_thresholds(curve: DataFrame, min_recall: float) -> DataFrame:
    """Best-F1 threshold and best-precision threshold with a recall floor, first on ties."""
    k = F.col("k")
    floor = F.col("recall") >= min_recall
    row = F.struct("k", "precision", "recall", "f1")
    return (
        curve.groupBy("model", "category_id")
        .agg(
            F.min_by(row, F.struct(-F.col("f1"), k)).alias("b"),
            F.min_by(F.when(floor, row), F.when(floor, F.struct(-F.col("precision"), k))).alias("p"),
        )
        .withColumn("p", F.coalesce("p", "b"))
        .select(
            "model", "category_id",
            F.col("b.k").alias("best_k"), F.col("b.f1").alias("best_f1"),
            F.col("p.k").alias("prec_k"), F.col("p.precision").alias("prec_at"), F.col("p.recall").alias("rec_at"),
        )
    )


def suppress(preds: DataFrame, max_iou: float) -> DataFrame:
    """Greedy non-maximum suppression per model, image and label.

    Exact copies fall to the first of them at once; the rest meet only where they overlap.
    """
    on = ["model", "image_id", "category_id"]
    key = F.struct((-F.col("score")).alias("s"), F.col("pred_id"))
    one = preds.groupBy(*on, *SHAPE).agg(F.min(key).alias("k")).withColumn(
        "node", F.struct("model", F.col("k.pred_id").alias("pred_id"))
    )
    left = _prefixed(one, "l_", [*SHAPE, "k", "node"])
    right = _prefixed(one, "r_", [*SHAPE, "k", "node"])
    pairs = (
        spatial.overlap_join(left, right, on)
        .where((F.col("l_k") < F.col("r_k")) & (G.iou(G.box("l_"), G.box("r_")) >= max_iou))
        .select(F.col("l_node").alias("earlier"), F.col("r_node").alias("later"))
    )
    kept = scale.greedy_independent(one.select("node"), pairs, "node")
    return preds.join(kept.select("node.model", "node.pred_id"), ["model", "pred_id"], "left_semi")


def best_iou_per_truth(preds: DataFrame, truth: DataFrame) -> DataFrame:
    """Best box IoU of every truth box on images where the model has output, 0 without overlap."""
    left = _prefixed(preds.select("model", "image_id", *SHAPE).distinct(), "l_", SHAPE)
    right = _prefixed(truth.select("image_id", *SHAPE).distinct(), "r_", SHAPE)
    best = (
        spatial.overlap_join(left, right, ["image_id"])
        .groupBy("model", "image_id", *["r_" + c for c in SHAPE])
        .agg(F.max(G.iou(G.box("l_"), G.box("r_"))).alias("iou"))
        .select("model", "image_id", *[F.col("r_" + c).alias(c) for c in SHAPE], "iou")
    )
    both = truth.join(preds.select("model", "image_id").distinct(), "image_id")
    return both.join(best, ["model", "image_id", *SHAPE], "left").withColumn("iou", F.coalesce("iou", F.lit(0.0)))


def compare_classes(mean_aps: DataFrame, first: str, second: str) -> DataFrame:
    """Full outer comparison of two models by class, a missing side counting 0."""
    a = mean_aps.where(F.col("model") == first).select("category_id", F.col("mean_ap").alias("ap_first"))
    b = mean_aps.where(F.col("model") == second).select("category_id", F.col("mean_ap").alias("ap_second"))
    both = a.join(b, "category_id", "full_outer").na.fill(0.0, ["ap_first", "ap_second"])
    return both.withColumn("delta", F.col("ap_second") - F.col("ap_first"))


def advice(first: Column, second: Column) -> Column:
    """Five-branch advice for a class; fixed values: 0.01, 0.05, 0.3, 0.2."""
    return (
        F.when((first <= 0.01) & (second <= 0.01), "no_detections")
        .when((first <= 0.05) & (second >= 0.3), "second_better")
        .when((second <= 0.05) & (first >= 0.3), "first_better")
        .when((first < 0.2) & (second < 0.2), "both_weak")
        .otherwise("moderate")
    )


def mask_iou(truth: DataFrame, preds: DataFrame, on: Sequence[str]) -> DataFrame:
    """Best mask IoU of every truth object where its picture has predictions.

    `truth(*on, gt, px, py)` and `preds(*on, pr, px, py)` hold foreground pixels.
    """
    keys = list(on)
    common = truth.join(preds, [*keys, "px", "py"]).groupBy(*keys, "gt", "pr").agg(F.count(F.lit(1)).alias("i"))
    size = lambda df, k, n: df.groupBy(*keys, k).agg(F.count(F.lit(1)).alias(n))
    a, b = size(truth, "gt", "a"), size(preds, "pr", "b")
    union = F.col("a") + F.col("b") - F.col("i")
    best = common.join(a, [*keys, "gt"]).join(b, [*keys, "pr"]).groupBy(*keys, "gt").agg(F.max(F.col("i") / union).alias("iou"))
    both = a.join(preds.select(*keys).distinct(), keys)
    return both.join(best, [*keys, "gt"], "left").select(*keys, "gt", F.coalesce("iou", F.lit(0.0)).alias("iou"))


def _shapes(df: DataFrame, keys: Sequence[str], name: str, side: str) -> DataFrame:
    """(*keys, name, box, shape, polygons, place) of every object of `df(*keys, name, points)`, columns marked by `side`.

    Polygons of whole numbers are moved to the origin, which moves their pixels alike, so objects of one
    form share a shape wherever they lie. Other polygons stay in place, as rounding is not the same everywhere.
    """
    point = lambda p, i: F.get(p, F.lit(i)).cast("double")
    axis = lambda i: F.transform(F.flatten("_polys"), lambda p: point(p, i))
    objects = df.where(F.size("points") >= 3).groupBy(*keys, name).agg(F.collect_set("points").alias("_polys")).select(
        *keys, name, "_polys", axis(0).alias("_xs"), axis(1).alias("_ys"))
    whole = F.coalesce(F.forall(F.concat("_xs", "_ys"), lambda v: (v == F.floor(v)) & (F.abs(v) < 2.0**31)), F.lit(False))
    low = lambda c: F.floor(F.array_min(c))
    place = lambda c: F.when(whole, low(c)).otherwise(F.lit(0).cast("bigint"))
    moved = objects.select("*", place("_xs").alias(side + "px"), place("_ys").alias(side + "py")).withColumn("_polys", F.sort_array(F.transform("_polys", lambda poly: F.transform(
        poly, lambda p: F.array(point(p, 0) - F.col(side + "px"), point(p, 1) - F.col(side + "py"))))))
    return moved.select(
        *keys, name, low("_xs").alias(side + "x"), low("_ys").alias(side + "y"), (F.ceil(F.array_max("_xs")) - low("_xs") + 1).alias(side + "w"),
        (F.ceil(F.array_max("_ys")) - low("_ys") + 1).alias(side + "h"), F.struct(F.xxhash64("_polys"), F.xxhash64(F.lit(1), "_polys")).alias(side + "shape"),
        F.col("_polys").alias(side + "polys"), side + "px", side + "py")


def polygon_mask_iou(truth: DataFrame, preds: DataFrame, on: Sequence[str]) -> DataFrame:
    """Best mask IoU of every truth object where its picture has predictions, from polygons.

    `truth(*on, gt, points)` and `preds(*on, pr, points)`; the polygons of an object are one
    mask. Objects meet only if their extents overlap, as two shapes and the way from one to the other;
    each such meeting is worked out once, however many pairs have it. Shapes are kept as spans per
    line; lengths of common spans are added up, no pixel is a row. An object without pixels has IoU 0.
    """
    keys = list(on)
    left, right = stage(_shapes(truth, keys, "gt", "l_")), stage(_shapes(preds, keys, "pr", "r_"))
    shapes = left.select(F.col("l_shape").alias("shape"), F.col("l_polys").alias("polys")).unionByName(right.select(F.col("r_shape").alias("shape"), F.col("r_polys").alias("polys"))).distinct()
    lines = stage(R.polygon_lines(shapes.select("shape", F.explode("polys").alias("points")), ["shape"]))
    top = F.greatest("l_y", "r_y")
    bottom = F.least(F.col("l_y") + F.col("l_h"), F.col("r_y") + F.col("r_h"))
    way = ["l_shape", "r_shape", "dx", "dy", "top", "bottom"]
    pairs = stage(spatial.overlap_join(left.drop("l_polys"), right.drop("r_polys"), keys).select(
        *keys, "gt", "l_shape", "r_shape", (F.col("r_px") - F.col("l_px")).alias("dx"), (F.col("r_py") - F.col("l_py")).alias("dy"),
        (top - F.col("l_py")).alias("top"), (bottom - F.col("l_py")).alias("bottom")))
    of = lambda p: lines.select(F.col("shape").alias(p + "shape"), F.col("_y").alias(p + "y"), F.col("_a").alias(p + "a"), F.col("_z").alias(p + "z"))
    size = lambda p: lines.groupBy(F.col("shape").alias(p + "shape")).agg(F.sum(F.col("_z") - F.col("_a") + 1).alias(p + "n"))
    mine = pairs.select(way).distinct().join(of("l_"), "l_shape").where((F.col("l_y") >= F.col("top")) & (F.col("l_y") < F.col("bottom"))).withColumn("r_y", F.col("l_y") - F.col("dy"))
    both = mine.join(of("r_"), ["r_shape", "r_y"]).withColumns({"r_a": F.col("r_a") + F.col("dx"), "r_z": F.col("r_z") + F.col("dx")}).where("r_a <= l_z AND l_a <= r_z")
    common = both.groupBy(way).agg(F.sum(F.least("r_z", "l_z") - F.greatest("r_a", "l_a") + 1).alias("i")).join(size("l_"), "l_shape").join(size("r_"), "r_shape")
    met = stage(common.select(*way, (F.col("i") / (F.col("l_n") + F.col("r_n") - F.col("i"))).alias("iou")))
    best = pairs.join(met, way).groupBy(*keys, "gt").agg(F.max("iou").alias("iou"))
    every = truth.select(*keys, "gt").distinct().join(preds.select(*keys).distinct(), keys)
    return every.join(best, [*keys, "gt"], "left").select(*keys, "gt", F.coalesce("iou", F.lit(0.0)).alias("iou"))
