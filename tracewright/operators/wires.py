"""Wire graphs: incidence, nets, degrees, confidence, repair, assembly and decks.

Sheets are the outer key. Node numbers are the numeric suffix of a node id.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.functions import geometry as G
from tracewright.functions import metadata as M
from tracewright.functions.labels import lookup
from tracewright.operators import forests, scale, spatial
from tracewright.session import stage


def incidence(segments: DataFrame) -> DataFrame:
    """One row per segment end: (sheet_id, segment_id, n)."""
    return segments.select("sheet_id", "segment_id", F.explode(F.array("a", "b")).alias("n"))


def edges_from_incidence(inc: DataFrame) -> DataFrame:
    """(source, target) of segments with exactly two ends; `skipped` marks the others."""
    per = inc.groupBy("sheet_id", "segment_id").agg(F.count(F.lit(1)).alias("ends"), F.min("n").alias("source"), F.max("n").alias("target"))
    ok = F.col("ends") == 2
    return per.select(
        "sheet_id", "segment_id", F.when(ok, F.col("source")).alias("source"), F.when(ok, F.col("target")).alias("target"), (~ok).alias("skipped"))


def simple_edges(edges: DataFrame) -> DataFrame:
    """Distinct unordered node pairs; parallels collapse, self-loops stay."""
    return edges.select("sheet_id", F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).distinct()


def adjacency(edges: DataFrame) -> DataFrame:
    """(sheet_id, n, neighbour) rows; a self-loop lists the node once."""
    e = simple_edges(edges)
    return e.select("sheet_id", F.col("a").alias("n"), F.col("b").alias("neighbour")).unionByName(
        e.where("a <> b").select("sheet_id", F.col("b").alias("n"), F.col("a").alias("neighbour")))


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Degree on the simple graph (a self-loop counts 2) and number of neighbours of every node."""
    d = adjacency(edges).groupBy("sheet_id", "n").agg(
        F.sum(F.when(F.col("n") == F.col("neighbour"), 2).otherwise(1)).alias("degree"), F.count(F.lit(1)).alias("neighbours"))
    return nodes.join(d, ["sheet_id", "n"], "left").na.fill(0, ["degree", "neighbours"])


def node_class(ends: Column, given: Column | None = None) -> Column:
    """essential, non_essential, endpoint or isolated by the number of ends, unless a class is given."""
    made = F.when(ends >= 3, "essential").when(ends == 2, "non_essential").when(ends == 1, "endpoint").otherwise("isolated")
    return made if given is None else F.when(given.isNotNull() & (given != "unspecified"), given).otherwise(made)


def nets(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(sheet_id, n, root): the numerically first node of the net a node belongs to."""
    e = simple_edges(edges).where("a <> b")
    flat = scale.connected_components(e, ["sheet_id"]).withColumnRenamed("node", "n")
    return nodes.join(flat, ["sheet_id", "n"], "left").withColumn("root", F.coalesce("root", "n"))


def node_labels(nodes: DataFrame) -> DataFrame:
    """`N001`... per sheet in numeric id order."""
    r = scale.ranked(nodes, ["sheet_id"], [F.col("n")], "_k")
    return r.withColumn("label", F.format_string("N%03d", "_k")).drop("_k")


def net_labels(members: DataFrame) -> DataFrame:
    """`NET001`... per sheet; nets are ordered by the text of their numerically first node id."""
    per = members.groupBy("sheet_id", "root").agg(F.count(F.lit(1)).alias("size"))
    per = per.withColumn("_t", F.concat(F.lit("node-"), F.col("root").cast("string")))
    return scale.ranked(per, ["sheet_id"], [F.col("_t")], "_k").withColumn("net", F.format_string("NET%03d", "_k")).drop("_k", "_t")


def cycle_rank(members: DataFrame, edges: DataFrame) -> DataFrame:
    """Independent cycles per sheet: edges - nodes + nets on the simple graph."""
    v = members.groupBy("sheet_id").agg(F.count(F.lit(1)).alias("nodes"), F.count_if(F.col("n") == F.col("root")).alias("nets"))
    e = simple_edges(edges).groupBy("sheet_id").agg(F.count(F.lit(1)).alias("edges"))
    j = v.join(e, "sheet_id", "left").na.fill(0, ["edges"])
    return j.withColumn("cycles", F.col("edges") - F.col("nodes") + F.col("nets"))


def segment_ends(segments: DataFrame, nodes: DataFrame) -> DataFrame:
    """Segments with the node standing exactly at either end (null where there is none)."""
    side = lambda p: nodes.select("sheet_id", F.col("x").alias(f"{p}_x"), F.col("y").alias(f"{p}_y"), F.col("n").alias(f"{p}_n"), F.col("ends").alias(f"{p}_ends"))
    return segments.join(side("s"), ["sheet_id", "s_x", "s_y"], "left").join(side("e"), ["sheet_id", "e_x", "e_y"], "left")


def confidence(length: Column, start_ends: Column, end_ends: Column, min_length: float) -> tuple[Column, Column]:
    """(score in [0, 1], sorted reasons) of a segment; fixed values as in the rule table below."""
    ratio = length / F.lit(max(1.0, float(min_length)))
    s, e = F.coalesce(start_ends, F.lit(0)), F.coalesce(end_ends, F.lit(0))

    def ladder(*steps: tuple[Column, float]) -> Column:
        out = None
        for cond, points in steps:
            out = F.when(cond, F.lit(points)) if out is None else out.when(cond, F.lit(points))
        return out.otherwise(F.lit(0.0))

    support = lambda d: ladder((d >= 3, 0.08), (d == 2, 0.03), (d <= 1, -0.12))
    alone, backed = (s <= 1) & (e <= 1), (s >= 2) & (e >= 2) & (ratio >= 1.8)
    lone = lambda given, d: F.when(given.isNotNull() & (d == 0), -0.05).otherwise(0.0)
    score = (
        F.least(F.lit(1.0), F.greatest(F.lit(0.0), ratio / 3.0))
        + ladder((ratio < 1.05, -0.3), (ratio < 1.45, -0.15), (ratio > 3.5, 0.06), (ratio > 2.2, 0.03))
        + support(s) + support(e) + ladder((alone, -0.14), (backed, 0.05)) + lone(start_ends, s) + lone(end_ends, e)
    )
    reasons = F.array_sort(F.array_compact(F.array(
        F.when(ratio < 1.05, "short_segment").when(ratio < 1.45, "marginal_length"),
        F.when(s >= 3, "start_supported").when(s <= 1, "start_endpoint"),
        F.when(e >= 3, "end_supported").when(e <= 1, "end_endpoint"),
        F.when(alone, "isolated_branch").when(backed, "well_supported"),
        F.when(start_ends.isNotNull() & (s == 0), "start_isolated"), F.when(end_ends.isNotNull() & (e == 0), "end_isolated"))))
    return F.greatest(F.lit(0.0), F.least(score, F.lit(1.0))), reasons


def confidence_label(score: Column) -> Column:
    return F.when(score >= 0.65, "high").when(score >= 0.45, "medium").otherwise("low")


def endpoint_thresholds(min_length: float, merge_tolerance: float) -> dict[str, float]:
    """Limits of the endpoint rules for a drawing scale (fixed values)."""
    sq = min_length * min_length
    radius = max(int(round(max(merge_tolerance * 2.8, min_length * 0.9, 12.0))), 8)
    return {
        "area_dense": max(140.0, sq * 0.9), "ink_dense": 0.28, "fill_dense": 0.56, "aspect_dense": 2.7, "skeleton_min": 0.019,
        "area_cluster": max(110.0, sq * 0.7), "ink_cluster": 0.24, "fill_cluster": 0.52, "neighbor_radius": radius * 0.9,
        "area_local": max(90.0, sq * 0.6), "ink_local": 0.26, "aspect_local": 2.3, "density_margin": 0.11, "radius": float(radius),
        "short_branch": max(42.0, min_length * 3.4),
    }


def endpoint_reason(t: dict[str, float], limit: Column | float) -> Column:
    """First removal rule that fits an endpoint's metrics, null when it stays.

    Columns: branch_length, area, aspect_ratio, ink_ratio, fill_ratio, skeleton_density,
    nearest_node_distance, local_density, other_density.
    """
    limit = F.lit(float(limit)) if not isinstance(limit, Column) else limit
    c = F.col
    length, area, near = c("branch_length"), c("area"), c("nearest_node_distance")
    ink, fill, aspect, skel = c("ink_ratio"), c("fill_ratio"), c("aspect_ratio"), c("skeleton_density")
    here, there = c("local_density"), c("other_density")
    reach = max(t["neighbor_radius"] * 2.0, 24.0)
    local = (area >= t["area_local"]) & (ink >= t["ink_local"])
    within = lambda d: F.coalesce(near <= d, F.lit(False))
    text_pair = (
        (length <= limit * 0.55) & (area >= t["area_local"]) & (fill >= t["fill_cluster"] * 0.7)
        & (ink >= max(t["ink_local"], t["ink_cluster"] * 0.9)) & (here >= t["ink_local"]) & (there >= t["ink_local"])
        & (F.abs(here - there) <= t["density_margin"] * 0.5) & (aspect <= t["aspect_dense"])
        & (skel >= t["skeleton_min"] * 1.15) & within(reach * 1.1))
    blob = (
        (area >= t["area_dense"]) & (ink >= t["ink_dense"]) & (fill >= t["fill_dense"]) & (aspect <= t["aspect_dense"]) & (skel >= t["skeleton_min"]))
    cluster = (
        (area >= t["area_cluster"]) & (ink >= t["ink_cluster"]) & (fill >= t["fill_cluster"]) & within(t["neighbor_radius"]) & (skel >= t["skeleton_min"]))
    margin = local & (aspect <= t["aspect_local"]) & (here >= there + t["density_margin"])
    pair = (
        local & (length <= F.least(F.greatest(limit * 0.5, F.lit(10.0)), F.lit(24.0))) & (fill >= t["fill_cluster"] * 0.65)
        & (F.greatest(here, there) >= t["ink_cluster"] + 0.08) & (aspect <= t["aspect_local"]) & (skel >= t["skeleton_min"] * 1.6) & within(reach))
    found = (
        F.when(text_pair, "text_pair").when(blob, "dense_blob").when(cluster, "cluster").when(margin, "density_margin").when(pair, "dense_pair"))
    return F.when((length <= limit) & (area > 0), found)


def nearest_other(points: DataFrame, nodes: DataFrame, first_radius: float) -> DataFrame:
    """Distance to the nearest node that stands neither at the point nor at its opposite end.

    `points(sheet_id, id, x, y, ox, oy)`. The search square doubles until every
    point has a neighbour inside it or the square covers all nodes; on sheets of few
    nodes points meet all of them at once.
    """
    spots = stage(nodes.select("sheet_id", F.col("x").cast("double").alias("r_x"), F.col("y").cast("double").alias("r_y")).distinct())
    span = spots.agg(F.max(F.greatest(F.abs("r_x"), F.abs("r_y"))).alias("m")).first()["m"] or 0.0
    todo = stage(points.select("sheet_id", "id", *[F.col(c).cast("double").alias(n) for c, n in (("x", "l_x"), ("y", "l_y"), ("ox", "ox"), ("oy", "oy"))]))
    own = (F.col("l_x") == F.col("r_x")) & (F.col("l_y") == F.col("r_y"))
    opposite = (F.col("ox") == F.col("r_x")) & (F.col("oy") == F.col("r_y"))
    d = G.distance(F.col("l_x"), F.col("l_y"), F.col("r_x"), F.col("r_y"))
    large = stage(spots.groupBy("sheet_id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > scale.SMALL).select("sheet_id"))
    whole = large.isEmpty()
    few = todo if whole else todo.join(large, "sheet_id", "left_anti")
    radius, parts = float(first_radius), [few.join(spots, "sheet_id").where(~own & ~opposite).groupBy("sheet_id", "id").agg(F.min(d).alias("nearest"))]
    if not whole:
        spots, todo = (stage(x.join(large, "sheet_id", "left_semi")) for x in (spots, todo))
    while not whole:
        near = spatial.near_join(todo, spots, ["sheet_id"], radius)
        last = radius > 4 * span
        # inside the square only distances up to the radius are sure to be smallest
        found = near.where(~own & ~opposite).withColumn("d", d).where(F.lit(last) | (F.col("d") <= radius))
        got = stage(found.groupBy("sheet_id", "id").agg(F.min("d").alias("nearest")))
        parts.append(got)
        todo = stage(todo.join(got, ["sheet_id", "id"], "left_anti"))
        if last or todo.isEmpty():
            break
        radius *= 2
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return points.join(out, ["sheet_id", "id"], "left")


def patch_stats(points: DataFrame, pixels: DataFrame, radius: int, width: int, height: int) -> DataFrame:
    """Foreground statistics in the square around each point, cut at the picture border.

    `points(sheet_id, id, x, y)`, `pixels(sheet_id, px, py)`.
    """
    p = points.select("sheet_id", "id", F.greatest(F.lit(0), F.least(F.lit(width - 1), "x")).cast("double").alias("l_x"),
                      F.greatest(F.lit(0), F.least(F.lit(height - 1), "y")).cast("double").alias("l_y"))
    spots = pixels.select("sheet_id", F.col("px").cast("double").alias("r_x"), F.col("py").cast("double").alias("r_y"))
    hit = spatial.near_join(p, spots, ["sheet_id"], float(radius), few="left").groupBy("sheet_id", "id").agg(
        F.count(F.lit(1)).alias("area"), (F.max("r_x") - F.min("r_x") + 1).alias("box_w"), (F.max("r_y") - F.min("r_y") + 1).alias("box_h"))
    j = p.join(hit, ["sheet_id", "id"], "left").na.fill(0, ["area"]).na.fill(0.0, ["box_w", "box_h"])
    side = lambda c, size: F.least(F.lit(size), F.col(c) + radius + 1) - F.greatest(F.lit(0.0), F.col(c) - radius)
    patch = side("l_x", width) * side("l_y", height)
    box = F.col("box_w") * F.col("box_h")
    some = F.col("area") > 0
    zero = F.lit(0.0)
    return j.select(
        "sheet_id", "id", "area", (F.col("area") / patch).alias("ink_ratio"), F.when(some, F.col("area") / box).otherwise(zero).alias("fill_ratio"),
        F.when(some, F.greatest("box_w", "box_h") / F.least("box_w", "box_h")).otherwise(zero).alias("aspect_ratio"),
        (box / patch).alias("extent_ratio"))


def covered_by_points(candidates: DataFrame, contour: DataFrame, tolerance: float) -> DataFrame:
    """Candidates with a contour point near both ends.

    `candidates(sheet_id, id, s_x, s_y, e_x, e_y)`, `contour(sheet_id, x, y)`.
    """
    limit = max(tolerance * 1.5, tolerance + 1.0)
    spots = contour.select("sheet_id", F.col("x").cast("double").alias("r_x"), F.col("y").cast("double").alias("r_y")).distinct()

    def close(p: str) -> DataFrame:
        ends = candidates.select("sheet_id", "id", F.col(f"{p}_x").cast("double").alias("l_x"), F.col(f"{p}_y").cast("double").alias("l_y"))
        d = G.distance(F.col("l_x"), F.col("l_y"), F.col("r_x"), F.col("r_y"))
        return spatial.near_join(ends, spots, ["sheet_id"], limit, few="left").where(d <= limit).select("sheet_id", "id").distinct()

    return candidates.join(close("s"), ["sheet_id", "id"], "left_semi").join(close("e"), ["sheet_id", "id"], "left_semi")


def colinear_pairs(segments: DataFrame, angle_tolerance: float, gap: float) -> DataFrame:
    """Pairs (a < b) of like-angled segments whose nearest ends are at most `gap` apart.

    `segments(sheet_id, id, s_x, s_y, e_x, e_y, angle_deg)`. Ends meet in grid cells, so
    only segments that nearly touch are compared.
    """
    end = lambda x, y: F.struct(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    ends = segments.select("sheet_id", "id", "angle_deg", F.explode(F.array(end("s_x", "s_y"), end("e_x", "e_y"))).alias("p"))
    side = lambda p: ends.select("sheet_id", F.col("id").alias(f"{p}_id"), F.col("angle_deg").alias(f"{p}_angle"), F.col("p.x").alias(f"{p}_x"), F.col("p.y").alias(f"{p}_y"))
    d = G.distance(F.col("l_x"), F.col("l_y"), F.col("r_x"), F.col("r_y"))
    near = spatial.near_join(side("l"), side("r"), ["sheet_id"], float(gap))
    return near.where((F.col("l_id") < F.col("r_id")) & (F.abs(F.col("l_angle") - F.col("r_angle")) <= angle_tolerance) & (d <= gap)).select(
        "sheet_id", F.col("l_id").alias("a"), F.col("r_id").alias("b")).distinct()


def _angle(dx: Column, dy: Column) -> Column:
    return F.pmod(F.degrees(F.atan2(dy, dx)), F.lit(180.0))


def combine_colinear(segments: DataFrame, pairs: DataFrame) -> DataFrame:
    """Each group of colinear segments as one segment between its outermost points."""
    tag = scale.connected_components(pairs, ["sheet_id"]).withColumnRenamed("node", "id")
    s = segments.join(tag, ["sheet_id", "id"])
    pt = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    g = s.groupBy("sheet_id", "root").agg(
        F.min(F.least(pt("s_x", "s_y"), pt("e_x", "e_y"))).alias("s"), F.max(F.greatest(pt("s_x", "s_y"), pt("e_x", "e_y"))).alias("e"), F.count(F.lit(1)).alias("n"))
    dx, dy = F.col("e.x") - F.col("s.x"), F.col("e.y") - F.col("s.y")
    return g.select(
        "sheet_id", "root", "n", F.col("s.x").alias("s_x"), F.col("s.y").alias("s_y"), F.col("e.x").alias("e_x"), F.col("e.y").alias("e_y"),
        F.sqrt(dx * dx + dy * dy).alias("length"), _angle(dx, dy).alias("angle_deg"))


def bridge_gaps(ends: DataFrame, mask: DataFrame, width: int, height: int, max_distance: float, max_angle: float, min_cover: float, max_joins: int) -> DataFrame:
    """Endpoint pairs that face each other across a gap the mask mostly covers.

    `ends(sheet_id, k, x, y, dx, dy)` with the direction out of the node, `mask(sheet_id, px, py)`.
    The first `max_joins` pairs in (i, j) order count per sheet; an end may serve twice.
    """
    side = lambda p: ends.select("sheet_id", *[F.col(c).alias(f"{p}_{c}") for c in ("k", "x", "y", "dx", "dy")])
    near = spatial.near_join(side("l").withColumns({"l_x": F.col("l_x").cast("double"), "l_y": F.col("l_y").cast("double")}),
                             side("r").withColumns({"r_x": F.col("r_x").cast("double"), "r_y": F.col("r_y").cast("double")}), ["sheet_id"], float(max_distance))
    vx, vy = F.col("r_x") - F.col("l_x"), F.col("r_y") - F.col("l_y")
    d = F.sqrt(vx * vx + vy * vy)
    turn = lambda ax, ay, bx, by: F.abs(F.pmod(F.degrees(F.atan2(ay, ax)) - F.degrees(F.atan2(by, bx)) + 180.0, F.lit(360.0)) - 180.0)
    facing = (turn(F.col("l_dx"), F.col("l_dy"), vx, vy) <= max_angle) & (turn(F.col("r_dx"), F.col("r_dy"), -vx, -vy) <= max_angle)
    cand = stage(near.where((F.col("l_k") < F.col("r_k")) & (d >= 1.0) & (d <= max_distance) & facing).withColumn("d", d))
    n = F.greatest(F.lit(3), F.floor("d").cast("int"))
    step = F.explode(F.sequence(F.lit(0), n - 1))
    pos = lambda a, b: F.when(F.col("_i") == n - 1, F.col(b)).otherwise(F.col("_i") * ((F.col(b) - F.col(a)) / (n - 1)) + F.col(a))
    dots = cand.withColumn("_i", step).withColumns({"px": pos("l_x", "r_x").cast("bigint"), "py": pos("l_y", "r_y").cast("bigint")})
    dots = dots.where(F.col("px").between(0, width - 1) & F.col("py").between(0, height - 1))
    on = mask.select("sheet_id", "px", "py", F.lit(1).alias("_on")).distinct()
    cover = dots.join(on, ["sheet_id", "px", "py"], "left").groupBy("sheet_id", "l_k", "r_k", "d").agg((F.count("_on") / F.count(F.lit(1))).alias("cover"))
    return scale.top_n(cover.where(F.col("cover") >= min_cover), ["sheet_id"], [F.col("l_k"), F.col("r_k")], max_joins).drop("_rank")


def endpoint_directions(segments: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nodes with exactly one segment and the direction from the node along it."""
    ends = segments.select("sheet_id", F.explode(F.array(
        F.struct(F.col("s_x").alias("x"), F.col("s_y").alias("y"), (F.col("e_x") - F.col("s_x")).alias("dx"), (F.col("e_y") - F.col("s_y")).alias("dy")),
        F.struct(F.col("e_x").alias("x"), F.col("e_y").alias("y"), (F.col("s_x") - F.col("e_x")).alias("dx"), (F.col("s_y") - F.col("e_y")).alias("dy")),
    )).alias("p")).select("sheet_id", "p.*")
    one = ends.groupBy("sheet_id", "x", "y").agg(F.count(F.lit(1)).alias("c"), F.first("dx").alias("dx"), F.first("dy").alias("dy")).where("c = 1")
    return nodes.join(one.drop("c"), ["sheet_id", "x", "y"]).where("dx <> 0 OR dy <> 0")


def assemble(candidates: DataFrame, merge_tolerance: float, min_length: float) -> tuple[DataFrame, DataFrame]:
    """Segments and nodes from candidate lines.

    `candidates(sheet_id, ord, s_x, s_y, e_x, e_y, priority)`. Points join the first
    earlier leader within the tolerance, leaders being found in candidate order;
    every leader pair keeps its best line. Ids are dense per sheet. Sheets of few
    candidates are worked out in a row each, the others in rounds; those without a
    sheet_id make nothing.
    """
    c = stage(candidates.where("sheet_id IS NOT NULL").select(
        "sheet_id", F.col("ord").cast("bigint").alias("ord"), *[F.col(k).cast("double").alias(k) for k in ("s_x", "s_y", "e_x", "e_y")], "priority"))
    large = stage(c.groupBy("sheet_id").agg(F.count(F.lit(1)).alias("_n"), F.count("ord").alias("_o")).where((F.col("_n") > scale.SMALL) | (F.col("_o") < F.col("_n"))).select("sheet_id"))
    if large.isEmpty():
        return _assemble_rows(c, merge_tolerance, min_length)
    few = _assemble_rows(c.join(large, "sheet_id", "left_anti"), merge_tolerance, min_length)
    many = _assemble_rounds(c.join(large, "sheet_id", "left_semi"), merge_tolerance, min_length)
    return few[0].unionByName(many[0]), few[1].unionByName(many[1])


def _assemble_rows(candidates: DataFrame, merge_tolerance: float, min_length: float) -> tuple[DataFrame, DataFrame]:
    """`assemble` for sheets of few candidates: the points of a row are taken one by one."""
    point = lambda c, p, k: F.struct(k.alias("k"), c[f"{p}_x"].alias("x"), c[f"{p}_y"].alias("y"))
    lines = candidates.groupBy("sheet_id").agg(F.sort_array(F.collect_list(F.struct("ord", "s_x", "s_y", "e_x", "e_y", "priority"))).alias("c"))
    points = lines.select("sheet_id", "c", F.flatten(F.transform("c", lambda c: F.array(point(c, "s", c["ord"] * 2), point(c, "e", c["ord"] * 2 + 1)))).alias("points"))

    def taken(state: Column, p: Column) -> Column:
        def near(q: Column) -> Column:
            return F.coalesce((G.distance(p["x"], p["y"], q["x"], q["y"]) <= merge_tolerance) | ((p["x"] == q["x"]) & (p["y"] == q["y"])), F.lit(False))

        return scale.bound({"found": state["found"], "at": state["at"], "own": F.coalesce(F.get(F.filter(state["found"], near), F.lit(0)), p)}, lambda x: F.struct(
            F.when(x["own"]["k"] == p["k"], F.array_append(x["found"], p)).otherwise(x["found"]).alias("found"), F.array_append(x["at"], x["own"]).alias("at")))

    none = F.array().cast("array<struct<k:bigint,x:double,y:double>>")
    led = points.select("sheet_id", "c", F.aggregate("points", F.struct(none.alias("found"), none.alias("at")), taken, lambda x: x["at"]).alias("at"))

    def line(c: Column, i: Column) -> Column:
        s, e = F.get("at", 2 * i), F.get("at", 2 * i + 1)
        length = G.distance(c["s_x"], c["s_y"], c["e_x"], c["e_y"])
        return F.struct(F.least(s["k"], e["k"]).alias("p"), F.greatest(s["k"], e["k"]).alias("q"), (-c["priority"]).alias("f"), (-length).alias("g"), c["ord"].alias("ord"), length.alias("len"), s.alias("s"), e.alias("e"))

    good = led.select("sheet_id", F.sort_array(F.filter(F.transform("c", line), lambda x: (x["p"] != x["q"]) & (x["len"] >= min_length))).alias("good"))
    first = good.select("sheet_id", F.filter("good", lambda x, i: ~(F.get("good", i - 1)["p"].eqNullSafe(x["p"]) & F.get("good", i - 1)["q"].eqNullSafe(x["q"]))).alias("first"))
    whole = lambda q: F.struct(q["k"].alias("k"), F.bround(q["x"]).cast("bigint").alias("x"), F.bround(q["y"]).cast("bigint").alias("y"))
    ends = first.select("sheet_id", F.transform("first", lambda x: F.struct(whole(x["s"]).alias("s"), whole(x["e"]).alias("e"))).alias("segs"))
    far = lambda x: G.distance(x["s"]["x"], x["s"]["y"], x["e"]["x"], x["e"]["y"])
    ends = ends.select("sheet_id", F.filter("segs", lambda x: far(x) >= min_length).alias("segs"))
    ends = ends.select("sheet_id", "segs", F.concat("segs.s", "segs.e").alias("ends"))
    rows = stage(ends.select("sheet_id", "segs", "ends", F.sort_array(F.array_distinct("ends")).alias("nodes")))
    number = lambda p: F.array_position("nodes.k", F.col(f"_p.{p}.k")) - 1
    seg = rows.select("sheet_id", "nodes", F.posexplode("segs").alias("i", "_p")).select(
        "sheet_id", F.col("i").cast("bigint").alias("seg"), *[F.col(f"_p.{p}.{v}").alias(f"{p}_{v}") for p in "se" for v in "xy"], far(F.col("_p")).alias("length"), number("s").alias("a"), number("e").alias("b"))
    segments = seg.select(
        "sheet_id", "seg", "s_x", "s_y", "e_x", "e_y", "length", _angle(F.col("e_x") - F.col("s_x"), F.col("e_y") - F.col("s_y")).alias("angle_deg"), "a", "b")
    nodes = rows.select("sheet_id", "ends", F.posexplode("nodes").alias("i", "_p")).select(
        "sheet_id", F.col("i").cast("bigint").alias("n"), "_p.x", "_p.y", F.size(F.filter("ends", lambda e: e["k"] == F.col("_p.k"))).cast("bigint").alias("ends"))
    return segments, nodes


def _assemble_rounds(c: DataFrame, merge_tolerance: float, min_length: float) -> tuple[DataFrame, DataFrame]:
    """`assemble` for sheets of any size."""
    pts = c.select("sheet_id", F.explode(F.array(
        F.struct((F.col("ord") * 2).alias("k"), F.col("s_x").alias("x"), F.col("s_y").alias("y")),
        F.struct((F.col("ord") * 2 + 1).alias("k"), F.col("e_x").alias("x"), F.col("e_y").alias("y")))).alias("p")).select("sheet_id", "p.*")
    # equal points share their fate, so one stands for all
    spots = stage(pts.groupBy("sheet_id", "x", "y").agg(F.min("k").alias("k")))
    side = lambda df, p: df.select("sheet_id", *[F.col(x).alias(f"{p}_{x}") for x in ("k", "x", "y")])
    d = G.distance(F.col("l_x"), F.col("l_y"), F.col("r_x"), F.col("r_y"))
    tol = max(float(merge_tolerance), 1e-9)
    close = stage(spatial.near_join(side(spots, "l"), side(spots, "r"), ["sheet_id"], tol).where((d <= merge_tolerance) & (F.col("l_k") < F.col("r_k"))).select(
        F.struct("sheet_id", F.col("l_k").alias("k")).alias("earlier"), F.struct("sheet_id", F.col("r_k").alias("k")).alias("later")))
    leaders = stage(scale.greedy_independent(spots.select(F.struct("sheet_id", "k").alias("v")), close, "v").select("v.sheet_id", F.col("v.k").alias("leader")))
    joined = close.select("earlier.sheet_id", F.col("earlier.k").alias("leader"), F.col("later.k").alias("k")).join(leaders, ["sheet_id", "leader"], "left_semi")
    first = joined.groupBy("sheet_id", "k").agg(F.min("leader").alias("leader"))
    place = stage(spots.join(first, ["sheet_id", "k"], "left").withColumn("leader", F.coalesce("leader", "k")))
    at = lambda p: place.select("sheet_id", F.col("x").alias(f"{p}_x"), F.col("y").alias(f"{p}_y"), F.col("leader").alias(f"{p}_l"))
    lines = c.join(at("s"), ["sheet_id", "s_x", "s_y"]).join(at("e"), ["sheet_id", "e_x", "e_y"])
    length = G.distance(F.col("s_x"), F.col("s_y"), F.col("e_x"), F.col("e_y"))
    ok = lines.withColumn("len", length).where((F.col("s_l") != F.col("e_l")) & (F.col("len") >= min_length))
    best = ok.groupBy("sheet_id", F.least("s_l", "e_l").alias("p"), F.greatest("s_l", "e_l").alias("q")).agg(
        F.min_by(F.struct("s_l", "e_l"), F.struct(-F.col("priority"), -F.col("len"), F.col("ord"))).alias("w"))
    spot = spots.select("sheet_id", F.col("k"), F.bround("x").cast("bigint").alias("x"), F.bround("y").cast("bigint").alias("y"))
    pos = lambda p: spot.select("sheet_id", F.col("k").alias(f"{p}_l"), F.col("x").alias(f"{p}_x"), F.col("y").alias(f"{p}_y"))
    seg = best.select("sheet_id", "p", "q", "w.*").join(pos("s"), ["sheet_id", "s_l"]).join(pos("e"), ["sheet_id", "e_l"])
    seg = seg.withColumn("length", length).where(F.col("length") >= min_length)
    seg = stage(scale.ranked(seg, ["sheet_id"], [F.col("p"), F.col("q")], "_k"))
    segments = seg.select(
        "sheet_id", (F.col("_k") - 1).alias("seg"), "s_l", "e_l", "s_x", "s_y", "e_x", "e_y", "length",
        _angle(F.col("e_x") - F.col("s_x"), F.col("e_y") - F.col("s_y")).alias("angle_deg"))
    used = segments.select("sheet_id", F.explode(F.array("s_l", "e_l")).alias("k")).groupBy("sheet_id", "k").agg(F.count(F.lit(1)).alias("ends"))
    numbered = stage(scale.ranked(used, ["sheet_id"], [F.col("k")], "_k"))
    nodes = numbered.join(spot, ["sheet_id", "k"]).select("sheet_id", (F.col("_k") - 1).alias("n"), "x", "y", "ends", "k")
    node_of = lambda p, name: nodes.select("sheet_id", F.col("k").alias(f"{p}_l"), F.col("n").alias(name))
    segments = segments.join(node_of("s", "a"), ["sheet_id", "s_l"]).join(node_of("e", "b"), ["sheet_id", "e_l"]).drop("s_l", "e_l")
    return segments, nodes.drop("k")


def straight_chains(segments: DataFrame, nodes: DataFrame, merge_tolerance: float, min_length: float, angle_tolerance: float = 15.0) -> DataFrame:
    """Candidate lines after replacing two nearly straight segments at a two-ended node by one.

    Nodes decide in order; one that would touch a used segment or an already bridged
    pair of ends waits in vain. Returns candidates for `assemble`.
    """
    end = lambda n, x, y, ox, oy: F.struct(F.col(n).alias("n"), F.col(x).alias("x"), F.col(y).alias("y"), F.col(ox).alias("ox"), F.col(oy).alias("oy"))
    halves = segments.select("sheet_id", "seg", "length", F.explode(F.array(
        end("a", "s_x", "s_y", "e_x", "e_y"), end("b", "e_x", "e_y", "s_x", "s_y"))).alias("p")).select("sheet_id", "seg", "length", "p.*")
    # a two-ended node has two rows here: its first and last segment in the text order of their ids
    name = F.concat(F.lit("edge-"), F.col("seg").cast("string"))
    row = F.struct("seg", "length", "ox", "oy")
    pairs = halves.groupBy("sheet_id", "n", "x", "y").agg(
        F.count(F.lit(1)).alias("c"), F.min_by(row, name).alias("a"), F.max_by(row, name).alias("b")).where("c = 2")
    ax, ay, bx, by = (F.col(f"{s}.o{k}") - F.col(k) for s, k in (("a", "x"), ("a", "y"), ("b", "x"), ("b", "y")))
    la, lb = F.sqrt(ax * ax + ay * ay), F.sqrt(bx * bx + by * by)
    joined = G.distance(F.col("a.ox"), F.col("a.oy"), F.col("b.ox"), F.col("b.oy"))
    both = F.col("a.length") + F.col("b.length")
    extra = max(merge_tolerance * 3.0, min_length)
    apart = (F.col("a.ox") != F.col("b.ox")) | (F.col("a.oy") != F.col("b.oy"))
    ok = apart & (la >= 1.0) & (lb >= 1.0) & ((ax * bx + ay * by) / (la * lb) <= -math.cos(math.radians(angle_tolerance))) & (
        joined <= F.greatest(both * 1.25, both + extra))
    cand = stage(pairs.where(ok).select(
        F.struct("sheet_id", "n").alias("v"), F.col("a.seg").alias("sa"), F.col("b.seg").alias("sb"),
        F.col("a.ox").alias("s_x"), F.col("a.oy").alias("s_y"), F.col("b.ox").alias("e_x"), F.col("b.oy").alias("e_y")))
    # nodes contend for segments and for pairs of ends: each contended thing has few claimants
    s, e = F.struct("s_x", "s_y"), F.struct("e_x", "e_y")
    seg_key = lambda c: F.concat_ws("|", F.lit("s"), F.col(c).cast("string"))
    pair_key = F.concat_ws("|", F.lit("p"), *[F.col(k).cast("string") for k in ("lo.s_x", "lo.s_y", "hi.s_x", "hi.s_y")])
    keyed = cand.withColumns({"lo": F.least(s, F.struct(F.col("e_x").alias("s_x"), F.col("e_y").alias("s_y"))), "hi": F.greatest(s, F.struct(F.col("e_x").alias("s_x"), F.col("e_y").alias("s_y")))})
    claims = keyed.select("v", F.explode(F.array(seg_key("sa"), seg_key("sb"), pair_key)).alias("key")).withColumn("sheet", F.col("v.sheet_id"))
    right = claims.select(F.col("v").alias("later"), "key", "sheet")
    fights = claims.select(F.col("v").alias("earlier"), "key", "sheet").join(right, ["sheet", "key"]).where("earlier < later").select("earlier", "later").distinct()
    won = stage(scale.greedy_independent(cand.select("v"), fights, "v").join(cand, "v"))
    gone = won.select(F.col("v.sheet_id").alias("sheet_id"), F.explode(F.array("sa", "sb")).alias("seg"))
    keep = segments.join(gone, ["sheet_id", "seg"], "left_anti").select("sheet_id", F.col("seg").alias("ord"), "s_x", "s_y", "e_x", "e_y", F.lit(0).alias("priority"))
    # bridges follow the kept segments, in node order
    after = segments.groupBy("sheet_id").agg((F.max("seg") + 1).alias("_after"))
    new = won.select(F.col("v.sheet_id").alias("sheet_id"), F.col("v.n").alias("ord"), "s_x", "s_y", "e_x", "e_y", F.lit(2).alias("priority"))
    new = new.join(after, "sheet_id").withColumn("ord", F.col("ord") + F.col("_after")).drop("_after")
    return keep.unionByName(new)


GROUND = ("0", "gnd", "ground")

# fixed values: deck prefix by part kind; others get X
PREFIXES = {"resistor": "R", "capacitor": "C", "inductor": "L", "diode": "D", "transistor": "Q", "power_rail": "V", "ground": "G"}


def resolve_pins(pins: DataFrame, known: DataFrame, ground: str = "0") -> DataFrame:
    """Pins with the ground name put in, and `unknown` for pins that are in no list of nodes or nets.

    `pins(deck_id, comp, pos, pin)`, `known(deck_id, pin)`.
    """
    p = pins.withColumn("pin", F.trim("pin"))
    names = known.select("deck_id", "pin", F.lit(True).alias("_known")).distinct()
    is_ground = F.lower("pin").isin(*GROUND)
    j = p.join(names, ["deck_id", "pin"], "left")
    return j.withColumns({"node": F.when(is_ground, F.lit(ground)).otherwise(F.col("pin")), "unknown": ~is_ground & F.col("_known").isNull()}).drop("_known")


def reference_names(components: DataFrame) -> DataFrame:
    """Given references stay; the others are numbered per deck and prefix in component order."""
    prefix = lookup(F.col("kind"), PREFIXES, None, "X")
    c = stage(components.withColumn("prefix", prefix))
    auto = scale.ranked(c.where("reference IS NULL"), ["deck_id", "prefix"], [F.col("comp")], "_k")
    made = auto.withColumn("reference", F.concat("prefix", F.col("_k").cast("string"))).drop("_k")
    return c.where("reference IS NOT NULL").unionByName(made)


def component_checks(components: DataFrame, pins: DataFrame) -> DataFrame:
    """Fewer than two pins, and explicit references used before in the deck, one row per finding."""
    n = pins.groupBy("deck_id", "comp").agg(F.count(F.lit(1)).alias("n"))
    few = components.join(n, ["deck_id", "comp"], "left").where(F.coalesce("n", F.lit(0)) < 2).select("deck_id", "comp", F.lit("few_pins").alias("code"))
    first = components.where("reference IS NOT NULL").groupBy("deck_id", "reference").agg(F.min("comp").alias("first"))
    again = components.join(first, ["deck_id", "reference"]).where("comp > first").select("deck_id", "comp", F.lit("repeated_reference").alias("code"))
    return few.unionByName(again)


def component_line(reference: Column, nodes: Column, value: Column) -> Column:
    """`R1 node-1 0 4.7K`; a part without a value gets 1."""
    return F.concat_ws(" ", reference, F.array_join(nodes, " "), F.when(F.coalesce(value, F.lit("")) == "", "1").otherwise(value))


def wire_line(segment: Column, source: Column, target: Column, length: Column, angle: Column) -> Column:
    return F.format_string("WIRE %s %s %s LEN=%.2f ANG=%.1f", segment, source, target, length, angle)


def payload_issues() -> Column:
    """Rules for `kind` and `nodes` of a component given as JSON."""
    return M.issues(
        M.issue(F.coalesce(F.col("kind"), F.lit("")) == "", "error", "kind", "missing_kind"),
        M.issue(F.coalesce(F.size("nodes"), F.lit(0)) < 2, "error", "nodes", "few_nodes"))


SEGMENT_JSON = (
    "lines array<struct<id string, start struct<x double, y double>, end struct<x double, y double>, length double, angle_deg double>>")


def segments_from_json(rows: DataFrame, text: str) -> DataFrame:
    """Segment rows from payload text: missing ids become ordinals, missing lengths the end distance."""
    r = rows.withColumn("_p", F.from_json(text, SEGMENT_JSON)).select(
        *[c for c in rows.columns if c != text], F.posexplode("_p.lines").alias("pos", "s"))
    i = lambda c: F.bround(F.col(c)).cast("bigint")
    out = r.withColumns({"s_x": i("s.start.x"), "s_y": i("s.start.y"), "e_x": i("s.end.x"), "e_y": i("s.end.y")})
    dist = G.distance(F.col("s_x"), F.col("s_y"), F.col("e_x"), F.col("e_y"))
    return out.withColumns({
        "id": F.coalesce("s.id", F.concat(F.lit("edge-"), F.col("pos").cast("string"))), "length": F.coalesce("s.length", dist),
        "angle_deg": F.coalesce("s.angle_deg", F.lit(0.0))}).drop("s")


def spanning_forest(members: DataFrame, edges: DataFrame) -> DataFrame:
    """(sheet_id, n, parent, depth): every net hung on its first node, by the edges that close no circle with edges before them."""
    plain = simple_edges(edges).where("a <> b")
    return forests.rooted(forests.first_forest(plain, ["sheet_id"]), members, ["sheet_id"])


def cycle_basis(members: DataFrame, edges: DataFrame) -> DataFrame:
    """(sheet_id, a, b, n): the nodes of one cycle per edge (a, b) outside the spanning forest.

    A basis is not unique; this one closes each outside edge over the tree of the edges
    before it. A loop is a cycle of one node. Sheets of few edges are worked out in a row each.
    """
    groups, others = scale.small_groups(stage(simple_edges(edges)), ["sheet_id"])
    small = forests.closed_ways(groups, ["sheet_id"])
    if others is None:
        return small
    rest = others.withColumnsRenamed({"a": "source", "b": "target"})
    tree = stage(spanning_forest(members.join(others.select("sheet_id").distinct(), "sheet_id", "left_semi"), rest))
    used = tree.where("parent IS NOT NULL").select("sheet_id", F.least("n", "parent").alias("a"), F.greatest("n", "parent").alias("b"))
    outside = others.join(used, ["sheet_id", "a", "b"], "left_anti")
    return small.unionByName(forests.paths(outside, tree, ["sheet_id"]))
