"""Part names and the values that belong to them, and how well engines read them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.functions import geometry as G
from tracewright.functions import text as T
from tracewright.functions import tokens as K
from tracewright.operators import scale, spatial
from tracewright.operators.tokens import PASSIVE, _side
from tracewright.session import stage

SHORT_NUMBER = r"^\d{1,2}$"
PLAIN_NUMBER = r"^[\d.,/]+$"


def _near_values(tokens: DataFrame) -> DataFrame:
    """Candidate rows: a component and every token within 3.5 of its longer side that may be its value."""
    comps = _side(tokens.where(F.col("category") == "component"), "l")
    others = _side(tokens.where(F.col("category").isin("value", "net_label", "other")), "r")
    far = F.greatest("l_w", "l_h") * 3.5
    zero = F.lit(0.0)
    d = G.distance(F.col("l_cx"), F.col("l_cy"), F.col("r_cx"), F.col("r_cy"))
    ic = F.upper("l_text").startswith("IC")
    extra = F.col("r_category") != "value"
    near = spatial.reach_join(comps, others, ["page_id"], (far, far), (zero, zero)).withColumns({"d": d, "far": far, "extra": extra})
    return near.where((F.col("d") <= F.col("far")) & (~extra | (ic & (F.length("r_text") >= 3))))


def primary_values(tokens: DataFrame) -> DataFrame:
    """One value per component: below it, else right of it, else the nearest, then corrected by kind."""
    near = _near_values(tokens)
    up, t = F.upper("l_text"), F.col("r_text")
    ic, head = up.startswith("IC"), F.substring(up, 1, 1)
    dx, dy = F.col("r_cx") - F.col("l_cx"), F.col("r_cy") - F.col("l_cy")
    side = F.greatest("l_w", "l_h")
    tie = [F.col("extra"), F.col("r_ord")]
    usable = ~(ic & (t.rlike(SHORT_NUMBER) | t.rlike(PASSIVE)))
    short, semi = t.rlike(SHORT_NUMBER), t.rlike(K.SEMI_MODEL)
    not_above = F.col("r_cy") >= F.col("l_cy") - F.col("l_h") * 0.5
    down = usable & (dy >= 0) & (F.abs(dx) <= F.col("l_w") * 0.5) & (dy <= side * 2.0)
    right = usable & (dx >= 0) & (F.abs(dy) <= F.col("l_h") * 0.5) & (dx <= side * 3.0)
    richer = ~short & t.rlike(r"\p{L}") & ~(semi & head.isin("C", "R", "L", "T")) & not_above
    row = F.struct(F.col("r_ord").alias("ord"), t.alias("text"), F.col("d").alias("d"))
    best = lambda cond, by, name: F.min_by(F.when(cond, row), F.when(cond, F.struct(by.alias("k"), *tie))).alias(name)
    per = near.groupBy("page_id", "l_ord", "l_text").agg(
        best(down, dy, "down"), best(down & ~short, dy, "down_rich"), best(right, F.abs(dx), "right"),
        best(richer, F.col("d"), "rich"), best(usable & not_above, F.col("d"), "any"),
        best(semi & not_above, F.col("d"), "semi"), best(~semi & not_above, F.col("d"), "passive"))
    short_of = lambda c: F.coalesce(F.col(c)["text"].rlike(SHORT_NUMBER), F.lit(False))
    first = F.when(F.col("down").isNotNull(), F.when(short_of("down"), F.coalesce("down_rich", "down")).otherwise(F.col("down"))).otherwise(F.col("right"))
    per = per.withColumn("c", first)
    # a plain short number gives way to a text with letters not much farther off
    swap = ~ic & short_of("c") & (F.col("rich.d") <= F.col("c.d") * 2.5)
    per = per.withColumn("c", F.when(F.coalesce(swap, F.lit(False)), F.col("rich")).otherwise(F.col("c")))
    per = per.withColumn("c", F.coalesce("c", "any"))
    is_semi, plain = F.col("c.text").rlike(K.SEMI_MODEL), F.col("c.text").rlike(PLAIN_NUMBER)
    reach = F.col("c.d") * F.when(plain, 1.5).otherwise(0.75)
    wants_semi = head.isin("Q", "D") & ~is_semi
    wants_passive = head.isin("C", "R", "L", "T") & is_semi
    chosen = (
        F.when(wants_semi & F.col("semi").isNotNull(), F.when(F.col("semi.d") < reach, F.col("semi")).otherwise(F.col("c")))
        .when(wants_semi & plain, F.lit(None))
        .when(wants_passive & (F.col("passive.d") < F.col("c.d") * 0.75), F.col("passive"))
        .otherwise(F.col("c"))
    )
    return per.withColumn("c", chosen).where("c IS NOT NULL").select(
        "page_id", F.col("l_ord").alias("comp"), F.col("c.ord").alias("val"), F.col("c.d").alias("d"))


def exclusive_values(tokens: DataFrame, primary: DataFrame) -> DataFrame:
    """A contested value stays with its closest component; the others take the nearest free value in order."""
    primary = stage(primary)
    holders = primary.groupBy("page_id", "val").agg(F.min_by("comp", F.struct("d", "comp")).alias("comp"))
    losers = primary.join(holders, ["page_id", "val", "comp"], "left_anti").select("page_id", "comp")
    free = tokens.where(F.col("category") == "value").join(holders.select("page_id", F.col("val").alias("ord")), ["page_id", "ord"], "left_anti")
    lost = tokens.join(losers.select("page_id", F.col("comp").alias("ord")), ["page_id", "ord"], "left_semi")
    far = F.greatest("l_w", "l_h") * 3.5
    d = G.distance(F.col("l_cx"), F.col("l_cy"), F.col("r_cx"), F.col("r_cy"))
    near = spatial.reach_join(_side(lost, "l"), _side(free, "r"), ["page_id"], (far, far), (F.lit(0.0), F.lit(0.0)))
    ok = (d <= far) & (F.col("r_cy") >= F.col("l_cy") - F.col("l_h") * 0.5) & ~(F.upper("l_text").startswith("IC") & F.col("r_text").rlike(PASSIVE))
    key = lambda p: F.struct("page_id", F.col(f"{p}_ord").alias("ord"))
    again = scale.priority_matching(
        near.where(ok).select(key("l").alias("s"), key("r").alias("t"), d.alias("d")), "s", "t", [F.col("s").alias("k")], [F.col("d")])
    return holders.select("page_id", "comp", "val").unionByName(
        again.select(F.col("s.page_id").alias("page_id"), F.col("s.ord").alias("comp"), F.col("t.ord").alias("val")))


def stacked_values(tokens: DataFrame, pairs: DataFrame) -> DataFrame:
    """Pairs with up to two further texts standing under the value (one for ICs), joined to one text and box."""
    p = pairs.join(_side(tokens, "l").withColumnRenamed("l_ord", "comp"), ["page_id", "comp"])
    val = tokens.select("page_id", F.col("ord").alias("val"), *[F.col(c).alias(f"v_{c}") for c in ("text", "x", "y", "w", "h", "cx", "cy")])
    p = stage(p.join(val, ["page_id", "val"]))
    taken = pairs.select("page_id", F.col("val").alias("ord")).distinct()
    more = tokens.where(F.col("category").isin("value", "net_label", "other")).join(taken, ["page_id", "ord"], "left_anti")
    up = F.upper("l_text")
    ic, cap = up.startswith("IC"), up.startswith("C")
    side = F.greatest("l_w", "l_h")
    tol = F.greatest("l_w", "v_w") * F.when(ic, 0.6).otherwise(1.0)
    span = side * F.when(ic, 0.5).when(cap, 1.5).otherwise(1.0)
    step = F.greatest("v_h", "l_h") * F.when(ic, 0.5).otherwise(1.0)
    near = spatial.reach_join(p, _side(more, "r"), ["page_id"], (tol, span), (F.lit(0.0), F.lit(0.0)))
    t = F.col("r_text")
    dxm, dym = F.abs(F.col("r_cx") - F.col("v_cx")), F.col("r_cy") - F.col("v_cy")
    digit_ok = cap & F.col("v_text").rlike(r"^\d+$") & (dym > 0) & (dym <= F.col("v_h") * 3.0) & (dxm <= F.greatest("v_w", "l_w") * 1.5)
    dx, dy = F.abs(F.col("r_cx") - F.col("l_cx")), F.col("r_cy") - F.col("l_cy")
    ok = (
        (~ic | (F.col("r_category") != "value")) & ~(F.substring(up, 1, 1).isin("Q", "D") & t.rlike(PLAIN_NUMBER))
        & (~t.rlike(SHORT_NUMBER) | digit_ok) & ~F.upper(t).rlike(r"^(IC|[RCLQ])\d{2,4}$") & dy.between(0, span) & (dx <= tol)
    )
    below = near.where(ok).groupBy("page_id", "comp").agg(F.array_sort(F.collect_list(
        F.struct(F.col("r_y").alias("y"), F.col("r_x").alias("x"), F.col("r_ord").alias("o"), t.alias("text"), F.col("r_w").alias("w"), F.col("r_h").alias("h"))
    )).alias("below"))
    j = p.join(below, ["page_id", "comp"], "left")
    main = F.struct(F.col("v_y").alias("y"), F.col("v_x").alias("x"), F.array(F.lit(-1).cast("bigint")).alias("o"), F.col("v_text").alias("text"), F.col("v_w").alias("w"), F.col("v_h").alias("h"))
    j = j.withColumns({"main": main, "below": F.coalesce("below", F.filter(F.array(main), lambda _: F.lit(False))), "_step": step, "_most": F.when(ic, 1).otherwise(2)})
    start = F.struct(F.array("main").alias("got"), (F.col("v_y") + F.col("v_h")).alias("low"))

    def take(acc: Column, e: Column) -> Column:
        fits = (e["y"] - acc["low"] <= F.col("_step")) & (F.size(acc["got"]) <= F.col("_most"))
        return F.when(fits, F.struct(F.array_append(acc["got"], e).alias("got"), (e["y"] + e["h"]).alias("low"))).otherwise(acc)

    j = j.withColumn("parts", F.array_sort(F.aggregate("below", start, take)["got"]))
    texts = F.transform("parts", lambda e: e["text"])
    ten = r"^0?1/(\d{2})$"
    texts = F.when(cap, F.transform(texts, lambda x: F.when(x.rlike(ten), F.concat(F.regexp_extract(x, ten, 1), F.lit("/10"))).otherwise(x))).otherwise(texts)
    two_digits = cap & (F.size(texts) == 2) & F.forall(texts, lambda x: x.rlike(r"^\d+$"))
    x = F.array_min(F.transform("parts", lambda e: e["x"]))
    y = F.array_min(F.transform("parts", lambda e: e["y"]))
    right = F.array_max(F.transform("parts", lambda e: e["x"] + e["w"]))
    low = F.array_max(F.transform("parts", lambda e: e["y"] + e["h"]))
    return j.select(
        "page_id", "comp", "val", F.col("l_text").alias("component"),
        F.when(two_digits, F.array_join(texts, "/")).otherwise(F.array_join(texts, " ")).alias("value"),
        x.alias("x"), y.alias("y"), (right - x).alias("w"), (low - y).alias("h"))


def pair(tokens: DataFrame) -> DataFrame:
    tokens = stage(tokens)
    return stacked_values(tokens, stage(exclusive_values(tokens, primary_values(tokens))))


def restore_ics(tokens: DataFrame, pairs: DataFrame) -> DataFrame:
    """An unpaired `C4xx` on a page whose ICs are numbered in the same hundred lost its `I`."""
    hundred = lambda pattern: F.floor(F.regexp_extract("text", pattern, 1).try_cast("int") / 100)
    known = tokens.where(F.col("text").rlike(r"(?i)IC\d{2,4}")).select("page_id", hundred(r"(?i)IC(\d{2,4})").alias("_h"), F.lit(True).alias("_ic")).distinct()
    named = pairs.select("page_id", F.col("component").alias("text"), F.lit(True).alias("_paired")).distinct()
    shape = r"^C(\d{3,4})$"
    j = tokens.withColumn("_h", F.when(F.col("text").rlike(shape), hundred(shape))).join(known, ["page_id", "_h"], "left").join(
        named, ["page_id", "text"], "left")
    lost = F.col("_ic").isNotNull() & F.col("_paired").isNull()
    return j.withColumns({
        "category": F.when(lost, "component").otherwise(F.col("category")),
        "text": F.when(lost, F.concat(F.lit("IC"), F.regexp_extract("text", shape, 1).cast("int").cast("string"))).otherwise(F.col("text")),
    }).drop("_h", "_ic", "_paired")


def component_hits(components: DataFrame, detections: DataFrame) -> DataFrame:
    """Per model and component: was its name, was its value read inside its box?

    `components(image_id, comp_id, name, value, x, y, w, h)`, `detections(model, image_id, text, x, y, w, h)`.
    """
    c = components.select("image_id", "comp_id", T.words_only(F.col("name")).alias("name"), T.words_only(F.col("value")).alias("value"),
                          *[F.col(k).alias(f"r_{k}") for k in "xywh"])
    d = detections.select("model", "image_id", T.words_only(F.col("text")).alias("text"), *[F.col(k).alias(f"l_{k}") for k in "xywh"])
    near = spatial.overlap_join(d, c, ["image_id"])
    hit = lambda what: (F.col(what) != "") & F.contains(F.col("text"), F.col(what))
    return near.groupBy("model", "image_id", "comp_id").agg(F.max(hit("name")).alias("name_hit"), F.max(hit("value")).alias("value_hit"))


def coverage(components: DataFrame, detections: DataFrame) -> DataFrame:
    """Share of components with a read name (of all) and a read value (of those that have one), detections per image."""
    hits = component_hits(components, detections).groupBy("model").agg(F.count_if("name_hit").alias("names"), F.count_if("value_hit").alias("values"))
    n = components.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce(F.col("value"), F.lit("")) != "").alias("v"),
                       F.count_distinct("image_id").alias("i")).first()
    per = detections.groupBy("model").agg(F.count(F.lit(1)).alias("found"))
    share = lambda c, total: F.coalesce(F.col(c), F.lit(0)) / F.lit(max(total, 1))
    return per.join(hits, "model", "left").select(
        "model", share("names", n["n"]).alias("name_rate"), share("values", n["v"]).alias("value_rate"), share("found", n["i"]).alias("per_image"))
