"""Detector evaluation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewright.functions import geometry as G
from tracewright.operators import evaluation as E
from tracewright.operators import scale
from tracewright.plans.registry import query

_IOU = """CASE WHEN p.w*p.h+g.w*g.h-i.a > 0 THEN i.a/(p.w*p.h+g.w*g.h-i.a) ELSE 0 END"""
_INTER = """greatest(0, least(p.x+p.w, g.x+g.w)-greatest(p.x, g.x))*greatest(0, least(p.y+p.h, g.y+g.h)-greatest(p.y, g.y))"""
_PAIRS = f"""pairs AS (SELECT *, CAST(inter AS DOUBLE)/(pa+ga-inter) AS iou FROM (
  SELECT p.model, p.image_id, p.category_id, p.pred_id, p.score, g.ann_id, p.w*p.h AS pa, g.w*g.h AS ga, {_INTER} AS inter
  FROM fx_predictions p JOIN fx_annotations g ON p.image_id=g.image_id AND p.category_id=g.category_id) q WHERE inter > 0)"""
_BEST = """best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY model, pred_id ORDER BY iou DESC, ann_id) AS r FROM pairs) q WHERE r=1)"""
_AP = f"""{_PAIRS}, {_BEST},
lv AS (SELECT CAST(50+5*k AS DOUBLE)/100 AS level FROM range(0,10) t(k)),
claim AS (SELECT model, level, pred_id FROM (SELECT b.model, lv.level, b.pred_id, row_number() OVER (PARTITION BY b.model, lv.level, b.ann_id ORDER BY b.score DESC, b.image_id, b.pred_id) AS r
  FROM best b JOIN lv ON b.iou >= lv.level) q WHERE r=1),
marked AS (SELECT p.model, p.category_id, lv.level, p.score, p.image_id, p.pred_id, CASE WHEN c.pred_id IS NULL THEN 0 ELSE 1 END AS tp
  FROM fx_predictions p CROSS JOIN lv LEFT JOIN claim c ON c.model=p.model AND c.level=lv.level AND c.pred_id=p.pred_id),
cum AS (SELECT *, sum(tp) OVER o AS tpc, row_number() OVER o AS n FROM marked WINDOW o AS (PARTITION BY model, category_id, level ORDER BY score DESC, image_id, pred_id ROWS UNBOUNDED PRECEDING)),
pr AS (SELECT *, tpc/n AS prec FROM cum),
env AS (SELECT *, max(prec) OVER (PARTITION BY model, category_id, level ORDER BY n DESC ROWS UNBOUNDED PRECEDING) AS e FROM pr),
npos AS (SELECT category_id, count(*) AS npos FROM fx_annotations GROUP BY 1),
area AS (SELECT model, category_id, level, sum(CASE WHEN tp=1 THEN e ELSE 0 END) AS a FROM env GROUP BY 1,2,3),
seen AS (SELECT DISTINCT model, category_id FROM fx_predictions UNION SELECT m.model, c.category_id FROM (SELECT DISTINCT model FROM fx_predictions) m CROSS JOIN (SELECT DISTINCT category_id FROM fx_annotations) c),
ap AS (SELECT s.model, s.category_id, lv.level, coalesce(n.npos, 0) AS npos, coalesce(a.a/n.npos, 0) AS ap FROM seen s CROSS JOIN lv
  LEFT JOIN area a ON a.model=s.model AND a.category_id=s.category_id AND a.level=lv.level LEFT JOIN npos n ON n.category_id=s.category_id)"""
_MEAN = f"""WITH {_AP}, m AS (SELECT model, category_id, avg(ap) AS mean_ap FROM ap GROUP BY 1,2),
cmp AS (SELECT category_id, coalesce(a.mean_ap,0) AS ap_first, coalesce(b.mean_ap,0) AS ap_second FROM (SELECT * FROM m WHERE model='a') a FULL JOIN (SELECT * FROM m WHERE model='b') b USING (category_id))"""


def _r(c, name):
    return F.round(c, 6).alias(name)


@query("iou_pairs_j06_p02", f"WITH {_PAIRS} SELECT model, pred_id, ann_id, round(iou,6) AS iou FROM pairs WHERE iou >= 0.5")
def _(t):
    p, g = t("fx_predictions"), t("fx_annotations")
    on = ["image_id", "category_id"]
    pairs = E.shape_pairs(p, g, on, 0.5)
    left = p.select("model", "pred_id", *on, *[F.col(c).alias("l_" + c) for c in E.SHAPE])
    right = g.select("ann_id", *on, *[F.col(c).alias("r_" + c) for c in E.SHAPE])
    full = pairs.join(left, [*on, *["l_" + c for c in E.SHAPE]]).join(right, [*on, *["r_" + c for c in E.SHAPE]])
    return full.select("model", "pred_id", "ann_id", _r("iou", "iou"))


@query("true_positives_w02", f"""WITH {_PAIRS}, {_BEST},
f AS (SELECT model, pred_id FROM (SELECT *, row_number() OVER (PARTITION BY model, ann_id ORDER BY score DESC, image_id, pred_id) AS c FROM best WHERE iou>=0.5) q WHERE c=1)
SELECT p.model, p.pred_id, f.pred_id IS NOT NULL AS tp FROM fx_predictions p LEFT JOIN f ON f.model=p.model AND f.pred_id=p.pred_id""")
def _(t):
    return E.true_positives(t("fx_predictions"), t("fx_annotations"), 0.5).select("model", "pred_id", "tp")


@query("average_precision_a10", f"WITH {_AP} SELECT model, category_id, level, npos, round(ap,6) AS ap FROM ap")
def average_precision(t):
    ap = E.average_precision(t("fx_predictions"), t("fx_annotations"))
    return ap.select("model", "category_id", "level", "npos", _r("ap", "ap"))


@query("mean_average_precision_a10", f"""WITH {_AP}, per AS (SELECT model, level, avg(ap) AS map, count(*) AS n_classes FROM ap GROUP BY 1,2)
SELECT model, level, round(map,6) AS map, n_classes FROM per UNION ALL SELECT model, NULL, round(avg(map),6), max(n_classes) FROM per GROUP BY 1""")
def _(t):
    m = E.mean_ap(E.average_precision(t("fx_predictions"), t("fx_annotations")))
    return m.select("model", "level", _r("map", "map"), "n_classes")


@query("precision_envelope_w03", f"""WITH {_PAIRS}, {_BEST},
f AS (SELECT model, pred_id FROM (SELECT *, row_number() OVER (PARTITION BY model, ann_id ORDER BY score DESC, image_id, pred_id) AS c FROM best WHERE iou>=0.5) q WHERE c=1),
m AS (SELECT p.*, CASE WHEN f.pred_id IS NULL THEN 0 ELSE 1 END AS tp FROM fx_predictions p LEFT JOIN f ON f.model=p.model AND f.pred_id=p.pred_id),
c AS (SELECT *, sum(tp) OVER o AS tp_cum, sum(1-tp) OVER o AS fp_cum FROM m WINDOW o AS (PARTITION BY model, category_id ORDER BY score DESC, image_id, pred_id ROWS UNBOUNDED PRECEDING))
SELECT model, category_id, pred_id, CAST(tp_cum AS BIGINT) AS tp_cum, CAST(fp_cum AS BIGINT) AS fp_cum,
round(max(tp_cum/(tp_cum+fp_cum)) OVER (PARTITION BY model, category_id ORDER BY score DESC, image_id, pred_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING),6) AS envelope FROM c""")
def _(t):
    keys, order = ["model", "category_id"], E.score_order()
    tp = E.true_positives(t("fx_predictions"), t("fx_annotations"), 0.5)
    sliced = scale.slice_by_order(tp.select(*keys, "pred_id", "image_id", "score", "tp"), keys, order)
    one = F.col("tp").cast("bigint")
    cum = scale.running(sliced, keys, order, {"tp_cum": one, "fp_cum": 1 - one})
    out = scale.suffix_max(cum, keys, order, F.col("tp_cum") / (F.col("tp_cum") + F.col("fp_cum")), "envelope")
    return out.select(*keys, "pred_id", "tp_cum", "fp_cum", _r("envelope", "envelope"))


_GREEDY = f"""{_PAIRS},
cand AS (SELECT model, pred_id, list(ann_id ORDER BY iou DESC, ann_id) AS c FROM pairs WHERE iou >= 0.5 GROUP BY 1,2),
p AS (SELECT x.model, x.pred_id, x.image_id, x.category_id, x.score, coalesce(cand.c, []) AS c, row_number() OVER (PARTITION BY x.model, x.image_id, x.category_id ORDER BY x.score DESC, x.pred_id) AS k
  FROM fx_predictions x LEFT JOIN cand ON cand.model=x.model AND cand.pred_id=x.pred_id),
step AS (SELECT DISTINCT model, image_id, category_id, CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS taken, CAST(NULL AS BIGINT) AS pred_id, CAST(NULL AS BIGINT) AS ann_id FROM p
  UNION ALL SELECT s.model, s.image_id, s.category_id, p.k, CASE WHEN len(list_filter(p.c, lambda z: NOT list_contains(s.taken, z)))=0 THEN s.taken ELSE list_append(s.taken, list_filter(p.c, lambda z: NOT list_contains(s.taken, z))[1]) END,
  p.pred_id, list_filter(p.c, lambda z: NOT list_contains(s.taken, z))[1] FROM step s JOIN p ON p.model=s.model AND p.image_id=s.image_id AND p.category_id=s.category_id AND p.k=s.k+1)"""
_CURVE = f"""{_GREEDY},
hit AS (SELECT model, pred_id FROM step WHERE ann_id IS NOT NULL),
th AS (SELECT k, CAST(k AS DOUBLE)*CAST(0.01 AS DOUBLE) AS thr FROM range(0,101) t(k)),
npos AS (SELECT model, category_id, npos FROM (SELECT category_id, count(*) AS npos FROM fx_annotations GROUP BY 1) a, (SELECT DISTINCT model FROM fx_predictions) m),
cnt AS (SELECT p.model, p.category_id, th.k, count(*) AS n, count(hit.pred_id) AS tp FROM fx_predictions p LEFT JOIN hit ON hit.model=p.model AND hit.pred_id=p.pred_id JOIN th ON p.score >= th.thr GROUP BY 1,2,3),
curve AS (SELECT *, CASE WHEN precision+recall>0 THEN 2*precision*recall/(precision+recall) ELSE 0 END AS f1 FROM (
  SELECT npos.model, npos.category_id, th.k, npos.npos, coalesce(cnt.tp,0) AS tp, coalesce(cnt.n,0) AS n, CASE WHEN cnt.n>0 THEN cnt.tp/cnt.n ELSE 0 END AS precision, coalesce(cnt.tp,0)/npos.npos AS recall
  FROM npos CROSS JOIN th LEFT JOIN cnt ON cnt.model=npos.model AND cnt.category_id=npos.category_id AND cnt.k=th.k) q)"""


@query("free_box_matches_g08", f"WITH RECURSIVE {_GREEDY} SELECT model, pred_id, ann_id FROM step WHERE ann_id IS NOT NULL")
def _(t):
    return E.free_box_matches(t("fx_predictions"), t("fx_annotations"), 0.5)


@query("threshold_curve_a09", f"WITH RECURSIVE {_CURVE} SELECT model, category_id, k, tp, n, round(precision,6) AS precision, round(recall,6) AS recall, round(f1,6) AS f1 FROM curve")
def _(t):
    c = E.threshold_curve(t("fx_predictions"), t("fx_annotations"))
    return c.select("model", "category_id", "k", "tp", "n", _r("precision", "precision"), _r("recall", "recall"), _r("f1", "f1"))


@query("best_thresholds_w04", f"""WITH RECURSIVE {_CURVE},
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY model, category_id ORDER BY f1 DESC, k) AS r FROM curve) q WHERE r=1),
pm AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY model, category_id ORDER BY precision DESC, k) AS r FROM curve WHERE recall >= 0.8) q WHERE r=1)
SELECT b.model, b.category_id, b.k AS best_k, round(b.f1,6) AS best_f1, coalesce(pm.k,b.k) AS prec_k, round(coalesce(pm.precision,b.precision),6) AS prec_at, round(coalesce(pm.recall,b.recall),6) AS rec_at FROM b LEFT JOIN pm ON pm.model=b.model AND pm.category_id=b.category_id""")
def _(t):
    b = E.best_thresholds(E.threshold_curve(t("fx_predictions"), t("fx_annotations")), 0.8)
    return b.select("model", "category_id", "best_k", _r("best_f1", "best_f1"), "prec_k", _r("prec_at", "prec_at"), _r("rec_at", "rec_at"))


@query("suppression_g07", f"""WITH RECURSIVE p AS (SELECT *, row_number() OVER (PARTITION BY model, image_id, category_id ORDER BY score DESC, pred_id) AS k FROM fx_predictions),
bad AS (SELECT model, pred_id, list(other) AS c FROM (SELECT p.model, p.pred_id, g.pred_id AS other, p.w*p.h+g.w*g.h AS both_, {_INTER} AS i
  FROM p JOIN p g ON p.model=g.model AND p.image_id=g.image_id AND p.category_id=g.category_id AND g.k<p.k) q WHERE CAST(i AS DOUBLE)/(both_-i) >= 0.3 GROUP BY 1,2),
pp AS (SELECT p.model, p.image_id, p.category_id, p.k, p.pred_id, coalesce(bad.c, []) AS c FROM p LEFT JOIN bad ON bad.model=p.model AND bad.pred_id=p.pred_id),
step AS (SELECT DISTINCT model, image_id, category_id, CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS kept, CAST(NULL AS BIGINT) AS pred_id FROM p
  UNION ALL SELECT s.model, s.image_id, s.category_id, pp.k, CASE WHEN list_has_any(s.kept, pp.c) THEN s.kept ELSE list_append(s.kept, pp.pred_id) END, CASE WHEN list_has_any(s.kept, pp.c) THEN NULL ELSE pp.pred_id END
  FROM step s JOIN pp ON pp.model=s.model AND pp.image_id=s.image_id AND pp.category_id=s.category_id AND pp.k=s.k+1)
SELECT model, pred_id FROM step WHERE pred_id IS NOT NULL""")
def _(t):
    return E.suppress(t("fx_predictions"), 0.3).select("model", "pred_id")


@query("mean_best_iou_a11", f"""WITH q AS (SELECT p.model, g.ann_id, p.w*p.h+g.w*g.h AS both_, {_INTER} AS i FROM fx_predictions p JOIN fx_annotations g ON p.image_id=g.image_id),
b AS (SELECT model, ann_id, max(CAST(i AS DOUBLE)/(both_-i)) AS iou FROM q GROUP BY 1,2)
SELECT model, count(*) AS n_truth, round(avg(iou),6) AS mean_iou FROM b GROUP BY 1""")
def _(t):
    b = E.best_iou_per_truth(t("fx_predictions"), t("fx_annotations"))
    return b.groupBy("model").agg(F.count(F.lit(1)).alias("n_truth"), _r(F.avg("iou"), "mean_iou"))


def _compared(t):
    ap = E.average_precision(t("fx_predictions"), t("fx_annotations"))
    return E.compare_classes(E.class_mean_ap(ap), "a", "b")


@query("model_comparison_j05_a27", f"{_MEAN} SELECT category_id, round(ap_first,6) AS ap_first, round(ap_second,6) AS ap_second, round(ap_second-ap_first,6) AS delta, CASE WHEN ap_second>=ap_first THEN 'b' ELSE 'a' END AS winner FROM cmp")
def _(t):
    c = _compared(t)
    winner = F.when(F.col("ap_second") >= F.col("ap_first"), "b").otherwise("a").alias("winner")
    return c.select("category_id", _r("ap_first", "ap_first"), _r("ap_second", "ap_second"), _r("delta", "delta"), winner)


@query("class_report_t05_p32", f"""{_MEAN} SELECT category_id, round(ap_first,6) AS ap_first, round(ap_second-ap_first,6) AS delta,
CASE WHEN ap_first<=0.01 AND ap_second<=0.01 THEN 'no_detections' WHEN ap_first<=0.05 AND ap_second>=0.3 THEN 'second_better' WHEN ap_second<=0.05 AND ap_first>=0.3 THEN 'first_better'
WHEN ap_first<0.2 AND ap_second<0.2 THEN 'both_weak' ELSE 'moderate' END AS advice FROM cmp ORDER BY ap_first, category_id LIMIT 20""")
def _(t):
    c = _compared(t).orderBy("ap_first", "category_id").limit(20)
    return c.select("category_id", _r("ap_first", "ap_first"), _r("delta", "delta"),
                    E.advice(F.col("ap_first"), F.col("ap_second")).alias("advice"))


@query("worst_class_examples_t01", f"""{_MEAN}, worst AS (SELECT category_id FROM cmp ORDER BY ap_first, category_id LIMIT 3),
im AS (SELECT DISTINCT category_id, image_id FROM fx_annotations WHERE category_id IN (SELECT category_id FROM worst))
SELECT category_id, image_id, r AS example FROM (SELECT *, row_number() OVER (PARTITION BY category_id ORDER BY image_id) AS r FROM im) q WHERE r<=5""")
def _(t):
    worst = _compared(t).orderBy("ap_first", "category_id").limit(3).select("category_id")
    images = t("fx_annotations").join(worst, "category_id", "left_semi").select("category_id", "image_id").distinct()
    return scale.top_n(images, ["category_id"], [F.col("image_id")], 5, "example").select(
        "category_id", "image_id", F.col("example").cast("bigint").alias("example"))


@query("score_filter_f02", "SELECT model, pred_id, score FROM fx_predictions WHERE score >= 0.5 AND category_id = 2")
def _(t):
    return t("fx_predictions").where("score >= 0.5 AND category_id = 2").select("model", "pred_id", "score")


@query("mask_iou_a11", """WITH g AS (SELECT sheet_id, CAST(floor(px/50) AS BIGINT) AS gt, px, py FROM fx_pixels), p AS (SELECT sheet_id, CAST(floor((px+15)/50) AS BIGINT) AS pr, px, py FROM fx_pixels),
a AS (SELECT sheet_id, gt, count(*) AS a FROM g GROUP BY 1,2), b AS (SELECT sheet_id, pr, count(*) AS b FROM p GROUP BY 1,2), c AS (SELECT g.sheet_id, gt, pr, count(*) AS i FROM g JOIN p ON p.sheet_id=g.sheet_id AND p.px=g.px AND p.py=g.py GROUP BY 1,2,3)
SELECT a.sheet_id, a.gt, round(max(coalesce(i/(a.a+b.b-i),0)),6) AS iou FROM a LEFT JOIN c ON c.sheet_id=a.sheet_id AND c.gt=a.gt LEFT JOIN b ON b.sheet_id=c.sheet_id AND b.pr=c.pr GROUP BY 1,2""")
def _(t):
    px = t("fx_pixels")
    g = px.withColumn("gt", F.floor(F.col("px") / 50))
    p = px.withColumn("pr", F.floor((F.col("px") + 15) / 50))
    m = E.mask_iou(g, p, ["sheet_id"])
    return m.select("sheet_id", "gt", _r("iou", "iou"))


@query("polygon_mask_iou_a11", """WITH g AS (SELECT ann_id, image_id, x+40 AS cx, y+25 AS cy FROM fx_annotations), p AS (SELECT pred_id, image_id, x+40 AS cx, y+25 AS cy FROM fx_predictions WHERE model='a'),
near AS (SELECT g.ann_id, p.pred_id, g.cx AS gx, g.cy AS gy, p.cx AS px, p.cy AS py FROM g JOIN p ON p.image_id=g.image_id AND abs(p.cx-g.cx)<=80 AND abs(p.cy-g.cy)<=50),
ys AS (SELECT *, unnest(range(greatest(gy,py)-25, least(gy,py)+26)) AS y FROM near),
w AS (SELECT *, CAST(floor((2000-abs(y-gy)*80)/50e0) AS BIGINT) AS gr, CAST(floor((2000-abs(y-py)*80)/50e0) AS BIGINT) AS pr FROM ys),
c AS (SELECT ann_id, pred_id, sum(greatest(0, least(gx+gr,px+pr)-greatest(gx-gr,px-pr)+1)) AS i FROM w GROUP BY 1,2),
one AS (SELECT sum(2*CAST(floor((2000-abs(y)*80)/50e0) AS BIGINT)+1) AS n FROM (SELECT unnest(range(-25,26)) AS y) q),
b AS (SELECT ann_id, max(CAST(i AS DOUBLE)/(2*n-i)) AS iou FROM c, one GROUP BY 1)
SELECT g.ann_id, round(coalesce(b.iou,0),6) AS iou FROM g LEFT JOIN b ON b.ann_id=g.ann_id WHERE g.image_id IN (SELECT image_id FROM p)""")
def _(t):
    def diamonds(df, name, number):
        pt = lambda dx, dy: F.array((F.col("x") + dx).cast("double"), (F.col("y") + dy).cast("double"))
        return df.select("image_id", F.col(number).alias(name), F.array(pt(40, 0), pt(80, 25), pt(40, 50), pt(0, 25)).alias("points"))

    best = E.polygon_mask_iou(diamonds(t("fx_annotations"), "gt", "ann_id"), diamonds(t("fx_predictions").where("model = 'a'"), "pr", "pred_id"), ["image_id"])
    return best.select(F.col("gt").alias("ann_id"), _r("iou", "iou"))
