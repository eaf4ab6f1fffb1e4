"""Box, polygon and label-line queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewright.functions import geometry as G
from tracewright.functions import labels as L
from tracewright.operators import spatial
from tracewright.plans.registry import query



def _r(c, name, digits=6):
    return F.round(c, digits).alias(name)


def _at(arr, i):
    return F.get(arr, F.lit(i))


def _flat(arr, names, digits=6):
    return [_r(_at(arr, i), n, digits) for i, n in enumerate(names)]


CORNERS = ["x1", "y1", "x2", "y2", "x3", "y3", "x4", "y4"]
_CORNER_SQL = ", ".join(
    f"round(cx+({sx}*w/2)*cos(a)-({sy}*h/2)*sin(a),6) AS x{k}, round(cy+({sx}*w/2)*sin(a)+({sy}*h/2)*cos(a),6) AS y{k}"
    for k, (sx, sy) in enumerate(((-1, -1), (1, -1), (1, 1), (-1, 1)), 1)
)


@query("box_metrics_p01", "SELECT ann_id, CAST(w*h AS DOUBLE) AS area, round(w/h,6) AS aspect_ratio, round(sqrt(w*w+h*h),6) AS diagonal FROM fx_annotations")
def _(t):
    X, Y, W, H = BOX = G.box()
    m = G.box_metrics(BOX)
    return t("fx_annotations").select("ann_id", m["area"].alias("area"), _r(m["aspect_ratio"], "aspect_ratio"), _r(m["diagonal"], "diagonal"))


@query("centre_distance_p02", """SELECT p.model, p.pred_id, g.ann_id, round(sqrt((p.x+p.w/2-g.x-g.w/2)*(p.x+p.w/2-g.x-g.w/2)+(p.y+p.h/2-g.y-g.h/2)*(p.y+p.h/2-g.y-g.h/2)),6) AS distance
FROM fx_predictions p JOIN fx_annotations g ON p.pred_id=g.ann_id""")
def _(t):
    X, Y, W, H = BOX = G.box()
    p = t("fx_predictions").select("model", "pred_id", *[c.alias(f"l_{n}") for c, n in zip(BOX, "xywh")])
    g = t("fx_annotations").select("ann_id", *[c.alias(f"r_{n}") for c, n in zip(BOX, "xywh")])
    a, b = G.centre(G.box("l_")), G.centre(G.box("r_"))
    return p.join(g, p.pred_id == g.ann_id).select("model", "pred_id", "ann_id", _r(G.distance(*a, *b), "distance"))


@query("box_units_p03", """SELECT ann_id, round(CAST(a.x AS DOUBLE)/i.width,6) AS fx, round(CAST(a.y AS DOUBLE)/i.height,6) AS fy,
CAST(floor(a.x/10/100*i.width) AS BIGINT) AS px1, CAST(floor(a.y/10/100*i.height) AS BIGINT) AS py1,
CAST(floor(a.x/10/100*i.width)+greatest(1,floor(a.w/10/100*i.width)) AS BIGINT) AS px2, CAST(floor(a.y/10/100*i.height)+greatest(1,floor(a.h/10/100*i.height)) AS BIGINT) AS py2
FROM fx_annotations a JOIN fx_images i ON a.image_id=i.image_id""")
def _(t):
    X, Y, W, H = BOX = G.box()
    a = t("fx_annotations").join(t("fx_images"), "image_id")
    # fixture boxes are read as tenths of a percent here
    px = L.percent_to_pixels(*[c / 10 for c in BOX], F.col("width"), F.col("height"))
    return a.select("ann_id", _r(X / F.col("width"), "fx"), _r(Y / F.col("height"), "fy"),
                    *[_at(px, i).cast("bigint").alias(n) for i, n in enumerate(["px1", "py1", "px2", "py2"])])


@query("rotated_corners_p04", f"SELECT ann_id, {_CORNER_SQL} FROM (SELECT ann_id, x AS cx, y AS cy, w, h, radians(rotation) AS a FROM fx_annotations) q")
def _(t):
    X, Y, W, H = BOX = G.box()
    poly = G.rotated_corners(X, Y, W, H, F.col("rotation"))
    return t("fx_annotations").select("ann_id", poly.alias("p")).select("ann_id", *_flat(F.col("p"), CORNERS))


@query("rotated_percent_corners_p04", f"""SELECT ann_id, {_CORNER_SQL} FROM (SELECT ann_id, w*i_w/1000 AS w, h*i_h/1000 AS h, x*i_w/1000+w*i_w/2000 AS cx, y*i_h/1000+h*i_h/2000 AS cy, radians(-rotation) AS a
FROM (SELECT a.*, i.width AS i_w, i.height AS i_h FROM fx_annotations a JOIN fx_images i ON a.image_id=i.image_id) z) q""")
def _(t):
    X, Y, W, H = BOX = G.box()
    a = t("fx_annotations").join(t("fx_images"), "image_id")
    x, w = X / 1000 * F.col("width"), W / 1000 * F.col("width")
    y, h = Y / 1000 * F.col("height"), H / 1000 * F.col("height")
    poly = G.rotated_corners(x + w / 2, y + h / 2, w, h, -F.col("rotation"))
    return a.select("ann_id", poly.alias("p")).select("ann_id", *_flat(F.col("p"), CORNERS))


@query("polygon_box_area_p05", f"""SELECT ann_id, round(least(x1,x2,x3,x4),4) AS x, round(least(y1,y2,y3,y4),4) AS y, round(greatest(x1,x2,x3,x4)-least(x1,x2,x3,x4),4) AS w, round(greatest(y1,y2,y3,y4)-least(y1,y2,y3,y4),4) AS h,
round(abs(x1*y2-x2*y1+x2*y3-x3*y2+x3*y4-x4*y3+x4*y1-x1*y4)/2,3) AS area
FROM (SELECT ann_id, {_CORNER_SQL.replace('round(', '(').replace(',6)', ')')} FROM (SELECT ann_id, x AS cx, y AS cy, w, h, radians(rotation) AS a FROM fx_annotations) q) z""")
def _(t):
    X, Y, W, H = BOX = G.box()
    a = t("fx_annotations").select("ann_id", G.rotated_corners(X, Y, W, H, F.col("rotation")).alias("p"))
    return a.select("ann_id", *_flat(G.polygon_box(F.col("p")), "xywh", 4), _r(G.polygon_area(F.col("p")), "area", 3))


_FORM = "CASE WHEN rotation<>0 THEN 'label_studio' WHEN category_id=5 THEN 'yolov8_obb' ELSE 'coco_standard' END"


@query("annotation_format_p06", f"""SELECT image_id, coalesce(arg_max(CASE WHEN f<>'coco_standard' THEN f END, CASE WHEN f<>'coco_standard' THEN ann_id END),'coco_standard') AS format,
CAST(sum(CASE WHEN f<>'coco_standard' THEN 1 ELSE 0 END) AS BIGINT) AS rotated_count, count(*) AS total_count FROM (SELECT *, {_FORM} AS f FROM fx_annotations) q GROUP BY 1""")
def _(t):
    X, Y, W, H = BOX = G.box()
    a = t("fx_annotations").withColumns({
        "rotation": F.when(F.col("rotation") != 0, F.col("rotation")),
        "bbox": F.when(F.col("category_id") == 5, F.array(X, Y, W, H, F.lit(15))).otherwise(F.array(*BOX)),
    })
    from tracewright.operators.datasets import annotation_format, file_format

    return file_format(a.withColumn("format", annotation_format(F.col("rotation"), F.col("bbox"))), ["image_id"])


@query("format_conversion_p06", f"""SELECT ann_id, bx, round(x1,6) AS x1, round(y1,6) AS y1, round(x3,6) AS x3, round(y3,6) AS y3 FROM (
SELECT ann_id, f, CASE WHEN f='yolov8_obb' THEN x-w/2 ELSE x END AS bx,
CASE WHEN f='coco_standard' THEN x ELSE x-w/2*cos(a)+h/2*sin(a) END AS x1, CASE WHEN f='coco_standard' THEN y ELSE y-w/2*sin(a)-h/2*cos(a) END AS y1,
CASE WHEN f='coco_standard' THEN x+w ELSE x+w/2*cos(a)-h/2*sin(a) END AS x3, CASE WHEN f='coco_standard' THEN y+h ELSE y+w/2*sin(a)+h/2*cos(a) END AS y3
FROM (SELECT *, {_FORM} AS f, radians(CASE WHEN rotation<>0 THEN rotation ELSE 15 END) AS a FROM fx_annotations) q) z""")
def _(t):
    X, Y, W, H = BOX = G.box()
    from tracewright.operators.datasets import to_polygon_rows

    a = t("fx_annotations").withColumns({
        "rotation": F.when(F.col("rotation") != 0, F.col("rotation").cast("double")),
        "bbox": F.when(F.col("category_id") == 5, F.array(X, Y, W, H, F.lit(15))).otherwise(F.array(*BOX)).cast("array<double>"),
        "segmentation": F.lit(None).cast("array<array<double>>"),
    })
    s = _at(F.col("segmentation"), 0)
    return to_polygon_rows(a).select("ann_id", _at(F.col("bbox"), 0).alias("bx"), _r(_at(s, 0), "x1"), _r(_at(s, 1), "y1"), _r(_at(s, 4), "x3"), _r(_at(s, 5), "y3"))


_LINE = "printf('%.6f %.6f %.6f %.6f %.6f %.6f %.6f %.6f', x1,y1,x2,y1,x2,y2,x1,y2)"


@query("label_lines_p07", f"""SELECT ann_id, concat(CAST(idx AS VARCHAR), ' ', {_LINE}) AS line FROM (
SELECT a.ann_id, c.idx, greatest(0,least(1,a.x/i.width)) AS x1, greatest(0,least(1,a.y/i.height)) AS y1, greatest(0,least(1,(a.x+a.w)/i.width)) AS x2, greatest(0,least(1,(a.y+a.h)/i.height)) AS y2
FROM fx_annotations a JOIN fx_images i ON a.image_id=i.image_id JOIN (SELECT category_id, row_number() OVER (ORDER BY category_id)-1 AS idx FROM fx_categories) c ON c.category_id=a.category_id) q""")
def _(t):
    X, Y, W, H = BOX = G.box()
    a = t("fx_annotations").join(t("fx_images"), "image_id").join(L.class_index(t("fx_categories")), "category_id")
    rect = F.array(X, Y, X + W, Y, X + W, Y + H, X, Y + H)
    coords = G.scale_polygon(rect, F.col("width"), F.col("height"))
    return a.select("ann_id", L.to_line(F.col("class_idx"), coords).alias("line"))


@query("label_lines_unclamped_p07_f07", f"""SELECT ann_id, concat(CAST(cat-1 AS VARCHAR), ' ', {_LINE}) AS line FROM (
SELECT a.ann_id, a.cat, a.x/i.width AS x1, a.y/i.height AS y1, (a.x+a.w)/i.width AS x2, (a.y+a.h)/i.height AS y2
FROM (SELECT *, 1+(category_id+ann_id)%6 AS cat FROM fx_annotations) a JOIN fx_images i ON a.image_id=i.image_id JOIN fx_categories c ON c.category_id=a.cat WHERE c.name<>'ignore_region') q""")
def _(t):
    X, Y, W, H = BOX = G.box()
    a = t("fx_annotations").withColumn("category_id", 1 + (F.col("category_id") + F.col("ann_id")) % 6)
    a = a.join(t("fx_images"), "image_id").join(t("fx_categories"), "category_id").where("name <> 'ignore_region'")
    rect = F.array(X, Y, X + W, Y, X + W, Y + H, X, Y + H)
    coords = G.scale_polygon(rect, F.col("width"), F.col("height"), bounded=False)
    return a.select("ann_id", L.to_line(F.col("category_id") - 1, coords).alias("line"))


_F = "CAST(split_part(line,' ',{}) AS DOUBLE)"


@query("label_line_to_row_p08_s04", f"""SELECT line_id, category_id, x, y, round(x2-x,6) AS w, round(y2-y,6) AS h, round((x2-x)*(y2-y),4) AS area FROM (
SELECT l.line_id, CAST(split_part(line,' ',1) AS BIGINT)+1 AS category_id, round({_F.format(2)}*i.width,2) AS x, round({_F.format(3)}*i.height,2) AS y, round({_F.format(6)}*i.width,2) AS x2, round({_F.format(7)}*i.height,2) AS y2
FROM fx_labels l JOIN fx_images i ON l.image_id=i.image_id WHERE len(string_split(line,' '))>=3) q""")
def _(t):
    rows = t("fx_labels").join(t("fx_images"), "image_id").withColumn("c", L.line_coords(F.col("line"))).where("c IS NOT NULL")
    seg = rows.withColumn("s", L.to_pixels(F.col("c"), F.col("width"), F.col("height")))
    return seg.select("line_id", (L.line_class(F.col("line")) + 1).alias("category_id"),
                      *_flat(G.polygon_box(F.col("s")), "xywh"), _r(G.polygon_area(F.col("s")), "area", 4))


@query("corner_line_to_centre_p09", f"""SELECT line_id, CASE WHEN len(string_split(line,' '))=9 THEN concat(split_part(line,' ',1), printf(' %.6f %.6f %.6f %.6f', ({_F.format(2)}+{_F.format(6)})/2, ({_F.format(3)}+{_F.format(7)})/2, {_F.format(6)}-{_F.format(2)}, {_F.format(7)}-{_F.format(3)})) END AS line FROM fx_labels""")
def _(t):
    return t("fx_labels").select("line_id", L.corners_to_centre_line(F.col("line")).alias("line"))


@query("percent_to_centre_p10", """SELECT ann_id, round(greatest(0.0001e0,least(0.9999e0,(x+w/2)/500)),6) AS xc, round(greatest(0.0001e0,least(0.9999e0,(y+h/2)/500)),6) AS yc, round(greatest(0.0001e0,least(1e0,w/500)),6) AS w, round(greatest(0.0001e0,least(1e0,h/500)),6) AS h FROM fx_annotations""")
def _(t):
    X, Y, W, H = BOX = G.box()
    # fixture pixels over 500 as percent values
    c = L.percent_to_centre(*[v / 5.0 for v in BOX])
    return t("fx_annotations").select("ann_id", c.alias("c")).select("ann_id", *_flat(F.col("c"), ["xc", "yc", "w", "h"]))


_PW, _PH = "CASE cls WHEN 0 THEN 60 WHEN 1 THEN 20 WHEN 2 THEN 60 WHEN 3 THEN 40 WHEN 4 THEN 80 END", "CASE cls WHEN 0 THEN 20 WHEN 1 THEN 40 WHEN 2 THEN 20 WHEN 3 THEN 40 WHEN 4 THEN 60 END"


@query("label_offset_p11", f"""SELECT line_id, round(x1,6) AS x1, round(y1,6) AS y1, round(x3,6) AS x3, round(y3,6) AS y3, x1 IN (0,1) OR y1 IN (0,1) OR x3 IN (0,1) OR y3 IN (0,1) AS on_edge FROM (
SELECT line_id, CASE WHEN pw IS NULL THEN a ELSE greatest(0,least(1,a-pw/2/width)) END AS x1, CASE WHEN pw IS NULL THEN b ELSE greatest(0,least(1,b-ph/2/height)) END AS y1,
CASE WHEN pw IS NULL THEN c ELSE greatest(0,least(1,c-pw/2/width)) END AS x3, CASE WHEN pw IS NULL THEN d ELSE greatest(0,least(1,d-ph/2/height)) END AS y3 FROM (
SELECT *, {_PW} AS pw, {_PH} AS ph FROM (SELECT l.line_id, i.width, i.height, CAST(split_part(line,' ',1) AS BIGINT) AS cls, {_F.format(2)} AS a, {_F.format(3)} AS b, {_F.format(6)} AS c, {_F.format(7)} AS d
FROM fx_labels l JOIN fx_images i ON l.image_id=i.image_id WHERE len(string_split(line,' '))>=3) q) z) y""")
def _(t):
    rows = t("fx_labels").join(t("fx_images"), "image_id").withColumn("c", L.line_coords(F.col("line"))).where("c IS NOT NULL")
    moved = rows.withColumn("m", L.shift_label(F.col("c"), L.line_class(F.col("line")).cast("int"), F.col("width"), F.col("height")))
    m = F.col("m")
    return moved.select("line_id", _r(_at(m, 0), "x1"), _r(_at(m, 1), "y1"), _r(_at(m, 4), "x3"), _r(_at(m, 5), "y3"), L.touches_edge(m).alias("on_edge"))


@query("page_range_p21", """SELECT p_partkey AS id, string_agg(CAST(n AS VARCHAR), ',' ORDER BY n) AS pages FROM (
SELECT DISTINCT p_partkey, unnest([p_size, p_size+1, p_size+2, CASE WHEN p_partkey%4=3 THEN 7 ELSE p_size END]) AS n FROM part) q GROUP BY 1""")
def _(t):
    p = t("part")
    n = F.col("p_size")
    text = F.concat(n.cast("string"), F.lit("-"), (n + 2).cast("string"), F.lit(", x-3, ,"),
                    F.when(F.col("p_partkey") % 4 == 3, " 7 ").otherwise("q"), F.lit(",9-4"))
    pages = L.page_range(text)
    return p.select(F.col("p_partkey").alias("id"), F.array_join(pages.cast("array<string>"), ",").alias("pages"))


@query("roi_box_p22", """SELECT ann_id, rx, ry, greatest(rx2-rx,1) AS rw, greatest(ry2-ry,1) AS rh, least(640,greatest(0,rx)+(rx2-rx))-greatest(0,rx) AS clip_w FROM (
SELECT ann_id, CAST(round_even((x-40)/4,0) AS BIGINT) AS rx, CAST(round_even((y-40)/4,0) AS BIGINT) AS ry, CAST(round_even((x+w)/4,0) AS BIGINT) AS rx2, CAST(round_even((y+h)/4,0) AS BIGINT) AS ry2 FROM fx_annotations) q""")
def _(t):
    X, Y, W, H = BOX = G.box()
    from tracewright.functions import regions as R

    pts = F.array(F.array((X - 40) / 4, (Y - 40) / 4), F.array((X + W) / 4, (Y + H) / 4), F.array((X - 40) / 4, (Y + H) / 4))
    roi = R.roi_of_points(pts)
    a = t("fx_annotations").select("ann_id", roi.alias("r")).select("ann_id", "r.*")
    clip = R.clip_roi(F.col("x"), F.col("y"), F.col("w"), F.col("h"), F.lit(640), F.lit(100000))
    return a.select("ann_id", F.col("x").alias("rx"), F.col("y").alias("ry"), F.col("w").alias("rw"), F.col("h").alias("rh"), clip["width"].alias("clip_w"))


@query("region_normalise_p23", """SELECT region_id, unit, round(greatest(0,least(width, l)),6) AS x1, round(greatest(0,least(height, t)),6) AS y1, round(greatest(0,least(width, r)),6) AS x2, round(greatest(0,least(height, b)),6) AS y2 FROM (
SELECT *, CASE unit WHEN 'fraction' THEN x*width ELSE CASE unit WHEN 'percent' THEN x/100*width ELSE x END END AS l, CASE unit WHEN 'fraction' THEN y*height ELSE CASE unit WHEN 'percent' THEN y/100*height ELSE y END END AS t,
CASE unit WHEN 'fraction' THEN x2*width ELSE CASE unit WHEN 'percent' THEN x2/100*width ELSE x2 END END AS r, CASE unit WHEN 'fraction' THEN y2*height ELSE CASE unit WHEN 'percent' THEN y2/100*height ELSE y2 END END AS b FROM (
SELECT *, CASE WHEN greatest(x2,y2)<=1 THEN 'fraction' WHEN greatest(x2,y2)<=100 THEN 'percent' ELSE 'pixel' END AS unit FROM (
SELECT r.region_id, i.width, i.height, CAST(r.x AS DOUBLE)/d AS x, CAST(r.y AS DOUBLE)/d AS y, CAST(r.x+r.w AS DOUBLE)/d AS x2, CAST(r.y+r.h AS DOUBLE)/d AS y2 FROM (SELECT *, CASE region_id%3 WHEN 0 THEN 1000 WHEN 1 THEN 10 ELSE 1 END AS d FROM fx_regions) r JOIN fx_images i ON i.image_id=r.image_id) q) z) v
WHERE least(width,r)>greatest(0,l) AND least(height,b)>greatest(0,t)""")
def _(t):
    X, Y, W, H = BOX = G.box()
    from tracewright.functions import regions as R

    d = F.when(F.col("region_id") % 3 == 0, 1000.0).when(F.col("region_id") % 3 == 1, 10.0).otherwise(1.0)
    r = t("fx_regions").join(t("fx_images"), "image_id").withColumn(
        "pts", F.array(F.array(X / d, Y / d), F.array((X + W) / d, (Y + H) / d)))
    norm = R.normalise_region(F.lit("rect"), F.col("pts"), F.col("width"), F.col("height"))
    out = r.withColumn("n", norm).where("n IS NOT NULL")
    p = F.col("n.points")
    return out.select("region_id", F.col("n.unit").alias("unit"), _r(_at(_at(p, 0), 0), "x1"), _r(_at(_at(p, 0), 1), "y1"),
                      _r(_at(_at(p, 2), 0), "x2"), _r(_at(_at(p, 2), 1), "y2"))


@query("default_part_box_p27", """SELECT ann_id, x-ww/2 AS bx, y-hh/2 AS by_, ww AS bw, hh AS bh FROM (SELECT ann_id, x, y, CASE WHEN up THEN h0 ELSE w0 END AS ww, CASE WHEN up THEN w0 ELSE h0 END AS hh FROM (
SELECT ann_id, x, y, ((rotation*6)%180)=90 AS up, CAST(CASE category_id WHEN 1 THEN 140 WHEN 2 THEN 100 WHEN 3 THEN 160 WHEN 4 THEN 120 ELSE 80 END AS DOUBLE) AS w0, CAST(CASE category_id WHEN 5 THEN 50 WHEN 3 THEN 50 ELSE 40 END AS DOUBLE) AS h0 FROM fx_annotations) q) z""")
def _(t):
    X, Y, W, H = BOX = G.box()
    letter = F.element_at(F.array(*[F.lit(c) for c in "rcldz"]), F.col("category_id").cast("int"))
    b = L.default_box(letter, X, Y, F.col("rotation") * 6)
    return t("fx_annotations").select("ann_id", b.alias("b")).select("ann_id", *[_at(F.col("b"), i).alias(n) for i, n in enumerate(["bx", "by_", "bw", "bh"])])


@query("tile_manifest_p33", """SELECT image_id, r AS tile_row, c AS tile_col, c*tw AS x1, r*th AS y1, CASE WHEN c=2 THEN width ELSE c*tw+tw END AS x2, CASE WHEN r=3 THEN height ELSE r*th+th END AS y2
FROM (SELECT image_id, width, height, width//3 AS tw, height//4 AS th FROM fx_images) i, range(0,4) a(r), range(0,3) b(c)""")
def _(t):
    from tracewright.functions import regions as R

    return R.tiles(t("fx_images"), 4, 3).select("image_id", "tile_row", "tile_col", "x1", "y1", "x2", "y2")


@query("box_validity_f08", """SELECT a.ann_id, a.w>0 AND a.h>0 AND a.x-15>=0 AND a.y>=0 AND a.x-15+a.w<=i.width-150 AND a.y+a.h<=i.height-100 AS valid FROM fx_annotations a JOIN fx_images i ON a.image_id=i.image_id""")
def _(t):
    X, Y, W, H = BOX = G.box()
    a = t("fx_annotations").join(t("fx_images"), "image_id")
    return a.select("ann_id", G.box_inside([X - 15, Y, W, H], F.col("width") - 150, F.col("height") - 100).alias("valid"))


@query("image_kind_f03", "SELECT image_id, file_name FROM fx_images WHERE file_name LIKE 'synthetic\\_%' ESCAPE '\\' OR file_name LIKE 'schematic\\_%' ESCAPE '\\'")
def _(t):
    name = F.col("file_name")
    return t("fx_images").where(name.startswith("synthetic_") | name.startswith("schematic_")).select("image_id", "file_name")


@query("ignore_box_filter_j08", """WITH hit AS (SELECT DISTINCT p.model, p.pred_id FROM fx_predictions p JOIN fx_regions r ON p.image_id=r.image_id
WHERE greatest(0,least(p.x+p.w,r.x+r.w)-greatest(p.x,r.x))*greatest(0,least(p.y+p.h,r.y+r.h)-greatest(p.y,r.y))/greatest(1,p.w*p.h) >= 0.3)
SELECT p.model, p.pred_id FROM fx_predictions p LEFT JOIN hit ON hit.model=p.model AND hit.pred_id=p.pred_id WHERE hit.pred_id IS NULL""")
def _(t):
    from tracewright.functions import regions as R

    return R.outside_regions(t("fx_predictions"), t("fx_regions"), ["image_id"], ["model", "pred_id"], 0.3).select("model", "pred_id")


@query("ignore_polygon_filter_j08", """WITH b AS (SELECT p.model, p.pred_id, p.image_id, greatest(0,p.x) AS x1, greatest(0,p.y) AS y1, least(i.width,p.x+p.w) AS x2, least(i.height,p.y+p.h) AS y2 FROM fx_predictions p JOIN fx_images i ON i.image_id=p.image_id),
pr AS (SELECT b.model, b.pred_id, x1, y1, x2, y2, r.x+40 AS cx, r.y+25 AS cy FROM b JOIN fx_regions r ON r.image_id=b.image_id AND x2>x1 AND y2>y1 AND r.x<x2 AND r.x+80>=x1 AND r.y<y2 AND r.y+50>=y1),
py AS (SELECT *, unnest(range(greatest(y1,cy-25), least(y2,cy+26))) AS y FROM pr), px AS (SELECT *, unnest(range(greatest(x1,cx-40), least(x2,cx+41))) AS x FROM py),
hit AS (SELECT model, pred_id FROM px WHERE abs(x-cx)*50+abs(y-cy)*80<=2000 GROUP BY model, pred_id HAVING count(DISTINCT x*10000+y)/((max(x2)-max(x1))*(max(y2)-max(y1)))>=0.3)
SELECT p.model, p.pred_id FROM fx_predictions p LEFT JOIN hit ON hit.model=p.model AND hit.pred_id=p.pred_id WHERE hit.pred_id IS NULL""")
def _(t):
    from tracewright.functions import regions as R

    X, Y, W, H = G.box()
    pt = lambda x, y: F.array(x.cast("double"), y.cast("double"))
    diamond = F.array(pt(X + 40, Y), pt(X + W, Y + 25), pt(X + 40, Y + H), pt(X, Y + 25))
    polygons = t("fx_regions").select("image_id", diamond.alias("points"))
    boxes = t("fx_predictions").join(t("fx_images").select("image_id", "width", "height"), "image_id")
    return R.outside_polygons(boxes, polygons, ["image_id"], ["model", "pred_id"], 0.3).select("model", "pred_id")
