"""Annotation-set queries: merge, split, subset, rename."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewright.functions import labels as L
from tracewright.operators import datasets as D
from tracewright.operators import scale
from tracewright.plans.registry import query

_IMS = "ims AS (SELECT *, row_number() OVER (ORDER BY file_idx, pos) AS new_id FROM fx_file_images)"
_CATS = "cats AS (SELECT *, row_number() OVER (ORDER BY file_idx, pos) AS new_id FROM fx_file_categories)"
_CATM = """firsts AS (SELECT name, row_number() OVER (ORDER BY file_idx, pos) AS new_id FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY file_idx, pos) AS r FROM fx_file_categories) q WHERE r=1),
cats AS (SELECT c.*, f.new_id FROM fx_file_categories c JOIN firsts f ON f.name=c.name)"""


@query("merged_categories_u02", f"WITH {_CATM} SELECT file_idx, old_id, name, new_id FROM cats")
def _(t):
    return D.merge_categories(t("fx_file_categories"), True).select("file_idx", "old_id", "name", "new_id")


@query("merged_image_ids_w05", f"WITH {_IMS} SELECT file_idx, old_id, new_id, file_name FROM ims")
def _(t):
    return D.merge_images(t("fx_file_images")).select("file_idx", "old_id", "new_id", "file_name")


def _merge_sql(cats):
    return f"""WITH {_IMS}, {cats} SELECT row_number() OVER (ORDER BY a.file_idx, a.pos) AS new_id, a.file_idx, a.pos, i.new_id AS new_image_id, c.new_id AS new_category_id
FROM fx_file_annotations a JOIN ims i ON i.file_idx=a.file_idx AND i.old_id=a.image_id JOIN cats c ON c.file_idx=a.file_idx AND c.old_id=a.category_id"""


def _merged(t, auto):
    out = D.merge_annotations(t("fx_file_annotations"), D.merge_images(t("fx_file_images")), D.merge_categories(t("fx_file_categories"), auto))
    return out.select("new_id", "file_idx", "pos", "new_image_id", "new_category_id")


@query("dataset_merge_u01_j02", _merge_sql(_CATM))
def _(t):
    return _merged(t, True)


@query("dataset_merge_kept_apart_u01_u02", _merge_sql(_CATS))
def _(t):
    return _merged(t, False)


@query("repeated_file_names_w11", """SELECT file_idx, old_id, file_name FROM (SELECT *, row_number() OVER (PARTITION BY file_name ORDER BY file_idx, pos) AS r FROM fx_file_images) q WHERE r>1""")
def _(t):
    return D.repeated_names(t("fx_file_images")).select("file_idx", "old_id", "file_name")


@query("canonical_categories_u03", """SELECT pos, file_idx, CASE c.name WHEN 'resistor' THEN 1 WHEN 'capacitor' THEN 2 WHEN 'inductor' THEN 3 WHEN 'diode' THEN 4 END AS category_id, c.name FROM (
SELECT a.pos, a.file_idx, k.name FROM fx_file_annotations a JOIN fx_file_categories k ON k.file_idx=a.file_idx AND k.old_id=a.category_id) c WHERE c.name IN ('resistor','capacitor','inductor','diode')""")
def _(t):
    # fixed values: canonical ids by name
    canon = {"resistor": 1, "capacitor": 2, "inductor": 3, "diode": 4}
    c = t("fx_file_categories").select("file_idx", F.col("old_id").alias("category_id"), "name")
    a = t("fx_file_annotations").join(c, ["file_idx", "category_id"])
    return a.select("pos", "file_idx", L.lookup(F.col("name"), canon).alias("category_id"), "name").where("category_id IS NOT NULL")


@query("task_last_wins_u04", """SELECT entry_id, first_pos, entry_type, seq AS last_seq FROM (SELECT *, min(seq) OVER (PARTITION BY entry_id) AS first_pos, row_number() OVER (PARTITION BY entry_id ORDER BY seq DESC) AS r FROM fx_entries) q WHERE r=1""")
def _(t):
    e = t("fx_entries").withColumn("last_seq", F.col("seq"))
    return D.last_wins(e, "entry_id", "seq", ["entry_type", "last_seq"])


_RANK = "row_number() OVER (ORDER BY md5(concat('42:', CAST(image_id AS VARCHAR))), image_id)"


@query("split_assignment_w12", f"""SELECT image_id, CASE WHEN k<=floor(n*0.7e0) THEN 'train' WHEN k<=floor(n*0.7e0)+floor(n*0.2e0) THEN 'val' ELSE 'test' END AS split
FROM (SELECT image_id, {_RANK} AS k, count(*) OVER () AS n FROM fx_images) q""")
def _(t):
    return D.split_by_ratio(t("fx_images").select("image_id"), "image_id", 42, [("train", 0.7), ("val", 0.2)], "test")


@query("split_synthetic_to_train_w12_f03", f"""SELECT image_id, 'train' AS split FROM fx_images WHERE NOT file_name LIKE 'scan%' UNION ALL
SELECT image_id, CASE WHEN k<=floor(n*0.2e0) THEN 'val' WHEN k<=floor(n*0.2e0)+floor(n*0.1e0) THEN 'test' ELSE 'train' END FROM (SELECT image_id, {_RANK} AS k, count(*) OVER () AS n FROM fx_images WHERE file_name LIKE 'scan%') q""")
def _(t):
    name = F.col("file_name")
    made = name.startswith("synthetic_") | name.startswith("schematic_")
    im = t("fx_images")
    real = D.split_by_ratio(im.where(~made).select("image_id"), "image_id", 42, [("val", 0.2), ("test", 0.1)], "train")
    return im.where(made).select("image_id", F.lit("train").alias("split")).unionByName(real)


@query("stratified_split_w12", """WITH n AS (SELECT image_id, category_id, count(*) AS n FROM fx_annotations GROUP BY 1,2),
d AS (SELECT image_id, category_id AS stratum FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY n DESC, category_id) AS r FROM n) q WHERE r=1)
SELECT image_id, stratum, CASE WHEN k<=floor(c*0.8e0) THEN 'train' ELSE 'test' END AS split FROM (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY md5(concat('7:', CAST(image_id AS VARCHAR))), image_id) AS k, count(*) OVER (PARTITION BY stratum) AS c FROM d) q""")
def _(t):
    d = D.dominant_class(t("fx_annotations"))
    return D.split_by_ratio(d, "image_id", 7, [("train", 0.8)], "test", ["stratum"]).select("image_id", "stratum", "split")


@query("class_counts_per_image_w14", """SELECT image_id, category_id, count(*) AS n, CAST(sum(count(*)) OVER (PARTITION BY image_id) AS BIGINT) AS image_total FROM fx_annotations GROUP BY 1,2""")
def _(t):
    n = t("fx_annotations").groupBy("image_id", "category_id").agg(F.count(F.lit(1)).alias("n"))
    return n.join(n.groupBy("image_id").agg(F.sum("n").alias("image_total")), "image_id").select("image_id", "category_id", "n", "image_total")


@query("split_members_j03", f"""WITH s AS (SELECT image_id FROM (SELECT image_id, {_RANK} AS k, count(*) OVER () AS n FROM fx_images) q WHERE k<=floor(n*0.7e0)) SELECT ann_id, image_id FROM fx_annotations WHERE image_id IN (SELECT image_id FROM s)""")
def _(t):
    s = D.split_by_ratio(t("fx_images").select("image_id"), "image_id", 42, [("train", 0.7), ("val", 0.2)], "test")
    return t("fx_annotations").join(s.where("split = 'train'"), "image_id", "left_semi").select("ann_id", "image_id")


@query("dangling_references_j04", """SELECT a.file_idx, a.pos, CASE WHEN i.old_id IS NULL THEN 'image' ELSE 'category' END AS missing FROM fx_file_annotations a LEFT JOIN fx_file_images i ON i.file_idx=a.file_idx AND i.old_id=a.image_id
LEFT JOIN fx_file_categories c ON c.file_idx=a.file_idx AND c.old_id=a.category_id WHERE i.old_id IS NULL OR c.old_id IS NULL""")
def _(t):
    a = t("fx_file_annotations")
    im = t("fx_file_images").select("file_idx", F.col("old_id").alias("image_id"))
    cat = t("fx_file_categories").select("file_idx", F.col("old_id").alias("category_id"))
    no_image = a.join(im, ["file_idx", "image_id"], "left_anti")
    no_cat = a.join(im, ["file_idx", "image_id"], "left_semi").join(cat, ["file_idx", "category_id"], "left_anti")
    tag = lambda df, v: df.select("file_idx", "pos", F.lit(v).alias("missing"))
    return tag(no_image, "image").unionByName(tag(no_cat, "category"))


@query("first_images_subset_f10", """WITH f AS (SELECT image_id FROM fx_images ORDER BY image_id LIMIT 20) SELECT ann_id, image_id FROM fx_annotations WHERE image_id IN (SELECT image_id FROM f)""")
def _(t):
    first = D.first_n(t("fx_images").select("image_id"), [F.col("image_id")], 20)
    return t("fx_annotations").join(first, "image_id", "left_semi").select("ann_id", "image_id")


@query("block_list_f04", "SELECT image_id, file_name FROM fx_images WHERE file_name NOT IN ('scan_2.png','scan_3.png','synthetic_5.png')")
def _(t):
    blocked = t.spark.createDataFrame([("scan_2.png",), ("scan_3.png",), ("synthetic_5.png",)], "base string")
    im = t("fx_images").withColumn("base", F.element_at(F.split(F.concat(F.lit("upload/"), "file_name"), "/"), -1))
    return im.join(blocked, "base", "left_anti").select("image_id", "file_name")


@query("training_mix_u07", """WITH made AS (SELECT image_id, file_name FROM fx_images WHERE file_name NOT LIKE 'scan%')
SELECT image_id, 'train' AS split FROM (SELECT image_id, row_number() OVER (ORDER BY md5(concat('1:', CAST(image_id AS VARCHAR))), image_id) AS k FROM made WHERE image_id%3<>0) q WHERE k<=100
UNION ALL SELECT image_id, 'test' FROM (SELECT image_id, file_name, row_number() OVER (ORDER BY image_id) AS k FROM made WHERE image_id%3=0) q WHERE k<=100 AND file_name NOT LIKE '%schemat%'
UNION ALL SELECT image_id, CASE WHEN k<=floor(n*0.8e0) THEN 'train' ELSE 'test' END FROM (SELECT image_id, row_number() OVER (ORDER BY md5(concat('2:', CAST(image_id AS VARCHAR))), image_id) AS k, count(*) OVER () AS n FROM fx_images WHERE file_name LIKE 'scan%') q""")
def _(t):
    im = t("fx_images")
    scan = F.col("file_name").startswith("scan")
    # a third of the made images is the test part of the base set
    made, kept = im.where(~scan), F.col("image_id") % 3 == 0
    sample = D.first_n(made.where(~kept).withColumn("o", D.shuffled("image_id", 1)), [F.col("o"), F.col("image_id")], 100).select("image_id", F.lit("train").alias("split"))
    tested = D.synthetic_test_part(made.where(kept), [F.col("image_id")], 100).select("image_id", F.lit("test").alias("split"))
    real = D.split_by_ratio(im.where(scan).select("image_id"), "image_id", 2, [("train", 0.8)], "test")
    return sample.unionByName(tested).unionByName(real)


@query("renumbered_names_u08", """SELECT old_id, CASE WHEN old_id BETWEEN 51 AND 100 THEN concat('schematic_', lpad(CAST(old_id%500+200 AS VARCHAR), 3, '0'), '.png') ELSE file_name END AS file_name FROM fx_file_images""")
def _(t):
    return t("fx_file_images").select("old_id", D.renamed(F.col("old_id"), F.col("file_name"), 51, 100, 200).alias("file_name"))


@query("ci_routing_u10", "SELECT image_id, CASE WHEN row_number() OVER (ORDER BY image_id)<=18 THEN 'ci' ELSE 'local' END AS target FROM fx_images")
def _(t):
    im = t("fx_images").select("image_id")
    first = D.first_n(im, [F.col("image_id")], 18).withColumn("ci", F.lit(True))
    return im.join(first, "image_id", "left").select("image_id", F.when(F.col("ci"), "ci").otherwise("local").alias("target"))


@query("class_list_s11", "SELECT concat('  ', CAST(row_number() OVER (ORDER BY category_id)-1 AS VARCHAR), ': ', name) AS line FROM fx_categories WHERE category_id IN (SELECT category_id FROM fx_annotations)")
def _(t):
    used = t("fx_categories").join(t("fx_annotations"), "category_id", "left_semi")
    return used.join(L.class_index(used), "category_id").select(F.format_string("  %d: %s", "class_idx", "name").alias("line"))


@query("label_files_s05", """SELECT stem, n_lines, first_line FROM (SELECT i.file_name, replace(i.file_name, '.png', '') AS stem, count(*) AS n_lines, min(l.line) AS first_line FROM fx_labels l JOIN fx_images i ON i.image_id=l.image_id WHERE len(string_split(l.line,' '))>=3 GROUP BY 1,2) q""")
def _(t):
    lines = t("fx_labels").where(F.size(L.parts(F.col("line"))) >= 3).join(t("fx_images"), "image_id")
    stem = F.regexp_replace("file_name", r"\.[^.]+$", "")
    return lines.groupBy(stem.alias("stem")).agg(F.count(F.lit(1)).alias("n_lines"), F.min("line").alias("first_line"))


def _results(t):
    """Labelling results built from annotations: rectangles, point rectangles, polygons and other types."""
    x, y, w, h = (F.col(c) / 10.0 for c in "xywh")
    name = F.element_at(F.array(*[F.lit(c) for c in ("resistor", "capacitor", "inductor", "diode", "gizmo")]), F.col("category_id").cast("int"))
    k = F.col("ann_id") % 4
    pts = F.array(F.array(x, y), F.array(x + w, y), F.array(x + w, y + h))
    kind = F.when(k == 2, "polygonlabels").when(k == 3, "textarea").otherwise("rectanglelabels")
    none = lambda ty: F.lit(None).cast(ty)
    value = F.struct(
        F.when(k != 2, x).alias("x"), F.when(k != 2, y).alias("y"), F.when(k != 2, w).alias("width"), F.when(k != 2, h).alias("height"),
        F.when(k == 0, F.col("rotation").cast("double")).alias("rotation"), F.when(k.isin(1, 2), pts).alias("points"),
        F.when(k < 2, F.array(name)).alias("rectanglelabels"), F.when(k == 2, F.array(name)).alias("polygonlabels"), none("array<string>").alias("brushlabels"),
        none("array<string>").alias("labels"), none("array<string>").alias("choices"), F.when(k == 3, F.lit("note")).alias("text"))
    meta = F.struct(F.when(F.col("ann_id") % 3 == 0, F.array(F.concat(F.lit("designator=R"), F.col("ann_id").cast("string")), F.lit("value=4.7k"))).alias("text"))
    r = F.struct(kind.alias("type"), F.lit("label").alias("from_name"), none("string").alias("annotationType"), value.alias("value"), meta.alias("meta"))
    return t("fx_annotations").join(t("fx_images"), "image_id").select("ann_id", "image_id", "width", "height", r.alias("r"))


_NAME = "CASE category_id WHEN 1 THEN 'resistor' WHEN 2 THEN 'capacitor' WHEN 3 THEN 'inductor' WHEN 4 THEN 'diode' ELSE 'gizmo' END"
_RES = """q AS (SELECT a.ann_id, a.image_id, a.category_id, a.ann_id%4 AS k, a.rotation, a.x*i.width/1000 AS x, a.y*i.height/1000 AS y, a.w*i.width/1000 AS w, a.h*i.height/1000 AS h FROM fx_annotations a JOIN fx_images i ON i.image_id=a.image_id),
c AS (SELECT *, abs(w/2*cos(radians(rotation)))+abs(h/2*sin(radians(rotation))) AS hw, abs(w/2*sin(radians(rotation)))+abs(h/2*cos(radians(rotation))) AS hh FROM q WHERE k<3),
b AS (SELECT *, CASE WHEN k=0 THEN x+w/2-hw ELSE x END AS bx, CASE WHEN k=0 THEN y+h/2-hh ELSE y END AS by_, CASE WHEN k=0 THEN 2*hw ELSE w END AS bw, CASE WHEN k=0 THEN 2*hh ELSE h END AS bh FROM c)"""


@query("task_components_p35", f"""SELECT ann_id, CASE WHEN ann_id%3=0 THEN concat('R', CAST(ann_id AS VARCHAR)) WHEN ann_id%4<2 THEN {_NAME} ELSE 'label' END AS label, CASE WHEN ann_id%4=3 THEN 'note' WHEN ann_id%3=0 THEN '4.7k' END AS value, CASE WHEN ann_id%4<>2 THEN x/10 END AS bx FROM fx_annotations""")
def _(t):
    from tracewright.sources import tasks

    c = tasks.component(F.col("r"))
    return _results(t).select("ann_id", c["label"].alias("label"), c["value"].alias("value"), F.get(c["bbox"], F.lit(0)).alias("bx"))


@query("task_polygons_p36", f"""WITH {_RES} SELECT ann_id, CASE WHEN category_id<5 THEN category_id END AS category_id, CASE k WHEN 0 THEN 'rotated_rectangle' WHEN 1 THEN 'rectangle_as_polygon' ELSE 'polygon' END AS method, category_id=5 AS skipped,
round(bx,4) AS bx, round(by_,4) AS by_, round(bw,4) AS bw, round(bh,4) AS bh, round(bw*bh,3) AS area FROM b""")
def _(t):
    from tracewright.sources import tasks

    p = tasks.polygons(_results(t), {"resistor": 1, "capacitor": 2, "inductor": 3, "diode": 4})
    at = lambda i, n: F.round(F.get("bbox", F.lit(i)), 4).alias(n)
    return p.select("ann_id", F.col("category_id").cast("bigint").alias("category_id"), "method", "skipped", at(0, "bx"), at(1, "by_"), at(2, "bw"), at(3, "bh"), F.round("area", 3).alias("area"))


@query("task_ignore_regions_p37", f"""WITH {_RES} SELECT ann_id, image_id, CASE WHEN k=2 THEN 3 ELSE 4 END AS n_points FROM q WHERE category_id=5 AND k<3""")
def _(t):
    from tracewright.sources import tasks

    g = tasks.ignore_regions(_results(t), ["gizmo"])
    return g.select("ann_id", "image_id", F.floor(F.size("points") / 2).cast("int").alias("n_points"))


@query("task_for_image_j25", """WITH tk AS (SELECT p_partkey AS ord, concat(CASE p_partkey%3 WHEN 0 THEN 'up/ab12f-' WHEN 1 THEN '/data/local/' ELSE 'x' END, 'scan_', CAST(p_partkey%90 AS VARCHAR), '.png', CASE WHEN p_partkey%7=0 THEN '?d=1' ELSE '' END) AS ref FROM part),
hit AS (SELECT f.file_name, min(tk.ord) AS ord FROM (SELECT DISTINCT file_name FROM fx_images) f JOIN tk ON contains(tk.ref, f.file_name) GROUP BY 1) SELECT i.image_id, i.file_name AS image, hit.ord FROM fx_images i LEFT JOIN hit ON hit.file_name=i.file_name""")
def _(t):
    from tracewright.sources import tasks

    k = F.col("p_partkey")
    name = F.concat(F.lit("scan_"), (k % 90).cast("string"), F.lit(".png"))
    lead = F.when(k % 3 == 0, "up/ab12f-").when(k % 3 == 1, "/data/local/").otherwise("x")
    ref = F.concat(lead, name, F.when(k % 7 == 0, "?d=1").otherwise(""))
    tk = t("part").select(k.alias("ord"), F.when(k % 2 == 0, ref).alias("file_upload"), F.when(k % 2 == 1, ref).alias("image_ref"))
    return tasks.task_for_image(t("fx_images").select("image_id", F.col("file_name").alias("image")), tk)


@query("generated_labels_p34", """SELECT ann_id, cls, round(greatest(0,least(1,x1/w0)),6) AS x1, round(greatest(0,least(1,y1/h0)),6) AS y1 FROM (SELECT a.ann_id, a.category_id-1 AS cls, i.width AS w0, i.height AS h0,
a.x-a.w/2*cos(radians(a.rotation))+a.h/2*sin(radians(a.rotation)) AS x1, a.y-a.w/2*sin(radians(a.rotation))-a.h/2*cos(radians(a.rotation)) AS y1 FROM fx_annotations a JOIN fx_images i ON i.image_id=a.image_id WHERE a.category_id<5) q""")
def _(t):
    from tracewright.operators.datasets import generated_labels

    letter = F.element_at(F.array(*[F.lit(c) for c in "RCLDZ"]), F.col("category_id").cast("int"))
    c = t("fx_annotations").join(t("fx_images"), "image_id").withColumn("type", letter)
    g = generated_labels(c, {"R": 0, "C": 1, "L": 2, "D": 3})
    return g.select("ann_id", F.col("class_idx").cast("bigint").alias("cls"), F.round(F.get("coords", F.lit(0)), 6).alias("x1"), F.round(F.get("coords", F.lit(1)), 6).alias("y1"))
