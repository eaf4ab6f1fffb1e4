"""Annotation quality and validation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewright.functions import geometry as G
from tracewright.functions import labels as L
from tracewright.functions import metadata as M
from tracewright.operators import datasets as D
from tracewright.operators import quality as Q
from tracewright.operators import scale
from tracewright.plans.registry import query


def _r(c, name, digits=6):
    return F.round(c, digits).alias(name)


_STAT = "count(value) AS n, coalesce(avg(value),0) AS mean, coalesce(stddev_pop(value),0) AS std, coalesce(min(value),0) AS min, coalesce(max(value),0) AS max, coalesce(quantile_cont(value,0.25),0) AS q25, coalesce(quantile_cont(value,0.5),0) AS median, coalesce(quantile_cont(value,0.75),0) AS q75"
_LONG = """m AS (SELECT category_id, 'area' AS measure, CAST(w*h AS DOUBLE) AS value FROM fx_annotations UNION ALL SELECT category_id, 'aspect_ratio', w/h FROM fx_annotations
UNION ALL SELECT category_id, 'width', CAST(w AS DOUBLE) FROM fx_annotations UNION ALL SELECT category_id, 'height', CAST(h AS DOUBLE) FROM fx_annotations)"""


@query("category_statistics_a01", f"""WITH {_LONG}, g AS (SELECT category_id, name, measure FROM fx_categories, (VALUES ('area'),('aspect_ratio'),('width'),('height')) v(measure)),
s AS (SELECT g.category_id, g.name, g.measure, {_STAT} FROM g LEFT JOIN m ON m.category_id=g.category_id AND m.measure=g.measure GROUP BY 1,2,3)
SELECT category_id, name, measure, n, round(mean,4) AS mean, round(std,4) AS std, round(min,6) AS min, round(max,6) AS max, round(q25,6) AS q25, round(median,6) AS median, round(q75,6) AS q75, round(n*100.0e0/(SELECT count(*) FROM fx_annotations),6) AS percent FROM s""")
def _(t):
    s = Q.category_statistics(t("fx_annotations"), t("fx_categories"))
    return s.select("category_id", "name", "measure", "n", _r("mean", "mean", 4), _r("std", "std", 4),
                    *[_r(c, c) for c in ("min", "max", "q25", "median", "q75", "percent")])


@query("coverage_grid_a02", """WITH c AS (SELECT CAST(least(greatest(trunc((y+h/2)/CAST(600 AS DOUBLE)*10),0),9) AS INTEGER) AS gy, CAST(least(greatest(trunc((x+w/2)/CAST(800 AS DOUBLE)*10),0),9) AS INTEGER) AS gx FROM fx_annotations),
g AS (SELECT CAST(a AS INTEGER) AS gy, CAST(b AS INTEGER) AS gx FROM range(0,10) p(a), range(0,10) q(b))
SELECT g.gy, g.gx, count(c.gx) AS n FROM g LEFT JOIN c ON c.gy=g.gy AND c.gx=g.gx GROUP BY 1,2""")
def _(t):
    first = t("fx_images").agg(F.min_by(F.struct("width", "height"), "image_id").alias("s")).first()["s"]
    return Q.coverage_grid(t("fx_annotations"), F.lit(first["width"]), F.lit(first["height"]), 10, 10)


@query("metadata_coverage_a03", """WITH c AS (SELECT category, region_comment IS NOT NULL AND region_comment<>'' AS has, regexp_extract(concat(' ', region_comment),' designator=(\\S+)',1)<>'' AS d, regexp_extract(concat(' ', region_comment),' value=(\\S+)',1)<>'' AS v FROM fx_comments)
SELECT category, count(*) AS regions, count(*) FILTER (has) AS with_metadata, count(*) FILTER (has AND d) AS with_designator, count(*) FILTER (has AND v) AS with_value FROM c GROUP BY ROLLUP (category)""")
def _(t):
    return Q.metadata_coverage(t("fx_comments"))


@query("designators_a04_t02", """WITH d AS (SELECT DISTINCT regexp_extract(concat(' ', region_comment),' designator=(\\S+)',1) AS d FROM fx_comments WHERE region_comment IS NOT NULL)
SELECT 'total' AS kind, CAST(count(*) AS VARCHAR) AS item FROM d WHERE d<>'' UNION ALL SELECT 'first', d FROM (SELECT d FROM d WHERE d<>'' ORDER BY d LIMIT 20) q""")
def _(t):
    d = t("fx_comments").select(M.entry(M.comment_map(F.col("region_comment")), "designator").alias("item")).where("item IS NOT NULL").distinct()
    total = d.agg(F.count(F.lit(1)).cast("string").alias("item")).select(F.lit("total").alias("kind"), "item")
    return total.unionByName(d.orderBy("item").limit(20).select(F.lit("first").alias("kind"), "item"))


@query("missing_designators_t02", """SELECT region_id, category FROM fx_comments WHERE region_comment IS NULL OR regexp_extract(concat(' ', region_comment),' designator=(\\S+)',1)='' ORDER BY region_id LIMIT 50""")
def _(t):
    d = M.entry(M.comment_map(F.col("region_comment")), "designator")
    return t("fx_comments").where(d.isNull()).orderBy("region_id").limit(50).select("region_id", "category")


@query("image_summary_a05_j01", """WITH n AS (SELECT a.image_id, c.name, count(*) AS n FROM fx_annotations a JOIN fx_categories c ON c.category_id=a.category_id GROUP BY 1,2),
d AS (SELECT image_id, sum(n) AS total, string_agg(concat(name,'=',CAST(n AS VARCHAR)),'; ' ORDER BY name) AS detail FROM n GROUP BY 1)
SELECT i.image_id, i.file_name, i.width, i.height, CAST(coalesce(d.total,0) AS BIGINT) AS total, coalesce(d.detail,'') AS detail FROM fx_images i LEFT JOIN d ON d.image_id=i.image_id""")
def _(t):
    return Q.image_summary(t("fx_images"), t("fx_annotations"), t("fx_categories"))


def _split(t):
    return D.split_by_ratio(t("fx_images").select("image_id"), "image_id", 42, [("train", 0.7), ("val", 0.2)], "test")


_SPLIT = """s AS (SELECT image_id, CASE WHEN k<=floor(n*0.7e0) THEN 'train' WHEN k<=floor(n*0.7e0)+floor(n*0.2e0) THEN 'val' ELSE 'test' END AS split FROM (
SELECT image_id, row_number() OVER (ORDER BY md5(concat('42:', CAST(image_id AS VARCHAR))), image_id) AS k, count(*) OVER () AS n FROM fx_images) q)"""


@query("split_class_counts_a06", f"""WITH {_SPLIT} SELECT s.split, c.name, count(*) AS n, count(DISTINCT a.image_id) AS images FROM fx_annotations a JOIN s ON s.image_id=a.image_id JOIN fx_categories c ON c.category_id=a.category_id GROUP BY CUBE (s.split, c.name)""")
def _(t):
    a = t("fx_annotations").join(_split(t), "image_id").join(t("fx_categories"), "category_id")
    # images are counted from distinct (split, class, image) rows, so no set is kept per group
    per = a.groupBy("split", "name", "image_id").agg(F.count(F.lit(1)).alias("n"))
    return per.cube("split", "name").agg(F.sum("n").alias("n"), F.count_distinct("image_id").alias("images"))


@query("missing_classes_u05_a06", f"""WITH {_SPLIT}, p AS (SELECT DISTINCT s.split, c.name FROM fx_annotations a JOIN s ON s.image_id=a.image_id JOIN fx_categories c ON c.category_id=a.category_id)
SELECT x.split, c.name FROM (SELECT DISTINCT split FROM p) x CROSS JOIN fx_categories c EXCEPT SELECT split, name FROM p""")
def _(t):
    a = t("fx_annotations").join(_split(t), "image_id").join(t("fx_categories"), "category_id").select("split", "name").distinct()
    return Q.missing_pairs(a, "split", t("fx_categories"), "name")


@query("area_outliers_w01", """WITH a AS (SELECT *, CAST(w*h AS DOUBLE) AS area FROM fx_annotations), s AS (SELECT category_id, avg(area) AS m, stddev_pop(area) AS d, count(*) AS n FROM a GROUP BY 1)
SELECT ann_id, image_id, a.category_id, area, round(abs((area-m)/d),6) AS z_score FROM a JOIN s ON s.category_id=a.category_id WHERE n>=2 AND d>0 AND abs((area-m)/d)>2.0""")
def _(t):
    return Q.area_outliers(t("fx_annotations"), 2.0).select("ann_id", "image_id", "category_id", "area", _r("z_score", "z_score"))


@query("top_outliers_t02", """WITH a AS (SELECT *, CAST(w*h AS DOUBLE) AS area FROM fx_annotations), s AS (SELECT category_id, avg(area) AS m, stddev_pop(area) AS d, count(*) AS n FROM a GROUP BY 1)
SELECT ann_id, round(abs((area-m)/d),6) AS z_score FROM a JOIN s ON s.category_id=a.category_id WHERE n>=2 AND d>0 AND abs((area-m)/d)>1.5 ORDER BY round(abs((area-m)/d),6) DESC, ann_id LIMIT 5""")
def _(t):
    return Q.area_outliers(t("fx_annotations"), 1.5).select("ann_id", _r("z_score", "z_score")).orderBy(F.desc("z_score"), "ann_id").limit(5)


_COMMENTS = "c AS (SELECT region_id, region_comment FROM fx_comments UNION ALL SELECT region_id+1000000000, region_comment FROM fx_edge_comments)"
_FIELD = "regexp_extract(concat(' ', region_comment, ' '), '.* {0}=(\\S*) ', 1)"


def _comments(t):
    e = t("fx_edge_comments").withColumn("region_id", F.col("region_id") + 1000000000)
    return t("fx_comments").select("region_id", "region_comment").unionByName(e)


@query("comment_fields_p12", f"""WITH {_COMMENTS}, f AS (SELECT region_id, unnest(string_split(trim(region_comment),' ')) AS p, generate_subscripts(string_split(trim(region_comment),' '),1) AS i FROM c),
k AS (SELECT region_id, i, split_part(p,'=',1) AS key, substr(p, instr(p,'=')+1) AS value FROM f WHERE instr(p,'=')>0)
SELECT region_id, key, value FROM (SELECT *, row_number() OVER (PARTITION BY region_id, key ORDER BY i DESC) AS r FROM k) q WHERE r=1""")
def _(t):
    return _comments(t).select("region_id", F.explode(M.comment_map(F.col("region_comment"))).alias("key", "value"))


@query("decimal_commas_p13", f"""WITH {_COMMENTS} SELECT region_id, regexp_replace(region_comment, '([0-9]),([0-9])', '\\1.\\2', 'g') AS fixed, regexp_replace(region_comment, '([0-9]),([0-9])', '\\1.\\2', 'g')<>region_comment AS changed FROM c WHERE region_comment IS NOT NULL""")
def _(t):
    f = M.without_decimal_commas(F.col("region_comment"))
    return _comments(t).where("region_comment IS NOT NULL").select("region_id", f.alias("fixed"), (~f.eqNullSafe(F.col("region_comment"))).alias("changed"))


_RULES = [
    ("region_comment IS NULL", "warning", "metadata", "empty"),
    ("kind<>'' AND kind NOT IN ('resistor','capacitor','inductor','diode','broken_line','edge_connector')", "warning", "type", "unknown_type"),
    ("kind IN ('resistor','capacitor','inductor','diode') AND des=''", "error", "designator", "missing_field"),
    ("kind='edge_connector' AND edge=''", "error", "edge_id", "missing_field"),
    ("kind='edge_connector' AND page=''", "error", "page", "missing_field"),
    ("kind='broken_line' AND sev=''", "error", "severity", "missing_field"),
    ("regexp_matches(val,'[0-9]+,[0-9]+')", "error", "value", "decimal_comma"),
    ("val<>'' AND NOT regexp_matches(val,'[0-9]+,[0-9]+') AND lower(val)<>'unknown' AND NOT regexp_full_match(lower(val),'[0-9]+[.]?[0-9]*([pnumkg]|pf|nf|uf|mf|ph|nh|uh|mh|ohm)?')", "warning", "value", "value_format"),
    ("kind='capacitor' AND pol=''", "warning", "polarity", "missing_polarity"),
    ("kind='resistor' AND pow<>'' AND pow<>'unknown' AND NOT regexp_full_match(lower(pow),'[0-9]+[.]?[0-9]*w')", "warning", "power", "power_format"),
    ("kind='broken_line' AND length(rea) BETWEEN 1 AND 5", "warning", "reason", "short_reason"),
    ("kind='broken_line' AND sev<>'' AND lower(sev) NOT IN ('minor','major','critical')", "error", "severity", "invalid_severity"),
    ("kind='broken_line' AND lower(sev) IN ('minor','major','critical') AND sev<>lower(sev)", "warning", "severity", "severity_case"),
    ("kind='edge_connector' AND edge<>'' AND NOT regexp_full_match(edge,'[ABCD][0-9][0-9]')", "error", "edge_id", "edge_id_format"),
    ("kind='edge_connector' AND page<>'' AND NOT regexp_full_match(page,'[0-9]{1,3}')", "error", "page", "page_format"),
    ("kind='edge_connector' AND length(note) BETWEEN 1 AND 3", "warning", "note", "short_note"),
]
_PARSED = "p AS (SELECT region_id, region_comment, " + ", ".join(
    f"{_FIELD.format(k)} AS {n}" for k, n in (("type", "kind"), ("designator", "des"), ("value", "val"), ("polarity", "pol"), ("power", "pow"), ("reason", "rea"), ("severity", "sev"), ("edge_id", "edge"), ("page", "page"), ("note", "note"))) + " FROM c)"
_ISSUES = f"{_COMMENTS}, {_PARSED}, issues AS (" + " UNION ALL ".join(
    f"SELECT region_id, '{s}' AS severity, '{f}' AS field, '{c}' AS code FROM p WHERE {w}" for w, s, f, c in _RULES) + ")"


@query("metadata_issues_v03", f"WITH {_ISSUES} SELECT region_id, severity, field, code FROM issues")
def _(t):
    rules = M.metadata_issues(M.comment_map(F.col("region_comment")))
    return Q.issue_rows(_comments(t), ["region_id"], rules)


@query("issue_totals_a24", f"WITH {_ISSUES} SELECT CAST(floor(region_id/100) AS BIGINT) AS file_id, severity, count(*) AS n FROM issues GROUP BY ROLLUP (CAST(floor(region_id/100) AS BIGINT), severity)")
def _(t):
    found = Q.issue_rows(_comments(t), ["region_id"], M.metadata_issues(M.comment_map(F.col("region_comment"))))
    return Q.issue_totals(found.withColumn("file_id", F.floor(F.col("region_id") / 100)), "file_id")


@query("coco_issues_v01", """SELECT a.pos, a.file_idx, 'unknown_image' AS code FROM fx_file_annotations a WHERE NOT EXISTS (SELECT 1 FROM fx_file_images i WHERE i.file_idx=a.file_idx AND i.old_id=a.image_id)
UNION ALL SELECT a.pos, a.file_idx, 'unknown_category' FROM fx_file_annotations a JOIN fx_file_images i ON i.file_idx=a.file_idx AND i.old_id=a.image_id WHERE a.category_id NOT IN (SELECT old_id FROM fx_file_categories)
UNION ALL SELECT a.pos, a.file_idx, 'invalid_box' FROM fx_file_annotations a JOIN fx_file_images i ON i.file_idx=a.file_idx AND i.old_id=a.image_id WHERE a.x+a.w>750 OR a.y+a.h>520""")
def _(t):
    from tracewright.operators.validation import coco_issues

    size = t("fx_file_images").withColumns({"width": F.lit(750), "height": F.lit(520)})
    return coco_issues(t("fx_file_annotations"), size, t("fx_file_categories")).select("pos", "file_idx", "code")


@query("category_name_conflicts_v01", """WITH k AS (SELECT file_idx, pos AS id, name FROM fx_file_categories), f AS (SELECT id, name AS first_name FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY file_idx) AS r FROM k) q WHERE r=1)
SELECT k.file_idx, k.id, k.name, f.first_name FROM k JOIN f ON f.id=k.id WHERE k.name<>f.first_name AND k.id IN (SELECT 1+event_id%5 FROM events)""")
def _(t):
    from tracewright.operators.validation import name_conflicts

    # only ids that annotations use
    used = t("fx_annotations").select(F.col("category_id").alias("id")).distinct()
    k = t("fx_file_categories").select("file_idx", F.col("pos").alias("id"), "name").join(used, "id", "left_semi")
    return name_conflicts(k)


@query("merged_ids_v02", """SELECT 'image' AS kind, image_id AS id, count(*) AS n FROM fx_annotations GROUP BY 2 HAVING count(*)>1 UNION ALL SELECT 'prediction', pred_id, count(*) FROM fx_predictions GROUP BY 2 HAVING count(*)>1""")
def _(t):
    a = Q.duplicated(t("fx_annotations"), ["image_id"]).select(F.lit("image").alias("kind"), F.col("image_id").alias("id"), "n")
    return a.unionByName(Q.duplicated(t("fx_predictions"), ["pred_id"]).select(F.lit("prediction").alias("kind"), F.col("pred_id").alias("id"), "n"))


@query("polygon_issues_v04", """WITH a AS (SELECT a.*, i.width-150 AS width, i.height-100 AS height, ann_id%6 AS f FROM fx_annotations a JOIN fx_images i ON i.image_id=a.image_id)
SELECT ann_id, 'missing' AS code FROM a WHERE f=0 UNION ALL SELECT ann_id, 'few_points' FROM a WHERE f=1 UNION ALL SELECT ann_id, 'zero_area' FROM a WHERE f=2 UNION ALL SELECT ann_id, 'zero_area_box' FROM a WHERE f=2
UNION ALL SELECT ann_id, 'odd_length' FROM a WHERE f=3 UNION ALL SELECT ann_id, 'out_of_bounds' FROM a WHERE f IN (3,4,5) AND (x+w>width OR y+h>height) UNION ALL SELECT ann_id, 'out_of_bounds' FROM a WHERE f=2 AND (x>width OR y>height)""")
def _(t):
    X, Y, W, H = G.box()
    f = F.col("ann_id") % 6
    rect = F.array(X, Y, X + W, Y, X + W, Y + H, X, Y + H)
    seg = (F.when(f == 1, F.slice(rect, 1, 4)).when(f == 2, F.array(X, Y, X, Y, X, Y))
           .when(f == 3, F.slice(rect, 1, 7)).when(f > 3, rect))
    a = t("fx_annotations").join(t("fx_images"), "image_id").withColumns({
        "width": F.col("width") - 150, "height": F.col("height") - 100, "seg": seg.cast("array<double>"), "h": F.when(f == 2, 0).otherwise(H)})
    return Q.issue_rows(a, ["ann_id"], Q.polygon_issues(a)).select("ann_id", "code")


@query("connector_issues_v05", """SELECT connector_id, 'edge_id' AS field FROM fx_connectors WHERE NOT regexp_full_match(edge_id,'[ABCD][0-9][0-9]') UNION ALL SELECT connector_id, 'page' FROM fx_connectors WHERE NOT regexp_full_match(page,'[0-9]{1,3}')
UNION ALL SELECT connector_id, 'geometry' FROM fx_connectors WHERE connector_id%7=0 OR connector_id%5=0""")
def _(t):
    from tracewright.operators.validation import connector_issues

    kind = F.when(F.col("connector_id") % 7 == 0, "circle").otherwise("rect")
    pts = F.when(F.col("connector_id") % 5 == 0, F.array(F.array(F.lit(1), F.lit(2)))).otherwise(
        F.array(F.array(F.lit(1), F.lit(2)), F.array(F.lit(3), F.lit(4))))
    c = t("fx_connectors").withColumn("geometry", F.struct(kind.alias("type"), pts.alias("points")))
    return Q.issue_rows(c, ["connector_id"], connector_issues()).select("connector_id", "field").distinct()


@query("sectors_a25_p20", """WITH s AS (SELECT regexp_extract(upper(comment),'\\b([A-C][1-3])\\b',1) AS sector FROM fx_notes), g AS (SELECT concat(c, CAST(r AS VARCHAR)) AS sector FROM (VALUES ('A'),('B'),('C')) a(c), (VALUES (1),(2),(3)) b(r))
SELECT g.sector, count(s.sector) AS n FROM g LEFT JOIN s ON s.sector=g.sector GROUP BY 1""")
def _(t):
    found = t("fx_notes").select(L.sector(F.col("comment")).alias("sector")).where("sector IS NOT NULL")
    n = found.groupBy("sector").agg(F.count(F.lit(1)).alias("n"))
    names = t.spark.createDataFrame([(c + r,) for r in "123" for c in "ABC"], "sector string")
    return names.join(n, "sector", "left").na.fill(0, ["n"])


@query("dataset_totals_a20", """SELECT i.file_idx, count(DISTINCT i.old_id) AS images, count(a.pos) AS annotations FROM fx_file_images i LEFT JOIN fx_file_annotations a ON a.file_idx=i.file_idx AND a.image_id=i.old_id GROUP BY ROLLUP (i.file_idx)""")
def _(t):
    n = t("fx_file_annotations").groupBy("file_idx", F.col("image_id").alias("old_id")).agg(F.count(F.lit(1)).alias("n"))
    im = t("fx_file_images").join(n, ["file_idx", "old_id"], "left").na.fill(0, ["n"])
    return im.rollup("file_idx").agg(F.count(F.lit(1)).alias("images"), F.sum("n").alias("annotations"))


@query("class_id_check_a21", """SELECT max(CAST(split_part(line,' ',1) AS BIGINT)) AS max_class, count(*) AS n_labels, (SELECT count(*) FROM fx_categories) AS n_classes, max(CAST(split_part(line,' ',1) AS BIGINT)) < (SELECT count(*) FROM fx_categories) AS ok FROM fx_labels WHERE len(string_split(line,' '))>=3""")
def _(t):
    n = t("fx_categories").count()
    lab = t("fx_labels").where(F.size(L.parts(F.col("line"))) >= 3)
    top = F.max(L.line_class(F.col("line")))
    return lab.agg(top.alias("max_class"), F.count(F.lit(1)).alias("n_labels"), F.lit(n).cast("bigint").alias("n_classes"), (top < n).alias("ok"))


@query("duplicate_content_a18", """SELECT doc_id, sha256(text) AS hash, count(*) OVER (PARTITION BY sha256(text)) AS copies FROM documents QUALIFY count(*) OVER (PARTITION BY sha256(text)) > 1""")
def _(t):
    from tracewright.operators.validation import content_copies

    return content_copies(t("documents"), "doc_id", F.col("text")).select("doc_id", "hash", "copies")
