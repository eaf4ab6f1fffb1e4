"""Scans and sinks: each query writes a table below the shared folder and reads it back through the library."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewright.operators import scale
from tracewright.operators.validation import fixture_issues
from tracewright.plans.registry import query
from tracewright.session import scratch
from tracewright.sources import coco, entries, labels, tables, tasks


@query("annotation_documents_s01_s02", """SELECT a.ann_id, i.file_name, c.name, CAST(a.x AS DOUBLE) AS x, CAST(a.w*a.h AS DOUBLE) AS area, i.width
FROM fx_annotations a JOIN fx_images i ON i.image_id=a.image_id JOIN fx_categories c ON c.category_id=a.category_id""")
def _(t):
    """Three documents of images, categories and annotations, cut into ranges and joined again by their ids."""
    box = F.array(*[F.col(c).cast("double") for c in "xywh"])
    path = scratch(t.spark, "documents")
    coco.write_documents({
        "images": t("fx_images").select(F.col("image_id").alias("id"), "file_name", "width", "height"),
        "categories": t("fx_categories").select(F.col("category_id").alias("id"), "name"),
        "annotations": t("fx_annotations").select(F.col("ann_id").alias("id"), "image_id", "category_id", box.alias("bbox"), (F.col("w") * F.col("h")).cast("double").alias("area"))}, path, shards=3)
    got = coco.read(t.spark, f"{path}/*.txt")
    images = got["images"].select(F.col("id").alias("image_id"), "file_name", F.col("width").cast("bigint").alias("width"))
    names = got["categories"].select(F.col("id").alias("category_id"), "name").distinct()  # every document has them
    a = got["annotations"].select(F.col("id").alias("ann_id"), "image_id", "category_id", F.get("bbox", F.lit(0)).alias("x"), "area")
    return a.join(images, "image_id").join(names, "category_id").select("ann_id", "file_name", "name", "x", "area", "width")


@query("task_export_s03", """SELECT task_id, row_number() OVER (PARTITION BY task_id ORDER BY region_id)-1 AS idx, concat('p', CAST(task_id AS VARCHAR), '.PNG') AS image,
CASE WHEN region_comment LIKE 'designator=%' THEN regexp_extract(region_comment, 'designator=([^ ]*)', 1) ELSE category END AS label FROM fx_comments""")
def _(t):
    """One export of tasks; names of pictures stand under an odd key, every second task keeps its results as `response`."""
    words = F.when(F.col("region_comment").isNotNull(), F.array("region_comment"))
    result = F.struct(F.lit("rectanglelabels").alias("type"), F.struct(F.array("category").alias("rectanglelabels")).alias("value"), F.struct(words.alias("text")).alias("meta"))
    per = t("fx_comments").groupBy("task_id").agg(F.array_sort(F.collect_list(F.struct("region_id", result.alias("r")))).alias("x"))  # 25 regions a task
    results = F.transform("x", lambda e: e["r"])
    odd = F.col("task_id") % 2 == 1
    groups = F.array(F.struct(F.lit(None).alias("result"), F.lit(None).alias("response")), F.struct(F.when(~odd, results).alias("result"), F.when(odd, results).alias("response")))
    data = F.create_map(F.lit("note"), F.lit("none"), F.lit("scan"), F.format_string("/upload/a/p%d.PNG", "task_id"))
    path = scratch(t.spark, "export")
    coco.write_documents({"tasks": per.select(F.col("task_id").alias("id"), data.alias("data"), groups.alias("annotations"))}, path, shards=1)
    rows = tasks.first_results(tasks.read(t.spark, f"{path}/*.txt"))
    return rows.select(F.col("id").alias("task_id"), F.col("idx").cast("bigint").alias("idx"), tasks.image_name().alias("image"), tasks.component(F.col("r"))["label"].alias("label"))


@query("label_folders_s04_s05", """SELECT concat('img_', CAST(image_id AS VARCHAR)) AS stem, count(*) AS n, CAST(sum(CAST(string_split(line,' ')[1] AS BIGINT)) AS BIGINT) AS classes, round(sum(CAST(string_split(line,' ')[2] AS DOUBLE)),6) AS first_x
FROM fx_labels WHERE len(string_split(line,' '))>=3 GROUP BY 1""")
def _(t):
    path = scratch(t.spark, "labels")
    lines = t("fx_labels").select(F.when(F.col("image_id") % 5 == 0, "val").otherwise("train").alias("split"), F.format_string("img_%d", "image_id").alias("stem"), F.col("line_id").alias("line_no"), "line")
    labels.write(lines, path)
    got = labels.read(t.spark, f"{path}/split=*")
    return got.groupBy("stem").agg(F.count(F.lit(1)).alias("n"), F.sum("class_id").cast("bigint").alias("classes"), F.round(F.sum(F.get("coords", F.lit(0))), 6).alias("first_x"))


@query("class_list_file_s11", "SELECT concat('  ', CAST(row_number() OVER (ORDER BY category_id)-1 AS VARCHAR), ': ', name) AS line FROM fx_categories WHERE category_id IN (SELECT category_id FROM fx_annotations)")
def _(t):
    path = scratch(t.spark, "names")
    labels.write_class_list(t("fx_categories").join(t("fx_annotations"), "category_id", "left_semi"), path)
    return t.spark.read.text(path).select(F.col("value").alias("line"))


@query("training_log_s06", "SELECT epoch, time_s, map50 FROM fx_epochs WHERE run=3")
def _(t):
    path = scratch(t.spark, "log")
    none = [F.lit(None).cast("double").alias(c) for c in ("train/box_loss", "train/seg_loss", "val/box_loss", "val/seg_loss")]
    log = t("fx_epochs").where("run = 3").select("epoch", F.col("time_s").alias("time"), *none, F.col("map50").alias("metrics/mAP50(B)"), F.lit(None).cast("double").alias("metrics/mAP50(M)"))
    tables.write_report(log, path, "csv")
    return tables.read_epochs(t.spark, path).select(F.col("epoch").cast("bigint").alias("epoch"), F.col("time").alias("time_s"), F.col("metrics/mAP50(B)").alias("map50"))


@query("correction_files_s07", "SELECT CAST(request_id AS VARCHAR) AS request_id, component, value FROM fx_corrections")
def _(t):
    path = scratch(t.spark, "corrections")
    entry = F.collect_list(F.struct("component", "value")).alias("corrections")  # four lines a request
    t("fx_corrections").groupBy(F.col("request_id").cast("string").alias("request_id")).agg(entry).write.json(path)
    return tables.read_corrections(t.spark, path, "*.json", lines=True)


@query("appended_corrections_s14", """WITH b AS (SELECT request_id, component, value, line%2=0 AND request_id%3=0 AS second FROM fx_corrections), w AS (SELECT *, bool_or(second) OVER (PARTITION BY request_id) AS twice FROM b)
SELECT CAST(request_id AS VARCHAR) AS request_id, component, value FROM w WHERE NOT twice OR second""")
def _(t):
    path = scratch(t.spark, "appended")
    c = t("fx_corrections").withColumn("request_id", F.col("request_id").cast("string"))
    tables.append_corrections(c, path)
    tables.append_corrections(c.where("line % 2 = 0 AND CAST(request_id AS BIGINT) % 3 = 0"), path)
    return tables.read_appended(t.spark, path)


@query("benchmark_files_s08", """WITH m AS (SELECT run, epoch%3 AS k, max(time_s) AS time_sec, count(*) AS epochs FROM fx_epochs GROUP BY 1,2)
SELECT CASE run%4 WHEN 0 THEN '1-ep-benchmark' WHEN 1 THEN 'poc' WHEN 2 THEN 'inference' ELSE 'unknown' END AS type, CASE WHEN run%4<2 THEN concat('m', CAST(k AS VARCHAR)) WHEN run%4=2 THEN 'best' END AS model,
CASE WHEN run%4<2 THEN time_sec END AS time_sec, CASE WHEN run%4<2 THEN CAST(epochs AS INTEGER) END AS epochs, CASE WHEN run%4=2 THEN time_sec END AS mean_latency_ms, run FROM m WHERE run%4<2 OR k=0""")
def _(t):
    """Files of four shapes, a document each, normalised to one row type."""
    path = scratch(t.spark, "benchmarks")
    m = t("fx_epochs").groupBy("run", (F.col("epoch") % 3).alias("k")).agg(F.max("time_s").alias("time_sec"), F.count(F.lit(1)).alias("epochs"))
    item = F.struct(F.format_string("m%d", "k").alias("model"), "time_sec", "epochs")
    per = m.groupBy("run").agg(F.collect_list(item).alias("results"), F.max(F.when(F.col("k") == 0, F.col("time_sec"))).alias("first"))  # three items a run
    kind = F.col("run") % 4
    text = F.when(kind == 0, F.to_json(F.struct("results", F.lit("cpu").alias("device")))).when(kind == 1, F.to_json("results")).when(
        kind == 2, F.to_json(F.struct(F.col("first").alias("mean_latency_ms"), F.lit("runs/best.pt").alias("weights"), F.lit("runs/x").alias("run_dir")))).otherwise(F.lit('{"a": 1}'))
    per.select("run", text.alias("value")).repartition("run").write.partitionBy("run").text(path)
    got = tables.read_benchmarks(t.spark, path, "*.txt")
    run = F.regexp_extract("source_file", "run=([0-9]+)", 1).cast("bigint").alias("run")
    return got.select("type", "model", "time_sec", "epochs", "mean_latency_ms", run)


@query("entry_store_s09", """SELECT CAST(entry_id AS VARCHAR) AS id, entry_type AS type, filename FROM (SELECT *, row_number() OVER (PARTITION BY entry_id ORDER BY seq DESC) AS r FROM fx_entries) q WHERE r=1 AND NOT is_delete""")
def _(t):
    """Three batches, the newest first, into buckets small enough to part."""
    path = scratch(t.spark, "entries")
    none = F.lit(None).cast("string")
    changes = t("fx_entries").select(F.col("entry_id").cast("string").alias("id"), F.col("entry_type").alias("type"), none.alias("label"), "filename", none.alias("payload"), "is_delete", "seq")
    third = changes.agg(F.floor(F.max("seq") / 3)).first()[0] or 0
    for part in (F.col("seq") > 2 * third, (F.col("seq") > third) & (F.col("seq") <= 2 * third), F.col("seq") <= third):
        entries.merge_entries(changes.where(part), path, 100)
    return entries.read_entries(t.spark, path).select("id", "type", "filename")


@query("manifest_s10", """SELECT concat(CAST(sheet_id AS VARCHAR), '.png') AS filename, node_id, CASE WHEN n%2=0 THEN 'dot' END AS label, CAST(count(*) AS BIGINT) AS written FROM (SELECT *, 1 AS k FROM fx_nodes UNION ALL SELECT *, 2 FROM fx_nodes WHERE n<3) q GROUP BY 1,2,3""")
def _(t):
    path = scratch(t.spark, "manifest")
    text = lambda c: F.col(c).cast("string")
    rows = t("fx_nodes").select(
        "n", F.format_string("%d.png", "sheet_id").alias("filename"), F.when(F.col("n") % 2 == 0, "dot").alias("label"), "node_id", F.lit("2").alias("degree"),
        text("y").alias("position_row"), text("x").alias("position_col"), F.lit("t").alias("timestamp"))
    tables.append_manifest(rows, path)
    tables.append_manifest(rows.where("n < 3"), path)
    return tables.read_manifest(t.spark, path).groupBy("filename", "node_id", "label").agg(F.count(F.lit(1)).alias("written"))


@query("report_files_s13", """SELECT category_id, count(*) AS n, CAST(sum(w*h) AS BIGINT) AS area, kind FROM fx_annotations, (VALUES ('csv'),('json')) AS k(kind) GROUP BY category_id, kind""")
def _(t):
    counts = t("fx_annotations").groupBy("category_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("w") * F.col("h")).cast("bigint").alias("area"))
    path, kind = scratch(t.spark, "reports"), "category_id bigint, n bigint, area bigint"
    tables.write_report(counts, f"{path}/csv", "csv")
    tables.write_report(counts, f"{path}/json", "json")
    csv = t.spark.read.schema(kind).option("header", True).csv(f"{path}/csv").withColumn("kind", F.lit("csv"))
    return csv.unionByName(t.spark.read.schema(kind).json(f"{path}/json").withColumn("kind", F.lit("json")))


@query("file_inventory_s12", """SELECT split, CAST(sum(octet_length(encode(concat(stem, chr(9), line)))+1) AS BIGINT) AS bytes FROM (SELECT CASE WHEN image_id%5=0 THEN 'val' ELSE 'train' END AS split, concat('img_', CAST(image_id AS VARCHAR)) AS stem, line FROM fx_labels) q GROUP BY 1""")
def _(t):
    """Sizes of written files, read from the list of files alone."""
    path = scratch(t.spark, "inventory")
    labels.write(t("fx_labels").select(F.when(F.col("image_id") % 5 == 0, "val").otherwise("train").alias("split"), F.format_string("img_%d", "image_id").alias("stem"), F.col("line_id").alias("line_no"), "line"), path)
    files = tables.list_files(t.spark, path, "*.txt")
    return files.groupBy(F.regexp_extract("path", "split=([a-z]+)", 1).alias("split")).agg(F.sum("length").alias("bytes"))


_FIXTURE = "SELECT doc_id, concat('f', CAST(doc_id AS VARCHAR), CASE WHEN doc_id%10=0 THEN '.txt' WHEN doc_id%10<5 THEN '.PNG' ELSE '.pdf' END) AS name, n_chars AS length, md5(text) AS hash FROM documents"


@query("fixture_rules_v07", f"""WITH f AS ({_FIXTURE}), d AS (SELECT hash, count(*) AS copies FROM f GROUP BY 1), r AS (SELECT f.*, d.copies FROM f JOIN d ON d.hash=f.hash)
SELECT name, 'warning' AS severity, 'name' AS field, 'extension' AS code FROM r WHERE name LIKE '%.txt' UNION ALL SELECT name, 'warning', 'length', 'too_large' FROM r WHERE length>5000
UNION ALL SELECT name, 'warning', 'annotation', 'missing_annotation' FROM r WHERE doc_id%3=0 UNION ALL SELECT name, 'error', 'annotation', 'missing_keys' FROM r WHERE doc_id%3<>0 AND doc_id%7=0
UNION ALL SELECT name, 'warning', 'hash', 'duplicate' FROM r WHERE copies>1""")
def _(t):
    k = F.col("doc_id")
    end = F.when(k % 10 == 0, ".txt").when(k % 10 < 5, ".PNG").otherwise(".pdf")
    files = t("documents").select(F.concat(F.lit("f"), k.cast("string"), end).alias("name"), F.col("n_chars").alias("length"), F.md5("text").alias("hash"))
    notes = t("documents").where(k % 3 != 0).select(F.concat(F.lit("f"), k.cast("string")).alias("stem"), F.lit(True).alias("has_image"), (k % 7 != 0).alias("has_annotations"))
    return fixture_issues(files, notes, 5000)


@query("ordered_selection_g00", "SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events) q WHERE k%2=1")
def _(t):
    """Events of a user in order, each taken unless the one before it is."""
    order = [F.col("event_id")]
    ranked = scale.ranked(t("events").select("user_id", "event_id"), ["user_id"], order, "k")
    ahead = ranked.withColumn("k", F.col("k") + 1).withColumnRenamed("event_id", "earlier")
    pairs = ahead.join(ranked.withColumnRenamed("event_id", "later"), ["user_id", "k"]).select("earlier", "later")
    return scale.greedy_independent(ranked.select("event_id"), pairs, "event_id")
