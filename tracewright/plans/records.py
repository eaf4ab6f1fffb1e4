"""Operational queries: stores, sessions, logs, sweeps, lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewright.functions import regions as R
from tracewright.functions import text as T
from tracewright.operators import records as O
from tracewright.operators import scale
from tracewright.plans.registry import query


def _r(c, name, digits=6):
    return F.round(c, digits).alias(name)


@query("entry_upsert_u06", """WITH base AS (SELECT c_custkey AS entry_id, 'page' AS entry_type, concat('c', CAST(c_custkey AS VARCHAR), '.json') AS filename FROM customer),
l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entry_id ORDER BY seq DESC) AS r FROM fx_entries) q WHERE r=1)
SELECT coalesce(b.entry_id,l.entry_id) AS entry_id, coalesce(l.entry_type,b.entry_type) AS entry_type, coalesce(l.filename,b.filename) AS filename FROM base b FULL JOIN l ON l.entry_id=b.entry_id WHERE NOT coalesce(l.is_delete,false)""")
def _(t):
    base = t("customer").select(F.col("c_custkey").alias("entry_id"), F.lit("page").alias("entry_type"),
                                F.format_string("c%d.json", "c_custkey").alias("filename"))
    return O.upsert(base, t("fx_entries"), "entry_id", "seq", "is_delete")


@query("clear_by_type_u06", "SELECT seq, entry_type FROM fx_entries WHERE entry_type NOT IN ('click','error')")
def _(t):
    return O.without_types(t("fx_entries"), ["click", "error"]).select("seq", "entry_type")


@query("latest_version_w08", "SELECT entry_id, seq, entry_type FROM (SELECT *, row_number() OVER (PARTITION BY entry_id ORDER BY seq DESC) AS r FROM fx_entries) q WHERE r=1")
def _(t):
    return O.latest(t("fx_entries"), "entry_id", "seq").select("entry_id", "seq", "entry_type")


@query("last_messages_w09", "SELECT conv_id, turn, role, md5(text) AS text_hash FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) q WHERE r<=4")
def _(t):
    return O.last_messages(t("conversations"), "conv_id", "turn", 4).select("conv_id", "turn", "role", F.md5("text").alias("text_hash"))


@query("history_filter_f05", "SELECT seq FROM (SELECT seq, CASE entry_type WHEN 'click' THEN 'crop' WHEN 'view' THEN 'netlist' ELSE 'page' END AS k FROM fx_entries) q WHERE k IN ('crop')")
def _(t):
    kind = F.when(F.col("entry_type") == "click", "crop").when(F.col("entry_type") == "view", "netlist").otherwise("page")
    return t("fx_entries").where(O.of_scope(kind, "image-processing", ["crop", " netlist "])).select("seq")


@query("newest_entries_f06", "SELECT seq, entry_type FROM fx_entries WHERE entry_type='error' ORDER BY updated_at DESC, seq DESC LIMIT 50")
def _(t):
    return t("fx_entries").where("entry_type = 'error'").orderBy(F.desc("updated_at"), F.desc("seq")).limit(50).select("seq", "entry_type")


@query("epoch_progress_w10_p30", """SELECT run, epoch, time_s-coalesce(lag(time_s) OVER (PARTITION BY run ORDER BY epoch),0) AS delta, CASE WHEN epoch>0 AND time_s>0 THEN CAST(floor(greatest(300-epoch,0)*(time_s/epoch)) AS BIGINT) END AS eta_s FROM fx_epochs""")
def _(t):
    return O.epoch_progress(t("fx_epochs"), 300).select("run", "epoch", "delta", "eta_s")


@query("last_epochs_t06", "SELECT run, epoch, map50 FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY epoch DESC) AS r FROM fx_epochs) q WHERE r<=3")
def _(t):
    return scale.top_n(t("fx_epochs"), ["run"], [F.desc("epoch")], 3).select("run", "epoch", "map50")


@query("sweep_totals_a12", """SELECT angle, overlap_pct, count(*) AS total, count(*) FILTER (timeout) AS timeouts, count(*) FILTER (returncode<>0) AS nonzero, round(avg(elapsed_s),3) AS avg_elapsed, count(pixel_delta) AS delta_counted, round(coalesce(avg(pixel_delta),0),3) AS avg_delta FROM fx_sweep GROUP BY 1,2""")
def _(t):
    return t("fx_sweep").groupBy("angle", "overlap_pct").agg(*O.sweep_totals())


@query("mode_totals_a28", """SELECT max_joins, count(*) AS total, count(*) FILTER (timeout) AS timeouts, round(avg(CASE WHEN NOT timeout THEN elapsed_s END),6) AS avg_elapsed, count(*) FILTER (NOT timeout AND returncode<>0) AS nonzero FROM fx_sweep GROUP BY 1""")
def _(t):
    return t("fx_sweep").groupBy("max_joins").agg(*O.mode_totals())


@query("sweep_progress_a26", """SELECT max_joins, count(DISTINCT image) AS done, round(count(DISTINCT image)*100.0e0/(SELECT count(*) FROM customer),2) AS percent FROM fx_sweep GROUP BY 1""")
def _(t):
    expected = t("customer").count()
    # distinct pairs first: no task keeps a set of images for a whole mode
    done = t("fx_sweep").select("max_joins", "image").distinct().groupBy("max_joins").agg(F.count(F.lit(1)).alias("done"))
    return done.withColumn("percent", F.round(F.col("done") * 100.0 / expected, 2))


@query("config_pivot_a29", """SELECT angle, overlap_pct, image, min(elapsed_s) FILTER (max_joins=10) AS no_repair, min(elapsed_s) FILTER (max_joins=50) AS with_repair FROM fx_sweep GROUP BY 1,2,3""")
def _(t):
    s = t("fx_sweep").withColumn("config", F.when(F.col("max_joins") == 10, "no_repair").otherwise("with_repair"))
    return s.groupBy("angle", "overlap_pct", "image").pivot("config", ["no_repair", "with_repair"]).agg(F.min("elapsed_s"))


@query("config_summary_a29", """SELECT angle, overlap_pct, max_joins, count(*) AS cases, round(avg(elapsed_s),6) AS avg_elapsed, CAST(sum(pixel_delta) AS BIGINT) AS delta_sum FROM fx_sweep GROUP BY 1,2,3""")
def _(t):
    return t("fx_sweep").groupBy("angle", "overlap_pct", "max_joins").agg(
        F.count(F.lit(1)).alias("cases"), _r(F.avg("elapsed_s"), "avg_elapsed"), F.sum("pixel_delta").cast("bigint").alias("delta_sum"))


@query("latency_summary_a13", """SELECT event_type, count(value) AS n, round(avg(value),6) AS mean, round(stddev_pop(value),4) AS std, round(quantile_cont(value,0.5),6) AS median, round(1000/avg(value),4) AS fps FROM events GROUP BY 1""")
def _(t):
    s = O.latency_summary(t("events"), ["event_type"], "value")
    return s.select("event_type", "n", _r("mean", "mean"), _r("std", "std", 4), _r("median", "median"), _r("fps", "fps", 4))


@query("fastest_slowest_a14", """SELECT angle, arg_min(task_id, elapsed_s*1000000000+task_id) AS fastest, arg_min(task_id, -elapsed_s*1000000000+task_id) AS slowest, round(max(1000/elapsed_s),6) AS best_fps FROM fx_sweep GROUP BY 1""")
def _(t):
    return t("fx_sweep").groupBy("angle").agg(
        F.min_by("task_id", F.struct("elapsed_s", "task_id")).alias("fastest"),
        F.min_by("task_id", F.struct(-F.col("elapsed_s"), F.col("task_id"))).alias("slowest"),
        _r(F.max(1000 / F.col("elapsed_s")), "best_fps"))


@query("readiness_a17", """WITH p AS (SELECT request_id AS session_id, count(*) AS n, count(*) FILTER (component<>'') AS l, count(*) FILTER (value<>' ') AS v, request_id%3<>0 AS netlist FROM fx_corrections GROUP BY 1),
c AS (SELECT session_id, n>0 AS symbols, netlist, CAST(floor(l*100/n) AS BIGINT) AS labels_pct, CAST(floor(v*100/n) AS BIGINT) AS values_pct FROM p)
SELECT session_id, symbols, netlist, labels_pct, values_pct, concat_ws(',', CASE WHEN NOT symbols THEN 'symbols' END, CASE WHEN NOT netlist THEN 'netlist' END, CASE WHEN labels_pct<80 THEN 'component_labels' END, CASE WHEN values_pct<80 THEN 'component_values' END) AS missing,
symbols AND netlist AND (labels_pct>=80 OR values_pct>=80) AS ready FROM c""")
def _(t):
    c = t("fx_corrections").select(F.col("request_id").alias("session_id"), F.col("component").alias("label"), F.trim("value").alias("value"))
    s = c.select("session_id").distinct().withColumn("netlist", F.col("session_id") % 3 != 0)
    return O.readiness(c, s)


@query("roi_counters_a22", """SELECT image_id, count(*) AS total, count(*) FILTER (u) AS roi_used, count(*) FILTER (NOT u) AS roi_missing FROM (SELECT image_id, x-100<least(300,greatest(0,x-100)+w)
AND least(300,greatest(0,x-100)+w)>greatest(0,x-100) AND least(200,y+h)>y AS u FROM fx_annotations) q GROUP BY 1""")
def _(t):
    a = t("fx_annotations").withColumn("roi", R.clip_roi(F.col("x") - 100, F.col("y"), F.col("w"), F.col("h"), F.lit(300), F.lit(200)))
    used = F.col("roi").isNotNull()
    return a.groupBy("image_id").agg(F.count(F.lit(1)).alias("total"), F.count_if(used).alias("roi_used"), F.count_if(~used).alias("roi_missing"))


@query("extreme_segments_a23", """WITH s AS (SELECT sheet_id, seg, segment_id, CASE WHEN length<20 THEN NULL ELSE length/100 END AS score FROM fx_segments),
e AS (SELECT sheet_id, first(segment_id) FILTER (rw=1) AS w, first(score) FILTER (rw=1) AS ws, first(segment_id) FILTER (rb=1) AS b FROM (SELECT *, row_number() OVER (PARTITION BY sheet_id ORDER BY coalesce(score,1), seg) AS rw,
row_number() OVER (PARTITION BY sheet_id ORDER BY coalesce(score,-1) DESC, seg) AS rb FROM s) q GROUP BY 1)
SELECT s.sheet_id, s.segment_id, s.score, s.segment_id=e.w AS is_worst, s.segment_id=e.b AS is_best, CASE WHEN e.ws IS NULL THEN s.segment_id=e.w ELSE coalesce(abs(s.score-e.ws)<1e-9,false) END AS tied_worst FROM s JOIN e ON e.sheet_id=s.sheet_id""")
def _(t):
    s = t("fx_segments").select("sheet_id", F.col("seg").alias("ord"), "segment_id", F.when(F.col("length") >= 20, F.col("length") / 100).alias("score"))
    return O.extreme_segments(s, "sheet_id")


_ATT = """att AS (SELECT n.sheet_id, c.connector_id, c.page, c.edge_id FROM (SELECT DISTINCT sheet_id, concat('lines-', CAST(sheet_id%200 AS VARCHAR)) AS h FROM fx_nodes) n JOIN fx_connectors c ON lower(trim(c.history_id))=n.h)"""


def _owners(t):
    return t("fx_nodes").select(F.col("sheet_id").alias("owner_id"), F.concat(F.lit("LINES-"), (F.col("sheet_id") % 200).cast("string"), F.lit(" ")).alias("history_id"))


@query("connector_attach_j11_u09", f"WITH {_ATT} SELECT sheet_id, connector_id, page, edge_id FROM att")
def _(t):
    return O.attach_connectors(_owners(t), t("fx_connectors")).select(F.col("owner_id").alias("sheet_id"), "connector_id", "page", "edge_id")


@query("connector_summary_j11", f"WITH {_ATT} SELECT sheet_id, count(*) AS n, count(DISTINCT page) AS pages, count(DISTINCT edge_id) AS edges FROM att GROUP BY 1")
def _(t):
    return O.connector_summary(_owners(t), t("fx_connectors")).withColumnRenamed("owner_id", "sheet_id")


@query("symbol_attach_j12", """WITH s AS (SELECT entry_id, arg_max(entry_type, seq) AS payload FROM fx_entries GROUP BY 1) SELECT c.c_custkey AS owner_id, coalesce(CASE WHEN c.c_custkey%4=0 THEN c.c_mktsegment END, s.payload) AS payload FROM customer c LEFT JOIN s ON s.entry_id=c.c_custkey""")
def _(t):
    own = t("customer").select(F.col("c_custkey").alias("entry_id"), F.when(F.col("c_custkey") % 4 == 0, F.col("c_mktsegment")).alias("inline"))
    stored = O.latest(t("fx_entries"), "entry_id", "seq").select("entry_id", F.col("entry_type").alias("payload"))
    return O.attach_or_inline(own, stored, "entry_id", "inline", "payload").select(F.col("entry_id").alias("owner_id"), "payload")


@query("best_scoring_entry_j13", """WITH e AS (SELECT connector_id, lower(trim(history_id)) AS history, lower(net_name) AS kind, CAST(connector_id%50 AS VARCHAR) AS source, edge_id AS filename, page AS url, connector_id*7919%1000 AS upd FROM fx_connectors),
l AS (SELECT s_suppkey AS lookup_id, CASE WHEN s_suppkey%4=0 THEN NULL ELSE concat('lines-', CAST(s_suppkey%300 AS VARCHAR)) END AS history, CASE s_suppkey%3 WHEN 0 THEN 'building' WHEN 1 THEN 'machinery' ELSE NULL END AS kind, CAST(s_suppkey%70 AS VARCHAR) AS source, concat('B', CASE WHEN s_suppkey%90<10 THEN '0' ELSE '' END, CAST(s_suppkey%90 AS VARCHAR)) AS filename, CAST(s_suppkey AS VARCHAR) AS url FROM supplier),
p AS (SELECT l.lookup_id, e.connector_id, e.upd, 5*CAST(coalesce(l.history=e.history,false) AS INTEGER)+2*CAST(coalesce(l.kind=e.kind,false) AS INTEGER)+2*CAST(coalesce(l.source=e.source,false) AS INTEGER)+CAST(coalesce(l.filename=e.filename,false) AS INTEGER)+CAST(coalesce(l.url=e.url,false) AS INTEGER) AS score FROM l CROSS JOIN e)
SELECT lookup_id, connector_id AS entry_id, score FROM (SELECT *, row_number() OVER (PARTITION BY lookup_id ORDER BY score DESC, upd DESC, connector_id) AS r FROM p WHERE score>0) q WHERE r=1""")
def _(t):
    e = t("fx_connectors").select(
        F.col("connector_id").alias("entry_id"), F.col("connector_id").alias("ord"), (F.col("connector_id") * 7919 % 1000).alias("updated_at"),
        F.lower(F.trim("history_id")).alias("history"), F.col("net_name").alias("kind"), (F.col("connector_id") % 50).cast("string").alias("source"),
        F.col("edge_id").alias("filename"), F.col("page").alias("url"))
    k = F.col("s_suppkey")
    lk = t("supplier").select(
        k.alias("lookup_id"), F.when(k % 4 != 0, F.concat(F.lit("lines-"), (k % 300).cast("string"))).alias("history"),
        F.when(k % 3 == 0, "Building").when(k % 3 == 1, "machinery").alias("kind"), (k % 70).cast("string").alias("source"),
        F.concat(F.lit("B"), F.when(k % 90 < 10, "0").otherwise(""), (k % 90).cast("string")).alias("filename"), k.cast("string").alias("url"))
    return O.best_scoring(lk, e)


@query("name_resolution_j14", """WITH f AS (SELECT DISTINCT file_name AS name FROM fx_images), r AS (SELECT p_partkey AS ref_id, CASE p_partkey%4 WHEN 0 THEN concat('scan_', CAST(p_partkey%700 AS VARCHAR), '.png') WHEN 1 THEN concat('ab12-scan_', CAST(p_partkey%700 AS VARCHAR), '.png') WHEN 2 THEN concat('x-', CAST(p_partkey%900 AS VARCHAR), '.png') ELSE concat('_', CAST(p_partkey%900 AS VARCHAR), '.png') END AS b FROM part),
r2 AS (SELECT *, CASE WHEN instr(b,'-')>0 THEN substr(b, instr(b,'-')+1) END AS s FROM r),
m AS (SELECT r2.ref_id, count(*) AS n, min(f.name) AS u FROM r2 JOIN f ON ends_with(f.name, coalesce(r2.s, r2.b)) GROUP BY 1)
SELECT r2.ref_id, coalesce(e.name, c.name, CASE WHEN m.n=1 THEN m.u END) AS file, CASE WHEN e.name IS NOT NULL THEN 'exact' WHEN c.name IS NOT NULL THEN 'after_dash' WHEN m.n=1 THEN 'suffix' END AS how
FROM r2 LEFT JOIN f e ON e.name=r2.b LEFT JOIN f c ON c.name=r2.s LEFT JOIN m ON m.ref_id=r2.ref_id""")
def _(t):
    k = F.col("p_partkey")
    name = lambda n: F.concat((k % n).cast("string"), F.lit(".png"))
    ref = (F.when(k % 4 == 0, F.concat(F.lit("scan_"), name(700))).when(k % 4 == 1, F.concat(F.lit("ab12-scan_"), name(700)))
           .when(k % 4 == 2, F.concat(F.lit("x-"), name(900))).otherwise(F.concat(F.lit("_"), name(900))))
    refs = t("part").select(k.alias("ref_id"), F.concat(F.lit("data/up/"), ref).alias("ref"))
    return O.resolve_names(refs, t("fx_images").select(F.col("file_name").alias("name"))).select("ref_id", "file", "how")


@query("open_tasks_j15", """WITH g AS (SELECT c_custkey AS image, a AS angle, o AS overlap_pct, m AS max_joins FROM customer, (VALUES (15),(30)) x(a), (VALUES (40),(60)) y(o), (VALUES (10),(50)) z(m)) SELECT * FROM g EXCEPT SELECT image, angle, overlap_pct, max_joins FROM fx_sweep""")
def _(t):
    g = O.grid_tasks(t("customer").select(F.col("c_custkey").alias("image")), {"angle": [15, 30], "overlap_pct": [40, 60], "max_joins": [10, 50]})
    return g.join(t("fx_sweep"), ["image", "angle", "overlap_pct", "max_joins"], "left_anti")


@query("manifest_sync_j16", """WITH m AS (SELECT file_name AS filename, CASE image_id%3 WHEN 0 THEN 'dot' ELSE 'cross' END AS label FROM fx_images), d AS (SELECT concat('scan_', CAST(doc_id AS VARCHAR), '.png') AS filename, CASE doc_id%2 WHEN 0 THEN 'dot' ELSE 'cross' END AS label FROM documents)
SELECT coalesce(m.filename,d.filename) AS filename, coalesce(d.label,m.label) AS label, CASE WHEN m.label IS NULL THEN 'added' WHEN d.label<>m.label THEN 'relabelled' ELSE 'kept' END AS change FROM m FULL JOIN d ON d.filename=m.filename""")
def _(t):
    m = t("fx_images").select(F.col("file_name").alias("filename"), F.when(F.col("image_id") % 3 == 0, "dot").otherwise("cross").alias("label"))
    d = t("documents").select(F.format_string("scan_%d.png", "doc_id").alias("filename"), F.when(F.col("doc_id") % 2 == 0, "dot").otherwise("cross").alias("label"))
    return O.sync_manifest(m, d)


@query("correction_merge_j17", """WITH c AS (SELECT CAST(floor(p_partkey/10) AS BIGINT) AS session_id, p_partkey%10 AS ref, p_brand AS label, p_type AS value FROM part),
n AS (SELECT CAST(floor(s/10) AS BIGINT) AS session_id, s%10 AS ref, s%2=0 AS has_label, s%3<>0 AS has_value, CASE WHEN s%5=0 THEN NULL ELSE concat('L', CAST(s AS VARCHAR)) END AS label, concat('V', CAST(s AS VARCHAR)) AS value FROM (SELECT DISTINCT c_custkey*3 AS s FROM customer) q)
SELECT coalesce(c.session_id,n.session_id) AS session_id, coalesce(c.ref,n.ref) AS ref, CASE WHEN n.has_label THEN n.label ELSE c.label END AS label, CASE WHEN n.has_value THEN n.value ELSE c.value END AS value FROM c FULL JOIN n ON n.session_id=c.session_id AND n.ref=c.ref""")
def _(t):
    k, s = F.col("p_partkey"), F.col("c_custkey") * 3
    c = t("part").select(F.floor(k / 10).alias("session_id"), (k % 10).alias("ref"), F.col("p_brand").alias("label"), F.col("p_type").alias("value"))
    n = t("customer").select(
        F.floor(s / 10).alias("session_id"), (s % 10).alias("ref"), (s % 2 == 0).alias("has_label"), (s % 3 != 0).alias("has_value"),
        F.when(s % 5 != 0, F.concat(F.lit("L"), s.cast("string"))).alias("label"), F.concat(F.lit("V"), s.cast("string")).alias("value"))
    return O.merge_corrections(c, n, ["session_id", "ref"])


@query("correction_counts_a07", """WITH c AS (SELECT trim(component) AS c, trim(value) AS v FROM fx_corrections WHERE trim(component)<>'' OR trim(value)<>'')
SELECT 'component' AS kind, c AS item, count(*) AS n FROM c WHERE c<>'' GROUP BY 2 UNION ALL SELECT 'value', v, count(*) FROM c WHERE v<>'' GROUP BY 2 UNION ALL SELECT 'entries', '', count(*) FROM c""")
def _(t):
    return O.correction_counts(t("fx_corrections"))


@query("unreferenced_files_j22", """SELECT count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS bytes FROM documents WHERE concat('f', CAST(doc_id AS VARCHAR), '.json') NOT IN (SELECT filename FROM fx_entries)""")
def _(t):
    d = t("documents").select(F.format_string("f%d.json", "doc_id").alias("filename"), "n_chars")
    free = d.join(t("fx_entries").select("filename").distinct(), "filename", "left_anti")
    return free.agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("bytes"))


@query("file_totals_a19_s12", "SELECT source, count(*) AS files, CAST(sum(n_chars) AS BIGINT) AS bytes FROM documents GROUP BY 1")
def _(t):
    return t("documents").groupBy("source").agg(F.count(F.lit(1)).alias("files"), F.sum("n_chars").alias("bytes"))


@query("wire_mentions_j24", """WITH m AS (SELECT DISTINCT msg_id, sheet_id, unnest(list_concat(regexp_extract_all(text,'(?i)e+d+g+e\\s*[-_ ]?\\s*([0-9]+)',1), regexp_extract_all(text,'(?i)(?:odcinek|punkt)\\s*(?:nr|numer)?\\s*[-_#: ]?\\s*([0-9]+)',1))) AS n FROM fx_messages)
SELECT m.msg_id, m.sheet_id, concat('edge', m.n) AS wire, s.segment_id FROM m LEFT JOIN fx_segments s ON s.sheet_id=m.sheet_id AND s.segment_id=concat('edge-', m.n)""")
def _(t):
    return O.wire_mentions(t("fx_messages"), t("fx_segments"), "sheet_id").select("msg_id", "sheet_id", "wire", "segment_id")


@query("inspection_set_t03", """WITH l AS (SELECT *, row_number() OVER (PARTITION BY image, max_joins ORDER BY task_id DESC) AS r FROM fx_sweep),
p AS (SELECT image, bool_or(timeout) AS timeout, max(CASE WHEN NOT timeout THEN elapsed_s END) AS elapsed, abs(sum(CASE WHEN max_joins=10 THEN 1 ELSE -1 END*coalesce(pixel_delta+20,0))) AS diff FROM l WHERE r=1 GROUP BY 1)
SELECT image FROM (SELECT image FROM p WHERE timeout UNION SELECT image FROM (SELECT image FROM p WHERE elapsed IS NOT NULL ORDER BY elapsed DESC, image DESC LIMIT 6) a UNION SELECT image FROM (SELECT image FROM p ORDER BY diff DESC, image DESC LIMIT 8) b) q ORDER BY image LIMIT 16""")
def _(t):
    s = t("fx_sweep").withColumns({
        "mode": F.when(F.col("max_joins") == 10, "conservative").otherwise("aggressive"),
        "stdout": F.concat(F.lit("done saved="), (F.col("pixel_delta") + 20).cast("string"), F.lit(" ok"))})
    return O.inspection_set(s)


@query("dated_sections_t04", """WITH s AS (SELECT log_id, CAST(NULL AS VARCHAR) AS day, string_split(text, chr(10))[1] AS head FROM fx_logs UNION ALL SELECT log_id, substr(string_split(text, chr(10))[2],4,10), string_split(text, chr(10))[2] FROM fx_logs
UNION ALL SELECT log_id, substr(string_split(text, chr(10))[4],5,10), string_split(text, chr(10))[4] FROM fx_logs UNION ALL SELECT log_id, '2025-01-01', string_split(text, chr(10))[5] FROM fx_logs)
SELECT log_id, row_number() OVER (PARTITION BY log_id ORDER BY day NULLS FIRST) AS place, day, head FROM s""")
def _(t):
    rows = t("fx_logs").select("log_id", F.posexplode(T.dated_sections(F.col("text"))).alias("place", "s"))
    return rows.select("log_id", (F.col("place") + 1).cast("bigint").alias("place"), F.col("s.day").cast("string").alias("day"), F.substring_index("s.body", "\n", 1).alias("head"))


@query("case_gate_f11", """SELECT task_id, round(iou,6) AS iou, round(red,6) AS reduction FROM (SELECT task_id, elapsed_s/35 AS iou, CASE WHEN pixel_delta+20=0 THEN 0 ELSE 100.0e0*pixel_delta/(pixel_delta+20) END AS red FROM fx_sweep) q WHERE NOT (iou>=0.7 OR coalesce(red>=40, false))""")
def _(t):
    start = F.col("pixel_delta") + 20
    s = t("fx_sweep").withColumns({
        "iou": F.col("elapsed_s") / 35, "reduction": F.when(start == 0, 0.0).otherwise(100.0 * F.col("pixel_delta") / F.when(start != 0, start))})
    # without a delta the overlap alone decides
    return s.where(~((F.col("iou") >= 0.7) | F.coalesce(F.col("reduction") >= 40, F.lit(False)))).select("task_id", _r("iou", "iou"), _r("reduction", "reduction"))


@query("training_samples_f12", """WITH m AS (SELECT p_partkey AS id, CASE p_partkey%5 WHEN 0 THEN ' ' WHEN 1 THEN 'dot' WHEN 2 THEN 'cross' WHEN 3 THEN 'gone' ELSE 'tee' END AS l, concat('n', CAST(p_partkey%900 AS VARCHAR), '.png') AS f FROM part), m2 AS (SELECT id, CASE WHEN trim(l)='' THEN 'unknown' ELSE trim(l) END AS label, f FROM m),
d AS (SELECT CASE doc_id%3 WHEN 0 THEN concat('dot/n', CAST(doc_id AS VARCHAR), '.png') WHEN 1 THEN concat('unknown/n', CAST(doc_id AS VARCHAR), '.png') ELSE concat('n', CAST(doc_id AS VARCHAR), '.png') END AS path FROM documents)
SELECT id, label, CASE WHEN concat(label,'/',f) IN (SELECT path FROM d) THEN concat(label,'/',f) ELSE f END AS path FROM m2 WHERE label IN ('dot','cross','tee','unknown') AND (concat(label,'/',f) IN (SELECT path FROM d) OR f IN (SELECT path FROM d))""")
def _(t):
    k, d = F.col("p_partkey"), F.col("doc_id")
    label = F.element_at(F.array(*[F.lit(x) for x in (" ", "dot", "cross", "gone", "tee")]), (k % 5 + 1).cast("int"))
    m = t("part").select(k.alias("id"), label.alias("label"), F.format_string("n%d.png", k % 900).alias("filename"))
    pre = F.when(d % 3 == 0, "dot/").when(d % 3 == 1, "unknown/").otherwise("")
    files = t("documents").select(F.concat(pre, F.format_string("n%d.png", d)).alias("path"))
    return O.training_samples(m, files, ["dot", "cross", "tee", "unknown"]).select("id", "label", "path")


@query("text_normalisers_p18_p19", """SELECT doc_id, md5(regexp_replace(regexp_replace(lower(text),'[^\\pL\\pN\\s]','','g'),'\\s+',' ','g')) AS words, md5(regexp_replace(lower(text),'[^\\pL\\pN]','','g')) AS alnum FROM documents""")
def _(t):
    x = F.col("text")
    return t("documents").select("doc_id", F.md5(F.regexp_replace(T.words_only(x), r"\s+", " ")).alias("words"), F.md5(T.alnum_only(x)).alias("alnum"))


@query("identifier_squeeze_p19", """SELECT conv_id, turn, md5(regexp_replace(strip_accents(lower(text)),'[ _-]','','g')) AS squeezed FROM conversations""")
def _(t):
    return t("conversations").select("conv_id", "turn", F.md5(T.squeeze(F.col("text"))).alias("squeezed"))


@query("sample_checks_v06", """WITH d AS (SELECT concat('scan_', CAST(doc_id AS VARCHAR), '.png') AS image FROM documents), c AS (SELECT request_id, count(*) AS comps, count(*) FILTER (component<>'') AS designators, count(*) FILTER (trim(value)<>'') AS filled FROM fx_corrections GROUP BY 1)
SELECT c.request_id, comps, designators, filled, d.image IS NULL AS image_missing FROM c LEFT JOIN d ON d.image=concat('scan_', CAST(c.request_id*2 AS VARCHAR), '.png')""")
def _(t):
    from tracewright.operators.validation import sample_checks

    c = t("fx_corrections").withColumn("image", F.format_string("scan_%d.png", F.col("request_id") * 2))
    files = t("documents").select(F.format_string("scan_%d.png", "doc_id").alias("image"))
    return sample_checks(c, files).select("request_id", "comps", "designators", "filled", "image_missing")


@query("history_defaults_p31", """SELECT seq, CASE WHEN entry_id%3=0 THEN concat('entry-', CAST(seq AS VARCHAR)) ELSE CAST(entry_id AS VARCHAR) END AS id, CASE WHEN entry_id%2=0 THEN entry_type ELSE concat('Entry ', entry_type) END AS label FROM fx_entries""")
def _(t):
    e = t("fx_entries").select("seq", F.when(F.col("entry_id") % 3 != 0, F.col("entry_id").cast("string")).alias("id"), F.col("entry_type").alias("type"),
                               F.when(F.col("entry_id") % 2 == 0, F.col("entry_type")).alias("label"))
    return O.with_defaults(e).select("seq", "id", "label")
