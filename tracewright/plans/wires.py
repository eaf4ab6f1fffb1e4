"""Wire-graph queries: nets, degrees, confidence, repair, assembly, decks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewright.functions import values as V
from tracewright.operators import quality as Q
from tracewright.operators import wires as W
from tracewright.plans.registry import query


def _r(c, name, digits=6):
    return F.round(c, digits).alias(name)


_ENDS_OF = "inc AS (SELECT sheet_id, segment_id, a AS n FROM fx_segments UNION ALL SELECT sheet_id, segment_id, b FROM fx_segments{})"
_EDGES_FROM = """{}, per AS (SELECT sheet_id, segment_id, count(*) AS ends, min(n) AS s, max(n) AS t FROM inc GROUP BY 1,2),
edges AS (SELECT sheet_id, segment_id, s AS source, t AS target FROM per WHERE ends=2), simple AS (SELECT DISTINCT sheet_id, source AS a, target AS b FROM edges)"""
_EDGES = _EDGES_FROM.format(_ENDS_OF.format(""))
# in this query only, segments under 8 long have lost their second end
_CUT_EDGES = _EDGES_FROM.format(_ENDS_OF.format(" WHERE length>=8"))
_ADJ = "adj AS (SELECT sheet_id, a AS n, b AS m FROM simple UNION SELECT sheet_id, b, a FROM simple)"
_NETS = f"""{_EDGES}, {_ADJ}, reach AS (SELECT sheet_id, n, n AS m FROM fx_nodes UNION SELECT r.sheet_id, r.n, j.m FROM reach r JOIN adj j ON j.sheet_id=r.sheet_id AND j.n=r.m),
mem AS (SELECT sheet_id, n, min(m) AS root FROM reach GROUP BY 1,2)"""


def _edges(t):
    return W.edges_from_incidence(W.incidence(t("fx_segments"))).where("NOT skipped")


def _nodes(t):
    return t("fx_nodes").select("sheet_id", "n")


@query("edges_g02", f"WITH {_CUT_EDGES} SELECT sheet_id, segment_id, CASE WHEN ends=2 THEN s END AS source, CASE WHEN ends=2 THEN t END AS target, ends<>2 AS skipped FROM per")
def _(t):
    s = t("fx_segments")
    cut = s.select("sheet_id", "segment_id", F.col("a").alias("n")).unionByName(s.where("length >= 8").select("sheet_id", "segment_id", F.col("b").alias("n")))
    return W.edges_from_incidence(cut)


@query("degrees_g03", f"WITH {_EDGES}, {_ADJ}, d AS (SELECT sheet_id, n, CAST(sum(CASE WHEN n=m THEN 2 ELSE 1 END) AS BIGINT) AS degree, count(*) AS neighbours FROM adj GROUP BY 1,2) SELECT f.sheet_id, f.n, coalesce(degree,0) AS degree, coalesce(neighbours,0) AS neighbours FROM fx_nodes f LEFT JOIN d ON d.sheet_id=f.sheet_id AND d.n=f.n")
def _(t):
    return W.degrees(_nodes(t), _edges(t))


@query("adjacency_g03", f"WITH {_EDGES}, {_ADJ} SELECT sheet_id, n, m AS neighbour FROM adj")
def _(t):
    return W.adjacency(_edges(t))


@query("node_class_p24", f"WITH {_ENDS_OF.format('')}, e AS (SELECT sheet_id, n, count(*) AS ends FROM inc GROUP BY 1,2) SELECT f.sheet_id, f.n, CASE WHEN f.n=3 THEN 'kept' WHEN coalesce(ends,0)>=3 THEN 'essential' WHEN ends=2 THEN 'non_essential' WHEN ends=1 THEN 'endpoint' ELSE 'isolated' END AS class FROM fx_nodes f LEFT JOIN e ON e.sheet_id=f.sheet_id AND e.n=f.n")
def _(t):
    e = W.incidence(t("fx_segments")).groupBy("sheet_id", "n").agg(F.count(F.lit(1)).alias("ends"))
    given = F.when(F.col("n") == 3, "kept").otherwise("unspecified")
    return _nodes(t).join(e, ["sheet_id", "n"], "left").select("sheet_id", "n", W.node_class(F.coalesce("ends", F.lit(0)), given).alias("class"))


@query("nets_g01", f"WITH RECURSIVE {_NETS} SELECT sheet_id, n, root FROM mem")
def _(t):
    return W.nets(_nodes(t), _edges(t))


@query("net_labels_w06", f"WITH RECURSIVE {_NETS}, s AS (SELECT sheet_id, root, count(*) AS size FROM mem GROUP BY 1,2) SELECT sheet_id, root, size, concat('NET', lpad(CAST(row_number() OVER (PARTITION BY sheet_id ORDER BY concat('node-', CAST(root AS VARCHAR))) AS VARCHAR), 3, '0')) AS net FROM s")
def _(t):
    return W.net_labels(W.nets(_nodes(t), _edges(t)))


@query("node_labels_w06", "SELECT sheet_id, n, concat('N', lpad(CAST(row_number() OVER (PARTITION BY sheet_id ORDER BY n) AS VARCHAR), 3, '0')) AS label FROM fx_nodes")
def _(t):
    return W.node_labels(_nodes(t))


@query("cycle_rank_g04", f"WITH RECURSIVE {_NETS}, v AS (SELECT sheet_id, count(*) AS nodes, count(*) FILTER (n=root) AS nets FROM mem GROUP BY 1), e AS (SELECT sheet_id, count(*) AS edges FROM simple GROUP BY 1) SELECT v.sheet_id, nodes, nets, coalesce(edges,0) AS edges, coalesce(edges,0)-nodes+nets AS cycles FROM v LEFT JOIN e ON e.sheet_id=v.sheet_id")
def _(t):
    return W.cycle_rank(W.nets(_nodes(t), _edges(t)), _edges(t))


@query("class_counts_a15", f"WITH {_ENDS_OF.format('')}, e AS (SELECT sheet_id, n, count(*) AS ends FROM inc GROUP BY 1,2), c AS (SELECT f.sheet_id, CASE WHEN coalesce(ends,0)>=3 THEN 'essential' WHEN ends=2 THEN 'non_essential' WHEN ends=1 THEN 'endpoint' ELSE 'isolated' END AS class FROM fx_nodes f LEFT JOIN e ON e.sheet_id=f.sheet_id AND e.n=f.n) SELECT sheet_id, class, count(*) AS nodes FROM c GROUP BY 1,2")
def _(t):
    e = W.incidence(t("fx_segments")).groupBy("sheet_id", "n").agg(F.count(F.lit(1)).alias("ends"))
    c = _nodes(t).join(e, ["sheet_id", "n"], "left").withColumn("class", W.node_class(F.coalesce("ends", F.lit(0))))
    return c.groupBy("sheet_id", "class").agg(F.count(F.lit(1)).alias("nodes"))


@query("degree_histogram_a15", f"WITH {_EDGES}, {_ADJ}, d AS (SELECT sheet_id, n, sum(CASE WHEN n=m THEN 2 ELSE 1 END) AS degree FROM adj GROUP BY 1,2), f AS (SELECT f.sheet_id, CAST(coalesce(degree,0) AS BIGINT) AS degree FROM fx_nodes f LEFT JOIN d ON d.sheet_id=f.sheet_id AND d.n=f.n) SELECT sheet_id, degree, count(*) AS nodes FROM f GROUP BY 1,2")
def _(t):
    return W.degrees(_nodes(t), _edges(t)).groupBy("sheet_id", "degree").agg(F.count(F.lit(1)).alias("nodes"))


def _placed(t):
    """Segments with end positions on the node grid."""
    s = t("fx_segments")
    at = lambda c: (60 * (F.col(c) % 4), 60 * F.floor(F.col(c) / 4))
    (sx, sy), (ex, ey) = at("a"), at("b")
    return s.withColumns({"s_x": sx, "s_y": sy, "e_x": ex, "e_y": ey})


_ENDS = "ec AS (SELECT sheet_id, n, count(*) AS ends FROM (SELECT sheet_id, a AS n FROM fx_segments UNION ALL SELECT sheet_id, b FROM fx_segments) q GROUP BY 1,2)"


def _end_counts(t):
    e = W.incidence(t("fx_segments")).groupBy("sheet_id", "n").agg(F.count(F.lit(1)).alias("ends"))
    return t("fx_nodes").join(e, ["sheet_id", "n"]).select("sheet_id", "n", "x", "y", "ends")


@query("segment_ends_j19", "SELECT sheet_id, segment_id, CASE WHEN a<>7 THEN a END AS start_node, CASE WHEN b<>7 THEN b END AS end_node FROM fx_segments")
def _(t):
    # in this query only, node 7 is left out so that some ends have no node
    return W.segment_ends(_placed(t), _end_counts(t).where("n <> 7")).select("sheet_id", "segment_id", F.col("s_n").alias("start_node"), F.col("e_n").alias("end_node"))


_CONF = f"""{_ENDS}, j AS (SELECT s.sheet_id, s.segment_id, s.length, s.length/20 AS q, coalesce(x.ends,0) AS sd, coalesce(y.ends,0) AS ed FROM fx_segments s LEFT JOIN ec x ON x.sheet_id=s.sheet_id AND x.n=s.a LEFT JOIN ec y ON y.sheet_id=s.sheet_id AND y.n=s.b),
sc AS (SELECT sheet_id, segment_id, greatest(0e0,least(1e0, least(1e0,greatest(0e0,q/3)) + CASE WHEN q<1.05e0 THEN -0.3e0 WHEN q<1.45e0 THEN -0.15e0 WHEN q>3.5e0 THEN 0.06e0 WHEN q>2.2e0 THEN 0.03e0 ELSE 0 END
 + CASE WHEN sd>=3 THEN 0.08e0 WHEN sd=2 THEN 0.03e0 ELSE -0.12e0 END + CASE WHEN ed>=3 THEN 0.08e0 WHEN ed=2 THEN 0.03e0 ELSE -0.12e0 END + CASE WHEN sd<=1 AND ed<=1 THEN -0.14e0 WHEN sd>=2 AND ed>=2 AND q>=1.8e0 THEN 0.05e0 ELSE 0 END)) AS score,
 concat_ws(',', CASE WHEN ed>=3 THEN 'end_supported' WHEN ed<=1 THEN 'end_endpoint' END, CASE WHEN sd<=1 AND ed<=1 THEN 'isolated_branch' END, CASE WHEN q>=1.05e0 AND q<1.45e0 THEN 'marginal_length' END, CASE WHEN q<1.05e0 THEN 'short_segment' END,
 CASE WHEN sd>=3 THEN 'start_supported' WHEN sd<=1 THEN 'start_endpoint' END, CASE WHEN NOT (sd<=1 AND ed<=1) AND sd>=2 AND ed>=2 AND q>=1.8e0 THEN 'well_supported' END) AS reasons FROM j)"""


def _scored(t):
    j = W.segment_ends(_placed(t), _end_counts(t))
    score, reasons = W.confidence(F.col("length"), F.col("s_ends"), F.col("e_ends"), 20.0)
    return j.select("sheet_id", "segment_id", score.alias("score"), F.array_join(reasons, ",").alias("reasons"))


@query("segment_confidence_p25", f"WITH {_CONF} SELECT sheet_id, segment_id, round(score,6) AS score, reasons, CASE WHEN round(score,9)>=0.65 THEN 'high' WHEN round(score,9)>=0.45 THEN 'medium' ELSE 'low' END AS label FROM sc")
def _(t):
    return _scored(t).select("sheet_id", "segment_id", _r("score", "score"), "reasons", W.confidence_label(F.round("score", 9)).alias("label"))


@query("confidence_totals_a16", f"WITH {_CONF} SELECT sheet_id, round(avg(score),6) AS average, round(min(score),6) AS lowest, round(max(score),6) AS highest, count(*) FILTER (round(score,9)>=0.65) AS high, count(*) FILTER (round(score,9)<0.45) AS low FROM sc GROUP BY 1")
def _(t):
    label = W.confidence_label(F.round("score", 9))
    return _scored(t).groupBy("sheet_id").agg(
        _r(F.avg("score"), "average"), _r(F.min("score"), "lowest"), _r(F.max("score"), "highest"), F.count_if(label == "high").alias("high"), F.count_if(label == "low").alias("low"))


@query("flagged_segments_f09", f"WITH {_CONF} SELECT sheet_id, segment_id, round(score,6) AS score FROM sc WHERE round(score,9)<0.45 ORDER BY 3")
def _(t):
    s = _scored(t).where(W.confidence_label(F.round("score", 9)) == "low")
    return s.orderBy("score").select("sheet_id", "segment_id", _r("score", "score"))


_METRICS = """m AS (SELECT o_orderkey AS id, CAST(o_custkey%60 AS DOUBLE) AS branch_length, CAST(o_orderkey%400 AS DOUBLE) AS area, 1+CAST(o_custkey%25 AS DOUBLE)/10 AS aspect_ratio, CAST(o_orderkey%50 AS DOUBLE)/100 AS ink_ratio, CAST(30+o_custkey%50 AS DOUBLE)/100 AS fill_ratio,
CAST(o_orderkey%45 AS DOUBLE)/1000 AS skeleton_density, CASE WHEN o_orderkey%9=0 THEN NULL ELSE CAST(o_custkey%40 AS DOUBLE) END AS near, CAST(15+o_orderkey%35 AS DOUBLE)/100 AS here, CAST(10+o_custkey%40 AS DOUBLE)/100 AS there FROM orders)"""


@query("endpoint_reason_p26", f"""WITH {_METRICS} SELECT id, CASE WHEN branch_length>46 OR area<=0 THEN NULL
WHEN branch_length<=46*0.55e0 AND area>=109.35e0 AND fill_ratio>=0.52e0*0.7e0 AND ink_ratio>=0.26e0 AND here>=0.26e0 AND there>=0.26e0 AND abs(here-there)<=0.11e0*0.5e0 AND aspect_ratio<=2.7e0 AND skeleton_density>=0.019e0*1.15e0 AND near<=12*0.9e0*2*1.1e0+(24-12*0.9e0*2)*1.1e0 THEN 'text_pair'
WHEN area>=164.025e0 AND ink_ratio>=0.28e0 AND fill_ratio>=0.56e0 AND aspect_ratio<=2.7e0 AND skeleton_density>=0.019e0 THEN 'dense_blob'
WHEN area>=127.575e0 AND ink_ratio>=0.24e0 AND fill_ratio>=0.52e0 AND near<=10.8e0 AND skeleton_density>=0.019e0 THEN 'cluster'
WHEN area>=109.35e0 AND ink_ratio>=0.26e0 AND aspect_ratio<=2.3e0 AND here>=there+0.11e0 THEN 'density_margin'
WHEN branch_length<=23 AND area>=109.35e0 AND ink_ratio>=0.26e0 AND fill_ratio>=0.52e0*0.65e0 AND greatest(here,there)>=0.24e0+0.08e0 AND aspect_ratio<=2.3e0 AND skeleton_density>=0.019e0*1.6e0 AND near<=24 THEN 'dense_pair' END AS reason FROM m""")
def _(t):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    m = t("orders").select(
        k.alias("id"), (c % 60).cast("double").alias("branch_length"), (k % 400).cast("double").alias("area"), (1 + (c % 25) / 10).alias("aspect_ratio"),
        ((k % 50) / 100).alias("ink_ratio"), ((30 + c % 50) / 100).alias("fill_ratio"), ((k % 45) / 1000).alias("skeleton_density"),
        F.when(k % 9 != 0, (c % 40).cast("double")).alias("nearest_node_distance"), ((15 + k % 35) / 100).alias("local_density"), ((10 + c % 40) / 100).alias("other_density"))
    return m.select("id", W.endpoint_reason(W.endpoint_thresholds(13.5, 4.0), 46.0).alias("reason"))


@query("nearest_node_j20", """SELECT s.sheet_id, s.seg AS id, min(round(sqrt((n.x-60*(s.a%4))*(n.x-60*(s.a%4))+(n.y-60*(s.a//4))*(n.y-60*(s.a//4))),6)) FILTER (n.n<>s.a AND n.n<>s.b) AS nearest FROM fx_segments s JOIN fx_nodes n ON n.sheet_id=s.sheet_id GROUP BY 1,2""")
def _(t):
    p = _placed(t).select("sheet_id", F.col("seg").alias("id"), F.col("s_x").alias("x"), F.col("s_y").alias("y"), F.col("e_x").alias("ox"), F.col("e_y").alias("oy"))
    return W.nearest_other(p, t("fx_nodes"), 64.0).select("sheet_id", "id", _r("nearest", "nearest"))


@query("patch_stats_g14", """WITH p AS (SELECT n.sheet_id, n.n AS id, n.x, n.y FROM fx_nodes n), h AS (SELECT p.sheet_id, p.id, count(*) AS area, max(px)-min(px)+1 AS bw, max(py)-min(py)+1 AS bh FROM p JOIN fx_pixels q ON q.sheet_id=p.sheet_id AND q.px BETWEEN p.x-12 AND p.x+12 AND q.py BETWEEN p.y-12 AND p.y+12 GROUP BY 1,2),
j AS (SELECT p.*, coalesce(area,0) AS area, bw, bh, (least(200,x+13)-greatest(0,x-12))*(least(140,y+13)-greatest(0,y-12)) AS patch FROM p LEFT JOIN h ON h.sheet_id=p.sheet_id AND h.id=p.id)
SELECT sheet_id, id, area, round(area/patch,6) AS ink_ratio, round(CASE WHEN area>0 THEN area/(bw*bh) ELSE 0 END,6) AS fill_ratio, round(CASE WHEN area>0 THEN greatest(bw,bh)/least(bw,bh) ELSE 0 END,6) AS aspect_ratio, round(CASE WHEN area>0 THEN bw*bh/patch ELSE 0 END,6) AS extent_ratio FROM j""")
def _(t):
    p = t("fx_nodes").select("sheet_id", F.col("n").alias("id"), "x", "y")
    s = W.patch_stats(p, t("fx_pixels"), 12, 200, 140)
    return s.select("sheet_id", "id", "area", *[_r(c, c) for c in ("ink_ratio", "fill_ratio", "aspect_ratio", "extent_ratio")])


@query("contour_cover_g15", """SELECT s.sheet_id, s.seg AS id FROM fx_segments s WHERE EXISTS (SELECT 1 FROM fx_pixels q WHERE q.sheet_id=s.sheet_id AND (q.px-60*(s.a%4))*(q.px-60*(s.a%4))+(q.py-60*(s.a//4))*(q.py-60*(s.a//4))<=36)
AND EXISTS (SELECT 1 FROM fx_pixels q WHERE q.sheet_id=s.sheet_id AND (q.px-60*(s.b%4))*(q.px-60*(s.b%4))+(q.py-60*(s.b//4))*(q.py-60*(s.b//4))<=36)""")
def _(t):
    c = _placed(t).withColumnRenamed("seg", "id")
    contour = t("fx_pixels").select("sheet_id", F.col("px").alias("x"), F.col("py").alias("y"))
    return W.covered_by_points(c, contour, 4.0).select("sheet_id", "id")


_LINES = """ln AS (SELECT sheet_id, seg AS id, 60*(a%4) AS s_x, 60*(a//4) AS s_y, 60*(b%4) AS e_x, 60*(b//4) AS e_y, CASE WHEN a=b THEN 0e0 ELSE (degrees(atan2(60*(b//4)-60*(a//4), 60*(b%4)-60*(a%4)))+360)%180 END AS angle_deg FROM fx_segments)"""
_COL = f"""{_LINES}, pr AS (SELECT p.sheet_id, p.id AS a, q.id AS b FROM ln p JOIN ln q ON q.sheet_id=p.sheet_id AND p.id<q.id AND abs(p.angle_deg-q.angle_deg)<=5 AND ((p.s_x=q.s_x AND p.s_y=q.s_y) OR (p.s_x=q.e_x AND p.s_y=q.e_y) OR (p.e_x=q.s_x AND p.e_y=q.s_y) OR (p.e_x=q.e_x AND p.e_y=q.e_y)))"""


def _lines(t):
    p = _placed(t).withColumnRenamed("seg", "id")
    dx, dy = F.col("e_x") - F.col("s_x"), F.col("e_y") - F.col("s_y")
    return p.withColumn("angle_deg", F.pmod(F.degrees(F.atan2(dy, dx)), F.lit(180.0))).select("sheet_id", "id", "s_x", "s_y", "e_x", "e_y", "angle_deg")


@query("colinear_pairs_j21", f"WITH {_COL} SELECT sheet_id, a, b FROM pr")
def _(t):
    return W.colinear_pairs(_lines(t), 5.0, 8.0)


@query("combined_segments_j21", f"""WITH RECURSIVE {_COL}, adj AS (SELECT sheet_id, a, b FROM pr UNION SELECT sheet_id, b, a FROM pr), reach AS (SELECT DISTINCT sheet_id, a AS v, a AS w FROM adj UNION SELECT r.sheet_id, r.v, j.b FROM reach r JOIN adj j ON j.sheet_id=r.sheet_id AND j.a=r.w),
mem AS (SELECT sheet_id, v, min(w) AS root FROM reach GROUP BY 1,2), pts AS (SELECT m.sheet_id, m.root, m.v, l.s_x AS x, l.s_y AS y FROM mem m JOIN ln l ON l.sheet_id=m.sheet_id AND l.id=m.v UNION ALL SELECT m.sheet_id, m.root, m.v, l.e_x, l.e_y FROM mem m JOIN ln l ON l.sheet_id=m.sheet_id AND l.id=m.v),
g AS (SELECT sheet_id, root, count(DISTINCT v) AS n, min(x*1000+y) AS lo, max(x*1000+y) AS hi FROM pts GROUP BY 1,2)
SELECT sheet_id, root, n, lo//1000 AS s_x, lo%1000 AS s_y, hi//1000 AS e_x, hi%1000 AS e_y, round(sqrt((hi//1000-lo//1000)*(hi//1000-lo//1000)+(hi%1000-lo%1000)*(hi%1000-lo%1000)),6) AS length FROM g""")
def _(t):
    lines = _lines(t)
    c = W.combine_colinear(lines, W.colinear_pairs(lines, 5.0, 8.0))
    return c.select("sheet_id", "root", "n", "s_x", "s_y", "e_x", "e_y", _r("length", "length"))


_TURN = "abs(((degrees(atan2({0},{1}))-degrees(atan2({2},{3}))+180)%360+360)%360-180)"


@query("gap_bridges_j18", f"""WITH {_LINES}, ends AS (SELECT sheet_id, s_x AS x, s_y AS y, e_x-s_x AS dx, e_y-s_y AS dy FROM ln UNION ALL SELECT sheet_id, e_x, e_y, s_x-e_x, s_y-e_y FROM ln),
one AS (SELECT sheet_id, x, y, min(dx) AS dx, min(dy) AS dy FROM ends GROUP BY 1,2,3 HAVING count(*)=1), pt AS (SELECT n.sheet_id, n.n AS k, n.x, n.y, o.dx, o.dy FROM fx_nodes n JOIN one o ON o.sheet_id=n.sheet_id AND o.x=n.x AND o.y=n.y),
c AS (SELECT p.sheet_id, p.k AS l_k, q.k AS r_k, p.x AS ax, p.y AS ay, q.x AS bx, q.y AS by_, sqrt((q.x-p.x)*(q.x-p.x)+(q.y-p.y)*(q.y-p.y)) AS d FROM pt p JOIN pt q ON q.sheet_id=p.sheet_id AND p.k<q.k
WHERE sqrt((q.x-p.x)*(q.x-p.x)+(q.y-p.y)*(q.y-p.y)) BETWEEN 1 AND 130 AND {_TURN.format('p.dy', 'p.dx', 'q.y-p.y', 'q.x-p.x')}<=100 AND {_TURN.format('q.dy', 'q.dx', 'p.y-q.y', 'p.x-q.x')}<=100),
s AS (SELECT c.*, greatest(3, CAST(floor(d) AS BIGINT)) AS n, unnest(range(0, greatest(3, CAST(floor(d) AS BIGINT)))) AS i FROM c),
dots AS (SELECT *, CAST(trunc(CASE WHEN i=n-1 THEN bx ELSE i*((bx-ax)/(n-1))+ax END) AS BIGINT) AS px, CAST(trunc(CASE WHEN i=n-1 THEN by_ ELSE i*((by_-ay)/(n-1))+ay END) AS BIGINT) AS py FROM s),
cov AS (SELECT d.sheet_id, l_k, r_k, d.d, count(q.px)/count(*) AS cover FROM dots d LEFT JOIN fx_pixels q ON q.sheet_id=d.sheet_id AND q.px=d.px AND q.py=d.py WHERE d.px BETWEEN 0 AND 199 AND d.py BETWEEN 0 AND 139 GROUP BY 1,2,3,4)
SELECT sheet_id, l_k, r_k, round(cover,6) AS cover FROM (SELECT *, row_number() OVER (PARTITION BY sheet_id ORDER BY l_k, r_k) AS r FROM cov WHERE cover>=0.01) q WHERE r<=3""")
def _(t):
    ends = W.endpoint_directions(_lines(t), t("fx_nodes")).select("sheet_id", F.col("n").alias("k"), "x", "y", "dx", "dy")
    b = W.bridge_gaps(ends, t("fx_pixels"), 200, 140, 130.0, 100.0, 0.01, 3)
    return b.select("sheet_id", "l_k", "r_k", _r("cover", "cover"))


def _candidates(t):
    """Candidate lines with ends a few pixels off the grid, so that clustering has work to do."""
    p = _placed(t)
    k, length = F.col("seg"), F.col("length")
    return p.select(
        "sheet_id", k.alias("ord"), (F.col("s_x") + k % 4).alias("s_x"), (F.col("s_y") + length % 5).alias("s_y"),
        (F.col("e_x") + (k * 3) % 5).alias("e_x"), (F.col("e_y") + (length * 7) % 4).alias("e_y"), (length % 3).cast("int").alias("priority"))


@query("assembled_segments_g05")
def _(t):
    s, _n = W.assemble(_candidates(t), 4.0, 10.0)
    return s.select("sheet_id", "seg", "a", "b", "s_x", "s_y", "e_x", "e_y", _r("length", "length"), _r("angle_deg", "angle_deg"))


@query("assembled_nodes_g05")
def _(t):
    return W.assemble(_candidates(t), 4.0, 10.0)[1]


@query("straight_chains_g06")
def _(t):
    s, n = W.assemble(_candidates(t), 4.0, 10.0)
    s2, _n = W.assemble(W.straight_chains(s, n, 4.0, 10.0), 4.0, 10.0)
    return s2.select("sheet_id", "seg", "a", "b", "s_x", "s_y", "e_x", "e_y", _r("length", "length"))


@query("leaf_pruning_g13")
def _(t):
    """Endpoints judged by the pixels around them, their segments removed, the rest assembled again."""
    s, n = W.assemble(_candidates(t), 4.0, 10.0)
    halves = s.select("sheet_id", "seg", "length", F.explode(F.array(
        F.struct(F.col("a").alias("n"), F.col("b").alias("o"), F.col("s_x").alias("x"), F.col("s_y").alias("y"), F.col("e_x").alias("ox"), F.col("e_y").alias("oy")),
        F.struct(F.col("b").alias("n"), F.col("a").alias("o"), F.col("e_x").alias("x"), F.col("e_y").alias("y"), F.col("s_x").alias("ox"), F.col("s_y").alias("oy")))).alias("p"))
    halves = halves.select("sheet_id", "seg", "length", "p.*")
    ends = n.select("sheet_id", "n", "ends")
    leaf = halves.join(ends.where("ends = 1").select("sheet_id", "n"), ["sheet_id", "n"]).join(
        ends.where("ends > 1").select("sheet_id", F.col("n").alias("o")), ["sheet_id", "o"]).withColumn("id", F.col("n"))
    limits = W.endpoint_thresholds(10.0, 4.0)
    radius = int(limits["radius"])
    here = W.patch_stats(leaf.select("sheet_id", "id", "x", "y"), t("fx_pixels"), radius, 200, 140)
    there = W.patch_stats(leaf.select("sheet_id", "id", F.col("ox").alias("x"), F.col("oy").alias("y")), t("fx_pixels"), radius, 200, 140)
    near = W.nearest_other(leaf.select("sheet_id", "id", "x", "y", "ox", "oy"), n, 64.0).select("sheet_id", "id", F.col("nearest").alias("nearest_node_distance"))
    m = leaf.select("sheet_id", "id", "seg", F.col("length").alias("branch_length")).join(here, ["sheet_id", "id"]).join(
        there.select("sheet_id", "id", F.col("ink_ratio").alias("other_density")), ["sheet_id", "id"]).join(near, ["sheet_id", "id"])
    m = m.withColumns({"local_density": F.col("ink_ratio") * 12, "other_density": F.col("other_density") * 12, "skeleton_density": F.col("ink_ratio"), "area": F.col("area") * 12, "ink_ratio": F.col("ink_ratio") * 12, "fill_ratio": F.col("fill_ratio") * 12})
    drop = m.where(W.endpoint_reason(limits, limits["short_branch"] * 2).isNotNull()).select("sheet_id", "seg").distinct()
    keep = s.join(drop, ["sheet_id", "seg"], "left_anti").select("sheet_id", F.col("seg").alias("ord"), "s_x", "s_y", "e_x", "e_y", F.lit(0).alias("priority"))
    out, _n = W.assemble(keep, 4.0, 10.0)
    return out.select("sheet_id", "seg", "a", "b", _r("length", "length"))


_DECK = "comps AS (SELECT deck_id, comp, min(kind) AS kind, CASE WHEN comp%5=0 THEN concat('U', CAST(deck_id%7 AS VARCHAR)) END AS reference FROM fx_pins GROUP BY deck_id, comp)"


def _comps(t):
    return t("fx_pins").groupBy("deck_id", "comp").agg(F.min("kind").alias("kind")).withColumn(
        "reference", F.when(F.col("comp") % 5 == 0, F.concat(F.lit("U"), (F.col("deck_id") % 7).cast("string"))))


def _known(t):
    return t("fx_nodes").select(F.col("sheet_id").alias("deck_id"), F.col("node_id").alias("pin"))


@query("unknown_pins_j23", """SELECT p.deck_id, p.comp, p.pin, CASE WHEN p.pin='GND' THEN '0' ELSE p.pin END AS node, p.pin<>'GND' AND n.node_id IS NULL AS unknown FROM fx_pins p LEFT JOIN fx_nodes n ON n.sheet_id=p.deck_id AND n.node_id=p.pin""")
def _(t):
    return W.resolve_pins(t("fx_pins").select("deck_id", "comp", "pin"), _known(t)).select("deck_id", "comp", "pin", "node", "unknown")


_REFS = f"""{_DECK}, pf AS (SELECT *, CASE kind WHEN 'resistor' THEN 'R' WHEN 'capacitor' THEN 'C' WHEN 'diode' THEN 'D' ELSE 'X' END AS prefix FROM comps),
refs AS (SELECT deck_id, comp, kind, coalesce(reference, concat(prefix, CAST(row_number() OVER (PARTITION BY deck_id, prefix, reference IS NULL ORDER BY comp) AS VARCHAR))) AS ref FROM pf)"""


@query("reference_names_w07", f"WITH {_REFS} SELECT deck_id, comp, ref FROM refs")
def _(t):
    return W.reference_names(_comps(t)).select("deck_id", "comp", F.col("reference").alias("ref"))


@query("component_checks_w13", f"""WITH {_DECK}, k AS (SELECT deck_id, comp, kind, CASE WHEN comp%2=0 THEN concat('U', CAST(comp%3 AS VARCHAR)) END AS reference FROM comps), n AS (SELECT deck_id, comp, count(*) AS n FROM fx_pins GROUP BY 1,2)
SELECT k.deck_id, k.comp, 'few_pins' AS code FROM k JOIN n ON n.deck_id=k.deck_id AND n.comp=k.comp WHERE n<2 UNION ALL SELECT deck_id, comp, 'repeated_reference' FROM (SELECT *, row_number() OVER (PARTITION BY deck_id, reference ORDER BY comp) AS r FROM k WHERE reference IS NOT NULL) q WHERE r>1""")
def _(t):
    k = _comps(t).withColumn("reference", F.when(F.col("comp") % 2 == 0, F.concat(F.lit("U"), (F.col("comp") % 3).cast("string"))))
    return W.component_checks(k, t("fx_pins"))


@query("component_lines_p28", f"""WITH {_REFS}, nd AS (SELECT deck_id, comp, string_agg(CASE WHEN pin='GND' THEN '0' ELSE pin END, ' ' ORDER BY pin) AS nodes FROM fx_pins GROUP BY 1,2)
SELECT r.deck_id, r.comp, concat(r.ref, ' ', nd.nodes, ' ', CASE WHEN r.comp%3=0 THEN '1' WHEN r.comp%3=1 THEN CASE r.kind WHEN 'resistor' THEN '4.7K' ELSE '4.7K' END ELSE 'about' END) AS line FROM refs r JOIN nd ON nd.deck_id=r.deck_id AND nd.comp=r.comp""")
def _(t):
    refs = W.reference_names(_comps(t))
    pins = W.resolve_pins(t("fx_pins").select("deck_id", "comp", "pin"), _known(t))
    # the pins of one part: a handful
    nodes = pins.groupBy("deck_id", "comp").agg(F.transform(F.array_sort(F.collect_list(F.struct("pin", "node"))), lambda p: p["node"]).alias("nodes"))
    raw = F.when(F.col("comp") % 3 == 0, "").when(F.col("comp") % 3 == 1, "4.70K").otherwise("about")
    j = refs.join(nodes, ["deck_id", "comp"])
    parsed = V.parse_value(F.col("raw"), F.lit("resistor"))
    j = j.withColumn("raw", raw).withColumn("value", F.coalesce(V.deck_value(parsed), F.col("raw")))
    return j.select("deck_id", "comp", W.component_line(F.col("reference"), F.col("nodes"), F.col("value")).alias("line"))


@query("wire_lines_p28", """WITH l AS (SELECT sheet_id, n, concat('N', lpad(CAST(row_number() OVER (PARTITION BY sheet_id ORDER BY n) AS VARCHAR), 3, '0')) AS label FROM fx_nodes)
SELECT s.sheet_id, s.segment_id, concat('WIRE ', s.segment_id, ' ', x.label, ' ', y.label, ' ', printf('LEN=%.2f ANG=%.1f', s.length, CAST(s.seg*15 AS DOUBLE))) AS line FROM fx_segments s JOIN l x ON x.sheet_id=s.sheet_id AND x.n=least(s.a,s.b) JOIN l y ON y.sheet_id=s.sheet_id AND y.n=greatest(s.a,s.b)""")
def _(t):
    e = W.edges_from_incidence(W.incidence(t("fx_segments")))
    lab = W.node_labels(_nodes(t))
    side = lambda c, n: lab.select("sheet_id", F.col("n").alias(c), F.col("label").alias(n))
    j = e.join(side("source", "sl"), ["sheet_id", "source"]).join(side("target", "tl"), ["sheet_id", "target"]).join(
        t("fx_segments").select("sheet_id", "segment_id", "seg", "length"), ["sheet_id", "segment_id"])
    return j.select("sheet_id", "segment_id", W.wire_line(F.col("segment_id"), F.col("sl"), F.col("tl"), F.col("length"), (F.col("seg") * 15).cast("double")).alias("line"))


@query("segment_payload_p29", """SELECT sheet_id, seg, CASE WHEN seg%3=0 THEN 'edge-0' ELSE segment_id END AS id, round(CASE WHEN seg%2=0 THEN sqrt((60*(a%4)-60*(b%4))*(60*(a%4)-60*(b%4))+(60*(a//4)-60*(b//4))*(60*(a//4)-60*(b//4))) ELSE length END,6) AS length FROM fx_segments""")
def _(t):
    p = _placed(t)
    obj = F.struct(
        F.when(F.col("seg") % 3 != 0, F.col("segment_id")).alias("id"), F.struct(F.col("s_x").alias("x"), F.col("s_y").alias("y")).alias("start"),
        F.struct(F.col("e_x").alias("x"), F.col("e_y").alias("y")).alias("end"), F.when(F.col("seg") % 2 != 0, F.col("length")).alias("length"))
    text = F.to_json(F.struct(F.array(obj).alias("lines")))
    rows = W.segments_from_json(p.select("sheet_id", "seg", text.alias("body")), "body")
    return rows.select("sheet_id", "seg", "id", _r("length", "length"))


@query("component_payload_v08", """WITH n AS (SELECT deck_id, comp, min(kind) AS kind, count(*) AS n FROM fx_pins GROUP BY 1,2) SELECT deck_id, comp, 'missing_kind' AS code FROM n WHERE kind='gizmo' UNION ALL SELECT deck_id, comp, 'few_nodes' FROM n WHERE n<2""")
def _(t):
    body = F.to_json(F.struct(F.when(F.col("kind") != "gizmo", F.col("kind")).alias("kind"), F.col("pins").alias("nodes")))
    n = t("fx_pins").groupBy("deck_id", "comp").agg(F.min("kind").alias("kind"), F.collect_list("pin").alias("pins")).select("deck_id", "comp", body.alias("body"))
    p = n.withColumn("p", F.from_json("body", "kind string, nodes array<string>")).select("deck_id", "comp", "p.*")
    return Q.issue_rows(p, ["deck_id", "comp"], W.payload_issues()).select("deck_id", "comp", "code")


@query("cycle_listing_g04", f"""WITH RECURSIVE {_EDGES}, ed AS (SELECT DISTINCT sheet_id, a, b FROM simple), around AS (SELECT sheet_id, a, b, a AS n FROM ed UNION
SELECT r.sheet_id, r.a, r.b, CASE WHEN f.a=r.n THEN f.b ELSE f.a END FROM around r JOIN ed f ON f.sheet_id=r.sheet_id AND (f.a=r.n OR f.b=r.n) AND (f.a<r.a OR (f.a=r.a AND f.b<r.b))),
outside AS (SELECT DISTINCT sheet_id, a, b FROM around WHERE n=b), tree AS (SELECT sheet_id, a, b FROM ed EXCEPT SELECT sheet_id, a, b FROM outside),
ways AS (SELECT sheet_id, a AS u, b AS v FROM tree UNION ALL SELECT sheet_id, b, a FROM tree),
walk AS (SELECT sheet_id, a, b, a AS n, [a] AS path FROM outside UNION ALL SELECT w.sheet_id, w.a, w.b, t.v, list_append(w.path, t.v) FROM walk w JOIN ways t ON t.sheet_id=w.sheet_id AND t.u=w.n WHERE w.n<>w.b AND NOT list_contains(w.path, t.v))
SELECT sheet_id, a, b, unnest(path) AS n FROM walk WHERE n=b""")
def _(t):
    return W.cycle_basis(W.nets(_nodes(t), _edges(t)), _edges(t))
