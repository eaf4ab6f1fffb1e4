"""The skew-safe building blocks against plain loops on random small inputs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewright.operators import quality, scale, spatial


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(3)
    # one key holds most rows, so its group spans several slices
    return [("hot" if rnd.random() < 0.7 else rnd.choice("abc"), rnd.randint(0, 20), i, rnd.randint(0, 100)) for i in range(400)]


@pytest.fixture(scope="module")
def sliced(spark, rows):
    df = spark.createDataFrame(rows, "k string, o int, id int, v int").repartition(5)
    return scale.slice_by_order(df, ["k"], [F.col("o"), F.col("id")])


def _groups(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        out.setdefault(r[0], []).append(r)
    return out


def test_hot_group_is_cut(sliced):
    assert sliced.where("k = 'hot'").select(scale.SLICE).distinct().count() > 1


def test_running_and_rank(sliced, rows):
    order = [F.col("o"), F.col("id")]
    got = {r.id: (r.s, r.n) for r in scale.running(sliced, ["k"], order, {"s": F.col("v"), "n": F.lit(1)}).collect()}
    for g in _groups(rows).values():
        total = 0
        for i, r in enumerate(g, 1):
            total += r[3]
            assert got[r[2]] == (total, i)


def test_suffix_max_and_previous(sliced, rows):
    order = [F.col("o"), F.col("id")]
    top = {r.id: r.m for r in scale.suffix_max(sliced, ["k"], order, F.col("v"), "m").collect()}
    before = {r.id: r.p for r in scale.previous(sliced, ["k"], order, "v", "p").collect()}
    for g in _groups(rows).values():
        for i, r in enumerate(g):
            assert top[r[2]] == max(x[3] for x in g[i:])
            assert before[r[2]] == (g[i - 1][3] if i else None)


def test_renumber_is_independent_of_partitioning(spark, rows):
    df = spark.createDataFrame(rows, "k string, o int, id int, v int")
    a = scale.renumber(df, [F.col("o"), F.col("id")], "n").select("id", "n").collect()
    b = scale.renumber(df.repartition(7).orderBy(F.desc("id")), [F.col("o"), F.col("id")], "n").select("id", "n").collect()
    assert sorted(a) == sorted(b)
    assert sorted(r.n for r in a) == list(range(1, len(rows) + 1))


def test_exact_quantiles(spark, rows):
    df = spark.createDataFrame(rows, "k string, o int, id int, v int")
    got = {r.k: (r.a, r.b, r.c) for r in quality.exact_quantiles(df, ["k"], "v", {"a": 0.25, "b": 0.5, "c": 0.9}).collect()}
    for k, g in _groups(rows).items():
        want = np.percentile([r[3] for r in g], [25, 50, 90])
        assert got[k] == pytest.approx(tuple(want))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_greedy_independent(spark, seed):
    rnd = random.Random(seed)
    n = 40
    edges = {tuple(sorted((rnd.randrange(n), rnd.randrange(n)))) for _ in range(70)}
    edges = {e for e in edges if e[0] != e[1]}
    kept = []
    for i in range(n):
        if not any((min(i, j), max(i, j)) in edges for j in kept):
            kept.append(i)
    nodes = spark.range(n).select(F.col("id").cast("int").alias("v"))
    got = scale.greedy_independent(nodes, spark.createDataFrame(list(edges), "earlier int, later int"), "v")
    assert sorted(r.v for r in got.collect()) == kept


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_priority_matching(spark, seed):
    rnd = random.Random(seed)
    pairs = {(rnd.randrange(25), rnd.randrange(15)): rnd.random() for _ in range(90)}
    free, want = set(range(15)), []
    for s in range(25):
        best = min(((d, t) for (a, t), d in pairs.items() if a == s and t in free), default=None)
        if best:
            want.append((s, best[1]))
            free.discard(best[1])
    df = spark.createDataFrame([(s, t, d) for (s, t), d in pairs.items()], "s int, t int, d double")
    got = scale.priority_matching(df, "s", "t", [F.col("s").alias("k")], [F.col("d")])
    assert sorted((r.s, r.t) for r in got.collect()) == sorted(want)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_ordered_pairing(spark, seed):
    rnd = random.Random(seed)
    pairs = {(a, b): rnd.randint(0, 9) for a, b in ((rnd.randrange(30), rnd.randrange(30)) for _ in range(60)) if a != b}
    used, want = set(), []
    for i in range(30):
        if i in used:
            continue
        best = min(((d, j) for (a, j), d in pairs.items() if a == i and j not in used), default=None)
        if best:
            want.append((i, best[1]))
            used |= {i, best[1]}
    df = spark.createDataFrame([(i, j, d) for (i, j), d in pairs.items()], "i int, j int, d int")
    got = scale.ordered_pairing(df, [F.col("d"), F.col("j").alias("o")])
    assert sorted((r.i, r.j) for r in got.collect()) == sorted(want)


@pytest.mark.parametrize("seed", [1, 2])
def test_connected_components(spark, seed):
    rnd = random.Random(seed)
    edges = [(rnd.randrange(80), rnd.randrange(80)) for _ in range(60)] + [(100 + i, 101 + i) for i in range(30)]
    root = {v: v for e in edges for v in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            m = min(root[a], root[b])
            changed |= root[a] != m or root[b] != m
            root[a] = root[b] = m
    got = {r.node: r.root for r in scale.connected_components(spark.createDataFrame(edges, "a int, b int")).collect()}
    assert got == root


def test_overlap_join_meets_each_pair_once(spark):
    rnd = random.Random(5)
    box = lambda i: (i % 2, i, float(rnd.randint(-200, 200)), float(rnd.randint(-200, 200)), float(rnd.randint(1, 180)), float(rnd.randint(1, 90)))
    a, b = [box(i) for i in range(40)], [box(i) for i in range(40)]
    hit = lambda p, q: min(p[2] + p[4], q[2] + q[4]) > max(p[2], q[2]) and min(p[3] + p[5], q[3] + q[5]) > max(p[3], q[3])
    want = sorted((p[1], q[1]) for p in a for q in b if p[0] == q[0] and hit(p, q))
    side = lambda rows, s: spark.createDataFrame(rows, f"g int, {s}id int, {s}_x double, {s}_y double, {s}_w double, {s}_h double")
    got = spatial.overlap_join(side(a, "l"), side(b, "r"), ["g"]).select("lid", "rid").collect()
    assert sorted(map(tuple, got)) == want


def test_null_groups_stay(spark):
    df = spark.createDataFrame([(None, 1), ("a", 2), (None, 3), ("a", 4)], "g string, v long")
    got = {(r.g, r.v): r.k for r in scale.ranked(df, ["g"], [F.col("v")], "k").collect()}
    assert got == {(None, 1): 1, ("a", 2): 1, (None, 3): 2, ("a", 4): 2}
    sliced = scale.slice_by_order(df, ["g"], [F.col("v")])
    assert {(r.g, r.v): r.m for r in scale.suffix_max(sliced, ["g"], [F.col("v")], F.col("v"), "m").collect()} == {(None, 1): 3, (None, 3): 3, ("a", 2): 4, ("a", 4): 4}
    assert {(r.g, r.v): r.p for r in scale.previous(sliced, ["g"], [F.col("v")], "v", "p").collect()} == {(None, 1): None, (None, 3): 1, ("a", 2): None, ("a", 4): 2}


def test_long_ladder(spark):
    n = 1000
    nodes = spark.range(n).withColumnRenamed("id", "n")
    steps = spark.range(n - 1).selectExpr("id AS earlier", "id + 1 AS later")
    assert [r.n for r in scale.greedy_independent(nodes, steps, "n").orderBy("n").collect()] == list(range(0, n, 2))


def test_greedy_equals_loop(spark):
    rng = random.Random(8)
    for n, m in ((30, 40), (40, 25), (25, 90)):
        pairs = {tuple(sorted(rng.sample(range(n), 2))) for _ in range(m)}
        kept = []
        for i in range(n):
            if not any((j, i) in pairs for j in kept):
                kept.append(i)
        nodes = spark.range(n).withColumnRenamed("id", "n")
        got = scale.greedy_independent(nodes, spark.createDataFrame(list(pairs), "earlier long, later long"), "n")
        assert sorted(r.n for r in got.collect()) == kept


def _overlaps(a, b):
    return min(a[1] + a[3], b[1] + b[3]) > max(a[1], b[1]) and min(a[2] + a[4], b[2] + b[4]) > max(a[2], b[2])


def test_overlap_join_of_all_sizes(spark):
    """Boxes from a fraction of a pixel to a whole sheet, negative places, boxes without area."""
    rnd = random.Random(8)
    def boxes(n):
        out = []
        for i in range(n):
            size = 4.0 ** rnd.uniform(-2, 7)
            out.append((i, rnd.uniform(-500, 3000), rnd.uniform(-500, 3000), size * rnd.uniform(0.01, 1), size))
        return out + [(n, 10.0, 10.0, 0.0, 50.0), (n + 1, -1000.0, -1000.0, 20_000.0, 20_000.0), (n + 2, 64.0, 64.0, 64.0, 64.0), (n + 3, 128.0, 64.0, 64.0, 64.0)]

    ls, rs = boxes(150), boxes(160)
    frame = lambda rows, p: spark.createDataFrame(rows, ", ".join(["%si long" % p, *[f"{p}{c} double" for c in "xywh"]])).withColumn("g", F.lit(1))
    got = [(r.l_i, r.r_i) for r in spatial.overlap_join(frame(ls, "l_"), frame(rs, "r_"), ["g"]).select("l_i", "r_i").collect()]
    assert sorted(got) == sorted((a[0], b[0]) for a in ls for b in rs if _overlaps(a, b))


def test_overlap_join_does_not_pair_what_only_asks(spark):
    """One box over the sheet and 10,000 of two pixels within a few: each box costs a handful of rows, not a square."""
    small = spark.range(10_000).select(F.col("id").alias("l_i"), F.lit(1).alias("g"), (F.col("id") % 100 * 2.0).alias("l_x"), (F.floor(F.col("id") / 100) * 2.0).alias("l_y"),
                                       F.lit(2.0).alias("l_w"), F.lit(2.0).alias("l_h"))
    right = small.select(F.col("l_i").alias("r_i"), "g", *[F.col(f"l_{c}").alias(f"r_{c}") for c in "xywh"]).unionByName(
        spark.createDataFrame([(-1, 1, -5.0, -5.0, 20_000.0, 20_000.0)], "r_i long, g int, r_x double, r_y double, r_w double, r_h double"))
    pairs = spatial.overlap_join(small, right, ["g"])
    got = pairs.groupBy().agg(F.count_if(F.col("r_i") == -1).alias("whole"), F.count_if(F.col("r_i") == F.col("l_i")).alias("same"), F.count(F.lit(1)).alias("all")).first()
    assert (got.whole, got.same, got.all) == (10_000, 10_000, 20_000)
    cells = F.size(spatial._cells([F.col(f"l_{c}") for c in "xywh"], spatial.level_of(F.col("l_w"), F.col("l_h")), 0))
    assert small.agg(F.max(cells)).first()[0] <= 4


def test_spans_and_polygon_masks(spark):
    from tracewright.functions import regions
    from tracewright.operators import evaluation

    rnd = random.Random(4)
    rows = [(rnd.randint(0, 3), a, a + rnd.randint(0, 6)) for a in (rnd.randint(0, 60) for _ in range(80))]
    got = regions.merged_spans(spark.createDataFrame(rows, "k int, _a long, _z long"), ["k"]).collect()
    dots = {(k, x) for k, a, z in rows for x in range(a, z + 1)}
    assert {(r.k, x) for r in got for x in range(r._a, r._z + 1)} == dots and sum(r._z - r._a + 1 for r in got) == len(dots)
    assert all((r.k, r._z + 1) not in dots and (r.k, r._a - 1) not in dots for r in got)
    # a box of 10,000 by 10,000 pixels is 10,001 rows
    square = spark.createDataFrame([(1, [[0.0, 0.0], [10_000.0, 0.0], [10_000.0, 10_000.0], [0.0, 10_000.0]])], "k int, points array<array<double>>")
    lines = regions.polygon_lines(square, ["k"])
    assert lines.agg(F.count(F.lit(1)), F.sum(F.col("_z") - F.col("_a") + 1)).first()[:] == (10_001, 10_001**2)
    rect = lambda x, y, w, h: [[x, y], [x + w - 1.0, y], [x + w - 1.0, y + h - 1.0], [x, y + h - 1.0]]
    truth = [(1, i, rect(float(rnd.randint(0, 50)), float(rnd.randint(0, 50)), rnd.randint(2, 30), rnd.randint(2, 30))) for i in range(20)]
    truth += [(1, 3, rect(70.0, 70.0, 10, 10)), (2, 99, rect(0.0, 0.0, 5, 5)), (1, 98, [[0.0, 0.0], [1.0, 1.0]])]
    preds = [(1, i, rect(float(rnd.randint(0, 60)), float(rnd.randint(0, 60)), rnd.randint(2, 30), rnd.randint(2, 30))) for i in range(15)] + [(3, 0, rect(0.0, 0.0, 5, 5))]

    def pixels(rows):
        out = {}
        for k, i, p in rows:
            out.setdefault((k, i), set())
            if len(p) > 2:
                out[k, i] |= {(x, y) for x in range(int(p[0][0]), int(p[2][0]) + 1) for y in range(int(p[0][1]), int(p[2][1]) + 1)}
        return out

    g, p = pixels(truth), pixels(preds)
    want = {(k, i): max(len(m & n) / len(m | n) for (q, _), n in p.items() if q == k) for (k, i), m in g.items() if any(q == k for q, _ in p)}
    kind = "array<array<double>>"
    got = evaluation.polygon_mask_iou(spark.createDataFrame(truth, f"s int, gt int, points {kind}"), spark.createDataFrame(preds, f"s int, pr int, points {kind}"), ["s"])
    assert {(r.s, r.gt): r.iou for r in got.collect()} == pytest.approx(want)


def test_polygon_masks_of_one_shape(spark, monkeypatch):
    """Objects of one form become lines once, wherever they lie; forms with fractions stay in place."""
    from tracewright.functions import regions
    from tracewright.operators import evaluation

    sizes = []
    plain = regions.polygon_lines
    monkeypatch.setattr(regions, "polygon_lines", lambda df, keys: (sizes.append(df.count()), plain(df, keys))[1])
    rnd = random.Random(7)
    diamond = lambda x, y: [[x + 4.0, y + 0.0], [x + 8.0, y + 3.0], [x + 4.0, y + 6.0], [x + 0.0, y + 3.0]]
    at = lambda: (rnd.randint(-20, 20), rnd.randint(-20, 20))
    truth, preds = ([(im, i, *at()) for im in range(3) for i in range(12)] for _ in range(2))
    kind = "array<array<double>>"
    frame = lambda rows, name: spark.createDataFrame([(im, i, diamond(x, y)) for im, i, x, y in rows], f"s int, {name} int, points {kind}")
    half = spark.createDataFrame([(9, 1, [[0.5, 0.0], [2.5, 0.0], [2.5, 1.0], [0.5, 1.0]])], f"s int, gt int, points {kind}")
    other = spark.createDataFrame([(9, 1, [[1.0, 0.0], [3.0, 0.0], [3.0, 1.0], [1.0, 1.0]]), (9, 1, [[7.0, 0.0], [8.0, 0.0], [8.0, 1.0]])], f"s int, pr int, points {kind}")
    got = {(r.s, r.gt): r.iou for r in evaluation.polygon_mask_iou(frame(truth, "gt").unionByName(half), frame(preds, "pr").unionByName(other), ["s"]).collect()}
    dots = lambda x, y: {(u, v) for v in range(y, y + 7) for u in range(x, x + 9) if abs(u - x - 4) * 3 + abs(v - y - 3) * 4 <= 12}
    iou = lambda a, b: len(a & b) / len(a | b)
    want = {(im, i): max(iou(dots(x, y), dots(u, v)) for jm, _, u, v in preds if jm == im) for im, i, x, y in truth}
    assert got == pytest.approx(want | {(9, 1): 4 / 9})
    assert sizes == [4]


def _free_boxes(preds, truth, least):
    """The serial loop: each prediction of a model in score order takes the free box with the highest IoU, the first of equals."""
    def iou(a, b):
        i = max(0, min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0])) * max(0, min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1]))
        return i / (a[2] * a[3] + b[2] * b[3] - i)

    taken, out = set(), []
    for m, p, im, c, s, *box in sorted(preds, key=lambda r: (-r[4], r[2], r[1])):
        best = max(((iou(box, g[3:]), -g[0]) for g in truth if g[1:3] == (im, c) and (m, g[0]) not in taken), default=(0, 0))
        if best[0] >= least:
            taken.add((m, -best[1]))
            out.append((m, p, -best[1]))
    return sorted(out)


_PRED, _TRUE = "model string, pred_id long, image_id long, category_id long, score double, x long, y long, w long, h long", "ann_id long, image_id long, category_id long, x long, y long, w long, h long"


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_free_box_matches(spark, seed):
    """Piles of equal boxes, shapes that lie equally well on either side, two models."""
    from tracewright.operators import evaluation

    rnd = random.Random(seed)
    shape = lambda: (rnd.choice([0, 2, 4, 6, 40]), rnd.choice([0, 0, 3]), 20, rnd.choice([20, 24]))
    truth = [(i, i % 2, 1, *shape()) for i in range(60)]
    preds = [(rnd.choice("ab"), i, i % 2, 1, round(rnd.random(), 1), *shape()) for i in range(120)]
    got = evaluation.free_box_matches(spark.createDataFrame(preds, _PRED), spark.createDataFrame(truth, _TRUE), 0.5)
    assert sorted(map(tuple, got.select("model", "pred_id", "ann_id").collect())) == _free_boxes(preds, truth, 0.5)


def test_a_pile_is_matched_in_linear_rows(spark, monkeypatch):
    """10,000 equal predictions on 9,000 equal boxes, ranked in slices: the first 9,000 by score get the boxes in order."""
    from tracewright.operators import evaluation

    monkeypatch.setattr(scale, "GROUP_ROWS", 500)
    i = F.col("id")
    preds = spark.range(10_000).select(F.lit("a").alias("model"), i.alias("pred_id"), F.lit(1).alias("image_id"), F.lit(1).alias("category_id"), ((i * 7919) % 10_000 / 10_000).alias("score"), *[F.lit(v).alias(c) for c, v in zip("xywh", (5, 5, 10, 10))])
    truth = spark.range(9_000).select(i.alias("ann_id"), F.lit(1).alias("image_id"), F.lit(1).alias("category_id"), *[F.lit(v).alias(c) for c, v in zip("xywh", (6, 5, 10, 10))])
    got = evaluation.free_box_matches(preds, truth, 0.5).join(preds.select("pred_id", "score"), "pred_id").orderBy(F.desc("score")).select("ann_id").collect()
    assert [r.ann_id for r in got] == list(range(9_000))


def test_groups_of_few_meet_without_cells(spark):
    """Small groups send one row per box; boxes of a crowded group, and only those, are dealt over cells."""
    rng = random.Random(5)
    box = lambda g, i: (g, i, rng.randint(0, 90), rng.randint(0, 90), rng.choice([0, 3, 9, 70]), rng.randint(1, 12))
    few, crowd = [box(i % 20, i) for i in range(200)], [box(77, 1000 + i) for i in range(150)]
    frame = lambda rows, p: spark.createDataFrame(rows, f"g long, {p}i long, {p}x long, {p}y long, {p}w long, {p}h long")
    hits = lambda a, b: sorted((p[1], q[1]) for p in a for q in b if p[0] == q[0] and min(p[2] + p[4], q[2] + q[4]) > max(p[2], q[2]) and min(p[3] + p[5], q[3] + q[5]) > max(p[3], q[3]))
    plain = spatial.overlap_join(frame(few, "l_"), frame(few[::2], "r_"), ["g"])
    assert "Generate" not in plain._jdf.queryExecution().optimizedPlan().toString()
    both = spatial.overlap_join(frame(few + crowd, "l_"), frame(few[::2] + crowd, "r_"), ["g"])
    assert "Generate" in both._jdf.queryExecution().optimizedPlan().toString()
    for got, a, b in ((plain, few, few[::2]), (both, few + crowd, few[::2] + crowd)):
        assert sorted(tuple(r) for r in got.select("l_i", "r_i").collect()) == hits(a, b)
