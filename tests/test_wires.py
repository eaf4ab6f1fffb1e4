"""Graph assembly and chain merging against plain loops on small random drawings."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tracewright.operators import scale, wires


def _lines(seed, n=24):
    rnd = random.Random(seed)
    snap = lambda v: v + rnd.choice([0, 0, 1, -1, 2])
    out = []
    for i in range(n):
        x, y = rnd.choice([0, 30, 60, 90]), rnd.choice([0, 30, 60])
        dx, dy = rnd.choice([(30, 0), (0, 30), (30, 30), (3, 0)])
        out.append((seed, i, float(snap(x)), float(snap(y)), float(snap(x + dx)), float(snap(y + dy)), rnd.choice([0, 0, 1])))
    return out


def _assemble(lines, tol, least):
    leaders, best = [], {}

    def spot(p):
        for k, q in enumerate(leaders):
            if math.dist(p, q) <= tol:
                return k
        leaders.append(p)
        return len(leaders) - 1

    for line in lines:
        s, e, prio = (line[2], line[3]), (line[4], line[5]), line[6]
        a, b = spot(s), spot(e)
        length = math.dist(s, e)
        if a == b or length < least:
            continue
        key = (min(a, b), max(a, b))
        if key not in best or (prio, length) > best[key][:2]:
            best[key] = (prio, length, a, b)
    at = [(round(x), round(y)) for x, y in leaders]
    segs = [(a, b) for _, (_, _, a, b) in sorted(best.items()) if math.dist(at[a], at[b]) >= least]
    ids = {k: i for i, k in enumerate(sorted({k for s in segs for k in s}))}
    return [(i, ids[a], ids[b], *at[a], *at[b]) for i, (a, b) in enumerate(segs)], {i: at[k] for k, i in ids.items()}


def _frame(spark, lines):
    return spark.createDataFrame(lines, "sheet_id long, ord long, s_x double, s_y double, e_x double, e_y double, priority int")


def _got(segments):
    return sorted((r.sheet_id, r.seg, r.a, r.b, r.s_x, r.s_y, r.e_x, r.e_y) for r in segments.collect())


@pytest.mark.parametrize("tol", [0.0, 3.0, 9.0])
def test_assemble(spark, tol):
    data = {s: _lines(s) for s in range(6)}
    seg, nodes = wires.assemble(_frame(spark, sum(data.values(), [])), tol, 5.0)
    want, spots = [], []
    for s, lines in data.items():
        segs, at = _assemble(lines, tol, 5.0)
        want += [(s, *r) for r in segs]
        spots += [(s, i, *p) for i, p in at.items()]
    assert _got(seg) == sorted(want)
    assert sorted((r.sheet_id, r.n, r.x, r.y) for r in nodes.collect()) == sorted(spots)


def test_straight_chains(spark):
    data = {s: _lines(s, 16) for s in range(6)}
    seg, nodes = wires.assemble(_frame(spark, sum(data.values(), [])), 3.0, 5.0)
    out, _ = wires.assemble(wires.straight_chains(seg, nodes, 3.0, 5.0), 3.0, 5.0)
    want, merged = [], 0
    for s, lines in data.items():
        segs, at = _assemble(lines, 3.0, 5.0)
        touch = {}
        for r in segs:
            touch.setdefault(r[1], []).append(r)
            touch.setdefault(r[2], []).append(r)
        used, pairs, new = set(), set(), []
        for n in sorted(touch):
            if len(touch[n]) != 2:
                continue
            a, b = sorted(touch[n], key=lambda r: f"edge-{r[0]}")
            if a[0] in used or b[0] in used:
                continue
            p = at[n]
            oa, ob = (at[r[2]] if r[1] == n else at[r[1]] for r in (a, b))
            va, vb = (oa[0] - p[0], oa[1] - p[1]), (ob[0] - p[0], ob[1] - p[1])
            la, lb, both = math.hypot(*va), math.hypot(*vb), math.dist(a[3:5], a[5:7]) + math.dist(b[3:5], b[5:7])
            if oa == ob or min(la, lb) < 1 or (va[0] * vb[0] + va[1] * vb[1]) / (la * lb) > -math.cos(math.radians(15)):
                continue
            if math.dist(oa, ob) > max(both * 1.25, both + 9.0) or tuple(sorted((oa, ob))) in pairs:
                continue
            pairs.add(tuple(sorted((oa, ob))))
            used |= {a[0], b[0]}
            new.append((s, n, float(oa[0]), float(oa[1]), float(ob[0]), float(ob[1]), 2))
        merged += len(new)
        kept = [(s, r[0], *map(float, r[3:]), 0) for r in segs if r[0] not in used]
        again, _ = _assemble(kept + new, 3.0, 5.0)
        want += [(s, *r) for r in again]
    assert merged > 5
    assert _got(out) == sorted(want)


def test_nearest_other(spark):
    rnd = random.Random(4)
    nodes = [(s, float(rnd.randint(0, 500)), float(rnd.randint(0, 500))) for s in (1, 2) for _ in range(15)]
    points = [(s, i, x, y, *rnd.choice(nodes)[1:]) for i, (s, x, y) in enumerate(nodes)] + [(3, 99, 0.0, 0.0, 1.0, 1.0)]
    got = wires.nearest_other(spark.createDataFrame(points, "sheet_id int, id int, x double, y double, ox double, oy double"),
                              spark.createDataFrame(nodes, "sheet_id int, x double, y double"), 10.0)
    for r in got.collect():
        d = [math.dist((r.x, r.y), n[1:]) for n in nodes if n[0] == r.sheet_id and n[1:] not in ((r.x, r.y), (r.ox, r.oy))]
        assert (r.nearest is None and not d) or r.nearest == pytest.approx(min(d))


def test_net_order_is_by_text_of_first_node(spark):
    nodes = spark.createDataFrame([(1, n) for n in (1, 2, 3, 10, 11)], "sheet_id long, n long")
    edges = spark.createDataFrame([(1, 10, 11), (1, 2, 3)], "sheet_id long, source long, target long")
    got = {r.root: r.net for r in wires.net_labels(wires.nets(nodes, edges)).collect()}
    assert got == {1: "NET001", 10: "NET002", 2: "NET003"}


def test_endpoint_reason_limits(spark):
    cols = "branch_length, area, aspect_ratio, ink_ratio, fill_ratio, skeleton_density, nearest_node_distance, local_density, other_density"
    rows = [
        (20.0, 150.0, 1.5, 0.3, 0.6, 0.03, 15.0, 0.3, 0.3), (40.0, 200.0, 2.0, 0.3, 0.6, 0.02, None, 0.3, 0.1), (40.0, 120.0, 3.5, 0.25, 0.55, 0.02, 5.0, 0.2, 0.2),
        (40.0, 100.0, 2.0, 0.3, 0.1, 0.0, None, 0.4, 0.2), (90.0, 500.0, 1.0, 0.9, 0.9, 0.9, 1.0, 0.9, 0.1), (10.0, 0.0, 1.0, 0.9, 0.9, 0.9, 1.0, 0.9, 0.1)]
    df = spark.createDataFrame(rows, ", ".join(f"{c.strip()} double" for c in cols.split(",")))
    got = [r.r for r in df.select(wires.endpoint_reason(wires.endpoint_thresholds(10.0, 4.0), 46.0).alias("r")).collect()]
    assert got == ["text_pair", "dense_blob", "cluster", "density_margin", None, None]


def test_reference_numbering_keeps_given_names(spark):
    c = spark.createDataFrame([(1, 1, "resistor", None), (1, 2, "resistor", "R9"), (1, 3, "resistor", None), (1, 4, "lamp", None)], "deck_id long, comp long, kind string, reference string")
    got = {r.comp: r.reference for r in wires.reference_names(c).collect()}
    assert got == {1: "R1", 2: "R9", 3: "R2", 4: "X1"}
    line = spark.range(1).select(wires.component_line(F.lit("R1"), F.array(F.lit("N001"), F.lit("0")), F.lit("4.7K")).alias("l")).first().l
    assert line == "R1 N001 0 4.7K"


def test_cycle_basis_closes_every_outside_edge(spark):
    rnd = random.Random(8)
    e = [(s, rnd.randrange(9), rnd.randrange(9)) for s in range(4) for _ in range(13)]
    nodes = spark.createDataFrame([(s, n) for s in range(4) for n in range(9)], "sheet_id long, n long")
    edges = spark.createDataFrame(e, "sheet_id long, source long, target long")
    members = wires.nets(nodes, edges)
    rank = {r.sheet_id: r.cycles for r in wires.cycle_rank(members, edges).collect()}
    cycles = {}
    for r in wires.cycle_basis(members, edges).collect():
        cycles.setdefault((r.sheet_id, r.a, r.b), set()).add(r.n)
    pairs = {(s, min(a, b), max(a, b)) for s, a, b in e}
    assert {s: sum(1 for k in cycles if k[0] == s) for s in range(4)} == rank
    for (s, a, b), c in cycles.items():
        assert (s, a, b) in pairs and {a, b} <= c
        # inside the cycle every node has two ways on, except in a loop on one node
        assert len(c) == 1 or all(sum((s, min(n, m), max(n, m)) in pairs for m in c if m != n) >= 2 for n in c)


def test_forest_of_a_long_path(spark):
    """A path of 10,000 nodes, a hub of 400, random sheets: parents, depths and ways, in rounds of the logarithm."""
    from tracewright.operators import forests

    rnd = random.Random(3)
    path = list(range(10_000))
    pairs = {(0, min(u, v), max(u, v)) for u, v in zip(path, path[1:])} | {(1, 0, k) for k in range(1, 400)}
    for s in range(2, 6):
        pairs |= {(s, *sorted(rnd.sample(range(40), 2))) for _ in range(55)}
    rows, _calls = sorted(pairs), []
    edges = spark.createDataFrame(rows, "sheet_id long, a long, b long")
    root, forest = {}, []
    def find(x):
        while root.get(x, x) != x:
            x = root[x]
        return x
    for s, a, b in rows:
        x, y = find((s, a)), find((s, b))
        if x != y:
            root[max(x, y)] = min(x, y)
            forest.append((s, a, b))
    on = ["sheet_id"]
    got = forests.first_forest(edges, on)
    assert sorted(map(tuple, got.collect())) == sorted(forest)
    nodes = sorted({(s, n) for s, a, b in rows for n in (a, b)})
    members = spark.createDataFrame([(*n, find(n)[1]) for n in nodes], "sheet_id long, n long, root long")
    near = {}
    for s, a, b in forest:
        near.setdefault((s, a), []).append((s, b))
        near.setdefault((s, b), []).append((s, a))
    want, todo = {}, [(n, None, 0) for n in nodes if find(n) == n]
    while todo:
        n, up, d = todo.pop()
        want[n] = (up and up[1], d)
        todo += [(m, n, d + 1) for m in near.get(n, ()) if m != up]
    tree = forests.stage(forests.rooted(got, members, on))
    assert {(r.sheet_id, r.n): (r.parent, r.depth) for r in tree.collect()} == want
    asked = [(0, 17, 9_000), (0, 5, 5), (1, 3, 399), (1, 0, 7)] + [(s, a, b) for s, a, b in rows if s > 1]
    def way(s, a, b):
        left, right = [a], [b]
        while left[-1] != right[-1]:
            one = left if want[s, left[-1]][1] >= want[s, right[-1]][1] else right
            one.append(want[s, one[-1]][0])
        return sorted((s, a, b, n) for n in {*left, *right})
    ways = forests.paths(spark.createDataFrame(asked, "sheet_id long, a long, b long"), tree, on)
    assert sorted(map(tuple, ways.collect())) == sorted(x for p in asked for x in way(*p))


def test_small_sheets_take_no_rounds(spark, monkeypatch):
    """Sheets of few edges are worked out in a row each, with the results of the rounds that larger ones take."""
    rnd = random.Random(12)
    rows = [(s, rnd.randint(0, 9), rnd.randint(0, 9)) for s in range(12) for _ in range(2 + s)] + [(50, i, i + 1) for i in range(40)] + [(None, 1, 2)]
    edges = spark.createDataFrame(rows, "sheet_id long, source long, target long")
    nodes = spark.createDataFrame(sorted({(s, n) for s, *ab in rows for n in ab if s is not None}), "sheet_id long, n long")

    def run():
        staged = []
        plain = scale.stage
        monkeypatch.setattr(scale, "stage", lambda df: (staged.append(1), plain(df))[1])
        members = wires.nets(nodes, edges.where("sheet_id IS NOT NULL"))
        found = sorted(map(tuple, members.collect())), len(staged)
        monkeypatch.setattr(scale, "stage", plain)
        return found, sorted(map(tuple, wires.cycle_basis(members, edges.where("sheet_id IS NOT NULL")).collect()))

    (flat, staged), cycles = run()
    assert staged == 2 and len(cycles) > 10
    lone = {r.node: r.root for r in scale.connected_components(edges.selectExpr("sheet_id", "source AS a", "target AS b"), ["sheet_id"]).where("sheet_id IS NULL").collect()}
    assert lone == {1: 1, 2: 2}  # a null key joins nothing
    monkeypatch.setattr(scale, "SMALL", 6)
    (again, rounds), others = run()
    assert again == flat and others == cycles and rounds > 2


def test_small_sheets_build_no_forest(spark, monkeypatch):
    monkeypatch.setattr(wires.forests, "rooted", None)
    edges = spark.createDataFrame([(1, 0, 1), (1, 1, 2), (1, 2, 0), (1, 3, 3), (2, 0, 1)], "sheet_id long, source long, target long")
    members = spark.createDataFrame([(1, 0, 0), (1, 1, 0), (1, 2, 0), (1, 3, 3), (2, 0, 0), (2, 1, 0)], "sheet_id long, n long, root long")
    got = sorted(map(tuple, wires.cycle_basis(members, edges).collect()))
    assert got == [(1, 1, 2, 0), (1, 1, 2, 1), (1, 1, 2, 2), (1, 3, 3, 3)]


@pytest.mark.parametrize("tol", [0.0, 3.0, 9.0])
def test_sheets_in_a_row_are_assembled_like_those_in_rounds(spark, monkeypatch, tol):
    rng = random.Random(int(tol))
    line = lambda s, i: (s, i, *[float(rng.randint(0, 40)) + rng.choice([0.0, 0.5]) for _ in range(4)], rng.choice([0, 1, 2, None]))
    rows = [line(s, i) for s in range(12) for i in range(rng.randint(1, 25))] + [line(40, i) for i in range(scale.SMALL + 9)]
    rows += [(50, i, *[None if i == 1 and k == 0 else float(9 * i + 30 * k) for k in range(4)], 1) for i in range(3)] + [line(None, i) for i in range(3)]

    def found(frames):
        return [sorted(map(tuple, f.select(*c).collect())) for f, c in zip(frames, (["sheet_id", "seg", "a", "b", "s_x", "s_y", "e_x", "e_y", "length", "angle_deg"], ["sheet_id", "n", "x", "y", "ends"]))]

    data = _frame(spark, rows)
    rounds, taken = wires._assemble_rounds, []
    monkeypatch.setattr(wires, "_assemble_rounds", lambda c, *a: taken.append({r.sheet_id for r in c.select("sheet_id").distinct().collect()}) or rounds(c, *a))
    mixed = wires.assemble(data, tol, 5.0)
    assert taken == [{40}]
    first = found(mixed)
    monkeypatch.setattr(scale, "SMALL", 0)
    every = wires.assemble(data, tol, 5.0)
    assert first == found(every) and first[0] and taken[1] >= {0, 40}
    assert [f.dtypes for f in mixed] == [f.dtypes for f in every]


def test_nearest_of_small_sheets_takes_no_rounds(spark, monkeypatch):
    rng = random.Random(9)
    nodes = [(s, float(rng.randint(0, 500)), float(rng.randint(0, 500))) for s, n in ((1, 15), (2, 5), (4, 1)) for _ in range(n)]
    points = [(s, i, x, y, *rng.choice(nodes)[1:]) for i, (s, x, y) in enumerate(nodes)] + [(3, 99, 0.0, 0.0, 1.0, 1.0)]
    frames = spark.createDataFrame(points, "sheet_id int, id int, x double, y double, ox double, oy double"), spark.createDataFrame(nodes, "sheet_id int, x double, y double")
    near, sheets = wires.spatial.near_join, set()
    monkeypatch.setattr(wires.spatial, "near_join", lambda left, *a, **k: sheets.update(r[0] for r in left.select("sheet_id").distinct().collect()) or near(left, *a, **k))
    direct = sorted((r.id, r.nearest) for r in wires.nearest_other(*frames, 10.0).collect())
    assert not sheets
    monkeypatch.setattr(scale, "SMALL", 10)
    mixed = sorted((r.id, r.nearest) for r in wires.nearest_other(*frames, 10.0).collect())
    assert sheets == {1} and direct == mixed and any(d is None for _, d in direct)
