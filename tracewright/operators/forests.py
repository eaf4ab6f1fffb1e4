"""Forests in a number of rounds that grows with the logarithm of their size, whatever their depth.

Edges are (*on, a, b) with a < b, each once; `on` names outer keys that no edge crosses.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.operators import scale
from tracewright.session import stage


def first_forest(edges: DataFrame, on: Sequence[str]) -> DataFrame:
    """(*on, a, b): the edges that do not close a circle of edges before them, in the order of (a, b).

    Every component takes its first edge that leads out of it, which halves their
    number at least; as no two edges are equal in order, the edges taken close no circle.
    """
    on = list(on)
    left = stage(edges.select(*on, "a", "b", F.col("a").alias("ca"), F.col("b").alias("cb")))
    forest = None
    while True:
        side = lambda c: left.select(*on, F.col(c).alias("c"), F.struct("a", "b", "ca", "cb").alias("e"))
        first = side("ca").unionByName(side("cb")).groupBy(*on, "c").agg(F.min("e").alias("e"))
        taken = stage(first.select(*on, "e.*").distinct())
        if taken.isEmpty():
            return edges.select(*on, "a", "b").limit(0) if forest is None else forest
        own = taken.select(*on, "a", "b")
        forest = own if forest is None else forest.unionByName(own)
        joined = stage(scale.connected_components(taken.select(*on, F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")), on))
        name = lambda c: joined.select(*on, F.col("node").alias(c), F.col("root").alias(f"_{c}"))  # noqa: E731, B023
        moved = left.join(name("ca"), [*on, "ca"]).join(name("cb"), [*on, "cb"])
        left = stage(moved.where("_ca <> _cb").select(*on, "a", "b", F.col("_ca").alias("ca"), F.col("_cb").alias("cb")))


def rooted(forest: DataFrame, members: DataFrame, on: Sequence[str]) -> DataFrame:
    """(*on, n, parent, depth) of all `members(*on, n, root)`, the trees hung on their roots.

    A tour walks every edge both ways: behind the way u to v comes the way from v to the
    neighbour after u. Pointer jumping over the tour, which ends before it comes to the
    root's first neighbour again, tells how far each way is from the end. The way that
    comes first leads down, and a running sum of ways down and up is the depth.
    """
    on = list(on)
    ways = stage(forest.select(*on, F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("w")).select(*on, "w.*"))
    degrees = stage(ways.groupBy(*on, F.col("u").alias("v")).agg(F.count(F.lit(1)).alias("m"), F.min("v").alias("first")))
    largest = degrees.agg(F.max("m")).first()[0] or 0
    numbered = stage(scale.placed(ways, [*on, "u"], [F.col("v")], "k", largest))
    after = numbered.select(*on, F.col("u").alias("v"), F.col("v").alias("w"), (F.col("k") - 1).alias("k"))  # w stands after number k of v
    into = numbered.select(*on, F.col("u").alias("v"), F.col("v").alias("u"), "k")  # u is number k of v, seen from the way u to v
    roots = members.select(*on, F.col("n").alias("v"), "root")
    turned = into.join(after, [*on, "v", "k"], "left").join(degrees, [*on, "v"]).join(roots, [*on, "v"])
    # behind the last neighbour comes the first again, but at the root the tour is over
    last = F.col("w").isNull()
    state = stage(turned.select(
        *on, "root", "u", "v", F.when(~last, F.col("w")).when(F.col("v") != F.col("root"), F.col("first")).alias("w"), F.lit(1).cast("bigint").alias("far")).select(
        *on, "root", "u", "v", F.when(F.col("w").isNotNull(), F.col("v")).alias("nu"), F.col("w").alias("nv"), "far"))
    while True:
        ahead = state.select(*on, F.col("u").alias("nu"), F.col("v").alias("nv"), F.col("nu").alias("nu2"), F.col("nv").alias("nv2"), F.col("far").alias("far2"))
        done = state.where("nu IS NULL")
        jumped = state.where("nu IS NOT NULL").join(ahead, [*on, "nu", "nv"]).select(
            *on, "root", "u", "v", F.col("nu2").alias("nu"), F.col("nv2").alias("nv"), (F.col("far") + F.col("far2")).alias("far"))
        state = stage(done.unionByName(jumped))
        if state.where("nu IS NOT NULL").isEmpty():
            break
    back = state.select(*on, F.col("u").alias("v"), F.col("v").alias("u"), F.col("far").alias("other"))
    order = [F.col("at")]
    tour = state.join(back, [*on, "u", "v"]).select(*on, "root", "u", "v", (-F.col("far")).alias("at"), (F.col("far") > F.col("other")).alias("down"))
    sliced = scale.slice_by_order(tour, [*on, "root"], order)
    depth = scale.running(sliced, [*on, "root"], order, {"depth": F.when(F.col("down"), 1).otherwise(-1).cast("bigint")})
    hung = depth.where("down").select(*on, F.col("v").alias("n"), F.col("u").alias("parent"), F.col("depth").cast("int").alias("depth"))
    top = members.where("n = root").select(*on, "n", F.lit(None).cast("bigint").alias("parent"), F.lit(0).alias("depth"))
    return top.unionByName(hung)


def lifts(tree: DataFrame, on: Sequence[str]) -> list[DataFrame]:
    """Tables (*on, n, up): number k names the ancestor 2^k steps up of every node that has one."""
    out, table = [], stage(tree.where("parent IS NOT NULL").select(*on, "n", F.col("parent").alias("up")))
    while not table.isEmpty():
        out.append(table)
        above = table.select(*on, F.col("n").alias("up"), F.col("up").alias("up2"))
        table = stage(table.join(above, [*on, "up"]).select(*on, "n", F.col("up2").alias("up")))
    return out


def _lifted(rows: DataFrame, table: DataFrame, on: Sequence[str], node: str) -> DataFrame:
    """`rows` with `_up`, the ancestor of `node` that the table names, or null."""
    return rows.join(table.select(*on, F.col("n").alias(node), F.col("up").alias("_up")), [*on, node], "left")


def paths(pairs: DataFrame, tree: DataFrame, on: Sequence[str]) -> DataFrame:
    """(*on, a, b, n): the nodes on the way from a to b in one tree, both ends included.

    The deeper end climbs by powers of two to the depth of the other, then both climb as
    long as their ancestors differ. The ways to the node where they meet are listed by
    halving them, so the rows grow only with what is listed.
    """
    on = list(on)
    up = lifts(tree, on)
    depth = lambda c: tree.select(*on, F.col("n").alias(c), F.col("depth").alias(f"{c}_d"))
    both = pairs.select(*on, "a", "b").join(depth("a"), [*on, "a"]).join(depth("b"), [*on, "b"])
    deeper = F.col("a_d") >= F.col("b_d")
    walk = stage(both.select(*on, "a", "b", "a_d", "b_d", F.when(deeper, F.col("a")).otherwise(F.col("b")).alias("x"), F.when(deeper, F.col("b")).otherwise(F.col("a")).alias("y"),
                             F.abs(F.col("a_d") - F.col("b_d")).cast("bigint").alias("gap")))
    for k in range(len(up) - 1, -1, -1):
        step = _lifted(walk, up[k], on, "x").withColumn("x", F.when(F.col("gap") >= 2**k, F.col("_up")).otherwise(F.col("x"))).drop("_up")
        walk = stage(step.withColumn("gap", F.when(F.col("gap") >= 2**k, F.col("gap") - 2**k).otherwise(F.col("gap"))))
    for k in range(len(up) - 1, -1, -1):
        step = _lifted(walk, up[k], on, "x").withColumnRenamed("_up", "_x")
        step = _lifted(step, up[k], on, "y").withColumnRenamed("_up", "_y")
        apart = F.coalesce(F.col("_x") != F.col("_y"), F.lit(False))
        walk = stage(step.select(*on, "a", "b", "a_d", "b_d", F.when(apart, F.col("_x")).otherwise(F.col("x")).alias("x"), F.when(apart, F.col("_y")).otherwise(F.col("y")).alias("y")))
    met = tree.select(*on, F.col("n").alias("x"), F.col("depth").alias("x_d"))
    # the ends met, or they are children of the node where they meet
    height = F.col("x_d") - F.when(F.col("x") == F.col("y"), 0).otherwise(1)
    ends = walk.join(met, [*on, "x"]).select(*on, "a", "b", F.explode(F.array(
        F.struct(F.col("a").alias("n"), (F.col("a_d") - height + 1).cast("bigint").alias("c")), F.struct(F.col("b").alias("n"), (F.col("b_d") - height).cast("bigint").alias("c")))).alias("s"))
    ways = stage(ends.select(*on, "a", "b", "s.n", "s.c").where("c > 0"))
    for k in range(len(up) - 1, -1, -1):
        half = F.lit(2**k).cast("bigint")
        cut = _lifted(ways, up[k], on, "n")
        parts = F.when(F.col("c") > half, F.array(F.struct("n", half.alias("c")), F.struct(F.col("_up").alias("n"), (F.col("c") - half).alias("c")))).otherwise(F.array(F.struct("n", "c")))
        ways = stage(cut.select(*on, "a", "b", F.explode(parts).alias("s")).select(*on, "a", "b", "s.*"))
    return ways.select(*on, "a", "b", "n")


def closed_ways(groups: DataFrame, on: Sequence[str]) -> DataFrame:
    """(*on, a, b, n): for every edge (a, b) that closes a circle of edges before it, the nodes on the way from a to b over those.

    `groups(*on, edges)` holds the edges of a small group in one row, in order. They are taken one by one;
    every node keeps its way to the root of its tree, and an edge between two trees hangs one on the other.
    """
    on = list(on)
    nodes = groups.select(*on, "edges", F.array_distinct(F.concat("edges.a", "edges.b")).alias("nodes"))
    way = lambda ways, n: F.get(ways, F.array_position(F.col("nodes"), n).cast("int") - 1)
    # ways share their last nodes, from the node where they meet on
    between = lambda p, q: F.concat(F.array_except(p, q), F.slice(p, F.size(F.array_except(p, q)) + 1, 1), F.reverse(F.array_except(q, p)))

    def taken(state: Column, e: Column) -> Column:
        def add(x: Column) -> Column:
            moved = F.transform(x["ways"], lambda w: F.when(F.element_at(w, -1) == F.element_at(x["q"], -1), F.concat(between(w, x["q"]), x["p"])).otherwise(w))
            closes = F.element_at(x["p"], -1) == F.element_at(x["q"], -1)
            found = F.array(F.struct(x["a"].alias("a"), x["b"].alias("b"), between(x["p"], x["q"]).alias("way")))
            return F.struct(F.when(closes, x["ways"]).otherwise(moved).alias("ways"), F.when(closes, F.concat(x["out"], found)).otherwise(x["out"]).alias("out"))

        return scale.bound({"ways": state["ways"], "out": state["out"], "a": e["a"], "b": e["b"], "p": way(state["ways"], e["a"]), "q": way(state["ways"], e["b"])}, add)

    kind = groups.schema["edges"].dataType.elementType["a"].dataType.simpleString()
    start = F.struct(F.transform("nodes", lambda n: F.array(n)).alias("ways"), F.array().cast(f"array<struct<a:{kind},b:{kind},way:array<{kind}>>>").alias("out"))
    done = nodes.select(*on, F.explode(F.aggregate("edges", start, taken, lambda s: s["out"])).alias("c"))
    return done.select(*on, "c.a", "c.b", F.explode("c.way").alias("n"))
