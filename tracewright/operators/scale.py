"""Building blocks that stay whole and even when one key holds much of the data.

* ``slice_by_order`` cuts every group into range slices, so a group larger than a
  task is ranked and summed by many tasks (``running``, ``suffix_max``).
* ``pick`` keeps one row per group with a partial aggregate, not a window.
* ``greedy_independent`` and ``priority_matching`` turn "take the next in order
  unless it conflicts" loops into a few rounds of joins.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.session import shuffle_width, stage

SLICE = "_slice"


def slice_by_order(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Range-partition by (keys, order) and record the slice of every row.

    The slice numbers depend on a sample, so the result is written before any
    other job reads it. `order` must end in a unique column: ties could
    otherwise not be cut, and ranks would not be repeatable.
    """
    n = shuffle_width(df.sparkSession)
    cut = df.repartitionByRange(n, *[F.col(k) for k in keys], *order)
    return stage(cut.withColumn(SLICE, F.spark_partition_id()))


def _slice_heads(sliced: DataFrame, keys: Sequence[str], aggs: list[Column]) -> DataFrame:
    return sliced.groupBy(*keys, SLICE).agg(*aggs)


def beside(rows: DataFrame, facts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join on `keys` in which a null key is a group like any other."""
    named = facts.select(*[F.col(c).alias(f"_on{i}") for i, c in enumerate(keys)], *[c for c in facts.columns if c not in keys])
    same = F.lit(True)
    for i, c in enumerate(keys):
        same = same & rows[c].eqNullSafe(named[f"_on{i}"])
    return rows.join(named, same).drop(*[f"_on{i}" for i in range(len(keys))])


def running(
    sliced: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    values: Mapping[str, Column],
) -> DataFrame:
    """Inclusive running sums per group: sum inside the slice + total of earlier slices."""
    tmp = {name: f"_v_{name}" for name in values}
    base = sliced.withColumns({tmp[n]: c for n, c in values.items()})
    heads = _slice_heads(base, keys, [F.sum(tmp[n]).alias(f"_t_{n}") for n in values])
    # at most one row per slice and group reaches this window
    earlier = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    offsets = heads.select(
        *keys, SLICE, *[F.coalesce(F.sum(f"_t_{n}").over(earlier), F.lit(0)).alias(f"_b_{n}") for n in values]
    )
    inside = Window.partitionBy(*keys, SLICE).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = base.withColumns({n: F.sum(tmp[n]).over(inside) for n in values}).drop(*tmp.values())
    joined = beside(local, offsets, [*keys, SLICE])
    return joined.withColumns({n: F.col(n) + F.col(f"_b_{n}") for n in values}).drop(
        *[f"_b_{n}" for n in values]
    )


def suffix_max(
    sliced: DataFrame, keys: Sequence[str], order: Sequence[Column], value: Column, name: str
) -> DataFrame:
    """Largest value from this row to the end of its group."""
    inside = Window.partitionBy(*keys, SLICE).orderBy(*order)
    base = sliced.withColumns({"_v": value, "_p": F.row_number().over(inside)})
    heads = _slice_heads(base, keys, [F.max("_v").alias("_t")])
    # walking backwards keeps the frame growing; a frame that ends at the group's
    # end would be computed anew for every row
    later = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(F.desc(SLICE)).rowsBetween(Window.unboundedPreceding, -1)
    offsets = heads.select(*keys, SLICE, F.max("_t").over(later).alias("_after"))
    back = Window.partitionBy(*keys, SLICE).orderBy(F.desc("_p")).rowsBetween(Window.unboundedPreceding, 0)
    local = base.withColumn("_m", F.max("_v").over(back))
    return (
        beside(local, offsets, [*keys, SLICE])
        .withColumn(name, F.greatest("_m", "_after"))
        .drop("_v", "_p", "_m", "_after")
    )


def ranked(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str) -> DataFrame:
    """`row_number` per group that no single task has to count through."""
    sliced = slice_by_order(df, keys, order)
    return running(sliced, keys, order, {name: F.lit(1).cast("bigint")}).drop(SLICE)


def pick(df: DataFrame, keys: Sequence[str], by: Sequence[Column], keep: Sequence[str]) -> DataFrame:
    """The row with the smallest `by` per group; combines map-side before shuffling."""
    row = F.struct(*[F.col(c) for c in keep])
    return df.groupBy(*keys).agg(F.min_by(row, F.struct(*by)).alias("_r")).select(*keys, "_r.*")


def top_n(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, name: str = "_rank") -> DataFrame:
    """First n rows per group. Spark trims each task to n rows before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= n)


def renumber(df: DataFrame, order: Sequence[Column], name: str, start: int = 1) -> DataFrame:
    """Dense ids in a total order without sending all rows through one task."""
    out = ranked(df, [], order, name)
    return out if start == 1 else out.withColumn(name, F.col(name) + F.lit(start - 1))


def greedy_independent(nodes: DataFrame, conflicts: DataFrame, node: str) -> DataFrame:
    """Keep the nodes an in-order "take unless it conflicts with a taken one" loop keeps.

    `conflicts` holds (earlier, later) node pairs. A round decides every node without
    an undecided earlier rival, and every node that hangs on such a one through nodes
    with a single earlier rival: along such a ladder each second node is kept. So a
    ladder of any length takes one round; every round decides something.
    """
    pairs = stage(conflicts.select("earlier", "later").distinct())
    dropped = None
    while not pairs.isEmpty():
        decided = stage(_ladder(pairs, node))
        kept, out = decided.where("kept").select(node), decided.where("NOT kept").select(node)
        rivals = pairs.join(kept, pairs["earlier"] == kept[node], "left_semi").select(F.col("later").alias(node))
        lost = stage(rivals.unionByName(out).distinct())
        dropped = lost if dropped is None else dropped.unionByName(lost)
        # a pair whose earlier end is decided, or whose later end is lost, carries no more news
        gone = lost.unionByName(kept).distinct()
        pairs = stage(
            pairs.join(lost.select(F.col(node).alias("later")), "later", "left_anti").join(gone.select(F.col(node).alias("earlier")), "earlier", "left_anti"))
    return nodes if dropped is None else nodes.join(dropped.distinct(), node, "left_anti")


def _ladder(pairs: DataFrame, node: str) -> DataFrame:
    """(node, kept) of free nodes and of the ladders that hang on them, by pointer jumping."""
    rivals = pairs.groupBy("later").agg(F.count(F.lit(1)).alias("n"), F.min("earlier").alias("up"))
    free = pairs.select(F.col("earlier").alias(node)).distinct().join(rivals.select(F.col("later").alias(node)), node, "left_anti")
    steps = stage(rivals.where("n = 1").select(F.col("later").alias("x"), "up", F.lit(1).alias("far")))
    while True:
        beyond = steps.select(F.col("x").alias("up"), F.col("up").alias("up2"), F.col("far").alias("far2"))
        longer = stage(steps.join(beyond, "up", "left").select(
            "x", F.coalesce("up2", "up").alias("up"), (F.col("far") + F.coalesce("far2", F.lit(0))).alias("far"), F.col("up2").isNotNull().alias("moved")))
        steps = longer.drop("moved")
        if longer.where("moved").isEmpty():
            break
    hung = steps.join(free.withColumnRenamed(node, "up"), "up", "left_semi").select(F.col("x").alias(node), (F.col("far") % 2 == 0).alias("kept"))
    return free.withColumn("kept", F.lit(True)).unionByName(hung)


#: Rows of one group that a window in one task may count; larger groups are cut into slices.
GROUP_ROWS = 1_000_000


def placed(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str, largest: int) -> DataFrame:
    """`row_number` per group; `largest` is the size of the largest group, which decides how."""
    if largest > GROUP_ROWS:
        return ranked(df, keys, order, name)
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("bigint"))


def priority_matching(
    pairs: DataFrame, seeker: str, target: str, seeker_rank: Sequence[Column], taste: Sequence[Column], places: Column | None = None,
) -> DataFrame:
    """Seekers choose in rank order their best target that has a place left.

    Deferred acceptance: every seeker asks its best target that has not refused it,
    a target with n places (one, unless `places` says more) holds its n first-ranked
    askers. The stable result is the one the serial loop reaches, and it needs no serial
    pass. Returns (seeker, target) and, with `places`, the place: those of a target are
    counted from 1 in rank order. With `places` no two targets of a seeker may taste the same.
    """
    rank = F.struct(*seeker_rank)
    pairs = stage(pairs.select(
        F.col(seeker).alias("s"), F.col(target).alias("t"), rank.alias("r"), F.struct(*taste).alias("f"), (F.lit(1) if places is None else places).cast("bigint").alias("m")))
    while True:  # every round refuses a pair or ends
        asks = stage(pairs.groupBy("s").agg(F.min_by(F.struct("t", "r", "m"), F.struct("f", "t")).alias("p")).select("s", "p.t", "p.r", "p.m"))
        loads = asks.groupBy("t").agg(F.count(F.lit(1)).alias("n"), F.max("m").alias("m"))
        load = loads.agg(F.count_if(F.col("n") > F.col("m")).alias("over"), F.max("n").alias("largest")).first()
        if not load.over and places is None:
            return asks.select(F.col("s").alias(seeker), F.col("t").alias(target))
        if not load.over:
            place = placed(asks, ["t"], [F.col("r")], "place", load.largest or 0)
            return place.select(F.col("s").alias(seeker), F.col("t").alias(target), "place")
        crowded = asks.join(loads.where(F.col("n") > F.col("m")).select("t"), "t", "left_semi")
        refused = placed(crowded, ["t"], [F.col("r")], "place", load.largest).where(F.col("place") > F.col("m")).select("s", "t")
        pairs = stage(pairs.join(refused, ["s", "t"], "left_anti"))


def previous(
    sliced: DataFrame, keys: Sequence[str], order: Sequence[Column], value: str, name: str
) -> DataFrame:
    """Value of the row before, also when that row lies in an earlier slice.

    The order columns must be ascending columns of the frame.
    """
    inside = Window.partitionBy(*keys, SLICE).orderBy(*order)
    tails = sliced.groupBy(*keys, SLICE).agg(F.max_by(value, F.struct(*order)).alias("_tail"))
    before = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(SLICE)
    heads = tails.select(*keys, SLICE, F.lag("_tail").over(before).alias("_prior"))
    local = sliced.withColumns({"_lag": F.lag(value).over(inside), "_first": F.row_number().over(inside) == 1})
    return (
        beside(local, heads, [*keys, SLICE])
        .withColumn(name, F.when(F.col("_first"), F.col("_prior")).otherwise(F.col("_lag")))
        .drop("_lag", "_first", "_prior")
    )


def ordered_pairing(pairs: DataFrame, taste: Sequence[Column]) -> DataFrame:
    """Pairs an in-order loop makes when seekers and targets may be the same tokens.

    `pairs(i, j)`: seeker i, in ascending order, takes its best still unused j and
    both are used up. A round settles every seeker that comes first among all
    seekers touching it or its candidates; such seekers cannot disturb each other.
    """
    left = stage(pairs.select("i", "j", F.struct(*taste).alias("f")))
    made = None
    while not left.isEmpty():  # the first seeker of all is ready in every round
        touch = left.select("i", F.col("j").alias("n")).unionByName(left.select("i", F.col("i").alias("n"))).distinct()
        first = touch.groupBy("n").agg(F.min("i").alias("m"))
        waits = touch.join(first, "n").where("i <> m").select("i").distinct()
        ready = left.join(waits, "i", "left_anti")
        picks = stage(ready.groupBy("i").agg(F.min_by("j", F.struct("f", "j")).alias("j")))
        made = picks if made is None else made.unionByName(picks)
        used = picks.select(F.explode(F.array("i", "j")).alias("n"))
        left = stage(
            left.join(used.withColumnRenamed("n", "i"), "i", "left_anti").join(used.withColumnRenamed("n", "j"), "j", "left_anti"))
    return pairs.select("i", "j").limit(0) if made is None else made


#: Edges of a group that are worked out at once in one row; larger groups take rounds of joins.
SMALL = 64


def small_groups(edges: DataFrame, on: Sequence[str]) -> tuple[DataFrame, DataFrame | None]:
    """(*on, edges) with the sorted distinct edges of every group of at most SMALL rows, and the rows of all other groups.

    `edges(*on, a, b)` is read twice. None stands for no other groups; groups with a null key are among the others.
    """
    on = list(on)
    named = F.lit(True)
    for k in on:
        named = named & F.col(k).isNotNull()
    large = stage(edges.groupBy(*on).agg(F.count(F.lit(1)).alias("_n")).where((F.col("_n") > SMALL) | ~named).drop("_n"))
    row = lambda df: df.groupBy(*on).agg(F.sort_array(F.collect_set(F.struct("a", "b"))).alias("edges"))
    if large.isEmpty():
        return row(edges), None
    return row(edges.where(named).join(large, on, "left_anti")), edges.join(large.where(named), on, "left_semi").unionByName(edges.where(~named))


def bound(values: dict[str, Column], body: Callable[[Column], Column]) -> Column:
    """`body` of a struct of `values`, which are worked out once."""
    return F.get(F.transform(F.array(F.struct(*[c.alias(k) for k, c in values.items()])), body), F.lit(0))


def _small_components(groups: DataFrame, on: Sequence[str]) -> DataFrame:
    """(*on, node, root): the edges of a row are taken one by one, each gives the larger of two roots the name of the smaller."""
    nodes = groups.select(*on, "edges", F.array_distinct(F.concat("edges.a", "edges.b")).alias("nodes"))
    root = lambda roots, n: F.get(roots, F.array_position(F.col("nodes"), n).cast("int") - 1)
    joined = lambda roots, e: bound(
        {"low": F.least(root(roots, e["a"]), root(roots, e["b"])), "high": F.greatest(root(roots, e["a"]), root(roots, e["b"]))},
        lambda x: F.transform(roots, lambda r: F.when(r == x["high"], x["low"]).otherwise(r)))
    roots = nodes.select(*on, "nodes", F.aggregate("edges", F.col("nodes"), joined).alias("roots"))
    return roots.select(*on, F.explode(F.arrays_zip(F.col("nodes").alias("node"), F.col("roots").alias("root"))).alias("x")).select(*on, F.col("x.node").alias("node"), F.col("x.root").alias("root"))


def connected_components(edges: DataFrame, on: Sequence[str] = ()) -> DataFrame:
    """(*on, node, root): smallest node of the connected component, for every node of `edges(*on, a, b)`.

    `on` names outer keys no edge crosses; groups of few edges are worked out in a row each, the others in rounds.
    """
    if not on:
        return _component_rounds(edges, on)
    groups, others = small_groups(stage(edges.select(*on, "a", "b")), on)
    small = _small_components(groups, on)
    return small if others is None else small.unionByName(_component_rounds(others, on))


def _component_rounds(edges: DataFrame, on: Sequence[str]) -> DataFrame:
    """The components of groups of any size.

    Alternates two steps that hang each node's larger neighbours, then its smaller
    ones, on the smallest; paths shrink geometrically and a hub only ever needs a
    minimum, which combines before the shuffle.
    """
    on = list(on)
    e = stage(edges.select(*on, F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    pair = lambda u, v: F.struct(F.col(u).alias("u"), F.col(v).alias("v"))
    while True:
        # done when every edge hangs a node on a root: one parent each, and no parent hangs itself
        sides = F.explode(F.array(
            F.struct(F.col("u").alias("n"), F.lit(1).alias("child"), F.lit(0).alias("parent")),
            F.struct(F.col("v").alias("n"), F.lit(0).alias("child"), F.lit(1).alias("parent"))))
        role = e.select(*on, sides.alias("s")).select(*on, "s.*").groupBy(*on, "n").agg(F.sum("child").alias("c"), F.max("parent").alias("p"))
        if role.where("c > 1 OR (c > 0 AND p > 0)").isEmpty():
            break
        both = e.select(*on, F.explode(F.array(pair("u", "v"), pair("v", "u"))).alias("h")).select(*on, "h.*")
        low = both.groupBy(*on, "u").agg(F.min("v").alias("m")).select(*on, "u", F.least("u", "m").alias("m"))
        down = both.join(low, [*on, "u"]).where("v > u").select(*on, F.col("v").alias("u"), F.col("m").alias("v"))
        low2 = down.groupBy(*on, "u").agg(F.min("v").alias("m"))
        small = down.join(low2, [*on, "u"])
        hang = F.explode(F.array(pair("u", "m"), pair("v", "m"))).alias("h")
        e = stage(small.select(*on, hang).select(*on, "h.*").where("u <> v").distinct())
    nodes = edges.select(*on, F.explode(F.array("a", "b")).alias("node")).distinct()
    return nodes.join(e.select(*on, F.col("u").alias("node"), F.col("v").alias("root")), [*on, "node"], "left").withColumn(
        "root", F.coalesce("root", "node"))
