"""Trie of conversation prefixes by ternary search trees.

Distinct turn sequences are range-partitioned in lexicographic order. A shard reads
its range in blocks, codes the turns by their order, and inserts the sequences of a
block into a ternary search tree, middle first and then the middles of both halves.
One walk with a stack lists its nodes, one pass back adds up members, leaves and
savings. Only nodes on the paths to the first and the last sequence of a block may
stand in other blocks too; these boundary nodes are merged by the hash of their path.

Sequences are cut into segments of a fixed number of turns. Segments of one number are
a layer; the deepest layer is done first and hands the sums of its roots up, so that
the length of a conversation bounds no task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.llm.common import column, record
from tracewright.operators.scale import ranked
from tracewright.session import shuffle_width, stage

#: Copies of a boundary node that its children are spread over when they ask for its member.
SALTS = 16


@dataclass(frozen=True)
class Limits:
    """Turns of a segment; sequences and turns that a block holds at most. They bound memory, not what is found."""

    segment: int = 256
    block_sequences: int = 20_000
    block_turns: int = 400_000


def number_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, at, k1, k2, size of every turn: its place from 0, 128 bits of role and text, code points of its text.

    Order: by turn, nulls first, then by the hash. Null roles and texts are empty;
    rows without conv_id belong to no conversation.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    rows = conversations.where("conv_id IS NOT NULL").select(
        "conv_id", "turn", F.xxhash64(role, text).alias("k1"), F.xxhash64(F.lit(1), role, text).alias("k2"), F.char_length(text).cast("long").alias("size"))
    placed = ranked(rows, ["conv_id"], [F.col("turn").asc_nulls_first(), F.col("k1"), F.col("k2"), F.col("size")], "at")
    return placed.select("conv_id", (F.col("at") - 1).alias("at"), "k1", "k2", "size")


# --- one block -----------------------------------------------------------------------


@dataclass
class Sequence:
    """Turns (k1, k2, size) of one distinct segment with what ends or goes on there."""

    turns: list[tuple[int, int, int]]
    n: int
    low: int
    own: int | None = None
    below: tuple[int, int, int] | None = None  # children, leaves, savings of the layer below


@dataclass
class Tree:
    """Ternary search tree over codes; node 0 is the textless root."""

    code: list[int] = field(default_factory=lambda: [-1])
    less: list[int] = field(default_factory=lambda: [0])
    more: list[int] = field(default_factory=lambda: [0])
    next: list[int] = field(default_factory=lambda: [0])
    ends: dict[int, int] = field(default_factory=dict)

    def _new(self, code: int) -> int:
        for side, value in ((self.code, code), (self.less, 0), (self.more, 0), (self.next, 0)):
            side.append(value)
        return len(self.code) - 1

    def insert(self, codes: list[int], number: int) -> None:
        at = 0
        for c in codes:
            side, parent = self.next, at
            at = side[parent]
            while at and self.code[at] != c:
                side, parent = (self.less if c < self.code[at] else self.more), at
                at = side[parent]
            if not at:
                at = side[parent] = self._new(c)
        self.ends[at] = number

    def walk(self) -> Iterator[tuple[int, int, int]]:
        """(node, parent in the trie, depth), parents first."""
        stack = [(0, -1, 0)]
        while stack:
            x, up, depth = stack.pop()
            yield x, up, depth
            if x:
                stack += [(y, up, depth) for y in (self.less[x], self.more[x]) if y]
            if self.next[x]:
                stack.append((self.next[x], x, depth + 1))


def middles(n: int) -> Iterator[int]:
    """0 .. n - 1, the middle first, then those of both halves."""
    stack = [(0, n)]
    while stack:
        a, b = stack.pop()
        if a < b:
            m = (a + b) // 2
            yield m
            stack += [(m + 1, b), (a, m)]


def build(sequences: list[Sequence]) -> tuple[Tree, list[tuple[int, int, int]]]:
    """Tree of distinct sequences in ascending order, and the turn of each code."""
    turns = sorted({t for s in sequences for t in s.turns})
    code = {t: i for i, t in enumerate(turns)}
    tree = Tree()
    for i in middles(len(sequences)):
        tree.insert([code[t] for t in sequences[i].turns], i)
    return tree, turns


_OUT = pa.schema([
    ("edge", pa.bool_()), ("depth", pa.int64()), ("key", pa.binary()), ("parent_key", pa.binary()), ("up", pa.list_(pa.binary())),
    ("p1", pa.int64()), ("p2", pa.int64()), ("conv_id", pa.int64()), ("parent_conv_id", pa.int64()), ("own", pa.int64()), ("size", pa.int64()),
    ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64())])
_KINDS = (
    "edge boolean, depth long, key binary, parent_key binary, up array<binary>, p1 long, p2 long, conv_id long, parent_conv_id long, own long, size long, "
    "n_convs long, n_children long, n_leaves long, saved_tokens long")


def _digest(parent: bytes, turn: tuple[int, int, int]) -> bytes:
    return hashlib.blake2b(parent + ("%d,%d,%d" % turn).encode(), digest_size=16).digest()


def nodes_of(sequences: list[Sequence], base: int, root: tuple[int, int], root_low: int | None, first: bool, last: bool) -> Iterator[tuple]:
    """Rows of `_OUT` for one root, at depth `base`, of a block; `first` and `last` tell whether the block begins or ends within it.

    A boundary row holds the sums of its other children only: those on the boundary are rows too.
    """
    tree, turns = build(sequences)
    order = list(tree.walk())
    size = len(tree.code)
    up, depth = [0] * size, [0] * size
    for x, parent, d in order:
        up[x], depth[x] = parent, d
    keys: dict[int, bytes] = {0: hashlib.blake2b(f"{base},{root[0]},{root[1]}".encode(), digest_size=16).digest()}
    code = {t: i for i, t in enumerate(turns)}
    for wanted, sequence in ((first, sequences[0]), (last, sequences[-1])):
        at = 0
        for t in sequence.turns if wanted else ():
            parent, at, c = at, tree.next[at], code[t]
            while tree.code[at] != c:
                at = tree.less[at] if c < tree.code[at] else tree.more[at]
            keys[at] = _digest(keys[parent], t)
    n, low, children, leaves, saved = [0] * size, [None] * size, [0] * size, [0] * size, [0] * size
    own: list = [None] * size
    for x, i in tree.ends.items():
        s = sequences[i]
        n[x], low[x], own[x] = s.n, s.low, s.own
        if s.below:
            children[x], leaves[x], saved[x] = s.below
    for x, parent, _ in reversed(order):
        edge = x in keys
        if not edge:
            leaves[x] += not children[x]
            saved[x] += (n[x] - 1) * turns[tree.code[x]][2]
        if parent >= 0:
            n[parent] += n[x]
            low[parent] = low[x] if low[parent] is None else min(low[parent], low[x])
            if not edge:
                children[parent] += 1
                leaves[parent] += leaves[x]
                saved[parent] += saved[x]
    if root_low is not None:
        low[0] = root_low
    for x, parent, d in order:
        edge = x in keys
        above: list[bytes] = []
        if edge:
            y = parent
            while y >= 0:
                above.append(keys[y])
                y = up[y]
        yield (
            edge, base + d, keys.get(x), keys.get(parent), above if edge else None, *(root if x == 0 else (None, None)), low[x],
            None if edge or parent in keys else low[parent], own[x], 0 if x == 0 else turns[tree.code[x]][2], n[x], children[x], leaves[x], saved[x])


def _sequences(batches) -> Iterator[tuple[tuple[int, int], int | None, Sequence]]:
    for b in batches:
        lists = column(b, "turns")
        ends = np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        values = lists.flatten()
        turns = list(zip(*[values.field(i).to_pylist() for i in range(3)]))
        at = 0
        rows = zip(ends.tolist(), *[column(b, c).to_pylist() for c in ("p1", "p2", "root_low", "n", "low", "own", "b_children", "b_leaves", "b_saved")])
        for end, p1, p2, root_low, n, low, own, *below in rows:
            yield (p1, p2), root_low, Sequence(turns[at:end], n, low, own, None if below[0] is None else tuple(below))
            at = end


def _blocks(rows, limits: Limits) -> Iterator[list]:
    held, turns = [], 0
    for row in rows:
        if held and (len(held) >= limits.block_sequences or turns + len(row[2].turns) > limits.block_turns):
            yield held
            held, turns = [], 0
        held.append(row)
        turns += len(row[2].turns)
    if held:
        yield held


def _shard(base: int, limits: Limits):
    def run(batches):
        for block in _blocks(_sequences(batches), limits):
            groups = [(k, list(g)) for k, g in groupby(block, key=lambda r: r[0])]
            out: list[tuple] = []
            for i, (root, rows) in enumerate(groups):
                for row in nodes_of([s for *_, s in rows], base, root, rows[0][1], i == 0, i == len(groups) - 1):
                    out.append(row)
                    if len(out) == 20_000:
                        yield record(_OUT, **dict(zip(_OUT.names, zip(*out))))
                        out = []
            if out:
                yield record(_OUT, **dict(zip(_OUT.names, zip(*out))))

    return run


# --- all blocks ----------------------------------------------------------------------

_ROW = ["depth", "conv_id", "parent_conv_id", "own", "n_convs", "n_children", "n_leaves", "saved_tokens"]


def _merged(edges: DataFrame) -> DataFrame:
    """Boundary nodes of all blocks, each once, with the sums over its whole subtree."""
    once = [F.first(c).alias(c) for c in ("depth", "parent_key", "up", "p1", "p2", "size")]
    nodes = stage(edges.groupBy("key").agg(
        *once, F.min("conv_id").alias("conv_id"), F.min("own").alias("own"), *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]))
    below = nodes.where("parent_key IS NOT NULL").groupBy(F.col("parent_key").alias("key")).agg(F.count(F.lit(1)).alias("more"))
    children = F.col("n_children") + F.coalesce("more", F.lit(0))
    nodes = stage(nodes.join(below, "key", "left").withColumn("n_children", children).drop("more"))
    own = nodes.select(
        F.explode(F.concat("up", F.array("key"))).alias("key"), (F.col("n_leaves") + (F.col("n_children") == 0).cast("long")).alias("l"),
        (F.col("saved_tokens") + (F.col("n_convs") - 1) * F.col("size")).alias("s"))
    sums = own.groupBy("key").agg(F.sum("l").alias("n_leaves"), F.sum("s").alias("saved_tokens"))
    parents = nodes.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
    return stage(nodes.drop("n_leaves", "saved_tokens", "up").join(sums, "key").join(parents, "parent_key", "left"))


def _layer(rows: DataFrame, base: int, limits: Limits) -> tuple[DataFrame, DataFrame]:
    """Nodes of one layer but its roots, and its roots with p1, p2."""
    order = ["p1", "p2", "turns"]
    dealt = rows.repartitionByRange(shuffle_width(rows.sparkSession), *order).sortWithinPartitions(*order)
    found = stage(dealt.mapInArrow(_shard(base, limits), _KINDS))
    edges = _merged(found.where("edge"))
    known = found.where("NOT edge AND parent_key IS NULL").select(*_ROW)
    salt = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    parents = edges.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("_up"), salt.alias("salt"))
    hung = found.where("NOT edge AND parent_key IS NOT NULL").withColumn("salt", F.pmod("conv_id", F.lit(SALTS)).cast("int"))
    hung = hung.join(parents, ["parent_key", "salt"]).withColumn("parent_conv_id", F.col("_up")).select(*_ROW)
    inner = edges.where("p1 IS NULL").select(*_ROW)
    return known.unionByName(hung).unionByName(inner), edges.where("p1 IS NOT NULL")


def _segments(turns: DataFrame, length: int) -> DataFrame:
    """seg, p1, p2, turns, conv_id, last, e1, e2, n1, n2: segments with the keys of what comes before, their own and those behind."""
    at = F.col("at")
    parts = turns.groupBy("conv_id", F.coalesce(F.floor(at / length), F.lit(0)).alias("seg")).agg(
        F.array_sort(F.collect_list(F.when(at.isNotNull(), F.struct("at", "k1", "k2", "size")))).alias("x"))
    parts = parts.select("conv_id", "seg", F.transform("x", lambda t: F.struct(t["k1"].alias("k1"), t["k2"].alias("k2"), t["size"].alias("size"))).alias("turns"))
    # 44 bits each, so that sums over a million segments fit
    own = [F.shiftrightunsigned(F.xxhash64(F.lit(i), "seg", "turns"), 20).alias(f"e{i}") for i in (1, 2)]
    before = Window.partitionBy("conv_id").orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("*", *own).select(
        "*", *[F.coalesce(F.sum(f"e{i}").over(before), F.lit(0)).alias(f"p{i}") for i in (1, 2)],
        (F.col("seg") == F.max("seg").over(Window.partitionBy("conv_id"))).alias("last"))
    return parts.select("*", *[(F.col(f"p{i}") + F.col(f"e{i}")).alias(f"n{i}") for i in (1, 2)])


def _ends(segments: DataFrame) -> DataFrame:
    """own, ends_sha256 for each sequence that conversations end with; `own` is the smallest of their ids.

    The hash runs over the ids in order, so equal conversations are read by one task, as a stream.
    """
    key = ["seg", "p1", "p2", "e1", "e2"]
    kinds = pa.schema([("own", pa.int64()), ("ends_sha256", pa.string())])

    def run(batches):
        ids = (zip(*[column(b, c).to_pylist() for c in (*key, "conv_id")]) for b in batches)
        out = []
        for _, rows in groupby((r for b in ids for r in b), key=lambda r: r[:5]):
            own = next(rows)[5]
            sha = hashlib.sha256(str(own).encode())
            for r in rows:
                sha.update(b",%d" % r[5])
            out.append((own, sha.hexdigest()))
            if len(out) == 10_000:
                yield record(kinds, own=[o for o, _ in out], ends_sha256=[h for _, h in out])
                out = []
        if out:
            yield record(kinds, own=[o for o, _ in out], ends_sha256=[h for _, h in out])

    ended = segments.where("last").select(*key, "conv_id")
    return ended.repartition(*key).sortWithinPartitions(*key, "conv_id").mapInArrow(run, "own long, ends_sha256 string")


def prefix_trie(turns: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """One row per node of the trie of all conversations.

    `turns` is (conv_id, at, k1, k2, size) as `number_turns` gives it, `at` dense from
    0 in each conversation; a row with null `at` stands for a conversation without
    turns and is no turn. Result: conv_id, the smallest member; depth; parent_conv_id,
    null for the root; n_convs, members; n_children; n_leaves, childless nodes of the
    subtree; saved_tokens, over the subtree the code points that sharing saves;
    ends_sha256 of the ids that end there, ascending, with commas. The root has depth 0.
    Without conversations there is no row.
    """
    segments = stage(_segments(turns, limits.segment))
    kinds = stage(segments.groupBy("seg", "p1", "p2", "e1", "e2").agg(
        F.first("turns").alias("turns"), F.first("n1").alias("n1"), F.first("n2").alias("n2"), F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("low"),
        F.min(F.when(F.col("last"), F.col("conv_id"))).alias("own")))
    deepest = kinds.agg(F.max("seg")).first()[0] or 0
    nodes, roots = None, None
    for layer in range(deepest, -1, -1):
        rows = kinds.where(F.col("seg") == layer).select("p1", "p2", "turns", "n", "low", "own", "n1", "n2")
        if roots is None:
            rows = rows.select("*", *[F.lit(None).cast("long").alias(f"b_{c}") for c in ("children", "leaves", "saved")])
        else:
            below = roots.select(
                F.col("p1").alias("n1"), F.col("p2").alias("n2"), F.col("n_children").alias("b_children"), F.col("n_leaves").alias("b_leaves"), F.col("saved_tokens").alias("b_saved"))
            rows = rows.join(below, ["n1", "n2"], "left")
        if layer:
            above = kinds.where(F.col("seg") == layer - 1).select(F.col("n1").alias("p1"), F.col("n2").alias("p2"), F.col("low").alias("root_low"))
            rows = rows.join(above, ["p1", "p2"])
        else:
            rows = rows.withColumn("root_low", F.lit(None).cast("long"))
        inner, roots = _layer(rows.drop("n1", "n2"), layer * limits.segment, limits)
        nodes = inner if nodes is None else nodes.unionByName(inner)
    nodes = nodes.unionByName(roots.select(*_ROW))
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    ended = nodes.where("own IS NOT NULL").join(_ends(segments), "own").select(*names, "ends_sha256")
    passed = nodes.where("own IS NULL").select(*names, F.sha2(F.lit(""), 256).alias("ends_sha256"))
    return ended.unionByName(passed)


def whole_conversations(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """`turns` with a row of null `at` for every conversation of `convs`."""
    return turns.unionByName(convs.select("conv_id", *[F.lit(None).cast("long").alias(c) for c in ("at", "k1", "k2", "size")]))


def with_shared_heads(turns: DataFrame, leader: Column, head: Column, longest: int) -> DataFrame:
    """Turns of conversations rebuilt: the first `head` turns (at most `longest`) of the conversation `leader`, then the own turns after the first `head`.

    `leader` and `head` are expressions over conv_id. Conversations left without turns have a row with null `at`.
    """
    turns = stage(turns)
    convs = turns.select("conv_id").distinct().withColumns({"leader": leader, "head": head})
    heads = turns.where(F.col("at") < longest).select(F.col("conv_id").alias("leader"), "at", "k1", "k2", "size")
    lent = convs.join(heads, "leader").where(F.col("at") < F.col("head")).select("conv_id", "at", "k1", "k2", "size")
    known = heads.groupBy("leader").agg(F.count(F.lit(1)).alias("known"))
    kept = turns.withColumns({"leader": leader, "head": head}).where(F.col("at") >= F.col("head")).join(known, "leader", "left")
    kept = kept.withColumn("at", F.col("at") - F.col("head") + F.least("head", F.coalesce("known", F.lit(0))))
    return whole_conversations(lent.unionByName(kept.select("conv_id", "at", "k1", "k2", "size")), convs)


#: The query in SQL: conversations with heads of up to five turns shared by each hundred.
CHECK = r"""
WITH turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS at, [coalesce(role, ''), coalesce(text, '')] AS t
  FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT DISTINCT conv_id FROM turns),
convs AS (
  SELECT conv_id, conv_id - conv_id % 100 AS leader, xor(4294967295, list_reduce(
    list_prepend(4294967295, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
    lambda crc, b: list_reduce(list_prepend(xor(crc, b), [0, 1, 2, 3, 4, 5, 6, 7]),
      lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END))) % 6 AS h FROM ids),
rebuilt AS (
  SELECT c.conv_id, 0 AS part, t.at, t.t FROM convs c JOIN turns t ON t.conv_id = c.leader AND t.at < c.h
  UNION ALL SELECT c.conv_id, 1, t.at, t.t FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.at >= c.h),
lists AS (SELECT c.conv_id, coalesce(list(r.t ORDER BY r.part, r.at) FILTER (WHERE r.t IS NOT NULL), []) AS ts FROM convs c LEFT JOIN rebuilt r USING (conv_id) GROUP BY c.conv_id),
prefixes AS (SELECT conv_id, len(ts) AS n, unnest(range(len(ts) + 1)) AS depth, ts FROM lists),
members AS (SELECT conv_id, n, depth, list_slice(ts, 1, depth) AS path FROM prefixes),
nodes AS (
  SELECT depth, path, min(conv_id) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE n = depth), '')) AS ends_sha256 FROM members GROUP BY depth, path),
named AS (SELECT *, CASE WHEN depth > 0 THEN list_slice(path, 1, depth - 1) END AS up, CASE WHEN depth > 0 THEN length(path[depth][2]) ELSE 0 END AS size FROM nodes),
kids AS (SELECT up AS path, count(*) AS n_children FROM named WHERE depth > 0 GROUP BY up),
whole AS (SELECT n.*, coalesce(k.n_children, 0) AS n_children FROM named n LEFT JOIN kids k USING (path)),
over AS (SELECT unnest(range(depth + 1)) AS d, path, n_convs, n_children, size FROM whole),
sums AS (SELECT list_slice(path, 1, d) AS path, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((n_convs - 1) * size) AS saved_tokens FROM over GROUP BY 1)
SELECT w.conv_id, CAST(w.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, w.n_convs, w.n_children, CAST(s.n_leaves AS BIGINT) AS n_leaves,
       CAST(s.saved_tokens AS BIGINT) AS saved_tokens, w.ends_sha256
FROM whole w JOIN sums s USING (path) LEFT JOIN nodes p ON p.path = w.up
"""
