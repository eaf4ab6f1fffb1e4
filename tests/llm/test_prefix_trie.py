import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tracewright.llm import prefix_trie as T

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain(convs):
    """convs: conv_id -> list of (role, text). Every prefix of every conversation."""
    members, ends = {}, {}
    for c, ts in convs.items():
        for d in range(len(ts) + 1):
            members.setdefault(tuple(ts[:d]), []).append(c)
        ends.setdefault(tuple(ts), []).append(c)
    out = []
    for path, own in members.items():
        below = [p for p in members if p[: len(path)] == path]
        kids = [p for p in below if len(p) == len(path) + 1]
        leaves = [p for p in below if not any(len(q) == len(p) + 1 and q[: len(p)] == p for q in below)]
        saved = sum((len(members[p]) - 1) * len(p[-1][1]) for p in below if p)
        sha = hashlib.sha256(",".join(map(str, sorted(ends.get(path, ())))).encode()).hexdigest()
        out.append((min(own), len(path), min(members[path[:-1]]) if path else None, len(own), len(kids), len(leaves), saved, sha))
    return sorted(out, key=repr)


def ordered(rows):
    """rows (conv_id, turn, role, text) -> conv_id -> turns; no two turns of a conversation share a number."""
    out = {}
    for c, t, r, x in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
        out.setdefault(c, []).append((r or "", x or ""))
    return out


def rebuilt(convs):
    out = {}
    for c, ts in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = convs.get(c - c % 100, [])[:h] + ts[h:]
    return out


def table(seed, n=260):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        c = c + 100 * (c > n // 2)
        if c in (100, 7):
            continue
        first = rng.choice([("user", "hi"), ("user", "hello there"), ("system", "ä"), (None, None)])
        turns = [first] + [(rng.choice(["user", "assistant"]), rng.choice(["a", "bb", "ccc", "", None])) for _ in range(rng.randint(0, 5))]
        rows += [(c, None if i == 0 and rng.random() < 0.2 else i, *t) for i, t in enumerate(turns)]
    rng.shuffle(rows)
    return rows


def got(df):
    assert df.columns == COLUMNS
    return sorted((tuple(r) for r in df.collect()), key=repr)


def trie(spark, rows):
    turns = T.number_turns(spark.createDataFrame([(*r, "x", 3) for r in rows], "conv_id long, turn long, role string, text string, at string, size int"))
    return turns, turns.select("conv_id").distinct()


@pytest.mark.parametrize("seed,limits", [(1, T.Limits()), (2, T.Limits(2, 20_000)), (3, T.Limits(256, 3)), (4, T.Limits(1, 2)), (5, T.Limits(3, 7, 9))])
def test_trie_equals_all_prefixes(spark, seed, limits):
    """Also with short segments, so that layers hand sums up, and small blocks, so that most nodes lie on boundaries."""
    rows = table(seed, 120)
    assert got(T.prefix_trie(T.whole_conversations(*trie(spark, rows)), limits)) == plain(ordered(rows))


def test_query_equals_brute_force(spark):
    rows = table(8)
    turns, _ = trie(spark, rows)
    conv = F.col("conv_id")
    df = T.prefix_trie(T.with_shared_heads(turns, conv - F.pmod(conv, F.lit(100)), F.crc32(conv.cast("string")) % 6, 5))
    want = plain(rebuilt(ordered(rows)))
    assert got(df) == want
    assert any(not ts for ts in rebuilt(ordered(rows)).values())


def test_long_and_equal_conversations(spark):
    """A conversation of several segments, many equal ones, ties, repeated rows, null ids, an empty table."""
    long = [(900, i, "user", f"t{i % 7}") for i in range(600)] + [(901, i, "user", f"t{i % 7}") for i in range(520)] + [(902, i, "user", f"t{i % 7}") for i in range(256)]
    same = [(c, i, "user", "same") for c in range(300) for i in range(2)]
    rows = long + same + [(None, 0, "user", "no conversation"), (950, 1, "a", "x"), (950, 1, "a", "x")]
    assert got(T.prefix_trie(T.whole_conversations(*trie(spark, rows)))) == plain(ordered(rows))
    empty, none = trie(spark, rows[:1])
    assert T.prefix_trie(T.whole_conversations(empty.limit(0), none.limit(0))).count() == 0


def test_search_tree():
    rng = random.Random(2)
    texts = sorted({tuple((rng.randint(0, 9), 0, 1) for _ in range(rng.randint(0, 5))) for _ in range(400)})
    tree, turns = T.build([T.Sequence(list(t), 1, i) for i, t in enumerate(texts)])
    paths = {0: ()}
    for x, parent, depth in tree.walk():
        if x:
            paths[x] = (*paths[parent], turns[tree.code[x]])
        assert len(paths[x]) == depth
    assert sorted(paths.values()) == sorted({t[:d] for t in texts for d in range(len(t) + 1)})
    assert {paths[x]: i for x, i in tree.ends.items()} == {t: i for i, t in enumerate(texts)}
    assert sorted(T.middles(17)) == list(range(17)) and next(T.middles(17)) == 8
    # the middle goes in first, so equal single turns make a search tree of least height
    flat, _ = T.build([T.Sequence([(i, 0, 1)], 1, i) for i in range(1000)])
    depth = {flat.next[0]: 1}
    for x in list(depth):
        stack = [x]
        while stack:
            y = stack.pop()
            for z in (flat.less[y], flat.more[y]):
                if z:
                    depth[z] = depth[y] + 1
                    stack.append(z)
    assert len(depth) == 1000 and max(depth.values()) == 10
