"""Near-duplicate documents by DartMinHash signatures and banded joining.

Every element of a weighted set owns a random stream of darts in the plane of
weight and rank, hashed from the element alone. A document takes the darts that
fall below its elements' weights and below a rank limit chosen so that about
k ln k + 2k darts hit; each dart belongs to one of k coordinates, and the earliest
one per coordinate is the signature. Two signatures agree in a coordinate with the
probability of their weighted Jaccard similarity, at a cost of k log k + elements.

Documents with equal shingle sets are one node. Nodes that share a band meet at
the leader of the bucket, not with each other; links are checked on the shingles
themselves. Only buckets whose nodes are still in different classes go on: there
signatures are compared in blocks of bounded size, and what is close enough to
matter is checked on the shingles as well.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewright.llm.common import column, record, row_key, steps, utf8, whole_text
from tracewright.operators.scale import connected_components
from tracewright.session import stage

_U = np.uint64


@dataclass(frozen=True)
class Near:
    """`bands` of `rows` coordinates: at similarity 0.8 a pair misses all 50 bands of 9 once in 1,300 cases, at 0.85 once in 500,000.

    `weights`: "set" counts a shingle once, "count" as often as it occurs.
    """

    words: int = 5
    similarity: float = 0.8
    bands: int = 50
    rows: int = 9
    weights: str = "set"
    block: int = 2048

    @property
    def k(self) -> int:
        return self.bands * self.rows

    @property
    def close(self) -> int:
        """Agreeing coordinates that a similar pair reaches but once in some 10^5 cases."""
        p = self.similarity
        return int(self.k * p - 4.5 * (self.k * p * (1 - p)) ** 0.5)


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every input bit over 64 bits."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def unit(x: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1] of hashed values."""
    return ((x >> _U(11)).astype(np.float64) + 1.0) * 2.0**-53


def shingles(texts: list[bytes], words: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all runs of `words` words and the number of runs per text.

    A shorter text has one run, all its words; a text without words has none.
    """
    known: dict[bytes, int] = {}
    split = [t.split() for t in texts]
    for w in split:
        for x in w:
            if x not in known:
                known[x] = xxhash.xxh3_64_intdigest(x)
    lengths = np.array([len(w) for w in split], np.int64)
    flat = np.fromiter((known[x] for w in split for x in w), _U, int(lengths.sum()))
    runs = np.where(lengths == 0, 0, np.maximum(1, lengths - words + 1))
    begin = np.repeat(np.cumsum(lengths) - lengths, runs) + _ranges(runs)
    size = np.repeat(np.minimum(lengths, words), runs)
    out = mix(size.astype(_U))
    for i in range(words):
        step = mix(out * _U(0x9E3779B97F4A7C15) + flat[np.minimum(begin + i, max(len(flat) - 1, 0))]) if len(flat) else out
        out = np.where(i < size, step, out)
    return out, runs


def _ranges(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... for each size, one after the other."""
    return np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def signatures(elements: np.ndarray, weights: np.ndarray, sizes: np.ndarray, k: int) -> np.ndarray:
    """[documents, k] ids of the earliest darts. `sizes`: elements of each document, none of them 0; weights above 0."""
    n = len(sizes)
    doc = np.repeat(np.arange(n), sizes)
    total = np.bincount(doc, weights=weights, minlength=n)
    limit = (k * np.log(k) + 2 * k) / total
    ids = np.zeros(n * k, _U)
    todo = np.ones(n, bool)
    while todo.any():
        best = np.full(n * k, np.inf)
        use = todo[doc]
        _throw(elements[use], weights[use], doc[use], limit, k, best, ids)
        # a coordinate without dart needs a higher rank limit; the darts below it stay the same
        todo &= np.isinf(best).reshape(n, k).any(axis=1)
        limit = limit * 2
    return ids.reshape(n, k)


def _throw(elements, weights, doc, limit, k, best, ids) -> None:
    """Earliest darts per document and coordinate, region by region of the weight axis: [0, 1), [1, 2), [2, 4), ..."""
    region = 0
    while elements.size:
        low = 0.0 if region == 0 else 2.0 ** (region - 1)
        width = max(low, 1.0)
        # where every weight covers its region, every dart below the rank limit hits
        partial = bool((weights < low + width).any())
        w = weights if partial else None
        seed = mix(elements + _U((region + 1) * 0x9E3779B97F4A7C15 % 2**64))
        # ranks in units of one dart per element and region: the darts of a stream are 1 apart on average
        rank, most, base, made = np.zeros(elements.size), limit[doc] * width, doc * k, np.zeros(elements.size, np.int64)
        while seed.size:
            # as many darts at once as each stream is likely to need; few streams go on after that
            ask = np.maximum(1, np.ceil(most - rank)).astype(np.int64)
            of = np.repeat(np.arange(seed.size), ask)
            ends = np.cumsum(ask)
            number = np.arange(of.size) - (ends - ask - made)[of] + 1
            dart = mix(seed[of] + number.astype(_U) * _U(0xD1B54A32D192ED03))
            gone = np.cumsum(-np.log(unit(dart)))
            at_rank = gone + (rank - np.concatenate([[0.0], gone[ends[:-1] - 1]]))[of]
            below = np.flatnonzero(at_rank <= most[of])
            of_hit, r, found = of[below], at_rank[below], dart[below]
            if partial:
                hit = np.flatnonzero(low + width * unit(mix(found ^ _U(0xA0761D6478BD642F))) <= w[of_hit])
                of_hit, r, found = of_hit[hit], r[hit], found[hit]
            at = base[of_hit] + ((((found * _U(0xE7037ED1A0B428DB)) >> _U(32)) * _U(k)) >> _U(32)).view(np.int64)
            if width != 1.0:
                r = r / width
            better = np.flatnonzero(r < best[at])
            at, r, found = at[better], r[better], found[better]
            np.minimum.at(best, at, r)
            first = np.flatnonzero(best[at] == r)
            ids[at[first]] = found[first]
            last = at_rank[ends - 1]
            on = np.flatnonzero(last <= most)
            seed, rank, most, base, made = seed[on], last[on], most[on], base[on], (made + ask)[on]
            if partial:
                w = w[on]
        more = weights > max(1.0, 2.0**region) if region else weights > 1.0
        elements, weights, doc = elements[more], weights[more], doc[more]
        region += 1


def sets_of(texts: list[bytes], near: Near) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text in ascending order, their weights, and how many each text has."""
    flat, runs = shingles(texts, near.words)
    parts, weights, at = [], [], 0
    for n in runs.tolist():
        own, count = np.unique(flat[at : at + n], return_counts=True)
        parts.append(own)
        weights.append(count if near.weights == "count" else np.ones(len(own)))
        at += n
    sizes = np.array([len(p) for p in parts], np.int64)
    none = np.zeros(0)
    return np.concatenate(parts or [none.astype(_U)]), np.concatenate(weights or [none]).astype(np.float64), sizes


_NODES = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("node", pa.binary()), ("signature", pa.binary()), ("bands", pa.list_(pa.int64()))])


def sign(docs: DataFrame, near: Near) -> DataFrame:
    """doc_id, key of the text, node (name of the shingle set), signature in bytes and band hashes of every row."""
    factors = mix(np.arange(1, near.rows + 1).astype(_U)) | _U(1)
    salt = mix(np.arange(101, 101 + near.bands).astype(_U))

    def run(batches):
        # the darts of a step are many times its text
        for b in steps(batches, size=400_000):
            elements, weights, sizes = sets_of(utf8(b), near)
            ends = np.cumsum(sizes)
            names = [xxhash.xxh3_128_digest(elements[e - s : e].tobytes() + (weights[e - s : e].tobytes() if near.weights == "count" else b"")) for s, e in zip(sizes.tolist(), ends.tolist())]
            full = np.flatnonzero(sizes)
            marks: list[bytes] = [b""] * len(names)
            bands: list = [[]] * len(names)
            if full.size:
                ids = signatures(elements, weights, sizes[full], near.k)
                short = (ids >> _U(32)).astype(np.uint8)
                keys = mix((ids.reshape(-1, near.bands, near.rows) * factors).sum(axis=2, dtype=_U) ^ salt).view(np.int64)
                for i, mark, key in zip(full.tolist(), short, keys):
                    marks[i], bands[i] = mark.tobytes(), key
            yield record(_NODES, doc_id=column(b, "doc_id"), key=column(b, "key"), node=names, signature=marks, bands=bands)

    rows = whole_text(docs, "doc_id").select("doc_id", row_key("text").alias("key"), "text")
    return rows.mapInArrow(run, "doc_id long, key long, node binary, signature binary, bands array<long>")


def _shingle_sets(docs: DataFrame, reps: DataFrame, near: Near) -> DataFrame:
    """node and shingles of one document of each node: 32 bits of each hash, then the weights if they count.

    Two different shingles of a pair fall together about n * n / 2^32 times, which
    moves a similarity by less than n / 2^32.
    """
    schema = pa.schema([("node", pa.binary()), ("items", pa.binary())])

    def run(batches):
        for b in steps(batches):
            elements, weights, sizes = sets_of(utf8(b), near)
            items, at = [], 0
            for n in sizes.tolist():
                own = (elements[at : at + n] >> _U(16)).astype("<u4").tobytes()
                items.append(own + weights[at : at + n].astype("<f4").tobytes() if near.weights == "count" else own)
                at += n
            yield record(schema, node=column(b, "node"), items=items)

    rows = whole_text(docs, "doc_id").select("doc_id", row_key("text").alias("key"), "text")
    same = rows["key"].eqNullSafe(reps["rep.key"]) & rows["doc_id"].eqNullSafe(reps["rep.doc_id"])
    sets = rows.join(reps, same).select("node", "text").mapInArrow(run, "node binary, items binary")
    return sets.groupBy("node").agg(F.first("items").alias("items"))  # a row may be repeated


def similarity(a: bytes, b: bytes, weights: str) -> float:
    """Jaccard similarity of two sets as `_shingle_sets` writes them."""
    step = 8 if weights == "count" else 4
    x, y = np.frombuffer(a, "<u4", len(a) // step), np.frombuffer(b, "<u4", len(b) // step)
    if not x.size or not y.size:
        return float(x.size == y.size)
    if weights != "count":
        shared = np.intersect1d(x, y).size
        return shared / (len(np.unique(x)) + len(np.unique(y)) - shared)
    u, v = np.frombuffer(a, "<f4", offset=4 * x.size), np.frombuffer(b, "<f4", offset=4 * y.size)
    _, i, j = np.intersect1d(x, y, return_indices=True)
    shared = float(np.minimum(u[i], v[j]).sum())
    return shared / (float(u.sum()) + float(v.sum()) - shared)


def _linked(pairs: DataFrame, sets: DataFrame, near: Near) -> DataFrame:
    """The pairs (a, b) that are similar enough, checked on their shingles."""
    schema = pa.schema([("a", pa.binary()), ("b", pa.binary())])

    def run(batches):
        for b in steps(batches, "x"):
            ok = [similarity(x, y, near.weights) >= near.similarity for x, y in zip(column(b, "x").to_pylist(), column(b, "y").to_pylist())]
            yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_())).cast(schema)

    left = sets.select(F.col("node").alias("a"), F.col("items").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("items").alias("y"))
    both = pairs.select("a", "b").join(left, "a").join(right, "b")
    if near.weights != "count":
        small, large = F.least(F.length("x"), F.length("y")), F.greatest(F.length("x"), F.length("y"))
        both = both.where(small >= near.similarity * large)
    return both.select("a", "b", "x", "y").mapInArrow(run, "a binary, b binary")


def _with_root(rows: DataFrame, node: str, roots: DataFrame, name: str) -> DataFrame:
    named = roots.select(F.col("node").alias(node), F.col("root").alias(name))
    return rows.join(named, node, "left").withColumn(name, F.coalesce(name, node))


def _close_pairs(open_buckets: DataFrame, marks: DataFrame, near: Near) -> DataFrame:
    """Pairs of nodes of different classes in one bucket whose signatures nearly agree.

    A bucket is cut into blocks of about `near.block` nodes; each pair of blocks is a
    piece of work of its own. A pair counts in the first open bucket that both nodes
    are in, told by the whole band hash: equal marks say less, as 8 bits of different
    darts agree once in 256.
    """
    schema = pa.schema([("a", pa.binary()), ("b", pa.binary())])
    least = near.close

    def compare(rows):
        number: dict[bytes, int] = {}
        roots = np.array([number.setdefault(bytes(r[2]), len(number)) for r in rows])
        side = np.array([r[3] for r in rows])
        marks = np.frombuffer(b"".join(r[1] for r in rows), np.uint8).reshape(len(rows), -1)
        hashes, held = np.stack([r[4] for r in rows]), np.stack([r[5] for r in rows])
        band = rows[0][6]
        for i in range(len(rows)):
            if side[i] == 2:
                continue
            other = np.flatnonzero((side == 2) if (side == 2).any() else (np.arange(len(rows)) > i))
            other = other[roots[other] != roots[i]]
            other = other[(marks[other] == marks[i]).sum(axis=1) >= least]
            first = ((hashes[other] == hashes[i]) & held[other] & held[i]).argmax(axis=1)
            for j in other[first == band].tolist():
                yield min(rows[i][0], rows[j][0]), max(rows[i][0], rows[j][0])

    def run(batches):
        def rows():
            for b in batches:
                own = column(b, "buckets")
                row, at = np.repeat(np.arange(len(own)), np.diff(own.offsets.to_numpy())), own.flatten()
                hashes, held = np.zeros((len(own), near.bands), np.int64), np.zeros((len(own), near.bands), bool)
                place = row, at.field("number").to_numpy()
                hashes[place], held[place] = at.field("band").to_numpy(), True
                work, node, signature, root, side, number = [column(b, n).to_pylist() for n in ("work", "node", "signature", "root", "side", "number")]
                yield from zip(work, node, signature, root, side, hashes, held, number)

        out = []
        for _, group in groupby(rows(), key=lambda r: r[0]):
            out += compare([r[1:] for r in group])
            if len(out) > 10_000:
                yield record(schema, a=[p[0] for p in out], b=[p[1] for p in out])
                out = []
        if out:
            yield record(schema, a=[p[0] for p in out], b=[p[1] for p in out])

    size = open_buckets.groupBy("band").agg(F.count(F.lit(1)).alias("n"))
    cut = open_buckets.join(size, "band").withColumn("blocks", F.ceil(F.col("n") / near.block)).withColumn("own", F.pmod(F.xxhash64("node"), "blocks"))
    # work (i, j), i <= j: a node of block o is on the first side of (o, j) and on the second of (i, o); (o, o) has one side
    pair = lambda i, j, side: F.struct(i.alias("i"), j.alias("j"), F.lit(side).alias("side"))
    everyone = F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)
    works = F.transform(everyone, lambda x: F.when(x == F.col("own"), pair(x, x, 0)).when(x > F.col("own"), pair(F.col("own"), x, 1)).otherwise(pair(x, F.col("own"), 2)))
    dealt = cut.select("node", "root", "number", "band", F.explode(works).alias("w")).select(
        "node", "root", "number", F.struct("band", "w.i", "w.j").alias("key"), F.col("w.side").alias("side"))
    # a node has one bucket per band
    own = open_buckets.groupBy("node").agg(F.collect_list(F.struct("number", "band")).alias("buckets"))
    rows = dealt.join(marks.join(own, "node"), "node").select(F.to_json("key").alias("work"), "node", "signature", "buckets", "root", "side", "number")
    return rows.repartition("work").sortWithinPartitions("work").mapInArrow(run, "a binary, b binary")


def near_classes(docs: DataFrame, near: Near = Near()) -> DataFrame:
    """Class of every row: doc_id, key, class_id, class_rows, first.

    A class is a connected component of documents with at least `similarity`;
    class_id is its smallest doc_id, null if no row has one. `first` marks the rows
    of the document with the smallest (doc_id, key of the text); repeated rows are
    one document, so all of them carry the mark. Null texts are empty, all texts
    without words form one class. An empty table gives no rows.
    """
    signed = stage(sign(docs, near))
    rep = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("rep")
    banded = signed.groupBy("node").agg(F.first("bands").alias("bands")).select("node", F.posexplode("bands").alias("number", "band"))
    # a node has a row in each of its bands, so no band holds more than one in `bands` of all rows
    members = stage(banded.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("band"))).where("n > 1"))
    weight = members.groupBy("node").agg(F.sum(F.col("n") - 1).alias("weight"))
    # the node that shares most with others leads: of a text and its edited copies, the text itself
    leaders = members.join(weight, "node").groupBy("band").agg(F.max(F.struct("weight", "node")).alias("leader"))
    asks = members.join(leaders, "band").select("node", "leader").where(F.col("node") != F.col("leader.node")).distinct()
    asks = stage(asks)
    reps = signed.groupBy("node").agg(rep).join(weight.select("node"), "node", "left_semi")
    sets = stage(_shingle_sets(docs, reps, near))
    first = asks.groupBy("node").agg(F.max("leader").alias("l")).select(F.col("node").alias("a"), F.col("l.node").alias("b"))
    links = stage(_linked(first, sets, near))
    roots = stage(connected_components(links))
    rest = _with_root(asks.select(F.col("node").alias("a"), F.col("leader.node").alias("b")), "a", roots, "ra")
    rest = _with_root(rest, "b", roots, "rb").where("ra <> rb").select("a", "b").join(first, ["a", "b"], "left_anti")
    links = stage(links.unionByName(_linked(rest, sets, near)))
    roots = stage(connected_components(links))
    placed = _with_root(members.select("band", "number", "node"), "node", roots, "root")
    split = placed.groupBy("band").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("band")
    marks = signed.join(weight.select("node"), "node", "left_semi").groupBy("node").agg(F.first("signature").alias("signature"))
    close = _close_pairs(placed.join(split, "band", "left_semi"), marks, near)
    asked = asks.select(F.least("node", "leader.node").alias("a"), F.greatest("node", "leader.node").alias("b"))
    links = stage(links.unionByName(_linked(close.join(asked, ["a", "b"], "left_anti"), sets, near)))
    roots = stage(connected_components(links))
    placed = _with_root(signed.select("doc_id", "key", "node"), "node", roots, "root")
    heads = placed.groupBy("root").agg(rep, F.count(F.lit(1)).alias("class_rows"))
    return placed.join(heads, "root").select(
        "doc_id", "key", F.col("rep.doc_id").alias("class_id"), "class_rows",
        (F.col("doc_id").eqNullSafe(F.col("rep.doc_id")) & (F.col("key") == F.col("rep.key"))).alias("first"))


def drop_near_duplicates(docs: DataFrame, near: Near = Near()) -> DataFrame:
    """The rows of `docs`, with all their columns, of the first document of every class; of repeated rows one stays."""
    mine = near_classes(docs, near).where("first").groupBy("doc_id", "key").agg(F.count(F.lit(1)).alias("rows"))
    keep = mine.select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"), F.col("rows").alias("_rows"))
    named = docs.select("*", F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("_text_key"))
    joined = named.join(keep, named["doc_id"].eqNullSafe(keep["_id"]) & (named["_text_key"] == keep["_key"]))
    once = joined.where("_rows = 1").drop("_id", "_key", "_rows", "_text_key")
    repeated = joined.where("_rows > 1").dropDuplicates(["_id", "_key"]).drop("_id", "_key", "_rows", "_text_key")
    return once.unionByName(repeated)
