import random

import numpy as np
import pytest

from tracewright.llm import dart_minhash as D


def words(rng, n):
    return [f"w{rng.randrange(10**6)}" for _ in range(n)]


def jaccard(a, b, k=5):
    s = [{tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set() for w in (a.split(), b.split())]
    return len(s[0] & s[1]) / len(s[0] | s[1]) if s[0] | s[1] else 1.0


@pytest.mark.parametrize("weights", [False, True])
def test_signatures_estimate_weighted_jaccard(weights):
    rng = np.random.default_rng(1)
    k = 1500
    for size, share in ((40, 0.5), (400, 0.8), (3, 0.3), (3000, 0.6)):
        e = D.mix(rng.integers(0, 2**62, size).astype(np.uint64))
        a = e[: int(size * (1 + share) / 2)]
        b = e[size - len(a) :]
        if weights:
            wa, wb = rng.gamma(0.7, 3, len(a)) + 1e-3, rng.gamma(0.7, 3, len(b)) + 1e-3
        else:
            wa, wb = np.ones(len(a)), np.ones(len(b))
        da, db = dict(zip(a.tolist(), wa)), dict(zip(b.tolist(), wb))
        true = sum(min(da.get(x, 0), db.get(x, 0)) for x in e.tolist()) / sum(max(da.get(x, 0), db.get(x, 0)) for x in e.tolist())
        s = D.signatures(np.concatenate([a, b]), np.concatenate([wa, wb]), np.array([len(a), len(b)]), k)
        assert abs((s[0] == s[1]).mean() - true) < 5 * (0.25 / k) ** 0.5
        alone = D.signatures(a, wa, np.array([len(a)]), k)
        assert (alone[0] == s[0]).all()


def classes(texts, near=D.Near()):
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if jaccard(texts[i], texts[j]) >= near.similarity:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(texts))]


def edited(rng, w, n):
    w = list(w)
    for _ in range(n):
        w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
    return w


def corpus(seed):
    rng = random.Random(seed)
    texts = ["", " \n", "a b", "a b", "a  b", "b a", "one"]
    for _ in range(6):
        base = words(rng, rng.randint(40, 200))
        texts += [" ".join(base)] * 3 + [" ".join(edited(rng, base, rng.randint(1, 9))) for _ in range(8)]
    chain = words(rng, 300)
    for step in range(8):  # neighbours are alike, the ends are not
        texts.append(" ".join(chain[step * 12 : step * 12 + 200]))
    for _ in range(20):
        texts.append(" ".join(words(rng, 60) + ["shared"] * 3))
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("block", [2048, 7])
def test_classes_equal_brute_force(spark, block):
    texts = corpus(3)
    rows = [(i, t, "x", None) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, class_id string, key int").repartition(4)
    got = {r.doc_id: r for r in D.near_classes(docs, D.Near(block=block)).collect()}
    want = classes(texts)
    low = {c: min(i for i, x in enumerate(want) if x == c) for c in want}
    assert {i: low[c] for i, c in enumerate(want)} == {i: r.class_id for i, r in got.items()}
    assert all(r.class_rows == want.count(want[i]) and r.first == (r.class_id == i) for i, r in got.items())
    assert sorted(r.doc_id for r in D.drop_near_duplicates(docs, D.Near(block=block)).collect()) == sorted(low.values())


def test_close_pairs_in_blocks(spark):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 256, 450).astype(np.uint8)
    marks = []
    for i in range(60):
        m = base.copy()
        m[9 + rng.permutation(441)[: int(rng.integers(0, 200))]] += 1  # band 0 stays
        marks.append((bytes([i]), m.tobytes()))
    near = D.Near(block=9)
    buckets = spark.createDataFrame([(7, bytearray(n), bytearray(bytes([n[0] % 4])), 0) for n, _ in marks], "band long, node binary, root binary, number int")
    sig = spark.createDataFrame([(bytearray(n), bytearray(m)) for n, m in marks], "node binary, signature binary")
    got = {(bytes(r.a), bytes(r.b)) for r in D._close_pairs(buckets, sig, near).collect()}
    want = set()
    for a, x in marks:
        for b, y in marks:
            if a < b and a[0] % 4 != b[0] % 4 and sum(p == q for p, q in zip(x, y)) >= near.close:
                want.add((a, b))
    assert got == want and want


def test_marks_that_agree_by_chance_hide_no_pair(spark):
    """Bands 0 and 1 look shared by their marks; the nodes meet in the buckets of bands 3 and 5 only."""
    a, b, c = bytearray(b"a"), bytearray(b"b"), bytearray(b"c")
    rows = [(n, number, 100 * number + (0 if number in (3, 5) else k), n) for k, n in enumerate((a, b)) for number in (0, 1, 3, 5)]
    rows += [(c, 0, 0, c), (c, 1, 101, c)]  # keeps the other buckets open
    buckets = spark.createDataFrame(rows, "node binary, number int, band long, root binary")
    sig = spark.createDataFrame([(n, bytearray(450)) for n in (a, b, c)], "node binary, signature binary")
    got = sorted((bytes(r.a), bytes(r.b)) for r in D._close_pairs(buckets, sig, D.Near()).collect())
    assert got == [(b"a", b"b"), (b"a", b"c"), (b"b", b"c")]


def test_nulls_and_repeats(spark):
    t = " ".join(f"v{i}" for i in range(30))
    rows = [(None, None, 1), (None, "", 2), (4, t, 3), (4, t, 3), (2, t, 4), (None, t, 5), (9, "other words here", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    got = sorted((r.doc_id or -1, r.class_id or -1, r.class_rows, r.first) for r in D.near_classes(docs).collect())
    assert got == [(-1, -1, 2, True), (-1, -1, 2, True), (-1, 2, 4, False), (2, 2, 4, True), (4, 2, 4, False), (4, 2, 4, False), (9, 9, 1, True)]
    assert sorted(r.doc_id or -1 for r in D.drop_near_duplicates(docs).collect()) == [-1, 2, 9]
    assert D.near_classes(docs.limit(0)).count() == 0


def test_counts_as_weights():
    a, b = "a b c d e " * 10, "a b c d e " * 8
    near = D.Near(weights="count")
    e, w, n = D.sets_of([a.encode(), b.encode()], near)
    x = [(e[:5] >> np.uint64(16)).astype("<u4").tobytes() + w[:5].astype("<f4").tobytes(), (e[5:] >> np.uint64(16)).astype("<u4").tobytes() + w[5:].astype("<f4").tobytes()]
    assert n.tolist() == [5, 5] and D.similarity(x[0], x[1], "count") == pytest.approx(36 / 46)
