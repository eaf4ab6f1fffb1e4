import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewright.llm import piecewise as C


def plain(t: bytes) -> str:
    """Byte by byte, with the same hashes."""
    table = C._byte_values().tolist()
    spread = lambda x: int(C._spread(np.array([x], np.uint32))[0])
    ctx, hashes = [0] * C.WINDOW, []
    for c in t:
        ctx = [c, *ctx[:-1]]
        hashes.append(spread(sum(table[b] * pow(C._FACTOR, k, 2**32) for k, b in enumerate(ctx)) % 2**32))
    size = 3
    while sum(h % size == size - 1 and h != 2**32 - 1 for h in hashes) > C.MOST:
        size *= 2
    out = []
    for b in (size, 2 * size):
        sig, total, n = "", 0, 0
        for i, h in enumerate(hashes):
            total, n = total + spread(h ^ 0x5BD1E995), n + 1
            if (h % b == b - 1 and h != 2**32 - 1) or i == len(hashes) - 1:
                sig += chr(C.LETTERS[((total + n) * 0x9E3779B97F4A7C15 % 2**64) >> 58])
                total = n = 0
        out.append(sig)
    return f"{size}:{out[0]}:{out[1]}"


def prose(rng, n):
    return " ".join(rng.choice(["the", "house", "sea", "of", "running", "old"]) + str(rng.randrange(50)) for _ in range(n))


def test_fingerprints_equal_byte_by_byte():
    rng = random.Random(1)
    texts = [b"", b"a", b"", b"\0\0\0", b"a" * 900, b"abc" * 300, "é🙂".encode() * 50] + [prose(rng, rng.randint(0, 300)).encode() for _ in range(25)] + [b""]
    got = C.fingerprints(texts)
    assert got == [plain(t) for t in texts] == [C.fingerprints([t])[0] for t in texts]
    assert all(len(f.split(":")[1]) <= C.MOST + 1 for f in got)
    assert C.fingerprints([]) == [] and C.fingerprints([b"", b""]) == ["3::", "3::"]


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


def test_likeness(spark):
    rows = [("3::", "3::"), ("3::", "3:ab:a"), ("6:abcdefgh:abcd", "6:abcdxfgh:abcd"), ("6:abcdefgh:abcd", "12:abcd:ab"), ("12:abcd:ab", "6:abcdefgh:abcd"),
            ("6:abcdefgh:abcd", "24:abcdefgh:abcd"), ("6:abcdefgh:wxyz", "6:aAbBcCdD:WXYZ"), ("6:aaaaaaabcd:a", "6:aaabcd:b"), ("3:ab:a", "3:ac:c")]
    got = [r.x for r in spark.createDataFrame(rows, "a string, b string").select(C.likeness(F.col("a"), F.col("b")).alias("x")).collect()]
    assert got == pytest.approx([1.0, 0.0, 1.0, 1.0, 1.0, 0.0, 0.0, 1.0, 0.5])


def test_rows(spark):
    rng = random.Random(5)
    rows = [(i * 3 - 50, prose(rng, rng.randint(20, 150)), "x") for i in range(80)]
    rows += [(None, "null id " * 9, "x"), (None, None, None), (7, "", "y"), (7, "same é🙂 text", "y"), (7, "same é🙂 text", "y"), (400, "z" * 5000, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, near_next string").repartition(5)
    got = C.compare_documents(docs).collect()
    assert len(got) == len(rows)
    keys = {r.t: r.k for r in spark.createDataFrame([(t or "",) for _, t, _ in rows], "t string").select("t", F.xxhash64("t").alias("k")).collect()}
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), -keys[r[1] or ""]))
    want = []
    for i, (d, t, _) in enumerate(order):
        t, nxt = t or "", order[(i + 1) % len(order)][1] or ""
        m = len(t) // 3
        e = t[: len(t) - m] + nxt[:m]
        want.append((d or -999, len(t), hashlib.sha256(e.encode()).hexdigest(), *C.fingerprints([t.encode(), e.encode()])))
    assert sorted((r.doc_id or -999, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) for r in got) == sorted(want)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    long = [r for r in got if r.n_chars > 500 and r.doc_id != 400]
    assert sum(r.near_edited for r in long) / len(long) > 0.5 > 0.1 > sum(r.near_next for r in long) / len(long)
    assert C.compare_documents(docs.limit(0)).count() == 0
    one = C.compare_documents(docs.where("doc_id = 400")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
