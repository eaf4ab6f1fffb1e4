import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from tracewright.llm import periodic_runs as P
from tracewright.llm.queries import _periodic_tail

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def plain(words):
    """Every run by comparing all words at every distance."""
    n, out = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(6, 4 * q) and not any(all(words[x] == words[x + r] for x in range(i, i + length - r)) for r in range(1, q)):
                out.append((i, length, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def samples(seed):
    rng = random.Random(seed)
    yield from ([], [b"a"], [b"a"] * 5, [b"a"] * 6, [b"a"] * 41, [b"a", b"b"] * 4, [b"a", b"b"] * 3 + [b"a"], [b"a", b"b", b"a", b"b", b"a", b"b", b"a", b"b", b"b"])
    for _ in range(60):
        out = []
        while len(out) < rng.randint(0, 90):
            base = [rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randint(1, 9))]
            out += base * rng.choice([1, 1, 2, 4, 5, 9]) + base[: rng.randint(0, len(base))]
        yield out
    for _ in range(20):
        yield [rng.choice([b"a", b"b"]) for _ in range(rng.randint(0, 60))]


@pytest.mark.parametrize("seed", range(3))
def test_runs_equal_brute_force(seed):
    texts = list(samples(seed))
    for words, got in zip(texts, P.runs_of(texts)):
        assert [tuple(r) for r in got.tolist()] == plain(words), words


def test_words_may_come_in_pieces():
    rng = random.Random(5)
    for words in samples(9):
        ids = np.array([ord(w) for w in words], np.int64)
        for most in (1, 3, 40):
            catchers, at = P.Catchers(), 0
            while at < len(ids):
                step = rng.randint(1, most)
                catchers.append(ids[at : at + step])
                at += step
                if rng.random() < 0.1:
                    assert [tuple(r) for r in catchers.runs().tolist()] == plain(words[:at])
            assert [tuple(r) for r in catchers.runs().tolist()] == plain(words)


def test_long_texts():
    """A million equal words, a long period, and random words around them."""
    rng = np.random.default_rng(1)
    noise = rng.integers(10, 10**9, 300_000)
    base = rng.integers(10, 10**9, 70_001)
    words = np.concatenate([noise, np.zeros(1_000_000, np.int64), noise + 1, np.tile(base, 5)])
    catchers = P.Catchers()
    for part in np.array_split(words, 7):
        catchers.append(part)
    assert [tuple(r) for r in catchers.runs().tolist()] == [(300_000, 1_000_000, 1), (1_600_000, 350_005, 70_001)]
    # hashes of a level are kept as far back as its blocks and the next level need them
    assert sum(len(x.hashes) for x in catchers.levels) < 8 * len(words)


def expected(doc_id, text):
    words = WORD.findall((text or "").encode())
    n, h = len(words), zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = plain(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return (doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()),
            sha(b" ".join(w for i, w in enumerate(words) if i not in gone)), len(words))


def test_query_equals_brute_force(spark):
    rng = random.Random(3)
    rows = [(i, "  ".join(rng.choice(["ä", "b\x1c", "c", f"w{i}"]) for _ in range(rng.randint(0, 70)))) for i in range(300)]
    rows += [(400, None), (401, ""), (402, " \n\t"), (None, "a b " * 20), (3, "x\n" * 9), (3, "x\n" * 9), (403, "a b " * 12 + "c " * 24), (404, "c " * 12 + "a b " * 12)]
    docs = spark.createDataFrame([(*r, "z", 1) for r in rows], "doc_id long, text string, runs string, best int").repartition(3)
    got = P.digests(P.periodic_runs(docs, _periodic_tail)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted((expected(*r) for r in rows), key=repr)
    assert sum(r.n_runs > 1 for r in got) >= 2
    assert P.digests(P.periodic_runs(docs.limit(0))).count() == 0
    whole = {r.doc_id: r for r in P.periodic_runs(docs).collect()}
    assert whole[401].runs == [] and whole[401].collapsed == "" and whole[402].n_words == 0
