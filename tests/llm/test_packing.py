import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from tracewright.llm import packing as K

PATH = P.path("byte_bpe_50k.json")


@pytest.mark.parametrize("seed", range(6))
def test_search_never_loses_and_squares_grow(seed):
    rng = random.Random(seed)
    for cap in (10, 100, 2048):
        hi = rng.choice([cap, cap // 2, max(2, cap // 3)])
        lengths = [rng.randint(max(1, hi // rng.choice([1, 2, 3, 9])), hi) for _ in range(rng.randint(1, 400))]
        b = K.Bins(lengths, cap)
        n, sq = len(b.items), b.squared()
        b.search(6)
        assert len(b.items) <= n and b.squared() >= sq
        assert sorted(i for x in b.items for i in x) == list(range(len(lengths)))
        for x, f in zip(b.items, b.fill):
            assert sum(lengths[i] for i in x) == f <= cap and x


def test_swaps_empty_a_bin():
    # best fit leaves 6+3, 5+4, 2: an exchange makes 6+4, 5+3+2
    b = K.Bins([6, 5, 4, 3, 2], 10)
    b.search(6)
    assert len(b.items) == 2
    assert K.pack([]) == []


def brute_minimum(lengths, cap):
    best = [len(lengths)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(lengths):
            best[0] = len(bins)
            return
        for b in range(len(bins)):
            if bins[b] + lengths[i] <= cap:
                go(i + 1, bins[:b] + [bins[b] + lengths[i]] + bins[b + 1 :])
        go(i + 1, bins + [lengths[i]])

    go(0, [])
    return best[0]


def test_close_to_the_minimum():
    rng, over = random.Random(3), 0
    for _ in range(40):
        lengths = [rng.randint(1, 20) for _ in range(rng.randint(1, 8))]
        over += len(K.pack(lengths, K.Packing(capacity=20))) - brute_minimum(lengths, 20)
    assert over <= 2


def check(spark, rows, packing):
    docs = spark.createDataFrame(rows, "doc_id long, text string, length string")
    got = K.pack_documents(docs, PATH, 0, packing).collect()
    tok = Tokenizer.from_file(PATH)
    seq, per_doc = {}, {}
    for r in got:
        seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
        per_doc.setdefault(r.doc_id, []).append(r)
    for parts in seq.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= packing.capacity
    want = sorted((d is not None, d or 0, s, n, c) for d, t, _ in rows for s, n, c in pieces(tok, t, packing.capacity))
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.start, r.length, r.ids_crc32) for r in got) == want
    return len(seq), sum(r.length for r in got)


def pieces(tok, text, cap):
    ids = tok.encode(text or "", add_special_tokens=False).ids + [0]
    first = len(ids) % cap or min(len(ids), cap)
    at = [0, *range(first, len(ids) + 1, cap)] if len(ids) > first else [0, len(ids)]
    return [(a, b - a, zlib.crc32(np.array(ids[a:b], dtype="<u4").tobytes())) for a, b in zip(at, at[1:])]


def test_levels(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(["the", "of", "zq"]) for _ in range(rng.randint(0, 60))), "x") for i in range(400)]
    rows += [(None, None, None), (None, "a b c", ""), (7, "same", "x"), (7, "same", "x"), (8, "long " * 500, "y")]
    n, total = check(spark, rows, K.Packing(capacity=64, group=40))
    assert n <= 1.05 * total / 64  # groups of 40 pieces are far below the production size
    n, total = check(spark, [(i, "w " * 40, "x") for i in range(90)], K.Packing(capacity=64, group=20))
    assert n == 90  # no two fit together, however they are mixed
    assert check(spark, rows[:0], K.Packing())[0] == 0
