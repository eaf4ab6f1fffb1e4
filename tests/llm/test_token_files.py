import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from test_bpe import nasty
from tracewright.llm import chunks
from tracewright.llm import token_files as T


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_equal_the_library(name):
    tok, enc = Tokenizer.from_file(P.path(name)), chunks.LibraryEncoder(P.path(name))
    texts = nasty(5) + ["", " ", "IT'S  Don'T <|startoftext|> x<|endoftext|>y", "É É Å", "<|STARTOFTEXT|>"]
    for t, ids in zip(texts, enc.encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids, repr(t)


@pytest.mark.parametrize("values", [[], [0], [7], [0, 0, 0], [5] * 700, list(range(1000)), [3, 3, 2**40, 2**40, 2**62]])
def test_elias_fano(values):
    e, rest = T.EliasFano.unpack(memoryview(T.EliasFano.of(np.array(values, dtype=np.uint64)).pack() + b"tail"))
    assert e.values().tolist() == values and [e.select(i) for i in range(len(values))] == values and bytes(rest) == b"tail"
    with pytest.raises(IndexError):
        e.select(len(values))


def test_elias_fano_random():
    rng = random.Random(1)
    for _ in range(30):
        v = sorted(rng.randrange(rng.choice([5, 1000, 10**9])) for _ in range(rng.randint(1, 900)))
        e = T.EliasFano.of(np.array(v, dtype=np.uint64))
        assert e.values().tolist() == v and [e.select(i) for i in range(0, len(v), 7)] == v[::7]
        if v[-1] > len(v):
            assert len(e.high) * 8 <= 3 * len(v) + 8


def test_file(spark, tmp_path, monkeypatch):
    rng = random.Random(4)
    rows = [(rng.randrange(50) * 7 - 90, "".join(rng.choice("ab c\n") for _ in range(rng.randint(0, 90))), "x") for _ in range(150)]
    rows += [(None, "null id", "y"), (None, None, None), (5, None, ""), (5, "same", "z"), (5, "same", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start string").repartition(3)
    path = str(tmp_path / "f")
    T.write_tokens(docs, P.path("word_bpe_49k.json"), path, 2)
    got = T.read_tokens(spark, path, with_ids=True).orderBy("start").collect()
    tok = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    ids = [r.doc_id for r in got]
    assert ids == sorted(ids, key=lambda d: (d is not None, d or 0)) and len(ids) == len(rows)
    at = 0
    for r in got:
        assert r.start == at and len(r.ids) == r.n_tokens and r.ids[-1] == 2
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, dtype="<u4").tobytes())
        at += r.n_tokens
    want = sorted((d is not None, d or 0, tok.encode(t or "", add_special_tokens=False).ids + [2]) for d, t, _ in rows)
    assert sorted((r.doc_id is not None, r.doc_id or 0, list(r.ids)) for r in got) == want
    assert T.token_file(docs.limit(0), P.path("word_bpe_49k.json"), 2).count() == 0


def test_segment_random_access():
    s = T.Segment(T.pack_segment([None, 3, 3, 9], [b"\1\0", b"", b"\2\0\3\0", b"\4\0"], 2))
    assert s.doc_ids() == [None, 3, 3, 9] and [s.tokens(i).tolist() for i in range(4)] == [[1], [], [2, 3], [4]]
