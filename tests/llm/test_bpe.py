import os
import random

import numpy as np
import pytest

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
import public_tokenizers as P
from tokenizers import Tokenizer

from tracewright.llm import bpe

PATH = P.path("byte_bpe_50k.json")


def nasty(seed, n=400):
    rng = random.Random(seed)
    bits = ["the", " and", "  ", "\n", "\t", " \n", " ", " ", "\x1c", "\x85", "é", "é", "ß", "日本", "🙂", "<|endoftext|>", "<|end", "'s", "'ll", "123", "½", "Ⅻ", "ͅ", "_", "--", "!!!", "x" * 70, "ab" * 90, "\0", "İ", " ", " ", " a", "Σ"]
    return ["".join(rng.choice(bits) for _ in range(rng.randint(0, 25))) for _ in range(n)]


def test_ids_equal_the_library():
    tok, enc = Tokenizer.from_file(PATH), bpe.Encoder(PATH)
    texts = nasty(1) + ["", " ", "a", "a ", " a", "\n", "z" * 3000]
    for t, ids in zip(texts, enc.encode(texts)):
        want = tok.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want, repr(t)
        assert enc.decode(ids) == tok.decode(want, skip_special_tokens=False)


def test_short_and_long_trees_agree():
    v, rng = bpe.vocabulary(PATH), random.Random(2)
    pieces = [bytes(rng.choice(b" theandiogr\xc3\xa9") for _ in range(rng.randint(2, 64))) for _ in range(500)]
    for p, ids in zip(pieces, bpe.merge_all(pieces, v)):
        assert np.frombuffer(ids, "<u4").tolist() == bpe.merge_long(p, v)


def test_store_of_any_size_gives_the_same():
    enc = bpe.Encoder(PATH)
    texts = nasty(3, 50)
    want = enc.encode(texts)
    enc.store.kept = 3
    assert [enc.encode([t])[0] for t in texts] == want


def test_rows(spark):
    rows = [(1, "a b", "x"), (1, "a b", "x"), (None, None, None), (2, "", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = bpe.encode_documents(docs, PATH, with_ids=True)
    assert sorted((r.doc_id or 0, r.n_tokens, r.same_text) for r in got.collect()) == [(0, 0, True), (1, 2, True), (1, 2, True), (2, 0, True)]
    assert sorted(r.text for r in bpe.decode_documents(got, PATH).collect()) == ["", "", "a b", "a b"]
    assert bpe.encode_documents(docs.limit(0), PATH).count() == 0
