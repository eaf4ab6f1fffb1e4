import math
import random
from collections import Counter

import public_tokenizers as P
from tokenizers import Tokenizer

from tracewright.llm import token_counts as C

PATH = P.path("byte_bpe_50k.json")


def test_histogram_equals_brute_force(spark):
    rng = random.Random(2)
    rows = [(rng.choice([None, "a", "b", ""]), rng.choice([0, 1, 5, rng.randint(0, 30_000)])) for _ in range(800)]
    hist = C.length_histogram(spark.createDataFrame(rows, "g string, n_tokens long"), ["g"])
    got = {(r.g, r.length): r for r in hist.collect()}
    assert set(got) == set(rows)
    for (g, n), r in got.items():
        own = [x for k, x in rows if k == g]
        assert (r.n_docs, r.n_tokens) == (own.count(n), own.count(n) * n)
        assert (r.docs_from, r.tokens_from) == (sum(x >= n for x in own), sum(x for x in own if x >= n))
        assert (r.docs_upto, r.all_docs, r.all_tokens) == (sum(x <= n for x in own), len(own), sum(own))
        assert (r.kept_tokens, r.cut_tokens) == (sum(min(x, n) for x in own), sum(max(0, x - n) for x in own))
    limits = [0, 1, 7, 4096, 9999, 10**6]
    for r in C.truncated_totals(hist, limits, ["g"]).collect():
        own = [x for k, x in rows if k == r.g]
        assert (r.longer_docs, r.kept_tokens, r.cut_tokens) == (
            sum(x > r.limit for x in own), sum(min(x, r.limit) for x in own), sum(max(0, x - r.limit) for x in own))
    for r in C.length_quantiles(hist, [0.0, 0.25, 0.5, 0.999, 1.0], ["g"]).collect():
        own = sorted(x for k, x in rows if k == r.g)
        assert r.length == own[max(1, math.ceil(r.q * len(own))) - 1]


def test_lengths(spark):
    rows = [(1, "a b c", "en", "x"), (1, "a b c", "en", "x"), (None, None, None, None), (3, "", "de", "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, n_tokens string")
    tok = Tokenizer.from_file(PATH)
    want = Counter((lang, len(tok.encode(t or "", add_special_tokens=False).ids)) for _, t, lang, _ in rows)
    got = C.length_histogram(C.encoded_lengths(docs, PATH, ["lang"]), ["lang"])
    assert {(r.lang, r.length): r.n_docs for r in got.collect()} == want
    assert [(r.length, r.n_docs) for r in C.length_histogram(C.encoded_lengths(docs, PATH)).orderBy("length").collect()] == [(0, 2), (3, 2)]
    none = C.length_histogram(C.encoded_lengths(docs.limit(0), PATH))
    assert none.count() == 0 == C.truncated_totals(none, [5]).count() == C.length_quantiles(none, [0.5]).count()
