import random

import public_tokenizers as P
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
import test_dart_minhash
import test_line_runs
import test_packing
import test_repetition
from tracewright.llm import line_runs, repetition


def corpus():
    rng = random.Random(11)
    own = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    shared, lines = own(60), ["boiler plate one", "boiler plate two"]
    texts = [None, "", "too short", "again and again here it goes on " * 20]
    for i in range(25):
        body = [own(rng.randint(8, 30)) for _ in range(rng.randint(2, 6))]
        if i % 4 == 0:
            body.insert(1, shared)
        if i % 3 == 0:
            body[1:1] = lines
        texts.append("\n".join(body))
        if i % 6 == 0:
            texts += [texts[-1], texts[-1].replace(" w", "  w", 2), own(3) + " " + texts[-1].replace("\n", " ") + " " + own(2)]
    return [(i * 2, t, "en", f"s{i % 3}", None if t is None else len(t)) for i, t in enumerate(texts)]


def test_pipeline_equals_brute_force(spark, tmp_path):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    kept = [r for r in rows if test_repetition.plain((r[1] or "").encode(), repetition.Rules())["kept"]]
    assert 3 < len(kept) < len(rows)
    keys = {r.t: r.k for r in spark.createDataFrame([(r[1],) for r in kept], "t string").select("t", F.xxhash64("t").alias("k")).collect()}
    cut = test_line_runs.plain([(r[0], r[1]) for r in kept], keys, line_runs.Runs())
    texts = [cut[(r[0], r[1])][3] for r in kept]
    want = test_dart_minhash.classes(texts)
    first = [min(i for i, x in enumerate(want) if x == c) for c in dict.fromkeys(want)]
    assert len(first) < len(texts)
    left = [(kept[i][0], texts[i], *kept[i][2:4], len(texts[i])) for i in first]
    step = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, step, str(tmp_path)).write.parquet(str(tmp_path / f"out{k}"))
        step = spark.read.parquet(str(tmp_path / f"out{k}"))
        assert step.columns == docs.columns, name
    assert sorted(tuple(r) for r in step.collect()) == sorted(left)
    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    pieces = sorted((d, s, n, c) for d, t, *_ in left for s, n, c in test_packing.pieces(tok, t, 2048))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in got) == pieces
