import zlib
from collections import Counter

import pytest
import zstandard

from tracewright.llm import language_id as L

SF = "/root/testdata/sf0.01"
EN = "the quick brown fox jumps over the lazy dog and then the dog sleeps in the sun while the fox runs away from them "
DE = "der schnelle braune fuchs springt ueber den faulen hund und dann schlaeft der hund in der sonne und der fuchs laeuft "


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_held_out_accuracy(spark, documents):
    got = L.classify_documents(documents).collect()
    want = {r.doc_id: r for r in documents.select("doc_id", "lang", "text").collect()}
    assert sorted(r.doc_id for r in got) == sorted(want)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert all(0 <= r.score <= 1 and (r.margin >= L.Settings().narrow) == r.accepted for r in got)
    held = [r for r in got if r.held_out and len(want[r.doc_id].text) >= 100]
    assert sum(r.lang_pred == want[r.doc_id].lang for r in held) >= 0.985 * len(held)
    sure = [r for r in held if r.accepted]
    assert sum(r.lang_pred == want[r.doc_id].lang for r in sure) >= 0.99 * len(sure)


def test_labels_are_no_inputs(spark, documents):
    from pyspark.sql import functions as F

    model = L.fit(documents.where(~L.held_out()))
    a = {r.doc_id: tuple(r) for r in L.identify(documents, model, "doc_id").collect()}
    b = L.identify(documents.withColumn("lang", F.lit("xx")).withColumn("source", F.lit(None)), model, "doc_id").collect()
    assert {r.doc_id: tuple(r) for r in b} == a


def test_model_is_a_word_list(spark):
    """Dictionary and sizes against plain counting and plain compression."""
    rows = [(i, EN * (1 + i % 3), "en") for i in range(6)] + [(i, DE * 2, "de") for i in range(6, 9)] + [(9, EN, None), (10, None, "fr")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = L.fit(docs, L.Settings(rows=9, dictionary_bytes=60))
    assert set(model.dictionaries) == {"en", "de"} and model.sampled == {"en": 3, "de": 1}
    n = Counter(w for t in {EN, EN * 2, EN * 3} for w in t.encode().split())
    words, size = [], 0
    for w in sorted(n, key=lambda w: (-n[w], w)):
        size += len(w) + 1
        if size > 60:
            break
        words.append(w + b" ")
    assert model.dictionaries["en"] == b"".join(reversed(words))
    d = zstandard.ZstdCompressionDict(model.dictionaries["en"], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    p = zstandard.ZstdCompressionParameters.from_level(3, min_match=4, strategy=zstandard.STRATEGY_GREEDY, window_log=17, write_content_size=False)
    data = b" ".join((EN * 60).encode().split())
    plain = sum(len(zstandard.ZstdCompressor(dict_data=d, compression_params=p).compress(data[i : i + 4096])) for i in range(0, len(data), 4096))
    assert abs(model.sizes(EN * 60)["en"] - plain) <= 6 * (1 + len(data) // 4096)  # headers name the dictionary or not


def test_edges(spark):
    rows = [(i, EN, "en") for i in range(20)] + [(i, DE, "de") for i in range(20, 40)]
    rows += [(50, None, "en"), (51, "", None), (52, "12 34 #!", "de"), (53, "½ ²", "de"), (None, EN, "en"), (54, "x", "en"), (55, EN * 3000, None), (50, None, "en")]
    docs = spark.createDataFrame([(*r, "a", "b") for r in rows], "doc_id long, text string, lang string, score string, margin string")
    got = sorted(map(tuple, L.classify_documents(docs).collect()), key=repr)
    assert len(got) == len(rows)
    by = {r[0]: r for r in got}
    assert [by[i][2:4] for i in (50, 51, 52, 53)] == [("und", 0.0)] * 4
    assert by[None][1:3] == (True, "en") and by[55][2] == "en" and by[3][2] == "en" and by[30][2] == "de" and by[54][2] in ("en", "de")
    assert L.classify_documents(docs.limit(0)).count() == 0
    alone = L.classify_documents(docs.where("lang IS NULL"))
    assert {r.lang_pred for r in alone.collect()} == {"und"}
