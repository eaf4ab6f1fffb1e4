"""Document fingerprints by context-triggered piecewise hashing.

A hash of the last bytes, rolled along the text, marks the boundaries of chunks:
they depend on their surroundings alone, so an edit moves only the chunks that it
touches. Every chunk gives one letter. The block size 3 * 2^i is the smallest whose
boundaries are at most 64; the fingerprint holds the letters for it and for its
double, and two fingerprints are compared by edit distance where sizes agree.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.llm.common import column, record, row_key, steps, whole_text
from tracewright.session import shuffle_width, stage

#: Bytes of context, most boundaries, and letters that two signatures must share in a row.
WINDOW, MOST, SHARED = 7, 64, 4
_FACTOR = 0x2C1B3C6D | 1
LETTERS = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)


@lru_cache(maxsize=1)
def _byte_values() -> np.ndarray:
    """A fixed random number for each byte."""
    x = (np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(32)).astype(np.uint32)


def _spread(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint32(16))
    x = x * np.uint32(0x7FEB352D)
    x = x ^ (x >> np.uint32(15))
    x = x * np.uint32(0x846CA68B)
    return x ^ (x >> np.uint32(16))


def fingerprints(texts: list[bytes]) -> list[str]:
    """`blocksize:letters:letters of the double size` of each text; the empty text has `3::`."""
    lengths = np.array([len(t) for t in texts], np.int64)
    total = int(lengths.sum())
    if not total:
        return ["3::"] * len(texts)
    gap = bytes(WINDOW)
    raw = np.frombuffer(gap + gap.join(texts), np.uint8)
    value = _byte_values()[raw]
    rolled = value.copy()
    for k in range(1, WINDOW):
        rolled[k:] += value[:-k] * np.uint32(pow(_FACTOR, k, 2**32))
    doc = np.repeat(np.arange(len(texts)), lengths)
    rolled = _spread(rolled[np.arange(total) + (doc + 1) * WINDOW])
    # a boundary for block size 3 * 2^i is a hash that is -1 modulo it; larger sizes have fewer of the same
    up = rolled + np.uint32(1)
    marks = np.flatnonzero((up % np.uint32(3) == 0) & (up != 0))
    low = up[marks] & (~up[marks] + np.uint32(1))
    level = np.log2(low.astype(np.float64)).astype(np.int64)
    counts = np.bincount(doc[marks] * 33 + level, minlength=33 * len(texts)).reshape(-1, 33)
    at_least = counts[:, ::-1].cumsum(axis=1)[:, ::-1]
    size = (at_least > MOST).sum(axis=1)
    starts = np.cumsum(lengths) - lengths
    mixed = _spread(rolled ^ np.uint32(0x5BD1E995))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed, dtype=np.uint64)])
    single = _signature(marks, level, size[doc[marks]], doc, starts, lengths, sums)
    double = _signature(marks, level, size[doc[marks]] + 1, doc, starts, lengths, sums)
    return [f"{3 << int(s)}:{a}:{b}" for s, a, b in zip(size, single, double)]


def _signature(marks, level, needed, doc, starts, lengths, sums) -> list[str]:
    ends = marks[level >= needed] + 1
    last = (starts + lengths)[lengths > 0]
    ends = np.union1d(ends, last)
    begins = np.concatenate([[0], ends[:-1]])  # texts end where the next begins
    chunk = sums[ends] - sums[begins] + (ends - begins).astype(np.uint64)
    letter = LETTERS[((chunk * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(58)).astype(np.int64)]
    cuts = np.cumsum(np.bincount(doc[ends - 1], minlength=len(lengths)))
    text = letter.tobytes().decode()
    return [text[a:b] for a, b in zip([0, *cuts.tolist()], cuts.tolist())]


def likeness(a: Column, b: Column) -> Column:
    """0 to 1: best agreement of two fingerprints over block sizes that both have; 0 if they share none."""
    sa, sb = (F.split(x, ":") for x in (a, b))
    part = lambda s, i: F.regexp_replace(s.getItem(i), r"(.)\1{3,}", "$1$1$1")
    na, nb = sa.getItem(0).cast("long"), sb.getItem(0).cast("long")
    return (
        F.when(a == b, 1.0)
        .when(na == nb, F.greatest(_agreement(part(sa, 1), part(sb, 1)), _agreement(part(sa, 2), part(sb, 2))))
        .when(na == 2 * nb, _agreement(part(sa, 1), part(sb, 2)))
        .when(2 * na == nb, _agreement(part(sa, 2), part(sb, 1)))
        .otherwise(0.0))


def _agreement(x: Column, y: Column) -> Column:
    """One minus the edit distance over the longer length; 0 without a common run of letters."""
    grams = lambda s: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(s) - (SHARED - 1))), lambda i: F.substring(s, i, SHARED))
    longer = F.greatest(F.length(x), F.length(y))
    short = F.least(F.length(x), F.length(y)) < SHARED
    near = short | F.arrays_overlap(grams(x), grams(y))
    return F.when(longer == 0, 0.0).when(near, 1.0 - F.levenshtein(x, y) / longer).otherwise(0.0)


def edited(text: str, following: str) -> str:
    """`text` whose last third is the start of the following text."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


_FIELDS = "part int, edge string, doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, next_fingerprint string, text string"
_ROWS = pa.schema([
    ("part", pa.int32()), ("edge", pa.string()), ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()),
    ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("next_fingerprint", pa.string()), ("text", pa.string())])


def _edit_rows(part: int, rows: list[tuple], following: list[tuple]) -> pa.RecordBatch:
    """rows: (doc_id, text, fingerprint); following: (text, fingerprint) of the next document of each."""
    changed = [edited(t, f[0]).encode() for (_, t, _), f in zip(rows, following)]
    n = len(rows)
    return record(
        _ROWS, part=[part] * n, edge=[None] * n, doc_id=[r[0] for r in rows], n_chars=[len(r[1]) for r in rows],
        edited_sha256=[hashlib.sha256(c).hexdigest() for c in changed], fingerprint=[r[2] for r in rows],
        edited_fingerprint=fingerprints(changed), next_fingerprint=[f[1] for f in following], text=[None] * n)


def compare_documents(docs: DataFrame) -> DataFrame:
    """Fingerprint of every text and of its edited text, and how alike they are.

    doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next. The next document is the one after in descending doc_id order, nulls
    last, equal ids by a hash of the text, repeated rows one after the other; after
    the last comes the first, so a single document follows itself. Null texts are
    empty, other columns are dropped, an empty table gives no rows.
    """
    spark = docs.sparkSession

    def run(batches):
        part, held, first = TaskContext.get().partitionId(), None, True
        for b in steps(batches):
            ids, texts = column(b, "doc_id").to_pylist(), column(b, "text").to_pylist()
            rows = list(zip(ids, texts, fingerprints([t.encode() for t in texts])))
            if first:
                yield _edge(part, "first", rows[0])
                first = False
            rows = [held, *rows] if held else rows
            held = rows.pop()
            if rows:
                yield _edit_rows(part, rows, [r[1:] for r in [*rows[1:], held]])
        if held:
            yield _edge(part, "last", held)

    source = whole_text(docs, "doc_id").select("doc_id", row_key("text").alias("key"), "text")
    order = [F.col("doc_id").desc_nulls_last(), F.col("key").desc()]
    ordered = source.repartitionByRange(shuffle_width(spark), *order).sortWithinPartitions(*order).select("doc_id", "text")
    # the ranges depend on a sample, so every later step reads one written run
    done = stage(ordered.mapInArrow(run, _FIELDS))
    first, last = done.where("edge = 'first'"), done.where("edge = 'last'")
    # one row per task of the step above
    turn = Window.orderBy("part")
    ring = first.select("part", F.lead("part").over(turn).alias("to"), F.min("part").over(Window.partitionBy(F.lit(0))).alias("start"))
    ring = ring.select("part", F.coalesce("to", "start").alias("to"))
    heads = first.select(F.col("part").alias("to"), F.col("text").alias("next_text"), F.col("fingerprint").alias("next_mark"))

    def close(batches):
        for b in batches:
            if b.num_rows:
                rows = list(zip(*[column(b, n).to_pylist() for n in ("doc_id", "text", "fingerprint")]))
                yield _edit_rows(-1, rows, list(zip(*[column(b, n).to_pylist() for n in ("next_text", "next_mark")])))

    edges = last.select("part", "doc_id", "text", "fingerprint").join(ring, "part").join(heads, "to").mapInArrow(close, _FIELDS)
    rows = done.where("edge IS NULL").unionByName(edges)
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"))


def _edge(part: int, edge: str, row: tuple) -> pa.RecordBatch:
    return record(
        _ROWS, part=[part], edge=[edge], doc_id=[row[0]], n_chars=[len(row[1])], edited_sha256=[None], fingerprint=[row[2]],
        edited_fingerprint=[None], next_fingerprint=[None], text=[row[1]])
