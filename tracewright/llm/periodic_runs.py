"""Runs of words that repeat with a period, found online by dyadic catchers.

At level k a catcher holds the last completed block of 2^k words before the block
that is being read. Every appended word completes one window of 2^k words, whose hash
follows from two windows of the level below and is compared with the catcher's block.
An equal window lies p words behind the block, 2^k <= p < 2^(k+1); two such blocks in
a row with one p are a square of period p. Squares of one period that touch merge; a
merged stretch that a run of a smaller period covers is no news, of any other the
words themselves decide where the run begins and ends.

A run with at least four periods holds two neighbouring blocks of its level together
with their copies, so none is missed; equal words have equal hashes, and unequal ones
with equal hashes fall out when the words are compared.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import column, record, steps, utf8, whole_text

#: Fewest periods and words of a run.
PERIODS, WORDS = 4, 6

_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93))
_SHIFT = np.uint64(32)


def _mix(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    x = left * _B + right
    x ^= x >> _SHIFT
    x *= _C
    x ^= x >> _SHIFT
    return x


class _Level:
    """Windows of 2^k words: hashes from position `base` on, the next window `done`, and open stretches by period."""

    def __init__(self, k: int):
        self.k, self.base, self.done = k, 0, 0
        self.hashes = np.zeros(0, np.uint64)
        self.open: dict[int, tuple[int, int]] = {}
        self.squares: list[tuple[int, int, int]] = []

    def extend(self, new: np.ndarray) -> None:
        """Hashes of the next windows; each is compared with the block before its own."""
        k, first = self.k, self.done
        self.hashes = np.concatenate([self.hashes, new])
        self.done = stop = first + len(new)
        at = np.arange(max(first, 1 << k), stop)
        if at.size == 0:
            return
        block = ((at >> k) - 1) << k
        hit = np.flatnonzero(self.hashes[at - self.base] == self.hashes[block - self.base])
        start, period = block[hit], (at - block)[hit]
        self._merge(start, period)

    def _merge(self, start: np.ndarray, period: np.ndarray) -> None:
        size = 1 << self.k
        if self.open:
            known = np.array([(s, e - s, p) for p, (s, e) in self.open.items()], np.int64)
            start, length, period = (np.concatenate([known[:, c], x]) for c, x in enumerate((start, np.full(len(start), size), period)))
        else:
            length = np.full(len(start), size)
        self.open = {}
        if start.size == 0:
            return
        order = np.lexsort((start, period))
        start, length, period = start[order], length[order], period[order]
        new = np.ones(start.size, bool)
        new[1:] = (period[1:] != period[:-1]) | (start[1:] != start[:-1] + length[:-1])
        head = np.flatnonzero(new)
        tail = np.append(head[1:], start.size) - 1
        begin, end, period = start[head], start[tail] + length[tail], period[head]
        alive = end + period >= self.done  # the window that would go on is still to come
        for s, e, p in zip(begin[alive].tolist(), end[alive].tolist(), period[alive].tolist()):
            self.open[p] = (s, e)
        closed = ~alive & (end - begin >= 2 * size)
        self.squares += zip(begin[closed].tolist(), end[closed].tolist(), period[closed].tolist())

    def forget(self, needed: int) -> None:
        """Drop hashes before `needed` and before the block of the next window."""
        keep = max(self.base, min(needed, ((self.done >> self.k) - 1) << self.k, self.done))
        self.hashes, self.base = self.hashes[keep - self.base :], keep

    def stretches(self) -> list[tuple[int, int, int]]:
        return self.squares + [(s, e, p) for p, (s, e) in self.open.items() if e - s >= 2 << self.k]


class Catchers:
    """Reads words, given as numbers, in pieces of any size; `runs` may be asked for at any time.

    `longest` bounds the periods that are looked for; without it any period that fits is.
    """

    def __init__(self, longest: int | None = None):
        self.words, self.levels, self.longest = np.zeros(0, np.int64), [_Level(0)], longest

    def append(self, words: np.ndarray) -> None:
        self.words = np.concatenate([self.words, np.asarray(words, np.int64)])
        n = len(self.words)
        fresh = self.words[self.levels[0].done :].astype(np.uint64) * _A
        self.levels[0].extend(_mix(fresh, fresh))
        k = 1
        while n >= 2 << k and (self.longest is None or self.longest >> k):
            if k == len(self.levels):
                self.levels.append(_Level(k))
            below, level, half = self.levels[k - 1], self.levels[k], 1 << (k - 1)
            first, stop = level.done, n - (1 << k) + 1
            if stop > first:
                left = below.hashes[first - below.base : stop - below.base]
                right = below.hashes[first + half - below.base : stop + half - below.base]
                level.extend(_mix(left, right))
            k += 1
        for k, level in enumerate(self.levels):
            above = self.levels[k + 1].done if k + 1 < len(self.levels) else 0
            level.forget(level.done if self.longest is not None and not self.longest >> (k + 1) else above)

    def runs(self) -> np.ndarray:
        """(start, length, period) of every run of at least four periods, by start, then period."""
        found: list[tuple[int, int, int]] = []
        for level in self.levels:
            stretches = level.stretches()
            if not stretches:
                continue
            s, e, p = np.array(stretches, np.int64).T
            if found:
                known = np.array(sorted(found), np.int64)
                reach = np.maximum.accumulate(known[:, 0] + known[:, 1])
                at = np.searchsorted(known[:, 0], s, "right") - 1
                covered = (at >= 0) & (reach[np.maximum(at, 0)] >= e + p)
                s, e, p = s[~covered], e[~covered], p[~covered]
            here = set()
            for a, b, q in zip(s.tolist(), e.tolist(), p.tolist()):
                here.update(self._runs_around(a, b, q, 1 << level.k))
            found += here
        out = np.array(sorted((s, p, n) for s, n, p in found), np.int64).reshape(-1, 3)
        return out[:, [0, 2, 1]][out[:, 2] >= WORDS]

    def _runs_around(self, start: int, end: int, period: int, block: int):
        low, high = max(0, start - block), min(len(self.words) - period, end + block)
        same = self.words[low:high] == self.words[low + period : high + period]
        edge = np.flatnonzero(np.diff(np.concatenate([[False], same, [False]]).astype(np.int8)))
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
            if b - a >= (PERIODS - 1) * period:
                yield low + a, b - a + period, period


def runs_of(texts: list[list[bytes]]) -> list[np.ndarray]:
    """Runs of each list of words. Lists of similar length are read in one go, with a word of their own between them."""
    out: list = [np.zeros((0, 3), np.int64)] * len(texts)
    number: dict = defaultdict(count().__next__)
    classes = defaultdict(list)
    for i, words in enumerate(texts):
        if len(words) >= WORDS:
            classes[(len(words) // PERIODS).bit_length()].append(i)
    for members in classes.values():
        parts, starts, at, longest = [], [], 0, 0
        for i in members:
            n = len(texts[i])
            parts += [np.fromiter((number[w] for w in texts[i]), np.int64, n), np.array([-1 - i])]
            starts.append(at)
            at += n + 1
            longest = max(longest, n // PERIODS)
        catchers = Catchers(longest)
        catchers.append(np.concatenate(parts))
        found = catchers.runs()
        if len(found):
            owner = np.searchsorted(starts, found[:, 0], "right") - 1
            for j in np.unique(owner).tolist():
                own = found[owner == j]
                own[:, 0] -= starts[j]
                out[members[j]] = own
    return out


def collapse(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words joined by spaces, without those behind the first period of a run."""
    if not len(runs):
        return b" ".join(words)
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    kept = np.cumsum(edge)[:-1] == 0
    return b" ".join([w for w, k in zip(words, kept.tolist()) if k])


_SCHEMA = pa.schema([
    ("doc_id", pa.int64()), ("n_words", pa.int64()),
    ("runs", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))), ("collapsed", pa.string())])


def periodic_runs(docs: DataFrame, rewrite: Callable[[int | None, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """doc_id, n_words, runs (start, length, period in words, by start, then period), collapsed of every row.

    `collapsed` holds the words outside of repeats: a word goes if a run contains it
    behind its first period. `rewrite` may replace the words of a document before.
    Null and empty texts have no words, null ids stay, repeated rows get a row each,
    an empty table gives none.
    """
    def run(batches):
        for b in steps(batches):
            ids = column(b, "doc_id").to_pylist()
            texts = [t.split() for t in utf8(b)]
            if rewrite:
                texts = [rewrite(d, w) for d, w in zip(ids, texts)]
            found = runs_of(texts)
            yield record(
                _SCHEMA, doc_id=column(b, "doc_id"), n_words=[len(w) for w in texts],
                runs=[[{"start": s, "length": n, "period": p} for s, n, p in r.tolist()] for r in found],
                collapsed=pa.array([collapse(w, r) for w, r in zip(texts, found)], pa.binary()).cast(pa.string()))

    return whole_text(docs, "doc_id").mapInArrow(run, "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def _most_repeated(runs: str) -> Column:
    """The run with the greatest length / period; the first one, by start and period, of equals."""
    better = lambda best, r: best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"])
    return F.aggregate(runs, F.element_at(F.col(runs), 1), lambda best, r: F.when(better(best, r), r).otherwise(best))


def digests(found: DataFrame) -> DataFrame:
    """One row per row of `periodic_runs`: number of runs, the most repeated one, hashes of all runs and of the collapsed text."""
    line = lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))
    best = F.when(F.size("runs") > 0, _most_repeated("runs"))
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"), "n_words")
