"""Quality rules on repetition inside a text, by suffix arrays over its words.

The suffix array of many texts is built at once by prefix doubling: after round k
the ranks order suffixes by their first 2^k words, and only suffixes that still
share a rank go on. Longest common prefixes of neighbours follow from the ranks
of all rounds. They bound the maximal repeated substrings; their spans are united,
and the covered share of the text and the longest repeat are limited.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tracewright.llm.common import column, record, steps, utf8, whole_text

SYMBOLS = b"#*$%&|<>"
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
FOLLOWING = bytes(range(0x80, 0xC0))


@dataclass(frozen=True)
class Rules:
    """Limits. Repeats of fewer than `least_words` words are no repeats."""

    window: int = 8
    fewest_words: int = 20
    most_repeat_percent: int = 30
    least_words: int = 10
    most_covered: float = 0.25
    longest_repeat: int = 200


def ranks_by_doubling(words: np.ndarray, text: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """Ranks of all suffixes by their first 1, 2, 4, ... words, until no two suffixes of a text share one.

    `words` are word numbers, `text` the text of each position, `ends` its end.
    """
    n = len(words)
    at = np.argsort(text * (int(words.max(initial=0)) + 1) + words, kind="stable")
    new = np.ones(n, bool)
    new[1:] = (text[at][1:] != text[at][:-1]) | (words[at][1:] != words[at][:-1])
    head = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[at] = head
    levels, h = [rank], 1
    size = np.diff(np.append(np.flatnonzero(new), n))
    active = at[np.repeat(size > 1, size)]
    while active.size:
        follows = np.where(active + h < ends[active], rank[np.minimum(active + h, n - 1)], -1)
        order = np.lexsort((follows, rank[active]))
        active, follows = active[order], follows[order]
        group = rank[active]
        first = np.ones(active.size, bool)
        first[1:] = group[1:] != group[:-1]
        new = first.copy()
        new[1:] |= follows[1:] != follows[:-1]
        here = np.arange(active.size)
        base = np.maximum.accumulate(np.where(first, here, 0))
        head = np.maximum.accumulate(np.where(new, here, 0))
        rank = rank.copy()
        rank[active] = group + head - base
        levels.append(rank)
        size = np.diff(np.append(np.flatnonzero(new), active.size))
        active = active[np.repeat(size > 1, size)]
        h *= 2
    return levels


def same_start(levels: list[np.ndarray], length: int, ends: np.ndarray) -> np.ndarray:
    """A number per position that is equal where the next `length` words are; negative where they don't fit."""
    k = min(length.bit_length() - 1, len(levels) - 1)
    rank, n = levels[k], len(ends)
    fits = np.arange(n) + length <= ends
    if k < length.bit_length() - 1:
        return np.where(fits, rank, -1)  # all suffixes differ already
    rest = rank[np.minimum(np.arange(n) + length - (1 << k), n - 1)]
    return np.where(fits, rank * n + rest, -1)


def longest_repeats(levels: list[np.ndarray], least: int, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions where a repeat of `least` or more words starts, and the length of the longest there."""
    start = same_start(levels, least, ends)
    there = np.flatnonzero(start >= 0)
    order = there[np.argsort(levels[-1][there], kind="stable")]
    shared = start[order][1:] == start[order][:-1] if order.size else np.zeros(0, bool)
    a, b = order[:-1][shared], order[1:][shared]
    common = np.zeros(a.size, np.int64)
    for k in range(len(levels) - 1, -1, -1):
        i, j = a + common, b + common
        ok = (i + (1 << k) <= ends[a]) & (j + (1 << k) <= ends[b])
        ok[ok] = levels[k][i[ok]] == levels[k][j[ok]]
        common += ok * (1 << k)
    # every level counts once, from the top: no two suffixes share a rank of the last one
    best = np.zeros(len(ends), np.int64)
    np.maximum.at(best, a, common)
    np.maximum.at(best, b, common)
    at = np.flatnonzero(best)
    return at, best[at]


def covered(at: np.ndarray, length: np.ndarray, n: int) -> np.ndarray:
    """Which of n positions lie in a span [at, at + length)."""
    edge = np.bincount(at, minlength=n + 1)[: n + 1] - np.bincount(at + length, minlength=n + 1)[: n + 1]
    return np.cumsum(edge)[:n] > 0


def measure(texts: list[bytes], rules: Rules) -> dict[str, np.ndarray]:
    """All figures and the verdict of each text."""
    number = defaultdict(count().__next__)
    split = [t.split() for t in texts]
    n_words = np.array([len(w) for w in split], np.int64)
    total = int(n_words.sum())
    out = {
        "n_words": n_words,
        "word_chars": np.array([len(t.translate(None, SPACES + FOLLOWING)) for t in texts], np.int64),
        "n_symbols": np.array([len(t) - len(t.translate(None, SYMBOLS)) for t in texts], np.int64),
        "n_dup_lines": np.array([_copied_lines(t) for t in texts], np.int64),
    }
    repeat, cover, longest = (np.zeros(len(texts), np.int64) for _ in range(3))
    spans: list = [()] * len(texts)
    if total:
        words = np.fromiter((number[w] for x in split for w in x), np.int64, total)
        chars = np.fromiter((len(w) for x in split for w in x), np.int64, total)
        text = np.repeat(np.arange(len(texts)), n_words)
        ends = np.repeat(np.cumsum(n_words), n_words)
        levels = ranks_by_doubling(words, text, ends)
        start = same_start(levels, rules.window, ends)
        fits = np.flatnonzero(start >= 0)
        _, inverse, size = np.unique(start[fits], return_inverse=True, return_counts=True)
        again = fits[size[inverse] > 1]
        inside = covered(again, np.full(again.size, rules.window), total)
        repeat = np.bincount(text[inside], minlength=len(texts))
        at, length = longest_repeats(levels, rules.least_words, ends)
        inside = covered(at, length, total)
        cover = np.bincount(text, weights=inside * chars, minlength=len(texts)).astype(np.int64)
        np.maximum.at(longest, text[at], length)
        whole = np.bincount(text, weights=chars, minlength=len(texts))
        share = cover / np.maximum(whole, 1)
        base = np.cumsum(n_words) - n_words
        edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
        for s, e in zip(edge[::2].tolist(), edge[1::2].tolist()):
            while s < e:  # spans of neighbouring texts may touch
                t = int(text[s])
                stop = min(e, int(ends[s]))
                spans[t] = (*spans[t], {"start": s - int(base[t]), "end": stop - int(base[t])})
                s = stop
    else:
        share = np.zeros(len(texts))
    failed = (n_words < rules.fewest_words) | (100 * repeat > rules.most_repeat_percent * n_words)
    return out | {
        "n_repeat_words": repeat.astype(np.int64), "base_failed": failed, "covered": share, "longest_repeat": longest, "spans": spans,
        "kept": ~failed & (share <= rules.most_covered) & (longest <= rules.longest_repeat)}


def _copied_lines(text: bytes) -> int:
    lines = [x for x in text.split(b"\n") if x.strip(SPACES)]
    return len(lines) - len(set(lines))


_SCHEMA = pa.schema(
    [("doc_id", pa.int64())] + [(n, pa.int64()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    + [("base_failed", pa.bool_()), ("kept", pa.bool_()), ("covered", pa.float64()), ("longest_repeat", pa.int64()),
       ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])


def quality_rules(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Figures, repeated spans (in words) and verdict of every row.

    Nulls: a null text has no words, so it fails; a null doc_id is kept. Repeated
    rows get a row each, an empty table gives none, other columns are dropped.
    """
    def run(batches):
        for b in steps(batches):
            yield record(_SCHEMA, doc_id=column(b, "doc_id"), **measure(utf8(b), rules))

    kinds = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, covered double, longest_repeat long, spans array<struct<start: long, end: long>>"
    return whole_text(docs, "doc_id").mapInArrow(run, kinds)


def keep_documents(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The rows of `docs`, with all their columns, that the rules keep. A null text goes."""
    def run(batches):
        for b in steps(batches):
            texts = [t or b"" for t in utf8(b)]
            yield b.filter(pa.array(measure(texts, rules)["kept"]))

    return docs.mapInArrow(run, docs.schema)
