"""Byte-pair encoding and decoding with segment trees over the ranks of adjacent pairs.

A leaf holds the rank of one pair, the root the leftmost pair of lowest rank. A
merge changes three leaves, so it costs a logarithmic update; encoding ends when
the root holds no pair. Short pieces are merged many at a time, one tree per row
of an array; long ones have a tree of their own. Pieces that texts repeat are
encoded once and kept in a store of bounded size, which changes no result.
"""

from __future__ import annotations

import hashlib
import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tracewright.llm.chunks import PIECES, ChunkStore, byte_letters
from tracewright.llm.common import column, record, steps, whole_text

#: Pieces of up to this many bytes are merged together.
SHORT = 64


class Vocabulary:
    """Ids, ranks and special tokens of a byte-level vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        value = {c: b for b, c in enumerate(byte_letters())}
        names = spec["model"]["vocab"]
        size = max([*names.values(), *(t["id"] for t in spec["added_tokens"])]) + 1
        self.bytes_of: list[bytes] = [b""] * size
        for name, i in names.items():
            self.bytes_of[i] = bytes(value[c] for c in name)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for name, i in self.special.items():
            self.bytes_of[i] = name.encode()
        self.byte_id = np.array([names[c] for c in byte_letters()], dtype=np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        keys = np.array([(names[a] << 32) | names[b] for a, b in pairs], dtype=np.int64)
        self.made = np.array([names[a + b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank_at = keys[order], order.astype(np.int64)
        self.rank_of = dict(zip(keys.tolist(), range(len(pairs))))
        self.no_rank = len(pairs)
        self.split_special = regex.compile("(" + "|".join(regex.escape(s) for s in self.special) + ")") if self.special else None

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, `no_rank` where it cannot be merged."""
        key = (left << 32) | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank_at[at], self.no_rank)


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class PairTree:
    """Segment tree over the pairs of one piece."""

    def __init__(self, ranks: list[int], none: int):
        self.size = 1 << max(1, (len(ranks) - 1).bit_length())
        self.none = none * self.size
        leaves = [self.none] * self.size
        for i, r in enumerate(ranks):
            if r < none:
                leaves[i] = r * self.size + i
        self.tree = [self.none] * self.size + leaves
        for i in range(self.size - 1, 0, -1):
            self.tree[i] = min(self.tree[2 * i], self.tree[2 * i + 1])

    def first(self) -> tuple[int, int] | None:
        """(position, rank) of the leftmost pair of lowest rank."""
        top = self.tree[1]
        return None if top >= self.none else (top % self.size, top // self.size)

    def put(self, i: int, rank: int) -> None:
        tree, at = self.tree, self.size + i
        tree[at] = min(rank * self.size + i, self.none)
        while at > 1:
            at >>= 1
            low = min(tree[2 * at], tree[2 * at + 1])
            if tree[at] == low:
                break
            tree[at] = low


def merge_long(piece: bytes, v: Vocabulary) -> list[int]:
    """Ids of one piece of any length."""
    ids = v.byte_id[np.frombuffer(piece, np.uint8)].tolist()
    n = len(ids)
    if n < 2:
        return ids
    rank = lambda a, b: v.rank_of.get((a << 32) | b, v.no_rank)
    # the last position starts no pair, but has a leaf
    tree = PairTree([*(rank(a, b) for a, b in zip(ids, ids[1:])), v.no_rank], v.no_rank)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    made = v.made
    while (top := tree.first()) is not None:
        i, r = top
        j = after[i]
        k = after[j]
        ids[i], ids[j] = int(made[r]), -1
        after[i] = k
        tree.put(j, v.no_rank)
        if k < n:
            before[k] = i
            tree.put(i, rank(ids[i], ids[k]))
        else:
            tree.put(i, v.no_rank)
        if (p := before[i]) >= 0:
            tree.put(p, rank(ids[p], ids[i]))
    return [x for x in ids if x >= 0]


def merge_short(pieces: list[bytes], v: Vocabulary) -> list[np.ndarray]:
    """Ids of many pieces of 2 to SHORT bytes, with one tree per row."""
    lengths = np.array([len(p) for p in pieces])
    n = int(lengths.max())
    size = 1 << max(1, (n - 2).bit_length())
    m = len(pieces)
    none = v.no_rank * size
    raw = np.frombuffer(b"".join(p.ljust(n, b"\0") for p in pieces), np.uint8).reshape(m, n)
    inside = np.arange(n) < lengths[:, None]
    ids = np.where(inside, v.byte_id[raw], -1)
    tree = np.full((m, 2 * size), none, dtype=np.int64)
    there = inside[:, 1:]
    r = np.full((m, n - 1), v.no_rank, dtype=np.int64)
    r[there] = v.ranks(ids[:, :-1][there], ids[:, 1:][there])
    tree[:, size : size + n - 1] = np.where(r < v.no_rank, r * size + np.arange(n - 1), none)
    s = size
    while s > 1:
        tree[:, s // 2 : s] = np.minimum(tree[:, s : 2 * s : 2], tree[:, s + 1 : 2 * s : 2])
        s //= 2
    after = np.tile(np.arange(1, n + 1, dtype=np.int64), (m, 1))
    before = np.tile(np.arange(-1, n - 1, dtype=np.int64), (m, 1))
    rows = np.flatnonzero(tree[:, 1] < none)
    while rows.size:
        i, rank = tree[rows, 1] % size, tree[rows, 1] // size
        j = after[rows, i]
        k = after[rows, j]
        ids[rows, i] = v.made[rank]
        ids[rows, j] = -1
        after[rows, i] = k
        has = k < lengths[rows]
        before[rows[has], k[has]] = i[has]
        own = np.full(rows.size, v.no_rank, dtype=np.int64)
        own[has] = v.ranks(ids[rows[has], i[has]], ids[rows[has], k[has]])
        # the last position has a pair too, which never merges; its leaf may lie beyond the tree
        tree[rows, size + i] = np.where(own < v.no_rank, own * size + i, none)
        held = j < size
        tree[rows[held], size + j[held]] = none
        p = before[rows, i]
        prior = p >= 0
        left = v.ranks(ids[rows[prior], p[prior]], ids[rows[prior], i[prior]])
        tree[rows[prior], size + p[prior]] = np.where(left < v.no_rank, left * size + p[prior], none)
        for touched, at in ((rows, size + i), (rows[held], size + j[held]), (rows[prior], size + p[prior])):
            while at.size and at[0] > 1:
                at = at >> 1
                tree[touched, at] = np.minimum(tree[touched, 2 * at], tree[touched, 2 * at + 1])
        rows = rows[tree[rows, 1] < none]
    keep = ids >= 0
    flat, ends = ids[keep].astype("<u4"), np.cumsum(keep.sum(axis=1))
    return np.split(flat, ends[:-1])


def merge_all(pieces: list[bytes], v: Vocabulary) -> list[bytes]:
    """Little-endian 32-bit ids of every piece."""
    out: list[bytes | None] = [None] * len(pieces)
    groups: dict[int, list[int]] = {}
    for i, p in enumerate(pieces):
        n = len(p)
        if 1 < n <= SHORT:
            groups.setdefault((n - 1).bit_length(), []).append(i)
        else:
            out[i] = np.array(merge_long(p, v), dtype="<u4").tobytes()
    for members in groups.values():
        for start in range(0, len(members), 20_000):
            part = members[start : start + 20_000]
            for i, ids in zip(part, merge_short([pieces[i] for i in part], v)):
                out[i] = ids.tobytes()
    return out


class Encoder:
    """Texts to ids, equal to the tokenizers library on a byte-level file without normalizer."""

    def __init__(self, path: str):
        self.v = vocabulary(path)
        self.store = ChunkStore(self._chunks)

    def _chunks(self, chunks: list[str]) -> list[bytes]:
        """Ids of whole chunks: their pieces are merged together, each once."""
        number: dict[str, int] = {}
        cut: list[list[int]] = []
        for c in chunks:
            word = c[1:] if c[:1] == " " else c
            if word.isalpha():
                found = [c]
            elif word[:-1].isalpha() and word[-1] in ".,;:!?":
                found = [c[:-1], c[-1]]
            else:
                found = PIECES.findall(c)
            cut.append([number.setdefault(p, len(number)) for p in found])
        ids = merge_all([p.encode() for p in number], self.v)
        return [ids[x[0]] if len(x) == 1 else b"".join([ids[i] for i in x]) for x in cut]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        v, plain, where = self.v, [], []
        for t in texts:
            if v.special and any(s in t for s in v.special):
                parts = v.split_special.split(t)
                where.append((len(plain), parts))
                plain += parts[::2]
            else:
                where.append((len(plain), None))
                plain.append(t)
        ids, out = self.store.encode(plain), []
        for start, parts in where:
            if parts is None:
                out.append(ids[start])
            else:
                out.append(b"".join(
                    ids[start + k // 2] if k % 2 == 0 else v.special[p].to_bytes(4, "little") for k, p in enumerate(parts)))
        return out

    def decode(self, ids: bytes) -> str:
        """The text of the ids; bytes that form no character become the replacement character."""
        return b"".join(map(self.v.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", errors="replace")


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def encode_documents(docs: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, same_text and, on request, the ids of every row.

    Nulls: a null text is the empty text, with no ids; a null doc_id is kept.
    Repeated rows and ids give a row each. Other columns are dropped.
    """
    fields = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), ("same_text", pa.bool_())]
    schema = pa.schema(fields + [("ids", pa.binary())] * with_ids)

    def run(batches):
        enc = encoder(path)
        for b in steps(batches):
            texts = column(b, "text").to_pylist()
            ids = enc.encode(texts)
            back = [enc.decode(x) for x in ids]
            out = {
                "doc_id": column(b, "doc_id"), "n_tokens": [len(x) // 4 for x in ids], "ids_sha256": [hashlib.sha256(x).hexdigest() for x in ids],
                "decoded_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in back], "same_text": [x == y for x, y in zip(texts, back)], "ids": ids}
            yield record(schema, **{n: out[n] for n in schema.names})

    spark_schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, same_text boolean" + ", ids binary" * with_ids
    return whole_text(docs, "doc_id").mapInArrow(run, spark_schema)


def decode_documents(encoded: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """doc_id and decoded text of rows with little-endian 32-bit ids; null ids give a null text."""
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def run(batches):
        enc = encoder(path)
        for b in steps(batches, "ids"):
            yield record(schema, doc_id=column(b, "doc_id"), text=[None if x is None else enc.decode(x) for x in column(b, "ids").to_pylist()])

    return encoded.select("doc_id", encoded[ids].alias("ids")).mapInArrow(run, "doc_id long, text string")
