"""Encoding of texts by way of the chunks between their spaces.

No piece of the patterns used here holds a space but in front, so a text may be
cut before every space that a non-space follows, and the ids of the parts joined.
Natural text repeats its words: each distinct chunk is encoded once and kept.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import regex
from tokenizers import Tokenizer

from tracewright.llm.common import STEP_BYTES

# fixed value: the split pattern of the public byte-level vocabulary
PIECES = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
_CUT = re.compile(r" (?=\S)")
_ODD = re.compile(r" (?:\s|\Z)")


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabulary files.

    Printable Latin-1 bytes stand for themselves, the others for the code points from 256 on.
    """
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, spare = [], 256
    for b in range(256):
        out.append(chr(b if b in shown else spare))
        spare += b not in shown
    return out


#: Stands between chunks that are normalized together; no normalizer changes it or looks across it.
_APART = "\x00"
#: Chunks kept in each of two generations, and the longest chunk kept.
KEPT, LONGEST = 500_000, 64


class ChunkStore:
    """Joins what `encode_chunks` gives for the chunks of texts, keeping a bounded number of them."""

    def __init__(self, encode_chunks: Callable[[list[str]], list[bytes]], kept: int = KEPT):
        self.encode_chunks, self.kept = encode_chunks, kept
        self.now: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    @staticmethod
    def cut(text: str) -> list[str]:
        """First part, then the parts that followed a space, without it."""
        return _CUT.split(text) if _ODD.search(text) else text.split(" ")

    def encode(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = []
        start = held = 0
        for i, t in enumerate(texts):
            if held and held + len(t) > STEP_BYTES:
                out += self._step(texts[start:i])
                start, held = i, 0
            held += len(t)
        return out + self._step(texts[start:])

    def _step(self, texts: list[str]) -> list[bytes]:
        lists = [self.cut(t) for t in texts]
        heads = [x[0] for x in lists]
        known, old = self.now, self.old
        need: set[str] = set()
        for x in lists:
            need.update(x)
        need -= known.keys()
        missing = []
        for c in need:
            ids = old.get(c)
            if ids is None:
                missing.append(c)
            else:
                known[c] = ids
        passing = {}
        for c, ids in zip(missing, self.encode_chunks([" " + c for c in missing])):
            if len(c) <= LONGEST:
                known[c] = ids
            else:
                passing[c] = ids
        get = known.__getitem__ if not passing else (lambda c: passing[c] if c in passing else known[c])
        first = self.encode_chunks(heads)
        out = [f + b"".join(map(get, x[1:])) for f, x in zip(first, lists)]
        if len(known) > self.kept:
            self.old, self.now = known, {}
        return out


class LibraryEncoder:
    """Ids of the tokenizers library, which merges each distinct piece once.

    Known layouts of vocabulary files are cut into pieces here; any other file
    goes through the library text by text.
    """

    def __init__(self, path: str, width: str = "<u4"):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tok = Tokenizer.from_file(path)
        self.tok.no_padding()
        self.tok.no_truncation()
        self.width, self.size = width, np.dtype(width).itemsize
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split_special = regex.compile("(" + "|".join(regex.escape(s) for s in self.special) + ")") if self.special else None
        first = spec["pre_tokenizer"]
        if spec["normalizer"] is None and first["type"] == "ByteLevel" and first["use_regex"] and not first["add_prefix_space"]:
            self.pieces, self.space, self.normal = PIECES, True, None
        elif first["type"] == "Sequence" and first["pretokenizers"][0]["type"] == "Split" and first["pretokenizers"][0]["behavior"] == "Removed":
            self.pieces, self.space, self.normal = regex.compile(first["pretokenizers"][0]["pattern"]["Regex"]), False, self.tok.normalizer
        else:
            self.pieces = None
        self.letters = byte_letters()
        self.id_bytes = [i.to_bytes(self.size, "little") for i in range(min(self.tok.get_vocab_size(), 1 << 8 * self.size))]
        self.store = ChunkStore(self._chunks)
        self.known: dict[str, bytes] = {}

    def _piece(self, piece: str) -> bytes:
        if piece.isascii() and piece.isprintable():
            named = piece.replace(" ", self.letters[32])
        else:
            named = "".join(map(self.letters.__getitem__, piece.encode()))
        known = self.id_bytes
        return b"".join([known[t.id] for t in self.tok.model.tokenize(named)])

    def _normalized(self, chunks: list[str]) -> list[str]:
        """The chunks without the space in front, normalized; a separator keeps those beyond ASCII apart in one call."""
        plain = [c.removeprefix(" ") for c in chunks]
        odd = [i for i, c in enumerate(plain) if not c.isascii()]
        if odd:
            whole = self.normal.normalize_str(_APART.join([plain[i] for i in odd])).split(_APART)
            if len(whole) != len(odd):  # a chunk holds the separator
                whole = [self.normal.normalize_str(plain[i]) for i in odd]
            for i, c in zip(odd, whole):
                plain[i] = c
        return [c.lower() if c.isascii() else c for c in plain]

    def _chunks(self, chunks: list[str]) -> list[bytes]:
        ids, out = self.known, []
        for c in chunks if self.space else self._normalized(chunks):
            word = c.removeprefix(" ") if self.space else c
            if word.isalpha():
                found = (c,)
            elif word[:-1].isalpha() and word[-1] in ".,;:!?":
                found = (c[:-1], c[-1])
            else:
                found = self.pieces.findall(c)
            own = b""
            for p in found:
                if (part := ids.get(p)) is None:
                    part = self._piece(p)
                    if len(p) <= LONGEST:
                        ids[p] = part
                own += part
            out.append(own)
        if len(ids) > KEPT // 2:
            ids.clear()
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian ids of each text."""
        if self.pieces is None:
            return [np.array(e.ids, dtype=self.width).tobytes() for e in self.tok.encode_batch(texts, add_special_tokens=False)]
        plain, where = [], []
        for t in texts:
            parts = self.split_special.split(t) if self.special and any(s in t for s in self.special) else [t]
            where.append((len(plain), parts))
            plain += parts[::2]
        ids, size = self.store.encode(plain), self.size
        return [
            ids[at] if len(parts) == 1 else b"".join(
                ids[at + k // 2] if k % 2 == 0 else self.special[p].to_bytes(size, "little") for k, p in enumerate(parts))
            for at, parts in where]


@lru_cache(maxsize=4)
def library_encoder(path: str, width: str = "<u4") -> LibraryEncoder:
    return LibraryEncoder(path, width)
