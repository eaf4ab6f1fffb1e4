"""Records of JSON documents, read in ranges: one document of any size is cut over many tasks.

A file is read in pieces that end with a closing brace, so that ranges of it are splits
like those of any text file. A first pass reduces each range to what it does to the
open brackets, once for a start outside and once for a start inside a string. Folding
these per file gives every range its true start, and a second pass cuts the records
out of each range; parts of a record that crosses ranges are joined afterwards.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewright.session import stage

_TOKEN = re.compile(r'["{}\[\]]')
_STRING_END = re.compile(r'[^"\\]*(?:\\.[^"\\]*)*"', re.S)
_KEY = re.compile(r"\s*:")
#: Characters that a range is scanned in at a time.
STEP = 1 << 20
#: Bytes up to which an object that is a whole file is a record of its own.
WHOLE = 1 << 26
#: Kinds of cut text: a whole record, its begin, a range inside of it, its end; a whole document.
RECORD, BEGIN, INSIDE, END, DOCUMENT = range(5)


class Scanner:
    """Follows strings and brackets from a start state; text may come in steps.

    `stack` holds (bracket, key) of what is open; brackets closed beyond it are counted in `closed`.
    With `cut`, values that stand in the list at the top, or in a list of the object at the top, are given out as records.
    """

    def __init__(self, in_string: bool = False, stack: list | None = None, cut: bool = False):
        self.text, self.at, self.in_string, self.cut = "", 0, in_string, cut
        self.stack, self.closed, self.key = [tuple(x) for x in stack or []], 0, None
        self.begin: int | None = 0 if cut and self._inside() else None
        self.foreign = self.begin is not None  # the open record began in an earlier range
        self.records: list[tuple[int, str | None, str]] = []

    def _inside(self) -> bool:
        level = self._level()
        return level is not None and len(self.stack) > level

    def _level(self) -> int | None:
        """Number of brackets around a record here."""
        s = self.stack
        if s and s[0][0] == "[":
            return 1
        return 2 if len(s) > 1 and s[1][0] == "[" else None

    def list_key(self) -> str | None:
        return self.stack[1][1] if self.stack[0][0] == "{" else None

    def feed(self, text: str) -> None:
        keep = min(self.at, self.at if self.begin is None else self.begin)
        self.text, self.at = self.text[keep:] + text, self.at - keep
        self.begin = None if self.begin is None else self.begin - keep
        while True:
            if self.in_string:  # only at the start of a range
                end = _STRING_END.match(self.text, self.at)
                if not end:
                    return
                self.in_string, self.at = False, end.end()
            token = _TOKEN.search(self.text, self.at)
            if not token:
                self.at = len(self.text)
                return
            c, here = token.group(), token.start()
            if c == '"':
                end = _STRING_END.match(self.text, here + 1)
                if not end:
                    self.at = here  # read again when there is more
                    return
                if _KEY.match(self.text, end.end()):
                    self.key = self.text[here + 1 : end.end() - 1]
                self.at = end.end()
                continue
            self.at = here + 1
            if c in "{[":
                if self.cut and self.begin is None and len(self.stack) == self._level():
                    self.begin = here
                self.stack.append((c, self.key))
                self.key = None
            elif self.stack:
                self.stack.pop()
                if self.begin is not None and len(self.stack) == self._level():
                    self.records.append((END if self.foreign else RECORD, self.list_key(), self.text[self.begin : self.at]))
                    self.begin, self.foreign = None, False
            else:
                self.closed += 1

    def open_string(self) -> bool:
        return self.in_string or self.at < len(self.text)

    def rest(self) -> tuple[int, str | None, str] | None:
        """What is open at the end of the range."""
        return None if self.begin is None else (INSIDE if self.foreign else BEGIN, self.list_key(), self.text[self.begin :])


def _ranges(batches) -> Iterator[tuple[str, int, int, Iterator[str]]]:
    """(file, start of the range, size of the file, pieces without the brace between them) of each range of a task, in order."""
    def pieces():
        for b in batches:
            yield from zip(*[b.column(i).to_pylist() for i in range(4)])

    for (file, block, size), rows in groupby(pieces(), key=lambda r: r[1:]):
        yield file, block, size, (r[0] for r in rows)


def _steps(pieces: Iterator[str]) -> Iterator[str]:
    held, n = [], 0
    for p in pieces:
        held.append(p + "}")
        n += len(p) + 1
        if n >= STEP:
            yield "".join(held)
            held, n = [], 0
    if held:
        yield "".join(held)


_SUMMARY = pa.schema([("file_id", pa.string()), ("block", pa.int64()), ("size", pa.int64()), ("bytes", pa.int64()), ("doing", pa.string())])


def _summaries(batches):
    """What each range does to the state, without the brace behind its last piece."""
    for file, block, size, pieces in _ranges(batches):
        ways, n, last = [Scanner(False), Scanner(True)], 0, None
        for p in pieces:
            n += len(p.encode()) + 1
            if last is not None:
                for s in ways:
                    s.feed(last + "}")
            last = p
        for s in ways:
            s.feed(last)
        doing = json.dumps([[s.open_string(), s.closed, s.stack] for s in ways])
        yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((file, block, size, n, doing), _SUMMARY)], schema=_SUMMARY)


_STATE = pa.schema([("file_id", pa.string()), ("block", pa.int64()), ("state", pa.string()), ("root", pa.string()), ("broken", pa.bool_())])


def _states(batches):
    """Start state of every range of a file; `root` and `broken`, in the row of its last range, hold for the file."""
    rows = (r for b in batches for r in zip(*[b.column(i).to_pylist() for i in range(5)]))
    for file, parts in groupby(rows, key=lambda r: r[0]):
        parts = list(parts)
        in_string, stack, root, total, out = False, [], None, sum(p[3] for p in parts), []
        for k, (_, block, size, _, doing) in enumerate(parts):
            out.append((file, block, json.dumps([in_string, stack]), None, None))
            in_string, closed, opened = json.loads(doing)[in_string]
            stack = stack[: max(0, len(stack) - closed)] + opened
            root = root or (opened[0][0] if opened else "{")
            # the last piece of a file may stand without a brace
            if not in_string and stack and (k + 1 < len(parts) or total == size):
                stack = stack[:-1]
        out[-1] = (*out[-1][:3], root, bool(in_string or stack))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _STATE)], schema=_STATE)


_CUT = pa.schema([("file_id", pa.string()), ("block", pa.int64()), ("key", pa.string()), ("idx", pa.int64()), ("kind", pa.int32()), ("record", pa.string())])
_CUT_KIND = "file_id string, block long, key string, idx long, kind int, record string"


def _cutter(starts: dict[tuple[str, int], str]):
    def run(batches):
        out: list[tuple] = []
        for file, block, size, pieces in _ranges(batches):
            in_string, stack = json.loads(starts.get((file, block), "[false, []]"))
            scanner, counts, whole = Scanner(in_string, stack, cut=True), {}, []
            small = block == 0 and size <= WHOLE
            for text in _steps(pieces):
                scanner.feed(text)
                if small:
                    whole.append(text)
                for kind, key, record in scanner.records:
                    idx = counts.get(key, 0) if kind == RECORD else -1
                    if kind == RECORD:
                        counts[key] = idx + 1
                    out.append((file, block, key, idx, kind, record))
                scanner.records = []
                if len(out) >= 5000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _CUT)], schema=_CUT)
                    out = []
            if (rest := scanner.rest()) is not None:
                out.append((file, block, rest[1], counts.get(rest[1], 0) if rest[0] == BEGIN else -1, rest[0], rest[2]))
            elif small and not scanner.stack and (text := "".join(whole)).lstrip().startswith("{"):
                out.append((file, 0, None, 0, DOCUMENT, text.rstrip().removesuffix("}") if len(text.encode()) > size else text))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _CUT)], schema=_CUT)

    return run


def _joined(batches):
    """Records that cross ranges, from their parts in order."""
    rows = (r for b in batches for r in zip(*[b.column(i).to_pylist() for i in range(6)]))
    for _, parts in groupby(rows, key=lambda r: r[0]):
        held: list | None = None
        for file, block, key, idx, kind, text in parts:
            if kind == BEGIN:
                held = [(file, block, key, idx), text]
            elif held:
                held.append(text)
                if kind == END:
                    head, *texts = held
                    yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((*head, RECORD, "".join(texts)), _CUT)], schema=_CUT)
                    held = None


def records(spark: SparkSession, paths) -> DataFrame:
    """(file_id, key, pos, record): objects and lists that stand in the list at the top of a document (key null) or in a named list of it.

    `pos` counts them per file and list from 0. An object that is a whole file of at
    most WHOLE bytes in one range comes as a record of its own too, with key '' and pos 0. Documents
    that end early or close more than they opened give nothing. Names of lists hold no braces.
    """
    pieces = spark.read.option("lineSep", "}").text(paths).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("_metadata.file_size").alias("size"))
    found = pieces.mapInArrow(_summaries, "file_id string, block long, size long, bytes long, doing string")
    states = stage(found.repartition("file_id").sortWithinPartitions("file_id", "block").mapInArrow(
        _states, "file_id string, block long, state string, root string, broken boolean"))
    # one row for every range behind the first of a file: some hundred bytes per split of the input
    starts = {(r.file_id, r.block): r.state for r in states.where("block > 0").select("file_id", "block", "state").collect()}
    cut = stage(pieces.mapInArrow(_cutter(starts), _CUT_KIND))
    parts = cut.where(F.col("kind").isin(BEGIN, INSIDE, END)).withColumn("late", F.col("kind") == BEGIN)
    crossing = parts.repartition("file_id").sortWithinPartitions("file_id", "block", "late").drop("late").mapInArrow(_joined, _CUT_KIND)
    good = states.where("broken = false").select("file_id")
    rows = cut.where(F.col("kind") == RECORD).unionByName(crossing).join(good, "file_id", "left_semi")
    before = Window.partitionBy("file_id", "key").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    own = F.col("kind").isin(RECORD, BEGIN)
    counts = cut.where(own).groupBy("file_id", "key", "block").agg(F.count(F.lit(1)).alias("n")).select(
        F.col("file_id").alias("_f"), F.col("key").alias("_k"), F.col("block").alias("_b"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    placed = rows.join(counts, (F.col("file_id") == F.col("_f")) & F.col("key").eqNullSafe(F.col("_k")) & (F.col("block") == F.col("_b")))
    whole = cut.where(F.col("kind") == DOCUMENT).join(good, "file_id", "left_semi").select("file_id", F.lit("").alias("key"), F.lit(0).cast("long").alias("pos"), "record")
    return placed.select("file_id", "key", (F.col("first") + F.col("idx")).alias("pos"), "record").unionByName(whole)
