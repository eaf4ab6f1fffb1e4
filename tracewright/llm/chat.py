"""Formatting of conversations with a compiled template, and reading the result back."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import column, record
from tracewright.llm.templates import Template, compile_template, unguard, unguard_line

START, END = "<|im_start|>", "<|im_end|>"
#: One marked turn after the other; assistant texts are generated.
TURNS = (
    "{% for message in messages %}" + START + "{{ message.role|guard_line }}\n"
    "{% if message.role == 'assistant' %}{% generation %}{{ message.text|guard }}{% endgeneration %}"
    "{% else %}{{ message.text|guard }}{% endif %}" + END + "\n{% endfor %}")
#: Code points after which a row of formatted text is closed.
ROW = 100_000


@lru_cache(maxsize=16)
def _template(source: str) -> Template:
    return compile_template(source)


_ROWS = pa.schema([
    ("conv_id", pa.int64()), ("part", pa.int64()), ("offset", pa.int64()), ("text", pa.string()), ("last", pa.bool_()),
    ("loss", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])


def _turns(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*[column(b, n).to_pylist() for n in ("conv_id", "role", "text")])


def _format(template: Template, turns: Iterator[tuple]) -> Iterator[tuple]:
    """Rows of at most about ROW code points, or one turn; holds one row, not the conversation."""
    for conv, rows in groupby(turns, key=lambda r: r[0]):
        messages = ({"role": r or "", "text": t or ""} for _, r, t in rows)
        held, spans, part, start, at = [], [], 0, 0, 0
        for text, generated in template.parts(messages):
            if at - start > ROW:
                yield conv, part, start, "".join(held), False, spans
                held, spans, part, start = [], [], part + 1, at
            if generated and text:
                spans.append({"start": at, "end": at + len(text)})
            held.append(text)
            at += len(text)
        yield conv, part, start, "".join(held), True, spans


def format_conversations(conversations: DataFrame, template: str = TURNS) -> DataFrame:
    """Formatted text of every conversation: conv_id, part, offset, text, last, loss.

    The parts of a conversation, joined in order, are its text; `loss` holds the
    generated spans in code points of the whole text. Turns stand in the order of
    `turn`, nulls first, equal turns by role and text; repeated rows all stay. Null
    roles and texts are empty, rows without conv_id are one conversation without id.
    A template that walks through the messages once is rendered as the sorted turns
    stream by, so a conversation of any length needs the memory of one row.
    """
    _template(template)  # errors belong to the caller

    def run(batches):
        rows = []
        for row in _format(_template(template), _turns(batches)):
            rows.append(row)
            if len(rows) >= 500 or len(row[3]) > ROW:
                yield record(_ROWS, **dict(zip(_ROWS.names, zip(*rows))))
                rows = []
        if rows:
            yield record(_ROWS, **dict(zip(_ROWS.names, zip(*rows))))

    kinds = "conv_id long, part long, offset long, text string, last boolean, loss array<struct<start: long, end: long>>"
    turns = conversations.select("conv_id", "turn", "role", "text")
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "text")]
    return turns.repartition("conv_id").sortWithinPartitions(*order).select("conv_id", "role", "text").mapInArrow(run, kinds)


class TurnReader:
    """Reads turns back from formatted text that comes in parts."""

    def __init__(self):
        self.buffer, self.n = "", 0
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.loss_chars = self.chars = 0

    def feed(self, text: str, spans: list[tuple[int, int]]) -> None:
        """`spans` are the loss spans inside `text`."""
        self.chars += len(text)
        for a, b in spans:
            own = unguard(text[a:b])
            self.loss_chars += len(own)
            self.loss.update(own.encode())
        self.buffer += text
        at = 0
        while (end := self.buffer.find(END, at)) >= 0 and len(self.buffer) > end + len(END):
            if not self.buffer.startswith(START, at) or self.buffer[end + len(END)] != "\n":
                raise ValueError("not a sequence of marked turns")
            role, _, body = self.buffer[at + len(START) : end].partition("\n")
            self.turns.update(f"{unguard_line(role)}\n{unguard(body)}\n".encode())
            self.n += 1
            at = end + len(END) + 1
        self.buffer = self.buffer[at:]

    def close(self) -> dict:
        if self.buffer:
            raise ValueError("a turn is not closed")
        return {
            "n_turns": self.n, "turns_sha256": self.turns.hexdigest(), "loss_chars": self.loss_chars,
            "loss_sha256": self.loss.hexdigest(), "formatted_chars": self.chars}


def read_turns(formatted: DataFrame) -> DataFrame:
    """Digests per conversation, read back from what `format_conversations` returned with TURNS.

    The rows must come as that function returns them: the parts of a conversation
    together and in order.
    """
    schema = pa.schema([
        ("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
        ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def run(batches):
        reader = None
        for b in batches:
            out = []
            for conv, offset, text, last, spans in zip(*[column(b, n).to_pylist() for n in ("conv_id", "offset", "text", "last", "loss")]):
                reader = reader or TurnReader()
                reader.feed(text, [(s["start"] - offset, s["end"] - offset) for s in spans])
                if last:
                    out.append({"conv_id": conv, **reader.close()})
                    reader = None
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=schema)

    return formatted.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
