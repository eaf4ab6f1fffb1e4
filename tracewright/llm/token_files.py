"""Token-id files with Elias-Fano document boundaries.

A file is a folder of Parquet parts whose rows are segments: a concatenated array
of ids and, in front of it, where documents begin and which they are. Both are
non-decreasing sequences and take about two bits a document over the logarithm of
their mean gap; sampled select structures give the i-th value without a table of
64-bit offsets. Segments follow each other in ascending doc_id order, so offsets
over the whole file need only the totals of the segments before.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewright.llm.chunks import library_encoder
from tracewright.llm.common import column, record, row_key, steps, whole_text
from tracewright.session import scratch, shuffle_width

#: Bytes of ids after which a segment is closed, and ones between two select samples.
SEGMENT, SAMPLE = 4_000_000, 256
_HEAD = struct.Struct("<4sBqqqq")


@dataclass(frozen=True)
class EliasFano:
    """Non-decreasing numbers from 0 on: low bits packed, high bits in unary."""

    n: int
    low_bits: int
    low: bytes
    high: bytes
    samples: np.ndarray

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        top = int(values[-1]) if n else 0
        bits = max(0, (top // max(n, 1)).bit_length() - 1) if top else 0
        low = ((values[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8) if bits else np.zeros((n, 0), np.uint8)
        ones = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        unary = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        unary[ones] = 1
        return cls(n, bits, np.packbits(low.ravel(), bitorder="little").tobytes(), np.packbits(unary, bitorder="little").tobytes(), ones[::SAMPLE].astype("<u4"))

    def pack(self) -> bytes:
        return struct.pack("<qBqqq", self.n, self.low_bits, len(self.low), len(self.high), len(self.samples)) + self.low + self.high + self.samples.tobytes()

    @classmethod
    def unpack(cls, data: memoryview) -> tuple[EliasFano, memoryview]:
        n, bits, low, high, samples = struct.unpack_from("<qBqqq", data)
        at = struct.calcsize("<qBqqq")
        ends = np.cumsum([at, low, high, 4 * samples]).tolist()
        part = [bytes(data[a:b]) for a, b in zip(ends, ends[1:])]
        return cls(n, bits, part[0], part[1], np.frombuffer(part[2], "<u4")), data[ends[-1] :]

    def _low(self, i: int) -> int:
        start = i * self.low_bits
        raw = int.from_bytes(self.low[start // 8 : (start + self.low_bits + 7) // 8], "little")
        return (raw >> (start % 8)) & ((1 << self.low_bits) - 1)

    def select(self, i: int) -> int:
        """Value number i, found from the sample before it."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        byte, skip = at // 8, at % 8
        word = self.high[byte] >> skip << skip
        while (ones := word.bit_count()) <= left:
            left -= ones
            byte += 1
            word = self.high[byte]
        for _ in range(left):
            word &= word - 1
        return ((byte * 8 + (word & -word).bit_length() - 1 - i) << self.low_bits) | self._low(i)

    def values(self) -> np.ndarray:
        """All values at once."""
        ones = np.flatnonzero(np.unpackbits(np.frombuffer(self.high, np.uint8), bitorder="little"))[: self.n]
        out = (ones - np.arange(self.n)).astype(np.uint64) << np.uint64(self.low_bits)
        if self.low_bits:
            low = np.unpackbits(np.frombuffer(self.low, np.uint8), bitorder="little")[: self.n * self.low_bits].reshape(self.n, self.low_bits)
            out |= low.astype(np.uint64) @ (np.uint64(1) << np.arange(self.low_bits, dtype=np.uint64))
        return out


def pack_segment(doc_ids: list[int | None], ids: list[bytes], width: int) -> bytes:
    """One segment; documents without id come first and ids ascend."""
    nulls = sum(d is None for d in doc_ids)
    base = doc_ids[nulls] if nulls < len(doc_ids) else 0
    starts = np.cumsum([0, *(len(x) // width for x in ids)])
    names = np.array([d - base for d in doc_ids[nulls:]], dtype=np.uint64)
    return (_HEAD.pack(b"EFT1", width, len(doc_ids), nulls, base, int(starts[-1]))
            + EliasFano.of(starts).pack() + EliasFano.of(names).pack() + b"".join(ids))


class Segment:
    """Reads one segment."""

    def __init__(self, payload: bytes):
        magic, self.width, self.n_docs, self.nulls, self.base, self.n_tokens = _HEAD.unpack_from(payload)
        if magic != b"EFT1":
            raise ValueError("not a token segment")
        self.starts, rest = EliasFano.unpack(memoryview(payload)[_HEAD.size :])
        self.names, self.ids = EliasFano.unpack(rest)

    def tokens(self, i: int) -> np.ndarray:
        """Ids of document number i of this segment, by two selects."""
        return np.frombuffer(self.ids[self.starts.select(i) * self.width : self.starts.select(i + 1) * self.width], f"<u{self.width}")

    def doc_ids(self) -> list[int | None]:
        return [None] * self.nulls + [self.base + int(x) for x in self.names.values()]


def write_tokens(docs: DataFrame, vocabulary: str, path: str, end_id: int, id_bytes: int = 2) -> None:
    """Encode the documents and write them to the new folder `path` in ascending doc_id order.

    `end_id` is appended to every document. Documents without id come first,
    rows of one id are ordered by a hash of their text, equal rows all stay. A
    null text is empty, an empty table writes no segment.
    """
    spark = docs.sparkSession
    width, end = f"<u{id_bytes}", end_id.to_bytes(id_bytes, "little")
    parts = pa.schema([("part", pa.int32()), ("segment", pa.int32()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("payload", pa.binary())])

    def segments(batches):
        part, number, held, enc = TaskContext.get().partitionId(), 0, 0, library_encoder(vocabulary, width)
        names, ids = [], []

        def close():
            return record(parts, part=[part], segment=[number], n_docs=[len(names)], n_tokens=[held // id_bytes], payload=[pack_segment(names, ids, id_bytes)])

        for b in steps(batches):
            for d, x in zip(column(b, "doc_id").to_pylist(), enc.encode(column(b, "text").to_pylist())):
                x += end
                if held and held + len(x) > SEGMENT:
                    yield close()
                    number, held, names, ids = number + 1, 0, [], []
                names.append(d)
                ids.append(x)
                held += len(x)
        if names:
            yield close()

    source = whole_text(docs, "doc_id").select("doc_id", row_key("text").alias("key"), "text")
    order = [F.col("doc_id").asc_nulls_first(), F.col("key")]
    # the key cuts an id that very many rows share; texts are ordered before they are
    # encoded, as the sample for the ranges would encode them all once more
    ordered = source.repartitionByRange(shuffle_width(spark), *order).sortWithinPartitions(*order)
    ordered.select("doc_id", "text").mapInArrow(segments, "part int, segment int, n_docs long, n_tokens long, payload binary").write.parquet(path)


def read_tokens(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (ids as little-endian 32-bit) and, on request, the ids of every document."""
    file = spark.read.schema("part int, segment int, n_docs long, n_tokens long, payload binary").parquet(path)
    heads = file.select("part", "segment", "n_tokens")
    # one row per task of the writer, then one window per task of the writer
    totals = heads.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("part").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    first = totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    offsets = heads.withColumn("inner", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).join(first, "part").select(
        "part", "segment", (F.col("base") + F.col("inner")).alias("offset"))
    fields = [("part", pa.int32()), ("segment", pa.int32()), ("doc_id", pa.int64()), ("inner", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())]
    schema = pa.schema(fields + [("ids", pa.list_(pa.int32()))] * with_ids)

    def run(batches):
        for b in batches:
            for part, number, payload in zip(column(b, "part").to_pylist(), column(b, "segment").to_pylist(), column(b, "payload")):
                s = Segment(payload.as_py())
                starts = np.array([s.starts.select(i) for i in range(s.n_docs + 1)], np.int64)
                flat = np.frombuffer(s.ids, f"<u{s.width}")
                texts = [flat[a:e] for a, e in zip(starts[:-1].tolist(), starts[1:].tolist())]
                out = {
                    "part": [part] * s.n_docs, "segment": [number] * s.n_docs, "doc_id": s.doc_ids(), "inner": starts[:-1], "n_tokens": np.diff(starts),
                    "ids_crc32": [zlib.crc32(x.astype("<u4").tobytes()) for x in texts]}
                if with_ids:
                    out["ids"] = texts
                yield record(schema, **{n: out[n] for n in schema.names})

    kinds = "part int, segment int, doc_id long, inner long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    rows = file.select("part", "segment", "payload").mapInArrow(run, kinds)
    return rows.join(offsets, ["part", "segment"]).select(
        "doc_id", (F.col("offset") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)


def token_file(docs: DataFrame, vocabulary: str, end_id: int, path: str | None = None) -> DataFrame:
    """Write the documents and read them back."""
    spark = docs.sparkSession
    path = path or scratch(spark, "tokens")
    write_tokens(docs, vocabulary, path, end_id)
    return read_tokens(spark, path)
