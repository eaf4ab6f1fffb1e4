"""Helpers shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Text bytes that one Python step handles at a time; a longer text is a step of its own.
STEP_BYTES = 2_000_000


def whole_text(docs: DataFrame, *keep: str, text: str = "text") -> DataFrame:
    """The columns `keep` and the text, null read as empty; other columns go, whatever their names."""
    return docs.select(*[F.col(c) for c in keep], F.coalesce(F.col(text), F.lit("")).alias("text"))


def row_key(*columns: str) -> Column:
    """64-bit key that tells rows of one id apart by content."""
    return F.xxhash64(*columns)


def steps(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about `size` bytes in `column`, at least one row each."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        lengths = pc.binary_length(batch.column(batch.schema.get_field_index(column))).to_pylist()
        start = held = 0
        for i, n in enumerate(lengths):
            n = n or 1  # null
            if held and held + n > size:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        yield batch.slice(start)


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def utf8(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """The texts of a batch as bytes, without decoding them."""
    return column(batch, name).cast(pa.binary()).to_pylist()


def record(schema: pa.Schema, **values) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [v if isinstance(v, pa.Array) else pa.array(v, type=schema.field(n).type) for n, v in ((f, values[f]) for f in schema.names)], schema=schema)
