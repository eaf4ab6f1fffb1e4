"""Annotation documents: scan to tables, tables to documents."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tracewright import schemas
from tracewright.sources import documents


def read(spark: SparkSession, paths) -> dict[str, DataFrame]:
    """Images, categories and annotations of many documents, each row with its file and its place in the list.

    A document is cut into ranges that many tasks read. One that ends early gives no rows.
    """
    found = documents.records(spark, paths)
    kinds = StructType.fromDDL(schemas.COCO)

    def rows(name: str) -> DataFrame:
        return found.where(F.col("key") == name).select("file_id", "pos", F.from_json("record", kinds[name].dataType.elementType).alias("r")).select("file_id", "pos", "r.*")

    return {name: rows(name) for name in ("images", "categories", "annotations")}


#: Rows of a table that go to one document where the caller names no number of documents.
ROWS = 5_000_000


def write_tables(tables: dict[str, DataFrame], path: str) -> None:
    """One table per kind below `path`, split by the `split` column where there is one."""
    for name, df in tables.items():
        w = df.write.mode("overwrite")
        (w.partitionBy("split") if "split" in df.columns else w).json(f"{path}/{name}")


def write_documents(tables: dict[str, DataFrame], path: str, shards: int | None = None, key: str = "image_id") -> None:
    """The tables as `shards` documents, a file each; `read` takes them together.

    Without a number there is a document for every ROWS rows of the largest table.

    Rows with a `key`, or with `id` in the table of that key's own rows, go to the shard
    of its hash, other tables to every shard. Lines stream through the tasks, so a
    document may be larger than memory.
    """
    names = list(tables)
    shards = shards or max(1, -(-max(df.count() for df in tables.values()) // ROWS))
    rows = None
    for n, (name, df) in enumerate(tables.items()):
        own = key if key in df.columns else "id" if name == f"{key.removesuffix('_id')}s" else None
        every = F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))
        shard = every if own is None else F.pmod(F.xxhash64(F.col(own).cast("long")), F.lit(shards)).cast("int")
        part = df.select(shard.alias("shard"), F.lit(n).alias("kind"), F.to_json(F.struct(*df.columns)).alias("value"))
        rows = part if rows is None else rows.unionByName(part)

    def lines(batches):
        kind, started = -1, False

        def upto(k: int) -> list[str]:
            """Closes lists and opens those up to number k."""
            nonlocal kind
            out = []
            while kind < k:
                out += ["]" + ("," if kind + 1 < len(names) else "")] if kind >= 0 else ["{"]
                kind += 1
                out += [f"{json.dumps(names[kind])}: ["] if kind < len(names) else ["}"]
            return out

        for b in batches:
            out = []
            for k, value in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                new = upto(k)
                out += new
                out.append(value if new else "," + value)
                started = True
            if out:
                yield pa.RecordBatch.from_pydict({"value": out})
        if started:
            yield pa.RecordBatch.from_pydict({"value": upto(len(names))})

    placed = rows.repartitionById(shards, F.col("shard")).sortWithinPartitions("kind")
    placed.select("kind", "value").mapInArrow(lines, "value string").write.mode("overwrite").text(path)
