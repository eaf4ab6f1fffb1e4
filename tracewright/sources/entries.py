"""The entry store: newest state per id, in buckets that split with their size, read through a manifest.

A bucket (bits, prefix) holds the ids whose hash ends in `prefix`, written with `bits`
bits; buckets part the hashes among them without gaps. A merge writes the buckets that
its changes touch to new folders, parted further where they have grown, and then one
small file that names the folders of all buckets. A reader takes the newest such file,
so it sees the store before a merge or after it. Folders that the last KEEP
manifests don't name are removed. One writer at a time.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright import schemas
from tracewright.session import stage

#: Entries of a bucket; a bucket with more is parted at the next merge that touches it.
ROWS = 1_000_000
#: Manifests that stay readable.
KEEP = 3
_MANIFEST = "bits int, prefix bigint, folder string, rows bigint, version bigint"
_FIELDS = ["id", "type", "label", "filename", "payload", "is_delete", "seq"]


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(bits, prefix, folder, rows, version) of every bucket of the newest version; one bucket without folder in a new store."""
    every = _manifests(spark, path)
    newest = every.agg(F.max("version")).first()[0]
    if newest is None:
        return spark.createDataFrame([(0, 0, None, 0, 0)], _MANIFEST)
    return every.where(F.col("version") == newest)


def _manifests(spark: SparkSession, path: str) -> DataFrame:
    folder = f"{path}/manifests"
    spark.createDataFrame([], _MANIFEST).write.mode("ignore").partitionBy("version").parquet(folder)
    return spark.read.schema(_MANIFEST).parquet(folder)


def _rows(spark: SparkSession, path: str, folders: list[str]) -> DataFrame:
    if not folders:
        return spark.createDataFrame([], schemas.ENTRY)
    return spark.read.schema(schemas.ENTRY).parquet(*[f"{path}/data/{f}" for f in folders]).select(*_FIELDS)


def read_entries(spark: SparkSession, path: str) -> DataFrame:
    """Entries that are there, without those deleted, as of the newest version."""
    folders = [r.folder for r in manifest(spark, path).where("folder IS NOT NULL").select("folder").collect()]  # one name per ROWS entries
    return _rows(spark, path, folders).where("NOT is_delete").select("id", "type", "label", "filename", "payload")


def _hash() -> Column:
    return F.xxhash64("id")


def _prefix(bits: Column) -> Column:
    return F.pmod(_hash(), F.pow(F.lit(2.0), bits).cast("bigint"))


def _placed(rows: DataFrame, buckets: DataFrame) -> DataFrame:
    """`rows` with bits and prefix of their bucket."""
    depths = sorted(r.bits for r in buckets.select("bits").distinct().collect())
    tries = F.array(*[F.struct(F.lit(b).alias("bits"), _prefix(F.lit(b)).alias("prefix")) for b in depths])
    tried = rows.withColumn("_t", F.explode(tries)).select("*", "_t.bits", "_t.prefix").drop("_t")
    return tried.join(buckets.select("bits", "prefix"), ["bits", "prefix"])


def merge_entries(changes: DataFrame, path: str, rows_per_bucket: int = ROWS) -> None:
    """Apply changes in any order of arrival: per id the one with the largest `seq` decides, deletions too.

    Deleted ids stay as marks, so an older change cannot bring them back. Only
    buckets that the changes touch are written. Applying changes twice does no harm,
    a merge that fails leaves the store as it was.
    """
    spark = changes.sparkSession
    old = stage(manifest(spark, path))
    new = stage(_placed(changes.select(*[c for c in _FIELDS if c not in ("is_delete", "seq")], F.coalesce(F.col("is_delete"), F.lit(False)).alias("is_delete"), "seq"), old))
    touched = old.join(new.select("bits", "prefix").distinct(), ["bits", "prefix"], "left_semi")
    known = touched.select("bits", "prefix", "folder", "version").collect()  # one row per ROWS entries at most
    if not known:
        return
    before = _placed(_rows(spark, path, [r.folder for r in known if r.folder]), old)
    all_rows = before.select(*_FIELDS, "bits", "prefix").unionByName(new.select(*_FIELDS, "bits", "prefix"))
    rest = [c for c in _FIELDS if c != "id"]
    last = stage(all_rows.groupBy("id", "bits", "prefix").agg(F.max_by(F.struct(*rest), F.struct("seq", "is_delete")).alias("r")).select("id", "bits", "prefix", "r.*"))
    # a bucket with too many rows gets as many more bits as halving it down takes
    more = F.greatest(F.lit(0), F.ceil(F.log2(F.col("n") / rows_per_bucket))).cast("int")
    grown = last.groupBy("bits", "prefix").agg(F.count(F.lit(1)).alias("n")).select("bits", "prefix", (F.col("bits") + more).alias("to"))
    parted = last.join(grown, ["bits", "prefix"]).drop("bits", "prefix").withColumnRenamed("to", "bits").withColumn("prefix", _prefix(F.col("bits")))
    folder = f"{known[0].version + 1}-{uuid.uuid4().hex}"
    parted.repartition("bits", "prefix").write.partitionBy("bits", "prefix").parquet(f"{path}/data/{folder}")
    counts = parted.groupBy("bits", "prefix").agg(F.count(F.lit(1)).alias("rows"))
    # every part of a bucket is named, also one that no id falls into
    power = lambda c: F.pow(F.lit(2.0), c).cast("bigint")
    whole = grown.select(F.col("bits").alias("_b"), F.col("prefix").alias("_p"), "to")
    parts = whole.select(F.col("to").alias("bits"), F.explode(F.transform(
        F.sequence(F.lit(0).cast("bigint"), power(F.col("to") - F.col("_b")) - 1), lambda k: F.col("_p") + k * power(F.col("_b")))).alias("prefix"))
    name = F.when(F.col("rows") > 0, F.concat(F.lit(f"{folder}/bits="), "bits", F.lit("/prefix="), "prefix"))
    written = parts.join(counts, ["bits", "prefix"], "left").withColumn("rows", F.coalesce("rows", F.lit(0))).select("bits", "prefix", name.alias("folder"), "rows")
    kept = old.join(touched.select("bits", "prefix"), ["bits", "prefix"], "left_anti").select("bits", "prefix", "folder", "rows")
    # one file: it is there as a whole or not at all
    kept.unionByName(written).coalesce(1).write.parquet(f"{path}/manifests/version={known[0].version + 1}")
    _expire(spark, path, known[0].version + 1 - KEEP)


def _expire(spark: SparkSession, path: str, upto: int) -> None:
    """Remove the manifests up to a version and the merges' folders that only they name."""
    every = _manifests(spark, path)
    old = [r.version for r in every.where(F.col("version") <= upto).select("version").distinct().collect()]
    if not old:
        return
    merge = F.element_at(F.split("folder", "/"), 1).alias("merge")
    named = every.where("folder IS NOT NULL").select((F.col("version") <= upto).alias("old"), merge).groupBy("merge").agg(F.min("old").alias("gone"))
    gone = [r.merge for r in named.where("gone").select("merge").collect()]  # folders of a few merges
    for name in [f"manifests/version={v}" for v in old] + [f"data/{m}" for m in gone]:
        target = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
        target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(target, True)
