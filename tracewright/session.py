"""Session helpers: where lineage is cut and how wide a range sort is."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the session's `spark.checkpoint.dir`; fall back only in local mode.

    A folder on one machine does not survive the loss of that machine, so on a
    cluster an unset directory is an error.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        sc.setCheckpointDir(named)
    elif sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")


def stage(df: DataFrame) -> DataFrame:
    """Cut lineage: write `df` as a table in the shared checkpoint folder and read it back.

    A columnar table keeps column pruning, and its known size lets the planner
    broadcast it only when it is small.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes in memory that a byte of a file may stand for: codecs and dictionaries pack numbers, and rows are multiplied by grid cells.
UNPACKED = 64.0


def count_unpacked(spark: SparkSession) -> None:
    """Let the planner take files as `UNPACKED` times their size, so that it broadcasts a table only if its rows are small too.

    By file size alone it would build tables of a million rows in the driver. What a
    shuffle has measured to be small is broadcast as before.
    """
    key = "spark.sql.sources.fileCompressionFactor"
    if float(spark.conf.get(key)) < UNPACKED:
        spark.conf.set(key, str(UNPACKED))


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name inside the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
