"""Named queries with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from tracewright.plans.views import VIEWS, check_text, spark_text
from tracewright.session import count_unpacked

FAMILIES = ("evaluation", "boxes", "datasets", "quality", "tokens", "wires", "records", "streams", "files")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


class Tables:
    """The given tables and the derived views of one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir.rstrip("/")
        count_unpacked(spark)

    def __call__(self, name: str) -> DataFrame:
        if name in VIEWS:
            return self.spark.sql(spark_text(name, self.sf_dir))
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def query(name: str, check: str | None = None):
    def add(build: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = lambda spark, sf_dir: build(Tables(spark, sf_dir))
        if check is not None:
            CHECKS[name] = check_text(check)
        return build

    return add


def load() -> None:
    for family in FAMILIES:
        import_module(f"tracewright.plans.{family}")
