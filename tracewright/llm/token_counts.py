"""Token counts by an exact histogram of encoded lengths.

Documents are aggregated by length; suffix sums over the lengths then answer, for
any context limit, how many documents are longer, how many tokens a limit keeps
and cuts, and every quantile. Lengths are summed in blocks, so no task walks the
whole histogram.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.llm.chunks import library_encoder
from tracewright.llm.common import column, steps, whole_text
from tracewright.session import stage

#: Lengths per block of the suffix sums.
BLOCK = 4096


def encoded_lengths(docs: DataFrame, vocabulary: str, by: Sequence[str] = ()) -> DataFrame:
    """`by` and n_tokens of every row; a null text has no tokens."""
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in by)

    def run(batches):
        enc = library_encoder(vocabulary)
        for b in steps(batches):
            counts = pa.array([len(x) // 4 for x in enc.encode(column(b, "text").to_pylist())], pa.int64())
            yield pa.RecordBatch.from_arrays([*[column(b, c) for c in by], counts], names=[*by, "n_tokens"])

    return whole_text(docs, *by).mapInArrow(run, f"{kinds}{', ' * bool(by)}n_tokens long")


def length_histogram(lengths: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row per group and length with its counts and suffix sums.

    n_docs, n_tokens: documents of this length and their tokens; docs_from,
    tokens_from: of this length or more; docs_upto: of this length or less;
    all_docs, all_tokens: of the group. kept_tokens is what a context limit of this
    length leaves of all documents, cut_tokens what it takes away. Null groups are
    groups. An empty table has no rows.
    """
    by = list(by)
    hist = lengths.groupBy(*by, "n_tokens").agg(F.count(F.lit(1)).alias("n_docs")).withColumnRenamed("n_tokens", "length")
    hist = hist.withColumns({"tokens": F.col("length") * F.col("n_docs"), "block": F.floor(F.col("length") / BLOCK)})
    keys = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"_k{i}") for i, c in enumerate(by)] + [F.col(c).isNull().alias(f"_n{i}") for i, c in enumerate(by)]
    names = [f"_k{i}" for i in range(len(by))] + [f"_n{i}" for i in range(len(by))]
    hist = stage(hist.select("*", *keys))  # read twice below; the encoder runs once
    whole = Window.partitionBy(*names, F.lit(0))
    later = Window.partitionBy(*names, F.lit(0)).orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = hist.groupBy(*names, "block").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t")).select(
        *names, "block", F.sum("d").over(whole).alias("all_docs"), F.sum("t").over(whole).alias("all_tokens"),
        F.coalesce(F.sum("d").over(later), F.lit(0)).alias("_d"), F.coalesce(F.sum("t").over(later), F.lit(0)).alias("_t"))
    inside = Window.partitionBy(*names, "block").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, 0)
    summed = hist.withColumns({"_dd": F.sum("n_docs").over(inside), "_tt": F.sum("tokens").over(inside)}).join(blocks, [*names, "block"])
    docs_from, tokens_from = F.col("_dd") + F.col("_d"), F.col("_tt") + F.col("_t")
    kept = F.col("all_tokens") - tokens_from + F.col("length") * docs_from
    return summed.select(
        *by, "length", "n_docs", F.col("tokens").alias("n_tokens"), docs_from.alias("docs_from"), tokens_from.alias("tokens_from"),
        (F.col("all_docs") - docs_from + F.col("n_docs")).alias("docs_upto"), "all_docs", "all_tokens", kept.alias("kept_tokens"), (F.col("all_tokens") - kept).alias("cut_tokens"))


def truncated_totals(hist: DataFrame, limits: Sequence[int], by: Sequence[str] = ()) -> DataFrame:
    """For each limit: documents longer than it, tokens it keeps and cuts. Limits need not be lengths that occur.

    One pass over the histogram adds up every limit, so there is a row per group and limit.
    """
    by = list(by)
    longer = lambda n: F.col("length") > n
    one = lambda n: F.struct(
        F.lit(n).cast("long").alias("limit"), F.coalesce(F.sum(F.when(longer(n), F.col("n_docs"))), F.lit(0)).alias("longer_docs"),
        F.sum(F.least(F.col("length"), F.lit(n)) * F.col("n_docs")).alias("kept_tokens"),
        F.coalesce(F.sum(F.when(longer(n), (F.col("length") - n) * F.col("n_docs"))), F.lit(0)).alias("cut_tokens"))
    return hist.groupBy(*by).agg(F.array(*[one(int(n)) for n in limits]).alias("x")).select(*by, F.inline("x")).where("kept_tokens IS NOT NULL")


def length_quantiles(hist: DataFrame, shares: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """For each share q the smallest length that at least q of the documents don't exceed."""
    by = list(by)
    need: Column = F.greatest(F.lit(1), F.ceil(F.col("q") * F.col("all_docs")))
    each = hist.withColumn("q", F.explode(F.array(*[F.lit(float(q)) for q in shares])))
    return each.where((F.col("docs_upto") >= need) & (F.col("docs_upto") - F.col("n_docs") < need)).select(*by, "q", "length")
