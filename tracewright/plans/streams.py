"""Streaming queries: each reads a whole table as a stream and runs until it is drained."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.operators import scale
from tracewright.plans.registry import query
from tracewright.session import scratch
from tracewright.sources import entries
from tracewright.streaming import logs


def _stream(t, name: str) -> DataFrame:
    """The table as a stream; a pattern may match one file or a folder of parts, a plain path only a folder."""
    return t.spark.readStream.schema(t(name).schema).parquet(f"{t.sf_dir}/{name}.parque[t]")


def _newest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Last output per key of an updating stream."""
    keep = [c for c in rows.columns if c not in keys]
    return scale.pick(rows, keys, [-F.col("batch")], keep)


@query("epoch_stream_st01", "SELECT DISTINCT run, epoch FROM fx_epochs WHERE epoch%5=0")
def _(t):
    e = _stream(t, "events").select((F.col("event_id") % 20).cast("string").alias("run"), F.floor(F.col("event_id") / 20).cast("int").alias("epoch"))
    out = logs.run_to_end(logs.new_epochs(e, 5), "append", scratch(t.spark, "epochs"))
    return out.select(F.col("run").cast("bigint").alias("run"), F.col("epoch").cast("bigint").alias("epoch"))


@query("session_stream_st02", """SELECT CAST(conv_id AS VARCHAR) AS session_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) q WHERE r<=4""")
def _(t):
    m = _stream(t, "conversations").select(
        F.col("conv_id").cast("string").alias("session_id"), "turn", "role", F.col("text").alias("content"),
        F.create_map(F.lit("last_role"), F.col("role")).alias("updates"))
    out = logs.run_to_end(logs.session_tail(m, 4), "update", scratch(t.spark, "sessions"))
    last = out.groupBy("session_id").agg(F.max("batch").alias("batch"))
    return out.join(last, ["session_id", "batch"]).select("session_id", "turn", "role")


@query("store_stream_st03", """SELECT CAST(entry_id AS VARCHAR) AS id, entry_type AS type, filename FROM (SELECT *, row_number() OVER (PARTITION BY entry_id ORDER BY seq DESC) AS r FROM fx_entries) q WHERE r=1 AND NOT is_delete""")
def _(t):
    u = F.col("user_id").cast("string")
    changes = _stream(t, "events").select(
        u.alias("id"), F.col("event_type").alias("type"), F.lit(None).cast("string").alias("label"), F.concat(F.lit("f"), u, F.lit(".json")).alias("filename"),
        F.lit(None).cast("string").alias("payload"), (F.col("event_type") == "error").alias("is_delete"), F.col("event_id").alias("seq"))
    folder = scratch(t.spark, "store")
    q = logs.upsert_store(changes, f"{folder}/entries", f"{folder}/state", drain=True)
    q.awaitTermination()
    return entries.read_entries(t.spark, f"{folder}/entries").select("id", "type", "filename")


@query("outcome_stream_st04", """SELECT CAST(epoch_us(time_bucket(INTERVAL 5 MINUTES, ts))//1000000 AS BIGINT) AS start_s, event_type AS outcome, count(*) AS n, round(avg(value),6) AS mean_ms FROM events GROUP BY 1,2""")
def _(t):
    r = _stream(t, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("outcome"), F.col("value").alias("latency_ms"))
    out = logs.run_to_end(logs.outcome_counts(r), "update", scratch(t.spark, "outcomes"))
    rows = out.select(F.unix_timestamp("window.start").alias("start_s"), "outcome", "n", F.round("mean_ms", 6).alias("mean_ms"), "batch")
    return _newest(rows, ["start_s", "outcome"]).drop("batch")


@query("sweep_stream_st05", """SELECT max_joins, count(*) AS done, count(*) FILTER (timeout) AS timeouts, round(avg(elapsed_s),6) AS avg_elapsed, round(count(*)*100.0e0/(SELECT count(*) FROM orders),2) AS percent FROM fx_sweep GROUP BY 1""")
def _(t):
    k = F.col("o_orderkey")
    s = _stream(t, "orders").select(
        F.when(k % 8 < 4, 10).otherwise(50).alias("max_joins"), (F.col("o_orderstatus") == "P").alias("timeout"),
        ((1 + F.floor("o_totalprice") % 3500) / 100).alias("elapsed_s"))
    out = logs.run_to_end(logs.sweep_progress(s, t("orders").count()), "complete", scratch(t.spark, "sweep"))
    return _newest(out, ["max_joins"]).select("max_joins", "done", "timeouts", F.round("avg_elapsed", 6).alias("avg_elapsed"), "percent")
