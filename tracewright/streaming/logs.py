"""Streaming twins: log tails, sessions, stores, counters and sweep progress."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import StructType

from tracewright.sources import entries


_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def files(spark: SparkSession, path: str, schema: str, fmt: str = "json", per_batch: int = 1000) -> DataFrame:
    """New files below a folder as a stream."""
    r = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch)
    return (r.option("header", True) if fmt == "csv" else r).format(fmt).load(path)


def new_epochs(log: DataFrame, every: int) -> DataFrame:
    """Each (run, epoch) once, every k-th epoch."""
    return log.where(F.col("epoch") % every == 0).dropDuplicates(["run", "epoch"])


SESSION_OUT = "session_id string, turn bigint, role string, content string, fields map<string,string>"
_KEPT = StructType().add("turn", "long").add("role", "string").add("content", "string")
_NAME, _FIELD = StructType().add("name", "string"), StructType().add("value", "string").add("turn", "long")


class _Tail(StatefulProcessor):
    """Last messages of a session as a list, its fields as a map with the turn that set each; an idle session is forgotten by a timer."""

    def __init__(self, keep: int, idle_ms: int | None):
        self.keep, self.idle_ms = keep, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getListState("kept", _KEPT)
        self.fields = handle.getMapState("fields", _NAME, _FIELD)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        kept, told = [tuple(r) for r in self.kept.get()], {}
        for part in rows:
            new = list(zip(part["turn"].tolist(), part["role"].tolist(), part["content"].tolist()))
            # only the last messages are ever held
            kept = sorted(kept + new, key=lambda r: (r[0], r[1] or "", r[2] or ""))[-self.keep :]
            for turn, updates in zip(part["turn"].tolist(), part["updates"].tolist()):
                for name, value in dict(updates or {}).items():
                    if name not in told or told[name][0] <= turn:
                        told[name] = (turn, value)
        self.kept.put(kept)
        # a field is written only if a message as late as the one that set it names it; null stays as a mark
        for name, (turn, value) in told.items():
            if not self.fields.containsKey((name,)) or self.fields.getValue((name,))[1] <= turn:
                self.fields.updateValue((name,), (value, turn))
        fields = {k[0]: v[0] for k, v in self.fields.iterator() if v[0] is not None}
        if self.idle_ms is not None:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        yield pd.DataFrame({
            "session_id": [key[0]] * len(kept), "turn": [r[0] for r in kept], "role": [r[1] for r in kept], "content": [r[2] for r in kept], "fields": [fields] * len(kept)})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.kept.clear()
        self.fields.clear()
        return iter([])


def session_tail(messages: DataFrame, keep: int = 40, idle_ms: int | None = None) -> DataFrame:
    """Last `keep` messages and the merged fields of each session touched by a batch.

    A field has the value of the latest turn that names it, whatever the order in which
    batches come; null removes it. State is read and written for touched sessions
    only. With `idle_ms` a session without messages for so long is forgotten (a query that
    drains its source then waits for its timers), else its last messages and its fields stay as long as the query. Needs the state store that keeps lists and maps.
    """
    messages.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _STORE)
    mode = "None" if idle_ms is None else "ProcessingTime"
    return messages.groupBy("session_id").transformWithStateInPandas(_Tail(keep, idle_ms), SESSION_OUT, "Update", mode)


def upsert_store(changes: DataFrame, path: str, checkpoint: str, drain: bool = False) -> StreamingQuery:
    """Apply every batch of changes to the entry store.

    Batches may come in any order and more than once: the largest `seq` per id
    decides over all of them.
    """
    def apply(batch: DataFrame, _id: int) -> None:
        entries.merge_entries(batch, path)

    w = changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if drain else w).start()


def outcome_counts(requests: DataFrame, window: str = "5 minutes") -> DataFrame:
    """Requests and mean latency per time window and outcome.

    No request is too late to count, so there is no watermark; the state is one row
    per window and outcome.
    """
    return requests.groupBy(F.window("ts", window), "outcome").agg(
        F.count(F.lit(1)).alias("n"), F.avg("latency_ms").alias("mean_ms"))


def sweep_progress(results: DataFrame, expected: int) -> DataFrame:
    """Running totals of a sweep and the share that is done."""
    return results.groupBy("max_joins").agg(
        F.count(F.lit(1)).alias("done"), F.count_if("timeout").alias("timeouts"), F.avg("elapsed_s").alias("avg_elapsed")
    ).withColumn("percent", F.round(F.col("done") * 100.0 / F.lit(max(expected, 1)), 2))


def run_to_end(stream: DataFrame, mode: str, folder: str) -> DataFrame:
    """Drain what the source holds now; every output row keeps the number of its batch."""
    def save(batch: DataFrame, batch_id: int) -> None:
        # a batch run again after a failure replaces its own folder
        batch.write.mode("overwrite").parquet(f"{folder}/rows/batch={batch_id}")

    q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(save).start()
    q.awaitTermination()
    return stream.sparkSession.read.option("basePath", f"{folder}/rows").parquet(f"{folder}/rows")
