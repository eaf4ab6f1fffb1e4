"""Streams over several batches end where their batch twins do."""

import json
import os

from pyspark.sql import functions as F

from tracewright import schemas
from tracewright.operators import records
from tracewright.sources import entries
from tracewright.streaming import logs


def _put(path, name, rows):
    path.mkdir(exist_ok=True)
    (path / name).write_text("\n".join(json.dumps(r) for r in rows))


def test_epochs_reported_once(spark, tmp_path):
    src = tmp_path / "in"
    for i in range(3):
        _put(src, f"{i}.json", [{"run": "a", "epoch": e, "time_s": 1.0, "map50": 0.5} for e in range(i * 4, i * 4 + 8)])
    out = logs.run_to_end(logs.new_epochs(logs.files(spark, str(src), schemas.EPOCH_EVENT, per_batch=1), 5), "append", str(tmp_path / "o"))
    assert sorted(r.epoch for r in out.collect()) == [0, 5, 10, 15]
    assert out.select("batch").distinct().count() > 1


def test_session_tail_over_batches(spark, tmp_path):
    src = tmp_path / "in"
    for b in range(3):
        _put(src, f"{b}.json", [
            {"session_id": f"s{k}", "turn": b * 5 + i, "role": "user", "content": f"m{b}{i}", "ts": "2024-01-01T00:00:00", "updates": {"flag": None if b == 2 else "x", "last": str(b)}}
            for k in range(2) for i in range(5)])
    out = logs.run_to_end(logs.session_tail(logs.files(spark, str(src), schemas.MESSAGE, per_batch=1), 4), "update", str(tmp_path / "o"))
    final = out.where(F.col("batch") == out.agg(F.max("batch")).first()[0]).collect()
    for s in ("s0", "s1"):
        rows = sorted((r.turn, r.content) for r in final if r.session_id == s)
        assert rows == [(t, f"m2{t - 10}") for t in (11, 12, 13, 14)]
    assert {tuple(sorted(r.fields.items())) for r in final} == {(("last", "2"),)}
    raw = spark.read.schema(schemas.MESSAGE).json(str(src))
    twin = records.last_messages(raw, "session_id", "turn", 4)
    assert sorted((r.session_id, r.turn) for r in twin.collect()) == sorted((r.session_id, r.turn) for r in final)


def test_store_upserts_over_batches(spark, tmp_path):
    src, rows = tmp_path / "in", []
    for b in reversed(range(3)):  # the newest changes come first
        part = [{"id": str((b * 7 + i) % 9), "type": "page", "label": f"{b}-{i}", "filename": "f", "payload": "{}", "is_delete": (b + i) % 4 == 0, "seq": b * 10 + i} for i in range(8)]
        rows += part
        _put(src, f"{b}.json", part)
    q = logs.upsert_store(logs.files(spark, str(src), schemas.ENTRY, per_batch=1), str(tmp_path / "s"), str(tmp_path / "c"), drain=True)
    q.awaitTermination()
    last = {r["id"]: r for r in sorted(rows, key=lambda r: r["seq"])}
    want = {(k, r["label"]) for k, r in last.items() if not r["is_delete"]}
    assert {(r.id, r.label) for r in entries.read_entries(spark, str(tmp_path / "s")).collect()} == want


def test_table_of_parts_is_streamed(spark, tmp_path):
    from tracewright.plans.registry import Tables
    from tracewright.plans.streams import _stream

    spark.range(50).repartition(4).write.parquet(str(tmp_path / "a.parquet"))
    spark.range(7).coalesce(1).write.parquet(str(tmp_path / "b"))
    next((tmp_path / "b").glob("*.parquet")).rename(tmp_path / "b.parquet")
    t = Tables(spark, str(tmp_path))
    for name, n in (("a", 50), ("b", 7)):
        assert logs.run_to_end(_stream(t, name), "append", str(tmp_path / f"o{name}")).count() == n


def test_late_requests_count(spark, tmp_path):
    src = tmp_path / "in"
    for b, ts in enumerate(("2024-01-02T00:00:00", "2024-01-01T00:00:00")):
        _put(src, f"{b}.json", [{"ts": ts, "outcome": "ok", "latency_ms": 1.0}] * 3)
    out = logs.run_to_end(logs.outcome_counts(logs.files(spark, str(src), schemas.REQUEST, per_batch=1)), "update", str(tmp_path / "o"))
    assert sum(r.n for r in out.collect()) == 6


def test_session_tail_does_not_depend_on_the_order_of_batches(spark, tmp_path):
    """The same messages in several orders give the same messages and fields; only touched sessions come out."""
    batches = [[{"session_id": s, "turn": b * 3 + i, "role": "user", "content": f"{b}{i}", "ts": "2024-01-01T00:00:00",
                 "updates": {"a": f"{b}{i}", f"only{b}": None if i == 2 else "v", "gone": None if b == 3 else "x"}} for i in range(3) for s in (("s0", "s1") if b else ("s0",))] for b in range(4)]
    ends = []
    for order in ((0, 1, 2, 3), (3, 2, 1, 0), (2, 0, 3, 1)):
        name = "".join(map(str, order))
        for k, b in enumerate(order):
            _put(tmp_path / name, f"{k}.json", batches[b])
            os.utime(tmp_path / name / f"{k}.json", (1_700_000_000 + 10 * k,) * 2)  # files come by their time
        out = logs.run_to_end(logs.session_tail(logs.files(spark, str(tmp_path / name), schemas.MESSAGE, per_batch=1), 5), "update", str(tmp_path / f"o{name}"))
        rows = out.collect()
        assert {r.batch for r in rows if r.session_id == "s1"} == {k for k, b in enumerate(order) if b}
        last = max(r.batch for r in rows if r.session_id == "s0")
        ends.append(sorted((r.turn, r.content, tuple(sorted(r.fields.items()))) for r in rows if r.session_id == "s0" and r.batch == last))
    assert ends[0] == ends[1] == ends[2] and [t for t, *_ in ends[0]] == [7, 8, 9, 10, 11] and dict(ends[0][0][2]) == {"a": "32"}


def test_idle_sessions_are_forgotten():
    """The timer moves with every batch that touches the session; when it runs out, nothing is left."""
    import pandas as pd

    class Items:
        def __init__(self):
            self.rows = []
        def get(self):
            return iter(self.rows)
        def put(self, rows):
            self.rows = list(rows)
        def clear(self):
            self.rows = []

    class Named(dict):
        containsKey, getValue, iterator = dict.__contains__, dict.__getitem__, dict.items
        def updateValue(self, k, v):
            self[k] = v

    class Handle:
        def __init__(self):
            self.timers, self.kept, self.fields = [], Items(), Named()
        def getListState(self, name, schema):
            return self.kept
        def getMapState(self, name, key, value):
            return self.fields
        def listTimers(self):
            return iter(self.timers)
        def deleteTimer(self, t):
            self.timers.remove(t)
        def registerTimer(self, t):
            self.timers.append(t)

    class Now:
        def __init__(self, ms):
            self.getCurrentProcessingTimeInMs = lambda: ms

    handle, tail = Handle(), logs._Tail(2, 500)
    tail.init(handle)
    for ms, turn in ((1000, 1), (1200, 2)):
        part = pd.DataFrame({"turn": [turn], "role": ["user"], "content": ["m"], "updates": [{"a": str(turn)}]})
        out = list(tail.handleInputRows(("s",), iter([part]), Now(ms)))
        assert handle.timers == [ms + 500] and out[0]["turn"].tolist() == list(range(1, turn + 1)) and out[0]["fields"][0] == {"a": str(turn)}
    assert list(tail.handleExpiredTimer(("s",), Now(1800), None)) == [] and handle.kept.rows == [] and handle.fields == {}
