"""Work that must not grow beyond what the rows ask for."""

import glob
import random

import pandas as pd
import pyarrow as pa

from outboxlake.operators import fanout
from outboxlake.options import Options
from outboxlake.sources import tables
from outboxlake.streaming import lifecycle
from outboxlake.streaming import queries as streams

from .conftest import T0

NONE = Options(batch_size=None, jitter="none")


def _state_stores(spark, stream, path, monkeypatch):
    """Partitions of the state that `run_to_table` leaves, with many shuffle partitions set."""
    monkeypatch.setattr(streams, "fresh_path", lambda _, label: f"{path}/{label}")
    settings = ("spark.sql.shuffle.partitions", streams.STATE_CHANGELOG, streams.IDLE_BATCHES)
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    before = [spark.conf.get(key, None) for key in settings]
    try:
        rows = streams.run_to_table(stream, "out", idle_batches=False).collect()
        assert [spark.conf.get(key, None) for key in settings] == before
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    return rows, len(glob.glob(f"{path}/out-state/state/0/[0-9]*"))


def test_lifecycle_opens_one_state_store_per_core(spark, tmp_path, monkeypatch):
    rows = [(k, k, T0, "scheduled") for k in range(20)]
    messages = spark.createDataFrame(rows, "delivery_id long, seq long, at timestamp, type string")
    messages.write.parquet(str(tmp_path / "in"))
    stream = lifecycle.stream_lifecycle(spark.readStream.schema(messages.schema).parquet(str(tmp_path / "in")))
    got, stores = _state_stores(spark, stream, str(tmp_path), monkeypatch)
    assert len(got) == 20 and stores == spark.sparkContext.defaultParallelism


def test_lifecycle_keeps_state_by_group(spark, tmp_path):
    n = 3 * lifecycle.GROUPS
    messages = spark.range(n).selectExpr("id AS delivery_id", "id AS seq", "timestamp'2024-01-01' AS at", "'scheduled' AS type")
    messages.write.parquet(str(tmp_path / "in"))
    stream = lifecycle.stream_lifecycle(spark.readStream.schema(messages.schema).parquet(str(tmp_path / "in")))
    writer = stream.writeStream.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True)
    query = writer.start(str(tmp_path / "out"), format="parquet", outputMode="append")
    query.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == n
    assert 0 < query.recentProgress[0]["stateOperators"][0]["numRowsTotal"] <= lifecycle.GROUPS


class _Store:
    """A group's list of parts and timers, counting the calls."""

    def __init__(self):
        self.parts, self.timers, self.calls = [], set(), 0

    def getListState(self, *_):
        return self

    def get(self):
        self.calls += 1
        return iter(self.parts)

    def put(self, parts):
        self.calls, self.parts = self.calls + 1, list(parts)

    def appendValue(self, part):
        self.calls, self.parts = self.calls + 1, [*self.parts, part]

    def clear(self):
        self.calls, self.parts = self.calls + 1, []

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)

    def deleteTimer(self, at):
        self.calls += 1
        self.timers.remove(at)


class _Clock:
    def __init__(self, at):
        self.getCurrentWatermarkInMs = self.getExpiryTimeInMs = lambda: at


def test_lifecycle_of_a_group_in_many_small_batches():
    rng, store, keep, wire = random.Random(3), _Store(), 400_000, lifecycle._WIRE
    processor = lifecycle.Lifecycle(40, keep)
    processor.init(store)
    logs, ends, batches = {k: [] for k in range(50)}, {}, 150

    def emitted(frames):
        for frame in frames:
            for step in pa.Table.from_pandas(frame).to_pylist():
                best = ends.get(step["delivery_id"])
                if best is None or (step["revision"], step["step"]) > (best["revision"], best["step"]):
                    ends[step["delivery_id"]] = step

    for b in range(batches):
        clock, rows = 1000 * b, []
        for _ in range(rng.randrange(12)):
            key, at = rng.randrange(50), clock + rng.randrange(-20_000, 20_000)
            kind = rng.choice(["scheduled", "claim", "attempt", "attempt", "command"])
            m = dict.fromkeys(wire.names) | {"delivery_id": key, "at": at, "seq": rng.randrange(10**9), "type": kind, "mode": "external", "external_timeout_seconds": 5, "max_cycles": 2}
            m |= {"attempt": {"result": rng.choice(["ok", "transient"]), "error": "e"}, "command": {"action": rng.choice(["retry", "complete", "abandon"])}}.get(kind, {})
            logs[key].append((at, m["seq"], m))
            rows += [m] * rng.choice([1, 1, 2])
        packed = pd.DataFrame({"rows": [pa.RecordBatch.from_pylist(part, schema=wire).serialize().to_pybytes() for part in (rows[::2], rows[1::2])]})
        before = store.calls
        if rows:
            emitted(processor.handleInputRows((7,), iter([packed]), _Clock(clock)))
        # What is read and written does not grow with the group's deliveries.
        assert store.calls - before <= 4 and len(store.parts) <= lifecycle.MOST_PARTS
        for at in sorted(t for t in store.timers if t <= clock):
            emitted(processor.handleExpiredTimer((7,), _Clock(clock), _Clock(at)))
            store.timers.remove(at)
        assert all(t > clock for t in store.timers) and len(store.timers) <= 1
    for key, log in logs.items():
        steps = lifecycle.replay(None, sorted(log, key=lambda m: m[:2]), clock, 40)
        assert (key in ends) == bool(steps)
        if steps:
            at, seq, cause, s = steps[-1]
            got = ends[key]
            assert (got["at"], got["seq"], got["cause"], got["state"], got["attempts"], got["completion_cycles"], got["dispatched_at"]) == (
                at, seq, cause, lifecycle.state_name(s), s["attempts"], s["cycles"], s["dispatched"]
            ), key
    # Closed deliveries are forgotten, and a group without any leaves nothing.
    far = clock + 10**9
    for _ in range(4):
        for at in sorted(store.timers):
            emitted(processor.handleExpiredTimer((7,), _Clock(far), _Clock(at)))
            store.timers.remove(at)
    kept = lifecycle._Group(store, store).kept
    still_open = {k for k, e in ends.items() if e["state"] in ("pending", "external_pending")}
    assert set(kept) - still_open == {k for k in kept if ends.get(k) is None}


def test_dedupe_keeps_names_without_python_state(spark, make_events, tmp_path, monkeypatch):
    two = '[{"name": "abc_1", "url": 5}, {"name": "abc_2", "url": 5}]'
    events = make_events(*[two] * 20, names=[f"e{k % 5}" for k in range(20)])
    events.write.parquet(str(tmp_path / "in"))
    stream = streams.stream_dedupe(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")), NONE)
    assert "TransformWithState" not in stream._jdf.queryExecution().toString()
    got, stores = _state_stores(spark, stream, str(tmp_path), monkeypatch)
    # The first arrival of each of five events, in 20 rows of one micro-batch.
    assert sorted((r.id, r.label) for r in got) == [(k + 1, f"abc_{n}") for k in range(5) for n in (1, 2)]
    assert stores == spark.sparkContext.defaultParallelism


def test_rows_of_a_hot_key_are_not_joined_by_it(make_events):
    n = 40
    names = ["hot" if k % 2 else f"e{k}" for k in range(n)]
    good = '[{"name": "send_email"}]'
    checked = tables.check_events(make_events(*[good] * n, ids=[k // 4 for k in range(n)], names=names))
    # A join of the refused rows by their key would bring those of a hot one into one task.
    assert "Join Inner" not in checked.rejected._jdf.queryExecution().optimizedPlan().toString()
    assert checked.rows.filter("event_id = 'hot'").count() == 1
    assert checked.rejected.agg({"copies": "sum"}).first()[0] == n // 2 - 1


def test_callbacks_are_parsed_in_one_place(make_events):
    for build in (fanout.dedupe_callback_names, fanout.resolve_targets, fanout.corrupt_events):
        plan = build(make_events("[]").repartition(3), NONE)._jdf.queryExecution().optimizedPlan().toString()
        assert sum("parseJson" in line for line in plan.splitlines()) == 1, build.__name__
