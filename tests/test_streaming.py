import json
import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from outboxlake import schemas
from outboxlake.operators import alerts, dispatch, external, schedule
from outboxlake.operators.commands import apply_commands
from outboxlake.operators.merge import merge_deliveries
from outboxlake.options import Options, RetentionOptions
from outboxlake.streaming import lifecycle, run_log
from outboxlake.streaming import queries as streams

from .conftest import AS_OF, T0

NONE = Options(batch_size=None, jitter="none")
CALLBACKS = json.dumps(
    [
        {"name": "send_email", "url": "https://example.com/h", "signing_key_id": "k1"},
        {"name": "1bad"},
    ]
)


def test_stream_equals_batch_and_restarts(spark, make_events, make_deliveries, tmp_path):
    source, state = str(tmp_path / "in"), str(tmp_path / "state")
    first, second = make_events(CALLBACKS, CALLBACKS), make_events(CALLBACKS, CALLBACKS, ids=[2, 3])
    base = make_deliveries({"id": 10, "event_id": "e0"})
    sink = streams.DeliverySink(spark, str(tmp_path / "out"), base)
    stream = spark.readStream.schema(first.schema)
    first.write.mode("append").parquet(source)
    streams.run_schedule(stream.parquet(source), sink, NONE, state, AS_OF).awaitTermination()
    assert sink.new_rows().count() == 4
    # Event 2 arrives again with event 3; only the new one adds rows.
    second.write.mode("append").parquet(source)
    streams.run_schedule(stream.parquet(source), sink, NONE, state, AS_OF).awaitTermination()
    keys = [(r.event_id, r.callback_name) for r in sink.new_rows().collect()]
    assert len(keys) == len(set(keys)) == 6
    batch = schedule.schedule_deliveries(first.unionByName(second), base, NONE, AS_OF).new_rows
    assert set(keys) == {(r.event_id, r.callback_name) for r in batch.collect()}
    ids = [r.id for r in sink.rows().collect()]
    assert len(ids) == len(set(ids))
    assert sorted(ids) == list(range(10, 17))
    # A batch that is run again replaces its own output.
    last = sink.folders.parts()[-1]
    held, highest = sink.rows(last.writer, last.batch), sink.highest(last.writer, last.batch)
    again = schedule.schedule_deliveries(second, held, NONE, AS_OF, highest=highest).new_rows
    before = sorted(map(tuple, sink.rows().collect()))
    sink.write(again, last.writer, last.batch)
    assert sorted(map(tuple, sink.rows().collect())) == before


def split(spark, df, path, order):
    """The rows as one file per entry of ``order``, each with its own share, in that order of arrival."""
    for k, share in enumerate(order):
        df.where(f"pmod(id, {len(order)}) = {share}").coalesce(1).write.mode("append").parquet(f"{path}/f{k}")
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(f"{path}/*")


def test_split_streams_schedule_the_same_rows(spark, make_events, make_deliveries, tmp_path):
    events = make_events(*[CALLBACKS] * 23, names=[f"e{k % 20}" for k in range(23)])
    base = make_deliveries({"id": 10, "event_id": "e3"})
    want = schedule.schedule_deliveries(events, base, NONE, AS_OF).new_rows.drop("id")
    for name, order in (("one", [0]), ("many", [4, 1, 3, 0, 2])):
        sink = streams.DeliverySink(spark, str(tmp_path / name / "out"), base)
        stream = split(spark, events, str(tmp_path / name / "in"), order)
        streams.run_schedule(stream, sink, NONE, str(tmp_path / name / "state"), AS_OF).awaitTermination()
        got = sink.new_rows()
        assert sorted(map(str, got.drop("id").collect())) == sorted(map(str, want.collect()))
        assert sorted(r.id for r in got.collect()) == list(range(11, 11 + want.count()))


def test_new_checkpoint_and_rescan_share_a_sink(spark, make_events, make_deliveries, tmp_path):
    events = make_events(*[CALLBACKS] * 6)
    base = make_deliveries({"id": 10, "event_id": "e0"})
    sink = streams.DeliverySink(spark, str(tmp_path / "out"), base)
    source = str(tmp_path / "in")
    events.where("id <= 2").write.parquet(source)
    stream = spark.readStream.schema(events.schema).parquet(source)
    streams.run_schedule(stream, sink, NONE, str(tmp_path / "first"), AS_OF).awaitTermination()
    events.where("id in (2, 3)").write.mode("append").parquet(source)
    # The old checkpoint is lost: a new one reads everything again and keeps what is there.
    streams.run_schedule(stream, sink, NONE, str(tmp_path / "second"), AS_OF).awaitTermination()
    assert {p.writer for p in sink.folders.parts()} != set() and len(sink.folders.parts()) == 2
    rescanned = streams.stream_rescan(events, sink, NONE, AS_OF, "2023-01-01 00:00:00").collect()
    assert {r.event_id for r in rescanned} == {"e4", "e5", "e6"}
    again = streams.stream_rescan(events, sink, NONE, AS_OF, "2023-01-01 00:00:00").collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, rescanned))
    want = schedule.schedule_deliveries(events, base, NONE, AS_OF).new_rows
    assert sorted(map(tuple, sink.new_rows().collect())) == sorted(map(tuple, want.collect()))


TWINS = json.dumps(
    [
        {"name": "twin_cb", "url": 5},
        {"name": "send_email", "url": "https://example.com/h", "signing_key_id": "k1"},
        {"name": "twin_cb", "url": "https://example.com/h", "signing_key_id": "k1"},
        {"name": "twin_cb", "url": "https://example.com/i", "signing_key_id": "k1"},
    ]
)
ORDERS = [("one", [0]), ("many", [4, 1, 3, 0, 2])]


def test_dedupe_keeps_the_valid_twin_and_no_replay(spark, make_events, tmp_path):
    # Each of twelve events arrives three times; the replays come in other micro-batches.
    events = make_events(*[CALLBACKS, TWINS, "[]", "7"] * 9, names=[f"e{k % 12}" for k in range(36)])
    got = {}
    for name, order in ORDERS:
        stream = split(spark, events, str(tmp_path / name), order)
        rows = streams.run_to_table(streams.stream_dedupe(stream, NONE), "dedupe", idle_batches=False).collect()
        got[name] = sorted((r.event_id, r.label, r.pos, r.dead_letter) for r in rows)
    assert got["one"] == got["many"]
    assert [r[1:] for r in got["one"] if r[0] == "e1"] == [("send_email", 1, False), ("twin_cb", 2, False)]
    assert [r[1:] for r in got["one"] if r[0] == "e0"] == [("1bad", 1, True), ("send_email", 0, False)]
    assert len(got["one"]) == 12


def test_counts_do_not_depend_on_the_split(spark, make_events, tmp_path):
    events = make_events(*[CALLBACKS, "7", "[]"] * 10)
    # Every seventh event is five hours older than the others that arrive with it.
    late = F.when(F.col("id") % 7 == 0, F.col("created_at") - F.expr("INTERVAL 5 HOURS")).otherwise(F.col("created_at"))
    events = events.withColumn("created_at", late)
    want = sorted(map(tuple, streams.stream_metrics(events, NONE).groupBy("kind", "branch", "minute").count().collect()))
    assert len({r[2] for r in want}) == 2 and sum(r[3] for r in want) == 30
    for name, order in ORDERS:
        sink = streams.metrics_sink(spark, str(tmp_path / name / "out"))
        assert sink.totals().count() == 0
        stream = split(spark, events, str(tmp_path / name / "in"), order)
        streams.run_counts(streams.stream_metrics(stream, NONE), sink, str(tmp_path / name / "state")).awaitTermination()
        assert sorted(map(tuple, sink.totals().collect())) == want
        # A batch that runs again counts once, also behind a compaction.
        parts = sink.folders.parts()
        assert len(parts) == len(order)
        sink.compact(parts[0].writer)
        left = sink.folders.parts()
        assert len(left) == min(2, len(order)) and left[-1].batch == parts[-1].batch
        last = sink.folders.read([left[-1]], sink.schema)
        sink.write(spark.createDataFrame(last.collect(), last.schema), left[-1].writer, left[-1].batch)
        assert sorted(map(tuple, sink.totals().collect())) == want


def test_alert_windows_do_not_depend_on_the_split(spark, tmp_path):
    rows = [(k, "corrupted_rows", T0 + timedelta(seconds=17 * k * (-1) ** k)) for k in range(40)]
    log = spark.createDataFrame(rows, "id long, alert string, at timestamp")
    want = sorted(map(tuple, alerts.rate_alerts(log.select("alert", "at")).select("alert", "window_start", "window_end", "occurrences").collect()))
    for name, order in ORDERS:
        sink = streams.alerts_sink(spark, str(tmp_path / name / "out"))
        stream = split(spark, log, str(tmp_path / name / "in"), order)
        streams.run_counts(streams.stream_alerts(stream), sink, str(tmp_path / name / "state")).awaitTermination()
        assert sorted(map(tuple, sink.totals().collect())) == want


def message(**changes):
    base = dict.fromkeys(lifecycle.MESSAGES.fieldNames()[3:])
    return {**base, **changes}


def test_lifecycle_fold():
    s = dict(lifecycle.EMPTY)
    scheduled = message(type="scheduled", mode="external", max_attempts=2, external_timeout_seconds=60, max_cycles=2)
    lifecycle.fold(s, scheduled, 0)
    assert lifecycle.state_name(s) == "pending"
    lifecycle.fold(s, message(type="attempt", result="transient", error="e"), 1)
    assert (s["attempts"], s["dead"]) == (1, False)
    lifecycle.fold(s, message(type="attempt", result="ok"), 2)
    assert lifecycle.state_name(s) == "external_pending"
    lifecycle.expire(s)
    assert (lifecycle.state_name(s), s["attempts"], s["cycles"]) == ("pending", 0, 1)
    lifecycle.fold(s, message(type="attempt", result="ok"), 3)
    lifecycle.expire(s)
    assert lifecycle.state_name(s) == "dead" and s["error"] == "external_completion_cycles_exhausted"
    lifecycle.fold(s, message(type="command", action="retry"), 4)
    assert lifecycle.state_name(s) == "pending" and s["cycles"] == 0
    lifecycle.fold(s, message(type="command", action="complete"), 5)
    assert lifecycle.state_name(s) == "processed"
    lifecycle.fold(s, message(type="command", action="abandon"), 6)
    assert lifecycle.state_name(s) == "dead"


def test_lifecycle_leases():
    s = {**lifecycle.EMPTY}
    lifecycle.fold(s, message(type="claim", lease_seconds=10), 0)
    assert (s["attempts"], s["locked"]) == (1, 10_000)
    # A lease that is held stops claims and retries, its end does not stop its outcome.
    lifecycle.fold(s, message(type="claim", lease_seconds=10), 10_000)
    lifecycle.fold(s, message(type="command", action="retry"), 10_000)
    assert (s["attempts"], s["locked"]) == (1, 10_000)
    lifecycle.fold(s, message(type="claim", lease_seconds=10), 10_001)
    assert (s["attempts"], s["locked"]) == (2, 20_001)
    lifecycle.fold(s, message(type="attempt", result="timeout", error="e", next_available_at=99), 30_000)
    assert (s["attempts"], s["locked"], s["error"], s["available"]) == (2, None, "e", 99)
    lifecycle.fold(s, message(type="attempt", result="ok"), 40_000)
    assert (s["attempts"], s["processed"]) == (3, 40_000)
    lifecycle.fold(s, message(type="attempt", result="ok"), 50_000)
    assert (s["attempts"], s["processed"]) == (3, 40_000)


def test_replay_runs_timers_between_messages():
    log = [
        (0, 1, message(type="scheduled", mode="external", external_timeout_seconds=60, max_cycles=2)),
        (1_000, 2, message(type="attempt", result="ok")),
        (90_000, 3, message(type="attempt", result="ok")),
    ]
    steps = lifecycle.replay(None, log, 150_000, 40)
    assert [(s[0], s[2]) for s in steps] == [(0, "scheduled"), (1_000, "attempt"), (61_001, "timer"), (90_000, "attempt")]
    # The second timeout is over at 150 s sharp and overdue a millisecond later.
    assert lifecycle.replay(None, log, 150_001, 40)[-1][2:][1]["dead"]
    # A completion that comes late undoes the timer.
    late = (61_000, 4, message(type="command", action="complete"))
    steps = lifecycle.replay(None, sorted([*log, late], key=lambda m: m[:2]), 150_001, 40)
    assert [s[2] for s in steps] == ["scheduled", "attempt", "complete", "attempt"]
    assert lifecycle.replay(None, log[1:], 150_000, 40) == []


def _stream_messages(spark, rows):
    fields = ["id", *lifecycle.MESSAGES.fieldNames()]
    schema = "id long, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in lifecycle.MESSAGES.fields)
    return spark.createDataFrame([tuple(r.get(f) for f in fields) for r in rows], schema)


def _ends(spark, rows, path, order, **options):
    stream = split(spark, _stream_messages(spark, rows), path, order)
    changes = streams.run_to_table(lifecycle.stream_lifecycle(stream, **options), "lifecycle")
    ends = lifecycle.current(changes).drop("revision", "step")
    return {r.delivery_id: tuple(r) for r in ends.collect()}


def test_lifecycle_does_not_depend_on_the_split(spark, tmp_path):
    rng, rows = random.Random(5), []
    for key in range(1, 25):
        at = T0 + timedelta(minutes=rng.randrange(2000))
        mode = {"mode": rng.choice(["managed", "external"]), "max_attempts": 3, "external_timeout_seconds": 3600, "max_cycles": 2}
        rows.append({"delivery_id": key, "at": at, "type": "scheduled", **mode})
        for _ in range(rng.randrange(7)):
            at += timedelta(minutes=rng.choice([0, 1, 30, 59, 60, 61, 300]))
            kind = rng.choice(["claim", "attempt", "attempt", "command"])
            extra = {"claim": {"lease_seconds": 90}, "attempt": {"result": rng.choice(["ok", "transient"]), "error": "e"}}
            action = {"action": rng.choice(["retry", "complete", "abandon"])}
            rows.append({"delivery_id": key, "at": at, "type": kind, **extra.get(kind, action)})
    rows.append({"delivery_id": 99, "at": T0 + timedelta(days=6), "type": "scheduled"})
    for k, row in enumerate(rows):
        row["seq"] = k
    rng.shuffle(rows)
    for k, row in enumerate(rows):
        row["id"] = k
    got = [_ends(spark, rows, str(tmp_path / name), order) for name, order in ORDERS]
    assert got[0] == got[1] and len(got[0]) == 25
    # Each end is what a replay of all messages gives at the last watermark.
    clock = int((T0 + timedelta(days=6, minutes=-1) - datetime(1970, 1, 1)).total_seconds() * 1000)
    for key in range(1, 25):
        log = [(int((r["at"] - datetime(1970, 1, 1)).total_seconds() * 1000), r["seq"], message(**r)) for r in rows if r["delivery_id"] == key]
        at, seq, cause, state = lifecycle.replay(None, sorted(log, key=lambda m: m[:2]), clock, 40)[-1]
        assert got[0][key][2:9] == (seq, cause, lifecycle.state_name(state), state["attempts"], state["cycles"], state["dead"], state["error"])


def test_lifecycle_from_a_table_ends_as_the_batch_operators(spark, make_events, make_deliveries, tmp_path):
    callbacks = json.dumps(
        [
            {"name": "send_email", "url": "https://example.com/h", "signing_key_id": "k1", "max_attempts": 2},
            {"name": "audit_log", "url": "https://example.com/a", "signing_key_id": "k1", "mode": "external",
             "external_completion_timeout_seconds": 600, "max_completion_cycles": 2},
        ]
    )
    events = make_events(*[callbacks] * 8)
    rows = []
    for k in range(16):
        waits = k % 2 == 1
        row = {"id": k + 1, "event_id": f"e{k // 2 + 1}", "callback_name": "audit_log" if waits else "send_email"}
        row.update(completion_mode="external" if waits else "managed", attempts=k % 3 % 2, completion_cycles=k % 4 // 3)
        if k in (4, 5):
            row["locked_until"] = AS_OF + timedelta(days=30)
        if k in (6, 7, 9):
            row.update(dispatched_at=T0, processed_at=T0 if k == 6 else None)
        rows.append(row)
    table = make_deliveries(*rows)
    first, second, third = AS_OF, AS_OF + timedelta(minutes=5), AS_OF + timedelta(minutes=16)
    outcomes = spark.createDataFrame(
        [(k + 1, first, 200 if k % 3 else 503, None, None, None, 0.1) for k in range(12)], schemas.ATTEMPTS
    )
    commands = spark.createDataFrame(
        [(k, k, action, second) for k, action in ((1, "retry"), (2, "complete"), (3, "abandon"), (5, "retry"), (14, "abandon"))], schemas.COMMANDS
    )
    ready = dispatch.revalidate_due(dispatch.due_deliveries(events, table, NONE, first), NONE)[0]
    done = dispatch.apply_attempts(ready, outcomes, NONE, first)
    answered = {r.delivery_id: r for r in done.log.collect()}
    # Only due rows were sent; the others have no outcome to tell.
    state = merge_deliveries(table, done.changed.filter(F.col("id").isin(list(answered))))
    state = merge_deliveries(state, apply_commands(state, commands, second).changed)
    state = merge_deliveries(state, external.sweep_external(events, state, NONE, third).changed)
    fields = ["attempts", "completion_cycles", "dead_letter", "last_error", "available_at", "locked_until", "dispatched_at", "processed_at"]
    want = {r.id: tuple(r[f] for f in fields) for r in state.collect()}
    messages = [
        {"delivery_id": k, "at": first, "type": "attempt", "result": r.result, "error": r.error, "next_available_at": r.next_available_at}
        for k, r in answered.items()
    ]
    messages += [{"delivery_id": r.delivery_id, "at": r.issued_at, "type": "command", "action": r.action} for r in commands.collect()]
    # The clock: what is overdue at the sweep, but not by more than a millisecond's doubt.
    messages.append({"delivery_id": 99, "at": third + timedelta(minutes=1), "type": "scheduled"})
    for k, m in enumerate(messages):
        m.update(seq=k, id=(k * 7) % len(messages))
    start = lifecycle.start_rows(events, table, NONE)
    for name, order in ORDERS:
        stream = split(spark, _stream_messages(spark, messages), str(tmp_path / name), order)
        changes = streams.run_to_table(lifecycle.stream_lifecycle(stream, start=start, opts=NONE), "lifecycle")
        ends = {r.delivery_id: r for r in lifecycle.current(changes).collect()}
        for key, row in want.items():
            if key not in ends:
                # Nothing happened to it.
                assert row == tuple(table.where(f"id = {key}").select(*fields).collect()[0]), key
                continue
            got = tuple(ends[key][f] for f in fields)
            swept = ends[key].cause == "timer" and not ends[key].dead_letter
            # A timer resets at its deadline, a sweep when it runs.
            assert (got[:4] + got[5:] if swept else got) == (row[:4] + row[5:] if swept else row), key


def test_closed_deliveries_are_forgotten(spark, tmp_path):
    def at(days):
        return T0 + timedelta(days=days)

    rows = [
        {"delivery_id": 1, "at": at(0), "type": "scheduled"},
        {"delivery_id": 1, "at": at(0.1), "type": "attempt", "result": "ok"},
        {"delivery_id": 2, "at": at(0.1), "type": "scheduled"},
        {"delivery_id": 3, "at": at(3), "type": "scheduled"},
        {"delivery_id": 3, "at": at(4), "type": "command", "action": "abandon"},
        {"delivery_id": 4, "at": at(4), "type": "scheduled"},
        {"delivery_id": 1, "at": at(5), "type": "command", "action": "abandon"},
        {"delivery_id": 2, "at": at(5), "type": "command", "action": "abandon"},
    ]
    # Four micro-batches: rows 0-2, then 3-4, then 5 (in which the timers run), then 6-7.
    for k, row in enumerate(rows):
        row.update(seq=k, id=[0, 4, 8, 1, 5, 2, 3, 7][k])
    short = RetentionOptions(processed_days=1, dead_letter_days=1)
    ends = _ends(spark, rows, str(tmp_path / "in"), [0, 1, 2, 3], retention=short)
    # The first was done and forgotten, the second was open all the time.
    assert ends[1][3:5] == ("attempt", "processed") and ends[2][3:5] == ("abandon", "dead")


def test_run_log_keeps_more_batches_than_a_query_remembers(spark, make_events, tmp_path):
    log = run_log.RunLog(spark, str(tmp_path / "log"))
    spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", "3")
    spark.streams.addListener(log)
    try:
        stream = split(spark, make_events(*["[]"] * 16), str(tmp_path / "in"), list(range(8)))
        sink = streams.metrics_sink(spark, str(tmp_path / "out"))
        query = streams.run_counts(streams.stream_metrics(stream, NONE), sink, str(tmp_path / "state"), name="counts")
        query.awaitTermination()
        assert log.settled(query)
    finally:
        spark.streams.removeListener(log)
        spark.conf.unset("spark.sql.streaming.numRecentProgressUpdates")
    rows = log.rows().collect()
    assert len(query.recentProgress) <= 3
    assert sorted(r.batch_id for r in rows) == list(range(8)) and {r.worker for r in rows} == {"counts"}
    assert all(r.duration_seconds > 0 and r.started_at is not None for r in rows)
