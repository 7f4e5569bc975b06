import json
import threading
import time
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from outboxlake.functions.text import cut_utf8
from outboxlake.operators import commands, dispatch, external, requests, schedule
from outboxlake.operators.merge import merge_deliveries
from outboxlake.options import Options
from outboxlake.schemas import ATTEMPTS

from .conftest import AS_OF, T0

GOOD = {"name": "send_email", "url": "https://example.com/h", "signing_key_id": "k1"}
NONE = Options(batch_size=None, jitter="none")


def test_cut_utf8(spark):
    cases = [("é", 1, ""), ("héllo", 4, "hél"), ("🦀", 3, ""), ("🦀", 4, "🦀"), ("abc", 3, "abc")]
    for text, limit, want in cases:
        got = spark.range(1).select(cut_utf8(F.lit(text), limit)).head()[0]
        assert got == want, (text, limit)


def test_retry_after_texts(spark):
    cases = {
        "120": 120.0,
        "  60  ": 60.0,
        "+5": 5.0,
        "0": 0.0,
        "Thu, 01 Feb 2024 00:10:00 GMT": 600.0,
        "Thursday, 01-Feb-24 00:10:00 GMT": 600.0,
        "Thu Feb  1 00:10:00 2024": 600.0,
        "Sun, 06 Nov 1994 08:49:37 GMT": 0.0,
        "not-a-date": None,
        "": None,
        "-5": None,
        "99999999999999999999": None,
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    now = dispatch.times.instant(AS_OF, "timestamp_ntz")
    got = {r.t: r.s for r in df.select("t", dispatch.retry_after_seconds(F.col("t"), now).alias("s")).collect()}
    assert got == cases


def test_longest_retry_after_waits_longest(spark):
    texts = ["90000000001", "18446744073709551615", "18446744073709551616", "9" * 40, "90000000000"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {r.t: r.s for r in df.select("t", dispatch.retry_after_seconds(F.col("t"), F.lit(AS_OF)).alias("s")).collect()}
    assert [got[t] for t in texts] == [9e10, 9e10, None, None, 9e10]
    rows = spark.createDataFrame([(1, 1, [60], texts[1])], "delivery_id long, attempt int, backoff array<bigint>, retry_after string")
    assert str(dispatch.retry_schedule(rows, AS_OF, "none").selectExpr("CAST(next_available_at AS STRING) AS at").head().at) > "4800"


def test_backoff_and_jitter(spark):
    rows = [(1, 1, [30, 120, 600], None), (2, 0, [30, 120], None), (3, 5, [30], None), (4, 1, [], None), (5, 1, [30], "600")]
    df = spark.createDataFrame(rows, "delivery_id long, attempt int, backoff array<bigint>, retry_after string")
    plain = {r.delivery_id: r.delay_seconds for r in dispatch.retry_schedule(df, AS_OF, "none").collect()}
    assert plain == {1: 30.0, 2: 30.0, 3: 30.0, 4: 60.0, 5: 600.0}
    for mode in ("hash", "rand"):
        for r in dispatch.retry_schedule(df, AS_OF, mode).collect():
            assert 0.75 * plain[r.delivery_id] <= r.delay_seconds < 1.25 * plain[r.delivery_id]
    twice = [dispatch.retry_schedule(df, AS_OF, "hash").orderBy("delivery_id").collect() for _ in "ab"]
    assert twice[0] == twice[1]


def test_signature_golden(spark):
    secret = b"super-secret-key-32-bytes-minimum!!"
    keys = requests.key_table(spark, {"k": secret, "long": b"z" * 100})
    rows = [(1, "k", '{"hello":"world"}'), (2, None, "x"), (3, "gone", "x"), (4, "long", "x")]
    df = spark.createDataFrame(rows, "delivery_id long, signing_key_id string, body string").withColumn(
        "headers", F.create_map(F.lit("A"), F.lit("b"))
    )
    sent = requests.sign_requests(df, keys, datetime(2024, 4, 27, 14, 50))
    got = {r.delivery_id: r for r in sent.collect()}
    assert got[1].signature == (
        "t=1714229400,v1=eb20b73f08a3f6c407a9b2e6f40d63c13662fc9f25558ed78fdd59bd167709be"
    )
    assert got[1].headers["X-Outbox-Signing-Key-Id"] == "k"
    assert got[2].signature is None and got[2].send_error is None and len(got[2].headers) == 1
    assert got[3].send_error == "signing_key_id 'gone' not registered"
    import hashlib
    import hmac

    want = hmac.new(b"z" * 100, b"1714229400.x", hashlib.sha256).hexdigest()
    assert got[4].signature.endswith(want)
    audit = [
        (1, "k", '{"hello":"world"}', got[1].signature),
        (2, "k", '{"hello":"World"}', got[1].signature),
        (3, "k", '{"hello":"world"}', "v1=00"),
        (4, "k", '{"hello":"world"}', None),
        (5, "other", '{"hello":"world"}', got[1].signature),
    ]
    log = spark.createDataFrame(audit, "id long, signing_key_id string, body string, signature string")

    def valid(now, age):
        out = requests.verify_signatures(log, keys, now, age)
        return [r.valid for r in out.orderBy("id").collect()]

    assert valid(datetime(2024, 4, 27, 14, 55), 300) == [True, False, False, False, False]
    assert valid(datetime(2024, 4, 27, 14, 55, 1), 300)[0] is False
    assert valid(datetime(2024, 4, 27, 14, 0), 300)[0] is True


def test_lease_and_outcomes(spark, make_events, make_deliveries):
    external_cb = {**GOOD, "name": "audit", "mode": "external", "external_completion_timeout_seconds": 60}
    events = make_events(
        json.dumps([GOOD, external_cb]),
        json.dumps([{**GOOD, "max_attempts": 1}, external_cb]),
        json.dumps([{**GOOD, "headers": {"Authorization": "x"}}]),
        json.dumps([{**GOOD, "name": "other"}]),
    )
    rows = make_deliveries(
        {"id": 1, "event_id": "e1"},
        {"id": 2, "event_id": "e1", "callback_name": "audit", "completion_mode": "external", "last_error": "old"},
        {"id": 3, "event_id": "e2"},
        {"id": 4, "event_id": "e3"},
        {"id": 5, "event_id": "e4", "locked_until": T0},
        {"id": 6, "event_id": "e2", "callback_name": "audit", "locked_until": AS_OF + timedelta(1)},
        {"id": 7, "event_id": "gone"},
    )
    due = dispatch.due_deliveries(events, rows, NONE, AS_OF)
    assert {r.delivery_id for r in due.collect()} == {1, 2, 3, 4, 5}
    top = dispatch.due_deliveries(events, rows, Options(batch_size=2), AS_OF)
    assert {r.delivery_id for r in top.collect()} == {1, 2}
    ready, poison = dispatch.revalidate_due(due, NONE)
    bad = {r.id: r for r in poison.collect()}
    assert bad[4].last_error == (
        "invalid callback spec: Invalid data: callback 'send_email' failed structural revalidation at "
        "dispatch time: invalid_callback: header 'Authorization' is reserved and cannot be set"
    )
    assert bad[5].last_error == (
        "invalid callback spec: Callback target missing: callback 'send_email' not found in event callbacks array"
    )
    assert bad[5].dead_letter and bad[5].locked_until is None and bad[5].attempts == 0

    claimed = dispatch.claim_deliveries(rows, ready, NONE, AS_OF)
    one = claimed.filter("delivery_id = 1").head()
    assert one.claimed and one.delivery.attempts == 1
    assert one.delivery.locked_until == AS_OF + timedelta(seconds=40)
    again = dispatch.claim_deliveries(
        merge_deliveries(rows, claimed.select("delivery.*")), ready, NONE, AS_OF
    )
    assert not again.filter("claimed").count()
    later = dispatch.claim_deliveries(
        merge_deliveries(rows, claimed.select("delivery.*")), ready, NONE, AS_OF + timedelta(seconds=41)
    )
    assert {r.delivery.attempts for r in later.collect()} == {2}

    outcomes = spark.createDataFrame(
        [
            (1, T0, 503, None, None, "600", 0.1),
            (1, T0 + timedelta(1), 200, None, None, None, 0.1),
            (2, T0, 204, None, None, None, 0.2),
            (3, T0, None, "timeout", None, "600", 30.0),
        ],
        ATTEMPTS,
    )
    result = dispatch.apply_attempts(ready, outcomes, NONE, AS_OF)
    got = {r.id: r for r in result.changed.collect()}
    assert got[1].last_error == "POST https://example.com/h returned 503"
    assert got[1].available_at == AS_OF + timedelta(seconds=600)
    assert got[1].attempts == 1 and not got[1].dead_letter and got[1].locked_until is None
    assert got[2].dispatched_at == AS_OF and got[2].processed_at is None and got[2].last_error == "old"
    assert got[3].dead_letter and got[3].last_error == "callback timeout"
    assert got[3].available_at == AS_OF + timedelta(seconds=30)
    log = {r.delivery_id: r.result for r in result.log.collect()}
    assert log == {1: "transient", 2: "ok", 3: "timeout"}
    crashed = dispatch.apply_attempts(ready, outcomes.filter("delivery_id = 9"), NONE, AS_OF)
    assert all(r.locked_until is not None and r.attempts == 1 for r in crashed.changed.collect())


def test_delivery_fn(make_events, make_deliveries):
    events = make_events(json.dumps([GOOD]))
    due = dispatch.due_deliveries(events, make_deliveries({"id": 1, "event_id": "e1"}), NONE, AS_OF)
    sent = requests.render_requests(dispatch.revalidate_due(due, NONE)[0])
    body = json.loads(sent.head().body)
    assert len(body) == 14 and body["payload"] == {"hello": "world"} and body["actor_id"] is None
    assert body["created_at"] == "2024-01-01T00:00:00Z" and body["attempt"] == 1

    def deliver(batches):
        for b in batches:
            yield b[["delivery_id"]].assign(status_code=200)

    out = dispatch.with_delivery_fn(sent.select("delivery_id", "body"), deliver, "delivery_id long, status_code int", NONE)
    assert [tuple(r) for r in out.collect()] == [(1, 200)]


def test_sweep(make_events, make_deliveries):
    def hook(**extra):
        return json.dumps([{"name": "audit", **extra}])

    seconds = "external_completion_timeout_seconds"
    events = make_events(
        hook(**{seconds: 60}),
        hook(**{seconds: 60, "max_completion_cycles": 2}),
        hook(**{seconds: "x"}),
        hook(),
        hook(**{seconds: 60}),
    )
    sent = {"callback_name": "audit", "completion_mode": "external", "attempts": 3, "last_error": "e"}
    old = AS_OF - timedelta(seconds=61)
    rows = make_deliveries(
        {**sent, "id": 1, "event_id": "e1", "dispatched_at": old},
        {**sent, "id": 2, "event_id": "e2", "dispatched_at": old, "completion_cycles": 1},
        {**sent, "id": 3, "event_id": "e3", "dispatched_at": old},
        {**sent, "id": 4, "event_id": "e4", "dispatched_at": old},
        {**sent, "id": 5, "event_id": "e5", "dispatched_at": AS_OF - timedelta(seconds=60)},
    )
    result = external.sweep_external(events, rows, NONE, AS_OF)
    got = {r.id: r for r in result.changed.collect()}
    assert set(got) == {1, 2}
    assert (got[1].attempts, got[1].last_error, got[1].dispatched_at) == (0, None, None)
    assert got[1].available_at == AS_OF and got[1].completion_cycles == 1
    assert got[2].dead_letter and got[2].last_error == "external_completion_cycles_exhausted"
    assert got[2].attempts == 3 and got[2].dispatched_at == old
    assert [tuple(r) for r in result.report.collect()] == [("audit", 1, 1)]


def fold(row, actions, as_of):
    """The command semantics, one at a time."""
    row, outcomes = dict(row), []
    for action in actions:
        if action == "retry":
            if row["locked_until"] is not None and row["locked_until"] >= as_of:
                outcomes.append("locked")
                continue
            row.update(
                attempts=0, last_error=None, available_at=as_of, dispatched_at=None,
                processed_at=None, completion_cycles=0, dead_letter=False, locked_until=None,
            )
            outcomes.append("reset")
        elif action == "complete":
            row["processed_at"] = row["processed_at"] or as_of
            outcomes.append("ok")
        else:
            row.update(dead_letter=True, last_error="abandoned by operator")
            outcomes.append("ok")
    return row, outcomes


def test_command_sequences_match_a_plain_fold(spark, make_deliveries):
    from itertools import product

    sequences = [s for n in (1, 2, 3) for s in product(("retry", "complete", "abandon"), repeat=n)]
    starts = [
        {"attempts": 4, "dead_letter": True, "last_error": "x"},
        {"attempts": 2, "processed_at": T0, "dispatched_at": T0, "locked_until": T0},
        {"attempts": 1, "locked_until": AS_OF + timedelta(1)},
    ]
    rows, orders = [], {}
    for start in starts:
        for s in sequences:
            number = len(rows) + 1
            rows.append({**start, "id": number, "event_id": f"e{number}"})
            orders[number] = s
    table = make_deliveries(*rows)
    cmds = [(d, i, a) for d, s in orders.items() for i, a in enumerate(s)] + [(9999, 0, a) for a in ("retry", "complete")]
    frame = spark.createDataFrame(cmds, "delivery_id long, seq long, action string")
    result = commands.apply_commands(table, frame, AS_OF)
    after = {r.id: r.asDict() for r in merge_deliveries(table, result.changed).collect()}
    outcomes = {}
    for r in result.outcomes.orderBy("delivery_id", "seq").collect():
        outcomes.setdefault(r.delivery_id, []).append(r.outcome)
    for before in table.collect():
        row, want = fold(before.asDict(), orders[before.id], AS_OF)
        assert after[before.id] == row, orders[before.id]
        assert outcomes[before.id] == want
    assert outcomes[9999] == ["not_found", "not_found"]


def test_schedule_is_idempotent(make_events, make_deliveries):
    bad_first = [{**GOOD, "url": 5}, GOOD, {**GOOD, "name": "1bad"}, "x"]
    events = make_events(json.dumps([GOOD, {**GOOD, "name": "log_cb"}]), json.dumps(bad_first))
    empty = make_deliveries({"id": 10, "event_id": "e0"})
    first = schedule.schedule_deliveries(events, empty, NONE, AS_OF)
    rows = sorted(first.new_rows.collect(), key=lambda r: r.id)
    assert [(r.event_id, r.callback_name, r.dead_letter) for r in rows] == [
        ("e1", "send_email", False),
        ("e1", "log_cb", False),
        ("e2", "send_email", False),
        ("e2", "1bad", True),
        ("e2", "[3]", True),
    ]
    assert rows[0].id > 10 and len({r.id for r in rows}) == 5
    assert rows[3].completion_mode == "managed" and rows[3].attempts == 0
    assert first.rejects.count() == 3
    table = empty.unionByName(first.new_rows)
    assert schedule.schedule_deliveries(events, table, NONE, AS_OF).new_rows.count() == 0
    assert first.cursor.head()[0] == 2
    assert schedule.recover_cursor(events, table).head()[0] == 2
    assert schedule.recover_cursor(events, empty).head()[0] == 0
    only = schedule.new_events(events, 1).collect()
    assert [r.id for r in only] == [2]


def test_deliver_each_bounds_calls_and_answers_every_request(spark):
    def send(row):
        if row["delivery_id"] % 5 == 0:
            raise OSError("refused")
        if row["delivery_id"] % 5 == 1:
            time.sleep(20)
        if row["delivery_id"] % 5 == 2:
            return {"status_code": 429, "retry_after": 7}
        return {"status_code": 200} if row["delivery_id"] % 5 == 3 else "nothing"

    requests = spark.createDataFrame([(k, "b", 1 if k % 2 else None) for k in range(20)], "delivery_id long, body string, timeout_seconds long")
    opts = Options(dispatch_concurrency=8, timeout_seconds=1)
    rows = {r.delivery_id: r for r in dispatch.deliver_each(requests, send, opts, tasks=2).collect()}
    assert sorted(rows) == list(range(20))
    kinds = {k % 5: (r.status_code, r.failure_kind, r.error_detail, r.retry_after) for k, r in rows.items()}
    assert kinds[0] == (None, "connection", "OSError: refused", None)
    assert kinds[1] == (None, "timeout", None, None)
    assert kinds[2] == (429, None, None, "7") and kinds[3] == (200, None, None, None)
    assert kinds[4][1] == "connection" and all(r.started_at is not None and r.duration_seconds < 5 for r in rows.values())


def test_calls_never_exceed_the_window():
    running, most, lock = [0], [0], threading.Lock()

    def send(row):
        with lock:
            running[0] += 1
            most[0] = max(most[0], running[0])
        time.sleep(0.01)
        with lock:
            running[0] -= 1
        return {"status_code": 200}

    calls, out = dispatch.Calls(send, 3, 5), []
    for k in range(20):
        out += calls.start({"delivery_id": k})
    out += calls.rest()
    assert most[0] <= 3 and sorted(r.delivery_id.iloc[0] for r in out) == list(range(20))
