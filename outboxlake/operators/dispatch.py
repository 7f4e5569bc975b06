"""Due work, claims, attempt outcomes and retry times."""

from __future__ import annotations

import queue
import threading
import time
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outboxlake.functions import rules, states, times
from outboxlake.functions import variant as vj
from outboxlake.functions.text import cut_utf8
from outboxlake.operators.merge import changed_row
from outboxlake.options import FALLBACK_BACKOFF_SECONDS, Options
from outboxlake.schemas import ATTEMPTS, DELIVERY_COLUMNS

EVENT_PART = (
    "kind",
    "aggregate_type",
    "aggregate_id",
    "payload",
    "metadata",
    "actor_id",
    "correlation_id",
    "causation_id",
)

OK = "ok"
TRANSIENT = "transient"
TIMEOUT = "timeout"
TIMEOUT_TEXT = "callback timeout"
#: Kind of failure of a request that was never sent; its error text stands as it is.
REFUSED = "refused"

# Longer waits than this many seconds (about 2800 years) leave the timestamp range.
MAX_RETRY_AFTER = 90_000_000_000


def due_deliveries(
    events: DataFrame,
    deliveries: DataFrame,
    opts: Options,
    as_of: times.AsOf,
) -> DataFrame:
    """Deliveries to attempt now, with their event. ``delivery`` holds the full row.

    With a batch size the choice is made on narrow columns first, and the wide event
    columns are then read for the chosen rows only.
    """
    now = times.like(deliveries, "available_at", as_of)
    due = deliveries.filter(states.is_due(now))
    if opts.batch_size is not None:
        due = (
            due.join(events.select("event_id"), "event_id", "left_semi")
            .orderBy("available_at", "id")
            .limit(opts.batch_size)
        )
    return with_events(due, events)


def with_events(deliveries: DataFrame, events: DataFrame) -> DataFrame:
    left = deliveries.select(
        F.col("id").alias("delivery_id"),
        "event_id",
        "callback_name",
        "attempts",
        F.struct(*DELIVERY_COLUMNS).alias("delivery"),
    )
    right = events.select("event_id", *EVENT_PART, "callbacks", "created_at")
    return left.join(right, "event_id", "inner")


def revalidate(due: DataFrame, opts: Options) -> DataFrame:
    """Adds ``target`` and ``spec_error`` (exactly one is set) per due row.

    The first array element of that name is judged; the event is already at hand, so
    this is a projection.
    """
    found = due.withColumn("_array", rules.callback_array(F.col("callbacks"))).withColumn(
        "pos",
        F.array_position(
            F.transform("_array", rules.element_name),
            F.col("callback_name"),
        ).cast("int")
        - 1,
    )
    size = F.size("_array")
    too_many = F.concat(
        F.lit(rules.PREFIX + "too many callbacks in event ("),
        size.cast("string"),
        F.lit(f"); max is {opts.max_callbacks_per_event}"),
    )
    found = found.withColumns(
        {
            "_array_error": F.when(F.col("_array").isNull(), rules.TEXT_NOT_ARRAY).when(
                size > opts.max_callbacks_per_event, too_many
            ),
            "_missing": F.col("pos") < 0,
            "element": F.when(F.col("pos") >= 0, F.get("_array", F.col("pos"))),
        }
    ).drop("_array")
    judged = vj.add_stages(found, rules.stages(opts))
    name = F.col("callback_name")
    failed = F.coalesce(
        F.col("_array_error"), F.when(~F.col("_missing"), F.col("message"))
    )
    error = F.when(
        failed.isNotNull(),
        F.concat(
            F.lit("Invalid data: callback '"),
            name,
            F.lit("' failed structural revalidation at dispatch time: "),
            failed,
        ),
    ).when(
        F.col("_missing"),
        F.concat(
            F.lit("Callback target missing: callback '"),
            name,
            F.lit("' not found in event callbacks array"),
        ),
    )
    return judged.withColumn("spec_error", error).select(
        *due.columns,
        F.when(F.col("spec_error").isNull(), F.col("target")).alias("target"),
        F.col("spec_error"),
    )


def revalidate_due(due: DataFrame, opts: Options) -> tuple[DataFrame, DataFrame]:
    """(rows to attempt, changed deliveries of the refused rows)."""
    judged = revalidate(due, opts)
    return judged.filter(F.col("spec_error").isNull()), poison_rows(judged)


def poison_rows(judged: DataFrame) -> DataFrame:
    bad = judged.filter(F.col("spec_error").isNotNull())
    error = cut_utf8(F.concat(F.lit("invalid callback spec: "), F.col("spec_error")))
    return bad.select(
        *changed_row(
            "delivery",
            {
                "dead_letter": F.lit(True),
                "last_error": error,
                "locked_until": F.lit(None).cast(_time_type(bad)),
            },
        )
    )


def _time_type(df: DataFrame) -> str:
    return df.schema["delivery"].dataType["available_at"].dataType.simpleString()


def claim_deliveries(
    deliveries: DataFrame, batch: DataFrame, opts: Options, as_of: times.AsOf
) -> DataFrame:
    """Leases the batch on the current table.

    Returns the batch columns with ``delivery`` after the claim and ``claimed``; rows
    another worker holds come back unchanged with ``claimed`` false.
    """
    current = deliveries.select(
        F.col("id").alias("delivery_id"), F.struct(*DELIVERY_COLUMNS).alias("delivery")
    )
    return lease(batch.drop("delivery").join(current, "delivery_id", "inner"), opts, as_of)


def lease(batch: DataFrame, opts: Options, as_of: times.AsOf) -> DataFrame:
    kind = _time_type(batch)
    now = times.instant(as_of, kind)
    free = states.is_claimable(now, lambda n: F.col(f"delivery.{n}"))
    until = times.plus_seconds(
        now, F.col("target.timeout_seconds") + opts.lock_buffer_seconds
    )

    def if_free(new: Column, column: str) -> Column:
        return F.when(free, new).otherwise(F.col(f"delivery.{column}"))

    row = changed_row(
        "delivery",
        {
            "locked_until": if_free(until, "locked_until"),
            "attempts": if_free(F.col("delivery.attempts") + 1, "attempts"),
            "last_attempt_at": if_free(now, "last_attempt_at"),
        },
    )
    return batch.withColumns({"claimed": free, "delivery": F.struct(*row)})


def classify_attempts(attempts: DataFrame) -> DataFrame:
    """Adds ``result`` and ``error`` to outcome rows that carry the target ``url``."""
    status = F.col("status_code")
    result = (
        F.when(F.col("failure_kind") == "timeout", TIMEOUT)
        .when(F.col("failure_kind").isNotNull(), TRANSIENT)
        .when(status.between(200, 299), OK)
        .otherwise(TRANSIENT)
    )
    returned = F.concat(
        F.lit("POST "), F.col("url"), F.lit(" returned "), status.cast("string")
    )
    error = (
        F.when(F.col("failure_kind") == "timeout", TIMEOUT_TEXT)
        .when(
            F.col("failure_kind") == "connection",
            F.concat(F.lit("connection error: "), F.coalesce("error_detail", F.lit(""))),
        )
        .when(F.col("failure_kind").isNotNull(), F.col("error_detail"))
        .when(~status.between(200, 299), returned)
    )
    return attempts.withColumns({"result": result, "error": error})


def retry_after_seconds(text: Column, now: Column) -> Column:
    """Retry-After as seconds: whole seconds or an HTTP date (0 when past), else NULL.

    Whole seconds are unsigned 64-bit numbers; the longest waits end where timestamps do.
    """
    trimmed = F.regexp_replace(text, r"^\s+|\s+\z", "")
    whole = F.regexp_replace(trimmed, r"^\+", "").try_cast("decimal(38,0)")
    # Rare and large, so kept out of the generated code.
    date = vj.bind(trimmed, times.http_date)
    until = times.seconds_between(now.cast("timestamp_ntz"), date)
    known = F.when(whole < F.lit(str(1 << 64)).cast("decimal(38,0)"), whole.cast("double"))
    seconds = F.when(trimmed.rlike(r"^\+?[0-9]+\z"), known).otherwise(
        vj.bind(until, lambda seconds: F.when(seconds < 0, 0.0).otherwise(seconds))
    )
    return F.when(seconds > MAX_RETRY_AFTER, float(MAX_RETRY_AFTER)).otherwise(seconds)


def jitter_factor(mode: str, delivery_id: Column, attempt: Column) -> Column:
    """Factor in [0.75, 1.25): none, from a hash (replayable), or random."""
    if mode == "none":
        return F.lit(1.0)
    if mode == "rand":
        return 0.75 + F.rand() * 0.5
    unit = F.pmod(F.xxhash64(delivery_id, attempt), F.lit(1_000_000)) / 1e6
    return 0.75 + unit * 0.5


def retry_schedule(
    attempts: DataFrame,
    as_of: times.AsOf,
    jitter: str = "hash",
    time_type: str = "timestamp_ntz",
) -> DataFrame:
    """Adds ``retry_after_seconds``, ``delay_seconds`` and ``next_available_at``.

    Needs ``delivery_id``, ``attempt`` (1-based), ``backoff`` and ``retry_after``.
    """
    now = times.instant(as_of, time_type)
    index = F.greatest(F.col("attempt"), F.lit(1)) - 1
    base = F.coalesce(
        F.get("backoff", index),
        F.try_element_at("backoff", F.lit(-1)),
        F.lit(FALLBACK_BACKOFF_SECONDS),
    ).cast("double")
    floor = retry_after_seconds(F.col("retry_after"), now)
    if "result" in attempts.columns:
        floor = F.when(F.col("result") != TIMEOUT, floor)
    factor = jitter_factor(jitter, F.col("delivery_id"), F.col("attempt"))
    return (
        attempts.withColumn("retry_after_seconds", floor)
        .withColumn(
            "delay_seconds",
            F.greatest(base, F.coalesce(F.col("retry_after_seconds"), base)) * factor,
        )
        .withColumn("next_available_at", times.plus_seconds(now, F.col("delay_seconds")))
    )


def success_changes(now: Column, empty: Column) -> dict[str, Column]:
    """Managed rows are done; external ones now wait for their completion."""
    managed = F.col("target.mode") == "managed"
    return {
        "dispatched_at": now,
        "processed_at": F.when(managed, now).otherwise(F.col("delivery.processed_at")),
        "locked_until": empty,
    }


def failure_changes(empty: Column) -> dict[str, Column]:
    return {
        "last_error": cut_utf8(F.col("error")),
        "available_at": F.col("next_available_at"),
        "dead_letter": F.col("exhausted"),
        "locked_until": empty,
    }


def first_outcomes(outcomes: DataFrame) -> DataFrame:
    """One outcome per delivery, the earliest; copies combine before the shuffle."""
    row = F.struct(
        "started_at",
        "status_code",
        "failure_kind",
        "error_detail",
        "retry_after",
        "duration_seconds",
    )
    return outcomes.groupBy("delivery_id").agg(F.min(row).alias("o")).select("delivery_id", "o.*")


@dataclass(frozen=True)
class AttemptResult:
    """``changed`` delivery rows and the attempt ``log`` they came from."""

    changed: DataFrame
    log: DataFrame


def apply_attempts(
    batch: DataFrame, outcomes: DataFrame, opts: Options, as_of: times.AsOf
) -> AttemptResult:
    """Claims a revalidated batch and writes its outcomes back.

    Claimed rows without an outcome keep their lease, as after a crash.
    """
    kind = _time_type(batch)
    now, empty = times.instant(as_of, kind), F.lit(None).cast(kind)
    leased = lease(batch, opts, as_of).filter("claimed")
    joined = leased.join(first_outcomes(outcomes), "delivery_id", "left").withColumns(
        {
            "url": F.col("target.url"),
            "attempt": F.col("attempts") + 1,
            "backoff": F.col("target.backoff"),
            "_answered": F.col("status_code").isNotNull() | F.col("failure_kind").isNotNull(),
        }
    )
    timed = retry_schedule(classify_attempts(joined), as_of, opts.jitter, kind).withColumn(
        "exhausted", F.col("attempt") >= F.col("target.max_attempts")
    )
    success, failure = success_changes(now, empty), failure_changes(empty)
    changes = {}
    for name in {*success, *failure}:
        kept = F.col(f"delivery.{name}")
        changes[name] = (
            F.when(~F.col("_answered"), kept)
            .when(F.col("result") == OK, success.get(name, kept))
            .otherwise(failure.get(name, kept))
        )
    changed = timed.select(*changed_row("delivery", changes))
    failed = F.col("result") != OK
    log = timed.filter("_answered").select(
        "delivery_id",
        "event_id",
        "callback_name",
        F.col("target.mode").alias("completion_mode"),
        F.col("target.signing_key_id").alias("signing_key_id"),
        "attempt",
        "started_at",
        "result",
        "error",
        F.when(failed, F.col("retry_after_seconds")).alias("retry_after_seconds"),
        F.when(failed, F.col("next_available_at")).alias("next_available_at"),
        (failed & F.col("exhausted")).alias("dead_letter"),
        "duration_seconds",
    )
    return AttemptResult(changed, log)


def apply_success(batch: DataFrame, as_of: times.AsOf) -> DataFrame:
    """Changed rows of a batch whose attempts all succeeded."""
    kind = _time_type(batch)
    now = times.instant(as_of, kind)
    return batch.select(*changed_row("delivery", success_changes(now, F.lit(None).cast(kind))))


def apply_failure(failed: DataFrame) -> DataFrame:
    """Changed rows of failed attempts with ``error``, ``next_available_at``, ``exhausted``."""
    empty = F.lit(None).cast(_time_type(failed))
    return failed.select(*changed_row("delivery", failure_changes(empty)))


def all_outcomes(signed: DataFrame, answers: DataFrame, sent_at: times.AsOf) -> DataFrame:
    """One table of outcomes for signed requests: the answers to those that were sent, and a
    failed attempt for each that could not be (``send_error``), so that it backs off too."""
    sent = signed.filter(F.col("send_error").isNull()).select("delivery_id")
    answered = answers.select(*ATTEMPTS.fieldNames()).join(sent, "delivery_id", "left_semi")
    kind = answers.schema["started_at"].dataType.simpleString()
    refused = signed.filter(F.col("send_error").isNotNull()).select(
        "delivery_id",
        times.instant(sent_at, kind).alias("started_at"),
        F.lit(None).cast("int").alias("status_code"),
        F.lit(REFUSED).alias("failure_kind"),
        F.col("send_error").alias("error_detail"),
        F.lit(None).cast("string").alias("retry_after"),
        F.lit(0.0).alias("duration_seconds"),
    )
    return answered.unionByName(refused)


def with_delivery_fn(requests: DataFrame, deliver, schema, opts: Options) -> DataFrame:
    """Runs a user function over request batches (pandas in, outcome rows out) with
    bounded parallelism."""
    return requests.repartition(opts.dispatch_concurrency).mapInPandas(deliver, schema)


def deliver_each(requests: DataFrame, send, opts: Options, tasks: int = 4) -> DataFrame:
    """Calls ``send`` on every request (a dict) and returns attempt rows as they complete.

    ``send`` returns a dict with ``status_code`` and, if it likes, ``retry_after``. At most
    ``dispatch_concurrency`` calls run at a time over all tasks; a request whose column
    ``timeout_seconds`` is over counts as timed out, whatever becomes of its call. A call
    that raises, or returns anything else, is a failed connection. Every request gets one row.
    """
    tasks = max(1, min(tasks, opts.dispatch_concurrency))
    window = opts.dispatch_concurrency // tasks

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        calls = Calls(send, window, opts.timeout_seconds)
        for batch in batches:
            for row in batch.to_dict("records"):
                yield from calls.start(row)
        yield from calls.rest()

    return requests.repartition(tasks).mapInPandas(run, ATTEMPTS)


class Calls:
    """A window of calls in flight, each in a thread of its own."""

    def __init__(self, send, window: int, timeout: float) -> None:
        self.send, self.window, self.timeout = send, window, timeout
        self.done: queue.Queue = queue.Queue()
        self.open: dict[int, tuple[int, datetime, float, float]] = {}
        self.number = 0

    def start(self, row: dict) -> Iterator[pd.DataFrame]:
        """Starts a call once there is room for it; gives the outcomes met on the way."""
        while len(self.open) >= self.window:
            yield from self._next()
        self.number += 1
        number, now = self.number, time.monotonic()
        limit = row.get("timeout_seconds")
        limit = self.timeout if limit is None or pd.isna(limit) else float(limit)
        self.open[number] = (row["delivery_id"], datetime.now(timezone.utc), now, now + limit)
        threading.Thread(target=self._call, args=(number, row), daemon=True).start()

    def rest(self) -> Iterator[pd.DataFrame]:
        while self.open:
            yield from self._next()

    def _call(self, number: int, row: dict) -> None:
        try:
            answer = self.send(row)
            status, after = int(answer["status_code"]), answer.get("retry_after")
            self.done.put((number, status, None if after is None else str(after), None))
        except Exception as error:
            self.done.put((number, None, None, f"{type(error).__name__}: {error}"))

    def _next(self) -> Iterator[pd.DataFrame]:
        first = min(deadline for *_, deadline in self.open.values())
        try:
            number, status, after, error = self.done.get(timeout=max(0.0, first - time.monotonic()))
        except queue.Empty:
            now = time.monotonic()
            for number in [n for n, call in self.open.items() if call[3] <= now]:
                yield self._row(number, None, TIMEOUT, None, None)
            return
        # The answer to a call that was given up comes too late.
        if number in self.open:
            yield self._row(number, status, None if error is None else "connection", error, after)

    def _row(self, number: int, status, kind, error, after) -> pd.DataFrame:
        delivery_id, started, begun, _ = self.open.pop(number)
        row = (delivery_id, started, status, kind, error, after, time.monotonic() - begun)
        out = pd.DataFrame([row], columns=ATTEMPTS.fieldNames())
        return out.astype({"status_code": "Int32"})
