"""Every operator as a query over the given tables, with its SQL where one exists."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from outboxlake.operators import (
    alerts,
    commands,
    dispatch,
    external,
    fanout,
    metrics,
    reads,
    requests,
    retention,
    schedule,
)
from outboxlake.operators.merge import merge_deliveries
from outboxlake.options import Options, Page
from outboxlake.plans import fixtures, oracle
from outboxlake.plans.fixtures import AS_OF
from outboxlake.schemas import DELIVERY_COLUMNS, EVENT_COLUMNS
from outboxlake.session import STATE_STORE, configure, fresh_path
from outboxlake.sources import tables
from outboxlake.streaming import lifecycle
from outboxlake.streaming import queries as streams
from outboxlake.streaming.run_log import RunLog

WHOLE = Options(
    payload_size_limit=fixtures.PAYLOAD_LIMIT,
    batch_size=None,
    schedule_batch_size=None,
    age_sample_limit=None,
    jitter="none",
)
BATCH = Options(payload_size_limit=fixtures.PAYLOAD_LIMIT, jitter="none")
CUTOFFS = retention.Cutoffs("2024-01-10", "2024-01-25")
KEYS = {"k1": b"super-secret-key-32-bytes-minimum!!"}
CURSOR = 400
SINCE = "2024-01-15 00:00:00"


@dataclass(frozen=True)
class Tables:
    spark: SparkSession
    sf_dir: str

    @cached_property
    def base(self) -> DataFrame:
        configure(self.spark)
        return self.spark.read.parquet(f"{self.sf_dir}/events.parquet")

    def table(self, name: str) -> DataFrame:
        return fixtures.derive_from(self.base, name)

    @property
    def events(self) -> DataFrame:
        return self.table("outbox_events")

    @property
    def varied(self) -> DataFrame:
        return self.table("varied_events")

    @cached_property
    def spread_base(self) -> DataFrame:
        return tables.spread(self.base)

    @property
    def spread_events(self) -> DataFrame:
        """For the queries that judge every callback."""
        return fixtures.derive_from(self.spread_base, "outbox_events")

    @property
    def spread_varied(self) -> DataFrame:
        return fixtures.derive_from(self.spread_base, "varied_events")

    @property
    def deliveries(self) -> DataFrame:
        return self.table("outbox_deliveries")

    @property
    def attempts(self) -> DataFrame:
        return self.table("attempts")

    @property
    def commands(self) -> DataFrame:
        return self.table("commands")

    def due(self, opts: Options = WHOLE) -> DataFrame:
        return dispatch.due_deliveries(self.events, self.deliveries, opts, AS_OF)

    def ready(self) -> DataFrame:
        """Due rows that passed revalidation."""
        return dispatch.revalidate_due(self.due(), WHOLE)[0]

    def dispatched(self) -> dispatch.AttemptResult:
        return dispatch.apply_attempts(self.ready(), self.attempts, WHOLE, AS_OF)

    def signed(self) -> DataFrame:
        keys = requests.key_table(self.spark, KEYS)
        return requests.sign_requests(requests.render_requests(self.ready()), keys, AS_OF)

    def targeted_attempts(self) -> DataFrame:
        """All attempts with their resolved target, due or not."""
        rows = dispatch.with_events(self.deliveries, self.events)
        ok = dispatch.revalidate(rows, WHOLE).filter(F.col("spec_error").isNull())
        return ok.join(self.attempts, "delivery_id", "inner").withColumns(
            {
                "url": F.col("target.url"),
                "attempt": F.col("attempts") + 1,
                "backoff": F.col("target.backoff"),
            }
        )


Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def register(key: str, sql: str | None = None):
    def add(build: Callable[[Tables], DataFrame]):
        QUERIES[key] = lambda spark, sf_dir: build(Tables(spark, sf_dir))
        if sql is not None:
            ORACLE[key] = sql
        return build

    return add


W = oracle.ctes()
V = oracle.ctes(events="varied_events")
D = oracle.D_COLUMNS
E = oracle.E_COLUMNS
NOW = oracle.NOW


# --- Sources and scans ---------------------------------------------------------------


def _landed(parts: str, key: str, order: str, columns: str, reason: str) -> tuple[str, str]:
    base = f"""judged_rows AS (SELECT *, {reason} AS reason FROM {parts}),
copies AS (SELECT {columns}, count(*) AS copies FROM judged_rows WHERE reason IS NULL GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {order}) AS rn FROM copies)"""
    good = f"SELECT {columns} FROM ranked WHERE rn = 1"
    bad = f"""SELECT {columns}, reason, 1 AS copies FROM judged_rows WHERE reason IS NOT NULL
UNION ALL SELECT {columns}, 'duplicate_key' AS reason, CASE WHEN rn = 1 THEN copies - 1 ELSE copies END AS copies
FROM ranked WHERE NOT (rn = 1 AND copies = 1)"""
    return f"{base} {good}", f"{base} {bad}"


_GOOD_E, _BAD_E = _landed(
    "landed_events",
    "event_id",
    "id, kind, aggregate_type, aggregate_id, payload, metadata, callbacks",
    E,
    "CASE WHEN payload IS NULL THEN 'null_payload' WHEN NOT json_valid(callbacks) OR json_type(callbacks) <> 'ARRAY' "
    "OR json_array_length(callbacks) = 0 THEN 'callbacks_not_a_nonempty_array' END",
)
_GOOD_D, _BAD_D = _landed(
    "landed_deliveries",
    "event_id, callback_name",
    "id",
    D,
    "CASE WHEN completion_mode NOT IN ('managed', 'external') THEN 'completion_mode_invalid' "
    "WHEN event_id NOT IN (SELECT event_id FROM outbox_events) THEN 'event_missing' END",
)
_LAND_E = oracle.ctes("landed_events") + ", "
_LAND_D = oracle.ctes("landed_deliveries") + ", "


@register("load_events", _LAND_E + _GOOD_E)
def _(t: Tables):
    return tables.check_events(t.table("landed_events")).rows


@register("load_events_rejected", _LAND_E + _BAD_E)
def _(t: Tables):
    return tables.check_events(t.table("landed_events")).rejected


@register("load_deliveries", _LAND_D + _GOOD_D)
def _(t: Tables):
    return tables.check_deliveries(t.table("landed_deliveries"), t.events).rows


@register("load_deliveries_rejected", _LAND_D + _BAD_D)
def _(t: Tables):
    return tables.check_deliveries(t.table("landed_deliveries"), t.events).rejected


@register("new_events", W + f"SELECT {E}, strlen(payload) AS payload_size_bytes FROM outbox_events WHERE id > {CURSOR}")
def _(t: Tables):
    return schedule.new_events(t.events, CURSOR).select(*EVENT_COLUMNS, "payload_size_bytes")


@register(
    "new_events_batch",
    W + f"SELECT {E}, strlen(payload) AS payload_size_bytes FROM outbox_events WHERE id > {CURSOR} ORDER BY id LIMIT 500",
)
def _(t: Tables):
    limit = BATCH.schedule_batch_size
    return schedule.new_events(t.events, CURSOR, limit).select(*EVENT_COLUMNS, "payload_size_bytes")


@register(
    "recover_cursor",
    W + "SELECT coalesce(max(e.id), 0) AS cursor FROM outbox_events e WHERE e.event_id = "
    "(SELECT event_id FROM outbox_deliveries ORDER BY id DESC LIMIT 1)",
)
def _(t: Tables):
    return schedule.recover_cursor(t.events, t.deliveries)


_START = f"(SELECT coalesce(max(id), 0) FROM outbox_events WHERE created_at < TIMESTAMP '{SINCE}')"


@register("rescan_since", W + oracle.scheduled(cursor=_START))
def _(t: Tables):
    return schedule.rescan_since(t.spread_events, t.deliveries, WHOLE, AS_OF, SINCE).new_rows


@register("append_deliveries", W + f"SELECT {D} FROM ({oracle.scheduled()}) x UNION ALL SELECT {D} FROM outbox_deliveries")
def _(t: Tables):
    judged = fanout.judge_callbacks(t.spread_events, WHOLE)
    rows = schedule.append_deliveries(schedule.delivery_candidates(judged), t.deliveries, AS_OF)
    return t.deliveries.select(*DELIVERY_COLUMNS).unionByName(rows)


_AGGREGATE = "00000000-0000-4000-9000-000000000007"


@register("aggregate_history", W + f"SELECT {E} FROM outbox_events WHERE aggregate_type = 'user' AND aggregate_id = '{_AGGREGATE}'")
def _(t: Tables):
    return reads.aggregate_history(t.events, "user", _AGGREGATE)


@register(
    "events_by_kind",
    W + f"SELECT {E} FROM outbox_events WHERE kind = 'click@v1' AND created_at >= TIMESTAMP '2024-01-05' AND created_at < TIMESTAMP '2024-01-20'",
)
def _(t: Tables):
    return reads.events_by_kind(t.events, "click@v1", "2024-01-05", "2024-01-20")


@register("correlation_trace", W + f"SELECT {E} FROM outbox_events WHERE correlation_id IS NOT NULL")
def _(t: Tables):
    return reads.correlation_trace(t.events)


# --- Fan-out -------------------------------------------------------------------------


@register(
    "explode_callbacks",
    V + "SELECT id, event_id, pos, json_type(el) = 'OBJECT' AS is_object, name AS name_text, "
    "CASE WHEN json_type(el, '$.url') = 'VARCHAR' THEN el->>'$.url' END AS url_text FROM el1",
)
def _(t: Tables):
    element = F.col("element")
    return fanout.explode_callbacks(t.varied).select(
        "id",
        "event_id",
        "pos",
        element.isNotNull().alias("is_object"),
        fanout.rules.element_name(element).alias("name_text"),
        fanout.vj.text(element["url"]).alias("url_text"),
    )


@register(
    "oversized_payloads",
    W + "SELECT id, event_id, kind, pos, label AS callback_name, message FROM judged WHERE branch = 'oversized'",
)
def _(t: Tables):
    return fanout.oversized_payloads(t.events, WHOLE)


@register("callback_names", V + "SELECT id, event_id, pos, label AS callback_name FROM el3")
def _(t: Tables):
    return fanout.callback_names(t.varied)


_VERDICT = ("id", "event_id", "pos", "label", "reason", "message")
_VERDICT_SQL = "SELECT id, event_id, pos, label, reason, message FROM judged WHERE branch IN ('checked', 'unlisted')"


@register("validate_callbacks", W + _VERDICT_SQL)
def _(t: Tables):
    return fanout.validate_callbacks(t.spread_events, WHOLE).select(*_VERDICT)


@register("validate_callbacks_varied", V + _VERDICT_SQL)
def _(t: Tables):
    return fanout.validate_callbacks(t.spread_varied, WHOLE).select(*_VERDICT)


@register(
    "array_level_rejects",
    V + "SELECT id, event_id, kind, pos, label AS callback_name, message, reason FROM judged WHERE branch = 'too_many'",
)
def _(t: Tables):
    return fanout.array_level_rejects(t.spread_varied, WHOLE)


@register("dedupe_callback_names", V + _VERDICT_SQL + " AND reason = 'duplicate_name'")
def _(t: Tables):
    return fanout.dedupe_callback_names(t.spread_varied, WHOLE).select(*_VERDICT)


@register(
    "resolve_targets",
    V + """SELECT id, event_id, pos, label AS name, el->>'$.url' AS url, mode0 AS mode, el->>'$.signing_key_id' AS signing_key_id,
 coalesce(CAST(el->>'$.max_attempts' AS INT), 6) AS max_attempts, coalesce(CAST(el->>'$.timeout_seconds' AS BIGINT), 30) AS timeout_seconds,
 CAST(el->>'$.external_completion_timeout_seconds' AS BIGINT) AS external_completion_timeout_seconds,
 coalesce(CAST(el->>'$.max_completion_cycles' AS INT), 20) AS max_completion_cycles,
 coalesce(replace(replace(replace(CAST(json_extract(el, '$.backoff_seconds') AS VARCHAR), '[', ''), ']', ''), ' ', ''), '30,120,600,3600,21600,86400') AS backoff,
 coalesce(len(json_keys(el, '$.headers')), 0) AS header_count FROM judged WHERE valid""",
)
def _(t: Tables):
    return (
        fanout.resolve_targets(t.spread_varied, WHOLE)
        .withColumn("backoff", F.array_join(F.col("backoff").cast("array<string>"), ","))
        .withColumn("header_count", F.size("headers").cast("bigint"))
        .drop("headers")
    )


@register("schedule_deliveries", W + oracle.scheduled())
def _(t: Tables):
    return schedule.schedule_deliveries(t.spread_events, t.deliveries, WHOLE, AS_OF).new_rows


@register("schedule_deliveries_varied", V + oracle.scheduled())
def _(t: Tables):
    return schedule.schedule_deliveries(t.spread_varied, t.deliveries, WHOLE, AS_OF).new_rows


@register(
    "schedule_cursor", W + "SELECT coalesce(max(id), 0) AS cursor FROM outbox_events WHERE id > 0"
)
def _(t: Tables):
    return schedule.schedule_deliveries(t.events, t.deliveries, WHOLE, AS_OF).cursor


@register("corrupt_events", V + "SELECT id, event_id, kind, a.created_at, callbacks FROM arrays a WHERE n IS NULL AND size <= 1024")
def _(t: Tables):
    return fanout.corrupt_events(t.varied, WHOLE)


# --- Dispatch ------------------------------------------------------------------------

_DUE_COLUMNS = (
    "delivery_id",
    "event_id",
    "attempts",
    "callback_name",
    "kind",
    "aggregate_type",
    "aggregate_id",
    "payload",
    "metadata",
    "actor_id",
    "correlation_id",
    "causation_id",
    "created_at",
    "callbacks",
)
_DUE_SQL = f"""SELECT d.id AS delivery_id, event_id, d.attempts, d.callback_name, e.kind, e.aggregate_type, e.aggregate_id, e.payload,
 e.metadata, e.actor_id, e.correlation_id, e.causation_id, e.created_at, e.callbacks
 FROM outbox_deliveries d JOIN outbox_events e USING (event_id) WHERE {oracle.DUE}"""
_CHECKED = f"(SELECT * FROM checked_rows WHERE {oracle.DUE})"


@register("due_deliveries", W + _DUE_SQL)
def _(t: Tables):
    return t.due().select(*_DUE_COLUMNS)


@register("due_deliveries_batch", W + _DUE_SQL + " ORDER BY d.available_at, d.id LIMIT 50")
def _(t: Tables):
    return t.due(BATCH).select(*_DUE_COLUMNS)


def _changed(overrides: dict[str, str], source: str) -> str:
    columns = [f"{overrides[c]} AS {c}" if c in overrides else c for c in D.split(", ")]
    return f"SELECT {', '.join(columns)} FROM {source}"


@register(
    "revalidate_due",
    W + _changed(
        {
            "dead_letter": "true",
            "last_error": "'invalid callback spec: ' || spec_error",
            "locked_until": "CAST(NULL AS TIMESTAMP)",
        },
        f"{_CHECKED} x WHERE spec_error IS NOT NULL",
    ),
)
def _(t: Tables):
    return dispatch.revalidate_due(t.due(), WHOLE)[1]


@register(
    "claim_deliveries",
    W + f"""SELECT id AS delivery_id, true AS claimed, attempts + 1 AS attempts, {NOW} + to_seconds(timeout_s + 10) AS locked_until,
 {NOW} AS last_attempt_at FROM {_CHECKED} x WHERE spec_error IS NULL""",
)
def _(t: Tables):
    claimed = dispatch.claim_deliveries(t.deliveries, t.ready(), WHOLE, AS_OF)
    return claimed.select(
        "delivery_id",
        "claimed",
        "delivery.attempts",
        "delivery.locked_until",
        "delivery.last_attempt_at",
    )


def _text(column: str) -> str:
    return f"coalesce('\"' || {column} || '\"', 'null')"


_BODY_SQL = (
    "'{\"actor_id\":' || " + _text("actor_id") + " || ',\"aggregate_id\":\"' || aggregate_id || '\",\"aggregate_type\":\"' || aggregate_type || "
    "'\",\"attempt\":' || (attempts + 1) || ',\"callback_name\":\"' || callback_name || '\",\"causation_id\":' || " + _text("causation_id")
    + " || ',\"correlation_id\":' || " + _text("correlation_id") + " || ',\"created_at\":\"' || strftime(event_created_at, '%Y-%m-%dT%H:%M:%S') || "
    "CASE WHEN strftime(event_created_at, '%f') = '000000' THEN '' WHEN ends_with(strftime(event_created_at, '%f'), '000') "
    "THEN '.' || left(strftime(event_created_at, '%f'), 3) ELSE '.' || strftime(event_created_at, '%f') END || "
    "'Z\",\"delivery_id\":' || id || ',\"event_id\":\"' || event_id || '\",\"kind\":\"' || kind || '\",\"metadata\":' || json(metadata) || "
    "',\"mode\":\"' || mode0 || '\",\"payload\":' || json(payload) || '}'"
)
_REQUESTS = f"""requests AS (SELECT id AS delivery_id, event_id, callback_name, attempts + 1 AS attempt, url, timeout_s AS timeout_seconds, key_id AS signing_key_id,
 {_BODY_SQL} AS body FROM {_CHECKED} x WHERE spec_error IS NULL)"""


@register(
    "render_requests",
    W + ", " + _REQUESTS + " SELECT *, 7 AS header_count, CAST(attempt AS VARCHAR) AS attempt_header FROM requests",
)
def _(t: Tables):
    rendered = requests.render_requests(t.ready())
    return (
        rendered.withColumn("header_count", F.size("headers"))
        .withColumn("attempt_header", F.col("headers")["X-Outbox-Attempt"])
        .drop("headers")
    )


_STAMP = 1706745600
_K1 = KEYS["k1"].ljust(64, b"\0")
_INNER, _OUTER = bytes(b ^ 0x36 for b in _K1).hex(), bytes(b ^ 0x5C for b in _K1).hex()
_SIGNED_SQL = f"""SELECT delivery_id, signing_key_id,
 CASE WHEN signing_key_id = 'k1' THEN 't={_STAMP},v1=' || sha256(unhex('{_OUTER}') || unhex(sha256(unhex('{_INNER}') || encode('{_STAMP}.' || body)))) END AS signature,
 CASE WHEN signing_key_id <> 'k1' THEN 'signing_key_id ''' || signing_key_id || ''' not registered' END AS send_error FROM requests"""


@register("sign_requests", W + ", " + _REQUESTS + " " + _SIGNED_SQL)
def _(t: Tables):
    return t.signed().select("delivery_id", "signing_key_id", "signature", "send_error")


@register(
    "verify_signatures",
    W + ", " + _REQUESTS + " SELECT delivery_id, delivery_id % 3 <> 0 AS valid FROM requests WHERE signing_key_id = 'k1'",
)
def _(t: Tables):
    keys = requests.key_table(t.spark, KEYS)
    sent = t.signed().filter(F.col("signature").isNotNull())
    tampered = F.when(F.col("delivery_id") % 3 == 0, F.concat("body", F.lit(" "))).otherwise(
        F.col("body")
    )
    log = sent.select("delivery_id", "signing_key_id", "signature", tampered.alias("body"))
    return requests.verify_signatures(log, keys, "2024-02-01 00:05:00", 300).select(
        "delivery_id", "valid"
    )


@register("classify_attempts", W + "SELECT delivery_id, result, error FROM outcomes")
def _(t: Tables):
    return dispatch.classify_attempts(t.targeted_attempts()).select(
        "delivery_id", "result", "error"
    )


@register(
    "retry_schedule",
    W + "SELECT delivery_id, attempt, after_s AS retry_after_seconds, delay_s AS delay_seconds, next_at AS next_available_at FROM outcomes",
)
def _(t: Tables):
    return dispatch.retry_schedule(t.targeted_attempts(), AS_OF, "none").select(
        "delivery_id", "attempt", "retry_after_seconds", "delay_seconds", "next_available_at"
    )


_SUCCESS = {
    "dispatched_at": NOW,
    "processed_at": f"CASE WHEN mode0 = 'managed' THEN {NOW} ELSE processed_at END",
    "locked_until": "CAST(NULL AS TIMESTAMP)",
}
_FAILURE = {
    "last_error": "error",
    "available_at": "next_at",
    "dead_letter": "exhausted",
    "locked_until": "CAST(NULL AS TIMESTAMP)",
}


@register("apply_success", W + _changed(_SUCCESS, f"{_CHECKED} x WHERE spec_error IS NULL"))
def _(t: Tables):
    return dispatch.apply_success(t.ready(), AS_OF)


@register("apply_failure", W + _changed(_FAILURE, "outcomes WHERE result <> 'ok'"))
def _(t: Tables):
    timed = dispatch.retry_schedule(
        dispatch.classify_attempts(t.targeted_attempts()), AS_OF, "none"
    ).withColumn("exhausted", F.col("attempt") >= F.col("target.max_attempts"))
    return dispatch.apply_failure(timed.filter(F.col("result") != dispatch.OK))


_APPLIED = {
    **_SUCCESS,
    **{k: f"CASE WHEN result = 'ok' THEN {_SUCCESS.get(k, k)} ELSE {_FAILURE.get(k, k)} END" for k in {**_SUCCESS, **_FAILURE}},
    "attempts": "attempts + 1",
    "last_attempt_at": NOW,
}


@register("apply_attempts", W + _changed(_APPLIED, "log"))
def _(t: Tables):
    return t.dispatched().changed


@register(
    "apply_attempts_log",
    W + """SELECT delivery_id, event_id, callback_name, mode0 AS completion_mode, key_id AS signing_key_id, attempt, started_at, result, error,
 CASE WHEN result NOT IN ('ok', 'timeout') THEN after_s END AS retry_after_seconds, CASE WHEN result <> 'ok' THEN next_at END AS next_available_at,
 result <> 'ok' AND exhausted AS dead_letter, duration_seconds FROM log""",
)
def _(t: Tables):
    return t.dispatched().log


@register(
    "merge_deliveries",
    W + f", changed AS ({_changed(_APPLIED, 'log')}) SELECT {D} FROM changed UNION ALL "
    f"SELECT {D} FROM outbox_deliveries WHERE id NOT IN (SELECT id FROM changed)",
)
def _(t: Tables):
    return merge_deliveries(t.deliveries, t.dispatched().changed)


_REFUSED = f"""refused AS (SELECT c.*, c.attempts + 1 AS attempt FROM {_CHECKED} c
 WHERE spec_error IS NULL AND key_id <> 'k1')"""


def _refused(t: Tables) -> DataFrame:
    """The log rows of due requests whose signing key is not known."""
    outcomes = dispatch.all_outcomes(t.signed(), t.attempts, AS_OF)
    log = dispatch.apply_attempts(t.ready(), outcomes, WHOLE, AS_OF).log
    return log.filter(F.col("signing_key_id") != "k1")


@register(
    "refused_attempts",
    W + ", " + _REFUSED + f""" SELECT id AS delivery_id, callback_name, key_id AS signing_key_id, attempt, 'transient' AS result,
 'signing_key_id ''' || key_id || ''' not registered' AS error,
 {NOW} + to_seconds(coalesce(backoff[greatest(attempt, 1)], backoff[-1], 60)) AS next_available_at, attempt >= max_attempts AS dead_letter FROM refused""",
)
def _(t: Tables):
    return _refused(t).select(
        "delivery_id", "callback_name", "signing_key_id", "attempt", "result", "error", "next_available_at", "dead_letter"
    )


@register(
    "alert_signing_key",
    W + ", " + _REFUSED + f""" SELECT 'signing_key_drift' AS alert, {NOW} - to_minutes(k) AS window_start,
 {NOW} - to_minutes(k) + INTERVAL 5 MINUTE AS window_end, count(*) AS occurrences FROM refused CROSS JOIN range(5) o(k) GROUP BY ALL""",
)
def _(t: Tables):
    return alerts.rate_alerts(alerts.occurrences(_refused(t), alerts.KEY_DRIFT, F.col("started_at")))


@register(
    "with_delivery_fn",
    W + ", " + _REQUESTS + " SELECT delivery_id, CAST(200 + delivery_id % 2 * 303 AS INTEGER) AS status_code, CAST(NULL AS VARCHAR) AS failure_kind FROM requests",
)
def _(t: Tables):
    schema = "delivery_id bigint, status_code int, failure_kind string"

    def deliver(batches):
        for batch in batches:
            out = batch[["delivery_id"]].copy()
            out["status_code"] = (200 + (batch["delivery_id"] % 2) * 303).astype("int32")
            out["failure_kind"] = None
            yield out

    return dispatch.with_delivery_fn(
        requests.render_requests(t.ready()).select("delivery_id", "body"), deliver, schema, WHOLE
    )


# --- External completion -------------------------------------------------------------


@register("hung_external", W + "SELECT id AS delivery_id, event_id, timeout_s AS timeout_seconds, max_cycles FROM hung")
def _(t: Tables):
    return external.hung_external(t.events, t.deliveries, WHOLE, AS_OF).select(
        F.col("delivery.id").alias("delivery_id"), "event_id", "timeout_seconds", "max_cycles"
    )


_OUT = "completion_cycles + 1 >= max_cycles"


@register(
    "sweep_external",
    W + _changed(
        {
            "completion_cycles": "completion_cycles + 1",
            "dispatched_at": f"CASE WHEN {_OUT} THEN dispatched_at END",
            "available_at": f"CASE WHEN {_OUT} THEN available_at ELSE {NOW} END",
            "attempts": f"CASE WHEN {_OUT} THEN attempts ELSE 0 END",
            "last_error": f"CASE WHEN {_OUT} THEN 'external_completion_cycles_exhausted' END",
            "dead_letter": _OUT,
            "locked_until": "CAST(NULL AS TIMESTAMP)",
        },
        "hung",
    ),
)
def _(t: Tables):
    return external.sweep_external(t.events, t.deliveries, WHOLE, AS_OF).changed


@register(
    "sweep_report",
    W + f"SELECT callback_name, count(*) FILTER (WHERE NOT {_OUT}) AS reset, count(*) FILTER (WHERE {_OUT}) AS exhausted FROM hung GROUP BY 1",
)
def _(t: Tables):
    return external.sweep_external(t.events, t.deliveries, WHOLE, AS_OF).report


# --- Operator reads ------------------------------------------------------------------


@register(
    "dead_letters",
    W + """SELECT d.id AS delivery_id, event_id, e.kind AS event_kind, d.callback_name, d.completion_mode, d.attempts, d.last_error, d.last_attempt_at, d.created_at
 FROM outbox_deliveries d JOIN outbox_events e USING (event_id) WHERE d.dead_letter ORDER BY d.id DESC LIMIT 50""",
)
def _(t: Tables):
    return reads.dead_letters(t.events, t.deliveries, Page())


@register(
    "external_pending",
    W + f"""SELECT d.id AS delivery_id, event_id, e.kind AS event_kind, d.callback_name, d.attempts, d.dispatched_at, d.created_at
 FROM outbox_deliveries d JOIN outbox_events e USING (event_id) WHERE {oracle.WAITING} AND epoch({NOW} - d.dispatched_at) > 86400 ORDER BY d.id DESC LIMIT 200""",
)
def _(t: Tables):
    return reads.external_pending(t.events, t.deliveries, Page(limit=500), AS_OF, 86400)


@register(
    "dead_letters_next_cursor",
    W + "SELECT min(id) AS next_cursor FROM (SELECT d.id FROM outbox_deliveries d WHERE d.dead_letter ORDER BY d.id DESC LIMIT 50) x",
)
def _(t: Tables):
    page = Page()
    return reads.next_cursor(reads.dead_letters(t.events, t.deliveries, page), page)


_DETAIL = ", ".join(f"e.{c}" for c in E.split(", ") if c != "event_id")
_DETAIL_D = ", ".join(
    f"d.{c}" if c == "callback_name" else f"d.{c} AS delivery_{c}" for c in D.split(", ") if c != "event_id"
)


@register("event_detail", W + f"SELECT event_id, {_DETAIL}, {_DETAIL_D} FROM outbox_events e LEFT JOIN outbox_deliveries d USING (event_id)")
def _(t: Tables):
    return reads.event_detail(t.events, t.deliveries)


_TOTALS = f"""SELECT (SELECT count(*) FROM outbox_events) AS events_total, count(*) FILTER (WHERE {oracle.PENDING}) AS deliveries_pending,
 count(*) FILTER (WHERE {oracle.WAITING}) AS deliveries_external_pending, count(*) FILTER (WHERE dead_letter) AS deliveries_dead_lettered,
 epoch({NOW} - min(e.created_at) FILTER (WHERE {oracle.PENDING})) AS oldest_pending_age_seconds
 FROM outbox_deliveries d JOIN outbox_events e USING (event_id)"""


@register("stats_totals", W + _TOTALS)
def _(t: Tables):
    return reads.stats_totals(t.events, t.deliveries, AS_OF)


_BY_CALLBACK = f"""SELECT callback_name, count(*) FILTER (WHERE completion_mode = 'managed' AND {oracle.PENDING}) AS pending_managed,
 count(*) FILTER (WHERE completion_mode = 'external' AND {oracle.PENDING}) AS pending_external,
 count(*) FILTER (WHERE {oracle.WAITING}) AS external_pending, count(*) FILTER (WHERE dead_letter) AS dead_lettered FROM outbox_deliveries GROUP BY 1"""


@register("stats_by_callback", W + _BY_CALLBACK)
def _(t: Tables):
    return reads.stats_by_callback(t.deliveries)


_AGE_ROWS = f"SELECT callback_name, epoch({NOW} - dispatched_at) AS age_seconds FROM outbox_deliveries WHERE {oracle.WAITING}"


@register("external_pending_ages", W + _AGE_ROWS)
def _(t: Tables):
    return reads.external_pending_ages(t.deliveries, WHOLE, AS_OF)


@register("external_pending_ages_sample", W + _AGE_ROWS + " ORDER BY dispatched_at, id LIMIT 1000")
def _(t: Tables):
    return reads.external_pending_ages(t.deliveries, BATCH, AS_OF)


# --- Operator commands ---------------------------------------------------------------

_UNLOCKED = f"(locked_until IS NULL OR locked_until < {NOW})"
_RETRY = {
    "attempts": "0",
    "last_error": "CAST(NULL AS VARCHAR)",
    "available_at": NOW,
    "dispatched_at": "CAST(NULL AS TIMESTAMP)",
    "processed_at": "CAST(NULL AS TIMESTAMP)",
    "completion_cycles": "0",
    "dead_letter": "false",
    "locked_until": "CAST(NULL AS TIMESTAMP)",
}
_IDS = "id IN (SELECT delivery_id FROM commands)"
_RETRIED = _changed(_RETRY, f"outbox_deliveries WHERE {_IDS} AND {_UNLOCKED}")
_COMPLETE = {"processed_at": f"coalesce(processed_at, {NOW})"}
_ABANDON = {"dead_letter": "true", "last_error": "'abandoned by operator'"}


def _by_action(changes: dict[str, str], action: str, extra: str = "") -> str:
    source = f"outbox_deliveries WHERE id IN (SELECT delivery_id FROM commands WHERE action = '{action}'){extra}"
    return _changed(changes, source)


@register("retry_deliveries", W + _RETRIED)
def _(t: Tables):
    return commands.retry_deliveries(t.deliveries, t.commands, AS_OF).changed


@register("complete_deliveries", W + _changed(_COMPLETE, f"outbox_deliveries WHERE {_IDS}"))
def _(t: Tables):
    return commands.complete_deliveries(t.deliveries, t.commands, AS_OF).changed


@register("abandon_deliveries", W + _changed(_ABANDON, f"outbox_deliveries WHERE {_IDS}"))
def _(t: Tables):
    return commands.abandon_deliveries(t.deliveries, t.commands, AS_OF).changed


@register(
    "apply_commands",
    W + _by_action(_RETRY, "retry", f" AND {_UNLOCKED}") + " UNION ALL " + _by_action(_COMPLETE, "complete")
    + " UNION ALL " + _by_action(_ABANDON, "abandon"),
)
def _(t: Tables):
    return commands.apply_commands(t.deliveries, t.commands, AS_OF).changed


@register(
    "apply_commands_outcomes",
    W + f"""SELECT c.delivery_id, c.seq, c.action, CASE WHEN d.id IS NULL THEN 'not_found' WHEN c.action <> 'retry' THEN 'ok'
 WHEN {_UNLOCKED} THEN 'reset' ELSE 'locked' END AS outcome FROM commands c LEFT JOIN outbox_deliveries d ON d.id = c.delivery_id""",
)
def _(t: Tables):
    return commands.apply_commands(t.deliveries, t.commands, AS_OF).outcomes


# --- Retention -----------------------------------------------------------------------

_DOOMED = "doomed AS (SELECT * FROM terminal ORDER BY id LIMIT 1000)"


def _retained(t: Tables, limit: int | None) -> retention.RetentionResult:
    return retention.apply_retention(t.events, t.deliveries, CUTOFFS, limit)


@register("terminal_events", W + "SELECT * FROM terminal")
def _(t: Tables):
    return retention.terminal_events(t.events, t.deliveries, CUTOFFS)


@register("apply_retention", W + f"SELECT {E} FROM outbox_events WHERE id NOT IN (SELECT id FROM terminal)")
def _(t: Tables):
    return _retained(t, None).events


@register("apply_retention_deliveries", W + f"SELECT {D} FROM outbox_deliveries WHERE event_id NOT IN (SELECT event_id FROM terminal)")
def _(t: Tables):
    return _retained(t, None).deliveries


@register("apply_retention_batch", W + f", {_DOOMED} SELECT {E} FROM outbox_events WHERE id NOT IN (SELECT id FROM doomed)")
def _(t: Tables):
    return _retained(t, 1000).events


_OLDEST = f"SELECT epoch({NOW} - min(created_at)) AS age_seconds FROM terminal"


@register("oldest_terminal_age", W + _OLDEST)
def _(t: Tables):
    return retention.oldest_terminal_age(t.events, t.deliveries, CUTOFFS, AS_OF)


# --- Metrics -------------------------------------------------------------------------


@register("m_events_total", V + "SELECT kind, count(*) AS value FROM varied_events JOIN branches USING (id) WHERE branch = 'checked' GROUP BY 1")
def _(t: Tables):
    return metrics.m_events_total(t.varied, WHOLE)


_LOG_LABELS = "callback_name AS callback, mode0 AS mode"


@register("m_deliveries_total", W + f"SELECT {_LOG_LABELS}, result, count(*) AS value FROM log GROUP BY ALL")
def _(t: Tables):
    return metrics.m_deliveries_total(t.dispatched().log)


@register(
    "m_dispatch_duration",
    W + oracle.histogram(f"SELECT {_LOG_LABELS}, duration_seconds FROM log", "duration_seconds", "callback, mode", oracle.DURATIONS),
)
def _(t: Tables):
    return metrics.m_dispatch_duration(t.dispatched().log)


@register("m_lag_seconds", W + f"SELECT coalesce(oldest_pending_age_seconds, 'nan'::DOUBLE) AS value FROM ({_TOTALS}) x")
def _(t: Tables):
    return metrics.m_lag_seconds(reads.stats_totals(t.events, t.deliveries, AS_OF))


@register(
    "m_pending",
    W + f"""SELECT callback_name AS callback, 'managed' AS mode, pending_managed AS value FROM ({_BY_CALLBACK}) x
 UNION ALL SELECT callback_name, 'external', pending_external FROM ({_BY_CALLBACK}) y""",
)
def _(t: Tables):
    return metrics.m_pending(reads.stats_by_callback(t.deliveries))


@register("m_external_pending", W + f"SELECT callback_name AS callback, external_pending AS value FROM ({_BY_CALLBACK}) x")
def _(t: Tables):
    return metrics.m_external_pending(reads.stats_by_callback(t.deliveries))


@register(
    "m_external_pending_seconds",
    W + oracle.histogram(_AGE_ROWS.replace("callback_name,", "callback_name AS callback,"), "age_seconds", "callback", oracle.AGES),
)
def _(t: Tables):
    return metrics.m_external_pending_seconds(reads.external_pending_ages(t.deliveries, WHOLE, AS_OF))


@register("m_dead_letters_total", W + "SELECT callback_name AS callback, count(*) AS value FROM log WHERE result <> 'ok' AND exhausted GROUP BY 1")
def _(t: Tables):
    return metrics.m_dead_letters_total(t.dispatched().log)


def _total(condition: str) -> str:
    return f"""SELECT callback_name AS callback, count(*) FILTER (WHERE {condition}) AS value FROM hung GROUP BY 1
 UNION ALL SELECT '_all', count(*) FILTER (WHERE {condition}) FROM hung"""


@register("m_timeout_resets_total", W + _total(f"NOT {_OUT}"))
def _(t: Tables):
    return metrics.m_timeout_resets_total(external.sweep_external(t.events, t.deliveries, WHOLE, AS_OF).report)


@register("m_cycles_exhausted_total", W + _total(_OUT))
def _(t: Tables):
    return metrics.m_cycles_exhausted_total(external.sweep_external(t.events, t.deliveries, WHOLE, AS_OF).report)


@register(
    "m_signing_key_failures",
    W + ", " + _REQUESTS + " SELECT signing_key_id, callback_name AS callback, count(*) AS value FROM requests WHERE signing_key_id <> 'k1' GROUP BY ALL",
)
def _(t: Tables):
    return metrics.m_signing_key_failures(t.signed())


@register("m_invalid_callbacks_total", V + "SELECT reason, count(*) AS value FROM judged WHERE reason IS NOT NULL GROUP BY 1")
def _(t: Tables):
    return metrics.m_invalid_callbacks_total(schedule.rejects(t.spread_varied, WHOLE))


@register("m_payload_rejections_total", W + "SELECT kind, count(*) AS value FROM arrays WHERE size > 1024 GROUP BY 1")
def _(t: Tables):
    return metrics.m_payload_rejections_total(t.events, WHOLE)


@register("m_retention_deletions_total", W + "SELECT reason, count(*) AS value FROM terminal GROUP BY 1")
def _(t: Tables):
    return metrics.m_retention_deletions_total(_retained(t, None).report)


@register("m_oldest_retention_age", W + f", {_DOOMED} SELECT coalesce(epoch({NOW} - min(created_at)), 'nan'::DOUBLE) AS value FROM terminal WHERE id NOT IN (SELECT id FROM doomed)")
def _(t: Tables):
    left = _retained(t, 1000)
    age = retention.oldest_terminal_age(left.events, left.deliveries, CUTOFFS, AS_OF)
    return metrics.m_oldest_retention_age(age)


@register("m_corrupted_rows_total", V + "SELECT 'schedule' AS stage, count(*) AS value FROM arrays WHERE n IS NULL AND size <= 1024")
def _(t: Tables):
    return metrics.m_corrupted_rows_total(fanout.corrupt_events(t.varied, WHOLE))


def _run_log(t: Tables) -> DataFrame:
    """Attempts read as cycle runs: one per minute of the log."""
    minute = F.date_trunc("minute", "started_at")
    return t.attempts.groupBy(minute.cast("timestamp_ntz").alias("started_at")).agg(
        (F.count("*") / 100).alias("duration_seconds"), F.lit("scheduler").alias("worker")
    )


_RUNS = "runs AS (SELECT date_trunc('minute', started_at) AS started_at, count(*) / 100 AS duration_seconds, 'scheduler' AS worker FROM attempts GROUP BY 1)"


@register("m_cycle_duration", W + ", " + _RUNS + " " + oracle.histogram("SELECT * FROM runs", "duration_seconds", "worker", oracle.DURATIONS))
def _(t: Tables):
    return metrics.m_cycle_duration(_run_log(t))


@register(
    "zero_fill_gauges",
    W + f""", now_rows AS (SELECT callback_name AS callback, count(*) AS value FROM outbox_deliveries WHERE {oracle.DUE} AND callback_name = 'send_email' GROUP BY 1),
 old_rows AS (SELECT callback_name AS callback, count(*) AS value FROM outbox_deliveries WHERE {oracle.PENDING} GROUP BY 1)
 SELECT callback, value FROM now_rows UNION ALL SELECT callback, 0 FROM old_rows WHERE callback NOT IN (SELECT callback FROM now_rows)""",
)
def _(t: Tables):
    def gauge(rows: DataFrame) -> DataFrame:
        return rows.groupBy(F.col("callback_name").alias("callback")).agg(
            F.count("*").alias("value")
        )

    states = dispatch.states
    now = dispatch.times.like(t.deliveries, "available_at", AS_OF)
    due = t.deliveries.filter(states.is_due(now) & (F.col("callback_name") == "send_email"))
    return metrics.zero_fill_gauges(
        gauge(t.deliveries.filter(states.is_pending())), gauge(due), ["callback"]
    )


_ALERT_ROWS = """SELECT 'dead_letters_accumulating' AS alert, started_at AS happened FROM log WHERE result <> 'ok' AND exhausted
 UNION ALL SELECT 'corrupted_rows', created_at FROM arrays WHERE n IS NULL AND size <= 1024"""


@register(
    "alerts",
    V + f""", slid AS (SELECT alert, date_trunc('minute', happened) - to_minutes(k) AS window_start FROM ({_ALERT_ROWS}) r CROSS JOIN range(5) o(k))
 SELECT alert, window_start, window_start + INTERVAL 5 MINUTE AS window_end, count(*) AS occurrences FROM slid GROUP BY ALL""",
)
def _(t: Tables):
    log = _varied_log(t).filter("dead_letter")
    corrupt = fanout.corrupt_events(t.varied, WHOLE)
    both = alerts.occurrences(log, alerts.DEAD_LETTERS, F.col("started_at")).unionByName(
        alerts.occurrences(corrupt, alerts.CORRUPT_ROWS, F.col("created_at"))
    )
    return alerts.rate_alerts(both)


def _varied_log(t: Tables) -> DataFrame:
    due = dispatch.due_deliveries(t.varied, t.deliveries, WHOLE, AS_OF)
    ready = dispatch.revalidate_due(due, WHOLE)[0]
    return dispatch.apply_attempts(ready, t.attempts, WHOLE, AS_OF).log


@register("alert_lag", W + f"SELECT 'high_dispatch_lag' AS alert, oldest_pending_age_seconds AS lag_seconds FROM ({_TOTALS}) x WHERE oldest_pending_age_seconds > 300")
def _(t: Tables):
    return alerts.lag_alert(reads.stats_totals(t.events, t.deliveries, AS_OF))


@register(
    "alert_stalled",
    W + ", " + _RUNS + """ SELECT 'scheduler_stalled' AS alert, TIMESTAMP '1970-01-01' + to_minutes(m) AS window_start, TIMESTAMP '1970-01-01' + to_minutes(m + 1) AS window_end
 FROM range(epoch(TIMESTAMP '2024-01-01')::BIGINT // 60, epoch(TIMESTAMP '2024-02-01')::BIGINT // 60) g(m)
 WHERE m NOT IN (SELECT CAST(floor(epoch_us(started_at + to_microseconds(CAST(duration_seconds * 1000000 AS BIGINT))) / 60000000) AS BIGINT) FROM runs)""",
)
def _(t: Tables):
    return alerts.stalled_windows(_run_log(t), "2024-01-01", "2024-02-01")


# --- Streams -------------------------------------------------------------------------


def _stream(t: Tables) -> DataFrame:
    """The given events as a file stream."""
    schema = t.base.schema
    return t.spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(
        t.sf_dir
    )


def _sink(t: Tables) -> streams.DeliverySink:
    return streams.DeliverySink(t.spark, fresh_path(t.spark, "deliveries"), t.deliveries)


def _scheduled_stream(t: Tables, sink: streams.DeliverySink, where: str = "true") -> None:
    events = fixtures.derive_from(_stream(t), "outbox_events").where(where)
    state = fresh_path(t.spark, "schedule-state")
    streams.run_schedule(events, sink, WHOLE, state, AS_OF).awaitTermination()


@register("stream_schedule", W + oracle.scheduled())
def _(t: Tables):
    sink = _sink(t)
    _scheduled_stream(t, sink)
    return sink.new_rows()


# The stream missed the events of an outage, and a rescan from its start makes up for them.
_MISSED = "created_at >= TIMESTAMP_NTZ '2024-01-15 00:00:00' AND created_at < TIMESTAMP_NTZ '2024-01-18 00:00:00'"
_MISSED_SEQ = f"seq IN (SELECT id FROM outbox_events WHERE {_MISSED.replace('TIMESTAMP_NTZ', 'TIMESTAMP')})"


@register(
    "stream_rescan",
    W + ", streamed AS (" + oracle.scheduled(where=f"NOT {_MISSED_SEQ}") + ") "
    + oracle.scheduled(cursor=_START, highest="(SELECT max(id) FROM streamed)", where=_MISSED_SEQ),
)
def _(t: Tables):
    sink = _sink(t)
    _scheduled_stream(t, sink, f"NOT ({_MISSED})")
    return streams.stream_rescan(t.spread_events, sink, WHOLE, AS_OF, SINCE)


#: Micro-batches that the streams below are cut into, none in the order of the events.
_BATCHES = 6


def _scattered(t: Tables) -> DataFrame:
    """The given events as a stream of files, each with events of all times, one per core in a batch."""
    path, files = fresh_path(t.spark, "scattered"), t.spark.sparkContext.defaultParallelism
    t.base.repartition(_BATCHES * files, F.xxhash64("event_id")).write.parquet(path)
    return t.spark.readStream.schema(t.base.schema).option("maxFilesPerTrigger", files).parquet(path)


@register(
    "stream_dedupe",
    V + """SELECT id, event_id, label, CAST(pos AS INTEGER) AS pos, NOT valid AS dead_letter FROM judged
 QUALIFY row_number() OVER (PARTITION BY event_id, label ORDER BY valid DESC, pos) = 1""",
)
def _(t: Tables):
    t.spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    events = fixtures.derive_from(_scattered(t), "varied_events")
    replayed = events.unionByName(fixtures.derive_from(_scattered(t), "varied_events"))
    return streams.run_to_table(streams.stream_dedupe(replayed, WHOLE), "dedupe", idle_batches=False)


@register("run_log", f"SELECT 'metrics' AS worker, CAST(k AS BIGINT) AS batch_id, true AS timed FROM range({_BATCHES}) b(k)")
def _(t: Tables):
    """The log of a stream that reads the events in as many micro-batches as there are files."""
    log = RunLog(t.spark, fresh_path(t.spark, "run-log"))
    t.spark.streams.addListener(log)
    try:
        rows = streams.stream_metrics(fixtures.derive_from(_scattered(t), "varied_events"), WHOLE)
        sink = streams.metrics_sink(t.spark, fresh_path(t.spark, "metrics"))
        query = streams.run_counts(rows, sink, fresh_path(t.spark, "counts-state"), name="metrics")
        query.awaitTermination()
        log.settled(query)
    finally:
        t.spark.streams.removeListener(log)
    return log.rows().select("worker", "batch_id", (F.col("duration_seconds") > 0).alias("timed"))


def _counted(t: Tables, rows: DataFrame, sink: streams.CountSink) -> DataFrame:
    streams.run_counts(rows, sink, fresh_path(t.spark, "counts-state")).awaitTermination()
    totals = sink.totals()
    return totals.select(*[F.col(n).cast("timestamp_ntz").alias(n) if k == "timestamp" else n for n, k in totals.dtypes])


@register(
    "stream_metrics",
    V + """SELECT kind, branch, minute, count(*) AS value FROM (SELECT kind, branch, date_trunc('minute', created_at) AS minute
 FROM varied_events JOIN branches USING (id)) m GROUP BY 1, 2, 3""",
)
def _(t: Tables):
    rows = streams.stream_metrics(fixtures.derive_from(_scattered(t), "varied_events"), WHOLE)
    return _counted(t, rows, streams.metrics_sink(t.spark, fresh_path(t.spark, "metrics")))


@register(
    "stream_alerts",
    V + """, rows AS (SELECT created_at AS happened FROM arrays WHERE n IS NULL AND size <= 1024),
 slid AS (SELECT 'corrupted_rows' AS alert, date_trunc('minute', happened) - to_minutes(k) AS window_start FROM rows CROSS JOIN range(5) o(k))
 SELECT alert, window_start, window_start + INTERVAL 5 MINUTE AS window_end, count(*) AS occurrences FROM slid GROUP BY ALL""",
)
def _(t: Tables):
    corrupt = fanout.corrupt_events(fixtures.derive_from(_scattered(t), "varied_events"), WHOLE)
    rows = alerts.occurrences(corrupt, alerts.CORRUPT_ROWS, F.col("created_at"))
    return _counted(t, streams.stream_alerts(rows), streams.alerts_sink(t.spark, fresh_path(t.spark, "alerts")))


def _messages(t: Tables) -> DataFrame:
    """Two messages per event: scheduled, then an attempt, a command for every 11th. None in order."""
    return _scattered(t).selectExpr(
        "event_id + 1 AS delivery_id",
        "event_id AS seq",
        "CAST(ts AS TIMESTAMP) AS at",
        "inline(array("
        "named_struct('type', 'scheduled', 'order', 0, 'result', CAST(NULL AS STRING), 'error', CAST(NULL AS STRING), 'action', CAST(NULL AS STRING)),"
        "named_struct('type', 'attempt', 'order', 1, 'result', CASE WHEN event_id % 3 = 0 THEN 'transient' ELSE 'ok' END,"
        " 'error', CASE WHEN event_id % 3 = 0 THEN 'returned 503' END, 'action', CAST(NULL AS STRING)),"
        "named_struct('type', 'command', 'order', 2, 'result', CAST(NULL AS STRING), 'error', CAST(NULL AS STRING), 'action',"
        " CASE WHEN event_id % 11 = 0 THEN 'complete' WHEN event_id % 11 = 1 THEN 'abandon' END)))",
    ).filter("type <> 'command' OR action IS NOT NULL").selectExpr(
        "delivery_id",
        "seq * 3 + order AS seq",
        "at",
        "type",
        "CASE WHEN delivery_id % 2 = 0 THEN 'external' ELSE 'managed' END AS mode",
        "6 AS max_attempts",
        "3600L AS external_timeout_seconds",
        "CAST(1 + delivery_id % 2 AS INT) AS max_cycles",
        "result",
        "error",
        "action",
    )


_LIFECYCLE = """ SELECT delivery_id, cause, state, attempts, completion_cycles, dead_letter, last_error FROM (
 SELECT event_id + 1 AS delivery_id, event_id % 3 = 0 AS failed, (event_id + 1) % 2 = 0 AS ext, event_id % 11 AS k, ts FROM events) m,
 LATERAL (SELECT 0 AS step, 'scheduled' AS cause, 'pending' AS state, 0 AS attempts, 0 AS completion_cycles, false AS dead_letter, CAST(NULL AS VARCHAR) AS last_error
  UNION ALL SELECT 1, 'attempt', CASE WHEN failed THEN 'pending' WHEN ext THEN 'external_pending' ELSE 'processed' END, 1, 0, false, CASE WHEN failed THEN 'returned 503' END
  UNION ALL SELECT 2, CASE WHEN k = 0 THEN 'complete' ELSE 'abandon' END, CASE WHEN k = 0 THEN 'processed' ELSE 'dead' END, 1, 0, k = 1,
   CASE WHEN k = 1 THEN 'abandoned by operator' WHEN failed THEN 'returned 503' END WHERE k IN (0, 1)
  UNION ALL SELECT 3, 'timer', 'dead', 1, 1, true, 'external_completion_cycles_exhausted'
   WHERE ext AND NOT failed AND k NOT IN (0, 1) AND epoch_ms(ts) + 3600000 < (SELECT max(epoch_ms(ts)) FROM events) - 60000) s
 QUALIFY row_number() OVER (PARTITION BY delivery_id ORDER BY step DESC) = 1"""


def _lifecycle(t: Tables) -> DataFrame:
    """The state each delivery ends in."""
    t.spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    out = streams.run_to_table(lifecycle.stream_lifecycle(_messages(t)), "lifecycle")
    return lifecycle.current(out).select(
        "delivery_id", "cause", "state", "attempts", "completion_cycles", "dead_letter", "last_error"
    )


@register("stream_lifecycle", _LIFECYCLE)
def _(t: Tables):
    return _lifecycle(t)


@register("stream_external_timeout", f"SELECT * FROM ({_LIFECYCLE}) x WHERE cause = 'timer'")
def _(t: Tables):
    return _lifecycle(t).filter(F.col("cause") == lifecycle.EXPIRED)
