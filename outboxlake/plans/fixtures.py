"""Outbox tables derived from the given ``events`` table.

The SQL runs in Spark and, with two type names swapped, in DuckDB.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

AS_OF = "2024-02-01 00:00:00"
PAYLOAD_LIMIT = 1024

OUTBOX_EVENTS = """
SELECT event_id + 1 AS id,
 concat('00000000-0000-4000-8000-', lpad(CAST(event_id AS STRING), 12, '0')) AS event_id,
 concat(event_type, '@v1') AS kind, 'user' AS aggregate_type,
 concat('00000000-0000-4000-9000-', lpad(CAST(user_id AS STRING), 12, '0')) AS aggregate_id,
 CASE WHEN event_id % 37 = 0 THEN concat('{"k": 1, "pad": "', repeat('x', 2000), '"}') ELSE props END AS payload,
 '{}' AS metadata,
 CASE event_id % 12
  WHEN 0 THEN '[{"name": "send_email", "url": "https://a.example.com/h", "signing_key_id": "k1"}, {"name": "audit_log", "url": "https://b.example.com/h", "signing_key_id": "k2", "mode": "external", "external_completion_timeout_seconds": 3600, "max_completion_cycles": 3}]'
  WHEN 1 THEN '[{"name": "Bad-Name", "url": "https://a.example.com/h", "signing_key_id": "k1"}, {"name": "send_email", "url": "https://a.example.com/h", "signing_key_id": "k1"}]'
  WHEN 2 THEN '["not_an_object"]'
  WHEN 3 THEN '[{"name": "send_email", "url": "http://a.example.com/h", "signing_key_id": "k1"}]'
  WHEN 4 THEN '[{"name": "send_email", "url": "https://10.0.0.8/h", "signing_key_id": "k1"}]'
  WHEN 5 THEN '[{"name": "send_email", "url": "https://a.example.com/h"}]'
  WHEN 6 THEN '[{"name": "audit_log", "url": "https://b.example.com/h", "signing_key_id": "k2", "mode": "external"}]'
  WHEN 7 THEN '[{"name": "send_email", "url": "https://a.example.com/h", "signing_key_id": "k1"}, {"name": "send_email", "url": "https://c.example.com/h", "signing_key_id": "k1"}]'
  ELSE '[{"name": "send_email", "url": "https://a.example.com/h", "signing_key_id": "k1"}, {"name": "push_notif", "url": "https://p.example.com/h", "signing_key_id": "k1", "max_attempts": 3, "backoff_seconds": [10, 20]}]' END AS callbacks,
 CASE WHEN event_id % 3 = 0 THEN NULL ELSE concat('00000000-0000-4000-9000-', lpad(CAST(user_id AS STRING), 12, '0')) END AS actor_id,
 CASE WHEN event_id % 5 = 0 THEN NULL ELSE concat('00000000-0000-4000-a000-', lpad(CAST(event_id - event_id % 4 AS STRING), 12, '0')) END AS correlation_id,
 CASE WHEN event_id % 4 = 0 THEN NULL ELSE concat('00000000-0000-4000-8000-', lpad(CAST(event_id - 1 AS STRING), 12, '0')) END AS causation_id,
 ts AS created_at
FROM events
"""

OUTBOX_DELIVERIES = """
SELECT e.event_id * 2 + p.pos + 1 AS id,
 concat('00000000-0000-4000-8000-', lpad(CAST(e.event_id AS STRING), 12, '0')) AS event_id,
 CASE WHEN p.pos = 0 THEN 'send_email' ELSE 'audit_log' END AS callback_name,
 CASE WHEN p.pos = 0 THEN 'managed' ELSE 'external' END AS completion_mode,
 CAST((e.event_id + p.pos) % 7 AS INT) AS attempts,
 CASE WHEN (e.event_id + p.pos) % 10 IN (2, 3) THEN 'POST https://a.example.com/h returned 503'
      WHEN (e.event_id + p.pos) % 10 = 9 THEN 'invalid_callback: missing required field ''url''' END AS last_error,
 CASE WHEN (e.event_id + p.pos) % 7 > 0 THEN e.ts + INTERVAL 1 MINUTE END AS last_attempt_at,
 CASE WHEN (e.event_id + p.pos) % 10 = 1 THEN e.ts + INTERVAL 30 DAY ELSE e.ts END AS available_at,
 CASE WHEN (e.event_id + p.pos) % 10 = 2 THEN TIMESTAMP_NTZ '2024-02-15 00:00:00'
      WHEN (e.event_id + p.pos) % 10 = 3 THEN TIMESTAMP_NTZ '2024-01-01 00:00:00' END AS locked_until,
 CASE WHEN (e.event_id + p.pos) % 10 IN (4, 5, 6, 7, 8) THEN e.ts + INTERVAL 2 MINUTE END AS dispatched_at,
 CASE WHEN (e.event_id + p.pos) % 10 IN (6, 7, 8) OR (p.pos = 0 AND (e.event_id + p.pos) % 10 IN (4, 5))
      THEN e.ts + INTERVAL 3 MINUTE END AS processed_at,
 CAST(CASE WHEN p.pos = 1 THEN e.event_id % 7 % 4 ELSE 0 END AS INT) AS completion_cycles,
 ((e.event_id + p.pos) % 10 = 9) AS dead_letter,
 e.ts AS created_at
FROM events e CROSS JOIN (SELECT 0 AS pos UNION ALL SELECT 1 AS pos) p
WHERE e.event_id % 6 <> 5
"""

ATTEMPTS = """
SELECT e.event_id * 2 + p.pos + 1 AS delivery_id,
 e.ts + INTERVAL 1 MINUTE AS started_at,
 CASE (e.event_id + p.pos) % 6 WHEN 0 THEN 200 WHEN 1 THEN 503 WHEN 2 THEN 429 WHEN 3 THEN 301 END AS status_code,
 CASE (e.event_id + p.pos) % 6 WHEN 4 THEN 'timeout' WHEN 5 THEN 'connection' END AS failure_kind,
 CASE WHEN (e.event_id + p.pos) % 6 = 5 THEN 'connection refused' END AS error_detail,
 CASE (e.event_id + p.pos) % 6 WHEN 1 THEN 'Thu, 01 Feb 2024 00:10:00 GMT' WHEN 2 THEN '120' END AS retry_after,
 e.value / 20.0 AS duration_seconds
FROM events e CROSS JOIN (SELECT 0 AS pos UNION ALL SELECT 1 AS pos) p
WHERE e.event_id % 6 <> 5
"""

COMMANDS = """
SELECT e.event_id * 2 + 1 AS delivery_id, e.event_id AS seq,
 CASE e.event_id % 3 WHEN 0 THEN 'retry' WHEN 1 THEN 'complete' ELSE 'abandon' END AS action,
 e.ts AS issued_at
FROM events e WHERE e.event_id % 11 = 0
"""

_VARIED = [
    """'{"not": "an_array"}'""",
    """'[]'""",
    """concat('[', repeat('{"name": "many_cb", "url": "https://a.example.com/h", "signing_key_id": "k1"}, ', 32), '{"url": 3}]')""",
    """'[{"name": "<root>"}]'""",
    """'[{"url": "https://a.example.com/h"}, {"name": null}, {"name": 5}, null, 7, [1]]'""",
    """'[{"name": "ab"}, {"name": "abc"}, {"name": "abc_1", "url": 5}, {"name": "1abc"}]'""",
    """'[{"name": "cb_one", "url": "not a url", "signing_key_id": "k1"}, {"name": "cb_two", "url": "https://", "signing_key_id": "k1"}]'""",
    """'[{"name": "cb_one", "url": "https://u:p@a.example.com/", "signing_key_id": "k1"}, {"name": "cb_two", "url": "ftp://a.example.com/", "signing_key_id": "k1"}]'""",
    """'[{"name": "cb_one", "url": "https://127.0.0.1/hook", "signing_key_id": "k1"}, {"name": "cb_two", "url": "https://[::1]/hook", "signing_key_id": "k1"}, {"name": "cb_three", "url": "https://[fd12::9]/", "signing_key_id": "k1"}]'""",
    """'[{"name": "cb_one", "url": "https://localhost./hook", "signing_key_id": "k1"}, {"name": "cb_two", "url": "https://vault.corp.internal/hook", "signing_key_id": "k1"}, {"name": "cb_three", "url": "https://198.51.100.7/", "signing_key_id": "k1"}]'""",
    """'[{"name": "cb_one", "url": "https://a.example.com/", "signing_key_id": "k1", "mode": "later"}, {"name": "cb_two", "url": "https://a.example.com/", "signing_key_id": "k1", "mode": null}, {"name": "cb_three", "url": "https://a.example.com/", "signing_key_id": 5}]'""",
    """'[{"name": "cb_one", "url": "https://a.example.com/", "signing_key_id": "k1", "headers": null}, {"name": "cb_two", "url": "https://a.example.com/", "signing_key_id": "k1", "headers": {"X A": "1"}}, {"name": "cb_three", "url": "https://a.example.com/", "signing_key_id": "k1", "headers": {"A-Ok": "1", "Cookie": "x"}}]'""",
    """'[{"name": "cb_one", "url": "https://a.example.com/", "signing_key_id": "k1", "headers": {"X-Outbox-Z": "1"}}, {"name": "cb_two", "url": "https://a.example.com/", "signing_key_id": "k1", "headers": {"X-A": "1", "x-a": "2"}}, {"name": "cb_three", "url": "https://a.example.com/", "signing_key_id": "k1", "headers": {"X-A": 1}}, {"name": "cb_four", "url": "https://a.example.com/", "signing_key_id": "k1", "headers": {"X-B": "é"}}, {"name": "cb_five", "url": "https://a.example.com/", "signing_key_id": "k1", "headers": {"X-B": "fine", "X-C": "too"}}]'""",
    """'[{"name": "cb_one", "url": "https://a.example.com/", "signing_key_id": "k1", "max_attempts": 0}, {"name": "cb_two", "url": "https://a.example.com/", "signing_key_id": "k1", "max_attempts": 51}, {"name": "cb_three", "url": "https://a.example.com/", "signing_key_id": "k1", "max_attempts": -1}, {"name": "cb_four", "url": "https://a.example.com/", "signing_key_id": "k1", "max_attempts": "3"}, {"name": "cb_five", "url": "https://a.example.com/", "signing_key_id": "k1", "max_attempts": 50}]'""",
    """'[{"name": "cb_one", "url": "https://a.example.com/", "signing_key_id": "k1", "backoff_seconds": 5}, {"name": "cb_two", "url": "https://a.example.com/", "signing_key_id": "k1", "backoff_seconds": []}, {"name": "cb_three", "url": "https://a.example.com/", "signing_key_id": "k1", "backoff_seconds": [5, 0]}, {"name": "cb_four", "url": "https://a.example.com/", "signing_key_id": "k1", "backoff_seconds": [5, "x"]}, {"name": "cb_five", "url": "https://a.example.com/", "signing_key_id": "k1", "backoff_seconds": [604800, 604801]}]'""",
    """'[{"name": "cb_one", "url": "https://a.example.com/", "signing_key_id": "k1", "timeout_seconds": 301}, {"name": "cb_two", "url": "https://a.example.com/", "signing_key_id": "k1", "timeout_seconds": 2.5}, {"name": "cb_three", "url": "https://a.example.com/", "signing_key_id": "k1", "timeout_seconds": 18446744073709551615}, {"name": "cb_four", "url": "https://a.example.com/", "signing_key_id": "k1", "timeout_seconds": 300}]'""",
    """'[{"name": "cb_one", "url": "https://a.example.com/", "signing_key_id": "k1", "external_completion_timeout_seconds": 0}, {"name": "cb_two", "url": "https://a.example.com/", "signing_key_id": "k1", "external_completion_timeout_seconds": null}, {"name": "cb_three", "url": "https://a.example.com/", "signing_key_id": "k1", "max_completion_cycles": 1001}, {"name": "cb_four", "url": "https://a.example.com/", "signing_key_id": "k1", "max_completion_cycles": true}, {"name": "cb_five", "url": "https://a.example.com/", "signing_key_id": "k1", "mode": "external"}]'""",
    """'[{"name": "twin", "url": 5}, {"name": "twin", "url": "https://a.example.com/", "signing_key_id": "k1"}, {"name": "twin", "url": "https://b.example.com/", "signing_key_id": "k1"}, {"name": "twin"}]'""",
]

VARIED_EVENTS = (
    "SELECT o.id, o.event_id, o.kind, o.aggregate_type, o.aggregate_id, o.payload, o.metadata,\n"
    f" CASE (o.id - 1) % {len(_VARIED)}\n"
    + "\n".join(f"  WHEN {i} THEN {text}" for i, text in enumerate(_VARIED))
    + " END AS callbacks,\n o.actor_id, o.correlation_id, o.causation_id, o.created_at\nFROM ("
    + OUTBOX_EVENTS
    + ") o"
)

# Landed events with rows that break each constraint, and copies of some rows.
LANDED_EVENTS = f"""
SELECT o.id, o.event_id, o.kind, o.aggregate_type, o.aggregate_id,
 CASE WHEN o.id % 50 = 1 THEN NULL ELSE o.payload END AS payload, o.metadata,
 CASE o.id % 50 WHEN 2 THEN '{{"a": 1}}' WHEN 3 THEN '[]' WHEN 4 THEN 'broken' ELSE o.callbacks END AS callbacks,
 o.actor_id, o.correlation_id, o.causation_id, o.created_at
FROM ({OUTBOX_EVENTS}) o
UNION ALL
SELECT CASE WHEN o.id % 2 = 0 THEN o.id ELSE o.id + 1000000000 END AS id,
 CASE WHEN o.id % 3 = 0 THEN '00000000-0000-4000-8000-000000000009' ELSE o.event_id END AS event_id,
 o.kind, o.aggregate_type, o.aggregate_id,
 o.payload, o.metadata, o.callbacks, o.actor_id, o.correlation_id, o.causation_id, o.created_at
FROM ({OUTBOX_EVENTS}) o WHERE o.id % 29 = 0 OR o.id % 3 = 0
"""

# Landed deliveries with a bad mode, an unknown event, and copies.
LANDED_DELIVERIES = f"""
SELECT d.id, CASE WHEN d.id % 41 = 0 THEN 'no-such-event' ELSE d.event_id END AS event_id,
 d.callback_name, CASE WHEN d.id % 43 = 0 THEN 'other' ELSE d.completion_mode END AS completion_mode,
 d.attempts, d.last_error, d.last_attempt_at, d.available_at, d.locked_until, d.dispatched_at,
 d.processed_at, d.completion_cycles, d.dead_letter, d.created_at
FROM ({OUTBOX_DELIVERIES}) d
UNION ALL
SELECT d.id + 1000000000 AS id, d.event_id, d.callback_name, d.completion_mode,
 d.attempts, d.last_error, d.last_attempt_at, d.available_at, d.locked_until, d.dispatched_at,
 d.processed_at, d.completion_cycles, d.dead_letter, d.created_at
FROM ({OUTBOX_DELIVERIES}) d WHERE d.id % 31 = 0
"""

TABLES = {
    "varied_events": VARIED_EVENTS,
    "landed_events": LANDED_EVENTS,
    "landed_deliveries": LANDED_DELIVERIES,
    "outbox_events": OUTBOX_EVENTS,
    "outbox_deliveries": OUTBOX_DELIVERIES,
    "attempts": ATTEMPTS,
    "commands": COMMANDS,
}


# In Spark each event is expanded in place instead of joined.
_TWO_ROWS = "CROSS JOIN (SELECT 0 AS pos UNION ALL SELECT 1 AS pos) p"


def derive(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    base = spark.read.parquet(f"{sf_dir}/events.parquet")
    return derive_from(base, table)


def derive_from(base: DataFrame, table: str) -> DataFrame:
    view = f"fixture_{uuid.uuid4().hex}"
    base.createOrReplaceTempView(view)
    sql = TABLES[table].replace(_TWO_ROWS, "LATERAL VIEW explode(array(0, 1)) p AS pos")
    derived = base.sparkSession.sql(sql.replace("FROM events", f"FROM {view}"))
    base.sparkSession.catalog.dropTempView(view)
    return derived


def duckdb_sql(table: str) -> str:
    return TABLES[table].replace("AS STRING", "AS VARCHAR").replace("TIMESTAMP_NTZ '", "TIMESTAMP '")
