"""Table schemas. JSON columns are text and are parsed inside the operators."""

from __future__ import annotations

from pyspark.sql import types as T

EVENTS = T.StructType(
    [
        T.StructField("id", T.LongType(), False),
        T.StructField("event_id", T.StringType(), False),
        T.StructField("kind", T.StringType(), False),
        T.StructField("aggregate_type", T.StringType(), False),
        T.StructField("aggregate_id", T.StringType(), False),
        T.StructField("payload", T.StringType(), False),
        T.StructField("metadata", T.StringType(), False),
        T.StructField("callbacks", T.StringType(), False),
        T.StructField("actor_id", T.StringType(), True),
        T.StructField("correlation_id", T.StringType(), True),
        T.StructField("causation_id", T.StringType(), True),
        T.StructField("created_at", T.TimestampType(), False),
    ]
)

DELIVERIES = T.StructType(
    [
        T.StructField("id", T.LongType(), False),
        T.StructField("event_id", T.StringType(), False),
        T.StructField("callback_name", T.StringType(), False),
        T.StructField("completion_mode", T.StringType(), False),
        T.StructField("attempts", T.IntegerType(), False),
        T.StructField("last_error", T.StringType(), True),
        T.StructField("last_attempt_at", T.TimestampType(), True),
        T.StructField("available_at", T.TimestampType(), False),
        T.StructField("locked_until", T.TimestampType(), True),
        T.StructField("dispatched_at", T.TimestampType(), True),
        T.StructField("processed_at", T.TimestampType(), True),
        T.StructField("completion_cycles", T.IntegerType(), False),
        T.StructField("dead_letter", T.BooleanType(), False),
        T.StructField("created_at", T.TimestampType(), False),
    ]
)

ATTEMPTS = T.StructType(
    [
        T.StructField("delivery_id", T.LongType(), False),
        T.StructField("started_at", T.TimestampType(), True),
        T.StructField("status_code", T.IntegerType(), True),
        T.StructField("failure_kind", T.StringType(), True),
        T.StructField("error_detail", T.StringType(), True),
        T.StructField("retry_after", T.StringType(), True),
        T.StructField("duration_seconds", T.DoubleType(), True),
    ]
)

COMMANDS = T.StructType(
    [
        T.StructField("delivery_id", T.LongType(), False),
        T.StructField("seq", T.LongType(), False),
        T.StructField("action", T.StringType(), False),
        T.StructField("issued_at", T.TimestampType(), True),
    ]
)

RUN_LOG = T.StructType(
    [
        T.StructField("query_id", T.StringType(), False),
        T.StructField("batch_id", T.LongType(), False),
        T.StructField("worker", T.StringType(), False),
        T.StructField("started_at", T.TimestampType(), False),
        T.StructField("duration_seconds", T.DoubleType(), False),
    ]
)

DELIVERY_COLUMNS = [f.name for f in DELIVERIES.fields]
EVENT_COLUMNS = [f.name for f in EVENTS.fields]

COMPLETION_MODES = ("managed", "external")
