"""Request tables, signatures and signature audits."""

from __future__ import annotations

import hashlib
from collections.abc import Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from outboxlake.functions import times
from outboxlake.functions import variant as vj

# Body fields, in the order they are written.
BODY_FIELDS = (
    "actor_id",
    "aggregate_id",
    "aggregate_type",
    "attempt",
    "callback_name",
    "causation_id",
    "correlation_id",
    "created_at",
    "delivery_id",
    "event_id",
    "kind",
    "metadata",
    "mode",
    "payload",
)

SHA256_BLOCK = 64

KEY_SCHEMA = T.StructType(
    [
        T.StructField("signing_key_id", T.StringType(), False),
        T.StructField("_inner", T.BinaryType(), False),
        T.StructField("_outer", T.BinaryType(), False),
    ]
)


def render_requests(due: DataFrame) -> DataFrame:
    """One request per revalidated due row: url, body text and headers."""
    values = {
        "created_at": times.rfc3339(F.col("created_at")),
        "attempt": F.col("attempts") + 1,
        "mode": F.col("target.mode"),
        "payload": vj.parse(F.col("payload")),
        "metadata": vj.parse(F.col("metadata")),
    }
    body = F.to_json(
        F.struct(*[values.get(n, F.col(n)).alias(n) for n in BODY_FIELDS]),
        {"ignoreNullFields": "false"},
    )
    fixed = F.create_map(
        F.lit("Content-Type"),
        F.lit("application/json"),
        F.lit("X-Outbox-Event-Id"),
        F.col("event_id"),
        F.lit("X-Outbox-Delivery-Id"),
        F.col("delivery_id").cast("string"),
        F.lit("X-Outbox-Callback-Name"),
        F.col("callback_name"),
        F.lit("X-Outbox-Kind"),
        F.col("kind"),
        F.lit("X-Outbox-Mode"),
        F.col("target.mode"),
        F.lit("X-Outbox-Attempt"),
        (F.col("attempts") + 1).cast("string"),
    )
    return due.select(
        "delivery_id",
        "event_id",
        "callback_name",
        (F.col("attempts") + 1).alias("attempt"),
        F.col("target.url").alias("url"),
        F.col("target.timeout_seconds").alias("timeout_seconds"),
        F.col("target.signing_key_id").alias("signing_key_id"),
        F.map_concat(fixed, F.col("target.headers")).alias("headers"),
        body.alias("body"),
    )


def key_table(spark: SparkSession, keys: Mapping[str, bytes]) -> DataFrame:
    """The keyring as a table of padded keys, one row per configured key.

    A table rather than literals, so that no secret shows up in query plans.
    """
    columns: dict[str, list] = {"signing_key_id": [], "_inner": [], "_outer": []}
    for key_id, secret in sorted(keys.items()):
        block = secret if len(secret) <= SHA256_BLOCK else hashlib.sha256(secret).digest()
        block = block.ljust(SHA256_BLOCK, b"\0")
        columns["signing_key_id"].append(key_id)
        columns["_inner"].append(bytes(b ^ 0x36 for b in block))
        columns["_outer"].append(bytes(b ^ 0x5C for b in block))
    types = [pa.string(), pa.binary(), pa.binary()]
    arrays = [pa.array(v, t) for v, t in zip(columns.values(), types)]
    return spark.createDataFrame(pa.table(arrays, names=list(columns)), KEY_SCHEMA)


def hmac_hex(message: Column) -> Column:
    """HMAC-SHA256 with the padded key of the row, as two nested hashes."""
    inside = F.unhex(F.sha2(F.concat(F.col("_inner"), message), 256))
    return F.sha2(F.concat(F.col("_outer"), inside), 256)


def signed_text(stamp: Column, body: Column) -> Column:
    return F.concat(stamp.cast("string").cast("binary"), F.lit(b"."), body.cast("binary"))


def sign_requests(requests: DataFrame, keys: DataFrame, sent_at: times.AsOf) -> DataFrame:
    """Adds ``signature`` and the two signing headers, or ``send_error``.

    Requests without a key stay unsigned; an unknown key is a failed attempt that is
    never sent. The key table holds one row per configured key.
    """
    stamp = int((times.as_datetime(sent_at) - times.as_datetime("1970-01-01")).total_seconds())
    joined = requests.join(F.broadcast(keys), "signing_key_id", "left")
    known = F.col("_inner").isNotNull()
    signature = F.when(
        known,
        F.concat(F.lit(f"t={stamp},v1="), hmac_hex(signed_text(F.lit(stamp), F.col("body")))),
    )
    error = F.when(
        F.col("signing_key_id").isNotNull() & ~known,
        F.concat(F.lit("signing_key_id '"), F.col("signing_key_id"), F.lit("' not registered")),
    )
    signed = joined.withColumns({"signature": signature, "send_error": error})
    extra = F.when(
        F.col("signature").isNotNull(),
        F.map_concat(
            F.col("headers"),
            F.create_map(
                F.lit("X-Outbox-Signing-Key-Id"),
                F.col("signing_key_id"),
                F.lit("X-Outbox-Signature"),
                F.col("signature"),
            ),
        ),
    ).otherwise(F.col("headers"))
    return signed.select(
        *[extra.alias("headers") if n == "headers" else F.col(n) for n in requests.columns],
        "signature",
        "send_error",
    )


def verify_signatures(
    received: DataFrame, keys: DataFrame, as_of: times.AsOf, max_age_seconds: int
) -> DataFrame:
    """Adds ``valid`` to a log of received requests (signing_key_id, body, signature).

    Stamps older than the window fail, future ones pass.
    """

    def part(prefix: str) -> Column:
        parts = F.split(F.col("signature"), ",", -1)
        tail = F.filter(
            F.transform(parts, lambda p: F.regexp_replace(p, r"^\s+|\s+\z", "")),
            lambda p: p.startswith(prefix),
        )
        return F.substring(F.get(tail, F.lit(0)), len(prefix) + 1, 1 << 20)

    now = int((times.as_datetime(as_of) - times.as_datetime("1970-01-01")).total_seconds())
    stamped = received.withColumns({"_t": part("t="), "_v1": part("v1=")})
    stamp = F.when(
        F.col("_t").rlike(r"^\+?[0-9]+\z"),
        F.regexp_replace("_t", r"^\+", "").try_cast("decimal(20,0)"),
    )
    joined = stamped.withColumn("_stamp", stamp).join(F.broadcast(keys), "signing_key_id", "left")
    fresh = F.lit(now) - F.col("_stamp") <= max_age_seconds
    matches = F.lower("_v1") == hmac_hex(signed_text(F.col("_stamp"), F.col("body")))
    return joined.select(
        *received.columns, F.coalesce(fresh & matches, F.lit(False)).alias("valid")
    )
