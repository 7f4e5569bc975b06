import os
import sys
from datetime import datetime

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession  # noqa: E402

from outboxlake import schemas  # noqa: E402
from outboxlake.session import STATE_STORE, configure  # noqa: E402

T0 = datetime(2024, 1, 1)
AS_OF = datetime(2024, 2, 1)


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield configure(session)
    session.stop()


@pytest.fixture(scope="session")
def make_events(spark):
    def make(*callbacks, payloads=None, ids=None, names=None):
        rows = []
        for i, text in enumerate(callbacks):
            number = ids[i] if ids else i + 1
            payload = payloads[i] if payloads else '{"hello":"world"}'
            event = names[i] if names else f"e{number}"
            rows.append(
                (number, event, "test.event@v1", "test", "a1", payload, "{}", text, None, None, None, T0)
            )
        return spark.createDataFrame(rows, schemas.EVENTS)

    return make


@pytest.fixture(scope="session")
def make_deliveries(spark):
    def make(*rows):
        base = {
            "callback_name": "send_email",
            "completion_mode": "managed",
            "attempts": 0,
            "available_at": T0,
            "completion_cycles": 0,
            "dead_letter": False,
            "created_at": T0,
        }
        full = [{**base, **r} for r in rows]
        data = [tuple(r.get(c) for c in schemas.DELIVERY_COLUMNS) for r in full]
        return spark.createDataFrame(data, schemas.DELIVERIES)

    return make
