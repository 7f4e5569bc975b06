import json
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from outboxlake import schemas
from outboxlake.operators import metrics, numbering, reads, retention, schedule
from outboxlake.options import Options, OptionsError, Page, RetentionOptions
from outboxlake.sources import tables
from outboxlake.sources.snapshots import CommitConflict, SnapshotStore

from .conftest import AS_OF, T0

GOOD = json.dumps([{"name": "send_email", "url": "https://example.com/h", "signing_key_id": "k1"}])


def test_load_events_from_files(spark, make_events, tmp_path):
    good = make_events(GOOD, GOOD, '{"a":1}', "[]", ids=[1, 2, 3, 4])
    nulls = good.filter("id = 1").select(
        *[F.lit(5).cast("long").alias("id") if c == "id" else F.lit("e5").alias(c) if c == "event_id"
          else F.lit(None).cast("string").alias(c) if c == "kind" else F.col(c) for c in good.columns]
    )
    landed = good.unionByName(nulls)
    for fmt in ("parquet", "json", "csv"):
        path = str(tmp_path / fmt)
        writer = landed.write.format(fmt)
        if fmt == "csv":
            writer = writer.option("header", "true").option("escape", '"')
        writer.save(path)
        checked = tables.load_events(spark, path, fmt)
        assert {r.id for r in checked.rows.collect()} == {1, 2}, fmt
        assert {(r.id, r.reason) for r in checked.rejected.collect()} == {
            (3, tables.EMPTY_CALLBACKS),
            (4, tables.EMPTY_CALLBACKS),
            (5, "null_kind"),
        }


def test_copies_of_one_event(make_events):
    """A third of the table is copies of one row, another part shares its event id."""
    n = 30
    ids = [7] * n + list(range(100, 100 + 2 * n))
    names = ["hot"] * n + ["hot" if i < n else f"e{i}" for i in range(2 * n)]
    checked = tables.check_events(make_events(*[GOOD] * (3 * n), ids=ids, names=names))
    rows = checked.rows.collect()
    assert len(rows) == n + 1
    assert [r.id for r in rows if r.event_id == "hot"] == [7]
    refused = checked.rejected.agg(F.sum("copies")).head()[0]
    assert refused == 2 * n - 1
    assert checked.rejected.filter("id = 7").head().copies == n - 1


def test_check_deliveries(make_events, make_deliveries):
    events = make_events(GOOD, GOOD)
    rows = make_deliveries(
        {"id": 1, "event_id": "e1"},
        {"id": 2, "event_id": "e1"},
        {"id": 3, "event_id": "e9"},
        {"id": 4, "event_id": "e2", "completion_mode": "other"},
        {"id": 5, "event_id": "e2"},
    )
    checked = tables.check_deliveries(rows, events)
    assert {r.id for r in checked.rows.collect()} == {1, 5}
    assert {(r.id, r.reason) for r in checked.rejected.collect()} == {
        (2, tables.DUPLICATE),
        (3, tables.ORPHAN),
        (4, tables.BAD_MODE),
    }


def test_append_combines_copies(spark, make_deliveries):
    copies = [(1, "hot", "cb", 0, "managed", False, None)] * 50 + [(2, "e2", "cb", 0, "managed", False, None)]
    schema = "event_seq long, event_id string, callback_name string, ordinal int, completion_mode string, dead_letter boolean, last_error string"
    table = make_deliveries({"id": 4, "event_id": "e0"})
    rows = schedule.append_deliveries(spark.createDataFrame(copies, schema), table, AS_OF)
    assert sorted((r.id, r.event_id) for r in rows.collect()) == [(5, "hot"), (6, "e2")]
    assert rows.columns == schemas.DELIVERY_COLUMNS


def test_snapshots(spark, make_events, make_deliveries, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "store"))
    assert store.version() == 0
    events = make_events(GOOD)
    rows = make_deliveries({"id": 1, "event_id": "e1"}, {"id": 2, "event_id": "e1", "callback_name": "b", "dead_letter": True})
    assert store.commit(0, events=events, deliveries=rows) == 1
    assert store.read("deliveries").count() == 2 and store.read_open().count() == 1
    plan = store.read_open()._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(closed" in plan
    assert store.commit(1, deliveries=rows.filter("id = 1")) == 2
    assert store.read("deliveries").count() == 1 and store.read("events").count() == 1
    assert store.read("deliveries", 1).count() == 2
    with pytest.raises(CommitConflict):
        store.commit(1, deliveries=rows)
    assert store.version() == 2


def test_bucketed_tables_join_without_shuffle(spark, make_events, make_deliveries, tmp_path):
    spark.sql(f"CREATE DATABASE IF NOT EXISTS ol LOCATION '{tmp_path}/db'")
    tables.write_bucketed(make_events(GOOD), "ol.e", 4)
    tables.write_bucketed(make_deliveries({"id": 1, "event_id": "e1"}), "ol.d", 4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        cut = retention.Cutoffs(AS_OF, AS_OF)
        terminal = retention.terminal_events(spark.table("ol.e"), spark.table("ol.d"), cut)
        assert "Exchange" not in terminal._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP DATABASE ol CASCADE")


def test_jdbc_options():
    options = tables.jdbc_options("jdbc:postgresql://h/db", "outbox_events", schemas.EVENTS, 0, 100, 8)
    assert options["partitionColumn"] == "id" and options["numPartitions"] == "8"
    assert "payload::text AS payload" in options["dbtable"]


def test_pages(make_events, make_deliveries):
    events = make_events(*[GOOD] * 5)
    rows = make_deliveries(
        *[{"id": i, "event_id": f"e{i}", "dead_letter": True} for i in range(1, 6)],
        {"id": 9, "event_id": "gone", "dead_letter": True},
    )
    page = Page(limit=2)
    first = reads.dead_letters(events, rows, page)
    assert [r.delivery_id for r in first.collect()] == [5, 4]
    cursor = reads.next_cursor(first, page).head()[0]
    assert cursor == 4
    second = reads.dead_letters(events, rows, Page(limit=4, before=cursor))
    assert [r.delivery_id for r in second.collect()] == [3, 2, 1]
    assert reads.next_cursor(second, Page(limit=4)).head()[0] is None
    assert Page(limit=0).rows == 1 and Page(limit=999).rows == 200
    assert reads.dead_letters(events, rows, Page(callback_name="none")).count() == 0


def test_event_with_deliveries(make_events, make_deliveries):
    events = make_events(GOOD)
    rows = make_deliveries({"id": 2, "event_id": "e1", "callback_name": "b"}, {"id": 1, "event_id": "e1"})
    (found,) = reads.event_with_deliveries(events, rows, "e1").collect()
    assert [d.id for d in found.deliveries] == [1, 2]
    assert reads.event_with_deliveries(events, rows, "none").count() == 0


def test_stats_of_an_empty_queue(make_events, make_deliveries):
    totals = reads.stats_totals(
        make_events(GOOD), make_deliveries({"id": 1, "event_id": "e1", "processed_at": T0}), AS_OF
    )
    row = totals.head()
    assert (row.events_total, row.deliveries_pending, row.oldest_pending_age_seconds) == (1, 0, None)
    lag = metrics.m_lag_seconds(totals).head()[0]
    assert lag != lag


def test_retention(make_events, make_deliveries):
    events = make_events(*[GOOD] * 5)
    rows = make_deliveries(
        {"id": 1, "event_id": "e1", "processed_at": T0},
        {"id": 2, "event_id": "e2", "dead_letter": True},
        {"id": 3, "event_id": "e3", "processed_at": T0},
        {"id": 4, "event_id": "e3", "callback_name": "b"},
        {"id": 5, "event_id": "e4", "processed_at": T0, "dead_letter": True},
    )
    cut = retention.Cutoffs(dead_letter=T0 + timedelta(1), processed=T0)
    got = {(r.event_id, r.reason) for r in retention.terminal_events(events, rows, cut).collect()}
    assert got == {("e2", "dead_letter"), ("e4", "dead_letter")}
    both = retention.Cutoffs.of(RetentionOptions(), AS_OF)
    result = retention.apply_retention(events, rows, both, 3)
    assert {r.event_id for r in result.deleted.collect()} == {"e1", "e2", "e4"}
    assert {r.event_id for r in result.events.collect()} == {"e3", "e5"}
    assert {r.id for r in result.deliveries.collect()} == {3, 4}
    assert {(r.reason, r.deleted) for r in result.report.collect()} == {("processed", 1), ("dead_letter", 2)}


def test_histogram(spark):
    df = spark.createDataFrame([("a", 0.005), ("a", 0.2), ("a", 99.0), ("b", None)], "k string, v double")
    rows = {(r.k, r.le): r for r in metrics.histogram(df, "v", ["k"], (0.005, 1.0)).collect()}
    assert [rows["a", le].cumulative_count for le in ("0.005", "1", "+Inf")] == [1, 2, 3]
    assert rows["a", "1"].sum == 99.205 and rows["b", "+Inf"]["count"] == 0


def test_options_bounds():
    for bad in (
        {"batch_size": 0},
        {"max_attempts": 51},
        {"timeout_seconds": 301},
        {"backoff": ()},
        {"backoff": (0,)},
        {"backoff": (604_801,)},
        {"payload_size_limit": 1023},
        {"payload_size_limit": 104_857_601},
        {"max_callbacks_per_event": 1001},
        {"max_completion_cycles": 1001},
        {"sweep_interval_seconds": 9},
        {"jitter": "x"},
    ):
        with pytest.raises(OptionsError):
            Options(**bad)
    with pytest.raises(OptionsError) as error:
        Options(batch_size=0, max_attempts=0)
    assert len(error.value.problems) == 2
    with pytest.raises(OptionsError):
        RetentionOptions(batch_limit=10_001)


@pytest.mark.parametrize("part_rows", [1, 7, 1000])
def test_dense_ids_follow_the_order_without_gaps(spark, part_rows):
    rows = [((k * 37) % 50 // 3, k % 4, f"r{k}") for k in range(120)]
    df = spark.createDataFrame(rows, "seq long, ordinal long, name string").repartition(5)
    top = 1 << 62
    got = numbering.dense_ids(df, ["seq", "ordinal", "name"], top, part_rows=part_rows).collect()
    in_order = [r.name for r in sorted(got, key=lambda r: r.id)]
    assert in_order == [name for _, _, name in sorted(rows)]
    assert [r.id for r in sorted(got, key=lambda r: r.id)] == [top + k + 1 for k in range(120)]
    assert numbering.dense_ids(df.limit(0), ["seq", "ordinal"], 5, part_rows=part_rows).count() == 0
