"""Streams over several micro-batches end where the batch operators end."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from waybill.functions import expressions as X
from waybill.operators import changes as C
from waybill.operators.schema_ops import empty_table
from waybill.operators.hub_load import hub_load_fold, status_changes
from waybill.plans import sample_model as M
from waybill.session import fresh_folder
from waybill.sources.documents import PRESENT
from waybill.streaming import events as E
from waybill.streaming.buckets import BucketTable, latest
from waybill.streaming.hub_tree import HubTree
from waybill.streaming.store import compact_latest, latest_by_key, read_epochs


@pytest.fixture(scope="module")
def sliced(spark, folder):
    """The events as four files in time order, and as a stream that reads one file at a time."""
    events = M.shipment_events(spark, folder)
    path = fresh_folder(spark, "test-events")
    for part in range(4):
        chosen = F.floor((F.dayofmonth("event_datetime") - 1) / 8) == part
        events.where(chosen).coalesce(1).write.mode("append").parquet(path)
    stream = (spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1)
              .option("latestFirst", False).parquet(path))
    return events, stream


def same(left, right):
    columns = sorted(left.columns)
    left, right = left.select(*columns), right.select(*columns)
    assert left.exceptAll(right).count() == 0 and left.count() == right.count()


def test_current_status(spark, sliced):
    events, stream = sliced
    out = fresh_folder(spark, "test-status")
    E.stream_current_status(stream, f"{out}/rows", f"{out}/checkpoint")
    assert read_epochs(spark, f"{out}/rows").select("epoch").distinct().count() >= 4
    same(latest_by_key(read_epochs(spark, f"{out}/rows"), ["shipment_id"]), E.current_status(events))


def test_current_status_in_a_table(spark):
    """Late events, equal times, events without a status or a time: as the batch after every epoch, merged or not."""
    slices = [[(1, 1, "created", "2024-03-01"), (2, 2, "delivered", "2024-03-02"), (3, 3, None, "2024-03-01")],
              [(4, 1, "delivered", "2024-03-05"), (5, 2, "lost", "2024-03-01"), (6, 2, "at_hub", "2024-03-02"), (7, 4, "lost", None)],
              [(8, 1, "delivered", "2024-03-04"), (9, 3, "created", "2024-02-01")]]
    out = fresh_folder(spark, "test-status-table")
    table = E.status_table(spark, f"{out}/table", buckets=2, most_changes=2)
    table.create(spark.createDataFrame([], table.rows))
    for n in range(3):
        stream = _feed(spark, out, slices[n:n + 1])
        E.stream_current_status(stream, out, f"{out}/checkpoint", table=table)
        batch = spark.read.schema(stream.schema).parquet(f"{out}/in")
        same(table.read().select("shipment_id", "status", "actual_delivery"), E.current_status(batch))


def test_daily_counts(spark, sliced):
    events, stream = sliced
    out = fresh_folder(spark, "test-daily")
    E.stream_daily_counts(stream, f"{out}/rows", f"{out}/checkpoint")
    batch = events.groupBy(F.to_date("event_datetime").alias("date"), "status").agg(F.count(F.lit(1)).alias("events"))
    same(latest_by_key(read_epochs(spark, f"{out}/rows"), ["date", "status"]), batch)


def test_hub_load(spark, folder, sliced):
    events, stream = sliced
    shipments, hubs = M.shipments(spark, folder), M.hubs(spark, folder)
    out = fresh_folder(spark, "test-load")
    E.stream_hub_load(stream, shipments, hubs, out, f"{out}/checkpoint", buckets=4)
    batch = hub_load_fold(hubs, shipments, status_changes(events)).select(
        "id", F.col("new_load").cast("int").alias("current_load"))
    same(E.read_hub_load(spark, out).select("id", "current_load"), batch)


def test_hub_load_goes_on_after_a_restart(spark, folder):
    events, shipments, hubs = M.shipment_events(spark, folder), M.shipments(spark, folder), M.hubs(spark, folder)
    out = fresh_folder(spark, "test-restart")
    for half in (0, 1):
        part = events.where((F.dayofmonth("event_datetime") > 15).cast("int") == half)
        part.coalesce(1).write.mode("append").parquet(f"{out}/in")
        stream = spark.readStream.schema(events.schema).parquet(f"{out}/in")
        E.stream_hub_load(stream, shipments, hubs, out, f"{out}/checkpoint", buckets=4)
    batch = hub_load_fold(hubs, shipments, status_changes(events)).select(
        "id", F.col("new_load").cast("int").alias("current_load"))
    same(E.read_hub_load(spark, out).select("id", "current_load"), batch)


def test_late_events_are_marked(spark):
    out = fresh_folder(spark, "test-late")
    for n, rows in enumerate([[(1, 7, "created", "2024-01-02"), (2, 7, "delivered", "2024-01-03")],
                              [(3, 7, "lost", "2024-01-01"), (4, 7, "delivered", "2024-01-04"), (5, 7, None, "2024-01-05")]]):
        spark.createDataFrame(rows, "id bigint, shipment_id bigint, status string, at string").select(
            "id", "shipment_id", "status", F.col("at").cast("timestamp_ntz").alias("event_datetime"),
        ).coalesce(1).write.mode("append").parquet(f"{out}/in")
    stream = spark.readStream.schema("id bigint, shipment_id bigint, status string, event_datetime timestamp_ntz").option(
        "maxFilesPerTrigger", 1).parquet(f"{out}/in")
    E.run(E.status_change_stream(stream), lambda b, e: b.write.mode("overwrite").parquet(f"{out}/out/epoch={e}"), f"{out}/checkpoint")
    found = sorted((r["id"], r["old_status"], r["status"], r["late"]) for r in spark.read.parquet(f"{out}/out").collect())
    assert found == [(1, None, "created", False), (2, "created", "delivered", False),
                     (3, None, "lost", True)]


def _feed(spark, out, slices):
    """Write each slice as one file, read one file at a time."""
    for rows in slices:
        spark.createDataFrame(rows, "id bigint, shipment_id bigint, status string, at string").select(
            "id", "shipment_id", "status", F.col("at").cast("timestamp_ntz").alias("event_datetime"),
        ).coalesce(1).write.mode("append").parquet(f"{out}/in")
    return spark.readStream.schema("id bigint, shipment_id bigint, status string, event_datetime timestamp_ntz").option(
        "maxFilesPerTrigger", 1).parquet(f"{out}/in")


def test_daily_counts_lose_nothing(spark):
    out = fresh_folder(spark, "test-daily-late")
    stream = _feed(spark, out, [[(1, 1, "created", "2024-03-09"), (2, 1, None, "2024-03-09")],
                                [(3, 1, "created", "2020-01-01"), (4, 1, "created", None)],
                                [(5, 1, "created", "2024-03-09")]])
    E.stream_daily_counts(stream, f"{out}/rows", f"{out}/checkpoint")
    found = {(str(r["date"]), r["status"]): r["events"]
             for r in latest_by_key(read_epochs(spark, f"{out}/rows"), ["date", "status"]).collect()}
    assert found == {("2024-03-09", "created"): 2, ("2024-03-09", None): 1, ("2020-01-01", "created"): 1,
                     ("None", "created"): 1}


def test_a_stream_goes_on_behind_compacted_epochs(spark):
    out, keys = fresh_folder(spark, "test-compact"), ["shipment_id"]
    first = [[(1, 1, "created", "2024-03-01"), (2, 2, "created", "2024-03-01")], [(3, 1, "at_hub", "2024-03-02")]]
    E.stream_current_status(_feed(spark, out, first), f"{out}/rows", f"{out}/checkpoint")
    before = latest_by_key(read_epochs(spark, f"{out}/rows"), keys)
    compact_latest(spark, f"{out}/rows", f"{out}/compact", keys)
    assert read_epochs(spark, f"{out}/compact").select("epoch").distinct().count() == 1
    same(latest_by_key(read_epochs(spark, f"{out}/compact"), keys), before)
    E.stream_current_status(_feed(spark, out, [[(4, 2, "delivered", "2024-03-05")]]), f"{out}/compact", f"{out}/checkpoint")
    found = {r["shipment_id"]: r["status"] for r in latest_by_key(read_epochs(spark, f"{out}/compact"), keys).collect()}
    assert found == {1: "at_hub", 2: "delivered"}


def test_hub_load_from_stored_statuses_and_late_events(spark):
    out = fresh_folder(spark, "test-initial")
    hubs = spark.createDataFrame([(1, 100, 40), (2, 100, 10), (3, 100, 7)], "id bigint, capacity int, current_load int")
    shipments = spark.createDataFrame([(7, 1, 2, 5), (8, 3, 2, 2)],
                                      "id bigint, origin_hub_id bigint, destination_hub_id bigint, package_count int")
    initial = spark.createDataFrame([(7, "in_transit")], "shipment_id bigint, old_status string")
    slices = [[(1, 7, "in_transit", "2024-01-02"), (2, 8, "created", "2024-01-02"), (9, 8, "lost", None)],
              [(3, 7, "at_hub", "2024-01-03"), (4, 8, "delivered", "2024-01-01")]]
    stream = _feed(spark, out, slices)
    E.stream_hub_load(stream, shipments, hubs, out, f"{out}/checkpoint", initial=initial, buckets=4)
    # Shipment 7 was in transit before, so only at_hub releases packages; shipment 8 was delivered before it was created.
    loads = {r["id"]: r["current_load"] for r in E.read_hub_load(spark, out).collect()}
    assert loads == {1: 35, 2: 12, 3: 3}
    late = {r["hub_id"]: r["late_events"] for r in E.read_late_events(spark, out, shipments).collect()}
    assert late == {3: 1, 2: 1}


def test_hub_load_for_any_order_of_arrival(spark):
    """Random slices in random order, one busy shipment, repeated events, limits that bind: as the fold over the whole log, after
    every epoch; a day that loses its steps, and an epoch that is run again."""
    rng = random.Random(11)
    hubs = spark.createDataFrame([(1, 12, 9), (2, 10, 0), (3, None, 4), (4, 5, None)], "id bigint, capacity int, current_load int")
    shipments = spark.createDataFrame([(k, 1 + k % 4, 1 + k % 3, None if k == 5 else 1 + k % 3) for k in range(12)],
                                      "id bigint, origin_hub_id bigint, destination_hub_id bigint, package_count int")
    kinds = ["created", "in_transit", "delivered", "delivered", "lost"]
    rows = [(i, 0 if i % 3 == 0 else rng.randrange(13), rng.choice(kinds), f"{1969 + i % 3 * 25}-0{1 + i % 9}-{1 + i % 28:02d} 0{i % 10}:00:00")
            for i in range(90)]
    slices = [rows[i::4] for i in range(4)]
    rng.shuffle(slices)
    slices[3] = slices[3] + slices[1][:5]
    initial = spark.createDataFrame([(0, "created"), (4, "lost"), (99, "lost")], "shipment_id bigint, old_status string")
    out = fresh_folder(spark, "test-any-order")
    tree = HubTree(spark, out, hubs, shipments, initial, 4)
    tree.create()
    seen = []
    for epoch, part in enumerate(slices):
        seen += part
        batch, every = (spark.createDataFrame(r, "id bigint, shipment_id bigint, status string, time string").select(
            "id", "shipment_id", "status", F.unix_micros(F.to_timestamp("time")).alias("at")) for r in (part, seen))
        tree.fold(batch, epoch)
        if epoch == 2:
            tree.fold(batch, epoch)
        wanted = hub_load_fold(hubs, shipments, status_changes(every, order=("at", "id"), initial=initial), order=("at", "id"))
        same(tree.loads().select("id", "current_load"), wanted.select("id", F.col("new_load").cast("int").alias("current_load")))
    assert read_epochs(spark, f"{out}/late").count() > 0


def test_an_epoch_that_failed_on_the_way_goes_on(spark, monkeypatch):
    hubs = spark.createDataFrame([(1, 100, 50), (2, 100, 0)], "id bigint, capacity int, current_load int")
    shipments = spark.createDataFrame([(k, 1, 2, 1 + k) for k in range(4)],
                                      "id bigint, origin_hub_id bigint, destination_hub_id bigint, package_count int")
    batches = [spark.createDataFrame(rows, "id bigint, shipment_id bigint, at bigint, status string") for rows in (
        [(1, 1, 10, "created"), (2, 2, 20, "created"), (3, 3, 5, "created")],
        [(4, 1, 30, "delivered"), (5, 2, 15, "lost"), (6, 2, 40, "delivered")])]
    wanted = hub_load_fold(hubs, shipments, status_changes(batches[0].union(batches[1]), order=("at", "id")), order=("at", "id"))
    out = fresh_folder(spark, "test-failed")
    tree = HubTree(spark, out, hubs, shipments, None, 4)
    tree.create()
    tree.fold(batches[0], 0)
    add = BucketTable.add
    for step in ("log", "steps", "tree", "last"):
        def failing(table, changes, epoch):
            add(table, changes, epoch)
            if table.folder.endswith(step):
                raise OSError("lost")
        with monkeypatch.context() as patch:
            patch.setattr(BucketTable, "add", failing)
            with pytest.raises(OSError):
                HubTree(spark, out, hubs, shipments, None, 4).fold(batches[1], 1)
    HubTree(spark, out, hubs, shipments, None, 4).fold(batches[1], 1)
    found = HubTree(spark, out, hubs).loads()
    same(found.select("id", "current_load"), wanted.select("id", F.col("new_load").cast("int").alias("current_load")))


def test_bucket_table_keeps_untouched_files(spark):
    out = fresh_folder(spark, "test-buckets")
    schema = StructType.fromDDL("k bigint, v string, n int")
    table = BucketTable(spark, out, schema, schema, F.col("k") % 4, latest(["k"], ["n"]), most_changes=3)
    assert table.version() is None
    table.create(spark.createDataFrame([(k, "a", 0) for k in range(12)], schema))
    table.create(spark.createDataFrame([(1, "never", 0)], schema))
    state = {k: ("a", 0) for k in range(12)}
    for epoch in range(5):
        rows = [(1, f"e{epoch}", epoch + 1), (5, f"e{epoch}", 1), (20, "new", 1)] if epoch != 2 else [(2, "old", -1)]
        state |= {k: (v, n) for k, v, n in rows if n >= state.get(k, ("", n))[1]}
        for _ in range(2):  # run again
            table.add(spark.createDataFrame(rows, schema), epoch)
        assert {r.k: (r.v, r.n) for r in table.read().collect()} == state and table.version() == epoch
    files = {(b, kind): path for b, kind, path in table._entries()[2]}
    assert "base--1-" in files[3, "base"] and "base-" in files[1, "base"] and "base--1-" not in files[1, "base"]
    assert {r.k for r in table.read([1]).collect()} == {1, 5, 9}
    table.compact()
    assert {kind for _, kind, _ in table._entries()[2]} == {"base"} and table.version() == 4
    assert {r.k: (r.v, r.n) for r in table.read().collect()} == state


def test_event_source(spark):
    out = fresh_folder(spark, "test-source")
    empty_table(spark, "shipment_events").write.parquet(f"{out}/in")
    stream = E.event_source(spark, f"{out}/in")
    E.stream_current_status(stream, f"{out}/rows", f"{out}/checkpoint")
    assert stream.isStreaming and "event_datetime" in stream.columns


def test_upsert_equals_batch(spark, folder, sliced):
    _, stream = sliced
    kinds = F.when(F.col("status") == "in_transit", F.array(F.lit("status"))).otherwise(F.array().cast("array<string>"))

    def patches(events):
        return events.select(F.concat(F.lit("SH"), F.col("shipment_id").cast("string")).alias("id"),
                             F.col("id").alias("seq"), kinds.alias(PRESENT), "status")

    out = fresh_folder(spark, "test-upsert")
    E.stream_upsert(patches(stream), out, f"{out}/checkpoint")
    base, as_of = M.documents(spark, folder), X.timestamp("2024-02-01")
    merged = E.read_upserted(base, out, as_of)
    wanted = patches(sliced[0]).where("status = 'in_transit'")
    same(merged, C.apply_patches(base, wanted, as_of)[0])


def test_upsert_into_buckets(spark):
    """Equal to one batch after every epoch, whether patches have been merged or not; other buckets keep their base."""
    rows = [(f"k{k}", "pending", "standard", None) for k in range(40)]
    base = spark.createDataFrame(rows, "id string, status string, service_type string, updated_at timestamp")
    schema = f"id string, seq bigint, {PRESENT} array<string>, status string, service_type string"
    slices = [[("k1", 1, ["status"], "picked_up", None), ("k1", 2, ["service_type"], None, "express"), ("zz", 3, ["status"], "delivered", None)],
              [("k1", 0, ["status"], "delivered", None), ("k2", 5, [], None, None)],
              [("k1", 9, ["service_type"], None, "overnight"), ("k3", 9, ["status"], "sold", None)]]
    out, as_of = fresh_folder(spark, "test-buckets"), X.timestamp("2024-02-01")
    table = E.patched_table(base, spark.createDataFrame([], schema), f"{out}/table", as_of, buckets=6, most_changes=2)
    table.create(base)
    seen = []
    for n, part in enumerate(slices):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{out}/in")
        E.stream_upsert(spark.readStream.schema(schema).parquet(f"{out}/in"), out, f"{out}/checkpoint", table=table)
        seen += [(k, 100 * n + s, *rest) for k, s, *rest in part]
        valid = E.split(E.validate(spark.createDataFrame(seen, schema), E.patch_rules(spark.createDataFrame(seen, schema))))[0]
        same(table.read(), C.apply_patches(base, valid, as_of)[0])
    assert E.read_rejected_patches(spark, out).count() == 1
    bases = {path for _, kind, path in table._entries()[2] if kind == "base"}
    assert len(bases) == 2 and sum("base--1-" in path for path in bases) == 1


def test_a_stream_can_go_on(spark, sliced):
    _, stream = sliced
    out = fresh_folder(spark, "test-on")
    query = E.stream_daily_counts(stream, f"{out}/rows", f"{out}/checkpoint", every="1 second")
    try:
        query.processAllAvailable()
        assert query.isActive and read_epochs(spark, f"{out}/rows").count() > 0
    finally:
        query.stop()
