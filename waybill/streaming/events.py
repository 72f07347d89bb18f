"""The event-driven parts as streams.

Event streams have ``id, shipment_id, status, event_datetime``. Watermarks need an instant, so the
event time is cast to ``timestamp`` first.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from waybill.operators.changes import EXPLICIT_NULL, apply_patches
from waybill.operators.quality import patch_rules, split, validate
from waybill.schemas import schema_of
from waybill.streaming.buckets import EPOCH, BucketTable, hashed
from waybill.streaming.hub_tree import HubTree
from waybill.streaming.store import epoch_folder, epoch_writer, read_epochs, write_epoch


def event_source(spark: SparkSession, path: str, format: str = "parquet",
                 files_per_batch: int = 1000) -> DataFrame:
    """Shipment events as they arrive as files, with their declared schema."""
    return (spark.readStream.schema(schema_of("shipment_events")).format(format)
            .option("maxFilesPerTrigger", files_per_batch).load(path))


def run(stream: DataFrame, each_batch, checkpoint: str, mode: str = "update",
        every: str | None = None) -> StreamingQuery:
    """Process everything there is and stop; with ``every`` (as "1 minute") go on doing so."""
    writer = (stream.writeStream.outputMode(mode).foreachBatch(each_batch)
              .option("checkpointLocation", checkpoint))
    if every is not None:
        return writer.trigger(processingTime=every).start()
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    return query


# --- current status ----------------------------------------------------------------------------

def current_status(events: DataFrame) -> DataFrame:
    """Latest status and delivery time per shipment. Combined before the shuffle in each batch."""
    place = F.struct("event_datetime", "id")
    return events.groupBy("shipment_id").agg(
        F.max_by("status", F.when(F.col("status").isNotNull(), place)).alias("status"),
        F.max(F.when(F.col("status") == "delivered", F.col("event_datetime"))).alias("actual_delivery"))


_STATUS = "shipment_id bigint, at timestamp_ntz, id bigint, status string, actual_delivery timestamp_ntz"


def _status_rows(events: DataFrame) -> DataFrame:
    """One row per shipment: its last event with a status, and its last delivery."""
    place = F.struct("event_datetime", "id", "status")
    known = F.max(F.when(F.col("status").isNotNull(), place))
    return events.groupBy("shipment_id").agg(
        known.alias("_last"), F.max(F.when(F.col("status") == "delivered", F.col("event_datetime"))).alias("actual_delivery"),
    ).select("shipment_id", F.col("_last.event_datetime").alias("at"), "_last.id", "_last.status", "actual_delivery")


def _status_merge(base: DataFrame, changes: DataFrame) -> DataFrame:
    every = base.unionByName(changes.drop(EPOCH)).withColumnRenamed("at", "event_datetime")
    place = F.struct("event_datetime", "id", "status")
    return (every.groupBy("shipment_id").agg(F.max(F.when(F.col("status").isNotNull(), place)).alias("_last"),
                                             F.max("actual_delivery").alias("actual_delivery"))
            .select("shipment_id", F.col("_last.event_datetime").alias("at"), "_last.id", "_last.status", "actual_delivery"))


def status_table(spark: SparkSession, folder: str, buckets: int = 32, most_changes: int = 8) -> BucketTable:
    """The stored table for ``stream_current_status``: status and delivery of each shipment with the event they come from."""
    rows = StructType.fromDDL(_STATUS)
    return BucketTable(spark, folder, rows, rows, hashed("shipment_id", buckets), _status_merge, most_changes)


def stream_current_status(events: DataFrame, folder: str, checkpoint: str,
                          every: str | None = None, table: BucketTable | None = None) -> StreamingQuery:
    """Every epoch writes the shipments it touched; read with ``store.latest_by_key``.

    With a ``table`` (created; see ``status_table``) the stream has no state: each epoch is reduced to a row per shipment, which
    goes into the bucket of the shipment. Shipments that nothing happens to any more cost nothing there, and late events count as
    in the batch.
    """
    if table is None:
        return run(current_status(events), epoch_writer(folder), checkpoint, every=every)
    return run(events.select("shipment_id", "id", "status", "event_datetime"),
               lambda batch, epoch: table.add(_status_rows(batch), epoch), checkpoint, mode="append", every=every)


# --- daily counts ------------------------------------------------------------------------------

def daily_counts(events: DataFrame) -> DataFrame:
    """Events per day and status, however late they come; those without a time count under no day.

    The state is one row per day and status, a dozen a day, so there is no need for a watermark, which would drop
    late events.
    """
    return events.groupBy(F.to_date("event_datetime").alias("date"), "status").agg(
        F.count(F.lit(1)).alias("events"))


def stream_daily_counts(events: DataFrame, folder: str, checkpoint: str,
                        every: str | None = None) -> StreamingQuery:
    return run(daily_counts(events), epoch_writer(folder), checkpoint, every=every)


# --- hub load ----------------------------------------------------------------------------------

_CHANGES = "shipment_id bigint, at bigint, id bigint, old_status string, status string, late boolean"
_LAST = "at bigint, id bigint, status string"


def _track(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Status changes of one shipment in one micro-batch, from its last status on.

    Events that come before the last one already counted are late: they cannot be put into a
    result that has gone out, and are handed on marked. An event without a status changes none. A shipment
    without events so far has its stored status.
    """
    rows = pd.concat(list(batches)).sort_values(["at", "id"])
    rows = rows[rows["status"].notna()]
    if rows.empty:
        return
    stored = rows["stored"].iloc[0]
    at, last_id, status = state.get if state.exists else (None, None, stored if pd.notna(stored) else None)
    late = pd.Series(False, index=rows.index)
    if at is not None:
        late = (rows["at"] < at) | ((rows["at"] == at) & (rows["id"] <= last_id))
    fresh = rows[~late].copy()
    if len(fresh):
        now = fresh["status"].astype(object)
        old = pd.Series([status, *now.iloc[:-1]], index=fresh.index, dtype=object)
        fresh["old_status"] = old
        changed = [a != b for a, b in zip(old, now)]
        state.update((int(fresh["at"].iloc[-1]), int(fresh["id"].iloc[-1]), now.iloc[-1]))
        fresh = fresh[changed]
    passed = rows[late].assign(old_status=None)
    out = pd.concat([fresh.assign(late=False), passed.assign(late=True)])
    out["shipment_id"] = key[0]
    yield out[["shipment_id", "at", "id", "old_status", "status", "late"]]


def status_change_stream(events: DataFrame, initial: DataFrame | None = None) -> DataFrame:
    """Status changes per shipment, the last status being kept as state between batches.

    The status before a shipment's first event comes from ``initial`` (``shipment_id``, ``old_status``; one row per
    shipment), or is unknown (NULL), which any status differs from. Events without a time or a status change none.
    The rows of a shipment in one micro-batch meet in one task, so the source's admission limit
    (files or offsets per trigger) bounds them.
    """
    narrow = events.where("event_datetime is not null and status is not null").select(
        "shipment_id", F.unix_micros(F.col("event_datetime").cast("timestamp")).alias("at"), "id", "status")
    if initial is None:
        narrow = narrow.withColumn("stored", F.lit(None).cast("string"))
    else:
        narrow = narrow.join(initial.select("shipment_id", F.col("old_status").alias("stored")), "shipment_id", "left")
    return narrow.groupBy("shipment_id").applyInPandasWithState(
        _track, _CHANGES, _LAST, "update", GroupStateTimeout.NoTimeout)


def stream_hub_load(events: DataFrame, shipments: DataFrame, hubs: DataFrame, folder: str,
                    checkpoint: str, every: str | None = None,
                    initial: DataFrame | None = None, buckets: int = 32) -> StreamingQuery:
    """Hub loads as the batch fold over all events so far has them, in whatever order they arrive; see ``hub_tree``.

    ``initial`` is the stored status per shipment, as in ``status_change_stream``. Events without a time or a status change none.
    ``hubs`` are those of the first start; they are stored. ``buckets``: into how many the shipments are dealt, the same at each
    start; their number bounds what an epoch with late events reads.
    """
    spark = hubs.sparkSession
    if HubTree(spark, folder, hubs).last.version() is None:
        hubs.write.mode("overwrite").parquet(f"{folder}/hubs")
    tree = HubTree(spark, folder, spark.read.parquet(f"{folder}/hubs"), shipments, initial, buckets)
    tree.create()
    narrow = events.where("event_datetime is not null and status is not null").select(
        "shipment_id", F.unix_micros(F.col("event_datetime").cast("timestamp")).alias("at"), "id", "status")
    return run(narrow, tree.fold, checkpoint, mode="append", every=every)


def read_hub_load(spark: SparkSession, folder: str) -> DataFrame:
    """The loads after the last epoch."""
    return HubTree(spark, folder, spark.read.parquet(f"{folder}/hubs")).loads()


def read_late_events(spark: SparkSession, folder: str, shipments: DataFrame) -> DataFrame:
    """Per hub how many events came after later ones of their shipment: ``hub_id, late_events``. Their steps are in the loads.

    An event counts at the origin of its shipment, a delivered one also at the destination. Events of unknown shipments
    count under hub NULL.
    """
    late = read_epochs(spark, f"{folder}/late")
    ends = shipments.select(F.col("id").alias("shipment_id"), "origin_hub_id", "destination_hub_id")
    arrived = F.when(F.col("status") == "delivered", F.col("destination_hub_id"))
    hubs = F.array_distinct(F.array("origin_hub_id", arrived))
    known = F.when(F.size(F.array_compact(hubs)) > 0, F.array_compact(hubs)).otherwise(hubs)
    return (late.join(ends, "shipment_id", "left").select(F.explode(known).alias("hub_id"))
            .groupBy("hub_id").agg(F.count(F.lit(1)).alias("late_events")))


def read_rejected_patches(spark: SparkSession, folder: str) -> DataFrame:
    """The patches ``stream_upsert`` kept out, with their broken rules and epoch."""
    return split(read_epochs(spark, f"{folder}/patches"))[1]


# --- upsert ------------------------------------------------------------------------------------

def patched_table(base: DataFrame, patches: DataFrame, folder: str, as_of: Column, key: str = "id", seq: str = "seq",
                  mode: str = EXPLICIT_NULL, buckets: int = 32, most_changes: int = 8) -> BucketTable:
    """The stored table for ``stream_upsert``: rows like ``base``, changed by patches like ``patches``, in buckets of the key's hash.

    A bucket is its base with the patches since, which are merged into it once there are ``most_changes`` sets of them; a read
    merges what is left. All patches go by epoch, then ``seq``.
    """
    def merge(rows: DataFrame, changes: DataFrame) -> DataFrame:
        ordered = changes.withColumn(seq, F.struct(EPOCH, seq)).drop(EPOCH)
        return apply_patches(rows, ordered, as_of, key, seq, mode)[0]
    spark = base.sparkSession
    return BucketTable(spark, folder, base.schema, patches.schema, hashed(key, buckets), merge, most_changes)


def stream_upsert(patches: DataFrame, folder: str, checkpoint: str,
                  every: str | None = None, table: BucketTable | None = None) -> StreamingQuery:
    """Validate patches as they come and keep them, with their broken rules, per epoch.

    With a ``table`` (created; see ``patched_table``) the valid ones go into the buckets of their keys; those of unknown keys change
    nothing there. Without one ``read_upserted`` merges all of them when read."""

    def keep(batch: DataFrame, epoch: int) -> None:
        write_epoch(validate(batch, patch_rules(batch)), f"{folder}/patches", epoch)
        if table is not None:
            table.add(split(batch.sparkSession.read.parquet(epoch_folder(f"{folder}/patches", epoch)))[0], epoch)

    return run(patches, keep, checkpoint, mode="append", every=every)


def read_upserted(base: DataFrame, folder: str, as_of: Column, key: str = "id", seq: str = "seq",
                  mode: str = EXPLICIT_NULL) -> DataFrame:
    """The base table with all patches kept so far, in epoch and then ``seq`` order."""
    valid, _ = split(read_epochs(base.sparkSession, f"{folder}/patches"))
    ordered = valid.withColumn(seq, F.struct("epoch", seq)).drop("epoch")
    return apply_patches(base, ordered, as_of, key, seq, mode)[0]
