"""Bulk create, patch, delete and event append.

Plain files have no in-place update: every operator returns the new rows or the new table, and the
caller writes them to a new place (or through ``foreachBatch``). Incoming batches are reduced to
one row per key before they meet the stored table, so a key with many changes costs one row there.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waybill import fixed
from waybill.functions import expressions as X
from waybill.functions.expressions import tracking_base
from waybill.operators.lookup import lookup, taken_keys
from waybill.operators.ordered import ROWS_PER_TASK, along
from waybill.operators.quality import (
    BROKEN, check_rules, shipment_rules, split, validate, validate_hubs, validate_users,
)
from waybill.operators.tracking import in_base_order, with_numbers
from waybill.sources.documents import PRESENT

EXPLICIT_NULL = "explicit_null"
IGNORE_NULL = "ignore_null"
#: Rows of a table or of patches that one task holds, where they are dealt out by number.
PATCHED_ROWS = 250_000


# --- create ------------------------------------------------------------------------------------

def _absent_default(df: DataFrame, column: str, value: Column) -> Column:
    """The default where the document had no such field; an explicit NULL stays."""
    if column not in df.columns:
        return value
    if PRESENT not in df.columns:
        return F.coalesce(column, value)
    absent = F.col(column).isNull() & ~F.array_contains(PRESENT, column)
    return F.when(absent, value).otherwise(F.col(column))


def _with_absent(df: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    missing = {c: F.lit(None).cast(kind) for c, kind in columns.items() if c not in df.columns}
    return df.withColumns(missing) if missing else df


def create_shipments(payloads: DataFrame, existing: DataFrame, as_of: Column, batch: str,
                     days: Mapping[str, int] = fixed.DELIVERY_DAYS) -> tuple[DataFrame, DataFrame]:
    """New shipment documents from payloads numbered by ``ordinal``: ``(created, rejects)``.

    Identifiers come from ``batch`` and ``ordinal``, so a run repeated after a failure creates the
    same rows. ``as_of`` is one time for the whole batch: the stored numbers that can collide all start with its base,
    which reaches the scan of ``existing``.
    """
    optional = {"sender_phone": "string", "receiver_phone": "string", "route": "string",
                "hub_id": "string", "pickup_date": "timestamp_ntz"}
    filled = _with_absent(payloads, optional).withColumn(
        "service_type", _absent_default(payloads, "service_type", F.lit(fixed.DEFAULT_SERVICE)))
    # Numbering goes over the batch several times: it is parsed, checked and ordered once. Rejects take no number.
    checked = validate(filled, shipment_rules(filled)).withColumn("created_at", as_of)
    base = F.when(F.size(BROKEN) == 0, tracking_base(as_of))
    placed = in_base_order(checked, base, ["ordinal"])
    _, rejects = split(placed.drop("_base", "_place"))
    used = existing.where(F.col("tracking_number").startswith(tracking_base(as_of)))
    rows = with_numbers(placed, used).drop(BROKEN).withColumns({
        "id": X.stable_uuid(F.lit(batch), "ordinal"),
        "weight": F.col("weight").cast("decimal(10,2)"),
        "cost": F.col("cost").cast("decimal(10,2)"),
        "status": F.lit(fixed.INITIAL_STATUS),
        "estimated_delivery": X.eta("service_type", "pickup_date", as_of, days),
        "actual_delivery": F.lit(None).cast("timestamp_ntz"),
        "events": X.initial_event(X.stable_uuid(F.lit(batch), "ordinal", F.lit("created")), as_of),
        "updated_at": as_of,
    })
    return rows.drop(PRESENT), rejects.drop("created_at")


def _unclaimed(valid: DataFrame, existing: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """``(fresh, repeated)``: a row is fresh if no existing row has one of its ``keys`` and no earlier valid one names it.

    NULL keys collide with nothing. One row per key value meets the batch again, however often it repeats.
    """
    marked, broken = valid, []
    for i, key in enumerate(keys):
        taken = taken_keys(valid, existing, [key]).withColumn("_taken", F.lit(True))
        first = (valid.where(F.col(key).isNotNull()).groupBy(key).agg(F.min("ordinal").alias("_first"))
                 .join(taken, key, "left")
                 .select(key, F.when(F.col("_taken").isNull(), F.col("_first")).alias(f"_owner{i}")))
        marked = marked.join(first, key, "left")
        owned = F.col(f"_owner{i}").eqNullSafe(F.col("ordinal"))
        broken.append(F.when(F.col(key).isNotNull() & ~owned, F.lit(f"{key}_exists")))
    checked = marked.withColumn(BROKEN, F.array_compact(F.array(*broken))).select(*valid.columns, BROKEN)
    return split(checked)


def create_hubs(payloads: DataFrame, existing: DataFrame, as_of: Column,
                batch: str) -> tuple[DataFrame, DataFrame]:
    """New hubs: upper-case code, no load; ``(created, rejects)``.

    A code or name that exists, or that an earlier valid payload of the batch names, is rejected.
    """
    optional = {"pincode": "string", "phone": "string", "manager": "string"}
    filled = _with_absent(payloads, optional).withColumn(
        "status", _absent_default(payloads, "status", F.lit("active")))
    valid, rejects = validate_hubs(filled)
    fresh, repeated = _unclaimed(valid.withColumn("code", X.upper_code("code")), existing, ["code", "name"])
    return fresh.withColumns({
        "id": X.stable_uuid(F.lit(batch), "ordinal"),
        "current_load": F.lit(0),
        "created_at": as_of,
        "updated_at": as_of,
    }).drop(PRESENT), rejects.unionByName(repeated)


def create_users(payloads: DataFrame, existing: DataFrame, as_of: Column, batch: str,
                 roles: list[str] = fixed.ALLOWED["users", "role"]) -> tuple[DataFrame, DataFrame]:
    """New users; an email (or username, where payloads have one) that exists, or that an earlier valid payload of the
    batch names, is rejected."""
    valid, rejects = validate_users(payloads, roles)
    keys = [k for k in ("email", "username") if k in payloads.columns]
    fresh, repeated = _unclaimed(valid, existing, keys)
    created = fresh.withColumns({
        "id": X.stable_uuid(F.lit(batch), "ordinal"),
        "is_active": F.lit(True),
        "created_at": as_of,
        "updated_at": as_of,
    })
    return created, rejects.unionByName(repeated)


# --- patch -------------------------------------------------------------------------------------

def touch_updated_at(df: DataFrame, changed: Column, as_of: Column,
                     column: str = "updated_at") -> DataFrame:
    """Set the change time on changed rows only."""
    return df.withColumn(column, F.when(changed, as_of).otherwise(F.col(column)))


def _is_set(field: str, mode: str) -> Column:
    if mode == IGNORE_NULL:
        return F.col(field).isNotNull()
    return F.array_contains(PRESENT, field)


def _patch_fields(table: DataFrame, patches: DataFrame, key: str, seq: str) -> list[str]:
    return [c for c in patches.columns if c in table.columns and c not in (key, seq, PRESENT)]


def _any_set(fields: list[str], mode: str) -> Column:
    marks = [F.coalesce(_is_set(f, mode), F.lit(False)) for f in fields]
    return F.greatest(F.lit(False), F.lit(False), *marks)


def combine_patches(patches: DataFrame, fields: list[str], key: str, seq: str,
                    mode: str) -> DataFrame:
    """One row per key: for each field the last value set, and whether it was set at all."""
    aggregates = []
    for field in fields:
        when_set = F.when(_is_set(field, mode), F.col(seq))
        aggregates.append(F.max_by(field, when_set).alias(f"_new_{field}"))
        aggregates.append(F.max(when_set).alias(f"_seq_{field}"))
    return patches.where(_any_set(fields, mode)).groupBy(key).agg(*aggregates)


def tasks_for(*frames: DataFrame) -> int:
    """Tasks for as many rows as the largest of ``frames`` has, so that what a task sorts stays the same as they grow."""
    return max(1, *[-(-df.count() // PATCHED_ROWS) for df in frames])


def apply_patches(table: DataFrame, patches: DataFrame, as_of: Column, key: str = "id",
                  seq: str = "seq", mode: str = EXPLICIT_NULL, recompute_eta: bool = False,
                  days: Mapping[str, int] = fixed.DELIVERY_DAYS, tasks: int = 1,
                  ) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Apply patches in ``seq`` order: ``(table, unmatched, empty)``.

    With ``explicit_null`` a field is set when ``present_fields`` names it, NULL included; with
    ``ignore_null`` when it is not NULL. Patches for unknown keys and patches that set nothing are
    handed back. ``recompute_eta`` derives the estimate anew at every service change. ``tasks`` above 1 (see ``tasks_for``)
    fixes the number of parts that rows are dealt into, else Spark chooses it.
    """
    fields = _patch_fields(table, patches, key, seq)
    if tasks > 1:
        table, patches = table.repartition(tasks, key), patches.repartition(tasks, seq)
    combined = combine_patches(patches, fields, key, seq, mode)
    if tasks > 1:
        combined = combined.repartition(tasks, key)
    joined = table.join(combined, key, "left")
    new = {f: F.when(F.col(f"_seq_{f}").isNotNull(), F.col(f"_new_{f}").cast(table.schema[f].dataType))
           .otherwise(F.col(f)) for f in fields}
    changed = F.coalesce(*[F.col(f"_seq_{f}") for f in fields]).isNotNull()
    helpers = [f"_{kind}_{f}" for f in fields for kind in ("new", "seq")]
    if recompute_eta and "service_type" in fields:
        joined, estimate = _patched_eta(joined, table, patches, fields, new, as_of, key, seq, mode, days)
        new["estimated_delivery"] = estimate
        helpers += ["_pickup_at_service", "_pickup_was_set"]
    if "updated_at" in table.columns:
        new["updated_at"] = F.when(changed, as_of).otherwise(new.get("updated_at", F.col("updated_at")))
    updated = joined.withColumns(new).drop(*helpers).select(*table.columns)

    something = _any_set(fields, mode)
    # One row per key meets the table; a NULL key is in no table.
    unknown = combined.select(key).join(table.select(key), key, "left_anti").withColumnRenamed(key, "_unknown")
    unmatched = patches.where(something).join(unknown, F.col(key).eqNullSafe(F.col("_unknown")), "left_semi")
    return updated, unmatched, patches.where(~something)


def patch_hubs(hubs: DataFrame, patches: DataFrame, as_of: Column, key: str = "id",
               seq: str = "seq") -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Apply hub patches, whose NULL fields change nothing: ``(hubs, rejects, unmatched, empty)``.

    Codes are upper-cased as on create. A patch is rejected if it breaks a CHECK of the hubs, or sets a name or code that another hub has, or that an
    earlier valid patch of another hub sets; so names and codes stay unique.
    """
    if "code" in patches.columns:
        patches = patches.withColumn("code", X.upper_code("code"))
    valid, rejects = split(validate(patches, check_rules("hubs", patches)))
    known = valid.join(hubs.select(key), key, "left_semi")
    marked, broken = valid, []
    for field in [c for c in ("name", "code") if c in patches.columns]:
        wanted = known.where(F.col(field).isNotNull())
        # One row per value: the hub that sets it first, and the hub that has it.
        claims = wanted.groupBy(field).agg(F.min_by(key, seq).alias(f"_first_{field}"))
        holders = (hubs.select(field, F.col(key).alias("_holder")).join(claims.select(field), field, "left_semi")
                   .groupBy(field).agg(F.min("_holder").alias(f"_holder_{field}")))
        marked = marked.join(claims.join(holders, field, "left"), field, "left")
        foreign = F.coalesce(F.col(f"_holder_{field}"), F.col(f"_first_{field}")) != F.col(key)
        broken.append(F.when(foreign, F.lit(f"{field}_exists")))
    checked = marked.withColumn(BROKEN, F.array_compact(F.array(F.lit(None).cast("string"), *broken)))
    accepted, repeated = split(checked.select(*valid.columns, BROKEN))
    updated, unmatched, empty = apply_patches(hubs, accepted, as_of, key, seq, IGNORE_NULL)
    return updated, rejects.unionByName(repeated), unmatched, empty


def _patched_eta(joined: DataFrame, table: DataFrame, patches: DataFrame, fields: list[str],
                 new: Mapping[str, Column], as_of: Column, key: str, seq: str, mode: str,
                 days: Mapping[str, int]) -> tuple[DataFrame, Column]:
    """The estimate after the last service change, unless a later patch set one by itself.

    The service change sees the pickup time known at that moment, so a pickup time patched in
    later does not count.
    """
    pickup = F.col("pickup_date")
    if "pickup_date" in fields:
        service_at = (patches.where(_is_set("service_type", mode))
                      .groupBy(key).agg(F.max(seq).alias("_service_seq")))
        moved = (patches.where(_is_set("pickup_date", mode)).select(key, seq, "pickup_date")
                 .join(service_at, key).where(F.col(seq) <= F.col("_service_seq"))
                 .groupBy(key).agg(F.max_by("pickup_date", seq).alias("_pickup_at_service"),
                                   F.lit(True).alias("_pickup_was_set")))
        joined = joined.join(moved, key, "left")
        pickup = F.when(F.col("_pickup_was_set"), F.col("_pickup_at_service")).otherwise(pickup)
    estimate = X.eta(F.col("_new_service_type"), pickup, as_of, days)
    stored = new.get("estimated_delivery", F.col("estimated_delivery"))
    recomputed = F.col("_seq_service_type").isNotNull()
    if "estimated_delivery" in fields:
        later = F.coalesce(F.col("_seq_estimated_delivery") > F.col("_seq_service_type"), F.lit(False))
        recomputed = recomputed & ~later
    return joined, F.when(recomputed, estimate).otherwise(stored)


# --- delete ------------------------------------------------------------------------------------

def delete_by_key(table: DataFrame, keys: DataFrame, by: tuple[str, ...] = ("id",),
                  key: str = "key") -> tuple[DataFrame, DataFrame]:
    """``(remaining rows, keys not found)``; with several columns in ``by`` the first match wins."""
    id_column = by[0]
    found = lookup(keys, table.select(*by), list(by), key)
    gone = found.select(id_column).distinct()
    missing = (keys.select(key).distinct()
               .join(found.select(key).distinct(), key, "left_anti"))
    return table.join(gone, id_column, "left_anti").select(*table.columns), missing


# --- events ------------------------------------------------------------------------------------

def event_timeline(shipments: DataFrame, events: DataFrame, order: tuple[str, ...] = ("at", "seq"),
                   key: str = "shipment_id", rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """The new events of known shipments in order: ``position`` counts on from 1 per shipment.

    An event without a status has the status current at that point; a missing location or
    description is empty.
    """
    ordered = along(events, [key], list(order), "status", rows_per_task)
    start = shipments.select(F.col("id").alias(key), F.col("status").alias("_start"))
    return ordered.join(start, key).select(
        key, *order, "position",
        F.coalesce("latest", "_start").alias("status"),
        F.coalesce("location", F.lit("")).alias("location"),
        F.coalesce("description", F.lit("")).alias("description"))


def append_events(shipments: DataFrame, events: DataFrame, as_of: Column,
                  order: tuple[str, ...] = ("at", "seq"),
                  key: str = "shipment_id") -> tuple[DataFrame, DataFrame]:
    """Shipments after their events: ``(shipments, events of unknown shipments)``.

    The status follows the last event that has one; the last delivered event sets
    ``actual_delivery``. The events themselves are the rows of ``event_timeline``.
    """
    place = F.struct(*order)
    has_status = F.col("status").isNotNull()
    last = events.groupBy(F.col(key).alias("id")).agg(
        F.max_by("status", F.when(has_status, place)).alias("_status"),
        F.max_by(order[0], F.when(F.col("status") == "delivered", place)).alias("_delivered"),
        F.count(F.lit(1)).alias("_events"))
    changed = F.col("_events").isNotNull()
    updated = shipments.join(last, "id", "left").withColumns({
        "status": F.coalesce("_status", "status"),
        "actual_delivery": F.coalesce("_delivered", "actual_delivery"),
        "updated_at": F.when(changed, as_of).otherwise(F.col("updated_at")),
    }).select(*shipments.columns)
    known = taken_keys(events.select(F.col(key).alias("id")), shipments, ["id"])
    unknown = events.join(known.withColumnRenamed("id", key), key, "left_anti")
    return updated, unknown


def event_pages(timeline: DataFrame, page_size: int, key: str = "shipment_id",
                order: tuple[str, ...] = ("at", "seq")) -> DataFrame:
    """The events as documents: ``events`` arrays of at most ``page_size``, in order.

    Usual shipments have one page, which is their event history. A shipment with more events has
    more pages instead of one row that no task could hold.
    """
    event = F.struct("position", F.col(order[1]).cast("string").alias("id"),
                     F.col(order[0]).alias("timestamp"), "status", "location", "description")
    page = F.floor((F.col("position") - 1) / page_size).cast("bigint")
    sorted_events = F.array_sort(F.collect_list(event))
    return (timeline.groupBy(key, page.alias("page")).agg(sorted_events.alias("_events"))
            .select(key, "page", F.transform("_events", lambda e: e.dropFields("position")).alias("events")))


def with_history(shipments: DataFrame, pages: DataFrame, key: str = "shipment_id") -> DataFrame:
    """Shipment documents with their new events behind the ones they had.

    A document with more than one page of new events appears once per page, numbered in ``page``;
    the events it had before stand on the first.
    """
    joined = shipments.join(
        pages.select(F.col(key).alias("id"), "page", F.col("events").alias("_new")), "id", "left")
    page = F.coalesce("page", F.lit(0))
    before = F.when(page == 0, F.coalesce("events", F.array())).otherwise(F.array())
    return joined.withColumns({
        "events": F.concat(before, F.coalesce("_new", F.array())), "page": page,
    }).drop("_new")


def append_with_history(shipments: DataFrame, events: DataFrame, as_of: Column, page_size: int,
                        order: tuple[str, ...] = ("at", "seq"), key: str = "shipment_id",
                        rows_per_task: int = ROWS_PER_TASK) -> tuple[DataFrame, DataFrame]:
    """Shipment documents after their events, history included: ``(documents, events of unknown shipments)``.

    The key of the documents is ``(id, page)``, as in ``with_history``.
    """
    updated, unknown = append_events(shipments, events, as_of, order, key)
    timeline = event_timeline(shipments, events, order, key, rows_per_task)
    return with_history(updated, event_pages(timeline, page_size, key, order), key), unknown
