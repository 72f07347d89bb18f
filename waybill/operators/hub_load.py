"""Hub load after a log of shipment status changes.

Every change of a shipment's status releases its packages at the origin hub, never below zero;
a change to delivered adds them at the destination hub, never above its capacity. The order of
the changes matters, because both limits lose information.

Each step is a function ``x -> min(high, max(low, x + shift))``, and two such functions in a row
are again one of that form. So every task composes its own stretch of a hub's steps, and only one
function per hub and stretch is left to apply in order.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waybill.operators.ordered import ROWS_PER_TASK, along

# Limits wide enough to be none, with room left to add shifts in 64 bits.
_NO_LIMIT = 1 << 60
_STEP_SCHEMA = "stretch int, seq bigint, low bigint, high bigint, shift bigint"


def status_changes(events: DataFrame, key: str = "shipment_id", status: str = "status",
                   order: tuple[str, ...] = ("event_datetime", "id"),
                   initial: DataFrame | None = None,
                   rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Events at which the status really changes, with ``old_status``.

    The status before a shipment's first event comes from ``initial`` (``key``, ``old_status``),
    or is unknown (NULL), which any status differs from. An event without a status changes none.
    """
    ordered = along(events.where(F.col(status).isNotNull()), [key], list(order), status, rows_per_task)
    if initial is None:
        old = F.col("previous")
    else:
        start = initial.select(F.col(key), F.col("old_status").alias("_start"))
        ordered = ordered.join(start, key, "left")
        old = F.when(F.col("position") == 1, F.col("_start")).otherwise(F.col("previous"))
    changed = ordered.withColumn("old_status", old).where(~F.col("old_status").eqNullSafe(F.col(status)))
    return changed.drop("previous", "latest", "position", "_start")


def load_steps(changes: DataFrame, shipments: DataFrame, key: str = "shipment_id",
               status: str = "status", order: tuple[str, ...] = ("event_datetime", "id")) -> DataFrame:
    """The load steps of each change: ``hub_id, at, seq, step, packages`` in replay order.

    ``packages`` is NULL where the shipment's count is.
    """
    moves = shipments.select(F.col("id").alias(key), "origin_hub_id", "destination_hub_id",
                             "package_count")
    joined = changes.select(key, *order, status).join(moves, key)
    release = F.struct(F.col("origin_hub_id").alias("hub_id"), F.lit(0).alias("step"))
    arrive = F.struct(
        F.when(F.col(status) == "delivered", F.col("destination_hub_id")).alias("hub_id"),
        F.lit(1).alias("step"))
    return (joined.select(*order, "package_count",
                          F.explode(F.array(release, arrive)).alias("move"))
            .where("move.hub_id is not null")
            .select("move.hub_id", F.col(order[0]).alias("at"), F.col(order[1]).alias("seq"),
                    "move.step", F.col("package_count").cast("bigint").alias("packages")))


def step_functions(steps: DataFrame, hubs: DataFrame) -> DataFrame:
    """Steps as clamp functions; an arrival is limited by the capacity of its hub.

    Limits skip NULLs: without a package count only the limit is left, so a release empties the hub and
    an arrival fills it (a hub without a capacity stays as it is).
    """
    limits = hubs.select(F.col("id").alias("hub_id"), F.col("capacity").cast("bigint"))
    arriving, unknown = F.col("step") == 1, F.col("packages").isNull()
    return steps.join(limits, "hub_id").select(
        "hub_id", "at", "seq", "step",
        F.when(arriving & unknown, F.coalesce("capacity", F.lit(-_NO_LIMIT)))
        .when(arriving, F.lit(-_NO_LIMIT)).otherwise(F.lit(0)).alias("low"),
        F.when(arriving, F.coalesce("capacity", F.lit(_NO_LIMIT)))
        .when(unknown, F.lit(0)).otherwise(F.lit(_NO_LIMIT)).alias("high"),
        F.coalesce(F.when(arriving, F.col("packages")).otherwise(-F.col("packages")), F.lit(0)).alias("shift"))


def _compose(first: np.ndarray, then: np.ndarray) -> np.ndarray:
    """Compose rows of (low, high, shift): ``then`` applied after ``first``."""
    low, high, shift = then.T
    return np.stack([
        np.minimum(high, np.maximum(low, first[:, 0] + shift)),
        np.minimum(high, np.maximum(low, first[:, 1] + shift)),
        first[:, 2] + shift,
    ], axis=1)


def _reduce_runs(hubs: np.ndarray, functions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Compose each run of equal hubs into one function, halving the rows pass by pass."""
    while len(hubs) > 1:
        starts = np.flatnonzero(np.r_[True, hubs[1:] != hubs[:-1]])
        lengths = np.diff(np.r_[starts, len(hubs)])
        if lengths.max() == 1:
            break
        place = np.arange(len(hubs)) - np.repeat(starts, lengths)
        left = np.flatnonzero(place % 2 == 0)
        paired = np.r_[hubs[1:] == hubs[:-1], False][left]
        merged = functions[left]
        merged[paired] = _compose(functions[left[paired]], functions[left[paired] + 1])
        hubs, functions = hubs[left], merged
    return hubs, functions


def _compose_stretch(batches: Iterator[pd.DataFrame], keys: tuple[str, ...] = ("hub_id",)) -> Iterator[pd.DataFrame]:
    """Compose the sorted rows of one partition by runs of equal keys, holding one Arrow batch at a time."""
    columns = ["low", "high", "shift"]
    seq, held = 0, None  # held: the last run's key and function so far, the run may go on

    def out(key: np.ndarray, functions: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({**{k: key[:, i] for i, k in enumerate(keys)}, "stretch": stretch, "seq": np.arange(seq, seq + len(key)),
                             **{c: functions[:, i] for i, c in enumerate(columns)}})

    for batch in batches:
        if batch.empty:
            continue
        stretch = int(batch["stretch"].iloc[0])
        key = batch[list(keys)].to_numpy(np.int64)
        functions = batch[columns].to_numpy(np.int64)
        if held is not None:
            key, functions = np.vstack([held[0], key]), np.vstack([held[1], functions])
        begins = np.r_[True, (key[1:] != key[:-1]).any(axis=1)]
        runs, functions = _reduce_runs(np.cumsum(begins), functions)
        key = key[begins]
        held = (key[-1:], functions[-1:].copy())
        if len(runs) > 1:
            yield out(key[:-1], functions[:-1])
            seq += len(runs) - 1
    if held is not None:
        yield out(*held)


def compose_steps(functions: DataFrame, stretches: int | None = None, keys: tuple[str, ...] = ("hub_id",)) -> DataFrame:
    """At most one function per key (a hub) and range of the ordered steps.

    Rows are spread by key *and* order, so that the steps of a busy hub are composed by many
    tasks. Order ends in (seq, step), which tells all rows apart.
    """
    count = stretches or int(functions.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [*keys, "at", "seq", "step"]
    return (functions.repartitionByRange(count, *order)
            .sortWithinPartitions(*order)
            .select(*keys, F.spark_partition_id().alias("stretch"), "low", "high", "shift")
            .mapInPandas(partial(_compose_stretch, keys=keys), ", ".join(f"{k} bigint" for k in keys) + ", " + _STEP_SCHEMA))


def apply_composed(hubs: DataFrame, composed: DataFrame) -> DataFrame:
    """Hubs with ``new_load``: the composed functions of each hub applied in order.

    A hub's functions are one per range at most, so the list below is bounded by the number of
    partitions whatever the number of steps.
    """
    lists = composed.groupBy("hub_id").agg(F.array_sort(F.collect_list(
        F.struct("stretch", "seq", "low", "high", "shift"))).alias("_functions"))
    lists = lists.withColumnRenamed("hub_id", "id")
    load = F.col("current_load").cast("bigint")
    folded = F.aggregate(
        "_functions", F.coalesce(load, F.lit(0)),
        lambda x, f: F.least(f["high"], F.greatest(f["low"], x + f["shift"])))
    return (hubs.join(lists, "id", "left")
            .withColumn("new_load", F.coalesce(folded, load)).drop("_functions"))


def hub_load_fold(hubs: DataFrame, shipments: DataFrame, changes: DataFrame,
                  key: str = "shipment_id", status: str = "status",
                  order: tuple[str, ...] = ("event_datetime", "id")) -> DataFrame:
    """Hubs with the load they have after all changes, next to ``current_load`` before."""
    steps = load_steps(changes, shipments, key, status, order)
    return apply_composed(hubs, compose_steps(step_functions(steps, hubs)))
