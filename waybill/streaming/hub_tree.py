"""Hub loads that follow a stream of status events in any order of arrival.

A hub's load is what its steps make of the load it had at first, in the order of events (see ``operators.hub_load``). Steps are clamp
functions, and so is what any number of them in a row do. They are kept as a tree per hub: a leaf composes the steps of one day, a node
above composes ``FANOUT`` neighbours below, and the root is the whole history. A late event changes the steps of a day or two; their
leaves are composed anew and the nodes on the way to the root, nothing else.

Stored below one folder, each a ``BucketTable``, each epoch taken in this order:

* ``log``: all events with a time and a status, by hash of the shipment. Read only for shipments that have late events: their changes
  are found anew, and the difference goes on as new and revoked steps.
* ``steps``: the steps with a sign, by day.
* ``tree``: the nodes, by level and time.
* ``last``: the last event of each shipment, by its hash. The others' changes are found from it with ``along``, which shares out the
  rows of a busy shipment.

An epoch that failed on the way goes on where it stopped: what it has written stays, and ``last``, by which all is found, comes last.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from waybill.operators.hub_load import compose_steps, load_steps, status_changes, step_functions
from waybill.session import checkpointed
from waybill.streaming.buckets import EPOCH, BucketTable, appended, hashed, latest
from waybill.streaming.store import write_epoch

FANOUT, LEVELS = 256, 2  # 256^2 days
_DAY = 86_400_000_000
_NO_LIMIT = 1 << 60
_EVENT = "shipment_id bigint, at bigint, id bigint, status string"
_STEP = "hub_id bigint, at bigint, seq bigint, step int, low bigint, high bigint, shift bigint"
_NODE = "level int, hub_id bigint, place bigint, low bigint, high bigint, shift bigint"


def _schema(text: str) -> StructType:
    return StructType.fromDDL(text)


def _node_bucket(level: Column, place: Column) -> Column:
    """Nodes with one parent time lie together; a level has room for 2^32 of them, from 2^31 before 1970."""
    return (level.cast("bigint") * F.lit(1 << 33)) + F.floor(place / FANOUT) + F.lit(1 << 32)


def _net(base: DataFrame, changes: DataFrame) -> DataFrame:
    """Steps that are there after all revocations."""
    every = base.unionByName(changes.drop(EPOCH))
    columns = [c for c in base.columns if c != "sign"]
    return every.groupBy(*columns).agg(F.sum("sign").cast("int").alias("sign")).where("sign <> 0").select(*base.columns)


def _composed(functions: str) -> Column:
    """The functions of an ordered list, one after another, as one (low, high, shift)."""
    none = F.struct(F.lit(-_NO_LIMIT).alias("low"), F.lit(_NO_LIMIT).alias("high"), F.lit(0).cast("bigint").alias("shift"))

    def then(first: Column, f: Column) -> Column:
        return F.struct(*[F.least(f["high"], F.greatest(f["low"], first[side] + f["shift"])).alias(side) for side in ("low", "high")],
                        (first["shift"] + f["shift"]).alias("shift"))
    return F.aggregate(functions, none, then)


@dataclass
class HubTree:
    """The tables, and what they are made for: the hubs with their first loads, the stored shipments (whose hubs and package
    counts don't change) and their statuses before the first event."""

    spark: SparkSession
    folder: str
    hubs: DataFrame
    shipments: DataFrame | None = None
    initial: DataFrame | None = None
    buckets: int = 32

    # --- tables ---

    @cached_property
    def log(self) -> BucketTable:
        return BucketTable(self.spark, f"{self.folder}/log", _schema(f"{_EVENT}, {EPOCH} bigint"), _schema(_EVENT),
                           hashed("shipment_id", self.buckets), appended)

    @cached_property
    def last(self) -> BucketTable:
        return BucketTable(self.spark, f"{self.folder}/last", _schema(_EVENT), _schema(_EVENT),
                           hashed("shipment_id", self.buckets), latest(["shipment_id"], ["at", "id"]))

    @cached_property
    def steps(self) -> BucketTable:
        return BucketTable(self.spark, f"{self.folder}/steps", _schema(f"{_STEP}, sign int"), _schema(f"{_STEP}, sign int"),
                           F.floor(F.col("at") / _DAY), _net)

    @cached_property
    def tree(self) -> BucketTable:
        return BucketTable(self.spark, f"{self.folder}/tree", _schema(_NODE), _schema(_NODE),
                           _node_bucket(F.col("level"), F.col("place")), latest(["level", "hub_id", "place"], []))

    def create(self) -> None:
        for table in (self.log, self.steps, self.tree, self.last):
            table.create(self.spark.createDataFrame([], table.rows))

    # --- an epoch ---

    def fold(self, batch: DataFrame, epoch: int) -> None:
        """Take the events of one epoch (shipment_id, at in microseconds, id, status)."""
        if self.last.version() >= epoch:
            return
        rows = checkpointed(batch.select("shipment_id", "at", "id", "status"))
        buckets = [r[0] for r in rows.select(hashed("shipment_id", self.buckets)).distinct().collect()]
        before = self.last.read(buckets).select("shipment_id", F.struct("at", "id").alias("_last"), F.col("status").alias("_status"))
        marked = checkpointed(rows.join(before, "shipment_id", "left").withColumn(
            "late", F.coalesce(F.struct("at", "id") <= F.col("_last"), F.lit(False))))
        write_epoch(marked.where("late").select("shipment_id", "at", "id", "status"), f"{self.folder}/late", epoch)
        self.log.add(rows, epoch)
        changes = checkpointed(self._changes(marked, epoch))
        self._take_steps(changes, epoch)
        ends = rows.groupBy("shipment_id").agg(F.max_by(F.struct("at", "id", "status"), F.struct("at", "id")).alias("_row"))
        self.last.add(ends.select("shipment_id", "_row.*"), epoch)

    def _status_changes(self, events: DataFrame, before: DataFrame | None) -> DataFrame:
        return status_changes(events, order=("at", "id"), initial=before).select("shipment_id", "at", "id", "status")

    def _changes(self, marked: DataFrame, epoch: int) -> DataFrame:
        """Status changes the epoch adds (sign 1) and revokes (-1)."""
        disturbed = marked.where("late").select("shipment_id").distinct()
        calm = marked.join(disturbed, "shipment_id", "left_anti")
        known = calm.where("_last is not null").select("shipment_id", F.col("_status").alias("old_status")).distinct()
        if self.initial is not None:
            fresh = calm.where("_last is null").select("shipment_id").distinct()
            known = known.unionByName(self.initial.select("shipment_id", "old_status").join(fresh, "shipment_id"))
        added = self._status_changes(calm.select("shipment_id", "at", "id", "status"), known).withColumn("sign", F.lit(1))
        if disturbed.isEmpty():
            return added
        initial = None if self.initial is None else self.initial.join(disturbed, "shipment_id", "left_semi")
        buckets = [r[0] for r in disturbed.select(hashed("shipment_id", self.buckets)).distinct().collect()]
        log = checkpointed(self.log.read(buckets).join(disturbed, "shipment_id", "left_semi"))
        old = self._status_changes(log.where(F.col(EPOCH) < epoch).drop(EPOCH), initial)
        new = self._status_changes(log.where(F.col(EPOCH) <= epoch).drop(EPOCH), initial)
        moved = (new.withColumn("sign", F.lit(1)).unionByName(old.withColumn("sign", F.lit(-1)))
                 .groupBy("shipment_id", "at", "id", "status").agg(F.sum("sign").cast("int").alias("sign")).where("sign <> 0"))
        return added.unionByName(moved)

    def _take_steps(self, changes: DataFrame, epoch: int) -> None:
        low, high = changes.agg(F.min("shipment_id"), F.max("shipment_id")).first()
        # The bounds reach the scan, which skips the rest of a table written in the order of ids.
        shipments = self.shipments.where("false") if low is None else self.shipments.where(F.col("id").between(low, high))
        signed = [step_functions(load_steps(changes.where(F.col("sign") == s), shipments, order=("at", "id")), self.hubs)
                  .withColumn("sign", F.lit(s)) for s in (1, -1)]
        steps = checkpointed(signed[0].unionByName(signed[1]).select(*self.steps.changes.names))
        self.steps.add(steps, epoch)
        if self.tree.version() >= epoch:
            return
        day = F.floor(F.col("at") / _DAY)
        touched = checkpointed(steps.select("hub_id", day.alias("place")).distinct())
        days = [r[0] for r in touched.select("place").distinct().collect()]
        here = self.steps.read(days).withColumn("place", day).join(touched, ["hub_id", "place"], "left_semi").where("sign > 0")
        lists = (compose_steps(here, keys=("hub_id", "place")).groupBy("hub_id", "place")
                 .agg(F.array_sort(F.collect_list(F.struct("stretch", "seq", "low", "high", "shift"))).alias("_functions")))
        # A day whose steps were all revoked does nothing.
        leaves = touched.join(lists, ["hub_id", "place"], "left").withColumn("_functions", F.coalesce(
            "_functions", F.array().cast("array<struct<stretch:int,seq:bigint,low:bigint,high:bigint,shift:bigint>>")))
        nodes = checkpointed(leaves.select(F.lit(0).alias("level"), "hub_id", "place", _composed("_functions").alias("_f"))
                             .select("level", "hub_id", "place", "_f.*"))
        every = nodes
        for level in range(LEVELS):
            above = F.floor(F.col("place") / FANOUT)
            buckets = [r[0] for r in nodes.select(_node_bucket(F.col("level"), F.col("place"))).distinct().collect()]
            parents = nodes.select("hub_id", above.alias("parent")).distinct()
            below = (self.tree.read(buckets, nodes.withColumn(EPOCH, F.lit(epoch).cast("bigint"))).where(F.col("level") == level)
                     .withColumn("parent", above).join(parents, ["hub_id", "parent"], "left_semi"))
            lists = below.groupBy("hub_id", "parent").agg(
                F.array_sort(F.collect_list(F.struct("place", "low", "high", "shift"))).alias("_functions"))
            nodes = checkpointed(lists.select(F.lit(level + 1).alias("level"), "hub_id", F.col("parent").alias("place"),
                                              _composed("_functions").alias("_f")).select("level", "hub_id", "place", "_f.*"))
            every = every.unionByName(nodes)
        self.tree.add(every, epoch)

    # --- results ---

    def loads(self) -> DataFrame:
        """The hubs with the load after all events so far as ``current_load``."""
        roots = self.tree.read([(LEVELS << 33) + (1 << 32) + k for k in (-1, 0)]).where(F.col("level") == LEVELS)
        # Places before 1970 and those after have a root each.
        lists = roots.groupBy(F.col("hub_id").alias("id")).agg(
            F.array_sort(F.collect_list(F.struct("place", "low", "high", "shift"))).alias("_functions"))
        kind, load = self.hubs.schema["current_load"].dataType, F.col("current_load").cast("bigint")
        after = F.aggregate("_functions", F.coalesce(load, F.lit(0)),
                            lambda x, f: F.least(f["high"], F.greatest(f["low"], x + f["shift"])))
        return self.hubs.join(lists, "id", "left").withColumn(
            "current_load", F.coalesce(after, load).cast(kind)).select(*self.hubs.columns)
