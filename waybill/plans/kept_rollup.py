"""The daily analytics kept up to date: sums per day and hub that take insertions and retractions.

Every measure of the rollup comes from sums over shipments. A change of a shipment takes its old row out of the sums of its day and
hub and puts the new one in, so a status change moves it from one count to another, and a new day of creation from one day to another.
The sums lie in a ``BucketTable`` by stretches of days: an epoch adds its signed differences, reading the changed shipments only.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from waybill.plans.reports import ROLLUP_SUMS, rollup_from_sums, rollup_sums
from waybill.streaming.buckets import BucketTable

_ROWS = "date date, hub_id bigint, " + ", ".join(
    f"{c} " + ("decimal(38,2)" if kind == "money" else "decimal(38,0)" if kind == "micros" else "bigint") for c, kind in ROLLUP_SUMS.items())
#: Where shipments without a day of creation lie.
_NO_DAY = -(1 << 30)


def _added(base: DataFrame, changes: DataFrame) -> DataFrame:
    every = base.unionByName(changes.select(*base.columns))
    kinds = {f.name: f.dataType for f in base.schema}
    sums = every.groupBy("date", "hub_id").agg(*[F.sum(c).cast(kinds[c]).alias(c) for c in ROLLUP_SUMS])
    return sums.where("total_shipments <> 0").select(*base.columns)


@dataclass
class KeptRollup:
    """The sums below ``folder``, by stretches of ``days`` days (the same at each start). Hub ids are integers."""

    spark: SparkSession
    folder: str
    days: int = 90

    @cached_property
    def table(self) -> BucketTable:
        rows = StructType.fromDDL(_ROWS)
        return BucketTable(self.spark, self.folder, rows, rows,
                           F.coalesce(F.floor(F.unix_date("date") / self.days), F.lit(_NO_DAY).cast("bigint")), _added)

    def _sums(self, shipments: DataFrame, sign: int = 1) -> DataFrame:
        kinds = {f.name: f.dataType for f in StructType.fromDDL(_ROWS)}
        sums = rollup_sums(shipments)
        return sums.select("date", F.col("hub_id").cast("bigint").alias("hub_id"), *[
            (F.lit(sign) * F.coalesce(c, F.lit(0))).cast(kinds[c]).alias(c) for c in ROLLUP_SUMS])

    def create(self, shipments: DataFrame) -> None:
        """Start from the shipments there are; sums that are there stay as they are."""
        self.table.create(self._sums(shipments))

    def change(self, before: DataFrame, after: DataFrame, epoch: int) -> None:
        """Take one batch of changes: the changed shipments as they were and as they are. New ones are in ``after`` only, deleted
        ones in ``before`` only. An epoch that is run again changes nothing."""
        both = self._sums(before, -1).unionByName(self._sums(after))
        moved = both.groupBy("date", "hub_id").agg(*[F.sum(c).alias(c) for c in ROLLUP_SUMS])
        something = F.lit(False)
        for c in ROLLUP_SUMS:
            something = something | (F.col(c) != 0)
        kinds = {f.name: f.dataType for f in StructType.fromDDL(_ROWS)}
        self.table.add(moved.where(something).select("date", "hub_id", *[F.col(c).cast(kinds[c]).alias(c) for c in ROLLUP_SUMS]), epoch)

    def read(self, hubs: DataFrame, days: Iterable[int] | None = None) -> DataFrame:
        """The rollup as ``daily_analytics_rollup`` has it. ``days`` (since 1970): only those, and only their buckets are read."""
        if days is None:
            return rollup_from_sums(self.table.read(), hubs)
        days = sorted(set(days))
        sums = self.table.read({d // self.days for d in days})
        return rollup_from_sums(sums.where(F.unix_date("date").isin(days)), hubs)
