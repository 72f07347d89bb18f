"""Unique tracking numbers for whole batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from waybill import fixed
from waybill.functions.expressions import tracking_base
from waybill.session import checkpointed

_BASE = len(fixed.TRACKING_PREFIX) + 8 + 4
_PLAIN = _BASE + 3


def _used_numbers(existing: DataFrame, bases: DataFrame, column: str) -> DataFrame:
    """Per base the counters in use (``_used``, ascending) and the next overflow number.

    Counters are three digits and the list is of distinct ones, so it holds at most 1000.
    """
    counter = F.substring(column, _BASE + 1, 3)
    # Suffixes follow the last counter; a longer tail than a number has is none of ours.
    overflow = F.substring(column, _PLAIN + 1, 18)
    ours = (counter == str(fixed.TRACKING_COUNTERS - 1)) & (F.length(column) <= _PLAIN + 18)
    numbers = (existing.select(F.substring(column, 1, _BASE).alias("_base"),
                               F.when(F.length(column) == _PLAIN, counter).alias("_counter"),
                               F.when((F.length(column) > _PLAIN) & ours, overflow).alias("_overflow"))
               .where(F.coalesce("_counter", "_overflow").rlike("^[0-9]+$"))
               .join(bases, "_base", "left_semi"))
    # Reduced to distinct counters first, so that a base many rows share is small when collected.
    distinct = numbers.groupBy("_base", F.col("_counter").cast("int").alias("_counter")).agg(
        F.max(F.col("_overflow").try_cast("bigint")).alias("_overflow"))
    return distinct.groupBy("_base").agg(
        F.array_sort(F.collect_list("_counter")).alias("_used"),
        F.coalesce(F.max("_overflow") + 1, F.lit(0)).alias("_next_overflow"))


def _nth_free(position: Column, used: Column) -> Column:
    """The counter that stands at ``position`` (from 0) among those not in ``used``.

    The used counter at place i has ``used[i] - i`` free ones before it; every one with no more
    than ``position`` of them pushes the answer up by one.
    """
    free_before = F.transform(used, lambda counter, place: counter - place)
    return position + F.size(F.filter(free_before, lambda free: free <= position))


def in_base_order(rows: DataFrame, base: Column, order: list[str], ranges: int | None = None) -> DataFrame:
    """The rows written once in ranges of base and ``order``, so that a base many rows share is spread over tasks.

    ``_base`` is the base (NULL: the row takes no number) and ``_place`` its place: range and row within it.
    """
    based = rows.withColumn("_base", base)
    keys = ["_base", *order]
    ranged = based.repartitionByRange(*keys) if ranges is None else based.repartitionByRange(ranges, *keys)
    placed = ranged.sortWithinPartitions(*keys).withColumn("_place", F.monotonically_increasing_id())
    # The limits of ranges are drawn from a sample: written once, all readers see the same ones.
    return checkpointed(placed)


def with_numbers(placed: DataFrame, existing: DataFrame, name: str = "tracking_number") -> DataFrame:
    """The rows of ``in_base_order`` that have a base, each with its number.

    Only one row per base and range is joined to them: where the base begins in the range, how many rows came in
    the ranges before, and the counters already in use.
    """
    numbered = placed.where(F.col("_base").isNotNull()).withColumn("_range", F.shiftright("_place", 33))
    before = W.partitionBy("_base").orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    starts = (numbered.groupBy("_range", "_base").agg(F.min("_place").alias("_start"), F.count(F.lit(1)).alias("_rows"))
              .withColumn("_before", F.coalesce(F.sum("_rows").over(before), F.lit(0))).drop("_rows"))
    taken = _used_numbers(existing, numbered.select("_base").distinct(), name)
    starts = starts.join(taken, "_base", "left")
    used = F.coalesce("_used", F.array().cast("array<int>"))
    place = F.col("_place") - F.col("_start") + F.col("_before")
    free_count = F.lit(fixed.TRACKING_COUNTERS) - F.size(used)
    plain = _nth_free(place.cast("int"), used).cast("string")
    suffix = (place - free_count + F.coalesce("_next_overflow", F.lit(0))).cast("string")
    number = F.when(place < free_count, F.concat("_base", F.lpad(plain, 3, "0"))).otherwise(
        F.concat("_base", F.lit(str(fixed.TRACKING_COUNTERS - 1)),
                 F.lpad(suffix, F.greatest(F.lit(3), F.length(suffix)), "0")))
    helpers = ["_base", "_range", "_place", "_start", "_before", "_used", "_next_overflow"]
    return numbered.drop(name).join(starts, ["_range", "_base"]).withColumn(name, number).drop(*helpers)


def assign_tracking(new: DataFrame, existing: DataFrame, created: str = "created_at",
                    order: list[str] | None = None, name: str = "tracking_number",
                    ranges: int | None = None) -> DataFrame:
    """Give every new row a tracking number that no other row, new or existing, has.

    Rows created in the same second share a base; in ``order`` they take the free three-digit
    counters of that base. Once those run out, numbers go on with a running suffix behind the last
    counter. A row without a time of creation has no base and gets NULL. ``ranges`` fixes the number of tasks, else
    Spark chooses it.
    """
    base = F.coalesce(tracking_base(created), F.lit(""))
    placed = in_base_order(new.drop(name), base, order or ["ordinal"], ranges)
    numbered = with_numbers(placed, existing, name)
    return numbered.withColumn(name, F.when(F.col(created).isNotNull(), F.col(name)))
