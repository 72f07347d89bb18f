"""Row order within a key: position, previous value and latest known value.

A window over the key puts all rows of a key into one task. That is right for usual keys and
wrong for a key that holds a large part of the table, so ``along`` looks at the largest key first:

* every key fits a task: one plain window;
* some key does not: rows are range-partitioned on key *and* order, which spreads a large key over
  many tasks, the window runs inside each range, and the end of every range (one row per range) is
  carried into the next.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from waybill.session import checkpointed

ROWS_PER_TASK = 1_000_000
# Ends of ranges are one row each and are broadcast: this bounds them.
MOST_RANGES = 100_000


def group_sizes(df: DataFrame, keys: list[str]) -> tuple[int, int]:
    """Row count of the largest key and of all; counts are combined before the shuffle."""
    counts = df.groupBy(*keys).count()
    row = counts.agg(F.max("count").alias("largest"), F.sum("count").alias("total")).first()
    return row["largest"] or 0, row["total"] or 0


def along(df: DataFrame, keys: list[str], order: list[str], value: str | None = None,
          rows_per_task: int = ROWS_PER_TASK, ranges: int | None = None) -> DataFrame:
    """Add ``position`` (from 1), ``previous`` and ``latest`` along ``order`` within ``keys``.

    ``previous`` is ``value`` of the row before, ``latest`` the last non-NULL ``value`` up to and
    including the row. ``order`` must tell all rows of a key apart.
    """
    largest, total = group_sizes(df, keys)
    if largest <= rows_per_task:
        return df.withColumns(_window_columns(W.partitionBy(*keys).orderBy(*order), value))
    if ranges is None:
        usual = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        ranges = min(max(usual, -(-total // rows_per_task)), MOST_RANGES)
    return _along_ranges(df, keys, order, value, ranges)


def _window_columns(window, value: str | None) -> dict[str, Column]:
    columns = {"position": F.row_number().over(window).cast("bigint")}
    if value is not None:
        so_far = window.rowsBetween(W.unboundedPreceding, W.currentRow)
        columns["previous"] = F.lag(value).over(window)
        columns["latest"] = F.last(value, ignorenulls=True).over(so_far)
    return columns


def _along_ranges(df: DataFrame, keys: list[str], order: list[str], value: str | None,
                  ranges: int) -> DataFrame:
    ranged = (df.repartitionByRange(ranges, *keys, *order)
                .withColumn("_range", F.spark_partition_id()))
    inside = ranged.withColumns(_window_columns(
        W.partitionBy("_range", *keys).orderBy(*order), value))
    # The range limits are drawn from a sample: write the rows once, so that every reader below
    # sees the same ranges, whatever is computed again.
    inside = checkpointed(inside)

    carried = ["position"] + (["latest", value] if value is not None else [])
    end = F.max_by(F.struct(F.struct(*keys).alias("key"),
                            *[F.col(c).alias(f"c{i}") for i, c in enumerate(carried)]),
                   F.struct(*keys, *order))
    ends = inside.groupBy("_range").agg(end.alias("end"))  # one row per range
    same_key = (W.partitionBy("end.key").orderBy("_range")
                .rowsBetween(W.unboundedPreceding, W.currentRow))
    ends = ends.withColumn("rows_before", F.sum("end.c0").over(same_key))
    carry = [F.col("end.key").alias("_key"), F.col("rows_before").alias("_rows")]
    if value is not None:
        ends = ends.withColumn("known", F.last("end.c1", ignorenulls=True).over(same_key))
        carry += [F.col("known").alias("_known"), F.col("end.c2").alias("_last")]
    ends = ends.select("_range", F.lag(F.struct(*carry)).over(W.orderBy("_range")).alias("_carry"))

    # ``ends`` has one row per range, MOST_RANGES at most, so it is small whatever the data.
    joined = inside.join(F.broadcast(ends), "_range", "left")
    goes_on = F.coalesce(F.struct(*keys).eqNullSafe(F.col("_carry._key")), F.lit(False))
    columns = {"position": F.col("position")
               + F.when(goes_on, F.col("_carry._rows")).otherwise(F.lit(0))}
    if value is not None:
        first = F.col("position") == 1
        columns["previous"] = F.when(goes_on & first, F.col("_carry._last")).otherwise(F.col("previous"))
        columns["latest"] = F.coalesce(F.col("latest"), F.when(goes_on, F.col("_carry._known")))
    return joined.withColumns(columns).drop("_range", "_carry")
