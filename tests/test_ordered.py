"""Order within a key: the spread-out way must give what one window gives."""

import pytest
from pyspark.sql import functions as F

from waybill.functions import expressions as X
from waybill.operators.ordered import along, group_sizes
from waybill.operators.tracking import assign_tracking


def events(spark, hot_share=3):
    """A third of the rows (or all) on one key; values with gaps; some NULL keys."""
    n = F.col("id")
    return spark.range(3000).select(
        F.when(n % hot_share == 0, F.lit(7)).when(n % 31 == 0, F.lit(None)).otherwise(n % 40).alias("k"),
        (n % 100).alias("t"), n.alias("seq"),
        F.when(n % 4 != 0, F.concat(F.lit("v"), (n % 5).cast("string"))).alias("v"))


@pytest.mark.parametrize("hot_share", [3, 1])
@pytest.mark.parametrize("ranges", [1, 5, 40])
def test_ranges_equal_one_window(spark, hot_share, ranges):
    df = events(spark, hot_share)
    plain = along(df, ["k"], ["t", "seq"], "v")
    spread = along(df, ["k"], ["t", "seq"], "v", rows_per_task=10, ranges=ranges)
    assert spread.columns == plain.columns
    assert plain.exceptAll(spread).count() == 0
    assert spread.count() == plain.count() == 3000


def test_position_without_value(spark):
    df = events(spark).select("k", "t", "seq")
    spread = along(df, ["k"], ["t", "seq"], rows_per_task=10)
    assert along(df, ["k"], ["t", "seq"]).exceptAll(spread).count() == 0


def test_no_task_holds_the_hot_key(spark):
    df = events(spark, 1)
    # Adaptive execution would put so few rows back together.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        spread = along(df, ["k"], ["t", "seq"], "v", rows_per_task=10, ranges=20)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    sizes = [r["count"] for r in spread.groupBy(F.spark_partition_id()).count().collect()]
    assert group_sizes(df, ["k"]) == (3000, 3000)
    assert max(sizes) < 1500


def test_empty(spark):
    assert along(events(spark).limit(0), ["k"], ["t", "seq"], "v").count() == 0


@pytest.mark.parametrize("ranges", [None, 1, 7])
def test_tracking_is_unique_and_fills_the_gaps(spark, ranges):
    at = X.timestamp("2024-01-02 03:04:05")
    new = spark.range(2500).select(F.col("id").alias("ordinal"), at.alias("created_at"))
    taken = [0, 1, 5, 998]
    existing = spark.createDataFrame(
        [(f"BC202401024645{c:03d}",) for c in taken] + [("BC202401024645999017",), ("TN123",), (None,)],
        "tracking_number string")
    out = {r["ordinal"]: r["tracking_number"]
           for r in assign_tracking(new, existing, ranges=ranges).collect()}
    free = [c for c in range(1000) if c not in taken]
    for k, counter in enumerate(free):
        assert out[k] == f"BC202401024645{counter:03d}"
    # Overflow goes on behind the suffix that is in use, and beyond three digits.
    assert out[len(free)] == "BC202401024645999018"
    assert out[2499] == f"BC202401024645999{18 + 2499 - len(free)}"
    everything = list(out.values()) + [r[0] for r in existing.collect()]
    assert len(set(everything)) == len(everything)
    assert new.count() == len(out)


def test_tracking_by_base(spark):
    new = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (2, "2024-01-01 00:00:01"), (3, "2024-01-01 00:00:00")],
                                "ordinal int, at string").select("ordinal", F.col("at").cast("timestamp_ntz").alias("created_at"))
    existing = new.where("false").select(F.lit("").alias("tracking_number"))
    out = {r["ordinal"]: r["tracking_number"] for r in assign_tracking(new, existing).collect()}
    assert out[1][-3:] == "000" and out[3][-3:] == "001" and out[2][-3:] == "000"
    assert out[1][:14] == out[3][:14] != out[2][:14]
