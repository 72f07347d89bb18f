"""Steps whose result is written."""

import time

from pyspark.sql import functions as F

from waybill.session import checkpointed


def after(seconds, kept):
    def run(batches):
        time.sleep(seconds)
        yield from (batch for batch in batches if kept)
    return run


def test_a_step_leaves_no_job_behind(spark):
    """One side of a join turns out empty, so adaptive execution is done while the other still runs; its job ends with the step."""
    slow = spark.range(4).repartition(2, "id").mapInArrow(after(20, True), "id bigint").groupBy("id").agg(F.count("*").alias("n"))
    none = spark.range(0, 4, 1, 1).mapInArrow(after(3, False), "_id bigint").groupBy("_id").agg(F.count("*").alias("m"))
    tracker, began = spark.sparkContext.statusTracker(), time.time()
    assert checkpointed(slow.hint("merge").join(none, F.col("id") == F.col("_id"))).count() == 0
    while tracker.getActiveJobsIds() and time.time() < began + 15:
        time.sleep(0.1)
    assert time.time() < began + 15
