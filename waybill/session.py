"""Session settings, and the shared folder for tables written along the way."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a skewed join even where that costs one more shuffle.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def build_session(app: str = "waybill", master: str | None = None, **settings) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**_SETTINGS, **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach, as named by ``spark.checkpoint.dir``.

    Only a session on one machine may go without: it gets a temporary folder of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        folder = tempfile.mkdtemp(prefix="waybill-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def fresh_folder(spark: SparkSession, name: str) -> str:
    """An unused path below the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """What is run in here leaves no shuffle files behind; for steps whose result is written.

    Adaptive execution may be done while jobs it no longer needs (the other side of a join with nothing) still run. They end
    with the step: their tasks would wait for shuffle files that are gone.
    """
    name, interrupt, tag = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "spark.job.interruptOnCancel", uuid.uuid4().hex
    context = spark.sparkContext
    before, interrupted = spark.conf.get(name, None), context.getLocalProperty(interrupt)
    spark.conf.set(name, "true")
    context.setInterruptOnCancel(True)
    context.addJobTag(tag)
    try:
        yield
    finally:
        context.cancelJobsWithTag(tag)
        context.removeJobTag(tag)
        context.setLocalProperty(interrupt, interrupted)
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def checkpointed(df: DataFrame) -> DataFrame:
    """Write the rows to the shared folder once and go on from there."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    with shuffles_removed(df.sparkSession):
        return df.select("*").checkpoint()
