"""Results of micro-batches as parquet folders, one per epoch.

An epoch that is run again after a failure overwrites its own folder, so every epoch counts once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EPOCH = "epoch"


def epoch_folder(folder: str, epoch: int) -> str:
    return f"{folder}/{EPOCH}={epoch}"


def write_epoch(df: DataFrame, folder: str, epoch: int) -> None:
    df.write.mode("overwrite").parquet(epoch_folder(folder, epoch))


def epoch_writer(folder: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that keeps what each epoch put out."""
    return lambda batch, epoch: write_epoch(batch, folder, epoch)


def read_epochs(spark: SparkSession, folder: str) -> DataFrame:
    """All epochs, with the ``epoch`` column."""
    return spark.read.parquet(folder)


def latest_by_key(epochs: DataFrame, keys: list[str]) -> DataFrame:
    """For each key the row of its last epoch: the state an update stream has arrived at."""
    fields = [c for c in epochs.columns if c not in (*keys, EPOCH)]
    return (epochs.groupBy(*keys).agg(F.max_by(F.struct(*fields), EPOCH).alias("_row"))
            .select(*keys, "_row.*"))


def compact_latest(spark: SparkSession, folder: str, target: str, keys: list[str]) -> None:
    """Write what ``latest_by_key`` gives for ``folder`` as one epoch of ``target``, under the number of the last one.

    Nothing in ``folder`` changes, so this may be run again after a failure. To go on, stop the stream, compact, and
    start it with the same checkpoint and ``target``: later epochs follow there. The old folder is the caller's to remove.
    """
    epochs = read_epochs(spark, folder)
    last = epochs.agg(F.max(EPOCH)).first()[0]
    if last is not None:
        write_epoch(latest_by_key(epochs, keys), target, last)
