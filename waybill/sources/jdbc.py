"""Tables in a database, read in parallel slices and appended to."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Slices:
    """How to cut a table into parallel reads over a numeric, date or timestamp column.

    The bounds only place the cuts: rows outside them fall into the first or last slice.
    """

    column: str
    lower: str | int
    upper: str | int
    count: int


def read_options(url: str, table_or_query: str, slices: Slices | None = None,
                 fetch_size: int = 10_000, **more: str) -> dict[str, str]:
    """Reader options; a query is wrapped as a derived table so that it too can be sliced."""
    source = table_or_query.strip()
    if source.lower().startswith(("select ", "with ")):
        source = f"({source}) source_rows"
    options = {"url": url, "dbtable": source, "fetchsize": str(fetch_size)}
    if slices is not None:
        options |= {"partitionColumn": slices.column, "lowerBound": str(slices.lower),
                    "upperBound": str(slices.upper), "numPartitions": str(slices.count)}
    return options | more


def write_options(url: str, table: str, connections: int | None = None,
                  batch_size: int = 10_000, **more: str) -> dict[str, str]:
    options = {"url": url, "dbtable": table, "batchsize": str(batch_size)}
    if connections is not None:
        options["numPartitions"] = str(connections)
    return options | more


def read_jdbc(spark: SparkSession, url: str, table_or_query: str, slices: Slices | None = None,
              **more: str) -> DataFrame:
    """Read a table or query. Without ``slices`` one task reads it all: fine for small ones only."""
    return spark.read.format("jdbc").options(**read_options(url, table_or_query, slices, **more)).load()


def write_jdbc(df: DataFrame, url: str, table: str, mode: str = "append",
               connections: int | None = None, **more: str) -> None:
    """Write rows. ``connections`` bounds the parallel writers, to spare the database.

    Appending is not idempotent when a task runs twice: append into a staging table with a unique
    key and move the rows over with ``insert_ignore`` semantics there.
    """
    df.write.format("jdbc").mode(mode).options(**write_options(url, table, connections, **more)).save()
