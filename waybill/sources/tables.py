"""Scans and writes of entity tables with their declared schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waybill.schemas import schema_of

PARTITION_COLUMN = "created_date"


def read_entity(spark: SparkSession, table: str, path: str, format: str = "parquet",
                columns: list[str] | None = None, partitioned: bool = False) -> DataFrame:
    """Scan a table with its declared schema; no inference pass over the files.

    ``columns`` names the stored columns when the files hold only some of them. With
    ``partitioned`` the files lie under ``created_date=`` folders, which filters on that column
    prune.
    """
    fields = [f for f in schema_of(table).fields if columns is None or f.name in columns]
    if partitioned:
        fields = fields + [T.StructField(PARTITION_COLUMN, T.DateType())]
    reader = spark.read.schema(T.StructType(fields)).format(format)
    if format == "csv":
        reader = reader.option("header", True)
    return reader.load(path)


def read_tables(spark: SparkSession, folder: str, tables: list[str],
                format: str = "parquet") -> dict[str, DataFrame]:
    """Several tables, each in a sub-folder of its name."""
    return {name: read_entity(spark, name, f"{folder}/{name}", format) for name in tables}


def conform(df: DataFrame, table: str) -> DataFrame:
    """Cast the columns a table declares to their declared types, in declared order."""
    declared = [f for f in schema_of(table).fields if f.name in df.columns]
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in declared])


def write_entity(df: DataFrame, table: str, path: str, format: str = "parquet",
                 created: str | None = None, key: str = "id", mode: str = "errorifexists") -> None:
    """Write a table, laid out in folders by creation day when ``created`` names that column.

    Rows are ranged on day *and* key first: a task then holds few days, which keeps the files few,
    and a day with a large part of all rows is spread over many tasks.
    """
    out = conform(df, table)
    if created is not None:
        out = (out.withColumn(PARTITION_COLUMN, F.to_date(created))
               .repartitionByRange(PARTITION_COLUMN, key))
    writer = out.write.format(format).mode(mode)
    if format == "csv":
        writer = writer.option("header", True)
    if created is not None:
        writer = writer.partitionBy(PARTITION_COLUMN)
    writer.save(path)
