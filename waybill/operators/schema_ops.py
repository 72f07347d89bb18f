"""Defaults, generated columns, schema changes and table descriptions."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waybill import fixed
from waybill.functions import expressions as X
from waybill.schemas import column_type, schema_of


def apply_defaults(df: DataFrame, table: str, as_of: Column, fill_nulls: bool = False,
                   identity: tuple[str, ...] = ("id",)) -> DataFrame:
    """Add the declared default of every absent column.

    As in SQL, an explicit NULL stays NULL unless ``fill_nulls``. Identifiers are derived from the
    ``identity`` columns.
    """
    added = {}
    for column, default in fixed.DEFAULTS.get(table, {}).items():
        present = column in df.columns
        if present and not fill_nulls:
            continue
        if default == fixed.AS_OF:
            value = as_of
        elif default == fixed.NEW_UUID:
            value = X.stable_uuid(F.lit(table), *identity)
        else:
            value = F.expr(default)
        value = value.cast(column_type(table, column))
        added[column] = F.coalesce(F.col(column), value) if present else value
    return df.withColumns(added) if added else df


def generated_columns(df: DataFrame, table: str) -> DataFrame:
    """(Re)compute the stored generated columns of a table."""
    derived = {
        "hubs": {"utilization_percentage": X.hub_utilization("current_load", "capacity")},
        "shipments": {
            "volume_m3": X.volume_m3("dimensions_length_cm", "dimensions_width_cm",
                                     "dimensions_height_cm"),
            "total_cost": X.total_cost("base_cost", "fuel_surcharge", "insurance_cost",
                                       "additional_fees"),
        },
        "daily_analytics": {"net_profit": X.net_profit("total_revenue", "total_costs")},
        "process_activities": {"duration_seconds": X.duration_seconds("started_at", "completed_at")},
    }.get(table)
    return df.withColumns(derived) if derived else df


def evolve_schema(df: DataFrame, add: Mapping[str, str], retype: Mapping[str, str] | None = None,
                  defaults: Mapping[str, Column] | None = None) -> DataFrame:
    """Add missing columns and change types; columns already there keep their values."""
    defaults = defaults or {}
    changes = {name: defaults.get(name, F.lit(None)).cast(kind)
               for name, kind in add.items() if name not in df.columns}
    changes |= {name: F.col(name).cast(kind) for name, kind in (retype or {}).items()}
    return df.withColumns(changes) if changes else df


def describe_table(df: DataFrame) -> DataFrame:
    """Column name, type and nullability in declared order."""
    rows = [(i, f.name, f.dataType.simpleString(), "YES" if f.nullable else "NO")
            for i, f in enumerate(df.schema.fields, start=1)]
    return df.sparkSession.createDataFrame(
        rows, "ordinal_position int, column_name string, data_type string, is_nullable string")


def empty_table(spark: SparkSession, table: str) -> DataFrame:
    return spark.createDataFrame([], schema_of(table))


def table_stats(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Row count per table."""
    counts = [df.agg(F.count(F.lit(1)).alias("row_count"))
                .select(F.lit(name).alias("table_name"), "row_count")
              for name, df in tables.items()]
    return reduce(DataFrame.unionByName, counts)


def sample_rows(df: DataFrame, count: int = 5) -> DataFrame:
    return df.limit(count)
