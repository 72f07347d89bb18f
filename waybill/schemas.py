"""Declared schemas as StructTypes."""

from __future__ import annotations

from functools import cache

from pyspark.sql import types as T

from waybill import fixed


@cache
def schema_of(table: str) -> T.StructType:
    """The declared schema of a table (needs a running Spark session to parse)."""
    return T.StructType.fromDDL(fixed.TABLES[table])


def required_columns(table: str) -> list[str]:
    return [f.name for f in schema_of(table).fields if not f.nullable]


def column_type(table: str, column: str) -> T.DataType:
    return schema_of(table)[column].dataType
