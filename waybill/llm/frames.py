"""Small helpers shared by the operators: words, uniform numbers, files written along the way."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waybill.session import checkpointed, shuffles_removed

#: A word is a run of anything but the ASCII white space characters.
WORD = r"[^\x20\x09-\x0D]+"

__all__ = ["WORD", "checkpointed", "kept_at", "named", "read", "uniform", "unpacked", "whole", "word_count"]


def read(spark, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def kept_at(df: DataFrame, folder: str, **options) -> DataFrame:
    """The rows, written to a folder and read again; what lay there before goes, and so do the shuffle files of this step.

    ``options``: of the writer.
    """
    spark = df.sparkSession
    with shuffles_removed(spark):
        df.write.mode("overwrite").options(**options).parquet(folder)
    return spark.read.parquet(folder)


def word_count(text: Column) -> Column:
    """Number of words; 0 for NULL."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("bigint")


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) that depends on the parts alone, so that a task that runs again agrees."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11) / F.lit(float(2 ** 53))


def named(column: str) -> Column:
    """The column of that name, whatever characters it has."""
    return F.col("`" + column.replace("`", "``") + "`")


def whole(columns: list[str], alias: str = "row") -> Column:
    """The named columns as one struct, so that no name of theirs meets one of an operator's."""
    return F.struct(*[named(c) for c in columns] or [F.lit(None).cast("int").alias("none")]).alias(alias)


def unpacked(columns: list[str], alias: str = "row") -> list[Column]:
    """The columns out of ``whole``."""
    return [F.col(alias).getField(c).alias(c) for c in columns]
