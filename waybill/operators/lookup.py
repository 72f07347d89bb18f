"""Filters, lookups by key, and pages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from waybill.functions.expressions import timestamp
from waybill.sources.tables import PARTITION_COLUMN


# --- filters -----------------------------------------------------------------------------------

def filter_status(df: DataFrame, status: str | None = None) -> DataFrame:
    return df if status is None else df.where(F.col("status") == status)


def filter_recent(df: DataFrame, column: str, as_of: str, days: int,
                  whole_days: bool = True) -> DataFrame:
    """Rows from ``days`` before ``as_of`` on, counted from midnight or from the exact time.

    The bound folds to one literal, which reaches the parquet scan. Where the table lies in folders
    by creation day, older folders are not even listed.
    """
    end = timestamp(as_of)
    if whole_days:
        end = F.to_date(end).cast("timestamp_ntz")
    bound = end - F.make_dt_interval(F.lit(days))
    recent = df.where(F.col(column) >= bound)
    if column == "created_at" and PARTITION_COLUMN in df.columns:
        recent = recent.where(F.col(PARTITION_COLUMN) >= F.to_date(bound))
    return recent


def filter_delivered_complete(df: DataFrame, pickup: str = "pickup_date",
                              delivery: str = "actual_delivery") -> DataFrame:
    return df.where((F.col("status") == "delivered") & F.col(pickup).isNotNull()
                    & F.col(delivery).isNotNull())


# --- lookups -----------------------------------------------------------------------------------

def taken_keys(candidates: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """The distinct candidate keys the existing rows hold.

    An inner join, so that Spark may send the usually few candidates to the large table instead of
    shuffling that; NULL keys match nothing.
    """
    wanted = candidates.select(*keys).distinct()
    return existing.select(*keys).join(wanted, keys).distinct()


def lookup(keys: DataFrame, rows: DataFrame, by: list[str], key: str = "key", tie: str = "id") -> DataFrame:
    """For each distinct key, the row that has it in one of the ``by`` columns.

    A match in an earlier column wins, then the lowest ``tie``, which tells all rows apart. Each row offers
    the values of its ``by`` columns to one equi-join (a join on a disjunction would compare every key with every row);
    only these columns and ``tie`` are read to find it, and the rows found are joined once.
    """
    wanted = keys.select(key).where(F.col(key).isNotNull()).distinct()
    kind = keys.schema[key].dataType
    offers = [F.struct(F.lit(i).alias("place"), F.col(c).cast(kind).alias("value")) for i, c in enumerate(by)]
    offered = (rows.select(F.explode(F.array(*offers)).alias("_offer"), F.col(tie).alias("_tie"))
               .where("_offer.value is not null")
               .select(F.col("_offer.value").alias(key), F.col("_offer.place").alias("_place"), "_tie"))
    found = (offered.join(wanted, key).groupBy(key)
             .agg(F.min(F.struct("_place", "_tie"))["_tie"].alias("_found")))
    return found.join(rows, F.col("_found") == F.col(tie)).select(key, *rows.columns)


def lookup_shipment(keys: DataFrame, shipments: DataFrame) -> DataFrame:
    return lookup(keys, shipments, ["id", "tracking_number"])


def lookup_hub(keys: DataFrame, hubs: DataFrame) -> DataFrame:
    return lookup(keys, hubs, ["id", "code"])


def lookup_user_email(keys: DataFrame, users: DataFrame) -> DataFrame:
    return lookup(keys, users, ["email"])


def insert_ignore(existing: DataFrame, incoming: DataFrame, keys: list[str],
                  ordinal: str = "ordinal") -> DataFrame:
    """The incoming rows to append: keys that exist, or came earlier in the batch, are left out.

    NULL keys never collide.
    """
    open_key = reduce(Column.__or__, [F.col(k).isNull() for k in keys])
    fields = [c for c in incoming.columns if c not in keys]
    first = (incoming.groupBy(*keys, F.when(open_key, F.col(ordinal)).alias("_own"))
             .agg(F.min_by(F.struct(*fields), ordinal).alias("_row"))
             .select(*keys, "_row.*"))
    return first.join(taken_keys(incoming, existing, keys), keys, "left_anti").select(*incoming.columns)


# --- pages -------------------------------------------------------------------------------------

def newest_first(created: str = "created_at", tie: str = "id") -> list[Column]:
    return [F.col(created).desc(), F.col(tie).asc()]


def page_newest(df: DataFrame, skip: int = 0, limit: int = 50, created: str = "created_at",
                tie: str = "id") -> DataFrame:
    """One page, newest first. For pages far down use ``page_after``: a page costs skip + limit."""
    return df.orderBy(*newest_first(created, tie)).offset(skip).limit(limit)


def page_after(df: DataFrame, last_created: str, last_id, limit: int = 50,
               created: str = "created_at", tie: str = "id") -> DataFrame:
    """The page behind the given last row, whatever its depth: the bound is pushed to the scan."""
    bound = timestamp(last_created)
    older = (F.col(created) < bound) | ((F.col(created) == bound) & (F.col(tie) > last_id))
    return (df.where(F.col(created) <= bound).where(older)
            .orderBy(*newest_first(created, tie)).limit(limit))


def latest_n(df: DataFrame, count: int = 50, created: str = "created_at", tie: str = "id") -> DataFrame:
    return page_newest(df, 0, count, created, tie)


def row_total(df: DataFrame) -> Column:
    """The number of rows as a scalar subquery."""
    return df.agg(F.count(F.lit(1))).scalar()


def page_rows(df: DataFrame, skip: int = 0, limit: int = 50, created: str = "created_at",
              tie: str = "id") -> DataFrame:
    """A page with the envelope's ``total``, ``skip`` and ``limit`` on every row."""
    return page_newest(df, skip, limit, created, tie).select(
        "*", row_total(df).alias("total"), F.lit(skip).alias("skip"), F.lit(limit).alias("limit"))


def page_envelope(df: DataFrame, name: str, skip: int = 0, limit: int = 50,
                  created: str = "created_at", tie: str = "id") -> DataFrame:
    """The page as one row: ``name`` (array of rows in order), ``total``, ``skip``, ``limit``."""
    page = page_newest(df, skip, limit, created, tie)
    # The window runs over one page only.
    placed = page.select(F.row_number().over(W.orderBy(*newest_first(created, tie))).alias("place"),
                         F.struct(*df.columns).alias("row"))
    items = F.transform(F.array_sort(F.collect_list(F.struct("place", "row"))), lambda x: x["row"])
    return placed.agg(items.alias(name)).select(
        name, row_total(df).alias("total"), F.lit(skip).alias("skip"), F.lit(limit).alias("limit"))
