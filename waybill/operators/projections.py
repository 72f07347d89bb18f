"""Column sets of the listings, and renames between snake_case and camelCase."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waybill.functions.expressions import money_to_double, to_camel, to_snake

LISTING = [
    "id", "tracking_number", "sender_name", "sender_phone", "sender_address", "receiver_name",
    "receiver_phone", "receiver_address", "package_details", "weight", "dimensions",
    "service_type", "cost", "status", "created_at", "updated_at",
]


def _present(df: DataFrame, names: list[str]) -> list[str]:
    return [n for n in names if n in df.columns]


def project_listing(documents: DataFrame) -> DataFrame:
    """The sixteen listing columns (those the table has), money as doubles."""
    listed = documents.select(*_present(documents, LISTING))
    return listed.withColumns({c: money_to_double(c) for c in _present(listed, ["weight", "cost"])})


def project_detail(documents: DataFrame) -> DataFrame:
    """The listing with the event history; a missing history is an empty one."""
    detail = documents.select(*_present(documents, LISTING), F.coalesce("events", F.array()).alias("events"))
    return detail.withColumns({c: money_to_double(c) for c in _present(detail, ["weight", "cost"])})


def project_hub(hubs: DataFrame) -> DataFrame:
    return hubs.select("id", "name", "location", "capacity", "created_at")


def project_user(users: DataFrame) -> DataFrame:
    """Users as shown: no password hash, and no phone or hub, which the table does not hold."""
    shown = ["id", F.col("full_name").alias("name"), "email", "role",
             F.lit(None).cast("string").alias("phone"), F.lit(None).cast("string").alias("hub_id")]
    return users.select(*shown, *_present(users, ["is_active", "created_at"]))


def to_camel_case(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({c: to_camel(c) for c in df.columns})


def to_snake_case(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({c: to_snake(c) for c in df.columns})
