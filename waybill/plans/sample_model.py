"""The logistics tables read out of the order/line/supplier test tables.

A shipment is an order, its hubs are the smallest and largest supplier of its lines; hubs are
suppliers, users are customers, shipment events are the events. All measures taken over the lines
of an order stay within their declared decimals however many lines an order has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waybill.functions import expressions as X

SHIPMENTS_AS_OF = "2001-08-01"
EVENTS_AS_OF = "2024-01-31"
EVENT_STATUS = {"signup": "accepted", "view": "in_transit", "click": "at_hub",
                "purchase": "delivered", "error": "failed_delivery"}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def chosen(column: str, values: dict[str, str], otherwise: Column) -> Column:
    picked = otherwise
    for key, value in values.items():
        picked = F.when(F.col(column) == key, F.lit(value)).otherwise(picked)
    return picked


def _hundredths(column: str) -> Column:
    """A two-digit amount as a whole number of hundredths; not for negative amounts."""
    return (F.col(column) * 100 + 0.5).cast("bigint")


def _status() -> Column:
    final, open_, low, urgent = (F.col("o_orderstatus") == "F", F.col("o_orderstatus") == "O",
                                 F.col("o_orderpriority") == "5-LOW",
                                 F.col("o_orderpriority") == "1-URGENT")
    return (F.when(final & low, "failed_delivery").when(final, "delivered")
            .when(open_ & urgent, "out_for_delivery").when(open_, "in_transit")
            .otherwise("created"))


def order_shipments(spark: SparkSession, folder: str) -> DataFrame:
    """The shipment columns that need no lines: for queries that would otherwise join in vain."""
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.concat(F.lit("TN"), F.col("o_orderkey").cast("string")).alias("tracking_number"),
        F.concat(F.lit("Customer#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0")).alias("sender_name"),
        F.concat(F.lit("Receiver "), F.col("o_orderkey").cast("string")).alias("receiver_name"),
        F.col("o_totalprice").cast("decimal(10,2)").alias("base_cost"),
        F.when(F.col("o_orderstatus") != "P", F.lit("5.00").cast("decimal(10,2)")).alias("additional_fees"),
        _status().alias("status"),
        chosen("o_orderpriority", {"1-URGENT": "overnight", "2-HIGH": "express", "5-LOW": "economy"},
               F.lit("standard")).alias("service_type"),
        chosen("o_orderpriority", {"1-URGENT": "urgent", "2-HIGH": "high", "5-LOW": "low"},
               F.lit("normal")).alias("priority"),
        F.col("o_custkey").alias("created_by_id"),
        F.col("o_orderdate").alias("created_at"),
    )


def shipments(spark: SparkSession, folder: str) -> DataFrame:
    """Shipments with hubs, weights, costs and times; lines are reduced before the join."""
    lines = table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(
        F.min("l_suppkey").alias("origin_hub_id"),
        F.max("l_suppkey").alias("destination_hub_id"),
        F.count(F.lit(1)).cast("int").alias("lines"),
        F.max("l_quantity").alias("total_weight_kg"),
        F.max(_hundredths("l_extendedprice") * _hundredths("l_tax")).alias("fuel_surcharge"),
        F.min("l_shipdate").alias("actual_pickup_datetime"),
        F.max("l_shipdate").alias("last_ship"),
    )
    # Decimals are made after the reduction: casting every line would cost more than all the rest.
    lines = lines.withColumns({
        "total_weight_kg": F.col("total_weight_kg").cast("decimal(10,2)"),
        "fuel_surcharge": (F.col("fuel_surcharge").cast("decimal(18,0)")
                           * F.lit("0.0001").cast("decimal(5,4)")).cast("decimal(10,2)"),
    })
    final = F.col("status").isin("delivered", "failed_delivery")
    return (order_shipments(spark, folder).join(lines, "id", "left")
            .withColumn("package_count", F.coalesce("lines", F.lit(1)))
            .withColumn("current_hub_id", F.when(final, F.col("destination_hub_id"))
                        .when(F.col("status") != "created", F.col("origin_hub_id")))
            .withColumn("actual_delivery_datetime", F.when(final, F.col("last_ship")))
            .withColumn("estimated_delivery_date", F.to_date(X.eta(
                "service_type", "actual_pickup_datetime", F.col("created_at"))))
            .withColumn("insurance_cost", F.lit(None).cast("decimal(10,2)"))
            .withColumn("total_cost", X.total_cost("base_cost", "fuel_surcharge", "insurance_cost",
                                                   "additional_fees"))
            .withColumn("route", F.concat(F.col("origin_hub_id").cast("string"), F.lit("-"),
                                          F.col("destination_hub_id").cast("string")))
            .drop("lines", "last_ship"))


def hubs(spark: SparkSession, folder: str) -> DataFrame:
    """Hubs from suppliers, and one more that no shipment touches."""
    capacity = (F.lit(500) + 20 * F.col("s_nationkey")).cast("int")
    from_suppliers = table(spark, folder, "supplier").select(
        F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"),
        F.concat(F.lit("H"), F.col("s_suppkey").cast("string")).alias("code"),
        capacity.alias("capacity"),
        (F.floor(F.abs("s_acctbal")).cast("int") % capacity).alias("current_load"),
        F.lit("active").alias("status"))
    spare = spark.range(1).select(
        F.lit(-1).cast("bigint").alias("id"), F.lit("Spare hub").alias("name"),
        F.lit("SPARE").alias("code"), F.lit(1000).alias("capacity"),
        F.lit(0).alias("current_load"), F.lit("active").alias("status"))
    return from_suppliers.unionByName(spare).withColumn(
        "utilization_percentage", X.hub_utilization("current_load", "capacity"))


def users(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("full_name"),
        F.concat(F.lit("user"), F.col("c_custkey").cast("string"), F.lit("@example.com")).alias("email"),
        F.concat(F.lit("user"), F.col("c_custkey").cast("string")).alias("username"),
        F.lower("c_mktsegment").alias("role"))


def shipment_events(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select(
        F.col("event_id").alias("id"), F.col("user_id").alias("shipment_id"),
        chosen("event_type", EVENT_STATUS, F.lit(None)).alias("status"),
        F.col("event_type").alias("description"), F.col("ts").alias("event_datetime"))


def routes(spark: SparkSession, folder: str) -> DataFrame:
    """Routes from parts; their values break every route rule now and then."""
    return table(spark, folder, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("name"),
        F.concat(F.lit("RT"), F.col("p_partkey").cast("string")).alias("code"),
        F.col("p_size").cast("bigint").alias("origin_hub_id"),
        (F.col("p_partkey") % 50 + 1).alias("destination_hub_id"),
        (F.col("p_retailprice") - 900).cast("decimal(10,2)").alias("distance_km"),
        (F.col("p_size") - 1).alias("estimated_duration_minutes"),
        F.col("p_size").alias("priority"),
        chosen("p_type", {"ECONOMY": "ground", "STANDARD": "air", "PROMO": "rail"},
               F.lower("p_type")).alias("route_type"),
        F.lit("active").alias("status"))


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """Shipments as flat documents with the six document statuses; from orders alone."""
    key = F.col("o_orderkey").cast("string")
    delivered = F.col("o_orderstatus") == "F"
    days = F.when(F.col("o_orderpriority") == "4-NOT SPECIFIED", F.lit(-1)).otherwise(F.lit(4))
    return table(spark, folder, "orders").select(
        F.concat(F.lit("SH"), key).alias("id"),
        # Some tracking numbers equal the id of another shipment.
        F.when(F.col("o_orderpriority") == "1-URGENT",
               F.concat(F.lit("SH"), (F.col("o_orderkey") + 1).cast("string")))
        .otherwise(F.concat(F.lit("TN"), key)).alias("tracking_number"),
        F.concat(F.lit("Customer#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0")).alias("sender_name"),
        F.concat(F.lit("Receiver "), key).alias("receiver_name"),
        F.col("o_orderpriority").alias("package_details"),
        (F.col("o_totalprice").cast("decimal(12,2)") * F.lit("0.001").cast("decimal(4,3)"))
        .cast("decimal(10,2)").alias("weight"),
        chosen("o_orderpriority", {"1-URGENT": "overnight", "2-HIGH": "express"},
               F.lit("standard")).alias("service_type"),
        F.when(delivered & (F.col("o_orderpriority") == "5-LOW"), "failed").when(delivered, "delivered")
        .when(F.col("o_orderstatus") == "O", "in_transit").otherwise("pending").alias("status"),
        F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderdate")).alias("pickup_date"),
        F.when(delivered & (F.col("o_orderpriority") != "3-MEDIUM"),
               F.col("o_orderdate") + F.make_dt_interval(days, F.lit(6))).alias("actual_delivery"),
        F.when(F.col("o_orderstatus") != "P",
               F.concat(F.lit("R"), F.col("o_custkey").cast("string"))).alias("route"),
        F.concat(F.lit("H"), F.col("o_custkey").cast("string")).alias("hub_id"),
        F.col("o_totalprice").cast("decimal(10,2)").alias("cost"),
        F.col("o_orderdate").alias("created_at"), F.col("o_orderdate").alias("updated_at"))
