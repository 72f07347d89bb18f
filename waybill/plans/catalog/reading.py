"""Sources, sinks, schema operators, projections, filters and lookups."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from waybill import fixed
from waybill.functions import expressions as X
from waybill.operators import lookup as L
from waybill.operators import projections as P
from waybill.operators import schema_ops as S
from waybill.operators.hub_load import status_changes
from waybill.plans import sample_model as M
from waybill.plans.catalog.model_sql import iso, on_model, uuid_of
from waybill.plans.catalog.registry import query
from waybill.session import fresh_folder
from waybill.sources import documents as D
from waybill.sources import open_documents as O
from waybill.sources.tables import read_entity, write_entity

DRIVER_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]


# --- sources and sinks -------------------------------------------------------------------------

@query("src_table", on_model("""
select id, tracking_number, status, total_cost, origin_hub_id, created_at
from shipments where status in ('delivered', 'in_transit')"""))
def src_table(spark, folder):
    path = fresh_folder(spark, "shipments")
    rows = M.shipments(spark, folder)
    write_entity(rows, "shipments", path)
    stored = [c for c in rows.columns if c != "route"]
    return (read_entity(spark, "shipments", path, columns=stored)
            .where(F.col("status").isin("delivered", "in_transit"))
            .select("id", "tracking_number", "status", "total_cost", "origin_hub_id", "created_at"))


PAYLOAD = T.StructType([
    T.StructField("senderName", T.StringType()), T.StructField("receiverName", T.StringType()),
    T.StructField("weight", T.DecimalType(10, 2)), T.StructField("serviceType", T.StringType()),
    T.StructField("pickupDate", T.TimestampNTZType()),
])


@query("src_json", on_model("""
select id, case when status <> 'failed' then sender_name end sender_name,
  case when status <> 'failed' then weight end weight,
  case when status <> 'failed' then service_type end service_type,
  case when status <> 'failed' then pickup_date end pickup_date,
  case when status = 'failed' then cast(null as bigint) when pickup_date is null then 4 else 5 end fields_present,
  status = 'failed' malformed
from documents_"""))
def src_json(spark, folder):
    rows = M.documents(spark, folder)
    text = F.to_json(F.struct(
        F.col("sender_name").alias("senderName"), F.col("receiver_name").alias("receiverName"),
        "weight", F.col("service_type").alias("serviceType"),
        X.iso_timestamp("pickup_date").alias("pickupDate")))
    broken = F.when(F.col("status") == "failed", F.expr("substring(text, 1, length(text) - 9)"))
    payloads = rows.select("id", "status", text.alias("text")).select(
        "id", F.coalesce(broken, F.col("text")).alias("payload"))
    good, malformed = D.read_payloads(payloads, PAYLOAD)
    kept = ["id", "sender_name", "weight", "service_type", "pickup_date"]
    good = good.select(*kept, F.size(D.PRESENT).cast("bigint").alias("fields_present"),
                       F.lit(False).alias("malformed"))
    return good.unionByName(malformed.select("id", F.lit(True).alias("malformed")),
                            allowMissingColumns=True)


@query("json_columns", """
select event_id, case when event_type = 'error' then null else cast(json_extract(props, '$.k') as bigint) end k,
  cast(case when event_type = 'error' or event_type = 'view' then 0 else 2 end as bigint) n_tags,
  case when event_type = 'error' then '{}' else '{"k":' || cast(json_extract(props, '$.k') as varchar) || '}' end text
from events""")
def json_columns(spark, folder):
    kind = F.col("event_type")
    rows = M.table(spark, folder, "events").select(
        "event_id",
        F.when(kind == "error", F.concat(F.lit("{"), "props")).otherwise(F.col("props")).alias("props"),
        F.when(kind == "error", "[1,").when(kind != "view", F.lit('["a", "b"]')).alias("tags"))
    props = D.parse_json_column("props", "struct<k: bigint>")
    tags = D.parse_json_column("tags", "array<string>")
    return rows.select("event_id", props["k"].alias("k"), F.size(tags).cast("bigint").alias("n_tags"),
                       D.serialise_column(props).alias("text"))


@query("open_documents", """
select event_id, event_type = 'error' malformed,
  case when event_type in ('view', 'purchase') then cast(json_extract(props, '$.k') as varchar)
       when event_type = 'click' then '"' || cast(json_extract(props, '$.k') as varchar) || '"' end k,
  case when event_type = 'purchase' then cast(floor(value) as bigint) end cart_total,
  case when event_type = 'purchase' then '[' || event_id || ',"x"]' end cart_items,
  case when event_type = 'click' then 'page ' || user_id end "note",
  case when event_type = 'signup' then '[' || cast(json_extract(props, '$.k') as varchar) || ']' end other
from events""")
def open_documents(spark, folder):
    """Documents of several shapes, one field of two kinds, lists and malformed text among them."""
    k = F.get_json_object("props", "$.k")
    number, whole = F.col("event_id").cast("string"), F.floor("value").cast("string")
    text = F.when(F.col("event_type") == "view", F.col("props"))
    for kind, parts in {
            "click": (F.lit('{"note": "page '), F.col("user_id").cast("string"), F.lit('", "k": "'), k, F.lit('"}')),
            "purchase": (F.lit('{"cart": {"total": '), whole, F.lit(', "items": ['), number, F.lit(', "x"]}, "k": '), k, F.lit("}")),
            "signup": (F.lit("["), k, F.lit("]")), "error": (F.lit('{"k": '),)}.items():
        text = text.when(F.col("event_type") == kind, F.concat(*parts))
    rows = M.table(spark, folder, "events").select("event_id", text.alias("text"))
    parsed = O.parse_open(rows, "text", "document")
    shredded = O.shred(parsed, "document", O.found_shape(parsed, "document"))
    return shredded.select(
        "event_id", "malformed", F.to_json("k").alias("k"), F.col("cart_total").cast("bigint").alias("cart_total"),
        F.to_json("cart_items").alias("cart_items"), "note",
        F.when(~O.is_object("document"), F.to_json("document")).alias("other"))


@query("sink_json", on_model(f"""
select id, '{{"id":"' || id || '","trackingNumber":"' || tracking_number || '","status":"' || status
  || '","cost":' || cost || ',"createdAt":"' || {iso('created_at')} || '","actualDelivery":'
  || coalesce('"' || {iso('actual_delivery')} || '"', 'null') || '}}' "document"
from documents_"""))
def sink_json(spark, folder):
    rows = M.documents(spark, folder).select("id", "tracking_number", "status", "cost",
                                             "created_at", "actual_delivery")
    return D.to_document(rows, keep=("id",))


@query("insert_ignore", """
with incoming as (
  select case when event_type = 'signup' then null else event_id * 3 % 20000 end id, event_id, value from events
  union all select event_id * 5 % 17000, event_id + 1000000000, value from events),
first as (
  select *, row_number() over (partition by id, case when id is null then event_id end order by event_id) rn
  from incoming)
select id, event_id, value from first
where rn = 1 and (id is null or id not in (select o_orderkey from orders))""")
def insert_ignore(spark, folder):
    events, event = M.table(spark, folder, "events"), F.col("event_id")
    incoming = events.select(F.when(F.col("event_type") != "signup", event * 3 % 20000).alias("id"), "event_id", "value")
    incoming = incoming.unionByName(events.select((event * 5 % 17000).alias("id"),
                                                  (event + 1_000_000_000).alias("event_id"), "value"))
    existing = M.table(spark, folder, "orders").select(F.col("o_orderkey").alias("id"))
    return L.insert_ignore(existing, incoming, ["id"], "event_id")


# --- schema ------------------------------------------------------------------------------------

@query("apply_defaults", f"""
select o_orderkey id, case when o_orderstatus <> 'P' then cast(5.00 as decimal(10,2)) end additional_fees,
  {uuid_of("'shipments'", "o_orderkey")} uuid, 1 package_count, 'USD' currency, 'normal' "priority",
  'created' status, cast(0 as decimal(10,2)) insurance_cost, '[]' tags, timestamp '2001-08-01' created_at
from orders""")
def apply_defaults(spark, folder):
    rows = M.order_shipments(spark, folder).select("id", "additional_fees")
    out = S.apply_defaults(rows, "shipments", X.timestamp(M.SHIPMENTS_AS_OF))
    return out.select("id", "additional_fees", "uuid", "package_count", "currency", "priority",
                      "status", "insurance_cost", "tags", "created_at")


@query("apply_defaults_filled", """
select o_orderkey id, cast(case when o_orderstatus <> 'P' then 5.00 else 0 end as decimal(10,2)) additional_fees
from orders""")
def apply_defaults_filled(spark, folder):
    rows = M.order_shipments(spark, folder).select("id", "additional_fees")
    out = S.apply_defaults(rows, "shipments", X.timestamp(M.SHIPMENTS_AS_OF), fill_nulls=True)
    return out.select("id", "additional_fees")


@query("gen_hub_utilization", on_model("select id, capacity, current_load, utilization_percentage from hubs"))
def gen_hub_utilization(spark, folder):
    rows = M.hubs(spark, folder).drop("utilization_percentage")
    return S.generated_columns(rows, "hubs").select(
        "id", "capacity", "current_load", "utilization_percentage")


_SIDES = """
sides as (
  select l_orderkey, l_linenumber, l_partkey, cast(l_quantity as decimal(8,2)) length,
    cast(l_extendedprice * 0.01 as decimal(8,2)) width,
    case when l_returnflag <> 'N' then cast(l_discount * 1000 as decimal(8,2)) end height
  from (select * replace (cast(l_extendedprice as decimal(12,2)) as l_extendedprice,
                          cast(l_discount as decimal(4,2)) as l_discount) from lineitem))"""


@query("gen_volume_m3", f"""
with {_SIDES}
select l_orderkey, l_linenumber, l_partkey,
  cast(cast(length as decimal(10,2)) * width * height * 0.000001 as decimal(10,4)) volume_m3
from sides""")
def gen_volume_m3(spark, folder):
    price = F.col("l_extendedprice").cast("decimal(12,2)")
    discount = F.col("l_discount").cast("decimal(4,2)")
    return M.table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey",
        X.volume_m3("l_quantity", price * F.lit("0.01").cast("decimal(3,2)"),
                    F.when(F.col("l_returnflag") != "N", discount * 1000)).alias("volume_m3"))


@query("gen_total_cost", on_model("select id, base_cost, fuel_surcharge, additional_fees, total_cost from shipments"))
def gen_total_cost(spark, folder):
    return M.shipments(spark, folder).select("id", "base_cost", "fuel_surcharge", "additional_fees",
                                             "total_cost")


@query("gen_net_profit", """
select o_orderkey id, cast(cast(o_totalprice as decimal(12,2))
  - case when o_orderstatus <> 'P' then cast(100.50 as decimal(12,2)) end as decimal(12,2)) net_profit
from orders""")
def gen_net_profit(spark, folder):
    costs = F.when(F.col("o_orderstatus") != "P", F.lit("100.50").cast("decimal(12,2)"))
    return M.table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("id"),
        X.net_profit(F.col("o_totalprice").cast("decimal(12,2)"), costs).alias("net_profit"))


@query("gen_duration_seconds", """
select event_id id, case when event_type <> 'error' then
  cast((cast(round(value * 1000000) as bigint) + 500000) // 1000000 as int) end duration_seconds
from events""")
def gen_duration_seconds(spark, folder):
    seconds = F.col("value").cast("decimal(18,6)")
    zero = F.lit(0)
    ended = F.when(F.col("event_type") != "error", F.col("ts") + F.make_dt_interval(zero, zero, zero, seconds))
    rows = M.table(spark, folder, "events").select(
        F.col("event_id").alias("id"), F.col("ts").alias("started_at"), ended.alias("completed_at"))
    return S.generated_columns(rows, "process_activities").select("id", "duration_seconds")


@query("evolve_schema", """
select cast(s_suppkey as varchar) id, s_name "name", 'H' || s_suppkey code, cast(null as varchar) city,
  cast(null as varchar) state, cast(null as varchar) pincode, cast(null as varchar) phone,
  cast(null as varchar) manager, timestamp '2001-08-01' updated_at
from supplier union all select '-1', 'Spare hub', 'SPARE', null, null, null, null, null, timestamp '2001-08-01'""")
def evolve_schema(spark, folder):
    rows = M.hubs(spark, folder).select("id", "name", "code")
    return S.evolve_schema(rows, fixed.HUB_MIGRATION, fixed.HUB_RETYPE,
                           {"updated_at": X.timestamp(M.SHIPMENTS_AS_OF)})


@query("table_stats", "\nunion all ".join(
    f"select '{t}' table_name, count(*) row_count from {t}" for t in DRIVER_TABLES))
def table_stats(spark, folder):
    return S.table_stats({t: M.table(spark, folder, t) for t in DRIVER_TABLES})


# --- projections -------------------------------------------------------------------------------

@query("project_listing", on_model("""
select id, tracking_number, sender_name, receiver_name, package_details, cast(weight as double) weight,
  service_type, cast(cost as double) "cost", status, created_at, updated_at from documents_"""))
def project_listing(spark, folder):
    return P.project_listing(M.documents(spark, folder))


@query("project_detail", on_model("""
select id, tracking_number, cast(cost as double) "cost", status,
  cast(case when status = 'pending' then 0 else 1 end as bigint) n_events,
  case when status <> 'pending' then 'Shipment created and pending pickup' end first_event from documents_"""))
def project_detail(spark, folder):
    rows = M.documents(spark, folder).withColumn("events", F.when(
        F.col("status") != "pending", X.initial_event("id", F.col("created_at"))))
    return P.project_detail(rows).select(
        "id", "tracking_number", "cost", "status", F.size("events").cast("bigint").alias("n_events"),
        F.get("events", F.lit(0))["description"].alias("first_event"))


@query("project_hub", on_model("""
select id, "name", code "location", capacity, timestamp '2001-08-01' created_at from hubs"""))
def project_hub(spark, folder):
    return P.project_hub(M.hubs(spark, folder).withColumn("location", F.col("code"))
                         .withColumn("created_at", X.timestamp(M.SHIPMENTS_AS_OF)))


@query("project_user", on_model("""
select id, full_name "name", email, "role", cast(null as varchar) phone, cast(null as varchar) hub_id from users"""))
def project_user(spark, folder):
    return P.project_user(M.users(spark, folder))


@query("rename_case", on_model("""
select id, tracking_number "trackingNumber", sender_name "senderName", receiver_name "receiverName",
  service_type "serviceType", status, pickup_date "pickupDate", actual_delivery "actualDelivery",
  hub_id "hubId", created_at "createdAt" from documents_"""))
def rename_case(spark, folder):
    return P.to_camel_case(M.documents(spark, folder).select(
        "id", "tracking_number", "sender_name", "receiver_name", "service_type", "status",
        "pickup_date", "actual_delivery", "hub_id", "created_at"))


@query("money_to_double", """
select l_orderkey, l_linenumber, l_partkey, cast(cast(l_extendedprice as decimal(12,2)) as double) price,
  cast(cast(l_tax as decimal(4,2)) as double) tax from lineitem""")
def money_to_double(spark, folder):
    return M.table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey",
        X.money_to_double(F.col("l_extendedprice").cast("decimal(12,2)")).alias("price"),
        X.money_to_double(F.col("l_tax").cast("decimal(4,2)")).alias("tax"))


# --- filters and lookups -----------------------------------------------------------------------

@query("filter_status", on_model("select id, status, cost from documents_ where status = 'in_transit'"))
def filter_status(spark, folder):
    return L.filter_status(M.documents(spark, folder), "in_transit").select("id", "status", "cost")


@query("filter_recent", """
select event_id, ts, ts >= timestamp '2024-01-30 06:30:00' - interval 7 day exact_too from events
where ts >= timestamp '2024-01-30' - interval 7 day""")
def filter_recent(spark, folder):
    as_of = "2024-01-30 06:30:00"
    rows = L.filter_recent(M.table(spark, folder, "events"), "ts", as_of, 7)
    exact = F.col("ts") >= X.timestamp(as_of) - F.make_dt_interval(F.lit(7))
    return rows.select("event_id", "ts", exact.alias("exact_too"))


@query("filter_recent_exact", """
select event_id, ts from events where ts >= timestamp '2024-01-30 06:30:00' - interval 7 day""")
def filter_recent_exact(spark, folder):
    return L.filter_recent(M.table(spark, folder, "events"), "ts", "2024-01-30 06:30:00", 7,
                           whole_days=False).select("event_id", "ts")


@query("filter_delivered_complete", on_model("""
select id, pickup_date, actual_delivery from documents_
where status = 'delivered' and pickup_date is not null and actual_delivery is not null"""))
def filter_delivered_complete(spark, folder):
    return L.filter_delivered_complete(M.documents(spark, folder)).select("id", "pickup_date", "actual_delivery")


CHANGES_SQL = """
ordered as (
  select *, lag(status) over (partition by shipment_id order by event_datetime, id) old_status from shipment_events),
changes as (select * from ordered where old_status is distinct from status)"""


@query("filter_status_changed", on_model(
    "select id, shipment_id, event_datetime, old_status, status from changes", CHANGES_SQL))
def filter_status_changed(spark, folder):
    return status_changes(M.shipment_events(spark, folder)).select(
        "id", "shipment_id", "event_datetime", "old_status", "status")


_LOOKUP_SQL = """
keys as (
  select distinct case o_orderpriority when '2-HIGH' then 'TN' || o_orderkey when '5-LOW' then 'XX' || o_orderkey
    else 'SH' || o_orderkey end "key" from orders),
matches as (
  select "key", d.*, 1 pref from keys join documents_ d on d.id = "key"
  union all select "key", d.*, 2 pref from keys join documents_ d on d.tracking_number = "key")"""


@query("lookup_shipment", on_model("""
select "key", id, tracking_number, status, "cost" from matches
qualify row_number() over (partition by "key" order by pref) = 1""", _LOOKUP_SQL))
def lookup_shipment(spark, folder):
    number = F.col("o_orderkey").cast("string")
    prefix = M.chosen("o_orderpriority", {"2-HIGH": "TN", "5-LOW": "XX"}, F.lit("SH"))
    keys = M.table(spark, folder, "orders").select(F.concat(prefix, number).alias("key"))
    return L.lookup_shipment(keys, M.documents(spark, folder)).select(
        "key", "id", "tracking_number", "status", "cost")


@query("lookup_hub", on_model("""
select k."key", h.id, h.code, h."name" from
 (select distinct case when l_returnflag = 'N' then 'H' || l_suppkey else cast(l_suppkey + 3 as varchar) end "key" from lineitem) k
 join (select * replace (cast(id as varchar) as id) from hubs) h on h.id = k."key" or h.code = k."key" """))
def lookup_hub(spark, folder):
    number = F.col("l_suppkey").cast("string")
    keys = M.table(spark, folder, "lineitem").select(
        F.when(F.col("l_returnflag") == "N", F.concat(F.lit("H"), number))
        .otherwise((F.col("l_suppkey") + 3).cast("string")).alias("key"))
    hubs = M.hubs(spark, folder).withColumn("id", F.col("id").cast("string"))
    return L.lookup_hub(keys, hubs).select("key", "id", "code", "name")


@query("lookup_user_email", on_model("""
select email, id, full_name from users
where email in (select 'user' || (2 * o_custkey) || '@example.com' from orders)"""))
def lookup_user_email(spark, folder):
    keys = M.table(spark, folder, "orders").select(F.concat(
        F.lit("user"), (2 * F.col("o_custkey")).cast("string"), F.lit("@example.com")).alias("key"))
    return L.lookup_user_email(keys, M.users(spark, folder)).select("email", "id", "full_name")


# --- pages -------------------------------------------------------------------------------------

@query("page_newest", on_model("""
select id, tracking_number, status, created_at from documents_ order by created_at desc, id limit 50 offset 100"""))
def page_newest(spark, folder):
    return L.page_newest(M.documents(spark, folder), 100, 50).select("id", "tracking_number", "status", "created_at")


@query("page_after", on_model("""
select id, created_at from documents_
where created_at < timestamp '2000-06-01' or (created_at = timestamp '2000-06-01' and id > 'SH5')
order by created_at desc, id limit 50"""))
def page_after(spark, folder):
    return L.page_after(M.documents(spark, folder), "2000-06-01", "SH5", 50).select("id", "created_at")


@query("page_envelope", on_model("""
select id, created_at, (select count(*) from documents_) total, 20 skip, 30 "limit"
from (select * from documents_ order by created_at desc, id limit 30 offset 20)"""))
def page_envelope(spark, folder):
    rows = M.documents(spark, folder).select("id", "created_at")
    return L.page_envelope(rows, "shipments", 20, 30).select(
        F.inline("shipments"), "total", "skip", "limit")


@query("latest_n", on_model("select id, created_at from documents_ order by created_at desc, id limit 50"))
def latest_n(spark, folder):
    return L.latest_n(M.documents(spark, folder)).select("id", "created_at")
