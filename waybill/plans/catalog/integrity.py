"""Expressions on single values, validation and integrity."""

from __future__ import annotations

from pyspark.sql import functions as F

from waybill import fixed
from waybill.functions import expressions as X
from waybill.operators import quality as Q
from waybill.plans import sample_model as M
from waybill.plans.catalog.model_sql import iso, on_model
from waybill.plans.catalog.registry import query


# --- expressions -------------------------------------------------------------------------------

@query("eta", on_model("""
select id, coalesce(pickup_date, timestamp '2001-08-01')
  + (case service_type when 'overnight' then 1 when 'express' then 2 else 3 end) * interval 1 day eta,
  timestamp '2001-08-01' + (case service_type when 'overnight' then 1 when 'express' then 3 else 5 end) * interval 1 day slow_eta
from documents_"""))
def eta(spark, folder):
    as_of = X.timestamp(M.SHIPMENTS_AS_OF)
    return M.documents(spark, folder).select(
        "id", X.eta("service_type", "pickup_date", as_of).alias("eta"),
        X.eta("service_type", F.lit(None).cast("timestamp_ntz"), as_of, fixed.SLOW_DELIVERY_DAYS).alias("slow_eta"))


PHONE_SQL = """case c_mktsegment when 'BUILDING' then null when 'MACHINERY' then ''
  when 'HOUSEHOLD' then '+1-' || c_custkey || ' 555' when 'AUTOMOBILE' then 'x' || c_custkey else '+-' end"""


def phone():
    number = F.col("c_custkey").cast("string")
    segment = F.col("c_mktsegment")
    return (F.when(segment == "BUILDING", F.lit(None).cast("string")).when(segment == "MACHINERY", "")
            .when(segment == "HOUSEHOLD", F.concat(F.lit("+1-"), number, F.lit(" 555")))
            .when(segment == "AUTOMOBILE", F.concat(F.lit("x"), number)).otherwise("+-"))


@query("phone_valid", f"""
select c_custkey, phone, phone is null or phone = ''
  or regexp_full_match(replace(replace(replace(phone, '+', ''), '-', ''), ' ', ''), '[0-9]+') valid
from (select c_custkey, {PHONE_SQL} phone from customer)""")
def phone_valid(spark, folder):
    rows = M.table(spark, folder, "customer").select("c_custkey", phone().alias("phone"))
    return rows.withColumn("valid", X.phone_valid("phone"))


@query("tracking_number", """
select event_id, 'BC' || strftime(ts, '%Y%m%d') || lpad(cast(((epoch_us(ts) + 500000) // 1000000) % 10000 as varchar), 4, '0')
  || lpad(cast(user_id % 1000 as varchar), 3, '0') tracking_number
from events""")
def tracking_number(spark, folder):
    return M.table(spark, folder, "events").select(
        "event_id", X.tracking_number("ts", F.col("user_id") % 1000).alias("tracking_number"))


@query("initial_event", """
select o_orderkey, cast(1 as bigint) n_events, 'EV' || o_orderkey event_id, o_orderdate "at", 'pending' status,
  'Origin Hub' "location", 'Shipment created and pending pickup' description
from orders""")
def initial_event(spark, folder):
    event_id = F.concat(F.lit("EV"), F.col("o_orderkey").cast("string"))
    rows = M.table(spark, folder, "orders").withColumn("events", X.initial_event(event_id, F.col("o_orderdate")))
    first = F.col("events")[0]
    return rows.select("o_orderkey", F.size("events").cast("bigint").alias("n_events"), first["id"].alias("event_id"),
                       first["timestamp"].alias("at"), first["status"].alias("status"),
                       first["location"].alias("location"), first["description"].alias("description"))


@query("upper_code", on_model("select id, upper(lower(code) || 'é') code from hubs"))
def upper_code(spark, folder):
    return M.hubs(spark, folder).select("id", X.upper_code(F.concat(F.lower("code"), F.lit("é"))).alias("code"))


@query("clamp", """
select o_orderkey, greatest(0, least_of - 750) low, least(cap, least_of) high
from (select o_orderkey, case when o_orderstatus <> 'P' then o_custkey end least_of,
  cast(case when o_orderpriority <> '5-LOW' then 700 end as bigint) cap from orders)""")
def clamp(spark, folder):
    rows = M.table(spark, folder, "orders").select(
        "o_orderkey", F.when(F.col("o_orderstatus") != "P", F.col("o_custkey")).alias("x"),
        F.when(F.col("o_orderpriority") != "5-LOW", F.lit(700).cast("bigint")).alias("cap"))
    return rows.select("o_orderkey", X.clamp_low(F.col("x") - 750).alias("low"), X.clamp_high("x", "cap").alias("high"))


@query("iso_timestamp", f"""
select event_id, case when event_type <> 'error' then {iso('ts')} end "at", {iso("date_trunc('second', ts)")} whole
from events""")
def iso_timestamp(spark, folder):
    return M.table(spark, folder, "events").select(
        "event_id", X.iso_timestamp(F.when(F.col("event_type") != "error", F.col("ts"))).alias("at"),
        X.iso_timestamp(F.date_trunc("second", "ts").cast("timestamp_ntz")).alias("whole"))


# --- validation --------------------------------------------------------------------------------

def _rules_text(parts, keys):
    """All rows of a (valid, rejects) pair with the broken rules as text."""
    valid, rejects = parts
    return (valid.select(*keys, F.lit("").alias("rules"))
            .unionByName(rejects.select(*keys, F.array_join(Q.BROKEN, ",").alias("rules"))))


def _rules_sql(*rules):
    return "concat_ws(',', " + ", ".join(f"case when {broken} then '{name}' end" for name, broken in rules) + ")"


@query("validate_shipments", on_model("select id, " + _rules_sql(
    ("sender_name_empty", "coalesce(sender_name, '') = ''"),
    ("receiver_name_too_long", "length(receiver_name) > 255"),
    ("sender_phone_too_long", "length(phone) > 20"),
    ("sender_phone_not_a_phone", "phone like 'x%'"),
    ("weight_not_positive", "weight <= 100"),
    ("dimensions.length_not_positive", "status = 'failed'"),
    ("service_type_not_allowed", "service is null or service = 'drone'"),
) + " rules from incoming", """
incoming as (
  select id, case when status = 'in_transit' then '' when status <> 'pending' then sender_name end sender_name,
    case when service_type = 'express' then repeat('n', 300) else receiver_name end receiver_name,
    case when pickup_date is null then 'x12' when service_type = 'overnight' then '+1 555 000 000 000 000 000'
      else '' end phone, weight, status,
    case when status = 'failed' then 'drone' when "cost" > 10000 then service_type end service
  from documents_)"""))
def validate_shipments(spark, folder):
    status, service = F.col("status"), F.col("service_type")
    rows = M.documents(spark, folder).select(
        "id",
        F.when(status == "in_transit", "").when(status != "pending", F.col("sender_name")).alias("sender_name"),
        F.when(service == "express", F.repeat(F.lit("n"), F.lit(300))).otherwise(F.col("receiver_name")).alias("receiver_name"),
        F.lit("x").alias("sender_address"), F.lit("y").alias("receiver_address"), "package_details",
        F.when(F.col("pickup_date").isNull(), "x12").when(service == "overnight", "+1 555 000 000 000 000 000")
        .otherwise("").alias("sender_phone"),
        (F.col("weight") - 100).cast("double").alias("weight"),
        F.struct(F.when(status == "failed", 0.0).otherwise(2.0).alias("length"), F.lit(1.0).alias("width"),
                 F.lit(1.0).alias("height")).alias("dimensions"),
        F.when(status == "failed", "drone").when(F.col("cost") > 10000, service).alias("service_type"),
        F.col("cost").cast("double").alias("cost"))
    return _rules_text(Q.validate_shipments(rows), ["id"])


@query("validate_patches", "select event_id, " + _rules_sql(
    ("weight_not_positive", "value <= 20"),
    ("status_not_allowed", "event_type in ('signup', 'view', 'click', 'purchase')"),
) + " rules from (select event_id, event_type, case when user_id % 2 = 0 then value end as value from events)")
def validate_patches(spark, folder):
    rows = M.table(spark, folder, "events").select(
        "event_id", F.when(F.col("user_id") % 2 == 0, F.col("value") - 20).alias("weight"),
        F.when(F.col("event_type") != "error", F.col("event_type")).alias("status"))
    return _rules_text(Q.validate_patches(rows), ["event_id"])


@query("validate_hubs", "select s_suppkey id, " + _rules_sql(
    ("name_empty", "s_nationkey = 3"), ("city_empty", "s_nationkey = 4"),
    ("capacity_not_positive", "s_acctbal <= 0"),
    ("status_not_allowed", "s_nationkey = 5 or s_nationkey = 6"),
) + " rules from supplier")
def validate_hubs(spark, folder):
    nation = F.col("s_nationkey")
    rows = M.table(spark, folder, "supplier").select(
        F.col("s_suppkey").alias("id"), F.when(nation != 3, F.col("s_name")).alias("name"),
        F.lit("C").alias("code"), F.lit("a").alias("address"), F.when(nation == 4, "").otherwise("c").alias("city"),
        F.lit("s").alias("state"), F.ceil("s_acctbal").cast("int").alias("capacity"),
        F.when(nation == 5, "closed").when(nation != 6, "active").alias("status"))
    return _rules_text(Q.validate_hubs(rows), ["id"])


@query("validate_users", "select c_custkey id, " + _rules_sql(
    ("full_name_too_long", "c_nationkey = 7"), ("email_empty", "c_nationkey = 8"),
    ("role_not_allowed", "c_mktsegment not in ('BUILDING', 'MACHINERY')"),
) + " rules from customer")
def validate_users(spark, folder):
    nation = F.col("c_nationkey")
    roles = M.chosen("c_mktsegment", {"BUILDING": "admin", "MACHINERY": "viewer"}, F.lower("c_mktsegment"))
    rows = M.table(spark, folder, "customer").select(
        F.col("c_custkey").alias("id"),
        F.when(nation == 7, F.repeat(F.lit("n"), F.lit(256))).otherwise(F.col("c_name")).alias("full_name"),
        F.when(nation != 8, F.lit("a@example.com")).alias("email"), roles.alias("role"))
    return _rules_text(Q.validate_users(rows), ["id"])


@query("validate_routes", on_model("select id, " + _rules_sql(
    ("route_type_check", "route_type not in ('ground', 'air', 'sea', 'rail')"),
    ("distance_km_check", "distance_km <= 0"),
    ("estimated_duration_minutes_check", "estimated_duration_minutes <= 0"),
    ("priority_check", "\"priority\" not between 1 and 10"),
    ("no_self_route_check", "origin_hub_id = destination_hub_id"),
) + " rules from routes"))
def validate_routes(spark, folder):
    return _rules_text(Q.validate_routes(M.routes(spark, folder)), ["id"])


# --- integrity ---------------------------------------------------------------------------------

def _tables(spark, folder):
    """All thirteen entities, each read out of a whole given table; every rule is broken by some rows."""
    def given(name):
        return M.table(spark, folder, name)

    key, line = F.col("id"), F.col("l_orderkey")
    hubs = M.hubs(spark, folder).withColumns({
        "manager_id": 17 * key,
        "hub_type": F.when(key % 4 == 0, "sorting").when(key % 4 == 1, "pickup").when(key % 4 != 2, "garage")})
    users = M.users(spark, folder).withColumn("status", F.when(key % 3 == 0, "active").when(key % 3 == 1, "gone"))
    shipments = M.shipments(spark, folder).drop("route").withColumns({
        "assigned_driver_id": 2 * F.col("created_by_id"), "assigned_route_id": key % 3000,
        "updated_by_id": F.col("created_by_id") + 100})
    events = M.shipment_events(spark, folder).withColumns({
        "event_type": M.chosen("description", {"view": "in_transit", "purchase": "delivered"}, F.col("description")),
        "hub_id": key % 120, "user_id": F.col("shipment_id") * 20})
    return {
        "hubs": hubs, "users": users, "routes": M.routes(spark, folder), "shipments": shipments, "shipment_events": events,
        "daily_analytics": given("orders").select(
            F.col("o_orderkey").alias("id"), F.to_date("o_orderdate").alias("date"), (F.col("o_custkey") % 130).alias("hub_id")),
        "performance_metrics": given("lineitem").select(
            line.alias("id"), F.col("l_returnflag").alias("metric_name"), F.col("l_quantity").alias("metric_value"),
            F.col("l_linestatus").alias("category"), (F.col("l_suppkey") + 20).alias("hub_id"), F.col("l_partkey").alias("user_id")),
        "process_definitions": given("part").select(
            F.col("p_partkey").alias("id"), F.col("p_type").alias("name"), F.col("p_size").cast("string").alias("version"),
            F.col("p_type").alias("process_type"), F.lit("{}").alias("definition_data"), F.col("p_partkey").alias("created_by_id")),
        "process_instances": given("orders").select(
            F.col("o_orderkey").alias("id"), (F.col("o_custkey") * 2).alias("process_definition_id"),
            M.chosen("o_orderstatus", {"F": "completed", "O": "running"}, F.lit("stopped")).alias("status"),
            F.col("o_custkey").alias("started_by_id"), (F.col("o_orderkey") * 2).alias("related_shipment_id")),
        "process_activities": given("lineitem").select(
            (line * 10 + F.col("l_linenumber")).alias("id"), (line + 5).alias("process_instance_id"),
            F.col("l_returnflag").alias("activity_name"), F.col("l_linestatus").alias("activity_type"),
            M.chosen("l_returnflag", {"A": "completed", "N": "pending"}, F.lit("stalled")).alias("status"),
            (F.col("l_suppkey") * 20).alias("assigned_to_id")),
        "system_settings": given("customer").select(
            F.col("c_custkey").alias("id"), F.concat("c_mktsegment", F.col("c_nationkey").cast("string")).alias("setting_key"),
            F.lit("x").alias("setting_value"),
            M.chosen("c_mktsegment", {"BUILDING": "string", "MACHINERY": "json"}, F.lit("list")).alias("setting_type"),
            F.col("c_mktsegment").alias("category")),
        "user_sessions": given("events").select(
            F.col("event_id").alias("id"), F.col("props").alias("session_token"), (F.col("user_id") * 11).alias("user_id"),
            F.col("ts").alias("expires_at")),
        "notifications": given("events").select(
            F.col("event_id").alias("id"), F.col("event_id").alias("user_id"), F.col("event_type").alias("title"),
            F.col("props").alias("message"), M.chosen("event_type", {"error": "error", "view": "info"}, F.lit("shout")).alias("type")),
    }


# The same thirteen entities, under their names with x_ before them.
_ENTITIES = """
x_hubs as (select *, 17 * id manager_id,
  case when id % 4 = 0 then 'sorting' when id % 4 = 1 then 'pickup' when id % 4 <> 2 then 'garage' end hub_type from hubs),
x_users as (select *, case id % 3 when 0 then 'active' when 1 then 'gone' end status from users),
x_routes as (select * from routes),
x_shipments as (select *, 2 * created_by_id assigned_driver_id, id % 3000 assigned_route_id, created_by_id + 100 updated_by_id
  from shipments),
x_shipment_events as (select *, case description when 'view' then 'in_transit' when 'purchase' then 'delivered' else description end event_type,
  id % 120 hub_id, shipment_id * 20 user_id from shipment_events),
x_daily_analytics as (select o_orderkey id, cast(o_orderdate as date) "date", o_custkey % 130 hub_id from orders),
x_performance_metrics as (select l_orderkey id, l_returnflag metric_name, l_quantity metric_value, l_linestatus category,
  l_suppkey + 20 hub_id, l_partkey user_id from lineitem),
x_process_definitions as (select p_partkey id, p_type "name", cast(p_size as varchar) "version", p_type process_type,
  '{}' definition_data, p_partkey created_by_id from part),
x_process_instances as (select o_orderkey id, o_custkey * 2 process_definition_id,
  case o_orderstatus when 'F' then 'completed' when 'O' then 'running' else 'stopped' end status,
  o_custkey started_by_id, o_orderkey * 2 related_shipment_id from orders),
x_process_activities as (select l_orderkey * 10 + l_linenumber id, l_orderkey + 5 process_instance_id, l_returnflag activity_name,
  l_linestatus activity_type, case l_returnflag when 'A' then 'completed' when 'N' then 'pending' else 'stalled' end status,
  l_suppkey * 20 assigned_to_id from lineitem),
x_system_settings as (select c_custkey id, c_mktsegment || c_nationkey setting_key, 'x' setting_value,
  case c_mktsegment when 'BUILDING' then 'string' when 'MACHINERY' then 'json' else 'list' end setting_type, c_mktsegment category
  from customer),
x_user_sessions as (select event_id id, props session_token, user_id * 11 user_id, ts expires_at from events),
x_notifications as (select event_id id, event_id user_id, event_type title, props message,
  case event_type when 'error' then 'error' when 'view' then 'info' else 'shout' end "type" from events)"""


def _counts_sql(table, rules):
    return "\nunion all ".join(
        f"select '{table}' table_name, '{rule}' \"rule\", count(*) filter (where {broken}) violations from x_{table}"
        for rule, broken in rules)


_CHECKS = "\nunion all ".join([
    _counts_sql("hubs", [
        ("status_check", "status not in ('active', 'inactive', 'maintenance', 'closed')"),
        ("hub_type_check", "hub_type not in ('distribution', 'sorting', 'pickup', 'delivery', 'storage')"),
        ("capacity_check", "capacity <= 0"), ("current_load_check", "current_load < 0")]),
    _counts_sql("users", [("role_check", "\"role\" not in ('admin', 'manager', 'operator', 'viewer')"),
                          ("status_check", "status not in ('active', 'inactive', 'suspended')")]),
    _counts_sql("routes", [
        ("route_type_check", "route_type not in ('ground', 'air', 'sea', 'rail')"),
        ("status_check", "status not in ('active', 'inactive', 'suspended', 'maintenance')"),
        ("distance_km_check", "distance_km <= 0"),
        ("estimated_duration_minutes_check", "estimated_duration_minutes <= 0"),
        ("priority_check", "\"priority\" < 1 or \"priority\" > 10"),
        ("no_self_route_check", "origin_hub_id = destination_hub_id")]),
    _counts_sql("shipments", [
        ("service_type_check", "service_type not in ('standard', 'express', 'overnight', 'economy')"),
        ("status_check", "status not in ('created', 'accepted', 'collected', 'in_transit', 'at_hub', "
                         "'out_for_delivery', 'delivered', 'failed_delivery', 'returned', 'cancelled', 'lost', 'damaged')"),
        ("priority_check", "\"priority\" not in ('low', 'normal', 'high', 'urgent')"),
        ("package_count_check", "package_count <= 0"), ("total_weight_kg_check", "total_weight_kg <= 0")]),
    _counts_sql("shipment_events", [
        ("event_type_check", "event_type not in ('created', 'accepted', 'collected', 'departed_hub', 'arrived_hub', 'in_transit', "
                             "'out_for_delivery', 'delivered', 'failed_delivery', 'returned', 'cancelled', 'damaged', "
                             "'lost', 'exception')")]),
    _counts_sql("process_instances", [("status_check", "status not in ('running', 'completed', 'failed', 'suspended')")]),
    _counts_sql("process_activities", [
        ("status_check", "status not in ('pending', 'active', 'completed', 'failed', 'skipped')")]),
    _counts_sql("system_settings", [("setting_type_check", "setting_type not in ('string', 'number', 'boolean', 'json')")]),
    _counts_sql("notifications", [("type_check", "\"type\" not in ('info', 'success', 'warning', 'error')")]),
])

_REQUIRED = {
    "hubs": "id name code", "users": "id username email full_name", "routes": "id name code origin_hub_id destination_hub_id",
    "shipments": "id tracking_number sender_name receiver_name total_weight_kg base_cost created_by_id",
    "shipment_events": "id shipment_id event_type status description", "daily_analytics": "id date",
    "performance_metrics": "id metric_name metric_value category",
    "process_definitions": "id name version process_type definition_data created_by_id",
    "process_instances": "id process_definition_id started_by_id",
    "process_activities": "id process_instance_id activity_name activity_type",
    "system_settings": "id setting_key setting_value category", "user_sessions": "id session_token user_id expires_at",
    "notifications": "id user_id title message",
}
_NOT_NULL = "\nunion all ".join(
    _counts_sql(table, [(f"{c}_not_null", f'"{c}" is null') for c in columns.split()])
    for table, columns in _REQUIRED.items())


def _surplus_sql(table, keys):
    return "\nunion all ".join(
        f"select '{table}', '{key.replace(', ', '_').replace(chr(34), '')}_unique', count(*) - count(distinct ({key})) from x_{table} "
        f"where ({key}) is not null" for key in keys)


_UNIQUE = "\nunion all ".join([
    _surplus_sql("hubs", ["id", '"name"', "code"]), _surplus_sql("users", ["id", "username", "email"]),
    _surplus_sql("routes", ["id", "code"]), _surplus_sql("shipments", ["id", "tracking_number"]),
    _surplus_sql("shipment_events", ["id"]), _surplus_sql("daily_analytics", ["id", '"date", hub_id']),
    _surplus_sql("performance_metrics", ["id"]), _surplus_sql("process_definitions", ["id", '"name", "version"']),
    _surplus_sql("process_instances", ["id"]), _surplus_sql("process_activities", ["id"]),
    _surplus_sql("system_settings", ["id", "setting_key"]), _surplus_sql("user_sessions", ["id", "session_token"]),
    _surplus_sql("notifications", ["id"]),
])


def _orphans_sql(child, parents):
    return "\nunion all ".join(
        f"select '{child}', '{column}_reference', count(*) from x_{child} c where c.{column} is not null "
        f"and not exists (select 1 from x_{parent} p where p.id = c.{column})" for column, parent in parents.items())


_ORPHANS = "\nunion all ".join([
    _orphans_sql("hubs", {"manager_id": "users"}),
    _orphans_sql("routes", {"origin_hub_id": "hubs", "destination_hub_id": "hubs"}),
    _orphans_sql("shipments", {
        "origin_hub_id": "hubs", "destination_hub_id": "hubs", "current_hub_id": "hubs", "assigned_route_id": "routes",
        "assigned_driver_id": "users", "created_by_id": "users", "updated_by_id": "users"}),
    _orphans_sql("shipment_events", {"shipment_id": "shipments", "hub_id": "hubs", "user_id": "users"}),
    _orphans_sql("daily_analytics", {"hub_id": "hubs"}),
    _orphans_sql("performance_metrics", {"hub_id": "hubs", "user_id": "users"}),
    _orphans_sql("process_definitions", {"created_by_id": "users"}),
    _orphans_sql("process_instances", {
        "process_definition_id": "process_definitions", "started_by_id": "users", "related_shipment_id": "shipments"}),
    _orphans_sql("process_activities", {"process_instance_id": "process_instances", "assigned_to_id": "users"}),
    _orphans_sql("user_sessions", {"user_id": "users"}), _orphans_sql("notifications", {"user_id": "users"}),
])
_HEAD = "select '' table_name, '' \"rule\", cast(0 as bigint) violations where false union all "


@query("check_constraints", on_model(_CHECKS, _ENTITIES))
def check_constraints(spark, folder):
    return Q.check_constraints(_tables(spark, folder))


@query("not_null_check", on_model(_NOT_NULL, _ENTITIES))
def not_null_check(spark, folder):
    return Q.not_null_check(_tables(spark, folder))


@query("unique_violations", on_model(_HEAD + _UNIQUE + """
union all select 'lineitem', 'l_orderkey_l_linenumber_unique', count(*) - count(distinct (l_orderkey, l_linenumber)) from lineitem""", _ENTITIES))
def unique_violations(spark, folder):
    tables = _tables(spark, folder) | {"lineitem": M.table(spark, folder, "lineitem")}
    keys = {**fixed.UNIQUE_KEYS, "lineitem": [["l_orderkey", "l_linenumber"]]}
    return Q.unique_violations(tables, keys)


@query("duplicate_keys", """
select l_orderkey, l_linenumber, count(*) row_count from lineitem where l_returnflag <> 'A'
group by 1, 2 having count(*) > 1""")
def duplicate_keys(spark, folder):
    return Q.duplicate_keys(M.table(spark, folder, "lineitem"), ["l_orderkey", "l_linenumber"],
                            F.col("l_returnflag") != "A")


@query("fk_orphans", on_model(_HEAD + _ORPHANS, _ENTITIES))
def fk_orphans(spark, folder):
    return Q.fk_orphans(_tables(spark, folder))


@query("orphan_rows", on_model("""
select id, 2 * created_by_id assigned_driver_id from shipments
where 2 * created_by_id not in (select id from users)"""))
def orphan_rows(spark, folder):
    tables = _tables(spark, folder)
    return Q.orphan_rows(tables["shipments"], "assigned_driver_id", tables["users"]).select("id", "assigned_driver_id")


@query("integrity_report", on_model(
    "\nunion all ".join([_CHECKS, _NOT_NULL, _UNIQUE, _ORPHANS]), _ENTITIES))
def integrity_report(spark, folder):
    return Q.integrity_report(_tables(spark, folder))


@query("cascade_delete", on_model("""
select 'shipments' part, id from order_shipments where id not in (select id from granted)
union all select 'shipment_events', id from shipment_events where shipment_id not in (select id from granted)
union all select 'refused ' || 'process_instances.related_shipment_id', id from refused""", """
wanted as (select id from order_shipments where status = 'created'),
refused as (select distinct w.id from wanted w join events e on 11 * e.event_id = w.id),
granted as (select id from wanted where id not in (select id from refused))"""))
def cascade_delete(spark, folder):
    shipments = M.order_shipments(spark, folder)
    instances = M.table(spark, folder, "events").select(
        F.col("event_id").alias("id"), (11 * F.col("event_id")).alias("related_shipment_id"))
    tables = {"shipments": shipments, "shipment_events": M.shipment_events(spark, folder),
              "process_instances": instances}
    left, refused = Q.cascade_delete(tables, "shipments", shipments.where("status = 'created'").select("id"))
    parts = [left[t].select(F.lit(t).alias("part"), "id") for t in ("shipments", "shipment_events")]
    return (parts[0].unionByName(parts[1])
            .unionByName(refused.select(F.concat(F.lit("refused "), "reason").alias("part"), "id")))
