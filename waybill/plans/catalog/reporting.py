"""Joins, aggregates, dashboards and the rollup."""

from __future__ import annotations

from pyspark.sql import functions as F

from waybill.operators.lookup import taken_keys
from waybill.plans import reports as R
from waybill.plans import sample_model as M
from waybill.plans.catalog.model_sql import average, half_up, on_model
from waybill.plans.catalog.registry import query
from waybill.plans.kept_rollup import KeptRollup
from waybill.session import checkpointed, fresh_folder


# Names come from subqueries, which can neither drop nor multiply shipments: the four outer joins must not either.
def _name_sql(role):
    return f'(select any_value("name") from hubs where hubs.id = {role}_hub_id) {role}_hub_name'


@query("shipment_summary", on_model(f"""
select id, tracking_number, sender_name, receiver_name, total_weight_kg, total_cost, status, service_type,
  "priority", created_at, estimated_delivery_date,
  {_name_sql("origin")}, {_name_sql("destination")}, {_name_sql("current")},
  (select any_value(full_name) from users where users.id = created_by_id) created_by_name
from shipments"""))
def shipment_summary(spark, folder):
    return R.shipment_summary(M.shipments(spark, folder), M.hubs(spark, folder), M.users(spark, folder))


@query("hub_performance", on_model(f"""
select id, "name", capacity, current_load, utilization_percentage, status,
  total_shipments, delivered_shipments, average_shipment_cost, total_revenue
from hubs join recent on recent.hub = hubs.id
union all
select id, "name", capacity, current_load, utilization_percentage, status, 0, 0, null, null
from hubs anti join visits on visits.hub = hubs.id""", f"""
visits as (
  select origin_hub_id hub, status state, total_cost, created_at from shipments
  union all
  select destination_hub_id, status, total_cost, created_at from shipments
  where destination_hub_id is distinct from origin_hub_id),
recent as (
  select hub, count(*) total_shipments, count_if(state = 'delivered') delivered_shipments,
    {average('total_cost')} average_shipment_cost, sum(total_cost) total_revenue
  from visits where created_at >= date '2001-08-01' - interval 30 day group by hub)"""))
def hub_performance(spark, folder):
    return R.hub_performance(M.hubs(spark, folder), M.shipments(spark, folder), M.SHIPMENTS_AS_OF).withColumn(
        "total_revenue", F.col("total_revenue").cast("decimal(38,2)"))


@query("exists_check", """
select distinct 'TN' || o_orderkey tracking_number from orders where o_orderkey in (select 2 * user_id from events)""")
def exists_check(spark, folder):
    numbers = M.table(spark, folder, "events").select(
        F.concat(F.lit("TN"), (2 * F.col("user_id")).cast("string")).alias("tracking_number"))
    return taken_keys(numbers, M.order_shipments(spark, folder), ["tracking_number"])


@query("shipment_count", on_model("select count(*) total from documents_ where status = 'delivered'"))
def shipment_count(spark, folder):
    return R.shipment_count(M.documents(spark, folder), "delivered")


_FIXED = """count(*) total_shipments, count(*) filter (where status = 'pending') pending_shipments,
  count(*) filter (where status = 'in_transit') in_transit_shipments,
  count(*) filter (where status = 'delivered') delivered_shipments,
  count(*) filter (where status = 'failed') failed_shipments"""


@query("status_counts_fixed", on_model(f"select {_FIXED} from documents_"))
def status_counts_fixed(spark, folder):
    return R.status_counts_fixed(M.documents(spark, folder))


_WITH_UNKNOWN = """unsure as (
  select id, created_at, case when service_type <> 'overnight' then status end status from documents_)"""


def _unsure(spark, folder):
    rows = M.documents(spark, folder)
    return rows.withColumn("status", F.when(F.col("service_type") != "overnight", F.col("status")))


@query("status_breakdown", on_model(
    "select coalesce(status, 'unknown') status, count(*) shipments from unsure group by 1", _WITH_UNKNOWN))
def status_breakdown(spark, folder):
    return R.status_breakdown(_unsure(spark, folder))


@query("status_breakdown_recent", on_model("""
select coalesce(status, 'unknown') status, count(*) shipments
from (select * from unsure order by created_at desc, id limit 1000) group by 1""", _WITH_UNKNOWN))
def status_breakdown_recent(spark, folder):
    return R.status_breakdown_recent(_unsure(spark, folder), 1000)


@query("total_revenue", on_model("select cast(coalesce(sum(\"cost\"), 0) as decimal(20,2)) total_revenue from documents_"))
def total_revenue(spark, folder):
    return R.total_revenue(M.documents(spark, folder))


_DAYS = """case when status = 'delivered' and pickup_date is not null and actual_delivery is not null then
  cast(floor((epoch_us(actual_delivery) - epoch_us(pickup_date)) / 86400000000) as bigint) end"""


@query("avg_delivery_days", on_model(f"select avg({_DAYS}) average_delivery_time from documents_"))
def avg_delivery_days(spark, folder):
    return R.avg_delivery_days(M.documents(spark, folder))


_TOP = """top as (select route, count(*) "count" from documents_ where route is not null
  group by 1 order by 2 desc, 1 limit 5)"""
_DAILY = """daily as (select cast(created_at as date) "date", count(*) "count" from documents_
  where created_at >= timestamp '2001-08-01' - interval 7 day group by 1)"""


@query("top_routes", on_model("select * from top", _TOP))
def top_routes(spark, folder):
    return R.top_routes(M.documents(spark, folder))


@query("daily_shipments", on_model("select * from daily", _DAILY))
def daily_shipments(spark, folder):
    return R.daily_shipments(M.documents(spark, folder), M.SHIPMENTS_AS_OF)


@query("daily_summary", on_model(f"""
select cast(created_at as date) "date", count(*) total_shipments,
  count(*) filter (where status = 'delivered') delivered_shipments,
  count(*) filter (where status in ('created', 'accepted', 'collected', 'in_transit', 'at_hub', 'out_for_delivery')) active_shipments,
  sum(total_cost) total_revenue, {average('total_weight_kg')} average_weight, {average('total_cost')} average_cost
from shipments where created_at >= date '2001-08-01' - interval 90 day group by 1"""))
def daily_summary(spark, folder):
    return R.daily_summary(M.shipments(spark, folder), M.SHIPMENTS_AS_OF).withColumn(
        "total_revenue", F.col("total_revenue").cast("decimal(38,2)"))


@query("dashboard", on_model(f"""
select {_FIXED}, cast(coalesce(sum("cost"), 0) as double) total_revenue, avg({_DAYS}) average_delivery_time,
  (select count(*) from hubs) total_hubs,
  (select string_agg(route || ':' || "count", ',' order by "count" desc, route) from top) top_routes,
  (select string_agg(strftime("date", '%Y-%m-%d') || ':' || "count", ',' order by "date") from daily) daily_shipments
from documents_""", _TOP, _DAILY))
def dashboard(spark, folder):
    board = R.dashboard(M.documents(spark, folder), M.SHIPMENTS_AS_OF, M.hubs(spark, folder))

    def text(column, key):
        return F.array_join(F.transform(column, lambda x: F.concat(x[key], F.lit(":"), x["count"].cast("string"))), ",")

    return board.withColumns({"top_routes": text("top_routes", "route"),
                              "daily_shipments": text("daily_shipments", "date")})


@query("dashboard_simple", on_model(f"""
select {_FIXED}, cast(coalesce(sum("cost"), 0) as double) total_revenue, (select count(*) from hubs) total_hubs
from documents_"""))
def dashboard_simple(spark, folder):
    return R.dashboard_simple(M.documents(spark, folder), M.hubs(spark, folder))


_ROLLUP = """rolled as (
  select cast(created_at as date) "date", origin_hub_id hub_id, grouping(origin_hub_id) all_hubs,
    count(*) total_shipments, count(*) filter (where status = 'delivered') completed_shipments,
    count(*) filter (where status in ('created', 'accepted', 'collected', 'in_transit', 'at_hub', 'out_for_delivery')) pending_shipments,
    count(*) filter (where status in ('failed_delivery', 'returned', 'cancelled', 'lost', 'damaged')) failed_shipments,
    cast(coalesce(sum(total_cost), 0) as decimal(20,2)) total_revenue,
    cast(coalesce(sum(total_weight_kg), 0) as decimal(20,2)) total_weight_processed_kg,
    cast(coalesce(sum(package_count), 0) as bigint) total_packages_processed,
    sum(case when status = 'delivered' then epoch_us(actual_delivery_datetime) - epoch_us(actual_pickup_datetime) end) micros,
    count(case when status = 'delivered' then epoch_us(actual_delivery_datetime) - epoch_us(actual_pickup_datetime) end) timed,
    count(*) filter (where status = 'delivered' and actual_delivery_datetime is not null and estimated_delivery_date is not null) dated,
    count(*) filter (where status = 'delivered' and cast(actual_delivery_datetime as date) <= estimated_delivery_date) on_time
  from shipments group by grouping sets ((cast(created_at as date), origin_hub_id), (cast(created_at as date))))"""


_ROLLED = f"""
select "date", hub_id, total_shipments, completed_shipments, pending_shipments, failed_shipments, total_revenue,
  cast(0 as decimal(20,2)) total_costs, total_revenue net_profit,
  case when timed > 0 then {half_up('micros', '(timed * 3600000000)', 2, 'decimal(8,2)')} end average_delivery_time_hours,
  case when dated > 0 then {half_up('100 * on_time', 'dated', 2, 'decimal(5,2)')} end on_time_delivery_rate,
  total_weight_processed_kg, total_packages_processed, h.utilization_percentage hub_utilization_rate,
  cast(null as decimal(5,2)) route_efficiency_score, cast(null as decimal(3,1)) customer_satisfaction_score
from rolled left join hubs h on h.id = hub_id
where all_hubs = 1 or hub_id is not null"""


@query("daily_analytics_rollup", on_model(_ROLLED, _ROLLUP))
def daily_analytics_rollup(spark, folder):
    return R.daily_analytics_rollup(M.shipments(spark, folder), M.hubs(spark, folder))


_PATCHED = """
patched as (
  select id, created_at, package_count, total_weight_kg, total_cost, estimated_delivery_date, actual_pickup_datetime,
    case when status in ('in_transit', 'out_for_delivery') then 'delivered' when status = 'delivered' then 'returned' else status end status,
    case when status = 'created' then destination_hub_id else origin_hub_id end origin_hub_id,
    case when status in ('in_transit', 'out_for_delivery') then greatest(created_at, actual_pickup_datetime) + interval 60 hour
      else actual_delivery_datetime end actual_delivery_datetime
  from shipments where status <> 'failed_delivery')"""


@query("daily_rollup_kept", on_model(_ROLLED,
                                     _PATCHED, _ROLLUP.replace("from shipments", "from patched")))
def daily_rollup_kept(spark, folder):
    """Kept over three batches of changes: deliveries, moves to other hubs and returns, deletions."""
    shipments, kept = checkpointed(M.shipments(spark, folder)), KeptRollup(spark, fresh_folder(spark, "kept-rollup"))
    status = F.col("status")
    kept.create(shipments)
    open_ = shipments.where(status.isin("in_transit", "out_for_delivery"))
    arrived = F.greatest("created_at", "actual_pickup_datetime") + F.expr("interval 60 hours")
    kept.change(open_, open_.withColumns({"status": F.lit("delivered"), "actual_delivery_datetime": arrived}), 0)
    moved = shipments.where(status.isin("created", "delivered"))
    kept.change(moved, moved.withColumns({
        "origin_hub_id": F.when(status == "created", F.col("destination_hub_id")).otherwise(F.col("origin_hub_id")),
        "status": F.when(status == "delivered", "returned").otherwise(status)}), 1)
    kept.change(shipments.where(status == "failed_delivery"), shipments.where("false"), 2)
    return kept.read(M.hubs(spark, folder))
