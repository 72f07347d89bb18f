"""The sample model in SQL, as common table expressions for the oracles."""

from __future__ import annotations

MODEL = """
lines as (
  select l_orderkey, min(l_suppkey) origin_hub_id, max(l_suppkey) destination_hub_id,
    cast(count(*) as int) n_lines, max(cast(l_quantity as decimal(10,2))) total_weight_kg,
    max(cast(cast(l_extendedprice as decimal(12,2)) * cast(l_tax as decimal(4,2)) as decimal(10,2))) fuel_surcharge,
    min(l_shipdate) first_ship, max(l_shipdate) last_ship
  from lineitem group by l_orderkey),
order_shipments as (
  select o_orderkey id, 'TN' || o_orderkey tracking_number,
    'Customer#' || lpad(cast(o_custkey as varchar), 9, '0') sender_name,
    'Receiver ' || o_orderkey receiver_name,
    cast(o_totalprice as decimal(10,2)) base_cost,
    case when o_orderstatus <> 'P' then cast(5.00 as decimal(10,2)) end additional_fees,
    case when o_orderstatus = 'F' and o_orderpriority = '5-LOW' then 'failed_delivery'
         when o_orderstatus = 'F' then 'delivered'
         when o_orderstatus = 'O' and o_orderpriority = '1-URGENT' then 'out_for_delivery'
         when o_orderstatus = 'O' then 'in_transit' else 'created' end status,
    case o_orderpriority when '1-URGENT' then 'overnight' when '2-HIGH' then 'express'
         when '5-LOW' then 'economy' else 'standard' end service_type,
    case o_orderpriority when '1-URGENT' then 'urgent' when '2-HIGH' then 'high'
         when '5-LOW' then 'low' else 'normal' end priority,
    o_custkey created_by_id, o_orderdate created_at
  from orders),
shipments as (
  select s.*, origin_hub_id, destination_hub_id, total_weight_kg, fuel_surcharge,
    first_ship actual_pickup_datetime,
    coalesce(n_lines, 1) package_count,
    case when status in ('delivered', 'failed_delivery') then destination_hub_id
         when status <> 'created' then origin_hub_id end current_hub_id,
    case when status in ('delivered', 'failed_delivery') then last_ship end actual_delivery_datetime,
    cast(coalesce(first_ship, created_at)
      + (case service_type when 'overnight' then 1 when 'express' then 2 else 3 end) * interval 1 day as date) estimated_delivery_date,
    cast(base_cost + coalesce(fuel_surcharge, 0) + coalesce(additional_fees, 0) as decimal(10,2)) total_cost,
    origin_hub_id || '-' || destination_hub_id route
  from order_shipments s left join lines l on l.l_orderkey = s.id),
hubs as (
  select *, cast(case when capacity > 0 then
      ((cast(current_load as bigint) * 20000 + capacity) // (2 * capacity)) * 0.01 else 0 end as decimal(5,2)) utilization_percentage
  from (
    select s_suppkey id, s_name "name", 'H' || s_suppkey code, 500 + 20 * s_nationkey capacity,
      cast(floor(abs(s_acctbal)) as int) % (500 + 20 * s_nationkey) current_load, 'active' status
    from supplier
    union all select -1, 'Spare hub', 'SPARE', 1000, 0, 'active')),
users as (
  select c_custkey id, c_name full_name, 'user' || c_custkey || '@example.com' email,
    'user' || c_custkey username, lower(c_mktsegment) "role"
  from customer),
shipment_events as (
  select event_id id, user_id shipment_id,
    case event_type when 'signup' then 'accepted' when 'view' then 'in_transit' when 'click' then 'at_hub'
         when 'purchase' then 'delivered' when 'error' then 'failed_delivery' end status,
    event_type description, ts event_datetime
  from events),
routes as (
  select p_partkey id, p_name "name", 'RT' || p_partkey code, cast(p_size as bigint) origin_hub_id,
    p_partkey % 50 + 1 destination_hub_id, cast(p_retailprice - 900 as decimal(10,2)) distance_km,
    p_size - 1 estimated_duration_minutes, p_size "priority",
    case p_type when 'ECONOMY' then 'ground' when 'STANDARD' then 'air' when 'PROMO' then 'rail'
         else lower(p_type) end route_type, 'active' status
  from part),
documents_ as (
  select 'SH' || o_orderkey id,
    case when o_orderpriority = '1-URGENT' then 'SH' || (o_orderkey + 1) else 'TN' || o_orderkey end tracking_number,
    'Customer#' || lpad(cast(o_custkey as varchar), 9, '0') sender_name,
    'Receiver ' || o_orderkey receiver_name, o_orderpriority package_details,
    cast(cast(o_totalprice as decimal(12,2)) * 0.001 as decimal(10,2)) weight,
    case o_orderpriority when '1-URGENT' then 'overnight' when '2-HIGH' then 'express' else 'standard' end service_type,
    case when o_orderstatus = 'F' and o_orderpriority = '5-LOW' then 'failed'
         when o_orderstatus = 'F' then 'delivered' when o_orderstatus = 'O' then 'in_transit' else 'pending' end status,
    case when o_orderpriority <> '5-LOW' then o_orderdate end pickup_date,
    case when o_orderstatus = 'F' and o_orderpriority <> '3-MEDIUM' then
      o_orderdate + (case when o_orderpriority = '4-NOT SPECIFIED' then -1 else 4 end) * interval 1 day + interval 6 hour end actual_delivery,
    case when o_orderstatus <> 'P' then 'R' || o_custkey end route, 'H' || o_custkey hub_id,
    cast(o_totalprice as decimal(10,2)) cost, o_orderdate created_at, o_orderdate updated_at
  from orders)
"""


def on_model(body: str, *more: str) -> str:
    """A query over the model, with further common table expressions in between."""
    return "with " + ",\n".join([MODEL.strip(), *(m.strip() for m in more)]) + "\n" + body.strip()


def half_up(numerator: str, denominator: str, scale: int, kind: str) -> str:
    """``numerator / denominator`` rounded half up, in whole numbers; neither may be negative."""
    factor = 10 ** scale
    unit = "0." + "0" * (scale - 1) + "1"
    return (f"cast(((2 * {factor} * cast({numerator} as hugeint) + {denominator}) // (2 * {denominator}))"
            f" * cast({unit} as decimal({scale + 1},{scale})) as {kind})")


def average(column: str, where: str = "true") -> str:
    """The mean of a two-digit decimal as decimal(14,6)."""
    picked = f"(case when {where} then {column} end)"
    return (f"case when count({picked}) > 0 then "
            + half_up(f"sum({picked}) * 100", f"(100 * count({picked}))", 6, "decimal(14,6)") + " end")


def uuid_of(*parts: str) -> str:
    digest = "md5(" + " || '|' || ".join(parts) + ")"
    cuts = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return "(" + " || '-' || ".join(f"substr({digest}, {s}, {n})" for s, n in cuts) + ")"


def iso(ts: str) -> str:
    return (f"(strftime({ts}, '%Y-%m-%dT%H:%M:%S') || case when microsecond({ts}) % 1000000 <> 0 "
            f"then '.' || strftime({ts}, '%f') else '' end)")
