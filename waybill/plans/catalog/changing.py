"""Bulk create, patch, delete, event append, hub load, and the streams."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from waybill.functions import expressions as X
from waybill.operators import changes as C
from waybill.operators.hub_load import hub_load_fold as fold_load
from waybill.operators.hub_load import status_changes
from waybill.operators.quality import BROKEN
from waybill.operators.tracking import assign_tracking as assign
from waybill.plans import sample_model as M
from waybill.plans.catalog.model_sql import on_model, uuid_of
from waybill.plans.catalog.reading import CHANGES_SQL
from waybill.plans.catalog.registry import query
from waybill.session import fresh_folder
from waybill.sources import documents as D
from waybill.streaming import events as E
from waybill.streaming.store import latest_by_key, read_epochs

AS_OF = X.timestamp


# --- create ------------------------------------------------------------------------------------

_NEW_NUMBER = """
ranked as (select *, row_number() over (partition by base order by ordinal) rn from fresh),
used as (select distinct number[1:14] base, cast(number[15:17] as int) counter from taken),
free as (
  select base, counter, row_number() over (partition by base order by counter) rn
  from (select distinct base from fresh) cross join range(0, 1000) r(counter)
  where (base, counter) not in (select base, counter from used)),
free_count as (select base, count(*) n from free group by base),
numbered as (
  select r.*, coalesce(r.base || lpad(cast(f.counter as varchar), 3, '0'),
    r.base || '999' || case when r.rn - coalesce(n, 0) - 1 < 1000
      then lpad(cast(r.rn - coalesce(n, 0) - 1 as varchar), 3, '0') else cast(r.rn - coalesce(n, 0) - 1 as varchar) end) tracking_number
  from ranked r left join free f on f.base = r.base and f.rn = r.rn left join free_count c on c.base = r.base)"""


@query("assign_tracking", f"""
with fresh as (
  select o_orderkey ordinal, 'BC' || strftime(born, '%Y%m%d')
    || lpad(cast((epoch_us(born) // 1000000) % 10000 as varchar), 4, '0') base
  from (select *, case when o_orderstatus = 'P' then timestamp '2001-08-01' else o_orderdate end born from orders)),
taken as (
  select 'BC' || strftime(o_orderdate, '%Y%m%d') || lpad(cast((epoch_us(o_orderdate) // 1000000) % 10000 as varchar), 4, '0')
    || lpad(cast(o_custkey % 5 as varchar), 3, '0') number
  from orders),
{_NEW_NUMBER}
select ordinal, tracking_number from numbered""")
def assign_tracking(spark, folder):
    orders = M.table(spark, folder, "orders")
    day = F.when(F.col("o_orderstatus") == "P", AS_OF(M.SHIPMENTS_AS_OF)).otherwise(F.col("o_orderdate"))
    new = orders.select(F.col("o_orderkey").alias("ordinal"), day.alias("created_at"))
    existing = orders.select(X.tracking_number("o_orderdate", F.col("o_custkey") % 5).alias("tracking_number"))
    return assign(new, existing).select("ordinal", "tracking_number")


_PAYLOAD = T.StructType([
    T.StructField("senderName", T.StringType()), T.StructField("senderAddress", T.StringType()),
    T.StructField("receiverName", T.StringType()), T.StructField("receiverAddress", T.StringType()),
    T.StructField("packageDetails", T.StringType()), T.StructField("weight", T.DoubleType()),
    T.StructField("dimensions", T.StructType([
        T.StructField(s, T.DoubleType()) for s in ("length", "width", "height")])),
    T.StructField("serviceType", T.StringType()), T.StructField("pickupDate", T.TimestampNTZType()),
    T.StructField("cost", T.DoubleType()),
])


@query("create_shipments", on_model(f"""
select ordinal, {uuid_of("'batch-1'", 'ordinal')} id, tracking_number, 'pending' status, service_type,
  coalesce(pickup_date, timestamp '2001-08-01')
    + (case service_type when 'overnight' then 1 when 'express' then 2 else 3 end) * interval 1 day estimated_delivery,
  "cost", cast(1 as bigint) n_events, '' rules
from numbered
union all select ordinal, null, null, null, null, null, null, null, rules from incoming where rules <> ''""", """
incoming as (
  select cast(substr(id, 3) as bigint) ordinal, service_type, pickup_date, "cost",
    case when cast(substr(id, 3) as bigint) % 11 = 3 then 'malformed' else
      concat_ws(',', case when status = 'failed' then 'sender_name_empty' end,
                     case when weight <= 50 then 'weight_not_positive' end) end rules
  from documents_),
fresh as (select *, 'BC' || '20010801' || lpad(cast((epoch_us(timestamp '2001-08-01') // 1000000) % 10000 as varchar), 4, '0') base
  from incoming where rules = ''),
taken as (
  select 'BC' || '20010801' || lpad(cast((epoch_us(timestamp '2001-08-01') // 1000000) % 10000 as varchar), 4, '0')
    || lpad(cast(3 * s_suppkey % 1000 as varchar), 3, '0') number from supplier)""", _NEW_NUMBER))
def create_shipments(spark, folder):
    # The orders are one file of one row group, which one task would have to write and parse as JSON; payloads come in many.
    rows = M.documents(spark, folder).repartition("id")
    # A standard payload leaves its service type out; a failed one has an empty sender name.
    text = F.to_json(F.struct(
        F.when(F.col("status") != "failed", F.col("sender_name")).otherwise("").alias("senderName"),
        F.lit("1 First St").alias("senderAddress"), F.col("receiver_name").alias("receiverName"),
        F.lit("2 Second St").alias("receiverAddress"), F.col("package_details").alias("packageDetails"),
        (F.col("weight") - 50).cast("double").alias("weight"),
        F.struct(*[F.lit(2.5).alias(s) for s in ("length", "width", "height")]).alias("dimensions"),
        F.when(F.col("service_type") != "standard", F.col("service_type")).alias("serviceType"),
        X.iso_timestamp("pickup_date").alias("pickupDate"), F.col("cost").cast("double").alias("cost")))
    ordinal = F.substring("id", 3, 20).cast("bigint")
    # Every eleventh document is cut off in the middle.
    cut = F.when(ordinal % 11 == 3, F.substring(text, 1, 40)).otherwise(text)
    good, malformed = D.read_payloads(rows.select(ordinal.alias("ordinal"), cut.alias("payload")), _PAYLOAD, once=True)
    existing = M.table(spark, folder, "supplier").select(
        X.tracking_number(AS_OF(M.SHIPMENTS_AS_OF), 3 * F.col("s_suppkey") % 1000).alias("tracking_number"))
    created, rejects = C.create_shipments(good, existing, AS_OF(M.SHIPMENTS_AS_OF), "batch-1")
    created = created.select("ordinal", "id", "tracking_number", "status", "service_type", "estimated_delivery",
                             "cost", F.size("events").cast("bigint").alias("n_events"), F.lit("").alias("rules"))
    left = (rejects.select("ordinal", F.array_join(BROKEN, ",").alias("rules"))
            .unionByName(malformed.select("ordinal", F.lit("malformed").alias("rules"))))
    return created.unionByName(left, allowMissingColumns=True)


@query("create_hubs", on_model(f"""
select ordinal, case when rules = '' then {uuid_of("'hubs-1'", 'ordinal')} end id,
  case when rules = '' then code end code, case when rules = '' then 0 end current_load,
  case when rules = '' then 'active' end status, case when rules = '' then timestamp '2001-08-01' end created_at, rules
from (select ordinal, code, case when not ok then 'capacity_not_positive' else concat_ws(',',
    case when code in (select code from hubs) or ordinal <> min(ordinal) over (partition by ok, code) then 'code_exists' end,
    case when "name" in (select "name" from hubs) or ordinal <> min(ordinal) over (partition by ok, "name")
      then 'name_exists' end) end rules
  from payloads)""", """
payloads as (select c_custkey ordinal, 'H' || (7 * c_custkey % 1200) code,
  'Supplier#' || lpad(cast(3 * c_custkey % 1300 as varchar), 9, '0') "name", c_acctbal > 0 ok from customer)"""))
def create_hubs(spark, folder):
    key = F.col("c_custkey")
    payloads = M.table(spark, folder, "customer").select(
        key.alias("ordinal"),
        F.concat(F.lit("Supplier#"), F.lpad((3 * key % 1300).cast("string"), 9, "0")).alias("name"),
        F.concat(F.lit("h"), (7 * key % 1200).cast("string")).alias("code"), F.lit("a").alias("address"),
        F.lit("c").alias("city"), F.lit("s").alias("state"), F.ceil("c_acctbal").cast("int").alias("capacity"))
    created, rejects = C.create_hubs(payloads, M.hubs(spark, folder), AS_OF(M.SHIPMENTS_AS_OF), "hubs-1")
    created = created.select("ordinal", "id", "code", "current_load", "status", "created_at", F.lit("").alias("rules"))
    return created.unionByName(rejects.select("ordinal", F.array_join(BROKEN, ",").alias("rules")),
                               allowMissingColumns=True)


@query("create_users", on_model(f"""
select ordinal, email, case when rules = '' then {uuid_of("'users-1'", 'ordinal')} end id, rules
from (select ordinal, email, case when not ok then 'role_not_allowed' else concat_ws(',',
    case when email in (select email from users) or ordinal <> min(ordinal) over (partition by ok, email) then 'email_exists' end,
    case when username in (select username from users) or ordinal <> min(ordinal) over (partition by ok, username)
      then 'username_exists' end) end rules
  from payloads)""", """
payloads as (select event_id ordinal, 'user' || (event_id * 3 % 7000) || '@example.com' email,
  'user' || (event_id * 7 % 9000) username, event_type <> 'error' ok from events)"""))
def create_users(spark, folder):
    kind = {"signup": "admin", "view": "viewer", "click": "operator", "purchase": "manager"}
    key = F.col("event_id")
    payloads = M.table(spark, folder, "events").select(
        key.alias("ordinal"), F.lit("Some Name").alias("full_name"),
        F.concat(F.lit("user"), (key * 3 % 7000).cast("string"), F.lit("@example.com")).alias("email"),
        F.concat(F.lit("user"), (key * 7 % 9000).cast("string")).alias("username"),
        M.chosen("event_type", kind, F.lit("robot")).alias("role"))
    created, rejects = C.create_users(payloads, M.users(spark, folder), AS_OF(M.EVENTS_AS_OF), "users-1")
    return (created.select("ordinal", "email", "id", F.lit("").alias("rules"))
            .unionByName(rejects.select("ordinal", "email", F.array_join(BROKEN, ",").alias("rules")),
                         allowMissingColumns=True))


# --- patch and delete --------------------------------------------------------------------------

def _patches(spark, folder, unknown=True):
    """One patch per event; the kind of event says which fields are present."""
    kind, value = F.col("event_type"), F.col("value")
    present = (F.when(kind == "view", F.array(F.lit("status")))
               .when(kind == "click", F.array(F.lit("service_type")))
               .when(kind == "purchase", F.array(F.lit("cost"), F.lit("route")))
               .when(kind == "error", F.array(F.lit("hub_id"), F.lit("pickup_date")))
               .otherwise(F.array().cast("array<string>")))
    prefix = F.when((value > 400) & F.lit(unknown), "XX").otherwise("SH")
    return M.table(spark, folder, "events").select(
        F.concat(prefix, F.col("user_id").cast("string")).alias("id"), F.col("event_id").alias("seq"),
        present.alias(D.PRESENT),
        F.when(kind == "view", F.when(value > 60, "picked_up").otherwise("in_transit")).alias("status"),
        F.when(kind == "click", F.when(value > 60, "express").otherwise("overnight")).alias("service_type"),
        F.when(kind == "purchase", value.cast("decimal(10,2)")).alias("cost"),
        F.when((kind == "purchase") & (value > 60), F.lit("R9")).alias("route"),
        F.lit(None).cast("string").alias("hub_id"),
        F.when(kind == "error", F.date_trunc("day", "ts").cast("timestamp_ntz")).alias("pickup_date"))


def _patches_sql(unknown=True):
    prefix = "case when value > 400 then 'XX' else 'SH' end" if unknown else "'SH'"
    return f"""
patches as (
  select {prefix} || user_id id, event_id seq, event_type kind,
    case when event_type = 'view' then case when value > 60 then 'picked_up' else 'in_transit' end end status,
    case when event_type = 'click' then case when value > 60 then 'express' else 'overnight' end end service_type,
    case when event_type = 'purchase' then cast(value as decimal(10,2)) end "cost",
    case when event_type = 'purchase' and value > 60 then 'R9' end route,
    case when event_type = 'error' then date_trunc('day', ts) end pickup_date
  from events),
combined as (
  select id, count(*) filter (where kind <> 'signup') n_set,
    (list(status order by seq desc) filter (where kind = 'view'))[1] status,
    (list(service_type order by seq desc) filter (where kind = 'click'))[1] service_type,
    (list("cost" order by seq desc) filter (where kind = 'purchase'))[1] "cost",
    (list(route order by seq desc) filter (where kind = 'purchase'))[1] route,
    (list(route order by seq desc) filter (where route is not null))[1] known_route,
    (list(pickup_date order by seq desc) filter (where kind = 'error'))[1] pickup_date,
    max(seq) filter (where kind = 'click') service_seq,
    count(*) filter (where kind = 'purchase') n_route, count(*) filter (where kind = 'error') n_hub
  from patches group by id)"""


_PATCHED = """
select d.id, coalesce(c.status, d.status) status, coalesce(c.service_type, d.service_type) service_type,
  coalesce(c."cost", d."cost") "cost", {route} route, {hub} hub_id,
  coalesce(c.pickup_date, d.pickup_date) pickup_date,
  case when {changed} > 0 then timestamp '2024-01-31' else d.updated_at end updated_at, 'kept' part
from documents_ d left join combined c on c.id = d.id
union all select id, null, null, null, null, null, null, null, 'unmatched ' || seq from patches
  where {something} and id not in (select id from documents_)
union all select id, null, null, null, null, null, null, null, 'empty ' || seq from patches where not ({something})"""


def _patched(parts):
    updated, unmatched, empty = parts
    shown = ["id", "status", "service_type", "cost", "route", "hub_id", "pickup_date", "updated_at"]
    seq = F.col("seq").cast("string")
    return (updated.select(*shown, F.lit("kept").alias("part"))
            .unionByName(unmatched.select("id", F.concat(F.lit("unmatched "), seq).alias("part")), True)
            .unionByName(empty.select("id", F.concat(F.lit("empty "), seq).alias("part")), True))


@query("apply_patches", on_model(_PATCHED.format(
    route="case when n_route > 0 then c.route else d.route end",
    hub="case when n_hub > 0 then null else d.hub_id end", changed="n_set", something="kind <> 'signup'"), _patches_sql()))
def apply_patches(spark, folder):
    rows, patches = M.documents(spark, folder), _patches(spark, folder)
    return _patched(C.apply_patches(rows, patches, AS_OF(M.EVENTS_AS_OF), tasks=C.tasks_for(rows, patches)))


@query("apply_patches_ignore_null", on_model(_PATCHED.format(
    route="coalesce(c.known_route, d.route)", hub="d.hub_id", changed="n_set", something="kind <> 'signup'"), _patches_sql()))
def apply_patches_ignore_null(spark, folder):
    rows, patches = M.documents(spark, folder), _patches(spark, folder)
    return _patched(C.apply_patches(rows, patches, AS_OF(M.EVENTS_AS_OF), mode=C.IGNORE_NULL, tasks=C.tasks_for(rows, patches)))


@query("patch_recompute_eta", on_model("""
select d.id, coalesce(c.service_type, d.service_type) service_type,
  case when c.service_type is not null then
    coalesce((select list(p.pickup_date order by seq desc)[1] from patches p
              where p.id = d.id and kind = 'error' and p.seq <= c.service_seq), d.pickup_date, timestamp '2024-01-31')
    + (case c.service_type when 'overnight' then 1 when 'express' then 2 else 3 end) * interval 1 day
  else d.created_at end estimated_delivery
from documents_ d left join combined c on c.id = d.id""", _patches_sql()))
def patch_recompute_eta(spark, folder):
    rows = M.documents(spark, folder).withColumn("estimated_delivery", F.col("created_at"))
    patches = _patches(spark, folder)
    updated, _, _ = C.apply_patches(rows, patches, AS_OF(M.EVENTS_AS_OF), recompute_eta=True, tasks=C.tasks_for(rows, patches))
    return updated.select("id", "service_type", "estimated_delivery")


@query("patch_hubs", on_model("""
select h.id, coalesce(c."name", h."name") "name", coalesce(c.code, h.code) code, coalesce(c.capacity, h.capacity) capacity,
  coalesce(c.status, h.status) status, 'kept' part
from hubs h left join (
  select id, arg_max("name", seq) filter (where "name" is not null) "name", arg_max(code, seq) filter (where code is not null) code,
    arg_max(capacity, seq) filter (where capacity is not null) capacity, arg_max(status, seq) filter (where status is not null) status
  from judged where rules = '' group by id) c on c.id = h.id
union all select id, null, null, null, null, 'rejected ' || seq || ' ' || rules from judged where rules <> ''
union all select id, null, null, null, null, 'unmatched ' || seq from judged
  where rules = '' and kind <> 'signup' and id not in (select id from hubs)
union all select id, null, null, null, null, 'empty ' || seq from judged where rules = '' and kind = 'signup'""", """
hub_patches as (
  select event_id % 150 id, event_id seq, event_type kind,
    case when event_type = 'view' then case when value > 100 then 'gone' when value > 30 then 'maintenance' else 'closed' end end status,
    case when event_type = 'click' then cast(floor(value) as int) - 20 end capacity,
    case when event_type = 'purchase' then 'Hub ' || (event_id % 400) end "name",
    case when event_type = 'error' then 'H' || (event_id % 300) end code
  from events),
sound as (select * from hub_patches where coalesce(status, '') <> 'gone' and coalesce(capacity, 1) > 0),
owners as (
  select 'name' field, "name" as value, arg_min(id, seq) id from sound where "name" is not null and id in (select id from hubs) group by 2
  union all
  select 'code', code, arg_min(id, seq) from sound where code is not null and id in (select id from hubs) group by 2),
stored as (select 'name' field, "name" as value, id from hubs union all select 'code', code, id from hubs),
judged as (
  select p.*, concat_ws(',', case when status = 'gone' then 'status_check' end, case when capacity <= 0 then 'capacity_check' end,
    case when exists (from owners o where o.field = 'name' and o.value = p."name" and o.id <> p.id)
           then 'name_exists' end,
    case when coalesce((select s.id from stored s where s.field = 'code' and s.value = p.code
                          and exists (from owners o where o.field = 'code' and o.value = p.code)),
                       (select o.id from owners o where o.field = 'code' and o.value = p.code)) <> p.id then 'code_exists' end) rules
  from hub_patches p)"""))
def patch_hubs(spark, folder):
    kind, value, event = F.col("event_type"), F.col("value"), F.col("event_id")
    patches = M.table(spark, folder, "events").select(
        (event % 150).alias("id"), event.alias("seq"),
        F.when(kind == "view", F.when(value > 100, "gone").when(value > 30, "maintenance").otherwise("closed")).alias("status"),
        F.when(kind == "click", F.floor("value").cast("int") - 20).alias("capacity"),
        F.when(kind == "purchase", F.concat(F.lit("Hub "), (event % 400).cast("string"))).alias("name"),
        F.when(kind == "error", F.concat(F.lit("H"), (event % 300).cast("string"))).alias("code"))
    hubs, rejects, unmatched, empty = C.patch_hubs(M.hubs(spark, folder), patches, AS_OF(M.EVENTS_AS_OF))

    def part(rows, *text):
        return rows.select("id", F.concat_ws(" ", *text).alias("part"))

    left = [part(rejects, F.lit("rejected"), "seq", F.array_join(BROKEN, ",")), part(unmatched, F.lit("unmatched"), "seq"),
            part(empty, F.lit("empty"), "seq")]
    out = hubs.select("id", "name", "code", "capacity", "status", F.lit("kept").alias("part"))
    for rows in left:
        out = out.unionByName(rows, allowMissingColumns=True)
    return out


@query("delete_by_key", on_model("""
select id, 'kept' part from documents_ where id not in (select id from gone)
union all select "key", 'missing' from keys where "key" not in (select "key" from hits)""", """
keys as (select distinct case event_type when 'view' then 'TN' || user_id when 'error' then 'XX' || user_id else 'SH' || user_id end "key" from events),
hits as (
  select "key", id from (
    select "key", d.id, row_number() over (partition by "key" order by d.id <> "key") rn
    from keys join documents_ d on d.id = "key" or d.tracking_number = "key") where rn = 1),
gone as (select id from hits)"""))
def delete_by_key(spark, folder):
    prefix = M.chosen("event_type", {"view": "TN", "error": "XX"}, F.lit("SH"))
    keys = M.table(spark, folder, "events").select(F.concat(prefix, F.col("user_id").cast("string")).alias("key"))
    left, missing = C.delete_by_key(M.documents(spark, folder), keys, ("id", "tracking_number"))
    return (left.select("id", F.lit("kept").alias("part"))
            .unionByName(missing.select(F.col("key").alias("id"), F.lit("missing").alias("part"))))


@query("touch_updated_at", on_model("""
select id, case when status <> 'pending' then timestamp '2024-01-31' else updated_at end updated_at from documents_"""))
def touch_updated_at(spark, folder):
    return C.touch_updated_at(M.documents(spark, folder), F.col("status") != "pending",
                              AS_OF(M.EVENTS_AS_OF)).select("id", "updated_at")


# --- events ------------------------------------------------------------------------------------

def _new_events(spark, folder):
    kind, value = F.col("event_type"), F.col("value")
    statuses = {"view": "in_transit", "purchase": "delivered", "error": "failed"}
    prefix = F.when(value > 400, "XX").otherwise("SH")
    return M.table(spark, folder, "events").select(
        F.concat(prefix, F.col("user_id").cast("string")).alias("shipment_id"), F.col("event_id").alias("seq"),
        F.col("ts").alias("at"), M.chosen("event_type", statuses, F.lit(None).cast("string")).alias("status"),
        F.when(value < 100, kind).alias("location"), F.when(value > 5, kind).alias("description"))


_EVENTS_SQL = """
appended as (
  select case when value > 400 then 'XX' else 'SH' end || user_id shipment_id, event_id seq, ts "at",
    case event_type when 'view' then 'in_transit' when 'purchase' then 'delivered' when 'error' then 'failed' end status,
    case when value < 100 then event_type end "location", case when value > 5 then event_type end description
  from events),
timeline as (
  select a.shipment_id, seq, "at", row_number() over w position,
    coalesce(last_value(a.status ignore nulls) over w, d.status) status,
    coalesce("location", '') "location", coalesce(description, '') description
  from appended a join documents_ d on d.id = a.shipment_id
  window w as (partition by a.shipment_id order by "at", seq rows between unbounded preceding and current row))"""


@query("append_events", on_model("""
select d.id, coalesce(s.status, d.status) status, coalesce(delivered, d.actual_delivery) actual_delivery,
  case when s.shipment_id is not null then timestamp '2024-01-31' else d.updated_at end updated_at, 'shipment' part
from documents_ d left join (
  select shipment_id, arg_max(status, ("at", seq)) filter (where status is not null) status,
    max("at") filter (where status = 'delivered') delivered from appended group by 1) s on s.shipment_id = d.id
union all select shipment_id, null, null, null, 'unknown ' || seq from appended
  where shipment_id not in (select id from documents_)""", _EVENTS_SQL))
def append_events(spark, folder):
    updated, unknown = C.append_events(M.documents(spark, folder), _new_events(spark, folder), AS_OF(M.EVENTS_AS_OF))
    return (updated.select("id", "status", "actual_delivery", "updated_at", F.lit("shipment").alias("part"))
            .unionByName(unknown.select(F.col("shipment_id").alias("id"), F.concat(
                F.lit("unknown "), F.col("seq").cast("string")).alias("part")), True))


@query("event_timeline", on_model("""select * from timeline""", _EVENTS_SQL))
def event_timeline(spark, folder):
    return C.event_timeline(M.documents(spark, folder), _new_events(spark, folder))


@query("event_pages", on_model("""
select d.id, cast(coalesce((position - 1) // 25, 0) as bigint) page,
  string_agg(cast(seq as varchar) || ' ' || t.status, ',' order by position) events
from documents_ d left join timeline t on t.shipment_id = d.id group by 1, 2""", _EVENTS_SQL))
def event_pages(spark, folder):
    shipments = M.documents(spark, folder)
    pages = C.event_pages(C.event_timeline(shipments, _new_events(spark, folder)), page_size=25)
    documents = C.with_history(shipments.withColumn("events", F.lit(None).cast(pages.schema["events"].dataType)), pages)
    text = F.transform("events", lambda e: F.concat_ws(" ", e["id"], e["status"]))
    return documents.select("id", "page", F.when(F.size("events") > 0, F.array_join(text, ",")).alias("events"))


@query("append_with_history", on_model("""
select d.id, cast(coalesce((position - 1) // 25, 0) as bigint) page, coalesce(any_value(s.status), d.status) status,
  coalesce(any_value(delivered), d.actual_delivery) actual_delivery,
  case when any_value(s.shipment_id) is not null then timestamp '2024-01-31' else d.updated_at end updated_at,
  concat_ws(',', case when coalesce(min(position), 1) <= 25 then 'EV' || d.id || ' pending' end,
    string_agg(cast(seq as varchar) || ' ' || t.status, ',' order by position)) events
from documents_ d left join timeline t on t.shipment_id = d.id left join (
  select shipment_id, arg_max(status, ("at", seq)) filter (where status is not null) status,
    max("at") filter (where status = 'delivered') delivered from appended group by 1) s on s.shipment_id = d.id
group by d.id, page, d.status, d.actual_delivery, d.updated_at
union all select shipment_id, null, null, null, null, 'unknown ' || seq from appended
  where shipment_id not in (select id from documents_)""", _EVENTS_SQL))
def append_with_history(spark, folder):
    shipments = M.documents(spark, folder)
    stored = shipments.withColumn("events", X.initial_event(F.concat(F.lit("EV"), "id"), F.col("created_at")))
    documents, unknown = C.append_with_history(stored, _new_events(spark, folder), AS_OF(M.EVENTS_AS_OF), page_size=25)
    text = F.array_join(F.transform("events", lambda e: F.concat_ws(" ", e["id"], e["status"])), ",")
    return (documents.select("id", "page", "status", "actual_delivery", "updated_at", text.alias("events"))
            .unionByName(unknown.select(F.col("shipment_id").alias("id"), F.concat(
                F.lit("unknown "), F.col("seq").cast("string")).alias("events")), True))


# --- hub load ----------------------------------------------------------------------------------

_STEPS_SQL = """
steps as (
  select origin_hub_id hub_id, c.event_datetime "at", c.id seq, 0 step, package_count packages
  from changes c join shipments s on s.id = c.shipment_id where origin_hub_id is not null
  union all
  select destination_hub_id, c.event_datetime, c.id, 1, package_count
  from changes c join shipments s on s.id = c.shipment_id where c.status = 'delivered' and destination_hub_id is not null),
replayed as (
  select hub_id, list({'step': step, 'packages': cast(packages as bigint)} order by "at", seq, step) moves from steps group by hub_id)"""
_FOLD_SQL = """
select h.id, h.current_load, coalesce(list_reduce(moves,
    lambda x, m: {'step': 0, 'packages': case when m.step = 0 then greatest(0, x.packages - m.packages)
                                              else least(cast(h.capacity as bigint), x.packages + m.packages) end},
    {'step': 0, 'packages': cast(h.current_load as bigint)}).packages, h.current_load) new_load
from hubs h left join replayed r on r.hub_id = h.id"""


@query("hub_load_fold", on_model(_FOLD_SQL, CHANGES_SQL, _STEPS_SQL))
def hub_load_fold(spark, folder):
    changes = status_changes(M.shipment_events(spark, folder))
    loads = fold_load(M.hubs(spark, folder), M.shipments(spark, folder), changes)
    return loads.select("id", "current_load", "new_load")


# --- streams -----------------------------------------------------------------------------------

def _event_stream(spark, folder):
    """The events file as a stream of shipment events."""
    schema = spark.read.parquet(f"{folder}/events.parquet").schema
    raw = (spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet")
           .option("maxFilesPerTrigger", 64).parquet(folder))
    return raw.select(F.col("event_id").alias("id"), F.col("user_id").alias("shipment_id"),
                      M.chosen("event_type", M.EVENT_STATUS, F.lit(None)).alias("status"),
                      F.col("ts").alias("event_datetime"), "event_type", "value")


@query("stream_current_status", on_model("""
select shipment_id, arg_max(status, (event_datetime, id)) status,
  max(event_datetime) filter (where status = 'delivered') actual_delivery
from shipment_events group by 1"""))
def stream_current_status(spark, folder):
    out = fresh_folder(spark, "current-status")
    table = E.status_table(spark, f"{out}/table", buckets=8)
    table.create(spark.createDataFrame([], table.rows))
    E.stream_current_status(_event_stream(spark, folder), out, f"{out}/checkpoint", table=table)
    return table.read().select("shipment_id", "status", "actual_delivery")


@query("stream_daily_counts", on_model("""
select cast(event_datetime as date) "date", status, count(*) events from shipment_events group by 1, 2"""))
def stream_daily_counts(spark, folder):
    out = fresh_folder(spark, "daily-counts")
    E.stream_daily_counts(_event_stream(spark, folder), f"{out}/rows", f"{out}/checkpoint")
    return latest_by_key(read_epochs(spark, f"{out}/rows"), ["date", "status"])


@query("stream_hub_load", on_model(_FOLD_SQL.replace("h.current_load, coalesce", "coalesce"), CHANGES_SQL, _STEPS_SQL))
def stream_hub_load(spark, folder):
    out = fresh_folder(spark, "hub-load")
    E.stream_hub_load(_event_stream(spark, folder), M.shipments(spark, folder), M.hubs(spark, folder),
                      out, f"{out}/checkpoint")
    return E.read_hub_load(spark, out).select("id", F.col("current_load").cast("bigint").alias("new_load"))


@query("stream_upsert", on_model("""
select d.id, coalesce(c.status, d.status) status, coalesce(c.service_type, d.service_type) service_type,
  case when n_set > 0 then timestamp '2024-01-31' else d.updated_at end updated_at
from documents_ d left join (
  select 'SH' || user_id id, count(*) n_set,
    (list(status order by event_id desc) filter (where event_type = 'view'))[1] status,
    (list(service_type order by event_id desc) filter (where event_type = 'click'))[1] service_type
  from (select *, 'picked_up' status, case when value > 60 then 'express' else 'overnight' end service_type from events)
  where event_type in ('view', 'click') group by 1) c on c.id = d.id"""))
def stream_upsert(spark, folder):
    kind = F.col("event_type")
    patches = _event_stream(spark, folder).select(
        F.concat(F.lit("SH"), F.col("shipment_id").cast("string")).alias("id"), F.col("id").alias("seq"),
        F.when(kind == "view", F.array(F.lit("status"))).when(kind == "click", F.array(F.lit("service_type")))
        # Not a document status: the purchase patches are rejected.
        .when(kind == "purchase", F.array(F.lit("status")))
        .otherwise(F.array().cast("array<string>")).alias(D.PRESENT),
        F.when(kind == "view", "picked_up").when(kind == "purchase", "sold").alias("status"),
        F.when(kind == "click", F.when(F.col("value") > 60, "express").otherwise("overnight")).alias("service_type"))
    out, documents = fresh_folder(spark, "upsert"), M.documents(spark, folder)
    table = E.patched_table(documents, patches, f"{out}/table", AS_OF(M.EVENTS_AS_OF), buckets=8)
    table.create(documents)
    E.stream_upsert(patches, out, f"{out}/checkpoint", table=table)
    return table.read().select("id", "status", "service_type", "updated_at")
