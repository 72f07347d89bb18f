import re
from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from waybill import fixed
from waybill.functions import expressions as X
from waybill.operators import changes as C
from waybill.operators import lookup as L
from waybill.operators.quality import BROKEN
from waybill.schemas import schema_of
from waybill.sources import documents as D

NOW = "2024-03-01 10:00:00"
AS_OF = X.timestamp


def document(**changes):
    base = {
        "id": "A", "tracking_number": "T-A", "sender_name": "Ann Sender", "sender_phone": None,
        "sender_address": "1 Way", "receiver_name": "Rex Taker", "receiver_phone": None,
        "receiver_address": "2 Way", "package_details": "books", "weight": Decimal("2.50"),
        "dimensions": (1.0, 2.0, 3.0), "service_type": "standard", "status": "pending",
        "pickup_date": datetime(2024, 2, 1), "estimated_delivery": datetime(2024, 2, 4),
        "actual_delivery": None, "route": None, "hub_id": "H1", "events": None,
        "cost": Decimal("25.00"), "created_at": datetime(2024, 1, 31), "updated_at": datetime(2024, 1, 31)}
    return tuple({**base, **changes}.values())


@pytest.fixture
def table(spark):
    return spark.createDataFrame([
        document(), document(id="B", tracking_number="T-B", pickup_date=None),
        document(id="T-A", tracking_number="T-C")], schema_of("shipment_documents"))


PAYLOADS = [
    ('{"senderName":"Ann","senderAddress":"1 Way","receiverName":"Rex","receiverAddress":"2 Way",'
     '"packageDetails":"books","weight":2.5,"dimensions":{"length":1,"width":2,"height":3},'
     '"serviceType":"express","pickupDate":"2024-03-05T08:00:00","cost":25.0}'),
    ('{"senderName":"Ann","senderAddress":"1 Way","receiverName":"Rex","receiverAddress":"2 Way",'
     '"packageDetails":"books","weight":2.5,"dimensions":{"length":1,"width":2,"height":3},"cost":25.0}'),
    ('{"senderName":"","senderAddress":"1 Way","receiverName":"Rex","receiverAddress":"2 Way",'
     '"packageDetails":"books","weight":-1,"dimensions":{"length":0,"width":2,"height":3},'
     '"serviceType":"drone","senderPhone":"12a","cost":25.0}'),
    ('{"senderName":"Ann","senderAddress":"1 Way","receiverName":"Rex","receiverAddress":"2 Way",'
     '"packageDetails":"books","weight":1e9,"dimensions":{"length":1,"width":2,"height":3},'
     '"serviceType":null,"cost":25.0}'),
    '{"senderName":"Ann", "weight": ',
    None,
]


def payload_frame(spark):
    return spark.createDataFrame([(i, p) for i, p in enumerate(PAYLOADS)], "ordinal bigint, payload string")


def test_create_shipments(spark, table):
    skip = ("id", "tracking_number", "status", "estimated_delivery", "actual_delivery", "events",
            "created_at", "updated_at")
    schema = D.payload_schema(schema_of("shipment_documents"), skip)
    for f in schema.fields:  # weights and costs come as any number
        if f.name in ("weight", "cost"):
            f.dataType = schema_of("shipment_documents")["dimensions"].dataType["length"].dataType
    good, malformed = D.read_payloads(payload_frame(spark), schema)
    assert [r["ordinal"] for r in malformed.orderBy("ordinal").collect()] == [4, 5]
    created, rejects = C.create_shipments(good, table, AS_OF(NOW), "b1")
    new = {r["ordinal"]: r for r in created.collect()}
    assert set(new) == {0, 1}
    assert new[0]["estimated_delivery"] == datetime(2024, 3, 7, 8)
    assert new[1]["service_type"] == "standard" and new[1]["estimated_delivery"] == datetime(2024, 3, 4, 10)
    assert {r["status"] for r in new.values()} == {"pending"} and new[0]["cost"] == Decimal("25.00")
    assert [e["status"] for e in new[0]["events"]] == ["pending"]
    assert new[0]["events"][0]["location"] == "Origin Hub"
    assert new[0]["tracking_number"] != new[1]["tracking_number"]
    broken = {r["ordinal"]: r[BROKEN] for r in rejects.collect()}
    assert broken[2] == ["sender_name_empty", "sender_phone_not_a_phone", "weight_not_positive",
                         "dimensions.length_not_positive", "service_type_not_allowed"]
    assert broken[3] == ["weight_too_large", "service_type_not_allowed"]
    stored = set(schema_of("shipment_documents").names)
    assert stored <= set(created.columns)


def patches(spark, rows):
    schema = ("id string, seq bigint, present_fields array<string>, status string, service_type string, "
              "pickup_date timestamp_ntz, hub_id string, cost decimal(10,2), estimated_delivery timestamp_ntz")
    return spark.createDataFrame(rows, schema)


def test_patch_explicit_null_and_order(spark, table):
    given = patches(spark, [
        ("A", 1, ["status", "cost"], "in_transit", None, None, None, Decimal("9.00"), None),
        ("A", 2, ["status", "hub_id"], "delivered", None, None, None, None, None),
        ("B", 1, [], None, None, None, None, None, None),
        ("nobody", 1, ["status"], "failed", None, None, None, None, None)])
    updated, unmatched, empty = C.apply_patches(table, given, AS_OF(NOW))
    by_id = {r["id"]: r for r in updated.collect()}
    assert by_id["A"]["status"] == "delivered" and by_id["A"]["cost"] == Decimal("9.00")
    assert by_id["A"]["hub_id"] is None and by_id["A"]["updated_at"] == datetime(2024, 3, 1, 10)
    assert by_id["B"] == [r for r in table.collect() if r["id"] == "B"][0]
    assert [r["id"] for r in unmatched.collect()] == ["nobody"]
    assert [r["id"] for r in empty.collect()] == ["B"]
    assert updated.columns == table.columns

    kept, _, _ = C.apply_patches(table, given, AS_OF(NOW), mode=C.IGNORE_NULL)
    assert {r["id"]: r["hub_id"] for r in kept.collect()}["A"] == "H1"


@pytest.mark.parametrize("rows, expected", [
    # The new service counts from the stored pickup, or from now without one.
    ([("A", 1, ["service_type"], None, "overnight", None, None, None, None)], datetime(2024, 2, 2)),
    ([("B", 1, ["service_type"], None, "overnight", None, None, None, None)], datetime(2024, 3, 2, 10)),
    # A pickup in the same patch counts, a later one does not.
    ([("A", 1, ["service_type", "pickup_date"], None, "express", datetime(2024, 5, 1), None, None, None),
      ("A", 2, ["pickup_date"], None, None, datetime(2024, 6, 1), None, None, None)], datetime(2024, 5, 3)),
    # A pickup set to NULL before: from now on.
    ([("A", 1, ["pickup_date"], None, None, None, None, None, None),
      ("A", 2, ["service_type"], None, "express", None, None, None, None)], datetime(2024, 3, 3, 10)),
    # An estimate set later wins, one set in the same patch does not.
    ([("A", 1, ["service_type"], None, "express", None, None, None, None),
      ("A", 2, ["estimated_delivery"], None, None, None, None, None, datetime(2025, 1, 1))], datetime(2025, 1, 1)),
    ([("A", 1, ["service_type", "estimated_delivery"], None, "express", None, None, None, datetime(2025, 1, 1))],
     datetime(2024, 2, 3)),
    ([("A", 1, ["status"], "failed", None, None, None, None, None)], datetime(2024, 2, 4)),
])
def test_patch_recomputes_eta(spark, table, rows, expected):
    updated, _, _ = C.apply_patches(table, patches(spark, rows), AS_OF(NOW), recompute_eta=True)
    assert {r["id"]: r["estimated_delivery"] for r in updated.collect()}[rows[0][0]] == expected


def test_delete(spark, table):
    keys = spark.createDataFrame([("T-A",), ("T-B",), ("gone",), ("T-A",)], "key string")
    left, missing = C.delete_by_key(table, keys, ("id", "tracking_number"))
    # "T-A" is one row's id and another's tracking number: the id wins.
    assert sorted(r["id"] for r in left.collect()) == ["A"]
    assert [r["key"] for r in missing.collect()] == ["gone"]
    again, _ = C.delete_by_key(left, keys, ("id",))
    assert again.count() == left.count()


def test_lookup_prefers_the_id(spark, table):
    keys = spark.createDataFrame([("T-A",), ("T-B",), ("T-B",), (None,), ("x",)], "key string")
    found = {r["key"]: r["id"] for r in L.lookup_shipment(keys, table).collect()}
    assert found == {"T-A": "T-A", "T-B": "B"}


def new_events(spark):
    return spark.createDataFrame([
        ("A", datetime(2024, 2, 3), 3, "delivered", None, "left at door"),
        ("A", datetime(2024, 2, 1), 1, None, "yard", "seen"),
        ("A", datetime(2024, 2, 2), 2, "in_transit", "road", None),
        ("A", datetime(2024, 2, 4), 4, None, "desk", "note"),
        ("nobody", datetime(2024, 2, 4), 5, "failed", None, None),
    ], "shipment_id string, at timestamp_ntz, seq bigint, status string, location string, description string")


@pytest.mark.parametrize("rows_per_task", [1, 1000])
def test_append_events(spark, table, rows_per_task):
    events = new_events(spark)
    updated, unknown = C.append_events(table, events, AS_OF(NOW))
    by_id = {r["id"]: r for r in updated.collect()}
    assert by_id["A"]["status"] == "delivered" and by_id["A"]["actual_delivery"] == datetime(2024, 2, 3)
    assert by_id["A"]["updated_at"] == datetime(2024, 3, 1, 10) and by_id["B"]["updated_at"] == datetime(2024, 1, 31)
    assert [r["seq"] for r in unknown.collect()] == [5]

    timeline = C.event_timeline(table, events, rows_per_task=rows_per_task)
    seen = [(r["position"], r["status"], r["location"], r["description"]) for r in timeline.orderBy("position").collect()]
    assert seen == [(1, "pending", "yard", "seen"), (2, "in_transit", "road", ""),
                    (3, "delivered", "", "left at door"), (4, "delivered", "desk", "note")]

    history = C.with_history(updated.withColumn("events", X.initial_event("id", F.col("created_at"))),
                             C.event_pages(timeline, page_size=3))
    pages = {(r["id"], r["page"]): [e["status"] for e in r["events"]] for r in history.collect()}
    assert pages["A", 0] == ["pending", "pending", "in_transit", "delivered"]
    assert pages["A", 1] == ["delivered"] and pages["B", 0] == ["pending"]


def test_create_hubs_and_users(spark):
    hubs = spark.createDataFrame([(1, "North", "n1", "a", "c", "s", 10, "active"), (2, "South", "s1", "a", "c", "s", 0, "closed")],
                                 "ordinal int, name string, code string, address string, city string, state string, capacity int, status string")
    stored = spark.createDataFrame([("X1", "East")], "code string, name string")
    created, rejects = C.create_hubs(hubs, stored, AS_OF(NOW), "h")
    row = created.first()
    assert (row["code"], row["current_load"], row["status"]) == ("N1", 0, "active")
    assert rejects.first()[BROKEN] == ["capacity_not_positive", "status_not_allowed"]

    users = spark.createDataFrame([
        (1, "Ann", "ann@example.com", "king"), (2, "Ann", "ann@example.com", "admin"),
        (3, "Bob", "ann@example.com", "admin"), (4, "Cid", "cid@example.com", "admin"), (5, "Dee", None, "admin")],
        "ordinal int, full_name string, email string, role string")
    existing = spark.createDataFrame([("cid@example.com",)], "email string")
    created, rejects = C.create_users(users, existing, AS_OF(NOW), "u")
    # The first payload is not valid, so it does not take the email from the second.
    assert [r["ordinal"] for r in created.collect()] == [2]
    assert {r["ordinal"]: r[BROKEN] for r in rejects.collect()} == {
        1: ["role_not_allowed"], 3: ["email_exists"], 4: ["email_exists"], 5: ["email_empty"]}


def test_codes_names_and_usernames_stay_unique(spark):
    stored = spark.createDataFrame([("X1", "East")], "code string, name string")
    payloads = spark.createDataFrame(
        [(1, "North", "n1", 10), (2, "Other", "N1", 10), (3, "North", "n3", 10), (4, "West", "x1", 10), (5, "East", "e1", 10),
         (6, "Last", "l1", 10)], "ordinal int, name string, code string, capacity int").selectExpr(
        "*", "'a' address", "'c' city", "'s' state")
    created, rejects = C.create_hubs(payloads, stored, AS_OF(NOW), "h")
    assert sorted((r["ordinal"], r["code"]) for r in created.collect()) == [(1, "N1"), (6, "L1")]
    assert {r["ordinal"]: r[BROKEN] for r in rejects.collect()} == {
        2: ["code_exists"], 3: ["name_exists"], 4: ["code_exists"], 5: ["name_exists"]}

    users = spark.createDataFrame([(1, "A", "a@x.org", "a", "admin"), (2, "B", "b@x.org", "a", "admin"),
                                   (3, "C", "c@x.org", None, "admin"), (4, "D", "d@x.org", None, "admin")],
                                  "ordinal int, full_name string, email string, username string, role string")
    created, rejects = C.create_users(users, spark.createDataFrame([("q@x.org", "q")], "email string, username string"), AS_OF(NOW), "u")
    assert sorted(r["ordinal"] for r in created.collect()) == [1, 3, 4]
    assert [(r["ordinal"], r[BROKEN]) for r in rejects.collect()] == [(2, ["username_exists"])]


def test_patch_hubs(spark):
    hubs = spark.createDataFrame([(1, "North", "N1", 10, 0, "active"), (2, "South", "S1", 10, 0, "active")],
                                 "id int, name string, code string, capacity int, current_load int, status string")
    patches = spark.createDataFrame(
        [(1, 1, None, None, None, "maintenance"), (1, 2, None, None, -5, None), (2, 3, "North", None, None, None),
         (2, 4, "Mid", "S1", 30, None), (1, 5, "Mid", None, None, None), (9, 6, "Far", None, None, None),
         (1, 7, None, None, None, None)], "id int, seq int, name string, code string, capacity int, status string")
    updated, rejects, unmatched, empty = C.patch_hubs(hubs, patches, AS_OF(NOW))
    assert sorted(tuple(r) for r in updated.collect()) == [
        (1, "North", "N1", 10, 0, "maintenance"), (2, "Mid", "S1", 30, 0, "active")]
    assert {r["seq"]: r[BROKEN] for r in rejects.collect()} == {2: ["capacity_check"], 3: ["name_exists"], 5: ["name_exists"]}
    assert [r["seq"] for r in unmatched.collect()] == [6] and [r["seq"] for r in empty.collect()] == [7]


def test_insert_ignore_is_idempotent(spark):
    existing = spark.createDataFrame([("a", 0), ("b", 0)], "setting_key string, ordinal int")
    incoming = spark.createDataFrame([("b", 1), ("c", 3), ("c", 2), (None, 4), (None, 5)], existing.schema)
    fresh = L.insert_ignore(existing, incoming, ["setting_key"])
    assert sorted(map(tuple, fresh.collect()), key=str) == [("c", 2), (None, 4), (None, 5)]
    full = existing.unionByName(fresh)
    again = L.insert_ignore(full, incoming.where("setting_key is not null"), ["setting_key"])
    assert again.count() == 0


def test_pages(spark):
    rows = spark.range(10).select(F.col("id"), (X.timestamp("2024-01-01") + F.make_dt_interval((F.col("id") / 2).cast("int"))).alias("created_at"))
    assert [r["id"] for r in L.page_newest(rows, 2, 3).collect()] == [6, 7, 4]
    last = L.page_newest(rows, 2, 3).collect()[-1]
    after = L.page_after(rows, str(last["created_at"]), last["id"], 3)
    assert [r["id"] for r in after.collect()] == [r["id"] for r in L.page_newest(rows, 5, 3).collect()]
    envelope = L.page_envelope(rows, "shipments", 2, 3).first()
    assert ([r["id"] for r in envelope["shipments"]], envelope["total"], envelope["skip"], envelope["limit"]) == ([6, 7, 4], 10, 2, 3)


def test_constants():
    assert fixed.DELIVERY_DAYS["standard"] == 3 and fixed.SLOW_DELIVERY_DAYS["standard"] == 5


def test_create_shipments_parses_its_payloads_once(spark, folder):
    """What ranges, numbers and hands back rejects reads the parsed documents."""
    from waybill.plans import catalog

    plan = catalog.QUERIES["create_shipments"](spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert "from_json" not in plan and "json_object_keys" not in plan


def test_payloads_parsed_once_are_the_same(spark):
    from pyspark.sql import types as T

    from waybill.sources.documents import read_payloads

    schema = T.StructType([T.StructField("senderName", T.StringType()), T.StructField("pickUpAt", T.StringType())])
    given = spark.createDataFrame([(1, '{"senderName": null, "otherThing": 1}'), (2, '{"pickUpAt": "x"}'), (3, '{"sen'), (4, None),
                                   (5, "{}")], "ordinal bigint, payload string")
    results = [[sorted(map(str, df.collect())) for df in read_payloads(given, schema, once=once)] for once in (False, True)]
    assert results[0] == results[1]
    rows = {r["ordinal"]: r for r in read_payloads(given, schema, once=True)[0].collect()}
    assert rows[1]["present_fields"] == ["sender_name", "other_thing"] and rows[2]["present_fields"] == ["pick_up_at"]
    assert rows[2]["pick_up_at"] == "x" and rows[5]["present_fields"] == []


@pytest.mark.parametrize("mode", [C.EXPLICIT_NULL, C.IGNORE_NULL])
def test_patches_dealt_out_by_number(spark, table, mode, monkeypatch):
    """As many parts as the rows ask for, and the same three results; a patch without a key is unmatched."""
    given = patches(spark, [
        ("A", 1, ["status", "cost"], "in_transit", None, None, None, Decimal("9.00"), None),
        ("A", 2, ["status", "hub_id"], "delivered", None, None, None, None, None),
        ("B", 1, [], None, None, None, None, None, None),
        (None, 5, ["status"], "failed", None, None, None, None, None),
        ("nobody", 1, ["status"], "failed", None, None, None, None, None),
        ("nobody", 2, ["status"], "failed", None, None, None, None, None)])
    monkeypatch.setattr(C, "PATCHED_ROWS", 2)
    tasks = C.tasks_for(table, given)
    assert tasks == max(3, -(-table.count() // 2)) and C.tasks_for(table.where("false")) == 1
    dealt, usual = (C.apply_patches(table, given, AS_OF(NOW), mode=mode, tasks=n) for n in (tasks, 1))
    for one, other in zip(dealt, usual):
        assert sorted(map(str, one.collect())) == sorted(map(str, other.collect()))
    assert sorted(map(str, (r["id"] for r in dealt[1].collect()))) == ["None", "nobody", "nobody"]
    plan = dealt[0]._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(rf"RepartitionByExpression \[id#\w+\], {tasks}\b", plan)
