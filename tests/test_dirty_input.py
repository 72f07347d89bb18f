"""Input outside of the fixtures: values that must neither fail a batch nor be dropped."""

from pyspark.sql import functions as F

from waybill.operators import hub_load as H
from waybill.operators.lookup import lookup_user_email
from waybill.operators.quality import BROKEN, fits, fk_orphans, positive, validate
from waybill.operators.tracking import assign_tracking


def loads(spark, packages, statuses):
    hubs = spark.createDataFrame([(1, 100, 40), (2, 50, 10)], "id bigint, capacity int, current_load int")
    shipments = spark.createDataFrame(
        [(7, 1, 2, packages)], "id bigint, origin_hub_id bigint, destination_hub_id bigint, package_count int")
    events = spark.createDataFrame(
        [(i, 7, s, i) for i, s in enumerate(statuses)], "id bigint, shipment_id bigint, status string, event_datetime bigint")
    changes = H.status_changes(events)
    return [r["new_load"] for r in H.hub_load_fold(hubs, shipments, changes).orderBy("id").collect()]


def test_unknown_package_count_leaves_the_limits(spark):
    assert loads(spark, None, ["delivered"]) == [0, 50]


def test_an_event_without_status_changes_none(spark):
    assert loads(spark, 5, ["in_transit", None, "in_transit"]) == [35, 10]


def test_values_that_round_out_of_their_column(spark):
    rows = spark.createDataFrame([(99999999.996,), (99999999.99,), (-1.0,), (float("nan"),), (None,)], "weight double")
    found = [r[BROKEN] for r in validate(rows, [positive("weight"), fits("weight")]).collect()]
    assert found == [["weight_too_large"], [], *[["weight_not_positive"]] * 3]


def test_rules_are_computed_once(spark):
    rows = spark.range(3).select(F.col("id").cast("double").alias("weight"))
    checked = validate(rows, [positive("weight")]).where(F.size(BROKEN) > 0)
    assert checked._jdf.queryExecution().optimizedPlan().toString().count("weight_not_positive") == 1


def test_a_stored_number_with_a_long_tail(spark):
    new = spark.createDataFrame([(1, "2024-03-01 10:00:00")], "ordinal int, at string").select(
        "ordinal", F.col("at").cast("timestamp_ntz").alias("created_at"), F.lit(None).cast("string").alias("tracking_number"))
    none = spark.createDataFrame([], "tracking_number string")
    base = assign_tracking(new, none).first()["tracking_number"][:-3]
    stored = spark.createDataFrame([(base + "999" + "9" * 19,), (base + "000",)], "tracking_number string")
    assert assign_tracking(new, stored).first()["tracking_number"] == base + "001"


def test_references_between_text_ids(spark):
    hubs = spark.createDataFrame([("HUB1",)], "id string")
    routes = spark.createDataFrame([("HUB1", "HUB2")], "origin_hub_id string, destination_hub_id string")
    found = {r["rule"]: r["violations"] for r in fk_orphans({"hubs": hubs, "routes": routes}).collect()}
    assert found == {"origin_hub_id_reference": 0, "destination_hub_id_reference": 1}


def test_one_row_per_key(spark):
    users = spark.createDataFrame([(2, "a@x.example"), (1, "a@x.example")], "id bigint, email string")
    keys = spark.createDataFrame([("a@x.example",)], "key string")
    assert [r["id"] for r in lookup_user_email(keys, users).collect()] == [1]
