from datetime import date, datetime
from decimal import Decimal

from pyspark.sql import functions as F

from waybill.functions import expressions as X
from waybill.plans import reports as R


def hubs(spark):
    return spark.createDataFrame(
        [(1, "N"), (2, "S"), (3, "old only"), (4, "empty")], "id bigint, name string").withColumns({
            "capacity": F.lit(10), "current_load": F.lit(5), "status": F.lit("active"),
            "utilization_percentage": F.lit("50").cast("decimal(5,2)")})


def shipments(spark):
    rows = [(1, 1, 2, "delivered", "10.00", "2024-03-01 00:00:00"), (2, 1, 1, "created", None, "2024-02-28 00:00:00"),
            (3, None, 2, "lost", "1.01", "2024-01-31 00:00:00"), (4, 3, None, "created", "9.00", "2024-01-30 23:59:59")]
    return spark.createDataFrame(
        [(*r[:4], r[4] and Decimal(r[4]), r[5]) for r in rows],
        "id bigint, origin_hub_id bigint, destination_hub_id bigint, status string, total_cost decimal(10,2), at string",
    ).withColumn("created_at", F.col("at").cast("timestamp_ntz")).withColumn("total_weight_kg", F.col("total_cost"))


def test_hub_performance_equals_a_loop(spark):
    mine = R.hub_performance(hubs(spark), shipments(spark), "2024-03-01 15:00:00")
    found = {r["id"]: (r["total_shipments"], r["delivered_shipments"], r["total_revenue"]) for r in mine.collect()}
    # Hub 3 has only a shipment just outside of the 30 days, hub 4 none at all.
    assert found == {1: (2, 1, Decimal("10.00")), 2: (2, 1, Decimal("11.01")), 4: (0, 0, None)}
    moves, first = shipments(spark).collect(), datetime(2024, 1, 31)
    for hub in hubs(spark).collect():
        here = [s for s in moves if hub["id"] in (s["origin_hub_id"], s["destination_hub_id"])]
        recent = [s for s in here if s["created_at"] >= first]
        if here and not recent:
            assert hub["id"] not in found
        else:
            costs = [s["total_cost"] for s in recent if s["total_cost"] is not None]
            assert found[hub["id"]] == (len(recent), sum(s["status"] == "delivered" for s in recent),
                                        sum(costs) if costs else None)


def test_hub_performance_has_no_nested_loop(spark):
    plan = R.hub_performance(hubs(spark), shipments(spark), "2024-03-01")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_daily_summary_bound(spark):
    days = R.daily_summary(shipments(spark), "2024-04-30 12:00:00").collect()
    assert [r["date"] for r in days] == [date(2024, 3, 1), date(2024, 2, 28), date(2024, 1, 31)]


def documents(spark, rows):
    schema = "status string, pickup string, delivered string, route string, cost decimal(10,2), at string"
    df = spark.createDataFrame(rows, schema)
    return df.select("status", F.col("pickup").cast("timestamp_ntz").alias("pickup_date"),
                     F.col("delivered").cast("timestamp_ntz").alias("actual_delivery"), "route", "cost",
                     F.col("at").cast("timestamp_ntz").alias("created_at"))


def test_dashboard(spark):
    rows = [("delivered", "2024-01-01", "2024-01-03 23:00:00", "b", Decimal("1.50"), "2024-01-08 12:00:00"),
            ("delivered", "2024-01-02", "2024-01-01 18:00:00", "a", Decimal("2.00"), "2024-01-08 11:59:59"),
            ("delivered", None, "2024-01-01", None, None, "2024-01-10"),
            ("pending", None, None, "b", Decimal("4.00"), "2024-01-10 01:00:00")]
    row = R.dashboard(documents(spark, rows), "2024-01-15 12:00:00").first()
    assert (row["total_shipments"], row["pending_shipments"], row["delivered_shipments"], row["failed_shipments"]) == (4, 1, 3, 0)
    assert row["total_revenue"] == 7.5 and row["average_delivery_time"] == 0.5
    assert [tuple(r) for r in row["top_routes"]] == [("b", 2), ("a", 1)]
    assert [tuple(r) for r in row["daily_shipments"]] == [("2024-01-08", 1), ("2024-01-10", 2)]


def test_empty_dashboard(spark):
    row = R.dashboard(documents(spark, []), "2024-01-15").first()
    assert (row["total_shipments"], row["total_revenue"], row["average_delivery_time"]) == (0, 0.0, None)
    assert row["top_routes"] == [] and row["daily_shipments"] == []


def test_filters_reach_the_scan(spark, folder):
    from waybill.operators.lookup import filter_recent
    events = spark.read.parquet(f"{folder}/events.parquet")
    plan = filter_recent(events, "ts", "2024-01-30", 7).select("event_id")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts" in plan and "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz>" in plan


def test_as_of_is_a_timestamp_literal(spark):
    assert spark.range(1).select(X.timestamp("2024-01-01").alias("t")).schema["t"].dataType.simpleString() == "timestamp_ntz"


def test_views_in_sql(spark, folder):
    from waybill.plans import sample_model as M
    R.register_views(M.shipments(spark, folder), M.hubs(spark, folder), M.users(spark, folder), M.SHIPMENTS_AS_OF)
    row = spark.sql("""select count(*) shipments, count(origin_hub_name) named from shipment_summary""").first()
    assert 0 < row["named"] <= row["shipments"]
    assert spark.sql("select max(total_shipments) from hub_performance").first()[0] > 0
    assert spark.sql("select count(*) from daily_summary").first()[0] > 0


def test_rollup_kept_over_patches_and_deletes(spark):
    """After any series of insertions, patches and deletions as the full rollup; only the changed days are written anew."""
    import random

    from waybill.plans.kept_rollup import KeptRollup
    from waybill.session import fresh_folder

    rng = random.Random(3)
    schema = ("id bigint, origin_hub_id bigint, status string, total_cost decimal(10,2), total_weight_kg decimal(10,2), package_count int, "
              "created_at timestamp_ntz, actual_pickup_datetime timestamp_ntz, actual_delivery_datetime timestamp_ntz, estimated_delivery_date date")

    def row(k):
        day = rng.choice([None, 1, 2, 3, 4])
        return (k, rng.choice([None, 1, 2, 3]), rng.choice(["created", "delivered", "delivered", "lost", "odd"]),
                rng.choice([None, Decimal(rng.randrange(1000)) / 100]), Decimal(rng.randrange(100)), rng.choice([None, 1, 5]),
                day and datetime(2024, 3, day, 5), rng.choice([None, datetime(2024, 3, 2)]), datetime(2024, 3, rng.randrange(3, 9), 7),
                rng.choice([None, date(2024, 3, 5)]))

    stored = {k: row(k) for k in range(40)}
    kept = KeptRollup(spark, fresh_folder(spark, "test-rollup"), days=1)

    def frame(rows):
        return spark.createDataFrame(list(rows), schema)

    def compare():
        found, wanted = (sorted(map(str, df.collect())) for df in (kept.read(hubs(spark)), R.daily_analytics_rollup(frame(stored.values()), hubs(spark))))
        assert found == wanted

    kept.create(frame(stored.values()))
    compare()
    for epoch in range(3):
        touched = rng.sample(range(60), 12)
        before = [stored[k] for k in touched if k in stored]
        for k in touched:
            stored[k] = row(k)
            if rng.random() < 0.3:
                del stored[k]
        for _ in range(2):  # run again
            kept.change(frame(before), frame(stored[k] for k in touched if k in stored), epoch)
        compare()
    before = stored.pop(next(k for k, r in stored.items() if r[6] and r[6].day == 2))
    files = {(b, kind, path) for b, kind, path in kept.table._entries()[2]}
    kept.change(frame([before]), frame([]), 3)
    compare()
    day = (date(2024, 3, 2) - date(1970, 1, 1)).days
    assert {b for b, _, _ in set(kept.table._entries()[2]) - files} == {day}
    one = R.daily_analytics_rollup(frame(stored.values()), hubs(spark)).where("date = '2024-03-02'")
    assert sorted(map(str, kept.read(hubs(spark), [day]).collect())) == sorted(map(str, one.collect()))
