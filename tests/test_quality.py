import pytest
from pyspark.sql import functions as F

from waybill import fixed
from waybill.operators import quality as Q


def tables(spark):
    hubs = spark.createDataFrame([(1, "A", 10, 0), (2, "A", 0, -1), (3, None, None, 5)],
                                 "id bigint, code string, capacity int, current_load int")
    routes = spark.createDataFrame(
        [(1, 1, 2, 0.0, 11), (2, 1, 1, 5.0, 10), (3, 2, 9, None, None)],
        "id bigint, origin_hub_id bigint, destination_hub_id bigint, distance_km double, priority int")
    shipments = spark.createDataFrame([(1, 1, 1), (2, None, 3)], "id bigint, origin_hub_id bigint, assigned_route_id bigint")
    events = spark.createDataFrame([(1, 1, "delivered"), (2, 2, "eaten"), (3, 5, None)],
                                   "id bigint, shipment_id bigint, event_type string")
    return {"hubs": hubs, "routes": routes, "shipments": shipments, "shipment_events": events}


def test_integrity_report(spark):
    found = {(r["table_name"], r["rule"]): r["violations"] for r in Q.integrity_report(tables(spark)).collect()}
    expected = {
        ("hubs", "capacity_check"): 1, ("hubs", "current_load_check"): 1, ("hubs", "code_unique"): 1,
        ("hubs", "code_not_null"): 1, ("hubs", "id_unique"): 0, ("routes", "distance_km_check"): 1,
        ("routes", "priority_check"): 1, ("routes", "no_self_route_check"): 1,
        ("routes", "origin_hub_id_reference"): 0, ("routes", "destination_hub_id_reference"): 1,
        ("shipments", "origin_hub_id_reference"): 0, ("shipments", "assigned_route_id_reference"): 0,
        ("shipment_events", "shipment_id_reference"): 1, ("shipment_events", "event_type_check"): 1,
        ("shipment_events", "event_type_not_null"): 1,
    }
    assert expected.items() <= found.items()


def test_partial_unique_key(spark):
    hubs = spark.createDataFrame([("a", 1), ("a", 2), (None, 3), (None, 4)], "code string, id int")
    assert [tuple(r) for r in Q.duplicate_keys(hubs, ["code"]).collect()] == [("a", 2)]
    assert Q.duplicate_keys(hubs, ["code"], F.col("id") > 1).count() == 0


def test_valid_and_rejects_make_the_input(spark):
    df = spark.createDataFrame([(float("nan"), "x"), (1.0, ""), (2.0, "y"), (None, None)], "weight double, status string")
    for rules in ([Q.positive("weight")], [Q.positive("weight", required=False), Q.filled("status")]):
        valid, rejects = Q.split(Q.validate(df, rules))
        assert valid.count() + rejects.count() == df.count()
        assert valid.where("isnan(weight)").count() == 0


def test_patches_look_at_given_fields_only(spark):
    df = spark.createDataFrame([(1, None, None, None), (2, "", -1.0, (0.0, 1.0, 1.0))],
                               "n int, sender_name string, cost double, dimensions struct<length: double, width: double, height: double>")
    valid, rejects = Q.validate_patches(df)
    assert [r["n"] for r in valid.collect()] == [1]
    assert rejects.first()[Q.BROKEN] == ["sender_name_empty", "cost_not_positive", "dimensions.length_not_positive"]


@pytest.mark.parametrize("ids, refused, hubs, routes", [
    ([3], {}, [1, 2], [1, 2, 3]),
    # Hub 2 takes routes 1 and 3 with it, which shipments use; hub 1 is used itself.
    ([2], {(2, "shipments.assigned_route_id")}, [1, 2, 3], [1, 2, 3]),
    ([1, 3], {(1, "shipments.origin_hub_id"), (1, "shipments.assigned_route_id")}, [1, 2], [1, 2, 3]),
])
def test_cascade_from_hubs(spark, ids, refused, hubs, routes):
    all_tables = tables(spark)
    keys = spark.createDataFrame([(i,) for i in ids], "id bigint")
    left, refusals = Q.cascade_delete(all_tables, "hubs", keys)
    assert {tuple(r) for r in refusals.collect()} == set(refused)
    assert sorted(r["id"] for r in left["hubs"].collect()) == hubs
    assert sorted(r["id"] for r in left["routes"].collect()) == routes


def test_cascade_through_two_levels(spark):
    all_tables = tables(spark)
    all_tables["shipments"] = all_tables["shipments"].where("id = 0")
    left, refusals = Q.cascade_delete(all_tables, "hubs", spark.createDataFrame([(1,), (1,)], "id bigint"))
    assert refusals.count() == 0
    assert [r["id"] for r in left["routes"].collect()] == [3]
    assert sorted(left) == ["hubs", "routes"]
    left, _ = Q.cascade_delete(tables(spark), "shipments", spark.createDataFrame([(1,)], "id bigint"))
    assert sorted(r["id"] for r in left["shipment_events"].collect()) == [2, 3]


def test_all_declared_rules_are_checked(spark, folder):
    from waybill.plans.catalog.integrity import _tables

    tables = _tables(spark, folder)
    assert Q.fk_orphans(tables).count() == len(fixed.FOREIGN_KEYS) == 24
    declared = [k for k in (*fixed.ALLOWED, *fixed.NUMERIC_CHECKS) if k[0] != "shipment_documents"]
    assert Q.check_constraints(tables).count() == len(declared) == 22


def test_unique_violations_tell_keys_apart(spark):
    rows = spark.createDataFrame([("a", "bc"), ("ab", "c"), ("a", "bc"), (None, "c"), (None, "c")], "x string, y string")
    found = {r["rule"]: r["violations"] for r in Q.unique_violations({"t": rows}, {"t": [["x", "y"], ["x"], ["y"]]}).collect()}
    assert found == {"x_y_unique": 1, "x_unique": 1, "y_unique": 3}
    empty = Q.unique_violations({"t": rows.where("false")}, {"t": [["x"]]}).first()
    assert empty["violations"] == 0


def test_equal_hashes_of_different_keys_are_told_apart(spark, monkeypatch):
    """All keys fall on one of two hashes: values decide."""
    rows = spark.createDataFrame([(k, f"v{k % 7}") for k in range(40)] + [(3, "x")], "id bigint, v string")
    plain = F.xxhash64
    monkeypatch.setattr(Q.F, "xxhash64", lambda *columns: plain(*columns) % 2)
    for most in (Q.MOST_BROADCAST, 0):
        monkeypatch.setattr(Q, "MOST_BROADCAST", most)
        found = {r["rule"]: r["violations"] for r in Q.unique_violations({"t": rows}, {"t": [["id"], ["v"], ["id", "v"]]}).collect()}
        assert found == {"id_unique": 1, "v_unique": 33, "id_v_unique": 0}


def test_integrity_report_reads_each_entity_once(spark, folder, tmp_path, monkeypatch):
    """The first pass has one scan of each table; after it only parents' ids are read, and tables with repeated hashes."""
    plans = []
    monkeypatch.setattr(Q, "checkpointed", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or df)
    stored = {}
    for name, df in tables(spark).items():
        df.write.parquet(str(tmp_path / name))
        stored[name] = spark.read.parquet(str(tmp_path / name))
    Q.integrity_report(stored)
    assert len(plans) == 1 and plans[0].count("FileScan parquet") == len(stored)


def test_unique_violations_scan_a_table_once(spark, folder):
    table = spark.read.parquet(f"{folder}/lineitem.parquet")
    report = Q.unique_violations({"lineitem": table}, {"lineitem": [["l_orderkey", "l_linenumber"], ["l_partkey"]]})
    plan = report._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1


def test_keys_of_numbers_are_counted_in_one_pass(spark, monkeypatch):
    """Neither written row by row nor looked at again, however many repeat; texts still are."""
    written = []
    monkeypatch.setattr(Q, "checkpointed", lambda df: written.append(df) or df)
    rows = spark.range(1000).selectExpr("id % 500 id", "cast(id % 250 as int) n", "date_add(date'2024-01-01', cast(id % 100 as int)) day",
                                        "cast(id % 10 as string) v").unionByName(
        spark.sql("select cast(null as bigint) id, 1 n, cast(null as date) day, cast(null as string) v"))
    keys = {"t": [["id"], ["n"], ["day", "id"], ["day"]]}
    found = {r["rule"]: r["violations"] for r in Q.unique_violations({"t": rows}, keys).collect()}
    assert found == {"id_unique": 500, "n_unique": 751, "day_id_unique": 500, "day_unique": 900} and not written
    found = {r["rule"]: r["violations"] for r in Q.unique_violations({"t": rows}, {"t": [*keys["t"], ["v"]]}).collect()}
    assert found["v_unique"] == 990 and found["id_unique"] == 500 and len(written) == 1
    assert {r["ref"]: r["n"] for r in written[0].groupBy("ref").agg(F.count("*").alias("n")).collect()} == {
        0: 1, 1: 1, 2: 1, 3: 1, 4: 10}


def test_neighbouring_numbers_share_a_row(spark, monkeypatch):
    """Keys of numbers are combined in blocks of 64 before the shuffle, and counted as exactly as one by one."""
    offered, union = [], Q._union
    monkeypatch.setattr(Q, "_union", lambda frames: offered.append(union(frames)) or offered[-1])
    rows = spark.range(-3200, 3200, 1, 2).selectExpr(
        "id", "cast(id div 10 * 10 as int) n", "id * 70 far", "date_add(date'1970-01-01', cast(id div 7 as int)) day", "cast(id % 2 as byte) v")
    ends = spark.sql("""select explode(array(-9223372036854775808L, 9223372036854775807L, 9223372036854775744L, -1L, null)) id, 0 n,
                        -64 far, cast(null as date) day, cast(3 as byte) v""")
    rows = rows.unionByName(ends).unionByName(ends.limit(2))
    keys = [["id"], ["n"], ["far"], ["day", "v"], ["v", "id"], ["day"]]
    found = {r["rule"]: r["violations"] for r in Q.unique_violations({"t": rows}, {"t": keys}).collect()}
    known = {"_".join(k): rows.dropna(subset=k).select(*k) for k in keys}
    assert found == {f"{name}_unique": df.count() - df.distinct().count() for name, df in known.items()}
    assert found["id_unique"] == 3 and found["far_unique"] == 6
    groups = {r["ref"]: r["n"] for r in offered[0].select("ref", "number", "more").distinct().groupBy("ref").agg(F.count("*").alias("n")).collect()}
    assert groups[0] <= 100 + 4 and groups[1] <= 101 and groups[2] <= 6401 and groups[3] <= 3 * 16


def test_references_by_number_and_by_text(spark):
    """Ids of either kind, side by side in one scan of the child."""
    hubs = spark.createDataFrame([(1,), (2,)], "id int")
    users = spark.createDataFrame([("7",), ("x",)], "id string")
    events = spark.createDataFrame([(1, 1, "x"), (2, 3, "y"), (3, None, "7"), (4, 9, None)], "id bigint, hub_id bigint, user_id string")
    tables = {"hubs": hubs, "users": users, "shipment_events": events}
    found = {r["rule"]: r["violations"] for r in Q.fk_orphans(tables).collect() if r["table_name"] == "shipment_events"}
    assert found == {"hub_id_reference": 2, "user_id_reference": 1}
