import json
from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waybill import fixed
from waybill.functions import expressions as X
from waybill.operators import projections as P
from waybill.operators import schema_ops as S
from waybill.operators.lookup import filter_recent
from waybill.schemas import required_columns, schema_of
from waybill.session import fresh_folder
from waybill.sources import documents as D
from waybill.sources import jdbc
from waybill.sources.tables import read_entity, read_tables, write_entity


@pytest.mark.parametrize("table", list(fixed.TABLES))
def test_schemas_parse_and_cover_the_rules(spark, table):
    names = set(schema_of(table).names)
    assert set(fixed.DEFAULTS.get(table, {})) <= names
    assert {c for key in fixed.UNIQUE_KEYS[table] for c in key} <= names
    assert {c for t, c, _, _ in fixed.FOREIGN_KEYS if t == table} <= names
    assert {c for t, c in fixed.ALLOWED if t == table} <= names


def test_declared_counts():
    tables = [t for t in fixed.TABLES if t != "shipment_documents"]
    checks = [k for k in [*fixed.ALLOWED, *fixed.NUMERIC_CHECKS] if k[0] != "shipment_documents"]
    assert (len(tables), len(fixed.FOREIGN_KEYS), len(checks)) == (13, 24, 22)
    assert sum(cascades for *_, cascades in fixed.FOREIGN_KEYS) == 6


@pytest.mark.parametrize("kind", ["parquet", "json", "csv"])
def test_entity_round_trip(spark, tmp_path, kind):
    hubs = spark.createDataFrame([(1, "North", 10, 3, Decimal("30.00"))],
                                 "id int, name string, capacity int, current_load int, utilization_percentage decimal(7,4)")
    path = str(tmp_path / kind)
    write_entity(hubs, "hubs", path, kind)
    back = read_entity(spark, "hubs", path, kind, columns=hubs.columns)
    assert back.first()["utilization_percentage"] == Decimal("30.00")
    assert back.schema["id"].dataType == T.LongType()


def test_partitioned_entity_prunes(spark):
    rows = spark.range(100).select("id", (X.timestamp("2024-01-01 05:00:00") + F.make_dt_interval((F.col("id") % 3).cast("int"))).alias("created_at"))
    path = fresh_folder(spark, "test-shipments")
    write_entity(rows, "shipments", path, created="created_at")
    back = read_entity(spark, "shipments", path, columns=["id", "created_at"], partitioned=True)
    day = back.where(F.col("created_date") == F.lit("2024-01-02").cast("date"))
    assert day.count() == 33 and day.select(F.max("created_date")).first()[0] == date(2024, 1, 2)
    plan = day._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(created_date" in plan
    recent = filter_recent(back, "created_at", "2024-01-03 08:00:00", 1)
    assert recent.count() == 66
    assert "(created_date" in recent._jdf.queryExecution().executedPlan().toString().split("PartitionFilters")[1]


def test_read_tables(spark, tmp_path):
    S.empty_table(spark, "hubs").write.parquet(str(tmp_path / "hubs"))
    S.empty_table(spark, "shipments").write.parquet(str(tmp_path / "shipments"))
    tables = read_tables(spark, str(tmp_path), ["hubs", "shipments"])
    assert {n: df.count() for n, df in tables.items()} == {"hubs": 0, "shipments": 0}


def test_jdbc_options():
    sliced = jdbc.read_options("jdbc:x", "select * from t", jdbc.Slices("id", 0, 100, 8))
    assert sliced["dbtable"] == "(select * from t) source_rows"
    assert (sliced["partitionColumn"], sliced["numPartitions"], sliced["upperBound"]) == ("id", "8", "100")
    assert "partitionColumn" not in jdbc.read_options("jdbc:x", "t")
    assert jdbc.write_options("jdbc:x", "t", connections=4)["numPartitions"] == "4"


def test_payloads_from_files(spark, tmp_path):
    (tmp_path / "p.json").write_text('{"senderName":"Ann","weight":1.5}\n{"senderName":null}\n{"senderName"\n')
    schema = T.StructType([T.StructField("senderName", T.StringType()), T.StructField("weight", T.DoubleType())])
    good, malformed = D.read_payloads(str(tmp_path), schema, spark)
    seen = sorted((r["sender_name"] or "", r["weight"], r[D.PRESENT]) for r in good.collect())
    assert seen == [("", None, ["sender_name"]), ("Ann", 1.5, ["sender_name", "weight"])]
    assert [r["payload"] for r in malformed.collect()] == ['{"senderName"']


def test_payload_of_the_wrong_type_is_malformed(spark):
    schema = T.StructType([T.StructField("weight", T.DoubleType())])
    rows = spark.createDataFrame([(1, '{"weight":"heavy"}'), (2, '{"weight":2}')], "n int, payload string")
    good, malformed = D.read_payloads(rows, schema)
    assert [r["n"] for r in good.collect()] == [2] and [r["n"] for r in malformed.collect()] == [1]


def test_json_columns(spark):
    rows = spark.createDataFrame([('{"length":1}', '["a"]'), ("nonsense", "nonsense"), (None, None)], "d string, t string")
    parsed = rows.select(D.parse_json_column("d", "struct<length: double>").alias("d"),
                         D.parse_json_column("t", "array<string>").alias("t"),
                         D.parse_json_column("d", "map<string,string>").alias("m"))
    assert [(r["d"]["length"], r["t"], r["m"]) for r in parsed.collect()] == [
        (1.0, ["a"], {"length": "1"}), (None, [], {}), (None, [], {})]
    typed = rows.select(F.array(F.lit("x")).alias("t"))
    kept = typed.select(D.parse_json_column("t", "array<string>", typed.schema["t"].dataType).alias("t"))
    assert kept.first()["t"] == ["x"]


def test_document(spark):
    rows = spark.createDataFrame(
        [("A", Decimal("2.50"), (1.0, 2.0, 3.0), datetime(2024, 1, 1, 5), None,
          [("e", datetime(2024, 1, 1, 5, 0, 0, 250), "pending", "x", "y")])],
        "id string, weight decimal(10,2), dimensions struct<length: double, width: double, height: double>, "
        "created_at timestamp_ntz, pickup_date timestamp_ntz, "
        "events array<struct<id: string, timestamp: timestamp_ntz, status: string, location: string, description: string>>")
    text = D.to_document(rows).first()["document"]
    assert json.loads(text) == {
        "id": "A", "weight": 2.5, "dimensions": {"length": 1.0, "width": 2.0, "height": 3.0},
        "createdAt": "2024-01-01T05:00:00", "pickupDate": None,
        "events": [{"id": "e", "timestamp": "2024-01-01T05:00:00.000250", "status": "pending",
                    "location": "x", "description": "y"}]}
    kept, malformed = D.read_payloads(D.to_document(rows, "payload"), D.payload_schema(rows.schema))
    assert malformed.count() == 0 and kept.select(*rows.columns).collect() == rows.collect()


def test_defaults(spark):
    rows = spark.createDataFrame([(1, None)], "id bigint, status string")
    as_of = X.timestamp("2024-01-01")
    plain = S.apply_defaults(rows, "hubs", as_of).first()
    assert (plain["status"], plain["capacity"], plain["hub_type"]) == (None, 1000, "distribution")
    assert json.loads(plain["operating_hours"])["sunday"] == "closed"
    assert S.apply_defaults(rows, "hubs", as_of, fill_nulls=True).first()["status"] == "active"


def test_generated_columns(spark):
    rows = spark.createDataFrame([(Decimal("10.00"), Decimal("4.00"))], "total_revenue decimal(12,2), total_costs decimal(12,2)")
    assert S.generated_columns(rows, "daily_analytics").first()["net_profit"] == Decimal("6.00")
    assert S.generated_columns(rows, "users").columns == rows.columns


def test_evolve_schema(spark):
    old = spark.createDataFrame([(1, "N")], "id int, city string")
    new = S.evolve_schema(old, fixed.HUB_MIGRATION, fixed.HUB_RETYPE)
    row = new.first()
    assert (row["id"], row["city"], row["code"]) == ("1", "N", None)
    assert set(fixed.HUB_MIGRATION) <= set(new.columns)
    assert S.evolve_schema(new, fixed.HUB_MIGRATION).columns == new.columns


def test_describe_and_stats(spark):
    described = S.describe_table(S.empty_table(spark, "routes")).orderBy("ordinal_position").collect()
    assert [(r["column_name"], r["is_nullable"]) for r in described[:2]] == [("id", "NO"), ("uuid", "NO")]
    assert [r["column_name"] for r in described if r["is_nullable"] == "NO"] == required_columns("routes")
    stats = S.table_stats({"a": spark.range(3), "b": spark.range(0)})
    assert {r["table_name"]: r["row_count"] for r in stats.collect()} == {"a": 3, "b": 0}
    assert S.sample_rows(spark.range(9), 2).count() == 2


def test_projections(spark):
    documents = S.empty_table(spark, "shipment_documents")
    assert len(P.project_listing(documents).columns) == 16
    assert P.project_detail(documents).columns == P.LISTING + ["events"]
    users = S.empty_table(spark, "users")
    assert "password_hash" not in P.project_user(users).columns
    assert P.to_snake_case(P.to_camel_case(documents)).columns == documents.columns


def test_open_documents(spark):
    from waybill.sources import open_documents as O
    texts = ['{"a": 1, "b": {"c": "x", "d e": null}}', '{"a": 2.5, "b": {"c": "y"}, "l": [1, {"z": 2}]}', '{"a\'s": true, "b_c": 7}',
             "[1, 2]", "3", "null", "{broken", "", None, "{}", '{"b": 5}']
    docs = spark.createDataFrame(list(enumerate(texts)), "n int, text string").withColumn("a", F.lit("taken"))
    parsed = O.parse_open(docs, "text", "document")
    assert [r.n for r in parsed.where("malformed").orderBy("n").collect()] == [6, 7]
    shape = O.found_shape(parsed, "document")
    # ``b`` is an object and a number, so it stays whole.
    assert {"".join(at): kind.simpleString() for at, kind in O.paths(shape)} == {
        "a": "decimal(21,1)", "a's": "boolean", "b": "variant", "b_c": "bigint", "l": "variant"}
    found = {r.n: r for r in O.shred(parsed, "document", shape).withColumn("l", F.to_json("l")).collect()}
    assert [found[n]["a_2"] is None or float(found[n]["a_2"]) for n in (0, 1, 2, 3)] == [1.0, 2.5, True, True]
    assert found[2]["a's"] is True and found[2]["b_c"] == 7 and found[1]["l"] == '[1,{"z":2}]' and found[0]["a"] == "taken"
    nested = O.found_shape(parsed.where("n < 2"), "document")
    assert {O._path(at) for at, _ in O.paths(nested)} == {"$['a']", "$['b']['c']", "$['b']['d e']", "$['l']"}
    assert [r["b_c"] for r in O.shred(parsed.where("n < 2"), "document", nested).orderBy("n").collect()] == ["x", "y"]
    assert O.found_shape(parsed.where("n in (3, 8)"), "document").fields == []
    assert O.shred(parsed.limit(0), "document", shape).count() == 0
