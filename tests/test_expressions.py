from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from waybill.functions import expressions as X


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def ntz(text):
    return X.timestamp(text)


@pytest.mark.parametrize("load, capacity, share", [
    (3, 7, "42.86"), (1, 800, "0.13"), (0, 5, "0.00"), (7, 0, "0.00"), (7, -1, "0.00"), (7, None, "0.00")])
def test_utilization(spark, load, capacity, share):
    column = X.hub_utilization(F.lit(load).cast("int"), F.lit(capacity).cast("int"))
    assert one(spark, column) == Decimal(share)


def test_utilization_beyond_its_type_raises(spark):
    with pytest.raises(Exception, match="NUMERIC_VALUE_OUT_OF_RANGE"):
        one(spark, X.hub_utilization(F.lit(20_000), F.lit(10)))


def test_volume(spark):
    assert one(spark, X.volume_m3(F.lit("30.5"), F.lit("20"), F.lit("10"))) == Decimal("0.0061")
    assert one(spark, X.volume_m3(F.lit("30.5"), F.lit(None).cast("string"), F.lit("10"))) is None


def test_total_cost(spark):
    none = F.lit(None).cast("decimal(10,2)")
    assert one(spark, X.total_cost(F.lit("10.10"), F.lit("0.05"), none, F.lit("1"))) == Decimal("11.15")
    assert one(spark, X.total_cost(none, F.lit("1"))) is None


@pytest.mark.parametrize("end, seconds", [
    ("2024-01-01 00:00:02.5", 3), ("2024-01-01 00:00:02.499999", 2), ("2023-12-31 23:59:57.5", -3)])
def test_duration_rounds_half_away(spark, end, seconds):
    assert one(spark, X.duration_seconds(ntz("2024-01-01 00:00:00"), ntz(end))) == seconds


@pytest.mark.parametrize("end, days", [
    ("2024-01-02 23:59:59", 1), ("2024-01-02 00:00:00", 1), ("2023-12-31 18:00:00", -1), ("2023-12-31 00:00:00", -1)])
def test_elapsed_days_floors(spark, end, days):
    assert one(spark, X.elapsed_days(ntz("2024-01-01 00:00:00"), ntz(end))) == days


@pytest.mark.parametrize("service, day", [("standard", 4), ("express", 3), ("overnight", 2), ("balloon", 4), (None, 4)])
def test_eta(spark, service, day):
    none = F.lit(None).cast("timestamp_ntz")
    column = X.eta(F.lit(service).cast("string"), none, ntz("2024-01-01 06:00:00"))
    assert one(spark, column) == datetime(2024, 1, day, 6)


@pytest.mark.parametrize("phone, good", [
    (None, True), ("", True), ("+1-555 123", True), ("+-", False), ("555x", False), ("5.5", False)])
def test_phone(spark, phone, good):
    assert one(spark, X.phone_valid(F.lit(phone).cast("string"))) is good


@pytest.mark.parametrize("ts, text", [
    ("2024-01-01 00:00:00", "2024-01-01T00:00:00"), ("2024-01-01 01:02:03.05", "2024-01-01T01:02:03.050000"), (None, None)])
def test_iso(spark, ts, text):
    assert one(spark, X.iso_timestamp(F.lit(ts).cast("timestamp_ntz"))) == text


def test_tracking_number_rounds_the_second(spark):
    # 1704164645 is the epoch second of 2024-01-02 03:04:05.
    assert one(spark, X.tracking_number(ntz("2024-01-02 03:04:05.4"), F.lit(7))) == "BC202401024645007"
    assert one(spark, X.tracking_number(ntz("2024-01-02 03:04:05.5"), F.lit(7))) == "BC202401024646007"


def test_clamp_skips_nulls(spark):
    none = F.lit(None).cast("int")
    assert one(spark, X.clamp_low(F.lit(-3))) == 0
    assert one(spark, X.clamp_low(none)) == 0
    assert one(spark, X.clamp_high(F.lit(9), F.lit(5))) == 5
    assert one(spark, X.clamp_high(F.lit(9), none)) == 9


def test_names():
    assert X.to_camel("estimated_delivery") == "estimatedDelivery"
    assert X.to_snake("estimatedDelivery") == "estimated_delivery"


def test_stable_uuid(spark):
    ids = rows(spark.range(3).select(X.stable_uuid(F.lit("b"), "id").alias("u")))
    again = rows(spark.range(3).select(X.stable_uuid(F.lit("b"), "id").alias("u")))
    assert ids == again and len(set(ids)) == 3
    assert [len(part) for part in ids[0][0].split("-")] == [8, 4, 4, 4, 12]
