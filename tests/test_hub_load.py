"""The composed replay against a plain loop."""

import random

import numpy as np
import pandas as pd
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from waybill.functions import expressions as X
from waybill.operators import hub_load as H


def replay(load, steps, capacity):
    for kind, packages in steps:
        load = max(0, load - packages) if kind == 0 else min(capacity, load + packages)
    return load


@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 1), st.integers(0, 9)), max_size=60),
       st.integers(0, 30))
def test_composition_equals_replay(moves, start):
    capacity, no_limit = 12, H._NO_LIMIT
    moves.sort(key=lambda m: m[0])
    table = pd.DataFrame([
        (hub, 5, -no_limit if kind else 0, capacity if kind else no_limit, n if kind else -n)
        for hub, kind, n in moves], columns=["hub_id", "stretch", "low", "high", "shift"])
    cut = len(table) // 3
    out = [r for b in H._compose_stretch(iter([table[:cut], table[cut:cut], table[cut:]])) for r in b.itertuples()]
    assert len(out) == len({m[0] for m in moves})
    for row in out:
        steps = [(kind, n) for hub, kind, n in moves if hub == row.hub_id]
        assert min(row.high, max(row.low, start + row.shift)) == replay(start, steps, capacity)


def test_reduce_runs_keeps_order_of_hubs():
    hubs = np.array([1, 1, 1, 2, 3, 3])
    functions = np.array([[0, 9, -1]] * 6)
    reduced, _ = H._reduce_runs(hubs, functions)
    assert reduced.tolist() == [1, 2, 3]


@pytest.mark.parametrize("hot", [True, False])
def test_fold_against_loop(spark, hot):
    rng = random.Random(4)
    hubs = [(h, 1000 if h else 40, rng.randrange(0, 60)) for h in range(4)]
    pick = (lambda: 1 if hot and rng.random() < .8 else rng.choice([0, 1, 2, 3, None, 99]))
    shipments = [(s, pick(), pick(), rng.randrange(1, 9)) for s in range(80)]
    statuses = ["created", "in_transit", "delivered"]
    events = [(e, rng.randrange(0, 90), rng.choice(statuses), rng.randrange(0, 500)) for e in range(1500)]

    load = {h: (c, n) for h, c, n in hubs}
    by_id = {s[0]: s for s in shipments}
    last = {}
    for _, ship, status, _ in sorted(events, key=lambda e: (e[3], e[0])):
        changed, last[ship] = last.get(ship) != status, status
        if not changed or ship not in by_id:
            continue
        _, origin, destination, packages = by_id[ship]
        if origin in load:
            capacity, now = load[origin]
            load[origin] = capacity, max(0, now - packages)
        if status == "delivered" and destination in load:
            capacity, now = load[destination]
            load[destination] = capacity, min(capacity, now + packages)

    hub_df = spark.createDataFrame(hubs, "id bigint, capacity int, current_load int")
    ship_df = spark.createDataFrame(shipments, "id bigint, origin_hub_id bigint, destination_hub_id bigint, package_count int")
    event_df = spark.createDataFrame(events, "id bigint, shipment_id bigint, status string, t int").withColumn(
        "event_datetime", (X.timestamp("2024-01-01") + F.make_dt_interval(F.lit(0), F.lit(0), F.col("t"))))
    changes = H.status_changes(event_df, rows_per_task=10 if hot else 10**6)
    out = {r["id"]: r["new_load"] for r in H.hub_load_fold(hub_df, ship_df, changes).collect()}
    assert out == {h: n for h, (_, n) in load.items()}


def test_status_before_the_first_event(spark):
    events = spark.createDataFrame([(1, 5, "created"), (2, 5, "delivered"), (3, 6, "created")],
                                   "id bigint, shipment_id bigint, status string").withColumn("event_datetime", X.timestamp("2024-01-01"))
    initial = spark.createDataFrame([(5, "created")], "shipment_id bigint, old_status string")
    changes = H.status_changes(events, initial=initial)
    assert sorted((r["id"], r["old_status"]) for r in changes.collect()) == [(2, "created"), (3, None)]
