"""Spatial joins on crowded places: results against all pairs, and how many pairs meet."""

from __future__ import annotations

import datetime as dt
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from contrail import plans
from contrail.functions import cpr, modes
from contrail.operators import airspaces, retractable, spatial
from contrail.plans import change_queries

T0 = dt.datetime(2024, 1, 1)


def distance(a, b):
    p, q = math.radians(a[0]), math.radians(b[0])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * 6_371_000.0 * math.asin(min(1.0, math.sqrt(h)))


@pytest.fixture
def met(monkeypatch):
    """Tables of pairs that near_pairs made."""
    made, real = [], spatial.near_pairs
    monkeypatch.setattr(spatial, "near_pairs", lambda *a, **k: made.append(real(*a, **k)) or made[-1])
    return made


TOWS = "fix_id long, aircraft_id long, received_at timestamp, lat double, lon double"


def test_tow_candidates_against_all_pairs(spark):
    rng = random.Random(3)
    row = lambda i: (i, rng.randrange(25), T0 + dt.timedelta(seconds=rng.randrange(7200)), 47 + rng.random() * 3, 8 + rng.random() * 3)
    tugs, others = [row(i) for i in range(300)], [row(i) for i in range(1000, 1150)]
    others += [(2000 + i, i % 2, T0, 47.0, 8.0) for i in range(8)] + [(2100, None, T0, 47.0, 8.0), (2101, 4, T0, None, 8.0)]
    tugs += [(900 + i, i, T0, 47.0, 8.0) for i in range(3)] + [(950, None, T0, 47.0, 8.0), (951, 3, T0, 47.0, None)]
    want = set()
    for i, a, t, *x in tugs:
        near = {b for _, b, u, *y in others if None not in (a, b, *x, *y) and a != b and abs((t - u).total_seconds()) <= 600 and distance(x, y) <= 40_000}
        want |= {(i, a, *near)} if len(near) == 1 else set()
    got = spatial.tow_candidates(spark.createDataFrame(tugs, TOWS), spark.createDataFrame(others, TOWS), 40_000.0, 600).collect()
    assert sorted(map(tuple, got)) == sorted(want)
    assert len(want) > 20
    assert {(900, 0, 1), (901, 1, 0)} <= want


def test_tow_candidates_in_a_crowd(spark, met):
    rng = random.Random(4)
    tugs = [(i, i, T0, 47.0, 8.0) for i in range(2000)]
    others = [(i, i, T0 + dt.timedelta(seconds=i % 30), 47 + rng.random() / 1000, 8.0) for i in range(3000, 5000)]
    found = spatial.tow_candidates(spark.createDataFrame(tugs, TOWS), spark.createDataFrame(others, TOWS), 500.0, 60)
    assert found.count() == 0
    assert sum(m.count() for m in met) < 10_000


def test_copies_around_cells_are_not_broadcast(spark, sf):
    plan = plans.QUERIES["j11_tow_candidates"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [__r" in plan
    assert "BroadcastExchange" not in plan.split("SortMergeJoin [__r")[-1]


def test_nearest_on_copies(spark, met):
    """Fixes and airports at few places: places meet, ties go to the smaller id."""
    fixes = [(i, 47 + i % 3 / 100, 8.0, 10.0 * (i % 36)) for i in range(3000)] + [(9000, None, 8.0, 0.0), (9001, 0.0, 0.0, 0.0)]
    airports = [(j, 47 + j % 4 / 100, 8.0) for j in range(1, 3000)]
    left = spark.createDataFrame(fixes, "fix_id long, lat double, lon double, track double")
    right = spark.createDataFrame(airports, "airport_id long, lat2 double, lon2 double")
    got = {r.fix_id: (r.airport_id, r.distance_m) for r in spatial.nearest(left, right, "fix_id", "airport_id", 50_000.0).collect()}
    assert got == {i: ((4, 1, 2)[i % 3], 0.0) for i in range(3000)}
    near = spatial.k_nearest(left.filter("fix_id < 3000"), right, "fix_id", "airport_id", 5).collect()
    assert {(r.fix_id, r["rank"], r.airport_id) for r in near} == {(i, n + 1, (i % 3 or 4) + 4 * n) for i in range(3000) for n in range(5)}
    ends = right.selectExpr("airport_id", "'le' AS end", "lat2", "lon2", "90.0D AS runway_heading")
    near = spatial.nearest_runway_ends(left, ends, 3000.0, 4).collect()
    assert {(r.fix_id, r["rank"], r.airport_id, r.track) for r in near} == {(i, n, (i % 3 or 4) + 4 * n, 10.0 * (i % 36)) for i in range(3000) for n in range(4)}
    assert sum(m.count() for m in met) < 1000


def test_nearest_among_many_places(spark, met):
    """The reach follows the density: each fix meets few airports, not all within the distance."""
    rng = random.Random(5)
    place = lambda: (47 + rng.random() / 5, 8 + rng.random() / 5)
    fixes, airports = [(i, *place()) for i in range(300)], [(j, *place()) for j in range(2000)]
    left = spark.createDataFrame(fixes, "fix_id long, lat double, lon double")
    right = spark.createDataFrame(airports, "airport_id long, lat2 double, lon2 double")
    got = {r.fix_id: r.airport_id for r in spatial.nearest(left, right, "fix_id", "airport_id", 50_000.0).collect()}
    assert got == {i: min((distance(x, y), j) for j, *y in airports)[1] for i, *x in fixes}
    assert sum(m.count() for m in met) < 10_000


def test_repeated_expressions_are_bound(spark):
    lat0, rest = F.col("first_lat"), [F.col(c) for c in ("b", "c", "d", "odd")]
    named = lambda c, name: c._jc.toString().count(name)
    assert named(cpr.global_position(lat0, *rest), "first_lat") == 1
    assert named(cpr.zones(F.col("first_lat")), "first_lat") == 1
    assert named(modes.with_parity(F.col("whole_frame")), "whole_frame") == 1


def test_changes_are_not_dealt_by_batches(spark, sf):
    none = spark.createDataFrame([], "batch_id long")
    found = retractable.pending(change_queries.feed(spark, sf), none)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"hashpartitioning\(batch_id#\d+L?, seq#", plan)
    assert "LeftAnti" in plan and "SortMergeJoin" not in plan


def test_fixes_and_areas_that_are_alike_meet_once(spark, sf, tmp_path, monkeypatch):
    """Copies of fixes change the numbers, not the work."""
    events = spark.read.parquet(f"{sf}/events.parquet").filter("event_id % 20 = 0")
    copies = events.withColumn("event_id", F.expr("explode(transform(sequence(0, 4), i -> event_id + i * 12000))"))
    copies.write.parquet(f"{tmp_path}/events.parquet")
    spark.read.parquet(f"{sf}/supplier.parquet").write.parquet(f"{tmp_path}/supplier.parquet")
    asked, real = [], airspaces.inside
    monkeypatch.setattr(airspaces, "inside", lambda *a: asked.append(a[0]) or real(*a))
    got = {r.area_id: r.n_fixes for r in plans.QUERIES["p10_in_airspaces"](spark, str(tmp_path)).collect()}
    assert got and all(n % 5 == 0 for n in got.values())
    assert asked[0].count() <= events.count()
