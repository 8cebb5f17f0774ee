"""Frames, change feeds, checks, pending registrations and nearest rows on hand-made rows."""

from __future__ import annotations

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from contrail.functions import modes
from contrail.operators import merge, retractable, rollups, spatial

T0 = dt.datetime(2025, 1, 1)


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first().x


# Published example frames of extended squitters.
SPEED, AIRSPEED = "8D485020994409940838175B284F", "8DA05F219B06B6AF189400CBC33F"
EVEN, ODD = "8D40621D58C382D690C8AC2863A7", "8D40621D58C386435CC412692AD6"
GROUND = "8C4841753A9A153237AEF0F275BE"


@pytest.mark.parametrize(
    ("frame", "rest", "address"),
    [
        (SPEED, 0, 0x485020), (EVEN, 0, 0x40621D), ("8d4bb463003d10000000001b5bec", 0, 0x4BB463), ("8D40621D58C382D690C8AC2863A6", 1, None), ("A0001838CA3E51F0A8000047A36A", 0x47A36A ^ 0x0, None),
        ("8D", None, None), ("zz", None, None), (None, None, None), ("", None, None),
    ],
)
def test_parity_and_address(spark, frame, rest, address):
    df = spark.createDataFrame([(frame,)], "f string")
    got = df.select(modes.parity(F.col("f")).alias("p"), modes.address(F.col("f")).alias("a"), modes.downlink_format(F.col("f")).alias("k")).first()
    if frame and frame.startswith("A0"):
        assert (got.k, got.p) == (20, got.a)  # the reply hides its address in the parity
        return
    assert (got.p, got.a) == (rest, address)


def test_parity_finds_every_single_and_double_error(spark):
    whole = int(EVEN, 16)
    rng = random.Random(1)
    flips = [1 << b for b in range(112)] + [(1 << rng.randrange(112)) ^ (1 << rng.randrange(112)) for _ in range(100)]
    df = spark.createDataFrame([(f"{whole ^ f:028X}",) for f in flips if f], "f string")
    assert df.filter(modes.parity(F.col("f")) == 0).count() == 0
    again = spark.createDataFrame([(f[:-6], f) for f in (EVEN, ODD, SPEED, AIRSPEED)], "digits string, whole string")
    assert again.filter(modes.with_parity(F.col("digits")) != F.col("whole")).count() == 0


def test_velocities(spark):
    v = one(spark, modes.velocity(F.col("f")), f=SPEED)
    assert (round(v.speed_kt, 2), round(v.track, 2), v.climb_fpm, v.heading, v.airspeed_kt) == (159.20, 182.88, -832, None, None)
    v = one(spark, modes.velocity(F.col("f")), f=AIRSPEED)
    assert (v.airspeed_kt, v.true_airspeed, round(v.heading, 2), v.climb_fpm, v.speed_kt) == (375, True, 243.98, -2304, None)
    assert one(spark, modes.velocity(F.col("f")), f=EVEN) is None
    assert one(spark, modes.velocity(F.col("f")), f=SPEED[:-1] + "0") is None


def test_reports_from_the_ground(spark):
    s = one(spark, modes.surface(F.col("f")), f=GROUND)
    assert (s.speed_kt, round(s.track, 1)) == (17.0, 92.8)
    assert one(spark, modes.surface(F.col("f")), f=EVEN) is None


@pytest.mark.parametrize(("code", "knots"), [(0, None), (1, 0.0), (2, 0.125), (8, 0.875), (9, 1.0), (12, 1.75), (13, 2.0), (38, 14.5), (39, 15.0), (93, 69.0), (94, 70.0), (108, 98.0), (109, 100.0), (123, 170.0), (124, 175.0), (125, None)])
def test_ground_speeds(spark, code, knots):
    digits = f"8C484175{(7 << 51) | (code << 44):014X}"
    s = one(spark, modes.surface(modes.with_parity(F.col("d"))), d=digits)
    assert (s.speed_kt, s.track) == (knots, None)


def test_position_from_one_report_and_a_place_nearby(spark):
    for odd, lat, lon, want in ((0, 93000, 51372, (52.25720, 3.91937)), (1, 74158, 50194, (52.26578, 3.93892))):
        p = one(spark, modes.local_position(F.col("y"), F.col("x"), F.col("o"), F.col("a"), F.col("b")), y=lat, x=lon, o=odd, a=52.258, b=3.918)
        assert (round(p.lat, 4), round(p.lon, 4)) == (round(want[0], 4), round(want[1], 4))
    rng = random.Random(4)
    rows = [(rng.uniform(-86, 86), rng.uniform(-180, 180), o) for o in (0, 1) for _ in range(200)]
    df = spark.createDataFrame(rows, "lat double, lon double, o int").withColumn("c", modes.compact(F.col("lat"), F.col("lon"), F.col("o")))
    near = modes.local_position(F.col("c.cpr_lat"), F.col("c.cpr_lon"), F.col("o"), F.col("lat") + 0.5, F.col("lon") - 0.5)
    got = df.select("lat", "lon", near.alias("p")).collect()
    assert all(abs(r.p.lat - r.lat) < 1e-4 and abs((r.p.lon - r.lon + 180) % 360 - 180) < 1e-3 for r in got)


def test_pairs_of_reports(spark):
    """Within ten seconds, the newer of the other kind, of one sender; a frame with a faulty parity takes no part."""
    at = lambda s: T0 + dt.timedelta(seconds=s)
    rows = [(1, at(0), ODD), (2, at(2), EVEN), (3, at(9), ODD), (4, at(30), ODD), (5, at(40), EVEN), (6, at(51), ODD), (7, at(52), EVEN[:-1] + "0"), (8, at(1), SPEED), (9, at(3), None)]
    got = {r.frame_id: (r.address, round(r.lat, 3), round(r.lon, 3), r.altitude_ft) for r in modes.paired_positions(spark.createDataFrame(rows, "frame_id long, received_at timestamp, frame string")).collect()}
    assert got == {2: (0x40621D, 52.257, 3.919, 38000), 3: (0x40621D, 52.266, 3.939, 38000), 5: (0x40621D, 52.257, 3.919, 38000)}


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("1A33000102030405808D4BB463003D10000000001B5BEC".lower(), (0x33, 0x80, "8D4BB463003D10000000001B5BEC")), ("FF33000102030405808D4BB463003D10000000001B5BEC", None),
        ("8D4BB463", None), ("1A3100010203040510ABCD", (0x31, 0x10, "ABCD")), ("1A3100010203040510AB", None), ("", None),
    ],
)
def test_receiver_framing(spark, raw, want):
    got = one(spark, modes.unframed(F.unhex("r")), r=raw)
    assert (got and tuple(got)) == want


# -- change feeds ----------------------------------------------------------------------------------------------

FLIGHT = "flight_id long, aircraft_id long, club_id long, takeoff timestamp, landing timestamp, distance_m double, dep long, arr long, towed boolean"


def random_flights(rng, ids):
    maybe = lambda x: None if rng.random() < 0.15 else x
    out = {}
    for i in ids:
        takeoff = maybe(T0 + dt.timedelta(hours=rng.randrange(50), minutes=rng.randrange(60)))
        landing = maybe((takeoff or T0) + dt.timedelta(minutes=rng.randrange(500)))
        out[i] = (i, maybe(rng.randrange(6)), maybe(rng.randrange(3)), takeoff, landing, maybe(rng.randrange(10**6) / 100), maybe(rng.randrange(4)), maybe(rng.randrange(4)), maybe(rng.random() < 0.5))
    return out


@pytest.mark.parametrize("name", list(retractable.ROLLUPS))
def test_rollups_follow_changes_in_any_order(spark, name):
    """What a rollup shows after inserts, updates and deletes, delivered twice and in parts, is the batch rollup of the new table."""
    rng = random.Random(name)
    old = random_flights(rng, range(150))
    new = {i: f for i, f in old.items() if i % 4} | {i: f for i, f in random_flights(rng, range(0, 200, 3)).items() if i % 4 or i >= 150}
    changes = [(i % 3, str(i), old.get(i), new.get(i)) for i in sorted(old.keys() | new.keys()) if old.get(i) != new.get(i)]
    # a flight that comes and goes again leaves nothing
    passing = random_flights(rng, [900])[900]
    changes += [(1, "900a", passing, None), (2, "900b", None, passing)]
    feed = spark.createDataFrame(changes + changes[::2], f"batch_id long, seq string, before struct<{FLIGHT.replace(' ', ':').replace(',:', ',')}>, after struct<{FLIGHT.replace(' ', ':').replace(',:', ',')}>")
    rollup = retractable.ROLLUPS[name]
    state = rollup.state(retractable.as_inserted(spark.createDataFrame([*old.values()], FLIGHT)))
    applied = spark.createDataFrame([], "batch_id long")
    for batch in (2, 0, 1):
        due = retractable.pending(feed.filter(F.col("batch_id") <= batch) if batch else feed.filter("batch_id = 0"), applied)
        due = due.filter(F.col("batch_id") == batch)
        state = rollup.merged(state, rollup.state(retractable.signed(due)))
        applied = applied.union(spark.createDataFrame([(batch,)], "batch_id long"))
    assert retractable.pending(feed, applied).count() == 0
    table = spark.createDataFrame([*new.values()], FLIGHT)
    now = F.lit(T0 + dt.timedelta(hours=60))
    clubs = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "club_id long, name string")
    aircraft = spark.createDataFrame([(i, "r") for i in range(6)], "aircraft_id long, registration string")
    want = {
        "daily": lambda: rollups.daily_flights(table),
        "hourly": lambda: rollups.hourly_flights(table),
        "histogram": lambda: rollups.duration_histogram(table),
        "aircraft": lambda: rollups.aircraft_stats(aircraft, table, now).filter("n_flights > 0").drop("registration", "z_score"),
        "club": lambda: rollups.club_daily(table, clubs).drop("name"),
        "airport": lambda: rollups.airport_daily(table),
    }[name]()
    got = rollup.shown(state, now) if name == "aircraft" else rollup.shown(state)
    rows = lambda df: sorted(repr([None if x is None else float(x) if isinstance(x, int | float) else str(x) for x in r]) for r in df.select(*want.columns).collect())
    assert rows(got) == rows(want)
    assert want.count() > 2


def test_flight_checks(spark):
    at = lambda m: None if m is None else T0 + dt.timedelta(minutes=m)
    sound = {"created": 0, "takeoff": 0, "tow_release": 5, "landing": 60, "last_fix": 50, "timed_out_at": None}
    cases = [
        ({}, []), ({"last_fix": 49}, ["landing_near_last_fix"]), ({"last_fix": -1, "landing": None}, ["last_fix_after_created"]), ({"takeoff": 60, "tow_release": None}, ["takeoff_before_landing"]),
        ({"tow_release": 0}, ["takeoff_before_tow_release"]), ({"timed_out_at": 55}, ["timed_out_or_landed"]), ({"landing": None, "timed_out_at": 49}, ["timeout_after_last_fix"]),
        ({"landing": None, "timed_out_at": 50 + 1440}, []), ({"landing": None, "timed_out_at": 51 + 1440}, ["timeout_reasonable"]), ({"tow_release": 60}, ["tow_release_before_landing"]),
        ({"created": None, "takeoff": None, "landing": None}, []),
    ]
    rows = [(k, *(at((sound | change)[c]) for c in sound)) for k, (change, _) in enumerate(cases)]
    df = spark.createDataFrame(rows, "k long, " + ", ".join(f"{c} timestamp" for c in sound))
    assert {r.k: r.broken for r in merge.with_broken_checks(df).collect()} == {k: want for k, (_, want) in enumerate(cases)}


N = None
AIRCRAFT = "aircraft_id long, registration string, pending string, icao int, flarm int, ogn int, other int"
PENDING = [
    ("only one address", [(1, "N204DG", N, N, 0xDD, N, N), (2, N, "N204DG", 0xAB, N, N, N)], [(1, "N204DG", N, 0xAB, 0xDD, N, N)], {2: ("merge", 1, [])}),
    ("the target has one of that kind", [(1, "N1", N, 0x11, N, N, N), (2, N, "N1", 0x22, N, N, N)], [(1, "N1", N, 0x11, N, N, N)], {2: ("merge", 1, ["icao"])}),
    ("several kinds", [(1, "N1", N, N, 0xAA, N, N), (2, N, "N1", 0xBB, N, 0xCC, N)], [(1, "N1", N, 0xBB, 0xAA, 0xCC, N)], {2: ("merge", 1, [])}),
    ("nobody holds it", [(3, N, "N999ZZ", 0x1, N, N, N), (4, "N5", N, 0x2, N, N, N)], [(3, "N999ZZ", N, 0x1, N, N, N), (4, "N5", N, 0x2, N, N, N)], {3: ("take", N, [])}),
    ("two wait, the first takes it", [(5, " ", "N7", N, 0x5, N, N), (6, N, "N7", N, 0x6, N, 0x9), (7, N, "N7", 0x7, 0x5, N, N)], [(5, "N7", N, 0x7, 0x5, N, 0x9)], {5: ("take", N, []), 6: ("merge", 5, ["flarm"]), 7: ("merge", 5, [])}),
    ("two bring one kind", [(1, "N1", N, N, N, N, 0x1), (2, N, "N1", N, N, 0x2, N), (3, N, "N1", N, N, 0x3, N)], [(1, "N1", N, N, N, 0x2, 0x1)], {2: ("merge", 1, []), 3: ("merge", 1, ["ogn"])}),
    ("waits for its own", [(1, "N1", "N1", 0x1, N, N, N)], [(1, "N1", N, 0x1, N, N, N)], {1: ("take", N, [])}),
    ("blank", [(1, "", "  ", 0x1, N, N, N)], [(1, "", "  ", 0x1, N, N, N)], {}),
]


@pytest.mark.parametrize(("rows", "after", "outcomes"), [c[1:] for c in PENDING], ids=[c[0] for c in PENDING])
def test_pending_registrations(spark, rows, after, outcomes):
    df = spark.createDataFrame(rows, AIRCRAFT)
    resolved = merge.resolve_pending(df)
    assert {r.aircraft_id: (r.outcome, r.target, r.discarded) for r in resolved.collect()} == outcomes
    assert sorted(map(tuple, merge.apply_resolved(df, resolved).collect())) == after


def test_k_nearest_rows_however_far(spark):
    rng = random.Random(6)
    left = [(i, rng.uniform(-90, 90), rng.uniform(-180, 180)) for i in range(60)] + [(900, 90.0, 0.0), (901, -90.0, 0.0), (902, 0.0, 180.0), (903, None, 1.0)]
    right = [(j, rng.gauss(47, 2), rng.gauss(8, 2)) for j in range(40)] + [(500, 47.0, 8.0), (501, 47.0, 8.0), (502, -47.0, -172.0)]

    def far(a, b):
        p, q = math.radians(a[0]), math.radians(b[0])
        h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
        return 2 * 6_371_000.0 * math.asin(min(1.0, math.sqrt(h)))

    a, b = spark.createDataFrame(left, "i long, lat double, lon double"), spark.createDataFrame(right, "j long, lat2 double, lon2 double")
    for k in (1, 4, 100):
        got = {(r.i, r.rank): (r.j, r.distance_m) for r in spatial.k_nearest(a, b, "i", "j", k, 200_000.0).collect()}
        want = {(i, n + 1): m for i, *x in left if x[0] is not None for n, m in enumerate(sorted((far(x, y), j) for j, *y in right)[:k])}
        assert got.keys() == want.keys()
        assert all(abs(got[key][1] - m) < 0.01 for key, (m, _) in want.items())
        if k == 1:
            assert sum(got[key][0] == j for key, (_, j) in want.items()) >= len(want) - 1
    assert spatial.k_nearest(a, b.limit(0), "i", "j", 3).count() == 0
    assert spatial.k_nearest(a.limit(0), b, "i", "j", 3).count() == 0
