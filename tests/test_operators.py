"""Operators on hand-made rows, against plain Python and the rule tables of the domain."""

from __future__ import annotations

import datetime as dt
import decimal
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from contrail.functions import countries, points, text
from contrail.operators import ground, paths, sessions, spatial, tracks, transponder, updates
from contrail.streaming import jobs

T0 = dt.datetime(2025, 1, 1)
R = 6_371_000.0


def distance(a, b):
    p, q = math.radians(a[0]), math.radians(b[0])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * R * math.atan2(math.sqrt(h), math.sqrt(max(0.0, 1 - h)))


@pytest.mark.parametrize(("low", "high"), [(-90, 90), (80, 90), (-90, -85), (50, 60)])
def test_near_pairs_at_all_latitudes(spark, low, high):
    rng = random.Random(low + high)
    a = [(i, rng.uniform(low, high), rng.uniform(-180, 180)) for i in range(150)]
    b = [(i, rng.uniform(low, high), rng.uniform(-180, 180)) for i in range(150)] + [(900, 89.99, 0.0), (901, -89.99, 170.0), (902, 55.0, 179.99), (903, 55.0, -179.99)]
    reach = 300_000.0
    want = {(i, j) for i, *x in a for j, *y in b if distance(x, y) <= reach}
    left = spark.createDataFrame(a, "i long, lat double, lon double")
    right = spark.createDataFrame(b, "j long, lat2 double, lon2 double")
    got = [(r.i, r.j) for r in spatial.near_pairs(left, right, reach).collect()]
    assert len(got) == len(set(got))
    assert set(got) == want
    assert want


def test_as_of_join_takes_the_newest_row_even_if_its_value_is_null(spark):
    right = spark.createDataFrame([(1, 10, 7), (1, 20, None), (1, 40, 9)], "k long, t long, v long")
    left = spark.createDataFrame([(1, 5, 100), (1, 15, 101), (1, 25, 102), (1, 40, 103), (2, 40, 104)], "k long, t long, id long")
    got = {r.id: r.found for r in tracks.as_of_join(left, right, "k", "t", "id", "v").collect()}
    assert got == {100: None, 101: 7, 102: None, 103: 9, 104: None}


SPLITS = [(1800, 0, None, False), (1801, 0, 10.0, True), (1801, 0, None, True), (3600, 0, 100.0, True), (3600, 100 * 0.514444 * 3600, 100.0, False), (7200, 100 * 0.514444 * 7200, 100.0, False), (7201, 1e9, 100.0, True)]


@pytest.mark.parametrize(("gap", "moved", "speed", "want"), SPLITS)
def test_gap_rule(spark, gap, moved, speed, want):
    assert sessions.gap_splits(gap, moved, speed) == want
    df = spark.createDataFrame([(float(gap), float(moved), speed)], "g double, m double, s double")
    assert df.select(tracks.splits(F.col("g"), F.col("m"), F.col("s")).alias("x")).first().x == want


def fixes(spark, rows):
    """rows: (aircraft, seconds, lat, alt, agl, speed, climb, on_ground)"""
    made = [(a, k, T0 + dt.timedelta(seconds=t), lat, 8.0, alt, agl, v, c, g) for k, (a, t, lat, alt, agl, v, c, g) in enumerate(rows)]
    return spark.createDataFrame(made, "aircraft_id long, fix_id long, received_at timestamp, lat double, lon double, alt_ft int, agl_ft int, speed_kt double, climb_fpm int, on_ground boolean")


def flight_rows(df):
    base = T0.replace(tzinfo=dt.UTC).timestamp()
    return sorted((r.aircraft_id, r.flight_no, r.first_fix - base, None if r.takeoff is None else r.takeoff - base, None if r.landed is None else r.landed - base, r.timed_out, r.n_fixes) for r in df.collect())


def test_flights_of_receivers_on_the_ground(spark):
    """Three quiet fixes before make a takeoff; five quiet ones in a row land; a long gap times out."""
    quiet, fly = (100, 0, 0.0, 0), (2000, 1500, 60.0, 0)
    rows = [(1, 10 * i, 47.0, *quiet, None) for i in range(4)]
    rows += [(1, 40 + 10 * i, 47.0 + 0.01 * i, *fly, None) for i in range(20)]
    rows += [(1, 240 + 10 * i, 47.2, *quiet, None) for i in range(6)]
    rows += [(1, 300 + 9000, 47.2, *fly, None), (1, 310 + 9000, 47.3, *fly, None), (1, 310 + 20000, 47.3, *fly, None)]
    rows += [(2, 0, 47.0, *fly, None), (2, 10, 47.0, 2000, 260, 0.0, 0, None), (2, 10.5, 47.0, *quiet, None)]
    got = flight_rows(sessions.sessionize(fixes(spark, rows)))
    assert got == [
        (1, 1, 40, 40, 280, False, 25), (1, 2, 9300, 9300, None, True, 2), (1, 3, 20310, None, None, False, 1),
        (2, 1, 0, None, None, True, 2),
    ]


def test_flights_of_transponders(spark):
    """One fix on the ground before makes a takeoff, the first one after is the landing; speed and height do not matter."""
    slow, fast = (100, 0, 5.0, 0), (100, 0, 140.0, 0)
    rows = [(1, 0, 47.0, *fast, True), (1, 10, 47.0, *slow, False), (1, 20, 47.1, *slow, False), (1, 30, 47.2, *fast, True), (1, 40, 47.2, *fast, True), (2, 0, 47.0, *slow, False), (2, 5, 47.0, *slow, True)]
    assert flight_rows(sessions.sessionize(fixes(spark, rows))) == [(1, 1, 10, 10, 30, False, 3), (2, 1, 0, None, 5, False, 2)]


def test_flights_do_not_depend_on_batches_or_order(spark):
    rng = random.Random(5)
    rows, t = [], 0
    for _ in range(3000):
        t += rng.choice([1, 5, 20, 60, 600, 2500, 8000])
        rows.append((rng.randrange(5), t, 47 + rng.random(), rng.randrange(100, 9000), rng.choice([None, 0, 100, 900]), rng.choice([0.0, 10.0, 60.0, 90.0]), rng.randrange(-900, 900), rng.choice([None, None, True, False])))
    whole = fixes(spark, rows)
    want = flight_rows(sessions.sessionize(whole))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert flight_rows(sessions.sessionize(whole.orderBy(F.rand(3)).repartition(3))) == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")


def test_spurious_flights():
    base = {"takeoff": 0.0, "landed": 3600.0, "last_fix": 3600.0, "min_alt": 100.0, "max_alt": 3000.0, "max_agl": 2000.0, "metres": 50_000.0}
    assert sessions.spurious_reasons(base) == []
    for change, reason in (({"landed": 119.0, "metres": 600.0}, "short_duration"), ({"min_alt": 2951.0}, "altitude_range"), ({"max_agl": 99.0}, "low_height"), ({"max_alt": 100_001.0}, "excessive_altitude"), ({"metres": 1_610_000.0}, "excessive_speed"), ({"metres": 499.0}, "short_distance")):
        assert sessions.spurious_reasons(base | change) == [reason]
    assert sessions.spurious_reasons(base | {"max_alt": 100_000.0}) == []
    assert sessions.spurious_reasons(base | {"takeoff": None, "metres": 0.0}) == []


def test_accumulated_transponder_fixes(spark):
    n = None
    rows = [
        (1, 0, n, n, n, n, "AB1", n, n), (2, 1, 50.0, 8.0, 1000, n, n, n, n), (3, 2, n, n, n, n, n, n, False), (4, 3, n, n, n, n, n, n, False), (5, 4, n, n, 1100, n, n, n, n),
        (6, 5, n, n, n, 90.0, n, n, n), (7, 11.9, n, n, n, n, n, "7000", n), (8, 12.1, n, n, n, n, n, "7001", n), (9, 13, 51.0, 9.0, n, n, n, n, True),
    ]
    made = [(1, i, T0 + dt.timedelta(seconds=t), la, lo, al, v, n, n, c, s, g) for i, t, la, lo, al, v, c, s, g in rows]
    df = spark.createDataFrame(made, "aircraft_id long, message_id long, received_at timestamp, lat double, lon double, altitude_ft int, speed_kt double, track double, climb_fpm int, callsign string, squawk string, on_ground boolean")
    got = {r.message_id: (r.trigger, r.lat, r.altitude_ft, r.speed_kt, r.callsign, r.squawk, r.on_ground, r.position_age_ms) for r in transponder.accumulated(df).collect()}
    assert got == {
        3: ("position", 50.0, 1000, n, "AB1", n, False, 1000), 5: ("altitude", 50.0, 1100, n, "AB1", n, False, 3000), 6: ("velocity", 50.0, 1100, 90.0, "AB1", n, False, 4000),
        7: ("squawk", 50.0, 1100, 90.0, "AB1", "7000", False, 10900), 9: ("position", 51.0, n, 90.0, "AB1", "7001", True, 0),
    }


def test_tow_release(spark):
    alts = [1000, 1100, 1200, 1300, 1400, 1380]
    climbs = [0, 500, 500, 500, 500, -600]
    rows = [(1, 12 * i, 47.0, a, 0, 60.0, c, None) for i, (a, c) in enumerate(zip(alts, climbs, strict=True))]
    rows += [(2, 12 * i, 47.0, 1000 - 10 * i, 0, 60.0, -600, None) for i in range(6)]
    got = ground.tow_releases(fixes(spark, rows)).collect()
    assert [(r.aircraft_id, r.alt_ft) for r in got] == [(1, 1380)]


def test_runways(spark):
    """With the airport known the better direction always counts, else only under 30 degrees; the magnetic heading names the rest."""
    ends = spark.createDataFrame([(7, "le", 47.0, 8.0, 140.0), (7, "he", 47.01, 8.0, 320.0)], "airport_id long, end string, lat2 double, lon2 double, runway_heading double")
    events = spark.createDataFrame([(1, 1, T0, 47.0, 8.0), (2, 2, T0, 47.0, 8.0), (3, 3, T0, 10.0, 8.0), (4, 4, T0, 47.0, 8.0)], "event_id long, aircraft_id long, received_at timestamp, lat double, lon double")
    at = [(1, -20, 150.0), (1, 20, 130.0), (1, 21, 0.0), (2, 3, 250.0), (3, 0, 357.0), (4, 0, None)]
    f = spark.createDataFrame([(a, T0 + dt.timedelta(seconds=t), c) for a, t, c in at], "aircraft_id long, received_at timestamp, track double")
    run = lambda known: {r.event_id: (r.runway, r.inferred) for r in ground.runways_used(events, f, ends, F.lit(2.0), known).collect()}
    assert run(False) == {1: ("14", False), 2: ("25", True), 3: ("36", True)}
    assert run(True) == {1: ("14", False), 2: ("32", False), 3: ("36", True)}


def test_updates(spark):
    old = spark.createDataFrame([(1, "a"), (2, None), (3, None)], "k long, v string")
    new = spark.createDataFrame([(1, "x"), (2, "y"), (9, "z")], "k long, v string")
    assert sorted(map(tuple, updates.update_where(old, new, "k", F.col("v").isNull()).collect())) == [(1, "a"), (2, "y"), (3, None)]
    assert updates.update_where(old, new, "k", F.lit(None).cast("boolean")).filter("v IS NOT NULL").count() == 1
    assert updates.altitudes_overlap(F.lit(1), F.lit(2), None, None) is None
    marked = updates.soft_deleted(old.withColumn("deleted_at", F.lit(None).cast("timestamp")), new, "k", F.lit(T0))
    assert [r.k for r in updates.visible(marked).collect()] == [3]


@pytest.mark.parametrize(("address", "country"), [(0xA0D1AE, "US"), (0x3C6444, "DE"), (0x4B1234, "CH"), (0x7C0000, "AU"), (0xC00001, "CA"), (0x000001, None), (0xFFFFFF, None), (-5, None)])
def test_address_country(spark, address, country):
    df = spark.createDataFrame([(address, "icao"), (address, "flarm")], "a long, kind string")
    assert [r.country for r in countries.with_address_country(df, "a", "kind").orderBy(F.desc("kind")).collect()] == [country, None]


@pytest.mark.parametrize(("reg", "country"), [("N123AB", "US"), ("D-1234", "DE"), ("HB-3456", "CH"), ("C-GABC", "CA"), ("OE-5678", "AT"), ("G-ABCD", "GB"), ("VH-ABC", "AU"), ("F-CABC", "FR"), ("", None), (None, None), ("9A-ABC", "HR")])
def test_registration_country(spark, reg, country):
    df = spark.createDataFrame([(reg,)], "r string")
    assert df.select(countries.registration_country(F.col("r")).alias("c")).first().c == country


def test_address_blocks_do_not_overlap():
    spans = sorted(countries.ADDRESS_BLOCKS)
    assert all(a[1] < b[0] for a, b in zip(spans, spans[1:], strict=False))
    assert all(a % 1024 == 0 and (b + 1) % 1024 == 0 for a, b, _ in spans)


def test_points(spark):
    df = spark.createDataFrame([(47.5, 8.25), (None, 1.0)], "lat double, lon double").select(points.point(F.col("lat"), F.col("lon")).alias("p"))
    a, b = df.select(points.wkt(F.col("p")).alias("w"), points.geojson(F.col("p")).alias("g"), points.from_wkt(points.wkt(F.col("p"))).alias("u"), points.from_geojson(points.geojson(F.col("p"))).alias("v")).collect()
    assert (a.w, tuple(a.u), tuple(a.v)) == ("POINT(8.25 47.5)", (8.25, 47.5), (8.25, 47.5))
    assert tuple(b) == (None, None, None, None)
    with pytest.raises(ValueError, match="south"):
        points.envelope(1.0, 0.0, 0.0, 0.0)


CALLSIGNS = [("AB1", "AB2", True), ("AB1", "AB1", False), ("AB1", None, False), (None, "AB1", False), ("AB1", "", False), ("AB1", "  ", False), (" AB1 ", "AB1", False), (None, None, False)]


@pytest.mark.parametrize(("old", "new", "changed"), CALLSIGNS)
def test_callsigns(spark, old, new, changed):
    df = spark.createDataFrame([(old, new)], "o string, n string")
    assert df.select(text.callsign_changed(F.col("o"), F.col("n")).alias("c")).first().c == changed


@pytest.mark.parametrize(("name", "want"), [("THE BOEING COMPANY", "Boeing"), ("SCHEMPP-HIRTH GMBH", "Schempp-Hirth"), ("CESSNA AIRCRAFT CO", "Cessna Aircraft"), ("INC", "Inc")])
def test_manufacturers(spark, name, want):
    df = spark.createDataFrame([(name,)], "n string")
    got = df.select(text.normalized_manufacturer(F.col("n"), {"CESSNA AIRCRAFT CO": "Cessna Aircraft"}).alias("m"), text.normalized_model(F.lit("CESSNA-172"), {"CESSNA": "Cessna"}).alias("d")).first()
    assert (got.m, got.d) == (want, "Cessna-172")


def test_path_figures(spark):
    """A straight track: the spline's length is the distance between its ends, its displacement half of a way out and back."""
    rows = [(1, 60 * i, 47.0 + 0.01 * i, 1000, 0, 60.0, 0, None) for i in range(11)]
    rows += [(2, 60 * i, 47.0 + 0.01 * min(i, 10 - i), 1000, 0, 60.0, 0, None) for i in range(11)]
    got = {r.aircraft_id: r for r in paths.path_figures(fixes(spark, rows), "aircraft_id").collect()}
    straight = distance((47.0, 8.0), (47.1, 8.0))
    assert got[1].spline_m == pytest.approx(straight, rel=1e-3)
    assert got[2].spline_m == pytest.approx(straight, rel=2e-2)
    assert got[2].displacement_m == pytest.approx(straight / 2, rel=2e-2)


def spline_by_hand(places):
    """Length and displacement of the path through (lat, lon, alt_m), the pyramid of Barry and Goldman in decimal numbers, each sample for itself."""
    wide = lambda x: np.array([np.longdouble(str(c)) for c in x])
    Decimal = decimal.Decimal  # noqa: N806

    def metres(a, b):
        p, q = np.radians(a), np.radians(b)
        h = np.sin((q[0] - p[0]) / 2) ** 2 + np.cos(p[0]) * np.cos(q[0]) * np.sin((q[1] - p[1]) / 2) ** 2
        return 2 * R * np.arctan2(np.sqrt(h), np.sqrt(1 - h))

    rise = lambda a, b: np.hypot(metres(a, b), b[2] - a[2])
    path = places = [np.array([Decimal(c) for c in x]) for x in places]
    if len(places) > 2:
        path = []
        for p in zip(places[:1] + places, places, places[1:], places[2:] + places[-1:], strict=False):
            n = max(2, math.ceil(rise(wide(p[1]), wide(p[2])) / 100))
            t = [Decimal(0)]
            for a, b in zip(p, p[1:], strict=False):
                t.append(t[-1] + max(((b - a) ** 2).sum().sqrt().sqrt(), Decimal("1e-9")))
            for k in range(n):
                x = t[1] + (t[2] - t[1]) * k / n
                mix = lambda i, j, a, b, x=x, t=t: ((t[j] - x) * a + (x - t[i]) * b) / (t[j] - t[i])
                a1, a2, a3 = (mix(i, i + 1, p[i], p[i + 1]) for i in range(3))
                path.append(mix(1, 2, mix(0, 2, a1, a2), mix(1, 3, a2, a3)))
        path.append(places[-1])
    path = [wide(x) for x in path]
    return float(sum(rise(a, b) for a, b in zip(path, path[1:], strict=False))), float(max(metres(path[0], x) for x in path))


def test_path_figures_of_many_flights(spark, monkeypatch):
    """Flights of one to nine fixes, some of them repeated, cut by batches and by runs of samples; a flight may lack its key."""
    monkeypatch.setattr(paths, "SAMPLES", 64)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        rng = random.Random(3)
        rows = [(flight or None, 60 * k, 47.0 + rng.choice([0, 0.001, 0.02, rng.random() / 20]), rng.choice([1000, rng.randrange(3000), None]), 0, 60.0, 0, None) for flight in range(40) for k in range(1 + flight % 9)]
        got = {r.aircraft_id: r for r in paths.path_figures(fixes(spark, rows).repartition(3), "aircraft_id").collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == 40
    for flight, r in got.items():
        with decimal.localcontext(prec=50):
            length, away = spline_by_hand([(lat, 8.0, (alt or 0) * 0.3048) for a, _, lat, alt, *_ in rows if a == flight])
        assert r.n_points == 1 + (flight or 0) % 9
        assert (r.spline_m is None) == (r.n_points == 1)
        assert (r.spline_m or 0) == pytest.approx(length, rel=1e-8, abs=1e-6)
        assert r.displacement_m == pytest.approx(away, rel=1e-8, abs=1e-6)


def test_path_figures_read_flights_together(spark):
    """No call for each flight."""
    plan = paths.path_figures(fixes(spark, [(1, 0, 47.0, 0, 0, 60.0, 0, None)]), "aircraft_id")._jdf.queryExecution().toString()
    assert "MapInArrow" in plan
    assert "FlatMapGroups" not in plan


def streamed(spark, tmp_path, job, batches, schema, **options):
    """The rows that a job puts out for these batches, one after the other."""
    source = tmp_path / "in"
    source.mkdir()
    stream = job(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source)))
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"b{k}"))
        part = next((tmp_path / f"b{k}").glob("part*"))
        part.rename(source / f"{k:03d}.parquet")
        query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        assert query.awaitTermination(120)
    return spark.read.parquet(str(tmp_path / "out")).collect()


def test_streamed_rows_come_once(spark, tmp_path):
    a = [(1, T0), (2, T0 + dt.timedelta(minutes=1)), (1, T0)]
    got = streamed(spark, tmp_path, lambda s: jobs.once(s, "k", "t"), [a, a], "k long, t timestamp")
    assert sorted(r.k for r in got) == [1, 2]


def test_streamed_latest(spark, tmp_path):
    source, state = tmp_path / "in", str(tmp_path / "state")
    source.mkdir()
    schema = "aircraft_id long, received_at timestamp, v long"
    for k in range(4):
        rows = [(1, T0 + dt.timedelta(hours=k), k), (k, T0 - dt.timedelta(hours=k), 10 + k)]
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"b{k}"))
        next((tmp_path / f"b{k}").glob("part*")).rename(source / f"{k:03d}.parquet")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    query = jobs.upsert_latest(stream, state, str(tmp_path / "check")).trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    assert {r.aircraft_id: r.v for r in spark.read.parquet(f"{state}/v3").collect()} == {0: 10, 1: 3, 2: 12, 3: 13}
    assert not (tmp_path / "state" / "v0").exists()
