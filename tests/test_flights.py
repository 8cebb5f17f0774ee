"""Flights, batch and streaming, against rules that are written out again here and import nothing of the operator; transponder fixes as a stream."""

from __future__ import annotations

import datetime as dt
import json
import math
import random

import pytest
from pyspark.sql import functions as F

from contrail.operators import sessions, transponder
from contrail.streaming import jobs

T0 = dt.datetime(2025, 1, 1)
BASE = T0.replace(tzinfo=dt.UTC).timestamp()
COLUMNS = "aircraft_id long, fix_id long, received_at timestamp, lat double, lon double, alt_ft int, agl_ft int, speed_kt double, climb_fpm int, on_ground boolean, callsign string"
SHOWN = ["aircraft_id", "first_fix", "last_fix", "takeoff", "landed", "timed_out", "n_fixes", "callsign", "spurious"]


def far(a, b):
    x, y = math.radians(a[0]), math.radians(b[0])
    h = math.sin((y - x) / 2) ** 2 + math.cos(x) * math.cos(y) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * 6_371_000.0 * math.asin(min(1.0, math.sqrt(h)))


def plain_flights(rows):
    """rows: (aircraft, fix, seconds, lat, alt, agl, speed, climb, on_ground, callsign) -> list of SHOWN; lon is 8 throughout."""
    out = []
    newest = max((int(r[2] * 1e6) for r in rows), default=0) / 1e6
    for plane in {r[0] for r in rows}:
        mine, seen, flight = sorted((r for r in rows if r[0] == plane), key=lambda r: (r[2], r[1])), [], None

        def finish(flight, landed, timed_out, by):
            reasons = []
            alts, agls = [f[4] for f in flight["fixes"] if f[4] is not None], [f[5] for f in flight["fixes"] if f[5] is not None]
            if flight["takeoff"] is not None:
                lasted = (flight["fixes"][-1][2] if landed is None else landed) - flight["takeoff"]
                guessed = by[8] is None
                reasons += ["short_duration"] * (guessed and lasted < 120)
                reasons += ["altitude_range"] * (guessed and bool(alts) and max(alts) - min(alts) < 50)
                reasons += ["low_height"] * (guessed and bool(agls) and max(agls) < 100)
                reasons += ["excessive_altitude"] * (bool(alts) and max(alts) > 100_000)
                reasons += ["excessive_speed"] * (lasted > 0 and flight["metres"] / 1609.344 * 3600 / lasted > 1000)
                reasons += ["short_distance"] * (guessed and flight["metres"] < 500)
            shown(flight, landed, timed_out, reasons)

        def shown(flight, landed, timed_out, reasons):
            whole = lambda x: None if x is None else int(x)
            first, last = flight["fixes"][0][2], flight["fixes"][-1][2]
            out.append((plane, whole(first), whole(last), whole(flight["takeoff"]), whole(landed), timed_out, len(flight["fixes"]), flight["callsign"], reasons))

        for r in mine:
            before = seen[-1] if seen else None
            if before and math.floor(r[2] - before[2]) < 1:
                continue
            gap = r[2] - before[2] if before else 0
            active = not r[8] if r[8] is not None else ((r[6] or 0) >= 80 if r[4] is None and r[5] is None else (r[6] or 0) >= 25 or (r[5] or 0) >= 250)
            name, new_name = (r[9] or "").strip() or None, False
            moved = far((before[3], 8), (r[3], 8)) if before else 0
            if flight and active and name and flight["callsign"] not in (None, name):
                finish(flight, r[2], False, r)
                flight, new_name = None, True
            elif flight:
                pace = before[6]
                split = gap > 7200 or (gap > 1800 and (pace is None or pace <= 25 or moved < 0.3 * pace * 0.514444 * gap))
                if split:
                    finish(flight, None, True, before)
                    flight = None
            if flight is None and gap > 18 * 3600:
                seen = [(*f[:10], None) for f in seen[-1:]]  # its rows no longer count as quiet or active
            if flight is None and active:
                states = [f[10] for f in seen if f[10] is not None][-5:]
                if r[8] is not None:
                    starts = bool(states) and not states[-1]
                else:
                    starts = not any(states[-3:]) if len(states) >= 3 else r[5] is not None and r[5] < 100
                flight = {"takeoff": r[2] if starts or new_name else None, "fixes": [], "metres": 0.0, "callsign": name}
                moved = 0.0
            seen.append((*r, active))
            if flight:
                flight["fixes"].append(r)
                flight["metres"] += moved
                if active and flight["callsign"] is None:
                    flight["callsign"] = name
                last_five = [f[10] for f in seen if f[10] is not None][-5:]
                grounded = r[8] if r[8] is not None else (r[5] is None or r[5] < 250) and len(last_five) == 5 and not any(last_five)
                if grounded:
                    finish(flight, r[2], False, r)
                    flight = None
        if flight:
            if newest - seen[-1][2] > 3600:
                finish(flight, None, True, seen[-1])
            else:
                shown(flight, None, False, [])
    return sorted(out, key=repr)


def table(spark, rows):
    made = [(a, k, T0 + dt.timedelta(seconds=t), lat, 8.0, alt, agl, v, c, g, s) for a, k, t, lat, alt, agl, v, c, g, s in rows]
    return spark.createDataFrame(made, COLUMNS)


def shown(df):
    since = lambda x: None if x is None else x - int(BASE)
    return sorted(((r.aircraft_id, since(r.first_fix), since(r.last_fix), since(r.takeoff), since(r.landed), r.timed_out, r.n_fixes, r.callsign, list(r.spurious)) for r in df.select(*SHOWN).collect()), key=repr)


def wandering(seed, n=1500, planes=5):
    rng = random.Random(seed)
    rows, t, lat = [], 0, 47.0
    for k in range(n):
        t += rng.choice([0, 1, 1, 5, 20, 60, 600, 1300, 4000])
        if rng.random() < 0.004:
            t += rng.choice([20_000, 80_000])
        lat += rng.choice([0.0, 0.001, 0.05, 0.4, -0.4])
        plane = rng.randrange(planes)
        on_ground = rng.choice([None, True, False, False]) if plane == 0 else None
        name = rng.choice([None, None, "", " AB1", "AB1", "AB2"]) if plane < 2 else None
        rows.append((plane, k, float(t), 47 + abs(lat) % 5, rng.choice([None, 100, 900, 3000, 120_000]), rng.choice([None, 0, 50, 900]), rng.choice([None, 0.0, 10.0, 60.0, 90.0]), rng.randrange(-900, 900), on_ground, name))
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_flights_against_rules_written_again(spark, seed):
    rows = wandering(seed)
    assert shown(sessions.sessionize(table(spark, rows))) == plain_flights(rows)
    assert len(plain_flights(rows)) > 30


FLY = (2000, 1500, 60.0, 0, None)


def test_a_new_callsign_starts_a_new_flight(spark):
    """The case of a flight that begins without one: it is learned, and the next one lands the flight."""
    names = [None, "WMT437", None, "", "WMT437", "WMT2574", None]
    rows = [(1, k, 60.0 * k, 47.0 + 0.1 * k, *FLY, n) for k, n in enumerate(names)]
    rows += [(2, 10 + k, 60.0 * k, 47.0, 100, 0, 0.0, 0, None, n) for k, n in enumerate(["AA1", "BB2", "CC3"])]  # never active
    got = shown(sessions.sessionize(table(spark, rows)))
    assert [(g[1], g[3], g[4], g[6], g[7]) for g in got] == [(0, None, 300, 5, "WMT437"), (300, 300, None, 2, "WMT2574")]


def test_transponder_flights_are_spurious_by_faulty_data_only(spark):
    up = lambda k, t, lat, alt, name=False: (1, k, t, lat, alt, 20, 5.0, 0, name, None)
    rows = [up(0, 0.0, 47.0, 100, True), up(1, 10.0, 47.0, 100), up(2, 40.0, 47.001, 110), up(3, 90.0, 47.001, 110, True)]
    rows += [up(10, 1000.0, 47.0, 100, True), up(11, 1010.0, 47.0, 100_001), up(12, 1020.0, 49.0, 100, True)]
    rows += [(2, 20 + k, 10.0 * k, 47.0, 100, 20, 30.0 if 3 <= k < 6 else 0.0, 0, None, None) for k in range(12)]
    got = {(g[0], g[1]): g[8] for g in shown(sessions.sessionize(table(spark, rows)))}
    assert got == {(1, 10): [], (1, 1010): ["excessive_altitude", "excessive_speed"], (2, 30): ["short_duration", "altitude_range", "low_height", "short_distance"]}


def test_flights_go_on_from_handed_on_states(spark):
    rows = wandering(7)
    cut = rows[700][2]
    early, late = [r for r in rows if r[2] <= cut], [r for r in rows if r[2] > cut]
    state = sessions.states(table(spark, early))
    whole = [f[:2] + f[3:] for f in shown(sessions.sessionize(table(spark, rows)))]
    parts = shown(sessions.sessionize(table(spark, early))) + shown(sessions.sessionize(table(spark, late), state))
    over = [f[:2] + f[3:] for f in parts if f[4] is not None or f[5] or f in shown(sessions.sessionize(table(spark, late), state))]
    # what was open at the cut is shown by the second part as a whole
    assert set(map(repr, whole)) <= set(map(repr, over))


def orphan(last, name, takeoff=None):
    return {"aircraft_id": 1, "flight_no": 4, "first_fix": int(BASE), "last_fix": int(BASE) + last, "takeoff": takeoff and int(BASE) + takeoff, "landed": None, "timed_out": False, "phase": None,
            "n_fixes": 9, "metres": 70_000.0, "min_alt": 500.0, "max_alt": 900.0, "max_agl": 400.0, "spurious": [], "callsign": name}


@pytest.mark.parametrize(
    ("held", "name", "want"),
    [
        (orphan(600, "AB1"), "AB1", [(0, None, 10, "AB1")]),  # carried on
        (orphan(600, None), "AB1", [(0, None, 10, "AB1")]),
        (orphan(600, "AB1"), None, [(0, None, 10, "AB1")]),
        (orphan(600, "AB1"), "CD2", [(0, 2000, 9, "AB1"), (2000, None, 1, "CD2")]),  # another operation
        (orphan(199, "AB1"), "AB1", [(0, 199, 9, "AB1"), (2000, None, 1, "AB1")]),  # 1,801 s old: over at its last fix
        (orphan(200, "AB1"), "AB1", [(0, None, 10, "AB1")]),
        (orphan(100, "AB1", 100), "AB1", [(0, 101, 9, "AB1"), (2000, None, 1, "AB1")]),
    ],
)
def test_open_flights_of_a_table_are_adopted_or_ended(spark, held, name, want):
    older = held | {"flight_no": 3, "last_fix": held["last_fix"] - 50}
    flights = spark.createDataFrame([tuple(h[c] for c in ("aircraft_id", *sessions.COLUMNS)) for h in (older, held)], sessions.SCHEMA)
    got = shown(sessions.sessionize(table(spark, [(1, 1, 2000.0, 47.0, *FLY, name)]), sessions.orphans(flights)))
    assert [(g[1], g[4], g[6], g[7]) for g in got] == want


# -- streaming -------------------------------------------------------------------------------------------------


def stream_of(spark, tmp_path, batches, schema):
    """A stream that reads one batch after the other."""
    source = tmp_path / "in"
    source.mkdir()
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"b{k}"))
        next((tmp_path / f"b{k}").glob("part*")).rename(source / f"{k:03d}.parquet")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source))


def put_out(spark, tmp_path, df):
    query = df.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    assert query.awaitTermination(240)
    return spark.read.parquet(str(tmp_path / "out")), [p["stateOperators"][0]["numRowsTotal"] for p in map(as_dict, query.recentProgress) if p["stateOperators"]]


def as_dict(progress):
    return progress if isinstance(progress, dict) else json.loads(progress.json)


def shuffled(rows, seed, within, parts):
    """Rows in micro-batches, each at most ``within`` seconds behind rows that come before it."""
    rng = random.Random(seed)
    order = sorted(rows, key=lambda r: r[2] + rng.uniform(0, within))
    size = math.ceil(len(order) / parts)
    return [order[k : k + size] for k in range(0, len(order), size)]


def fix_rows(batch):
    return [(a, k, T0 + dt.timedelta(seconds=t), lat, 8.0, alt, agl, v, c, g, s) for a, k, t, lat, alt, agl, v, c, g, s in batch]


def test_streamed_flights_do_not_depend_on_order_or_batches(spark, tmp_path):
    rows = wandering(11, n=400, planes=3)
    end = max(r[2] for r in rows) + 40 * 3600.0
    after = [(99, 9000, end, 47.0, 100, 0, 0.0, 0, None, None), (99, 9001, end + 3600, 47.0, 100, 0, 0.0, 0, None, None)]
    batches = [fix_rows(b) for b in shuffled(rows, 3, 540, 5)] + [fix_rows(after[:1]), fix_rows(after[1:])]
    got, state = put_out(spark, tmp_path, jobs.flights(stream_of(spark, tmp_path, batches, COLUMNS)))
    want = shown(sessions.sessionize(table(spark, rows + after)))
    assert shown(got) == want == plain_flights(rows + after)
    assert state[-1] < max(state)
    assert state[-1] <= 4  # one aircraft, its state and its timer: the others are forgotten


def test_a_stream_goes_on_from_open_flights(spark, tmp_path):
    early = [(1, k, 60.0 * k, 47.0 + 0.1 * k, *FLY, "AB1") for k in range(5)]
    late = [(1, 10 + k, 300.0 + 60 * k, 47.5 + 0.1 * k, *FLY, None) for k in range(3)]
    end = [(9, 99, 90_000.0, 47.0, 100, 0, 0.0, 0, None, None)]
    state = sessions.states(table(spark, early))
    got, _ = put_out(spark, tmp_path, jobs.flights(stream_of(spark, tmp_path, [fix_rows(late), fix_rows(end)], COLUMNS), before=state))
    assert [(g[0], g[1], g[2], g[6], g[7]) for g in shown(got)] == [(1, 0, 420, 8, "AB1")]


def test_streamed_transponder_fixes(spark, tmp_path):
    rng = random.Random(2)
    rows, t = [], 0.0
    for k in range(300):
        t += rng.choice([0.4, 1.0, 3.0, 9.5, 12.0, 45.0])
        here, height = rng.random() < 0.4, rng.random() < 0.3
        rows.append((rng.randrange(3), k, t, 47 + k / 1000 if here else None, 8.0 if here else None, k * 10.0 if height else None, rng.choice([None, None, 90.0]), None, rng.choice([None, 300.0]) if k % 5 == 0 else None,
                     rng.choice([None, None, "AB1"]), rng.choice([None, None, None, "7000"]), rng.choice([None, True, False])))
    schema = "aircraft_id long, message_id long, received_at timestamp, " + ", ".join(f"{c} {k}" for c, k in transponder.FIELDS.items())
    made = lambda part: [(r[0], r[1], T0 + dt.timedelta(seconds=r[2]), *r[3:]) for r in part]
    end = [(9, 999, t + 500.0, *[None] * 9), (9, 1000, t + 900.0, *[None] * 9)]
    batches = [made(b) for b in shuffled(rows, 4, 50, 4)] + [made(end[:1]), made(end[1:])]
    got, state = put_out(spark, tmp_path, jobs.accumulated(stream_of(spark, tmp_path, batches, schema), state_s=30))
    batch = transponder.accumulated(spark.createDataFrame(made(rows), schema), state_s=30)
    names = [*batch.columns]
    rows_of = lambda df: sorted(map(repr, map(tuple, df.select(*names).collect())))
    assert rows_of(got) == rows_of(batch)
    assert batch.count() > 50
    assert state[-1] <= 3


def test_bounded_windows_forget_after_a_silence(spark):
    schema = "aircraft_id long, message_id long, received_at timestamp, " + ", ".join(f"{c} {k}" for c, k in transponder.FIELDS.items())
    rows = [(1, 0, T0, None, None, None, None, None, None, "AB1", None, False), (1, 1, T0 + dt.timedelta(seconds=40), 47.0, 8.0, None, None, None, None, None, None, None), (1, 2, T0 + dt.timedelta(seconds=41), 47.0, 8.0, None, None, None, None, None, None, True)]
    df = spark.createDataFrame(rows, schema)
    seen = lambda **k: [(r.message_id, r.callsign, r.on_ground) for r in transponder.accumulated(df, **k).orderBy("message_id").collect()]
    assert seen() == [(1, "AB1", False), (2, "AB1", True)]
    assert seen(state_s=40) == [(1, "AB1", False), (2, "AB1", True)]
    assert seen(state_s=39) == [(2, None, True)]


def test_streamed_hours_drop_what_is_behind_the_watermark(spark, tmp_path):
    rows = [(r, T0 + dt.timedelta(minutes=m)) for r, m in ((1, 5), (1, 50), (2, 61), (1, 70))]
    later, late = [(9, T0 + dt.timedelta(hours=5))], [(1, T0 + dt.timedelta(minutes=6)), (9, T0 + dt.timedelta(hours=5, minutes=1))]
    stream = stream_of(spark, tmp_path, [rows, later, late, [(9, T0 + dt.timedelta(hours=9))]], "receiver_id long, received_at timestamp")
    got, _ = put_out(spark, tmp_path, jobs.hourly(stream))
    assert {(r.hour, r.receiver_id): r.n_fixes for r in got.collect()} == {(T0, 1): 2, (T0 + dt.timedelta(hours=1), 2): 1, (T0 + dt.timedelta(hours=1), 1): 1, (T0 + dt.timedelta(hours=5), 9): 2}


def test_streamed_sessions(spark, tmp_path):
    at = lambda m: T0 + dt.timedelta(minutes=m)
    stream = stream_of(spark, tmp_path, [[(1, at(20)), (1, at(0))], [(1, at(55)), (2, at(12))], [(3, at(300))], [(3, at(301))]], "aircraft_id long, received_at timestamp")
    got, _ = put_out(spark, tmp_path, jobs.sessions(stream, delay="60 minutes"))
    assert sorted((r.aircraft_id, r.first, r.end, r.n_fixes) for r in got.collect()) == [(1, at(0), at(50), 2), (1, at(55), at(85), 1), (2, at(12), at(42), 1)]
