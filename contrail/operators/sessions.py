"""Flights from fixes: the state machine (T6-T13, W8), shared by the batch operator and the streaming one.

Rules per aircraft, in order of (received_at, fix_id):
a fix within the same second as the last accepted one is dropped; a gap that splits closes the open flight at its
last fix; an active fix without an open flight opens one, as a takeoff if enough fixes before it were inactive or it
is under 100 ft above ground, else as an airborne start; five inactive fixes in a row below 250 ft land it; an hour
without fixes before the newest event time of all aircraft times it out, with a phase from its climb rate.

Fixes of transponders (``on_ground`` not null) say themselves whether they fly: one inactive fix before makes a start a takeoff, and the first
fix on the ground is the landing. Without the column ``on_ground`` all fixes follow the first rules. Only height and speed beyond reason make a flight that ends with a transponder's
fix spurious.

An active fix with another callsign than the flight's (column ``callsign``, where there is one) lands the flight and takes off a new one. A flight without one
learns it from its active fixes. The state of an aircraft is forgotten ``STALE`` seconds after its last fix when nothing is open.

States of trackers are JSON and can be handed on: ``states()`` gives them at the end of some fixes, ``orphans()`` makes them of flights that a table holds as open; both
``sessionize()`` and the streaming job take them. An open flight of the table is carried on by the first active fix within ``ADOPTED`` seconds whose callsign does not differ, else it ends.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .paths import R

ACTIVE_KT, ACTIVE_AGL, NO_ALTITUDE_KT = 25.0, 250.0, 80.0
QUIET_FIXES, FIXES_BEFORE_TAKEOFF = 5, 3
GAP_NEVER, GAP_ALWAYS, TIMEOUT = 1800.0, 7200.0, 3600.0
ADOPTED, STALE = 1800.0, 18 * 3600.0
SCHEMA = (
    "aircraft_id long, flight_no long, first_fix long, last_fix long, takeoff long, landed long, timed_out boolean, "
    "phase string, n_fixes long, metres double, min_alt double, max_alt double, max_agl double, spurious array<string>, callsign string"
)
STATE = "aircraft_id long, state string"


def metres(a: tuple, b: tuple) -> float:
    p, q = math.radians(a[0]), math.radians(b[0])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * R * math.atan2(math.sqrt(h), math.sqrt(max(0.0, 1 - h)))


def is_active(speed: float | None, agl: float | None, alt: float | None) -> bool:
    speed = speed or 0.0
    if agl is None and alt is None:
        return speed >= NO_ALTITUDE_KT
    return speed >= ACTIVE_KT or (agl or 0.0) >= ACTIVE_AGL


def gap_splits(gap: float, moved: float, speed_before: float | None) -> bool:
    if gap > GAP_ALWAYS:
        return True
    if gap <= GAP_NEVER:
        return False
    return moved < 0.3 * speed_before * 0.514444 * gap if speed_before is not None and speed_before > 25 else True


def phase_of(climb: float | None, alt: float | None) -> str:
    if climb is None:
        return "unknown"
    if climb > 300:
        return "climbing"
    if climb < -300:
        return "descending"
    return "cruising" if alt is not None and alt > 10_000 and abs(climb) < 500 else "unknown"


def spurious_reasons(f: dict, transponder: bool = False) -> list[str]:
    """Only for flights with a known takeoff; empty for a sound flight. A transponder's word on whether it flies is taken, so its flights are only tested for faulty data."""
    if f["takeoff"] is None:
        return []
    seconds = (f["landed"] if f["landed"] is not None else f["last_fix"]) - f["takeoff"]
    low, high = f["min_alt"], f["max_alt"]
    tests = [
        (not transponder and seconds < 120, "short_duration"),
        (not transponder and low is not None and high - low < 50, "altitude_range"),
        (not transponder and f["max_agl"] is not None and f["max_agl"] < 100, "low_height"),
        (high is not None and high > 100_000, "excessive_altitude"),
        (seconds > 0 and f["metres"] / 1609.344 / (seconds / 3600) > 1000, "excessive_speed"),
        (not transponder and f["metres"] < 500, "short_distance"),
    ]
    return [name for hit, name in tests if hit]


def known(callsign: str | None) -> str | None:
    return (callsign or "").strip() or None


@dataclass
class Tracker:
    """State of one aircraft; feed() returns the flights that the fix closes."""

    open: dict | None = None
    last: list | None = None  # time, lat, lon, speed, climb, alt, whether a transponder's
    quiet: list[bool] = field(default_factory=list)
    number: int = 0
    orphan: dict | None = None  # an open flight of a table, not of this tracker

    def feed(
        self, t: float, lat: float, lon: float, alt: float | None = None, agl: float | None = None, speed: float | None = None, climb: float | None = None,
        on_ground: float | None = None, callsign: str | None = None,
    ) -> list[dict]:
        closed: list[dict] = []
        if self.last is not None and int(abs(t - self.last[0])) < 1:
            return closed
        moved = metres(self.last[1:3], (lat, lon)) if self.last else 0.0
        on = is_active(speed, agl, alt) if on_ground is None else not on_ground
        said, this = known(callsign), [t, lat, lon, speed, climb, alt, on_ground is not None]
        changed = bool(self.open and on and said and self.open["callsign"] and said != self.open["callsign"])
        if changed:
            closed.append(self.close(landed=t, by=this))
        elif self.open and gap_splits(t - self.last[0], moved, self.last[3]):
            closed.append(self.close(timed_out=True))
        if self.open is None and self.last is not None and t - self.last[0] > STALE:
            self.quiet = []
        if self.open is None and on:
            closed += self._begin(t, agl, on_ground, said, changed)
            moved = 0.0
        self.quiet = [*self.quiet, not on][-QUIET_FIXES:]
        if f := self.open:
            f["n_fixes"] += 1
            f["metres"] += moved
            f["last_fix"] = t
            if on and not f["callsign"]:
                f["callsign"] = said
            for name, x, best in (("min_alt", alt, min), ("max_alt", alt, max), ("max_agl", agl, max)):
                if x is not None:
                    f[name] = x if f[name] is None else best(f[name], x)
            low = (agl is None or agl < ACTIVE_AGL) and len(self.quiet) == QUIET_FIXES and all(self.quiet)
            if (low and on_ground is None) or on_ground:
                closed.append(self.close(landed=t, by=this))
        self.last = this
        return closed

    def _begin(self, t: float, agl: float | None, on_ground: float | None, said: str | None, changed: bool) -> list[dict]:
        """Carries an orphan on, or opens a flight; returns the orphan if it ends."""
        ended = []
        if f := self.orphan:
            self.orphan = None
            if 0 <= t - f["last_fix"] <= ADOPTED and not (said and f["callsign"] and said != f["callsign"]):
                self.open, self.number = f, max(self.number, f["flight_no"])
                return ended
            ended = [f | self._completed(f, t)]
            self.number = max(self.number, f["flight_no"])
        before = self.quiet[-FIXES_BEFORE_TAKEOFF:]
        if on_ground is not None:
            takeoff = bool(before) and before[-1]
        else:
            takeoff = all(before) if len(before) == FIXES_BEFORE_TAKEOFF else agl is not None and agl < 100
        self.number += 1
        self.open = {"flight_no": self.number, "first_fix": t, "takeoff": t if takeoff or changed else None, "metres": 0.0, "n_fixes": 0, "min_alt": None, "max_alt": None, "max_agl": None, "callsign": said}
        return ended

    @staticmethod
    def _completed(f: dict, t: float) -> dict:
        """A young orphan with another callsign ends at the fix that says so, an old one was over at its last fix."""
        done = t if t - f["last_fix"] <= ADOPTED else f["last_fix"]
        landed = done if f["takeoff"] is None else max(done, f["takeoff"] + 1)
        return {"landed": landed, "timed_out": False, "phase": None, "spurious": []}

    def close(self, landed: float | None = None, timed_out: bool = False, by: list | None = None) -> dict:
        """by: the fix that ends the flight, the last one if none is given."""
        f = self.open | {"landed": landed, "timed_out": timed_out, "phase": phase_of(*self.last[4:6]) if timed_out else None}
        f["spurious"] = spurious_reasons(f, (by or self.last)[6])
        self.open = None
        return f

    def end(self, newest: float) -> list[dict]:
        """Closes or shows what is open at the newest event time of all aircraft."""
        if not self.open:
            return []
        if self.last is not None and newest - self.last[0] > TIMEOUT:
            return [self.close(timed_out=True)]
        return [self.open | {"landed": None, "timed_out": False, "phase": None, "spurious": []}]

    def to_json(self) -> str:
        return json.dumps([self.open, self.last, self.quiet, self.number, self.orphan])

    @classmethod
    def from_json(cls, state: str | None) -> Tracker:
        return cls(*json.loads(state)) if state else cls()


COLUMNS = ["flight_no", "first_fix", "last_fix", "takeoff", "landed", "timed_out", "phase", "n_fixes", "metres", "min_alt", "max_alt", "max_agl", "spurious", "callsign"]
#: Columns of fixes; the last two may be missing.
INPUT = ["received_at", "lat", "lon", "alt_ft", "agl_ft", "speed_kt", "climb_fpm"]
MAYBE = {"on_ground": "double", "callsign": "string"}
_KINDS = dict(zip(COLUMNS, [pa.int64()] * 5 + [pa.bool_(), pa.string(), pa.int64()] + [pa.float64()] * 4 + [pa.list_(pa.string()), pa.string()], strict=True))
_WHOLE = ("first_fix", "last_fix", "takeoff", "landed")


def columns(flights: list[tuple[object, dict]]) -> dict[str, list]:
    """Flights with their aircraft by column."""
    whole = lambda c, x: int(x) if c in _WHOLE and x is not None else x
    return {"aircraft_id": [a for a, _ in flights]} | {c: [whole(c, f[c]) for _, f in flights] for c in COLUMNS}


def frame(aircraft: object, flights: list[dict]) -> pd.DataFrame:
    out = pd.DataFrame(columns([(aircraft, f) for f in flights]))
    kinds = {"int64": "Int64", "double": "float64", "bool": "bool"}
    return out.astype({c: kinds.get(str(kind), "object") for c, kind in _KINDS.items()})


def prepared(fixes: DataFrame, *more: str) -> DataFrame:
    """aircraft_id, fix_id, seconds as a double, and the figures of a fix as doubles; more: further columns to keep."""
    rows = fixes.filter("aircraft_id IS NOT NULL")
    maybe = [(F.col(c) if c in fixes.columns else F.lit(None)).cast(kind).alias(c) for c, kind in MAYBE.items()]
    figures = [F.col(c).cast("double").alias(c) for c in INPUT[1:]]
    return rows.select("aircraft_id", "fix_id", (F.unix_micros("received_at") / 1e6).alias("t"), *figures, *maybe, *more)


def _tracked(fixes: DataFrame, before: DataFrame | None) -> DataFrame:
    """Rows of prepared() by aircraft and time, the state that is handed on first."""
    rows = prepared(fixes).withColumn("state", F.lit(None).cast("string"))
    if before is not None:
        rows = rows.unionByName(before.select("aircraft_id", "state"), allowMissingColumns=True)
    return rows.repartition("aircraft_id").sortWithinPartitions("aircraft_id", F.col("state").isNull(), "t", "fix_id")


def _runs(batches: Iterable[pa.RecordBatch]) -> Iterator[list[tuple[object, Tracker, list[dict], bool]]]:
    """For each batch: aircraft, its tracker, the flights that its rows close, and whether the aircraft's rows are over."""
    key, tracker = None, None
    for batch in batches:
        done = []
        at = {c: batch.column(c).to_pylist() for c in batch.schema.names}
        fed = zip(*(at[c] for c in ("aircraft_id", "state", "t", *INPUT[1:], *MAYBE)), strict=True)
        closed: list[dict] = []
        for aircraft, state, *row in fed:
            if tracker is None or aircraft != key:
                if tracker is not None:
                    done.append((key, tracker, closed, True))
                key, tracker, closed = aircraft, Tracker.from_json(state), []
            if state is None:
                closed += tracker.feed(*row)
        if closed:
            done.append((key, tracker, closed, False))
        yield done
    if tracker is not None:
        yield [(key, tracker, [], True)]


def sessionize(fixes: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """Flights of every aircraft. Each task reads its aircraft one after the other in sorted batches and holds the state of one; no
    history is held, however long. before: (aircraft_id, state), where to go on."""
    newest = fixes.agg(F.max(F.unix_micros("received_at")).alias("m")).first()["m"]
    newest = (newest or 0) / 1e6

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for done in _runs(batches):
            flights = [(a, f) for a, tracker, closed, over in done for f in [*closed, *(tracker.end(newest) if over else [])]]
            made = columns(flights)
            arrays = [pa.array(made["aircraft_id"], pa.int64()), *(pa.array(made[c], kind) for c, kind in _KINDS.items())]
            yield pa.RecordBatch.from_arrays(arrays, names=["aircraft_id", *COLUMNS])

    return _tracked(fixes, before).mapInArrow(run, SCHEMA)


def states(fixes: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """(aircraft_id, state) after the last fix of each aircraft; those with nothing open whose last fix is older than ``STALE`` are left out."""
    newest = fixes.agg(F.max(F.unix_micros("received_at")).alias("m")).first()["m"]
    newest = (newest or 0) / 1e6

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for done in _runs(batches):
            kept = [(a, t.to_json()) for a, t, _, over in done if over and (t.open or t.orphan or (t.last and newest - t.last[0] <= STALE))]
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in kept], pa.int64()), pa.array([x for _, x in kept], pa.string())], names=["aircraft_id", "state"])

    return _tracked(fixes, before).mapInArrow(run, STATE)


def orphans(flights: DataFrame) -> DataFrame:
    """(aircraft_id, state) of open flights with the columns of sessionize(): the newest of each aircraft."""
    f = flights.filter("aircraft_id IS NOT NULL AND landed IS NULL AND NOT timed_out")
    kept = f.groupBy("aircraft_id").agg(F.max_by(F.struct(*COLUMNS), F.struct("last_fix", "flight_no")).alias("f"))
    wanted = ["flight_no", "first_fix", "last_fix", "takeoff", "metres", "n_fixes", "min_alt", "max_alt", "max_agl", "callsign"]
    held = F.to_json(F.struct(*(F.col(f"f.{c}").alias(c) for c in wanted)), {"ignoreNullFields": "false"})
    return kept.select("aircraft_id", F.concat(F.lit("[null, null, [], 0, "), held, F.lit("]")).alias("state"))
