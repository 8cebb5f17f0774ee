"""Transponder messages put together to fixes (T3, T4), as windows over an aircraft's messages in order of (received_at, message_id).

Messages: aircraft_id, message_id, received_at, lat, lon, altitude_ft, speed_kt, track, climb_fpm, callsign, squawk, on_ground; a null is a
field that the message does not have. A message with an altitude and no position only brings the cached position up to date.

With ``state_s`` all that is known of an aircraft is forgotten after a silence of more seconds: the windows are then those of one stretch of messages, however long
its history is. ``Kept`` is the same for one aircraft and one message after the other, for the streaming job.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

TTL_S = 10


def _position() -> Column:
    return F.col("lat").isNotNull() & F.col("lon").isNotNull()


def _velocity() -> Column:
    return F.coalesce("speed_kt", "track", "climb_fpm").isNotNull()


def _only_ground() -> Column:
    others = _position() | _velocity() | F.coalesce("callsign", "squawk").isNotNull() | F.col("altitude_ft").isNotNull()
    return F.col("on_ground").isNotNull() & ~others


def _in_order(*more: str):  # noqa: ANN202
    return W.partitionBy("aircraft_id", *more).orderBy("received_at", "message_id")


def with_stretches(messages: DataFrame, state_s: float) -> DataFrame:
    """A running number ``stretch`` of each aircraft, that grows where it was silent for more than state_s seconds."""
    since = (F.unix_micros("received_at") - F.lag(F.unix_micros("received_at")).over(_in_order())) / 1e6
    return messages.withColumn("stretch", F.sum(F.when(since > state_s, 1).otherwise(0)).over(_in_order()))


def changes(messages: DataFrame, *more: str) -> DataFrame:
    """T4: without messages that only repeat the known on_ground. more: columns that part an aircraft's messages."""
    before = F.last("on_ground", ignorenulls=True).over(_in_order(*more).rowsBetween(W.unboundedPreceding, -1))
    kept = messages.withColumn("__before", before)
    return kept.filter(~(_only_ground() & F.coalesce(F.col("__before") == F.col("on_ground"), F.lit(False)))).drop("__before")


def trigger() -> Column:
    """What a message brings, the first that applies; one with nothing but on_ground counts as a position."""
    return (
        F.when(_position(), "position").when(_velocity(), "velocity").when(F.col("callsign").isNotNull(), "identification")
        .when(F.col("squawk").isNotNull(), "squawk").when(F.col("altitude_ft").isNotNull(), "altitude").otherwise("position")
    )


def accumulated(messages: DataFrame, ttl_s: int = TTL_S, state_s: float | None = None) -> DataFrame:
    """A fix for each message after which a position of at most ttl_s whole seconds and on_ground are known."""
    more = () if state_s is None else ("stretch",)
    if more:
        messages = with_stretches(messages, state_s)
    so_far = _in_order(*more).rowsBetween(W.unboundedPreceding, 0)
    last = lambda c: F.last(c, ignorenulls=True).over(so_far)
    whole = changes(messages, *more)
    carried = whole.select(
        "aircraft_id",
        "message_id",
        "received_at",
        trigger().alias("trigger"),
        last(F.when(_position(), F.struct("lat", "lon", F.col("received_at").alias("at")))).alias("p"),
        last(F.when(_position() | F.col("altitude_ft").isNotNull(), F.struct("altitude_ft"))).alias("a"),
        last(F.when(_velocity(), F.struct("speed_kt", "track", "climb_fpm", F.col("received_at").alias("at")))).alias("v"),
        last("callsign").alias("callsign"),
        last("squawk").alias("squawk"),
        last("on_ground").alias("on_ground"),
    )
    age = lambda x: (F.unix_micros("received_at") - F.unix_micros(f"{x}.at")) / 1e6
    fresh = F.floor(age("v")) <= ttl_s
    return carried.filter(F.col("p").isNotNull() & (F.floor(age("p")) <= ttl_s) & F.col("on_ground").isNotNull()).select(
        "aircraft_id",
        "message_id",
        "received_at",
        "trigger",
        "p.lat",
        "p.lon",
        F.col("a.altitude_ft").alias("altitude_ft"),
        *(F.when(fresh, F.col(f"v.{c}")).alias(c) for c in ("speed_kt", "track", "climb_fpm")),
        "callsign",
        "squawk",
        "on_ground",
        F.round(age("p") * 1000).cast("long").alias("position_age_ms"),
    )


FIELDS = {
    "lat": "double", "lon": "double", "altitude_ft": "double", "speed_kt": "double", "track": "double", "climb_fpm": "double", "callsign": "string", "squawk": "string", "on_ground": "boolean",
}
SCHEMA = "aircraft_id long, message_id long, received_at timestamp, trigger string, " + ", ".join(f"{c} {kind}" for c, kind in FIELDS.items()) + ", position_age_ms long"


@dataclass
class Kept:
    """What is known of one aircraft: position, altitude and velocity with their seconds, and the rest."""

    position: list | None = None  # lat, lon, seconds
    altitude: list | None = None
    velocity: list | None = None  # speed, track, climb, seconds
    callsign: str | None = None
    squawk: str | None = None
    on_ground: bool | None = None
    last: float | None = None

    def feed(self, aircraft: object, t: float, message: int, m: dict, ttl_s: int) -> list[dict]:
        """The fix that the message brings, or none."""
        here, moving = m["lat"] is not None and m["lon"] is not None, any(m[c] is not None for c in ("speed_kt", "track", "climb_fpm"))
        named = {"identification": m["callsign"], "squawk": m["squawk"], "altitude": m["altitude_ft"]}
        self.last = t
        if not here and not moving and all(x is None for x in named.values()) and m["on_ground"] is not None and m["on_ground"] == self.on_ground:
            return []
        if here:
            self.position = [m["lat"], m["lon"], t]
        if here or m["altitude_ft"] is not None:
            self.altitude = [m["altitude_ft"]]
        if moving:
            self.velocity = [m["speed_kt"], m["track"], m["climb_fpm"], t]
        for c in ("callsign", "squawk", "on_ground"):
            if m[c] is not None:
                setattr(self, c, m[c])
        if self.position is None or self.on_ground is None or int(t - self.position[2]) > ttl_s:
            return []
        trigger = "position" if here else "velocity" if moving else next((k for k, x in named.items() if x is not None), "position")
        speed = self.velocity[:3] if self.velocity and int(t - self.velocity[3]) <= ttl_s else [None] * 3
        figures = [*self.position[:2], self.altitude[0] if self.altitude else None, *speed, self.callsign, self.squawk, self.on_ground]
        return [{"aircraft_id": aircraft, "message_id": message, "t": t, "trigger": trigger, **dict(zip(FIELDS, figures, strict=True)), "position_age_ms": round((t - self.position[2]) * 1000)}]

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def from_json(cls, state: str | None) -> Kept:
        return cls(**json.loads(state)) if state else cls()


def columns(fixes: list[dict]) -> dict:
    """Fixes of Kept by column of SCHEMA, as pandas takes them."""
    import pandas as pd

    kinds = {"long": "Int64", "double": "float64", "string": "object", "boolean": "object", "timestamp": "datetime64[us, UTC]"}
    out = {}
    for part in SCHEMA.split(", "):
        name, kind = part.split(" ")
        if name == "received_at":
            out[name] = pd.to_datetime(pd.Series([round(f["t"] * 1e6) for f in fixes], dtype="int64"), unit="us", utc=True)
        else:
            out[name] = pd.Series([f[name] for f in fixes], dtype=kinds[kind])
    return out
