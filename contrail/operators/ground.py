"""What happens near the ground: tow releases and their height (T17, A23), and the runway of a takeoff or landing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import angular_difference, runway_ident, true_to_magnetic
from .spatial import nearest_runway_ends
from .tracks import by_aircraft, fixes_of_flights


def tow_releases(fixes: DataFrame, fixes_back: int = 5, climbing: float = 100.0) -> DataFrame:
    """Fixes of tugs that sink faster than ``climbing`` after rising faster than that in the mean of the last fixes with an altitude.

    Rates are between successive fixes at least a second apart, oldest first; so the rule says what it is meant to say.
    """
    known = fixes.filter("alt_ft IS NOT NULL")
    lag = lambda c: F.lag(c).over(by_aircraft())
    seconds = F.floor((F.unix_micros("received_at") - F.unix_micros(lag("received_at"))) / 1e6)
    rate = F.when(seconds > 0, (F.col("alt_ft") - lag("alt_ft")) / seconds * 60)
    mean = F.avg("rate").over(by_aircraft().rowsBetween(2 - fixes_back, 0))
    found = known.withColumn("rate", rate).withColumn("mean_climb", mean).filter((F.col("mean_climb") > climbing) & (F.col("climb_fpm") < -climbing))
    return found.select("aircraft_id", "fix_id", "received_at", "alt_ft", F.round("mean_climb", 3).alias("mean_climb"))


def release_heights(releases: DataFrame, flights: DataFrame, fixes: DataFrame) -> DataFrame:
    """For each flight with a release the altitude of its first release over that of its first fix with an altitude."""
    inside = lambda df: fixes_of_flights(df, flights).groupBy("flight_id").agg(F.min(F.struct("received_at", "fix_id", "alt_ft")).alias("m"))
    low = inside(fixes.filter("alt_ft IS NOT NULL")).select("flight_id", F.col("m.alt_ft").alias("first_ft"))
    high = inside(releases).select("flight_id", F.col("m.fix_id").alias("release_fix"), F.col("m.alt_ft").alias("release_ft"))
    return high.join(low, "flight_id").withColumn("height_ft", F.col("release_ft") - F.col("first_ft"))


def mean_tracks(events: DataFrame, fixes: DataFrame, seconds: int = 20) -> DataFrame:
    """The arithmetic mean track of an event's aircraft so many seconds around it; time goes into the join key in slots."""
    slot = F.floor(F.unix_timestamp("received_at") / seconds)
    a = events.select("event_id", "aircraft_id", F.col("received_at").alias("event_at"), F.explode(F.array(slot - 1, slot, slot + 1)).alias("slot"))
    b = fixes.filter("track IS NOT NULL").select("aircraft_id", "received_at", "track", slot.alias("slot"))
    near = F.abs(F.unix_micros("received_at") - F.unix_micros("event_at")) <= seconds * 1_000_000
    return a.join(b, ["aircraft_id", "slot"]).filter(near).groupBy("event_id").agg(F.avg("track").alias("course"))


def runways_used(
    events: DataFrame, fixes: DataFrame, ends: DataFrame, declination: Column, at_airport: bool = False, seconds: int = 20, metres: float = 2000.0, most: int = 10
) -> DataFrame:
    """(event_id, runway, inferred). events: event_id, aircraft_id, received_at, lat, lon.

    Of the nearest runway ends the direction that differs least from the mean track, always where the airport is known and else under 30
    degrees; without one the magnetic heading names the runway. Events without a track have no row.
    """
    course = mean_tracks(events, fixes, seconds)
    met = nearest_runway_ends(events.join(course, "event_id").select(F.col("event_id").alias("fix_id"), "lat", "lon", F.col("course").alias("track")), ends, metres, most)
    near, far = F.col("runway_heading"), F.pmod(F.col("runway_heading") + 180, F.lit(360.0))
    this, other = angular_difference(F.col("track"), near), angular_difference(F.col("track"), far)
    heading = F.when(this < other, near).otherwise(far)
    best = met.groupBy("fix_id").agg(F.min(F.struct(F.least(this, other).alias("diff"), "rank", heading.alias("heading"))).alias("m"))
    matched = best.filter(F.lit(at_airport) | (F.col("m.diff") < 30)).select(F.col("fix_id").alias("event_id"), runway_ident(F.col("m.heading")).alias("matched"))
    inferred = runway_ident(true_to_magnetic(F.col("course"), declination))
    return events.join(course, "event_id").join(matched, "event_id", "left").select("event_id", F.coalesce("matched", inferred).alias("runway"), F.col("matched").isNull().alias("inferred"))
