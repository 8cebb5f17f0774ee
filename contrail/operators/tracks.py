"""Windows over the fixes of an aircraft or flight, in order of (received_at, fix_id)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql import WindowSpec

from ..functions.geo import haversine
from ..functions.when import half_up


def by_aircraft() -> WindowSpec:
    return W.partitionBy("aircraft_id").orderBy("received_at", "fix_id")


def active(speed: Column, agl: Column | None = None, altitude: Column | None = None) -> Column:
    """Without any altitude from 80 kt on; else from 25 kt, or 250 ft above ground."""
    speed = F.coalesce(speed, F.lit(0.0))
    if agl is None:
        return speed >= 80
    known = altitude.isNotNull() | agl.isNotNull() if altitude is not None else agl.isNotNull()
    return F.when(known, (speed >= 25) | (F.coalesce(agl, F.lit(0)) >= 250)).otherwise(speed >= 80)


def splits(gap_s: Column, moved_m: Column, previous_speed_kt: Column) -> Column:
    """Over two hours always, up to half an hour never; between, a fast aircraft that moved less than 30 % of what it
    should have, or a slow one."""
    expected = previous_speed_kt * 0.514444 * gap_s
    fast = F.coalesce(previous_speed_kt > 25, F.lit(False))
    return F.when(gap_s > 7200, True).when(gap_s <= 1800, False).when(fast, moved_m < 0.3 * expected).otherwise(True)


def steps(fixes: DataFrame) -> DataFrame:
    """Each fix with seconds and metres since the one before."""
    lag = lambda c: F.lag(c).over(by_aircraft())
    return fixes.withColumns(
        {
            "gap_s": F.coalesce((F.unix_micros("received_at") - F.unix_micros(lag("received_at"))) / 1e6, F.lit(0.0)),
            "step_m": F.coalesce(haversine(lag("lat"), lag("lon"), F.col("lat"), F.col("lon")), F.lit(0.0)),
            "speed_before": lag("speed_kt"),
        }
    )


def path_distances(fixes: DataFrame) -> DataFrame:
    """W9."""
    return steps(fixes).groupBy("aircraft_id").agg(F.count("*").alias("n"), F.round(F.sum("step_m"), 1).alias("metres"))


def with_sessions(fixes: DataFrame) -> DataFrame:
    """T9 as a batch: each fix with its aircraft's running number of sessions."""
    split = splits(F.col("gap_s"), F.col("step_m"), F.col("speed_before")).cast("int")
    return steps(fixes).withColumn("session", F.sum(split).over(by_aircraft().rowsBetween(W.unboundedPreceding, 0)))


def gap_sessions(fixes: DataFrame) -> DataFrame:
    """One row per session."""
    return with_sessions(fixes).groupBy("aircraft_id", "session").agg(
        F.count("*").alias("n_fixes"),
        F.unix_timestamp(F.min("received_at")).alias("first"),
        F.unix_timestamp(F.max("received_at")).alias("last"),
    )


def gaps(fixes: DataFrame, least_s: float = 300.0) -> DataFrame:
    """Pairs of successive fixes so far apart, with the mean climb of the 11 fixes up to it and the 10 after."""
    after = lambda c: F.lead(c).over(by_aircraft())
    out = fixes.select(
        "aircraft_id",
        "fix_id",
        after("fix_id").alias("next_id"),
        ((F.unix_micros(after("received_at")) - F.unix_micros("received_at")) / 1e6).alias("gap_s"),
        F.round(haversine(F.col("lat"), F.col("lon"), after("lat"), after("lon")), 2).alias("metres"),
        F.round(F.avg("climb_fpm").over(by_aircraft().rowsBetween(-10, 0)), 4).alias("climb_before"),
        F.round(F.avg("climb_fpm").over(by_aircraft().rowsBetween(1, 10)), 4).alias("climb_after"),
    )
    return out.filter(F.col("gap_s") >= least_s)


def trailing_climb(fixes: DataFrame, seconds: int = 60, least_s: int = 5) -> DataFrame:
    """Feet a minute between the first and last fix of the trailing time range; null for one fix or a short span."""
    w = W.partitionBy("aircraft_id").orderBy(F.unix_seconds("received_at")).rangeBetween(-seconds, 0)
    ends = F.struct(F.min(F.struct("received_at", "fix_id", "alt_ft")).over(w).alias("a"), F.max(F.struct("received_at", "fix_id", "alt_ft")).over(w).alias("b"))
    span = F.unix_seconds("e.b.received_at") - F.unix_seconds("e.a.received_at")
    rate = F.when(span >= least_s, half_up((F.col("e.b.alt_ft") - F.col("e.a.alt_ft")) * 60.0 / span))
    return fixes.withColumn("e", ends).select("fix_id", "aircraft_id", rate.alias("climb"))


def consecutive_inactive(fixes: DataFrame, n: int = 5) -> DataFrame:
    """Whether this and the n - 1 fixes before are all inactive."""
    quiet = (~active(F.col("speed_kt"), F.col("agl_ft"), F.col("alt_ft"))).cast("int")
    marked = fixes.select("fix_id", "aircraft_id", "received_at", quiet.alias("q"))
    landed = F.coalesce(F.sum("q").over(by_aircraft().rowsBetween(1 - n, 0)) == n, F.lit(False))
    return marked.select("fix_id", "aircraft_id", landed.alias("landed"))


def latest(df: DataFrame, key: str, order: str, *columns: str) -> DataFrame:
    """The newest row's columns per key, by map-side maxima."""
    newest = df.groupBy(key).agg(F.max(F.struct(order, *columns)).alias("m"))
    return newest.select(key, F.col(f"m.{order}").alias(order), *(F.col(f"m.{c}").alias(c) for c in columns))


def as_of_join(left: DataFrame, right: DataFrame, key: str, time: str, tie: str, value: str) -> DataFrame:
    """Each left row with the value of the last row of right at or before it, null or not, by one sorted union and no range join."""
    both = left.select(key, time, tie, F.lit(1).alias("side"), F.lit(None).cast(right.schema[value].dataType).alias(value)).unionByName(
        right.select(key, time, F.lit(None).cast(left.schema[tie].dataType).alias(tie), F.lit(0).alias("side"), value)
    )
    w = W.partitionBy(key).orderBy(time, "side").rowsBetween(W.unboundedPreceding, 0)
    newest = F.last(F.when(F.col("side") == 0, F.struct(value)), ignorenulls=True).over(w)
    return both.withColumn("found", newest[value]).filter("side = 1").select(key, tie, "found")


def fixes_of_flights(fixes: DataFrame, flights: DataFrame, most_hours: int = 7) -> DataFrame:
    """Fixes between a flight's first and last time; flights are cut into hours, so the join is on (aircraft, hour)."""
    hour = lambda c: F.floor(F.unix_timestamp(c) / 3600)
    spans = flights.select("flight_id", "aircraft_id", "first", "last", F.explode(F.sequence(hour("first"), hour("last"))).alias("hour"))
    return fixes.withColumn("hour", hour("received_at")).join(spans, ["aircraft_id", "hour"]).filter(F.col("received_at").between(F.col("first"), F.col("last")))


def neighbours_in_time(flights: DataFrame) -> DataFrame:
    """Previous and next flight of the same aircraft."""
    w = W.partitionBy("aircraft_id").orderBy("takeoff", "flight_id")
    return flights.select("flight_id", "aircraft_id", F.lag("flight_id").over(w).alias("previous"), F.lead("flight_id").over(w).alias("next"))


def superseded(flights: DataFrame) -> DataFrame:
    """Open flights of an aircraft that are not its newest, with the time at which to close them."""
    w = W.partitionBy("aircraft_id").orderBy(F.desc("takeoff"), F.desc("flight_id"))
    return (
        flights.filter("landing IS NULL").withColumn("rn", F.row_number().over(w)).filter("rn > 1")
        .select("flight_id", "aircraft_id", F.unix_timestamp(F.greatest("takeoff", F.col("takeoff") + F.expr("INTERVAL 1 SECOND"))).alias("landed"))
    )
