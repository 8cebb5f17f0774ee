"""Batch rollups over flights and fixes. All take DataFrames and return DataFrames; "now" is a parameter.

Sums of doubles are rounded where they leave, so results do not depend on the order of addition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.cells import cell_id
from ..functions.when import DURATION_BUCKETS, duration_bucket, flight_seconds, half_up, within_days


def cross_country() -> Column:
    return F.col("arr").isNotNull() & ~F.col("dep").eqNullSafe(F.col("arr"))


def duration() -> Column:
    return flight_seconds(F.col("takeoff"), F.col("landing"))


def total(x: Column) -> Column:
    return F.coalesce(F.sum(x), F.lit(0))


def daily_flights(flights: DataFrame) -> DataFrame:
    """A1: per day of takeoff."""
    return (
        flights.filter("takeoff IS NOT NULL")
        .groupBy(F.to_date("takeoff").cast("string").alias("day"))
        .agg(
            F.count("*").alias("n_flights"),
            F.sum(duration()).alias("total_seconds"),
            half_up(F.avg(duration())).alias("avg_seconds"),
            F.round(total(F.col("distance_m")), 2).alias("total_m"),
            F.count_if("towed").alias("n_towed"),
            F.count_if(cross_country()).alias("n_cross_country"),
        )
    )


def hourly_flights(flights: DataFrame) -> DataFrame:
    """A2: per hour of takeoff, with distinct aircraft and clubs."""
    return flights.groupBy(F.unix_timestamp(F.date_trunc("hour", "takeoff")).alias("hour")).agg(
        F.count("*").alias("n_flights"),
        F.count_distinct("aircraft_id").alias("n_aircraft"),
        F.count_distinct("club_id").alias("n_clubs"),
    )


def duration_histogram(flights: DataFrame) -> DataFrame:
    """A3: completed flights by fixed duration bucket; empty buckets stay with 0."""
    rows = [(i, label) for i, (_, label) in enumerate(DURATION_BUCKETS)]
    every = flights.sparkSession.createDataFrame(rows, "position int, bucket string")
    found = flights.filter("landing IS NOT NULL").groupBy(duration_bucket(duration()).alias("bucket")).agg(F.count("*").alias("n"))
    return every.join(found, "bucket", "left").select("position", "bucket", F.coalesce("n", F.lit(0)).alias("n_flights"))


def aircraft_stats(aircraft: DataFrame, flights: DataFrame, as_of: Column) -> DataFrame:
    """A4, A5: every aircraft, also those without flights; z-score of its 30-day count against the active ones."""
    f = flights.filter("takeoff IS NOT NULL").groupBy("aircraft_id").agg(
        F.count("*").alias("n_flights"),
        F.count_if(within_days(F.col("takeoff"), as_of, 30)).alias("n_30d"),
        F.count_if(within_days(F.col("takeoff"), as_of, 7)).alias("n_7d"),
        F.unix_timestamp(F.max("takeoff")).alias("last_takeoff"),
        half_up(F.avg(duration())).alias("avg_seconds"),
        F.round(F.sum("distance_m"), 2).alias("total_m"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    stats = aircraft.select("aircraft_id", "registration").join(f, "aircraft_id", "left").select(
        "aircraft_id", "registration", zero("n_flights"), zero("n_30d"), zero("n_7d"), "last_takeoff", zero("avg_seconds"), zero("total_m")
    )
    spread = stats.filter("n_30d > 0").agg(F.avg("n_30d").alias("mean"), F.stddev_samp("n_30d").alias("sd"))
    z = F.when(F.col("sd") > 0, F.round((F.col("n_30d") - F.col("mean")) / F.col("sd"), 2)).otherwise(0.0)
    return stats.crossJoin(F.broadcast(spread)).withColumn("z_score", z).drop("mean", "sd")  # one row


def club_daily(flights: DataFrame, clubs: DataFrame) -> DataFrame:
    """A6."""
    return (
        flights.join(clubs, "club_id")
        .groupBy("club_id", "name", F.to_date("takeoff").cast("string").alias("day"))
        .agg(
            F.count("*").alias("n_flights"),
            F.count_distinct("aircraft_id").alias("n_aircraft"),
            F.sum(duration()).alias("airtime_seconds"),
            F.count_if("towed").alias("n_tows"),
        )
    )


def airport_daily(flights: DataFrame) -> DataFrame:
    """Departures by day of takeoff and arrivals by day of landing, one shuffle for both."""
    events = F.explode(
        F.array(
            F.struct(F.col("dep").alias("slot"), F.to_date("takeoff").alias("d"), F.lit(1).alias("departures"), F.lit(0).alias("arrivals")),
            F.struct(F.col("arr").alias("slot"), F.to_date("landing").alias("d"), F.lit(0).alias("departures"), F.lit(1).alias("arrivals")),
        )
    )
    return (
        flights.select(events.alias("e"))
        .select("e.*")
        .filter("slot IS NOT NULL AND d IS NOT NULL")
        .groupBy("slot", F.col("d").cast("string").alias("day"))
        .agg(F.sum("departures").alias("departures"), F.sum("arrivals").alias("arrivals"))
    )


def coverage(fixes: DataFrame, resolutions: list[int]) -> DataFrame:
    """Per cell, receiver and half-open UTC day, for each resolution."""
    return (
        fixes.withColumn("resolution", F.explode(F.array(*map(F.lit, resolutions))))
        .groupBy(
            cell_id(F.col("lat"), F.col("lon"), F.col("resolution")).alias("cell"),
            "resolution",
            "receiver_id",
            F.to_date("received_at").cast("string").alias("day"),
        )
        .agg(
            F.count("*").alias("n_fixes"),
            F.unix_timestamp(F.min("received_at")).alias("first_seen"),
            F.unix_timestamp(F.max("received_at")).alias("last_seen"),
            F.min("alt_ft").alias("min_alt"),
            F.max("alt_ft").alias("max_alt"),
            half_up(F.avg("alt_ft")).alias("avg_alt"),
        )
    )


def coverage_by_cell(cov: DataFrame) -> DataFrame:
    """Over receivers and days; avg_alt is the plain mean of means, weighted_alt weights by fixes."""
    return cov.groupBy("cell", "resolution").agg(
        F.sum("n_fixes").alias("n_fixes"),
        F.min("first_seen").alias("first_seen"),
        F.max("last_seen").alias("last_seen"),
        F.min("min_alt").alias("min_alt"),
        F.max("max_alt").alias("max_alt"),
        F.round(F.avg("avg_alt"), 4).alias("avg_alt"),
        F.expr("sum(avg_alt * n_fixes) div sum(n_fixes)").alias("weighted_alt"),
    )


def merged_coverage(old: DataFrame, new: DataFrame) -> DataFrame:
    """Additive merge of two coverage tables by key; the mean is weighted by counts, in whole numbers."""
    return old.unionByName(new).groupBy("cell", "resolution", "receiver_id", "day").agg(
        F.sum("n_fixes").alias("n_fixes"),
        F.min("first_seen").alias("first_seen"),
        F.max("last_seen").alias("last_seen"),
        F.min("min_alt").alias("min_alt"),
        F.max("max_alt").alias("max_alt"),
        F.expr("sum(avg_alt * n_fixes) div sum(n_fixes)").alias("avg_alt"),
    )


def grouped_counts(df: DataFrame, *by: str) -> DataFrame:
    """A12."""
    return df.groupBy(*by).agg(F.count("*").alias("n"))


def grid_clusters(fixes: DataFrame, size: float) -> DataFrame:
    """Fixes by square of this many degrees, with centroid and box."""
    return fixes.groupBy(
        (F.floor(F.col("lat") / size) * size).alias("south"), (F.floor(F.col("lon") / size) * size).alias("west")
    ).agg(
        F.count("*").alias("n"),
        F.round(F.avg("lat"), 6).alias("lat"),
        F.round(F.avg("lon"), 6).alias("lon"),
        F.min("lat").alias("min_lat"),
        F.max("lat").alias("max_lat"),
        F.min("lon").alias("min_lon"),
        F.max("lon").alias("max_lon"),
    )


def flight_boxes(fixes: DataFrame, by: str) -> DataFrame:
    """Bounding box, first and last time by key."""
    return fixes.groupBy(by).agg(
        F.min("lat").alias("min_lat"),
        F.max("lat").alias("max_lat"),
        F.min("lon").alias("min_lon"),
        F.max("lon").alias("max_lon"),
        F.unix_timestamp(F.min("received_at")).alias("created"),
        F.unix_timestamp(F.max("received_at")).alias("last_fix"),
    )


def busiest_airports(daily: DataFrame, airports: DataFrame, first: str, last: str, most: int) -> DataFrame:
    """Top airports by departures and arrivals in a closed range of days."""
    named = airports.groupBy("slot").agg(F.max("ident").alias("ident"))
    return (
        daily.filter(F.col("day").between(first, last))
        .groupBy("slot")
        .agg(F.sum("departures").alias("departures"), F.sum("arrivals").alias("arrivals"))
        .join(F.broadcast(named), "slot")  # as many rows as slots, fixed
        .orderBy((F.col("departures") + F.col("arrivals")).desc(), "slot")
        .limit(most)
    )


def summary(flights: DataFrame, as_of: Column) -> DataFrame:
    """One row, one pass."""
    today = F.to_date("takeoff") == F.to_date(as_of)
    return flights.agg(
        F.count("*").alias("n_flights"),
        F.count_if(today).alias("today"),
        F.count_if(within_days(F.col("takeoff"), as_of, 7)).alias("n_7d"),
        F.count_if(within_days(F.col("takeoff"), as_of, 30)).alias("n_30d"),
        F.coalesce(F.sum(F.when(within_days(F.col("takeoff"), as_of, 30), duration())), F.lit(0)).alias("seconds_30d"),
        F.count_if(F.col("landing").isNull()).alias("in_progress"),
    )


def home_bases(flights: DataFrame, airports: DataFrame, least: int) -> DataFrame:
    """The airport that an aircraft with enough flights uses most; ties to the first ident."""
    named = F.broadcast(airports.groupBy("slot").agg(F.min("ident").alias("ident")))
    ends = flights.select("aircraft_id", F.explode(F.array("dep", "arr")).alias("slot")).filter("slot IS NOT NULL")
    uses = ends.join(named, "slot").groupBy("aircraft_id", "ident").agg(F.count("*").alias("n_uses"))
    often = flights.groupBy("aircraft_id").agg(F.count("*").alias("n_flights")).filter(F.col("n_flights") >= least)
    best = uses.groupBy("aircraft_id").agg(F.min(F.struct((-F.col("n_uses")).alias("m"), "ident")).alias("b"))
    return best.join(often, "aircraft_id").select("aircraft_id", "n_flights", F.col("b.ident").alias("ident"), (-F.col("b.m")).alias("n_uses"))


def update_intervals(fixes: DataFrame, by: str = "receiver_id") -> DataFrame:
    """Mean seconds between successive rows of a key."""
    before = F.lag("received_at").over(W.partitionBy(by).orderBy("received_at", "fix_id"))
    gap = (F.unix_micros("received_at") - F.unix_micros(before)) / 1e6
    return fixes.select(by, gap.alias("gap")).groupBy(by).agg(F.count("*").alias("n"), F.round(F.avg("gap"), 4).alias("avg_gap"))


def missing_dimensions(cov: DataFrame, first: str, last: str, resolutions: list[int]) -> DataFrame:
    """(day, resolution) of the range that coverage does not have yet."""
    needed = cov.sparkSession.range(1).select(
        F.explode(F.sequence(F.to_date(F.lit(first)), F.to_date(F.lit(last)))).alias("day"),
        F.array(*map(F.lit, resolutions)).alias("r"),
    )
    needed = needed.select(F.col("day").cast("string").alias("day"), F.explode("r").alias("resolution"))
    return needed.join(cov.select("day", "resolution").distinct(), ["day", "resolution"], "left_anti")


def rollup_delta(old: DataFrame, new: DataFrame) -> DataFrame:
    """Change of the daily rollup when rows of flights change: + new - old, by day."""
    day = F.to_date("takeoff").cast("string").alias("day")
    signed = new.withColumn("s", F.lit(1)).unionByName(old.withColumn("s", F.lit(-1)))
    return signed.groupBy(day).agg(
        F.sum("s").alias("n_flights"), F.sum(duration() * F.col("s")).alias("total_seconds"), F.sum(F.col("towed").cast("int") * F.col("s")).alias("n_towed")
    )
