"""The six rollups of flights kept up to date by a feed of changes, in any order, each change once.

A rollup is held as a *state*: whole numbers and exact decimals by key that add up, so states of parts and of changes merge by addition, and what a change takes back is
subtracted. Distinct counts and newest times are held as counts by value: a value counts while its count is above zero, so they can fall again. ``shown``
turns a state into the rows of the batch rollup of the same name in ``rollups``.

A feed has batch_id, seq, and the structs ``before`` and ``after`` of a flight: an insert has no before, a delete no after, an update both.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.when import DURATION_BUCKETS, duration_bucket, half_up, within_days
from .rollups import cross_country, duration


def pending(feed: DataFrame, applied: DataFrame) -> DataFrame:
    """Changes of batches that are not applied yet, each once however often the feed was delivered. applied: batch_id, a number for each batch.

    Few batches hold all changes, so these are dealt by their own keys before they are sorted, and the numbers of batches go to every task.
    """
    done = F.broadcast(applied.select("batch_id").distinct())
    waiting = feed.join(done, "batch_id", "left_anti").repartition("batch_id", "seq")
    return waiting.dropDuplicates(["batch_id", "seq"])


def signed(changes: DataFrame) -> DataFrame:
    """Rows of flights with ``s``: +1 for what a change brings, -1 for what it takes back."""
    both = F.array(F.struct(F.lit(-1).alias("s"), F.col("before").alias("f")), F.struct(F.lit(1).alias("s"), F.col("after").alias("f")))
    return changes.select(F.explode(both).alias("e")).filter("e.f IS NOT NULL").select("e.s", "e.f.*")


def as_inserted(flights: DataFrame) -> DataFrame:
    return flights.withColumn("s", F.lit(1))


def _day(c: str) -> Column:
    return F.to_date(c).cast("string").alias("day")


def _sums() -> list[Column]:
    s = F.col("s").cast("long")
    metres = F.coalesce(F.col("distance_m"), F.lit(0)).cast("decimal(28,6)")
    return [
        F.sum(s).alias("n"),
        F.sum(duration() * s).alias("seconds"),
        F.sum(metres * s).alias("metres"),
        F.sum(F.when(F.col("towed"), s).otherwise(0)).alias("n_towed"),
        F.sum(F.when(cross_country(), s).otherwise(0)).alias("n_cross_country"),
    ]


@dataclass(frozen=True)
class Rollup:
    keys: tuple[str, ...]
    #: Signed flights to the state.
    state: Callable[[DataFrame], DataFrame]
    #: The state, and "now" where it matters, to the rows of the batch rollup.
    shown: Callable[..., DataFrame]

    def merged(self, *states: DataFrame) -> DataFrame:
        """The sum of states; keys at which nothing is left are dropped."""
        whole = states[0]
        for more in states[1:]:
            whole = whole.unionByName(more)
        values = [c for c in whole.columns if c not in self.keys]
        out = whole.groupBy(*self.keys).agg(*(F.sum(c).alias(c) for c in values))
        return out.filter(" OR ".join(f"`{c}` <> 0" for c in values))


def _daily(f: DataFrame) -> DataFrame:
    return f.filter("takeoff IS NOT NULL").groupBy(_day("takeoff")).agg(*_sums())


def _mean() -> Column:
    return half_up(F.col("seconds") / F.col("n")).alias("avg_seconds")


def _daily_shown(state: DataFrame) -> DataFrame:
    return state.filter("n > 0").select(
        "day", F.col("n").alias("n_flights"), F.col("seconds").alias("total_seconds"), _mean(),
        F.round(F.col("metres").cast("double"), 2).alias("total_m"), "n_towed", "n_cross_country",
    )


def _hourly(f: DataFrame) -> DataFrame:
    members = F.array(
        F.struct(F.lit("flight").alias("kind"), F.lit(0).cast("long").alias("member")),
        F.struct(F.lit("aircraft").alias("kind"), F.col("aircraft_id").alias("member")),
        F.struct(F.lit("club").alias("kind"), F.col("club_id").alias("member")),
    )
    rows = f.select(F.unix_timestamp(F.date_trunc("hour", "takeoff")).alias("hour"), F.col("s").cast("long").alias("s"), F.explode(members).alias("m"))
    return rows.filter("m.member IS NOT NULL").groupBy("hour", F.col("m.kind").alias("kind"), F.col("m.member").alias("member")).agg(F.sum("s").alias("n"))


def _hourly_shown(state: DataFrame) -> DataFrame:
    kind = lambda k: F.count_if((F.col("kind") == k) & (F.col("n") > 0))
    flights = F.sum(F.when(F.col("kind") == "flight", F.col("n")).otherwise(0))
    return state.groupBy("hour").agg(flights.alias("n_flights"), kind("aircraft").alias("n_aircraft"), kind("club").alias("n_clubs")).filter("n_flights > 0")


def _histogram(f: DataFrame) -> DataFrame:
    return f.filter("landing IS NOT NULL").groupBy(duration_bucket(duration()).alias("bucket")).agg(F.sum(F.col("s").cast("long")).alias("n"))


def _histogram_shown(state: DataFrame) -> DataFrame:
    rows = [(i, label) for i, (_, label) in enumerate(DURATION_BUCKETS)]
    every = state.sparkSession.createDataFrame(rows, "position int, bucket string")
    return every.join(state, "bucket", "left").select("position", "bucket", F.coalesce("n", F.lit(0)).alias("n_flights"))


def _aircraft(f: DataFrame) -> DataFrame:
    return f.filter("takeoff IS NOT NULL AND aircraft_id IS NOT NULL").groupBy("aircraft_id", "takeoff").agg(*_sums())


def _aircraft_shown(state: DataFrame, as_of: Column) -> DataFrame:
    within = lambda days: F.sum(F.when(within_days(F.col("takeoff"), as_of, days), F.col("n")).otherwise(0))
    whole = state.groupBy("aircraft_id").agg(
        F.sum("n").alias("n"), within(30).alias("n_30d"), within(7).alias("n_7d"), F.unix_timestamp(F.max(F.when(F.col("n") > 0, F.col("takeoff")))).alias("last_takeoff"),
        F.sum("seconds").alias("seconds"), F.sum("metres").alias("metres"),
    )
    return whole.filter("n > 0").select("aircraft_id", F.col("n").alias("n_flights"), "n_30d", "n_7d", "last_takeoff", _mean(), F.round(F.col("metres").cast("double"), 2).alias("total_m"))


def _club(f: DataFrame) -> DataFrame:
    return f.filter("club_id IS NOT NULL").groupBy("club_id", _day("takeoff"), "aircraft_id").agg(*_sums())


def _club_shown(state: DataFrame) -> DataFrame:
    return state.groupBy("club_id", "day").agg(
        F.sum("n").alias("n_flights"), F.count_if((F.col("n") > 0) & F.col("aircraft_id").isNotNull()).alias("n_aircraft"),
        F.sum("seconds").alias("airtime_seconds"), F.sum("n_towed").alias("n_tows"),
    ).filter("n_flights > 0")


def _airport(f: DataFrame) -> DataFrame:
    end = lambda slot, at, out: F.struct(F.col(slot).alias("slot"), F.to_date(at).alias("d"), F.lit(out).cast("long").alias("out"))
    rows = f.select(F.col("s").cast("long").alias("s"), F.explode(F.array(end("dep", "takeoff", 1), end("arr", "landing", 0))).alias("e"))
    return rows.filter("e.slot IS NOT NULL AND e.d IS NOT NULL").groupBy(F.col("e.slot").alias("slot"), F.col("e.d").cast("string").alias("day")).agg(
        F.sum(F.col("s") * F.col("e.out")).alias("departures"), F.sum(F.col("s") * (1 - F.col("e.out"))).alias("arrivals")
    )


ROLLUPS = {
    "daily": Rollup(("day",), _daily, _daily_shown),
    "hourly": Rollup(("hour", "kind", "member"), _hourly, _hourly_shown),
    "histogram": Rollup(("bucket",), _histogram, _histogram_shown),
    "aircraft": Rollup(("aircraft_id", "takeoff"), _aircraft, _aircraft_shown),
    "club": Rollup(("club_id", "day", "aircraft_id"), _club, _club_shown),
    "airport": Rollup(("slot", "day"), _airport, lambda state: state),
}
