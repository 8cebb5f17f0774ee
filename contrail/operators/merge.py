"""Upserts and entity merges as functions of tables: each returns the new state for the caller to write beside the old.

A key must be unique in the target; of several new rows with one key the last by ``order`` counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import keep_old_if_blank


def last_of(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key, the greatest in order; a null order comes first."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max(F.struct(order, *[c for c in rest if c != order])).alias("m")).select(
        key, *(F.col(f"m.{c}").alias(c) for c in rest)
    ).select(*rows.columns)


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """New rows replace old ones."""
    return old.join(new.select(key), key, "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


def upsert_keeping(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Blank or null new values keep the old ones."""
    a, b = old.alias("a"), new.alias("b")
    out = [F.coalesce(f"a.{key}", f"b.{key}").alias(key)]
    for f in old.schema:
        if f.name == key:
            continue
        x, y = F.col(f"b.{f.name}"), F.col(f"a.{f.name}")
        out.append((keep_old_if_blank(x, y) if f.dataType.simpleString() == "string" else F.coalesce(x, y)).alias(f.name))
    return a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full").select(*out).select(*old.columns)


def insert_absent(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows whose null-safe key is not there yet, once each."""
    a, b = new.dropDuplicates(keys).alias("a"), old.select(*keys).alias("b")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    return old.unionByName(a.join(b, same, "left_anti").select(*old.columns))


def merged_duplicates(rows: DataFrame, key: str, same: str) -> DataFrame:
    """(duplicate, target): rows with an equal value of ``same`` go to the smallest key."""
    target = rows.filter(F.col(same).isNotNull()).groupBy(same).agg(F.min(key).alias("target"), F.count("*").alias("n")).filter("n > 1")
    return rows.join(target, same).filter(F.col(key) != F.col("target")).select(F.col(key).alias("duplicate"), "target")


def reassigned(facts: DataFrame, mapping: DataFrame, key: str) -> DataFrame:
    """Facts with their key moved from duplicates to targets."""
    moved = facts.join(mapping, facts[key] == mapping["duplicate"], "left")
    return moved.withColumn(key, F.coalesce("target", key)).select(*facts.columns)


def tow_fee(tows: DataFrame, tiers: DataFrame) -> DataFrame:
    """The lowest tier of the club that reaches the height, else its tier without a limit.

    Tiers: club_id, max_ft (null: no limit), fee; a few per club, so they are grouped into one array per club.
    """
    by_club = tiers.groupBy("club_id").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("max_ft", F.lit(2**31 - 1)).alias("m"), "fee"))).alias("t"))
    fit = F.filter("t", lambda x: F.coalesce(F.col("height_ft"), F.lit(2**31 - 1)) <= x["m"])
    return tows.join(by_club, "club_id", "left").withColumn("fee", F.get(fit, F.lit(0))["fee"]).drop("t")


#: The checks of a flights table; a flight breaks one if the expression is false, not if it is null.
FLIGHT_CHECKS = {
    "landing_near_last_fix": "landing IS NULL OR last_fix >= landing - INTERVAL 10 MINUTES",
    "last_fix_after_created": "last_fix >= created",
    "takeoff_before_landing": "takeoff IS NULL OR landing IS NULL OR takeoff < landing",
    "takeoff_before_tow_release": "takeoff IS NULL OR tow_release IS NULL OR takeoff < tow_release",
    "timed_out_or_landed": "timed_out_at IS NULL OR landing IS NULL",
    "timeout_after_last_fix": "timed_out_at IS NULL OR timed_out_at >= last_fix",
    "timeout_reasonable": "timed_out_at IS NULL OR timed_out_at <= last_fix + INTERVAL 24 HOURS",
    "tow_release_before_landing": "tow_release IS NULL OR landing IS NULL OR tow_release < landing",
}


def with_broken_checks(flights: DataFrame) -> DataFrame:
    """Flights with the names of the checks that they break, in order of name."""
    broken = [F.when(~F.expr(check), F.lit(name)) for name, check in FLIGHT_CHECKS.items()]
    return flights.withColumn("broken", F.filter(F.array(*broken), lambda x: x.isNotNull()))


def repeated_keys(rows: DataFrame, *keys: str) -> DataFrame:
    """Values of a unique key that stand in several rows, with their number; a key with a null is free."""
    whole = rows.filter(" AND ".join(f"`{k}` IS NOT NULL" for k in keys))
    return whole.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


ADDRESSES = ("icao", "flarm", "ogn", "other")


def resolve_pending(aircraft: DataFrame, key: str = "aircraft_id") -> DataFrame:
    """What becomes of rows that wait for a registration (``pending``): key, outcome, target, discarded.

    The target is the row that holds the registration (the smallest of several, never the waiting row itself), or else the smallest waiting row, which then ``take``s it.
    All others ``merge`` into their target, which adopts an address of a kind that it lacks from the first row that brings one; the other addresses are discarded, and
    the array of their kinds says so. The table need not be clean: blank registrations are none.
    """
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    rows = aircraft.withColumns({"registration": blank("registration"), "pending": blank("pending")})
    owners = rows.filter("registration IS NOT NULL").select(F.col("registration").alias("r"), F.col(key).alias("o"), *(F.col(c).alias(f"__{c}") for c in ADDRESSES))
    waiting = rows.filter("pending IS NOT NULL").select(key, "pending", *ADDRESSES)
    held = waiting.join(owners, (F.col("pending") == F.col("r")) & (F.col(key) != F.col("o"))).groupBy(key).agg(F.min_by(F.struct("o", *(f"__{c}" for c in ADDRESSES)), "o").alias("t"))
    met = waiting.join(held, key, "left")
    among = W.partitionBy("pending").orderBy(key)
    before = among.rowsBetween(W.unboundedPreceding, -1)
    target = F.coalesce(F.col("t.o"), F.when(F.row_number().over(among) > 1, F.first(key).over(among)))
    dropped = []
    for c in ADDRESSES:
        taken = F.coalesce(F.col(f"t.__{c}"), F.first(c, ignorenulls=True).over(before))
        dropped.append(F.when(taken.isNotNull() & F.col(c).isNotNull() & (taken != F.col(c)), F.lit(c)))
    found = met.select(key, target.alias("target"), F.filter(F.array(*dropped), lambda x: x.isNotNull()).alias("discarded"))
    return found.select(key, F.when(F.col("target").isNull(), "take").otherwise("merge").alias("outcome"), "target", "discarded")


def apply_resolved(aircraft: DataFrame, resolved: DataFrame, key: str = "aircraft_id") -> DataFrame:
    """The table after resolve_pending: merged rows are gone, and their first addresses stand in targets that lack them. ``reassigned`` moves their facts."""
    r = resolved.select(F.col(key).alias("__k"), "outcome", F.col("target").alias("__t"))
    marked = aircraft.join(r, F.col(key) == F.col("__k"), "left").drop("__k")
    given = marked.filter("outcome = 'merge'").groupBy("__t").agg(*(F.min_by(c, F.when(F.col(c).isNotNull(), F.col(key))).alias(f"__{c}") for c in ADDRESSES))
    kept = marked.filter("outcome IS NULL OR outcome <> 'merge'").drop("__t")
    out = kept.join(given, kept[key] == given["__t"], "left")
    changed = {c: F.coalesce(c, f"__{c}") for c in ADDRESSES}
    took = F.col("outcome").eqNullSafe("take")
    changed |= {"registration": F.when(took, F.trim("pending")).otherwise(F.col("registration")), "pending": F.when(~took, F.col("pending"))}
    return out.select(*(changed[c].alias(c) if c in changed else F.col(c) for c in aircraft.columns))


def violations(flights: DataFrame) -> DataFrame:
    """Number of rows that break each rule; 0 everywhere for a sound table."""
    return flights.agg(
        F.count_if(F.col("landing") < F.col("takeoff")).alias("landing_before_takeoff"),
        F.count_if(F.col("distance_m") < 0).alias("negative_distance"),
        F.count_if(F.col("aircraft_id").isNull()).alias("no_aircraft"),
    )
