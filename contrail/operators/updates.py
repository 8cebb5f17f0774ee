"""Updates, deletes and backfills as functions of tables: each returns the new state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.codes import device_id


def update_where(old: DataFrame, new: DataFrame, key: str, allowed: Column) -> DataFrame:
    """Rows for which ``allowed`` holds take the columns that new has, all others stay. A key is unique in new."""
    changed = [c for c in new.columns if c != key]
    given = new.select(F.col(key), F.lit(True).alias("__given"), *(F.col(c).alias(f"__{c}") for c in changed))
    hit = F.coalesce(F.col("__given"), F.lit(False)) & F.coalesce(allowed, F.lit(False))
    out = [F.when(hit, F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in changed else F.col(c) for c in old.columns]
    return old.join(given, key, "left").select(*out)


def timed_out(flights: DataFrame, as_of: Column, after_s: int, add_s: int = 3600) -> DataFrame:
    """Open flights whose last fix is older than so many seconds end as timed out, add_s after that fix."""
    old = F.col("landing").isNull() & F.col("timed_out_at").isNull() & (F.unix_micros("last_fix") < F.unix_micros(as_of) - after_s * 1_000_000)
    return flights.withColumn("timed_out_at", F.when(old, F.col("last_fix") + F.make_dt_interval(secs=F.lit(add_s))).otherwise(F.col("timed_out_at")))


def soft_deleted(rows: DataFrame, gone: DataFrame, key: str, at: Column) -> DataFrame:
    """Rows named by gone get ``deleted_at``, unless they have one."""
    marks = gone.select(key).distinct().withColumn("__gone", F.lit(True))
    marked = F.coalesce("deleted_at", F.when(F.col("__gone"), at))
    return rows.join(marks, key, "left").withColumn("deleted_at", marked).drop("__gone").select(*rows.columns)


def visible(rows: DataFrame) -> DataFrame:
    """Rows that are not soft-deleted."""
    return rows.filter("deleted_at IS NULL")


def deleted(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """Without the rows named by gone."""
    return rows.join(gone.select(key).distinct(), key, "left_anti").select(*rows.columns)


def backfilled(rows: DataFrame, values: dict[str, Column]) -> DataFrame:
    """X11: nulls and blank strings take the given value."""
    kinds = dict(rows.dtypes)
    blank = lambda c: F.nullif(F.trim(F.col(c)), F.lit("")) if kinds[c] == "string" else F.col(c)
    return rows.withColumns({c: F.coalesce(blank(c), v) for c, v in values.items()})


def repaired_addresses(aircraft: DataFrame, messages: DataFrame) -> DataFrame:
    """Aircraft (aircraft_id, address, address_type) take type and address from the raw id of their newest message.

    messages: aircraft_id, received_at, message_id, raw_id. Aircraft without a readable id stay as they are.
    """
    newest = messages.groupBy("aircraft_id").agg(F.max_by("raw_id", F.struct("received_at", "message_id")).alias("raw_id"))
    found = newest.select("aircraft_id", device_id(F.col("raw_id")).alias("d"))
    out = aircraft.join(found, "aircraft_id", "left")
    return out.withColumns({"address": F.coalesce(F.col("d.address").cast("long"), "address"), "address_type": F.coalesce("d.address_type", "address_type")}).drop("d")


def canonical_ids(rows: DataFrame, key: str, same: list[str]) -> DataFrame:
    """Each row with the first key among the rows whose columns are null-safely equal."""
    groups = rows.groupBy(*same).agg(F.min(key).alias("canonical_id"))
    met = rows.alias("a").join(groups.alias("b"), [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in same])
    return met.select(F.col(f"a.{key}").alias(key), "canonical_id")


def filtered(df: DataFrame, *conditions: Column | None) -> DataFrame:
    """All given conditions; None stands for one that was not asked for."""
    for c in conditions:
        if c is not None:
            df = df.filter(c)
    return df


def altitudes_overlap(low: Column, high: Column, least: float | None, most: float | None) -> Column | None:
    """Whether [low, high] touches the asked range; None if no bound was asked for."""
    out = None
    if least is not None:
        out = high >= least
    if most is not None:
        out = low <= most if out is None else out & (low <= most)
    return out
