"""Receiver health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_MINUTES = 1440


def cooldown_minutes(base: Column, n_sent: Column) -> Column:
    """Doubles with each alert, a day at most; 0 before the first."""
    return F.when(n_sent > 0, F.least(base * F.pow(F.lit(2.0), n_sent - 1), F.lit(float(MOST_MINUTES)))).otherwise(0.0)


def alerts(
    latest: DataFrame, as_of: Column, down_minutes: float = 30, most_cpu: float = 0.9, most_temperature: float = 70.0
) -> DataFrame:
    """One row per receiver that is down, or up with a high load or temperature.

    latest: receiver_id, received_at, cpu_load, cpu_temperature.
    """
    silent = (F.unix_micros(as_of) - F.unix_micros("received_at")) / 6e7
    down = silent > down_minutes
    kinds = F.filter(
        F.array(
            F.when(down, "down"),
            F.when(~down & (F.col("cpu_load") > most_cpu), "cpu"),
            F.when(~down & (F.col("cpu_temperature") > most_temperature), "temperature"),
        ),
        F.isnotnull,
    )
    return latest.select("receiver_id", F.explode(kinds).alias("alert"))


def checked(subscriptions: DataFrame, latest: DataFrame, as_of: Column) -> DataFrame:
    """One round of checks; the subscriptions with their state after it, and what the round did (``outcome``, ``condition``).

    subscriptions: alert_id, receiver_id, on_down, on_cpu, on_temperature (null: off), down_minutes, most_cpu, most_temperature, base_minutes,
    consecutive (null: 0), last_alerted_at, last_condition. latest: one row for each receiver, as for ``alerts``; a receiver that was never heard
    (null received_at) is down. The first condition of down, cpu, temperature counts, and load and temperature only of a receiver that is not down.

    outcome: ``send`` (one alert more, now, for the condition), ``wait`` (the cooldown has not passed), ``clear`` (nothing is wrong any more: the
    count begins again, the time of the last alert stays), ``quiet`` (nothing was or is wrong), ``unknown`` (no such receiver; nothing changes).
    """
    names = subscriptions.columns
    known = latest.select(F.col("receiver_id"), F.struct("received_at", "cpu_load", "cpu_temperature").alias("__s"))
    s = F.col("__s")
    silent = (F.unix_micros(as_of) - F.unix_micros(s["received_at"])) / 6e7
    down = s["received_at"].isNull() | F.coalesce(silent > F.col("down_minutes"), F.lit(False))
    condition = (
        F.when(F.col("on_down") & down, "down")
        .when(~down & F.col("on_cpu") & (s["cpu_load"] > F.col("most_cpu")), "cpu")
        .when(~down & F.col("on_temperature") & (s["cpu_temperature"] > F.col("most_temperature")), "temperature")
    )
    sent = F.coalesce("consecutive", F.lit(0))
    due = F.unix_micros("last_alerted_at") + cooldown_minutes(F.col("base_minutes"), sent) * 6e7
    outcome = (
        F.when(s.isNull(), "unknown")
        .when(condition.isNull(), F.when(sent > 0, "clear").otherwise("quiet"))
        .when(F.unix_micros(as_of) < due, "wait")
        .otherwise("send")
    )
    judged = subscriptions.join(known, "receiver_id", "left").withColumn("condition", F.when(s.isNotNull(), condition)).withColumn("outcome", outcome)
    sends, clears = F.col("outcome") == "send", F.col("outcome") == "clear"
    after = {
        "consecutive": F.when(sends, sent + 1).when(clears, 0).otherwise(sent),
        "last_alerted_at": F.when(sends, as_of).otherwise(F.col("last_alerted_at")),
        "last_condition": F.when(sends, F.col("condition")).when(~clears, F.col("last_condition")),
    }
    return judged.select(*(after[c].alias(c) if c in after else F.col(c) for c in names), "outcome", "condition")
