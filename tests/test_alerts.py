"""Rounds of receiver checks: conditions, cooldown that doubles up to a day, clearing, and state carried from round to round."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from contrail.operators import receivers

START = datetime(2024, 5, 1)
SUBSCRIPTION = "alert_id int, receiver_id int, on_down boolean, on_cpu boolean, on_temperature boolean, down_minutes int, most_cpu double, most_temperature double, base_minutes int, consecutive int, last_alerted_at timestamp, last_condition string"
LATEST = "receiver_id int, received_at timestamp, cpu_load double, cpu_temperature double"


def at(minutes):
    return F.lit((START + timedelta(minutes=minutes)).isoformat(sep=" ")).cast("timestamp")


def test_conditions(spark):
    heard = START - timedelta(minutes=10)
    latest = spark.createDataFrame([(1, heard, 0.95, 80.0), (2, START - timedelta(minutes=31), 0.95, 80.0), (3, None, None, None), (4, heard, None, 80.0), (5, heard, 0.9, 70.0)], LATEST)
    rows = [(i, i, True, True, True, 30, 0.9, 70.0, 10, 0, None, None) for i in range(1, 7)] + [(7, 2, False, True, True, 30, 0.9, 70.0, 10, 3, None, "cpu"), (8, 1, None, None, None, 30, 0.9, 70.0, 10, None, None, None), (9, None, True, True, True, 30, 0.9, 70.0, 10, 2, None, "down")]
    got = {r.alert_id: (r.outcome, r.condition, r.consecutive, r.last_condition) for r in receivers.checked(spark.createDataFrame(rows, SUBSCRIPTION), latest, at(0)).collect()}
    assert got == {
        1: ("send", "cpu", 1, "cpu"), 2: ("send", "down", 1, "down"), 3: ("send", "down", 1, "down"), 4: ("send", "temperature", 1, "temperature"), 5: ("quiet", None, 0, None),
        6: ("unknown", None, 0, None), 7: ("clear", None, 0, None), 8: ("quiet", None, 0, None), 9: ("unknown", None, 2, "down"),
    }


@pytest.mark.parametrize(("sent", "minutes"), [(1, 30), (2, 60), (3, 120), (6, 960), (7, 1440), (40, 1440)])
def test_cooldown_ends_when_it_has_passed(spark, sent, minutes):
    latest = spark.createDataFrame([(1, None, None, None)], LATEST)
    rows = [(i, 1, True, True, True, 30, 0.9, 70.0, 30, sent, START - timedelta(minutes=minutes - early), "down") for i, early in ((1, 0), (2, 1))]
    got = {r.alert_id: (r.outcome, r.consecutive) for r in receivers.checked(spark.createDataFrame(rows, SUBSCRIPTION), latest, at(0)).collect()}
    assert got == {1: ("send", sent + 1), 2: ("wait", sent)}


def test_rounds_carry_their_state(spark):
    state = spark.createDataFrame([(1, 1, True, False, False, 30, None, None, 10, 0, None, None)], SUBSCRIPTION)
    said = []
    for minute, heard in ((0, None), (5, None), (10, None), (25, None), (30, None), (35, 35), (36, 35), (70, 35)):
        latest = spark.createDataFrame([(1, None if heard is None else START + timedelta(minutes=heard), 0.1, 20.0)], LATEST)
        after = receivers.checked(state, latest, at(minute))
        row = after.first()
        said.append((minute, row.outcome, row.consecutive))
        state = spark.createDataFrame([tuple(row)[:12]], SUBSCRIPTION)
    assert said == [(0, "send", 1), (5, "wait", 1), (10, "send", 2), (25, "wait", 2), (30, "send", 3), (35, "clear", 0), (36, "quiet", 0), (70, "send", 1)]


def test_empty(spark):
    none, latest = spark.createDataFrame([], SUBSCRIPTION), spark.createDataFrame([], LATEST)
    assert receivers.checked(none, latest, at(0)).collect() == []
