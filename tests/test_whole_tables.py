"""Queries over whole tables whose namesakes keep subsets."""

from __future__ import annotations

from pyspark.sql import functions as F

from contrail import plans
from contrail.plans import domain as d


def test_whole_tables_are_registered():
    assert {"t15_geofence_status", "t16_geofence_exits", "x9_rollup_delta"} <= set(plans.ORACLE_SQL)


def test_geofences_of_all_aircraft(spark, sf):
    known = d.fixes(spark, sf).join(d.aircraft(spark, sf), "aircraft_id", "left_semi").count()
    assert plans.QUERIES["t15_geofence_status"](spark, sf).agg({"n": "sum"}).first()[0] == known


def test_overlapping_flights_against_all_pairs(spark, sf, tmp_path):
    orders = spark.read.parquet(f"{sf}/orders.parquet").orderBy("o_orderkey").limit(600)
    crowded = orders.withColumn("o_orderdate", F.expr("date_add(DATE '1995-01-01', CAST(o_orderkey % 2 AS int))").cast(orders.schema["o_orderdate"].dataType))
    crowded.write.parquet(f"{tmp_path}/orders.parquet")
    rows = d.flights(spark, str(tmp_path)).filter("landing IS NOT NULL").select("flight_id", "takeoff", "landing").collect()

    def meet(a, b):
        near = abs(a[0] % 60 - b[0] % 60) <= 2 and abs(a[0] * 7 % 170 - b[0] * 7 % 170) <= 5
        return near and a[0] != b[0] and a[1] <= b[2] and a[2] >= b[1]

    want = sorted((a[0], b[0]) for a in rows for b in rows if meet(a, b))
    got = sorted(map(tuple, plans.QUERIES["j14_overlapping_flights"](spark, str(tmp_path)).collect()))
    assert got == want
    assert any(a % 4 for a, _ in want)
