"""Registered queries of frames, change feeds, checks, merges and neighbours, with their oracle SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..functions import modes
from ..operators import merge, retractable, spatial, transponder
from ..operators.kept import kept
from . import domain as d
from .domain import metres, seconds, sql
from .more_queries import MESSAGES, messages
from .rollup_queries import _bucket_rows, _bucket_sql

#: A table that changes: every fifth flight lands at a club of its own, every seventh is taken back, every eleventh comes again under a new number and aircraft.
CHANGED = """changed AS (SELECT flight_id, aircraft_id, CASE WHEN flight_id % 5 = 0 THEN flight_id % 13 ELSE club_id END AS club_id, takeoff,
    CASE WHEN flight_id % 5 = 0 THEN takeoff + to_minutes(flight_id % 90) ELSE landing END AS landing, distance_m, dep, arr, towed FROM flights WHERE flight_id % 7 <> 0
  UNION ALL SELECT flight_id + 1000000000, aircraft_id + 1, club_id, takeoff, landing, distance_m, arr, dep, towed FROM flights WHERE flight_id % 11 = 0)"""
SECS = "coalesce(round((epoch_us(landing) - epoch_us(takeoff)) / 1e6), 0)"


def feed(s, p):  # noqa: ANN001, ANN201
    """The changes between flights and CHANGED, in two batches; the first is delivered twice."""
    f, k = d.flights(s, p), F.col("flight_id")
    shape = ["flight_id", "aircraft_id", "club_id", "takeoff", "landing", "distance_m", "dep", "arr", "towed"]
    row = lambda **new: F.struct(*(new.get(c, F.col(c)).alias(c) for c in shape))
    none = F.lit(None).cast(f.select(row()).schema[0].dataType)
    updated = row(club_id=k % 13, landing=F.col("takeoff") + F.make_dt_interval(mins=(k % 90).cast("int")))
    again = row(flight_id=k + 1_000_000_000, aircraft_id=F.col("aircraft_id") + 1, dep=F.col("arr"), arr=F.col("dep"))
    change = lambda kind, where, before, after: f.filter(where).select((k % 2).alias("batch_id"), F.concat_ws("-", F.lit(kind), k).alias("seq"), before.alias("before"), after.alias("after"))
    parts = [change("u", (k % 5 == 0) & (k % 7 != 0), row(), updated), change("d", k % 7 == 0, row(), none), change("i", k % 11 == 0, none, again)]
    whole = reduce(lambda a, b: a.unionByName(b), parts)
    return whole.unionByName(whole.filter("batch_id = 0"))


def changed_rollup(name: str, *more):  # noqa: ANN002, ANN201
    """The rollup of the flights before, merged with the changes; batch by batch, each once."""

    def query(s, p):  # noqa: ANN001, ANN202
        rollup = retractable.ROLLUPS[name]
        before = rollup.state(retractable.as_inserted(d.flights(s, p)))
        none = s.createDataFrame([], "batch_id long")
        changes = retractable.signed(retractable.pending(feed(s, p), none))
        return rollup.shown(rollup.merged(before, rollup.state(changes)), *(m() for m in more))

    return query


def velocity_frames(s, p):  # noqa: ANN001, ANN201
    """A velocity report for each fix, over ground or through the air."""
    k = F.col("fix_id")
    air = k % 3 == 0
    word = lambda *parts: reduce(lambda a, x: a * (1 << x[1]) + x[0], parts, F.lit(0).cast("long"))
    east, north, climb = k * 7 % 900, k * 11 % 900, k * 5 % 500
    # type, subtype, intent and accuracy bits; then sign or status and value, twice; climb
    head = word((F.lit(19), 5), (F.when(air, 3).otherwise(1), 3), (F.lit(0), 5))
    both = word((k % 2, 1), (east + 1, 10), (k % 5 % 2, 1), (north + 1, 10))
    tail = word((F.lit(0), 1), (k % 4 % 2, 1), (climb + 1, 9), (F.lit(0), 10))
    whole = (head * (1 << 22) + both) * (1 << 21) + tail  # 13, 22 and 21 bits
    digits = F.concat(F.lit("8D"), F.lpad(F.hex(k * 7919 % 16777216), 6, "0"), F.lpad(F.hex(whole), 14, "0"))
    return kept(d.fixes(s, p).select("fix_id", modes.with_parity(digits).alias("frame")))


def position_frames(s, p):  # noqa: ANN001, ANN201
    """Two reports for each fix, an even one and 3 or 12 seconds later an odd one."""
    f, k = d.fixes(s, p), F.col("fix_id")
    kinds = f.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("odd"))
    coded = kinds.withColumn("c", modes.compact(F.col("lat"), F.col("lon"), F.col("odd")))
    steps = (k * 31 % 2000).cast("long")  # height in steps of 25 ft above -1000 ft
    height = F.shiftleft(F.shiftright(steps, 4), 5) + 16 + steps.bitwiseAND(15)
    whole = (((F.lit(11).cast("long") * 8 * 4096 + height) * 2 + 0) * 2 + F.col("odd")) * (1 << 34) + F.col("c.cpr_lat") * (1 << 17) + F.col("c.cpr_lon")
    digits = F.concat(F.lit("8D"), F.lpad(F.hex(k % 16777216), 6, "0"), F.lpad(F.hex(whole), 14, "0"))
    after = F.when(F.col("odd") == 1, F.when(k % 3 == 0, 12).otherwise(3)).otherwise(0)
    return kept(coded.select((k * 2 + F.col("odd")).alias("frame_id"), (F.col("received_at") + F.make_dt_interval(secs=after)).alias("received_at"), modes.with_parity(digits).alias("frame")))


def _checked(s, p):  # noqa: ANN001, ANN202
    k = F.col("flight_id")
    mins = lambda c, x: c + F.make_dt_interval(mins=x.cast("int"))
    last = mins(F.col("takeoff"), k % 300)
    return d.flights(s, p).select(
        "flight_id", "takeoff", "landing", last.alias("last_fix"), mins(F.col("takeoff"), k % 7 - 3).alias("created"), F.when(F.col("towed"), mins(F.col("takeoff"), k % 60 - 2)).alias("tow_release"),
        F.when(k % 9 == 0, mins(last, k % 1700 - 30)).alias("timed_out_at"),
    )


def _pending(s, p):  # noqa: ANN001, ANN202
    k = F.col("aircraft_id")
    tail = F.concat(F.lit("N"), F.floor(k / 6).cast("string"))
    kind = lambda rest, c: F.when(k % rest == 0, k * c % 50).cast("int")
    return d.aircraft(s, p).select(
        "aircraft_id", F.when((k % 6 == 2) & (k % 4 != 0), tail).when(k % 6 == 5, " ").alias("registration"), F.when(k % 6 != 2, tail).alias("pending"),
        kind(2, 7).alias("icao"), kind(3, 3).alias("flarm"), kind(5, 11).alias("ogn"), kind(7, 13).alias("other"),
    )


_CHECK_SQL = {
    "landing_near_last_fix": "last_fix < landing - INTERVAL 10 MINUTE", "last_fix_after_created": "last_fix < created", "takeoff_before_landing": "takeoff >= landing",
    "takeoff_before_tow_release": "takeoff >= tow_release", "timed_out_or_landed": "timed_out_at IS NOT NULL AND landing IS NOT NULL", "timeout_after_last_fix": "timed_out_at < last_fix",
    "timeout_reasonable": "timed_out_at > last_fix + INTERVAL 24 HOUR", "tow_release_before_landing": "tow_release >= landing",
}
_PENDING_SQL = """a AS (SELECT aircraft_id AS k, 'N' || (aircraft_id // 6) AS tail, CASE WHEN aircraft_id % 6 = 2 AND aircraft_id % 4 <> 0 THEN 'N' || (aircraft_id // 6) END AS reg, CASE WHEN aircraft_id % 6 <> 2 THEN 'N' || (aircraft_id // 6) END AS pend,
    CASE WHEN aircraft_id % 2 = 0 THEN aircraft_id * 7 % 50 END AS icao, CASE WHEN aircraft_id % 3 = 0 THEN aircraft_id * 3 % 50 END AS flarm, CASE WHEN aircraft_id % 5 = 0 THEN aircraft_id * 11 % 50 END AS ogn, CASE WHEN aircraft_id % 7 = 0 THEN aircraft_id * 13 % 50 END AS other FROM aircraft),
  t AS (SELECT a.*, coalesce(o.k, CASE WHEN pend IS NOT NULL THEN min(a.k) FILTER (a.pend IS NOT NULL) OVER (PARTITION BY a.tail) END) AS target FROM a LEFT JOIN (SELECT k, reg FROM a WHERE reg IS NOT NULL) o ON a.pend = o.reg)"""


def _adopted(c: str) -> str:
    return f"coalesce(x.{c}, (SELECT arg_min(t.{c}, t.k) FROM t WHERE t.target = x.k AND t.k <> x.k AND t.{c} IS NOT NULL)) AS {c}"


def _neighbours_sql(k: int) -> str:
    return sql(f"""WITH far AS (SELECT airport_id + 0 AS place, CASE WHEN airport_id % 4 = 0 THEN -60.0 ELSE lat + 0.05 END AS la, CASE WHEN airport_id % 4 = 0 THEN 170.0 - airport_id % 100 ELSE lon + 0.05 END AS lo FROM airports),
        m AS (SELECT place, airport_id, {metres('la', 'lo', 'lat', 'lon')} AS m FROM far, airports),
        r AS (SELECT *, row_number() OVER (PARTITION BY place ORDER BY m, airport_id) AS rank FROM m) SELECT place, rank, airport_id, round(m, 3) AS distance_m FROM r WHERE rank <= {k}""")


def _neighbours(k: int):  # noqa: ANN202
    def query(s, p):  # noqa: ANN001, ANN202
        a, far = d.airports(s, p), F.col("airport_id") % 4 == 0
        left = a.select(F.col("airport_id").alias("place"), F.when(far, -60.0).otherwise(F.col("lat") + 0.05).alias("lat"), F.when(far, 170.0 - F.col("airport_id") % 100).otherwise(F.col("lon") + 0.05).alias("lon"))
        right = a.select("airport_id", F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
        return spatial.k_nearest(left, right, "place", "airport_id", k)

    return query


def _now():  # noqa: ANN202
    return F.lit(d.FLIGHTS_AS_OF).cast("timestamp")


_EXPIRY = 21_600

QUERIES = {
    "s14_velocity_frames": (
        lambda s, p: velocity_frames(s, p).select("fix_id", modes.address(F.col("frame")).cast("long").alias("address"), modes.velocity(F.col("frame")).alias("v")).select(
            "fix_id", "address", F.round("v.speed_kt", 6).alias("speed_kt"), F.round("v.track", 6).alias("track"), F.round("v.heading", 6).alias("heading"), F.col("v.airspeed_kt").cast("long").alias("airspeed_kt"), F.col("v.climb_fpm").cast("long").alias("climb_fpm")),
        sql("""WITH v AS (SELECT fix_id, fix_id % 3 = 0 AS air, CASE WHEN fix_id % 2 = 1 THEN -1 ELSE 1 END * (fix_id * 7 % 900) AS x, CASE WHEN fix_id % 5 % 2 = 1 THEN -1 ELSE 1 END * (fix_id * 11 % 900) AS y,
              CASE WHEN fix_id % 4 % 2 = 1 THEN -64 ELSE 64 END * (fix_id * 5 % 500) AS climb FROM fixes)
            SELECT fix_id, fix_id * 7919 % 16777216 AS address, CASE WHEN NOT air THEN round(sqrt(x * x + y * y), 6) END AS speed_kt, CASE WHEN NOT air THEN round((degrees(atan2(x, y)) + 360) % 360, 6) END AS track,
              CASE WHEN air AND fix_id % 2 = 1 THEN round((abs(x) + 1) * 360 / 1024.0, 6) END AS heading, CASE WHEN air THEN abs(y) END AS airspeed_kt, climb AS climb_fpm FROM v"""),
    ),
    "g19_paired_positions": (
        lambda s, p: modes.paired_positions(position_frames(s, p)).select(F.floor(F.col("frame_id") / 2).alias("fix_id"), F.round("lat", 2).alias("lat"), F.round("lon", 2).alias("lon"), F.col("altitude_ft").cast("long").alias("altitude_ft")),
        sql("SELECT fix_id, round(lat, 2) AS lat, round(lon, 2) AS lon, (fix_id * 31 % 2000) * 25 - 1000 AS altitude_ft FROM fixes WHERE fix_id % 3 <> 0"),
    ),
    "t3_expiring_fixes": (
        lambda s, p: transponder.accumulated(messages(s, p), 7200, _EXPIRY).select("aircraft_id", "message_id", "lat", "altitude_ft", "speed_kt", "callsign", "squawk", "on_ground"),
        sql(f"""WITH {MESSAGES.split("b AS (")[0]} g AS (SELECT *, CASE WHEN epoch_us(received_at) - epoch_us(lag(received_at) OVER w) > {_EXPIRY}000000 THEN 1 ELSE 0 END AS cut FROM m WINDOW w AS (PARTITION BY aircraft_id ORDER BY received_at, message_id)),
            h AS (SELECT *, sum(cut) OVER (PARTITION BY aircraft_id ORDER BY received_at, message_id) AS part FROM g),
            b AS (SELECT *, lat IS NOT NULL AS pos, speed_kt IS NOT NULL OR track IS NOT NULL AS vel, last_value(on_ground IGNORE NULLS) OVER (PARTITION BY aircraft_id, part ORDER BY received_at, message_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS known FROM h),
            kept AS (SELECT * FROM b WHERE NOT (on_ground IS NOT NULL AND NOT pos AND NOT vel AND callsign IS NULL AND squawk IS NULL AND altitude_ft IS NULL AND coalesce(known = on_ground, false))),
            l AS (SELECT *, last_value(CASE WHEN pos THEN received_at END IGNORE NULLS) OVER w AS pat, last_value(lat IGNORE NULLS) OVER w AS plat, last_value(CASE WHEN pos OR altitude_ft IS NOT NULL THEN {{'a': altitude_ft}} END IGNORE NULLS) OVER w AS al,
              last_value(CASE WHEN vel THEN {{'s': speed_kt, 'at': received_at}} END IGNORE NULLS) OVER w AS v, last_value(callsign IGNORE NULLS) OVER w AS cs, last_value(squawk IGNORE NULLS) OVER w AS sq, last_value(on_ground IGNORE NULLS) OVER w AS og
              FROM kept WINDOW w AS (PARTITION BY aircraft_id, part ORDER BY received_at, message_id ROWS UNBOUNDED PRECEDING))
            SELECT aircraft_id, message_id, plat AS lat, al.a AS altitude_ft, CASE WHEN floor({seconds('v.at', 'received_at')}) <= 7200 THEN v.s END AS speed_kt, cs AS callsign, sq AS squawk, og AS on_ground
            FROM l WHERE floor({seconds('pat', 'received_at')}) <= 7200 AND og IS NOT NULL"""),
    ),
    "x9_changed_daily": (
        changed_rollup("daily"),
        sql(f"""WITH {CHANGED} SELECT strftime(takeoff, '%Y-%m-%d') AS day, count(*) AS n_flights, sum({SECS})::BIGINT AS total_seconds, floor(avg({SECS}) + 0.5)::BIGINT AS avg_seconds, round(sum(distance_m), 2) AS total_m,
            count(*) FILTER (towed) AS n_towed, count(*) FILTER (arr IS NOT NULL AND (dep IS NULL OR dep <> arr)) AS n_cross_country FROM changed GROUP BY 1"""),
    ),
    "x9_changed_hourly": (
        changed_rollup("hourly"),
        sql(f"WITH {CHANGED} SELECT epoch(date_trunc('hour', takeoff))::BIGINT AS hour, count(*) AS n_flights, count(DISTINCT aircraft_id) AS n_aircraft, count(DISTINCT club_id) AS n_clubs FROM changed GROUP BY 1"),
    ),
    "x9_changed_histogram": (
        changed_rollup("histogram"),
        sql(f"WITH {CHANGED} SELECT position, bucket, coalesce(n, 0) AS n_flights FROM (VALUES {_bucket_rows()}) b(position, bucket) LEFT JOIN (SELECT {_bucket_sql()} AS bucket, count(*) AS n FROM changed WHERE landing IS NOT NULL GROUP BY 1) USING (bucket)"),
    ),
    "x9_changed_aircraft": (
        changed_rollup("aircraft", _now),
        sql(f"""WITH {CHANGED} SELECT aircraft_id, count(*) AS n_flights, count(*) FILTER (takeoff >= (SELECT tf::DATE - 30 FROM as_of)) AS n_30d, count(*) FILTER (takeoff >= (SELECT tf::DATE - 7 FROM as_of)) AS n_7d, epoch_us(max(takeoff)) // 1000000 AS last_takeoff,
            floor(avg({SECS}) + 0.5)::BIGINT AS avg_seconds, round(sum(distance_m), 2) AS total_m FROM changed GROUP BY 1"""),
    ),
    "x9_changed_clubs": (
        changed_rollup("club"),
        sql(f"WITH {CHANGED} SELECT club_id, strftime(takeoff, '%Y-%m-%d') AS day, count(*) AS n_flights, count(DISTINCT aircraft_id) AS n_aircraft, sum({SECS})::BIGINT AS airtime_seconds, count(*) FILTER (towed) AS n_tows FROM changed WHERE club_id IS NOT NULL GROUP BY ALL"),
    ),
    "x9_changed_airports": (
        changed_rollup("airport"),
        sql(f"""WITH {CHANGED} SELECT slot, strftime(moment, '%Y-%m-%d') AS day, sum(o)::BIGINT AS departures, sum(1 - o)::BIGINT AS arrivals FROM (SELECT dep AS slot, takeoff AS moment, 1 AS o FROM changed UNION ALL SELECT arr, landing, 0 FROM changed)
            WHERE slot IS NOT NULL AND moment IS NOT NULL GROUP BY ALL"""),
    ),
    "x13_broken_checks": (
        lambda s, p: merge.with_broken_checks(_checked(s, p)).select(F.explode("broken").alias("check_name")).groupBy("check_name").agg(F.count("*").alias("n")),
        sql(f"""WITH c AS (SELECT *, takeoff + to_minutes(flight_id % 300) AS last_fix, takeoff + to_minutes(flight_id % 7 - 3) AS created, CASE WHEN towed THEN takeoff + to_minutes(flight_id % 60 - 2) END AS tow_release,
              CASE WHEN flight_id % 9 = 0 THEN takeoff + to_minutes(flight_id % 300 + flight_id % 1700 - 30) END AS timed_out_at FROM flights)
            SELECT check_name, count(*) AS n FROM ({" UNION ALL ".join(f"SELECT '{name}' AS check_name FROM c WHERE {broken}" for name, broken in _CHECK_SQL.items())}) GROUP BY 1"""),
    ),
    "x13_repeated_keys": (
        lambda s, p: merge.repeated_keys(d.flights(s, p).filter("landing IS NULL"), "aircraft_id", "club_id"),
        sql("SELECT aircraft_id, club_id, count(*) AS n FROM flights WHERE landing IS NULL AND club_id IS NOT NULL GROUP BY ALL HAVING count(*) > 1"),
    ),
    "x5_pending_outcomes": (
        lambda s, p: merge.resolve_pending(_pending(s, p)).select("aircraft_id", "outcome", "target"),
        sql(f"WITH {_PENDING_SQL} SELECT k AS aircraft_id, CASE WHEN target = k THEN 'take' ELSE 'merge' END AS outcome, nullif(target, k) AS target FROM t WHERE pend IS NOT NULL"),
    ),
    "x5_pending_merged": (
        lambda s, p: merge.apply_resolved(_pending(s, p), merge.resolve_pending(_pending(s, p))).select("aircraft_id", F.nullif(F.trim("registration"), F.lit("")).alias("registration"), *(F.col(c).cast("long").alias(c) for c in merge.ADDRESSES)),
        sql(f"WITH {_PENDING_SQL} SELECT k AS aircraft_id, CASE WHEN target = k THEN pend ELSE reg END AS registration, {', '.join(_adopted(c) for c in merge.ADDRESSES)} FROM t x WHERE pend IS NULL OR target = k"),
    ),
    "l5_nearest_1": (_neighbours(1), _neighbours_sql(1)),
    "l5_nearest_5": (_neighbours(5), _neighbours_sql(5)),
}
