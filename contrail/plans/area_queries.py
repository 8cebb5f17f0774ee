"""Registered queries of airspaces and of text search by index, with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..operators import airspaces, search
from . import domain as d
from .domain import sql

#: An outer ring with a dent and a level side, and a hole, as offsets (x, y) in quarter degrees.
OUTER = [(-8, -4), (0, -8), (8, -4), (3, 0), (8, 6), (-6, 6)]
HOLE = [(-2, -2), (2, -2), (0, 3)]


def _areas(s, p):  # noqa: ANN001, ANN202
    """An airspace around each airport, of one of four sizes, with a floor and, but for every fourth, a ceiling."""
    k = F.col("airport_id")
    scale = F.pow(F.lit(2.0), k % 4) * 0.25
    ring = lambda points: F.array(*(F.struct((F.col("lon") + scale * x).alias("x"), (F.col("lat") + scale * y).alias("y")) for x, y in points))
    return d.airports(s, p).select(k.alias("area_id"), F.array(ring(OUTER), ring(HOLE)).alias("rings"), (k % 3 * 1000).alias("floor_ft"), F.when(k % 4 != 0, k % 5 * 2500).alias("ceiling_ft"))


def _in_airspaces(s, p):  # noqa: ANN001, ANN202
    """Fixes at one place and height are met once, with their number and sum; so are areas of one shape and one range of heights."""
    heights = ["floor_ft", "ceiling_ft"]
    areas = _areas(s, p).withColumn("like", F.min("area_id").over(W.partitionBy("rings", *heights)))
    alike = areas.filter("area_id = like").select("like", "rings", *heights)
    spots = d.fixes(s, p).groupBy("lat", "lon", "alt_ft").agg(F.count("*").alias("n"), F.sum("fix_id").alias("sum_id"))
    met = airspaces.inside(spots, alike, "like").join(alike.drop("rings"), "like")
    high = (F.col("alt_ft") >= F.col("floor_ft")) & F.coalesce(F.col("alt_ft") <= F.col("ceiling_ft"), F.lit(True))
    found = met.filter(high).groupBy("like").agg(F.sum("n").alias("n_fixes"), F.sum("sum_id").alias("sum_fix_id"))
    return areas.select("area_id", "like").join(found, "like").drop("like")


def _sides() -> str:
    return ", ".join(f"({x}, {y}, {u}, {v})" for ring in (OUTER, HOLE) for (x, y), (u, v) in zip(ring, ring[1:] + ring[:1], strict=True))


QUERIES = {
    "p10_in_airspaces": (
        _in_airspaces,
        sql(f"""WITH a AS (SELECT airport_id AS area_id, lon, lat, pow(2.0, airport_id % 4) * 0.25 AS k, airport_id % 3 * 1000 AS lo, CASE WHEN airport_id % 4 <> 0 THEN airport_id % 5 * 2500 END AS hi FROM airports),
            e AS (SELECT area_id, lo, hi, lon + k * x AS x, lat + k * y AS y, lon + k * u AS u, lat + k * v AS v FROM a, (VALUES {_sides()}) t(x, y, u, v)),
            c AS (SELECT fix_id, area_id FROM fixes f JOIN e ON (e.y > f.lat) <> (e.v > f.lat) AND f.lon < (u - x) * (f.lat - y) / (v - y) + x
              AND alt_ft >= lo AND (hi IS NULL OR alt_ft <= hi) GROUP BY ALL HAVING count(*) % 2 = 1)
            SELECT area_id, count(*) AS n_fixes, sum(fix_id)::BIGINT AS sum_fix_id FROM c GROUP BY 1"""),
    ),
    "f2_fuzzy_join": (
        lambda s, p: search.similar_pairs(d.table(s, p, "part").select("p_partkey", "p_name"), d.table(s, p, "part").select(F.col("p_type").alias("asked")).distinct(), "p_partkey", "p_name", "asked", "asked"),
        """WITH t AS (SELECT DISTINCT p_type AS asked FROM part),
            g(side, id, t) AS (SELECT 0, p_partkey::VARCHAR, p_name FROM part UNION ALL SELECT 1, asked, asked FROM t),
            x AS (SELECT side, id, unnest(list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower(t), '[^a-z0-9]+'), lambda w: len(w) > 0),
              lambda w: list_transform(range(1, len(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))) AS g FROM g),
            n AS (SELECT side, id, count(*) AS n FROM x GROUP BY ALL),
            b AS (SELECT a.id AS i, b.id AS j, count(*) AS k FROM x a JOIN x b ON a.g = b.g AND a.side = 0 AND b.side = 1 GROUP BY ALL)
            SELECT i::BIGINT AS p_partkey, j AS asked, round(k / (m.n + o.n - k), 6) AS score FROM b JOIN n m ON m.id = i AND m.side = 0 JOIN n o ON o.id = j AND o.side = 1
            WHERE k / (m.n + o.n - k) >= 0.3""",
    ),
}
