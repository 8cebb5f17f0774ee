"""Airspaces against plain geometry, and the trigram index against scoring all pairs."""

from __future__ import annotations

import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from contrail.functions.text import similarity
from contrail.operators import airspaces, search

AREAS = "area_id long, rings array<array<struct<x: double, y: double>>>"
POINTS = "p long, lat double, lon double"


def held(x, y, rings):
    out = False
    for ring in rings:
        for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True):
            if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
                out = not out
    return out


def star(rng, x, y, size, n):
    angles = sorted(rng.uniform(0, 2 * math.pi) for _ in range(n))
    return [(x + size * rng.uniform(0.2, 1) * math.cos(a), y + size * rng.uniform(0.2, 1) * math.sin(a)) for a in angles]


def joined(spark, points, areas):
    got = airspaces.inside(spark.createDataFrame(points, POINTS), spark.createDataFrame(areas, AREAS), "area_id")
    assert got.columns == ["p", "lat", "lon", "area_id"]
    return sorted((r.p, r.area_id) for r in got.collect())


def plain(points, areas):
    return sorted((p, a) for p, lat, lon in points for a, rings in areas if rings and lat is not None and lon is not None and held(lon, lat, [r for r in rings if r]))


def test_points_in_areas_of_all_sizes(spark):
    rng = random.Random(5)
    areas = []
    for k in range(40):
        x, y, size = rng.uniform(-20, 20), rng.uniform(-20, 20), 2.0 ** rng.randint(-6, 5)
        rings = [star(rng, x, y, size, rng.choice([3, 5, 9, 200]))]
        if k % 2:
            rings.append(star(rng, x, y, size / 4, 7))  # a hole
        if k % 3 == 0:
            rings.append([(x + 3 * size, y), (x + 4 * size, y), (x + 4 * size, y + size), (x + 3 * size, y + size), (x + 3 * size, y)])  # another part, closed, with level sides
        areas.append((k, rings))
    points = [(i, rng.uniform(-30, 30), rng.uniform(-30, 30)) for i in range(2000)]
    # close to the small ones, on corners and on the grid too
    for k, rings in areas:
        x, y = rings[0][0]
        size = max(abs(a - x) for a, _ in rings[0])
        points += [(10_000 + 100 * k + i, y + rng.uniform(-size, size), x + rng.uniform(-size, size)) for i in range(30)]
        points += [(10_000 + 100 * k + 40 + i, round(y) + i / 4, round(x) + i / 8) for i in range(9)] + [(10_000 + 100 * k + 60, y, x)]
    want = plain(points, areas)
    assert len(want) > 500
    assert joined(spark, points, areas) == want


def test_level_sides_decide_within_their_cells(spark):
    box = [(0.0, 0.0), (64.0, 0.0), (64.0, 0.5), (0.0, 0.5)]  # lower than a cell: only level sides touch the middle ones
    points = [(0, 0.25, 30.5), (1, 0.75, 30.5), (2, -0.25, 30.5), (3, 0.25, 64.5), (4, 0.0, 10.0), (5, 0.5, 10.0), (6, 0.25, 0.0)]
    assert joined(spark, points, [(1, [box])]) == plain(points, [(1, [box])]) == [(0, 1), (4, 1), (6, 1)]


def test_odd_areas_and_points(spark):
    triangle = [(0.0, 0.0), (2.0, 0.0), (1.0, 2.0)]
    areas = [(1, [triangle]), (2, None), (3, []), (4, [[]]), (5, [[(0.0, 0.0), (1.0, 1.0)]]), (6, [triangle, None]), (7, [[(1.0, 1.0)] * 3]), (8, [triangle, triangle])]
    points = [(1, 0.5, 1.0), (1, 0.5, 1.0), (2, None, 1.0), (3, 1.0, None), (4, 90.0, 180.0), (5, float("nan"), 1.0)]
    assert joined(spark, points, areas) == [(1, 1), (1, 1), (1, 6), (1, 6)]
    assert joined(spark, points, []) == []
    assert joined(spark, [], areas) == []


def test_cover_is_bounded_and_answers_alone_within(spark):
    box = [(-100.0, -60.0), (100.0, -60.0), (100.0, 60.0), (-100.0, 60.0)]
    cells = airspaces.cover(spark.createDataFrame([(1, [box])], AREAS), "area_id")
    n, border = cells.select(F.count("*"), F.count("found")).first()
    assert n <= (airspaces.ACROSS + 2) ** 2 and border <= 4 * (airspaces.ACROSS + 2) < n


def test_polygons_own_their_holes(spark):
    square = lambda x, size: [(x, 0.0), (x, size), (x + size, size), (x + size, 0.0)]  # noqa: E731  clockwise: outer
    back = lambda ring: ring[::-1]
    hole = back([(1.0, 1.0), (1.0, 9.0), (9.0, 9.0), (9.0, 1.0)])
    rows = [("f", 1, 0, square(0.0, 10.0), True), ("f", 1, 1, hole, False), ("f", 1, 2, [(2.0, 2.0), (2.0, 8.0), (8.0, 8.0), (8.0, 2.0)], True)]
    rows += [("f", 1, 3, back([(3.0, 3.0), (3.0, 4.0), (4.0, 4.0), (4.0, 3.0)]), False), ("f", 1, 4, square(20.0, 1.0), True), ("f", 1, 5, back(square(40.0, 1.0)), False), ("g", 1, 0, square(0.0, 10.0), True)]
    df = spark.createDataFrame(rows, "path string, record long, ring long, points array<struct<x: double, y: double>>, outer boolean")
    got = {(r.path, r.polygon): [tuple(map(tuple, ring)) for ring in r.rings] for r in airspaces.polygons(df).collect()}
    ring = {(r[0], r[2]): tuple(r[3]) for r in rows}
    assert got == {("f", 0): [ring["f", 0], ring["f", 1]], ("f", 2): [ring["f", 2], ring["f", 3]], ("f", 4): [ring["f", 4]], ("f", 5): [ring["f", 5]], ("g", 0): [ring["g", 0]]}


NAMES = st.lists(st.one_of(st.none(), st.text("ab c-É1", max_size=14)), max_size=12)


@settings(max_examples=5, deadline=None)
@given(NAMES, NAMES, st.sampled_from([0.05, 0.3, 0.7, 1.0]))
def test_trigram_index_finds_what_scoring_all_finds(spark, names, asked, least):
    a = spark.createDataFrame([(i, t, "x") for i, t in enumerate(names)], "id long, t string, score string")
    b = spark.createDataFrame([(f"q{i}", t) for i, t in enumerate(asked)], "q string, t2 string")
    every = a.join(b).withColumn("s", similarity(F.col("t"), F.col("t2"))).filter((F.col("s") >= least) & (F.col("s") > 0))
    want = sorted((r.id, r.q, round(r.s, 6)) for r in every.collect())
    got = search.similar_pairs(a, b, "id", "t", "q", "t2", least)
    assert got.columns == ["id", "q", "score"]
    assert sorted((r.id, r.q, pytest.approx(r.score)) for r in got.collect()) == want
