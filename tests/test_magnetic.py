"""Declination against fields that have a closed form: a tilted dipole, and gradients of potentials written in x, y and z."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from contrail.functions import magnetic
from contrail.functions.geo import true_to_magnetic

RADIUS = 6371.2
PLACES = [(0.0, 0.0, 0.0), (47.3, 8.5, 400.0), (-33.9, 151.2, 12000.0), (64.1, -21.9, 0.0), (-77.8, 166.7, 3000.0), (12.0, 179.9, 50.0), (89.9, -120.0, 0.0)]


def model_file(tmp_path, epoch, lines):
    path = tmp_path / "coefficients.txt"
    path.write_text(f"    {epoch}   MADE   01/01/2020\n" + "".join(" ".join(map(str, x)) + "\n" for x in lines) + "9" * 48 + "\n" + "9" * 48 + "\n")
    return str(path)


def axes(lat, lon, altitude_m):
    """Place in km, and unit vectors to the north, the east and down, in a frame fixed to the earth."""
    p, q = np.radians(lat), np.radians(lon)
    a, b = 6378.137, 6378.137 * (1 - 1 / 298.257223563)
    up = np.array([np.cos(p) * np.cos(q), np.cos(p) * np.sin(q), np.sin(p)])
    at = np.array([a * a, a * a, b * b]) * up / np.sqrt(a * a * np.cos(p) ** 2 + b * b * np.sin(p) ** 2) + altitude_m / 1000 * up
    return at, np.array([-np.sin(p) * np.cos(q), -np.sin(p) * np.sin(q), np.cos(p)]), np.array([-np.sin(q), np.cos(q), 0.0]), -up


def angle(force, north, east):
    return np.degrees(np.arctan2(force @ east, force @ north))


def found(spark, model, places, year):
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(places)], "i int, lat double, lon double, alt double")
    return [r.d for r in df.withColumn("d", magnetic.declination(model, F.col("lat"), F.col("lon"), F.col("alt"), F.lit(year))).orderBy("i").collect()]


def test_tilted_dipole_that_drifts(spark, tmp_path):
    model = magnetic.read_model(spark, model_file(tmp_path, 2020.0, [(1, 0, -29404.5, 0.0, 6.7, 0.0), (1, 1, -1450.7, 4652.9, 7.7, -25.1)]))
    moment = np.array([-1450.7 + 2.5 * 7.7, 4652.9 - 2.5 * 25.1, -29404.5 + 2.5 * 6.7])
    for place, d in zip(PLACES, found(spark, model, PLACES, 2022.5), strict=True):
        at, north, east, _ = axes(*place)
        r = np.linalg.norm(at)
        force = 3 * (moment @ at) * at / r**2 - moment
        assert d == pytest.approx(angle(force, north, east), abs=1e-6)


@pytest.mark.parametrize(
    ("n", "m", "potential"),
    [
        (2, 0, lambda x, y, z, r: (3 * z * z - r * r) / 2 / r**5),
        (2, 1, lambda x, y, z, r: np.sqrt(3) * z * (x + 2 * y) / r**5),
        (2, 2, lambda x, y, z, r: np.sqrt(3) / 2 * ((x * x - y * y) + 2 * 2 * x * y) / r**5),
        (3, 1, lambda x, y, z, r: np.sqrt(3 / 8) * (x + 2 * y) * (5 * z * z - r * r) / r**7),
        (3, 3, lambda x, y, z, r: np.sqrt(5 / 8) * ((x**3 - 3 * x * y * y) + 2 * (3 * x * x * y - y**3)) / r**7),
    ],
)
def test_gradient_of_one_harmonic(tmp_path, spark, n, m, potential):
    model = magnetic.read_model(spark, model_file(tmp_path, 2020.0, [(n, m, 1.0, 2.0 if m else 0.0, 0.0, 0.0)]))

    def value(at):
        at = at / RADIUS
        return potential(*at, np.linalg.norm(at))

    lat, lon, alt = (np.array(x) for x in zip(*PLACES, strict=True))
    parts = np.array(magnetic.field(model, lat, lon, alt / 1000, np.full(len(lat), 2020.0)))
    for place, got in zip(PLACES, parts.T, strict=True):
        at, *directions = axes(*place)
        force = -RADIUS * np.array([(value(at + e) - value(at - e)) / 2 for e in np.eye(3)])
        assert got == pytest.approx([force @ d for d in directions], abs=1e-5)


def test_nulls_poles_and_empty(spark, tmp_path):
    path = model_file(tmp_path, 2020.0, [(1, 0, -29404.5, 0.0, 0.0, 0.0)])
    model = magnetic.read_model(spark, path)
    places = [(None, 0.0, 0.0), (0.0, None, 0.0), (0.0, 0.0, None), (float("nan"), 0.0, 0.0), (90.0, 10.0, 0.0), (-90.0, 10.0, 0.0), (10.0, 10.0, 0.0)]
    assert found(spark, model, places, 2020.0) == [None] * 4 + [pytest.approx(0.0, abs=1e-9)] * 3
    assert found(spark, model, [], 2020.0) == []
    with pytest.raises(ValueError, match="no coefficients"):
        magnetic.read_model(spark, model_file(tmp_path, 2020.0, []))


def test_decimal_year_and_heading(spark, tmp_path):
    years = spark.sql("SELECT timestamp'2024-01-01 12:00:00' AS t UNION ALL SELECT timestamp'2024-12-31 00:00:00' UNION ALL SELECT timestamp'2023-07-02 00:00:00' UNION ALL SELECT NULL")
    assert [r.y for r in years.select(magnetic.decimal_year(F.col("t")).alias("y")).collect()] == [2024.0, pytest.approx(2024 + 365 / 366), pytest.approx(2023 + 182 / 365), None]
    model = magnetic.read_model(spark, model_file(tmp_path, 2020.0, [(1, 0, -1.0, 0.0, 0.0, 0.0), (1, 1, 0.0, 1.0, 0.0, 0.0)]))
    turned = true_to_magnetic(F.lit(10.0), magnetic.declination(model, F.lit(0.0), F.col("lon"), F.lit(0.0), F.lit(2020.0)))
    row = spark.createDataFrame([(0.0,)], "lon double").select(turned.alias("h")).first()
    assert row.h == pytest.approx(55.0)  # east part -1, north part 1: 45 degrees to the west
