"""Magnetic declination from a file of spherical-harmonic coefficients (the published format of the World Magnetic Model)."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Reference radius of the coefficients, and the WGS 84 ellipsoid, in km.
REFERENCE_KM = 6371.2
SEMI_MAJOR_KM = 6378.137
FLATTENING = 1 / 298.257223563


@dataclass(frozen=True)
class Model:
    """Coefficients and their yearly change as (degree + 1) x (degree + 1) arrays, by degree and order."""

    epoch: float
    g: np.ndarray
    h: np.ndarray
    dg: np.ndarray
    dh: np.ndarray


def read_model(spark: SparkSession, path: str) -> Model:
    """A first line that begins with the epoch, then lines of degree, order, g, h and their change a year; other lines are passed over.

    A model of degree 12 has 90 lines, so it goes to the driver, and to the tasks with the function that uses it.
    """
    words = [r.value.split() for r in spark.read.text(path).collect()]
    rows = [[float(x) for x in w] for w in words[1:] if len(w) == 6]
    if not rows:
        raise ValueError(f"no coefficients in {path}")
    size = int(max(r[0] for r in rows)) + 1
    tables = np.zeros((4, size, size))
    for n, m, *values in rows:
        tables[:, int(n), int(m)] = values
    return Model(float(words[0][0]), *tables)


def decimal_year(at: Column) -> Column:
    """The year of a time and the share of it that has passed, by whole days."""
    days = F.datediff(F.make_date(F.year(at) + 1, F.lit(1), F.lit(1)), F.make_date(F.year(at), F.lit(1), F.lit(1)))
    return F.year(at) + (F.dayofyear(at) - 1) / days


def field(model: Model, lat: np.ndarray, lon: np.ndarray, altitude_km: np.ndarray, year: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """North, east and downward part of the field, in the units of the coefficients, at geodetic places."""
    phi, lam = np.radians(np.clip(lat, -90 + 1e-7, 90 - 1e-7)), np.radians(lon)
    squashed = FLATTENING * (2 - FLATTENING)
    across = SEMI_MAJOR_KM / np.sqrt(1 - squashed * np.sin(phi) ** 2)
    from_axis, up = (across + altitude_km) * np.cos(phi), (across * (1 - squashed) + altitude_km) * np.sin(phi)
    r = np.hypot(from_axis, up)
    c, s = up / r, from_axis / r  # cosine and sine of the colatitude
    north, east, down = np.zeros_like(r), np.zeros_like(r), np.zeros_like(r)
    passed = year - model.epoch
    sector, sector_slope = np.ones_like(r), np.zeros_like(r)  # Schmidt's function of degree and order m, and its slope
    for m in range(len(model.g)):
        if m:
            scale = 1.0 if m == 1 else np.sqrt((2 * m - 1) / (2 * m))
            sector, sector_slope = scale * s * sector, scale * (s * sector_slope + c * sector)
        below, below_slope, p, slope = np.zeros_like(r), np.zeros_like(r), sector, sector_slope
        cos, sin = np.cos(m * lam), np.sin(m * lam)
        for n in range(m, len(model.g)):
            if n > m:
                root, norm = np.sqrt((n - 1) ** 2 - m * m), np.sqrt(n * n - m * m)
                rise = ((2 * n - 1) * (c * slope - s * p) - root * below_slope) / norm
                below, p = p, ((2 * n - 1) * c * p - root * below) / norm
                below_slope, slope = slope, rise
            g, h = model.g[n, m] + passed * model.dg[n, m], model.h[n, m] + passed * model.dh[n, m]
            far = (REFERENCE_KM / r) ** (n + 2)
            north += far * (g * cos + h * sin) * slope
            east += far * m * (g * sin - h * cos) * p / s
            down -= far * (n + 1) * (g * cos + h * sin) * p
    tilt = np.arctan2(up, from_axis) - phi  # from the geodetic to the geocentric vertical
    return north * np.cos(tilt) - down * np.sin(tilt), east, north * np.sin(tilt) + down * np.cos(tilt)


def declination(model: Model, lat: Column, lon: Column, altitude_m: Column, year: Column) -> Column:
    """Degrees by which magnetic north lies east of true north, -180 to 180; null where an argument is null or not a number.

    ``year`` is decimal. A pole has no north: there the value is that of a place a centimetre away on the same meridian.
    """

    @F.pandas_udf("double")
    def east_of_north(lat: pd.Series, lon: pd.Series, altitude_m: pd.Series, year: pd.Series) -> pd.Series:
        north, east, _ = field(model, lat.to_numpy(float), lon.to_numpy(float), altitude_m.to_numpy(float) / 1000, year.to_numpy(float))
        return pd.Series(np.degrees(np.arctan2(east, north)))

    return F.nanvl(east_of_north(*(x.cast("double") for x in (lat, lon, altitude_m, year))), F.lit(None).cast("double"))
