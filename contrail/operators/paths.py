"""Paths of flights: spline length, simplification, displacement. Tasks read fixes in order, many flights at a time."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

R = 6_371_000.0
SAMPLE_M = 100.0
#: Samples of splines that are held at once.
SAMPLES = 1 << 15


def metres(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Haversine with altitude difference of rows (lat, lon, alt_m)."""
    p, q = np.radians(a[..., :2]), np.radians(b[..., :2])
    d = q - p
    h = np.sin(d[..., 0] / 2) ** 2 + np.cos(p[..., 0]) * np.cos(q[..., 0]) * np.sin(d[..., 1] / 2) ** 2
    flat = 2 * R * np.arctan2(np.sqrt(h), np.sqrt(np.maximum(1 - h, 0)))
    return np.hypot(flat, b[..., 2] - a[..., 2])


def half_chord(dlat: np.ndarray, dlon: np.ndarray, cosines: np.ndarray) -> np.ndarray:
    """The haversine of an arc between rows so many radians apart; cosines are those of both latitudes, multiplied."""
    y, x = np.sin(dlat / 2), np.sin(dlon / 2)
    return y * y + cosines * (x * x)


def arc(h: np.ndarray) -> np.ndarray:
    return 2 * R * np.arctan2(np.sqrt(h), np.sqrt(np.maximum(1 - h, 0)))


def short_arcs(dlat: np.ndarray, dlon: np.ndarray, cosines: np.ndarray) -> np.ndarray:
    """Arcs of half_chord; below 1e-3 radians by series whose next terms are below the precision of doubles."""
    if not max(np.abs(dlat).max(initial=0), np.abs(dlon).max(initial=0)) < 1e-3:
        return arc(half_chord(dlat, dlon, cosines))
    y, x = dlat * dlat / 4, dlon * dlon / 4
    h = y * (1 - y / 3 * (1 - y * (2 / 15))) + cosines * (x * (1 - x / 3 * (1 - x * (2 / 15))))
    return 2 * R * np.sqrt(h) * (1 + h * (1 / 6 + h * (3 / 40)))


def pieces(points: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Centripetal Catmull-Rom through the points of flights that lie end to end, as cubic coefficients (4, 3, points) of the piece that
    begins at each point, and how often to sample it: about every 100 m and at least twice, ends doubled. Repeated points take a knot distance of a tiny step.

    The last point of a flight is sampled once, and so are both points of a flight of two.
    """
    at = np.arange(len(points))
    begin, size = np.repeat(first, sizes), np.repeat(sizes, sizes)
    end = begin + size - 1
    p0, p1, p2, p3 = (points[np.clip(at + k, begin, end)] for k in (-1, 0, 1, 2))
    d1, d2, d3 = (np.maximum(np.sqrt(np.linalg.norm(b - a, axis=1)), 1e-9)[:, None] for a, b in ((p0, p1), (p1, p2), (p2, p3)))
    step = p2 - p1
    out = (p1 - p0) * (d2 * d2 / (d1 * (d1 + d2))) + step * (d1 / (d1 + d2))
    into = (p3 - p2) * (d2 * d2 / (d3 * (d2 + d3))) + step * (d3 / (d2 + d3))
    times = np.maximum(np.nan_to_num(np.ceil(metres(p1, p2) / SAMPLE_M)), 2).astype(np.int64)
    return np.stack([p1, out, 3 * step - 2 * out - into, out + into - 2 * step]).transpose(0, 2, 1), np.where((at == end) | (size < 3), 1, times)


def spline_figures(points: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of the flights end to end in points (lat, lon, alt_m): the spline's length, and its greatest displacement from the first point, in metres.

    Samples of all flights are made and summed in runs of SAMPLES, so memory does not follow the length of a path.
    """
    coefficients, times = pieces(points, first, sizes)
    flight = np.repeat(np.arange(len(first)), sizes)
    ends = np.cumsum(times)
    starts = ends - times
    home_lat, home_lon = np.radians(points[first, 0]), np.radians(points[first, 1])
    length, away = np.zeros(len(first)), np.zeros(len(first))
    before = None
    for s in range(0, int(ends[-1]), SAMPLES):
        e = min(s + SAMPLES, int(ends[-1]))
        a, b = np.searchsorted(ends, s, "right"), np.searchsorted(starts, e, "left")
        n = np.minimum(ends[a:b], e) - np.maximum(starts[a:b], s)
        u = (np.arange(s, e) - np.repeat(starts[a:b], n)) / np.repeat(times[a:b], n)
        lat, lon, alt = (((c3 * u + c2) * u + c1) * u + c0 for c0, c1, c2, c3 in (np.repeat(coefficients[:, k, a:b], n, axis=1) for k in range(3)))
        lat, lon = np.radians(lat), np.radians(lon)
        cos = np.cos(lat)
        fl = flight[a:b]
        change = np.flatnonzero(np.diff(fl, prepend=-1))
        of = fl[change]
        begin = (np.cumsum(n) - n)[change]
        own = np.diff(np.append(begin, e - s))
        h = half_chord(lat - np.repeat(home_lat[of], own), lon - np.repeat(home_lon[of], own), cos * np.repeat(np.cos(home_lat[of]), own))
        away[of] = np.maximum(away[of], np.maximum.reduceat(h, begin))
        # a step leads to each sample from the one before, which may lie in the run before; to the first of a flight none does
        last = before if before is not None else (lat[0], lon[0], alt[0], cos[0])
        lat0, lon0, alt0, cos0 = (np.concatenate([[x], y[:-1]]) for x, y in zip(last, (lat, lon, alt, cos), strict=True))
        dlat, dlon, rise = lat - lat0, lon - lon0, alt - alt0
        fresh = begin[starts[first[of]] >= s]
        for x in (dlat, dlon, rise):
            x[fresh] = 0
        flat = short_arcs(dlat, dlon, cos0 * cos)
        length[of] += np.add.reduceat(np.sqrt(flat * flat + rise * rise), begin)
        before = lat[-1], lon[-1], alt[-1], cos[-1]
    return length, arc(away)


def simplified(points: np.ndarray, epsilon_m: float = 50.0) -> np.ndarray:
    """Indices that Ramer-Douglas-Peucker keeps; distances in local metres to the clamped segment. 0 keeps all."""
    n = len(points)
    if n < 3 or epsilon_m <= 0:
        return np.arange(n)
    scale = np.array([np.pi / 180 * R, np.pi / 180 * R * np.cos(np.radians(points[:, 0].mean())), 1.0])
    xyz = points * scale
    keep = np.zeros(n, dtype=bool)
    keep[[0, n - 1]] = True
    stack = [(0, n - 1)]
    while stack:
        a, b = stack.pop()
        if b - a < 2:
            continue
        line, rel = xyz[b] - xyz[a], xyz[a + 1 : b] - xyz[a]
        length = line @ line
        t = np.clip(rel @ line / length, 0, 1) if length else np.zeros(len(rel))
        d = np.linalg.norm(rel - t[:, None] * line, axis=1)
        k = int(d.argmax())
        if d[k] > epsilon_m:
            keep[a + 1 + k] = True
            stack += [(a, a + 1 + k), (a + 1 + k, b)]
    return np.flatnonzero(keep)


def path_figures(fixes: DataFrame, key: str, epsilon_m: float = 50.0) -> DataFrame:
    """Per key the spline length (null for one fix), greatest displacement from the first fix, points kept.

    Fixes are sorted by key and time and read as they come; a flight that goes on in the next batch waits for the rest of its points.
    """

    def figures(parts: list[pa.RecordBatch], new: np.ndarray) -> pa.RecordBatch:
        """Of the whole flights in parts; new are the rows at which they begin."""
        rows = pa.Table.from_batches(parts)
        points = np.column_stack([rows.column(k).to_numpy() for k in (1, 2, 3)]).astype(float)
        sizes = np.diff(np.append(new, len(points)))
        length, away = spline_figures(points, new, sizes)
        kept = sizes.copy()
        for k in np.flatnonzero(sizes > 2):
            kept[k] = len(simplified(points[new[k] : new[k] + sizes[k]], epsilon_m))
        keys = rows.column(0).take(pa.array(new)).combine_chunks()
        columns = [pa.array(sizes), pa.array(length, mask=sizes < 2), pa.array(away), pa.array(kept)]
        return pa.RecordBatch.from_arrays([keys, *columns], names=[key, "n_points", "spline_m", "displacement_m", "n_kept"])

    def same(a: pa.Array, b: pa.Array) -> np.ndarray:
        return pc.or_(pc.fill_null(pc.equal(a, b), False), pc.and_(a.is_null(), b.is_null())).to_numpy(zero_copy_only=False)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # whose last rows are of a flight that may go on; it begins in the first of them
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(0)
            new = np.append(True, ~same(keys.slice(1), keys.slice(0, len(keys) - 1)))
            if held:
                before = held[-1].column(0)
                new[0] = not same(before.slice(len(before) - 1), keys.slice(0, 1))[0]
            begins = np.flatnonzero(new)
            if not len(begins):
                held.append(batch)
                continue
            waiting = sum(x.num_rows for x in held)
            cut = int(begins[-1])
            whole = [*held, batch.slice(0, cut)] if cut else held
            if whole:
                yield figures(whole, np.append([0] if waiting else [], begins[:-1] + waiting).astype(np.int64))
            held = [batch.slice(cut)]
        if held:
            yield figures(held, np.zeros(1, np.int64))

    kind = fixes.schema[key].dataType.simpleString()
    metres_up = F.coalesce(F.col("alt_ft"), F.lit(0)).cast("double") * 0.3048
    points = fixes.select(key, F.col("lat").cast("double"), F.col("lon").cast("double"), metres_up.alias("alt_m"), "received_at", "fix_id")
    order = [F.col(c).asc_nulls_last() for c in (key, "received_at", "fix_id")]
    read = points.repartition(key).sortWithinPartitions(*order).select(key, "lat", "lon", "alt_m")
    return read.mapInArrow(run, f"{key} {kind}, n_points long, spline_m double, displacement_m double, n_kept long")
