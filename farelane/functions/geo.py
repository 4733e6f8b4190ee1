"""Geometry without a spatial engine: column arithmetic for points and lines, numpy kernels for trajectories.

A point is two doubles; a line an array of struct<x, y>. Distances on the ellipsoid are approximated on a sphere
(haversine, at most 0.5 % off); planar kernels work in metres of UTM zone 24 south or in degrees, as named.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH = 6371008.8


def point(lon: Column, lat: Column) -> Column:
    """Null where either coordinate is null."""
    return F.when(lon.isNotNull() & lat.isNotNull(), F.struct(lon.cast("double").alias("x"), lat.cast("double").alias("y")))


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Metres between two points in degrees."""
    dy, dx = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    a = F.pow(F.sin(dy), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dx), 2)
    return 2 * EARTH * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


# Krüger's series for the transverse Mercator projection on GRS80, zone 24 south: central meridian -39, scale 0.9996
_F, _A = 1 / 298.257222101, 6378137.0
_N = _F / (2 - _F)
_R = _A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_ALPHA = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16, 13 * _N**2 / 48 - 3 * _N**3 / 5, 61 * _N**3 / 240)
_E = 2 * math.sqrt(_N) / (1 + _N)


def utm24s(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Easting and northing in metres, as built-in column arithmetic."""
    sin = F.sin(F.radians(lat))
    t = F.sinh(F.atanh(sin) - _E * F.atanh(_E * sin))
    dl = F.radians(lon + 39.0)
    xi, eta = F.atan2(t, F.cos(dl)), F.atanh(F.sin(dl) / F.sqrt(1 + t * t))
    east, north = eta, xi
    for j, a in enumerate(_ALPHA, 1):
        east = east + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        north = north + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return 500000.0 + 0.9996 * _R * east, 10000000.0 + 0.9996 * _R * north


def make_line(order: Column, x: Column, y: Column) -> Column:
    """Aggregate: points in order; null for fewer than two."""
    line = F.transform(F.array_sort(F.collect_list(F.struct(order.alias("k"), x.alias("x"), y.alias("y")))), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))
    return F.when(F.size(line) >= 2, line)


def _segments(line: Column) -> Column:
    n = F.size(line)
    return F.zip_with(F.slice(line, 1, n - 1), F.slice(line, 2, n - 1), lambda a, b: F.struct(a["x"].alias("ax"), a["y"].alias("ay"), (b["x"] - a["x"]).alias("dx"), (b["y"] - a["y"]).alias("dy")))


def line_length(line: Column) -> Column:
    """Planar length in the line's own units."""
    return F.aggregate(_segments(line), F.lit(0.0), lambda acc, s: acc + F.sqrt(s["dx"] * s["dx"] + s["dy"] * s["dy"]))


def line_length_metres(line: Column) -> Column:
    return F.aggregate(_segments(line), F.lit(0.0), lambda acc, s: acc + haversine(s["ax"], s["ay"], s["ax"] + s["dx"], s["ay"] + s["dy"]))


def locate(line: Column, x: Column, y: Column) -> Column:
    """struct(fraction, d2): where on the line the nearest point lies (0 to 1 of planar length) and its squared distance.

    The first of equally near segments counts. One pass of aggregate() over the segments, inside the JVM.
    """
    start = F.struct(F.lit(0.0).alias("run"), F.lit(float("inf")).alias("d2"), F.lit(0.0).alias("at"))

    def step(acc: Column, s: Column) -> Column:
        sq = s["dx"] * s["dx"] + s["dy"] * s["dy"]
        t = F.when(sq > 0, F.least(F.greatest(((x - s["ax"]) * s["dx"] + (y - s["ay"]) * s["dy"]) / sq, F.lit(0.0)), F.lit(1.0))).otherwise(F.lit(0.0))
        ex, ey = x - s["ax"] - t * s["dx"], y - s["ay"] - t * s["dy"]
        d2, length = ex * ex + ey * ey, F.sqrt(sq)
        near = d2 < acc["d2"]
        return F.struct((acc["run"] + length).alias("run"), F.when(near, d2).otherwise(acc["d2"]).alias("d2"), F.when(near, acc["run"] + t * length).otherwise(acc["at"]).alias("at"))

    return F.aggregate(_segments(line), start, step, lambda acc: F.struct(F.try_divide(acc["at"], acc["run"]).alias("fraction"), acc["d2"].alias("d2")))


def in_polygon_column(polygon: tuple[tuple[float, float], ...], x: Column, y: Column) -> Column:
    """Even-odd rule over a fixed polygon, as column arithmetic."""
    crossed = F.lit(0)
    for (ax, ay), (bx, by) in zip(polygon, polygon[1:] + polygon[:1], strict=True):
        if ay != by:
            spans = (F.lit(ay) > y) != (F.lit(by) > y)
            crossed = crossed + F.when(spans & (x < (bx - ax) * (y - ay) / (by - ay) + ax), 1).otherwise(0)
    return crossed % 2 == 1


# ---- numpy kernels -------------------------------------------------------------------------------------------------
def as_array(line) -> np.ndarray:
    """Points of a line cell, as (n, 2)."""
    return np.array([(p["x"], p["y"]) for p in line], float).reshape(-1, 2)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(((a[:, None, :] - b[None, :, :]) ** 2).sum(axis=2))


def hausdorff(a: np.ndarray, b: np.ndarray) -> float:
    """Discrete: the largest distance from a vertex of one to the nearest vertex of the other; nan if either is empty."""
    if not len(a) or not len(b):
        return float("nan")
    d = distances(a, b)
    return float(max(d.min(axis=0).max(), d.min(axis=1).max()))


def frechet(a: np.ndarray, b: np.ndarray) -> float:
    """Discrete Fréchet distance over vertices; the table is filled along anti-diagonals."""
    if not len(a) or not len(b):
        return float("nan")
    d = distances(a, b)
    n, m = d.shape
    best = np.full((n + 1, m + 1), np.inf)
    best[0, 0] = 0.0
    for s in range(n + m - 1):
        i = np.arange(max(0, s - m + 1), min(n, s + 1))
        j = s - i
        reach = np.minimum(np.minimum(best[i, j + 1], best[i + 1, j]), best[i, j])
        best[i + 1, j + 1] = np.maximum(reach, d[i, j])
        best[0, 0] = np.inf
    return float(best[n, m])


def project(line: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Chainage, offset and segment of the nearest place of the line to each point; the first segment wins ties."""
    start, step = line[:-1], np.diff(line, axis=0)
    sq = (step**2).sum(axis=1)
    rel = points[:, None, :] - start[None]
    t = np.clip(np.divide((rel * step).sum(axis=2), sq, out=np.zeros((len(points), len(step))), where=sq > 0), 0, 1)
    off = np.sqrt(((rel - t[..., None] * step) ** 2).sum(axis=2))
    seg = off.argmin(axis=1)
    length = np.sqrt(sq)
    before = np.concatenate([[0.0], np.cumsum(length)[:-1]])
    row = np.arange(len(points))
    return before[seg] + t[row, seg] * length[seg], off[row, seg], seg


def nearest(points: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Distance of each point to the nearest candidate; infinite without candidates."""
    if not len(candidates):
        return np.full(len(points), np.inf)
    return distances(points, candidates).min(axis=1)


def in_polygon(polygon: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Even-odd rule."""
    a, b = polygon, np.roll(polygon, -1, axis=0)
    x, y = points[:, :1], points[:, 1:]
    spans = (a[:, 1] > y) != (b[:, 1] > y)
    with np.errstate(divide="ignore", invalid="ignore"):
        cross = x < (b[:, 0] - a[:, 0]) * (y - a[:, 1]) / (b[:, 1] - a[:, 1]) + a[:, 0]
    return (spans & cross).sum(axis=1) % 2 == 1


def forward_stops(line: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Chainage of stops in order, each searched only from the one before on."""
    out, low = [], 0.0
    length = np.concatenate([[0.0], np.cumsum(np.sqrt((np.diff(line, axis=0) ** 2).sum(axis=1)))])
    for stop in stops:
        k = min(int(np.searchsorted(length, low, "right")) - 1, len(line) - 2)
        here = line[k] + (line[k + 1] - line[k]) * (0 if length[k + 1] == length[k] else (low - length[k]) / (length[k + 1] - length[k]))
        along, _, _ = project(np.vstack([here, line[k + 1 :]]), stop[None])
        low += float(along[0])
        out.append(low)
    return np.array(out)


def isotonic(y: np.ndarray, weight: np.ndarray | None = None) -> np.ndarray:
    """Least-squares non-decreasing fit by pooling adjacent violators."""
    weight = np.ones(len(y)) if weight is None else weight
    level: list[list[float]] = []
    for v, w in zip(y, weight, strict=True):
        level.append([float(v), float(w), 1])
        while len(level) > 1 and level[-2][0] > level[-1][0]:
            v2, w2, n2 = level.pop()
            v1, w1, n1 = level.pop()
            level.append([(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, n1 + n2])
    return np.concatenate([np.full(int(n), v) for v, _, n in level]) if level else np.zeros(0)


def viterbi(start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> np.ndarray:
    """Likeliest states of a hidden Markov model from log probabilities; emit is (time, state), move (time-1, state, state) or one matrix."""
    score, back = start + emit[0], []
    for t in range(1, len(emit)):
        total = score[:, None] + (move if move.ndim == 2 else move[t - 1])
        back.append(total.argmax(axis=0))
        score = total.max(axis=0) + emit[t]
    path = [int(score.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return np.array(path[::-1])
