"""Evidence that a device's track belongs to a bus's trip: metrics of each trip and direction, of a day, and of the day as a whole.

A trip's pings and a route direction's line and stops meet as arrays of one row, keyed by trip and route; the metrics that are
sequences by nature are one Arrow kernel over such rows, everything after it is grouping. What can't be measured is null.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from farelane.functions import geo as G
from farelane.operators import relational as R

# Metres, km/h, degrees and shares.
BUFFERS, BIN_M, BIN_NEAR_M, STOP_M, SLOW_KMH, TURN, FAR_M = (30.0, 50.0, 100.0), 200.0, 100.0, 60.0, 3.0, 45.0, 500.0
GOOD_COVER, GOOD_MARGIN, BAD_SHARE, SAMPLED = 0.5, 0.3, 0.5, 8
DIRECTION_NUMBER = {"I": 0, "V": 1}

#: Metrics of a trip against one direction of its route. Fixed values.
TRIP_METRICS = (
    "n_points", "direction_correlation", "monotonicity_fraction", "heading_consistency", "direction_agreement", "fare_stationary_fraction", "fare_near_stop_m",
    "buffer_coverage_30", "buffer_coverage_50", "buffer_coverage_100", "shape_coverage", "median_offset_m", "p90_offset_m", "distance_ratio", "mean_speed_kmh",
    "max_speed_kmh", "stationary_fraction", "stop_coincidence_fraction", "contradiction_fraction", "max_excursion_m", "route_id_agreement",
    "start_dist_route_endpoint_m", "end_dist_route_endpoint_m", "start_dist_stop_m", "end_dist_stop_m",
)
#: Features of a bus, device and day. Fixed values.
DAY_FEATURES = (
    "n_trips_sampled", "n_trips_with_data", "n_trips_no_avl", "n_trips_no_gtfs", "frac_good_trips", "n_clearly_bad_trips", "median_heading_consistency", "median_direction_agreement",
    "median_fare_stationary_fraction", "median_fare_near_stop_m", "frac_device_points_in_windows", "frac_device_moving_points_in_windows", "first_activity_gap_seconds",
    "last_activity_gap_seconds", "median_buffer_coverage_50", "median_shape_coverage", "median_direction_margin", "median_distance_ratio", "median_mean_speed",
    "median_stop_coincidence_fraction", "median_route_id_agreement", "median_offset_m", "p90_offset_m", "worst_contradiction_fraction", "max_excursion_m",
    "median_start_dist_route_endpoint_m", "median_end_dist_route_endpoint_m", "median_start_dist_stop_m", "median_end_dist_stop_m", "avl_points_per_minute", "longest_gap_seconds",
)


def rank_correlation(a: np.ndarray, b: np.ndarray) -> float:
    """Spearman's, ties ranked in order of appearance; 0 for fewer than three points or without spread."""
    if len(a) < 3 or np.ptp(a) == 0 or np.ptp(b) == 0:
        return 0.0
    place = [np.argsort(np.argsort(x, kind="stable"), kind="stable") for x in (a, b)]
    return float(np.corrcoef(*place)[0, 1])


def _share(hit: np.ndarray, empty: float | None = 0.0) -> float | None:
    return float(hit.mean()) if len(hit) else empty


def trip_metrics(at, xy, speed, heading, route, line, stops, ends, trip_route, stated, fares) -> dict[str, float | None]:
    """TRIP_METRICS of one track (times, metres, km/h, degrees, reported routes) against one direction.

    line, stops: points of the direction; ends: (first stops, last stops); stated: whether the trip's own direction is this one
    (null: unknown); fares: times of its fares. With no points shares are 0 and contradiction is 1, as nothing fits.
    """
    n = len(at)
    out: dict[str, float | None] = dict.fromkeys(TRIP_METRICS)
    along, off, seg = G.project(line, xy) if n else (np.zeros(0),) * 3
    length = float(np.sqrt((np.diff(line, axis=0) ** 2).sum(axis=1)).sum())
    out |= {"n_points": float(n), "direction_correlation": rank_correlation(at, along), "monotonicity_fraction": _share(np.diff(along) >= 0), "direction_agreement": None if stated is None else float(stated)}
    out |= {f"buffer_coverage_{int(b)}": _share(off <= b) for b in BUFFERS}
    out["shape_coverage"] = len(np.unique(along[off <= BIN_NEAR_M] // BIN_M)) / max(1, int(np.ceil(length / BIN_M)))
    moved = float(np.sqrt((np.diff(xy, axis=0) ** 2).sum(axis=1)).sum()) if n > 1 else 0.0
    out["distance_ratio"] = moved / length if length else 0.0
    slow = speed <= SLOW_KMH
    out["stationary_fraction"] = _share(slow)
    out["stop_coincidence_fraction"] = _share(G.nearest(xy[slow], stops) <= STOP_M) if slow.any() and len(stops) else 0.0
    out["contradiction_fraction"] = _share(off > FAR_M, 1.0)
    out["route_id_agreement"] = _share(route == trip_route)
    if not n:
        return out
    out |= {"median_offset_m": float(np.median(off)), "p90_offset_m": float(np.percentile(off, 90)), "max_excursion_m": float(off.max()), "mean_speed_kmh": float(speed.mean()), "max_speed_kmh": float(speed.max())}
    step = np.diff(line, axis=0)[seg]
    turn = np.abs(heading - np.degrees(np.arctan2(step[:, 0], step[:, 1])) % 360)
    out["heading_consistency"] = _share(np.minimum(turn, 360 - turn) <= TURN)
    for name, point, other in (("start_dist_route_endpoint_m", 0, line[:1]), ("end_dist_route_endpoint_m", -1, line[-1:]), ("start_dist_stop_m", 0, ends[0]), ("end_dist_stop_m", -1, ends[1])):
        out[name] = float(G.nearest(xy[point][None], other)[0]) if len(other) else None
    if len(fares):
        k = np.minimum(np.searchsorted(at, fares), n - 1)
        out["fare_stationary_fraction"] = _share(speed[k] <= SLOW_KMH)
        out["fare_near_stop_m"] = float(np.median(G.nearest(xy[k], stops))) if len(stops) else None
    return out


_ROW = T.StructType([T.StructField(c, T.DoubleType()) for c in (*TRIP_METRICS, "longest_gap_seconds")])


@F.pandas_udf(_ROW)
def _metrics(points: pd.Series, line: pd.Series, stops: pd.Series, first: pd.Series, last: pd.Series, trip_route: pd.Series, stated: pd.Series, fares: pd.Series) -> pd.DataFrame:
    out = []
    for p, shape, s, a, z, r, d, f in zip(points, line, stops, first, last, trip_route, stated, fares, strict=True):
        p = [] if p is None else p
        at, speed, heading = (np.array([x[c] for x in p], float) for c in ("at", "speed", "heading"))
        xy, route = np.array([(x["x"], x["y"]) for x in p], float).reshape(-1, 2), np.array([x["route"] for x in p], object)
        row = trip_metrics(at, xy, speed, heading, route, G.as_array(shape), G.as_array(s), (G.as_array(a), G.as_array(z)), r, None if pd.isna(d) else bool(d), np.sort(np.array([] if f is None else f, float)))
        out.append(row | {"longest_gap_seconds": float(np.diff(at).max()) if len(at) > 1 else 0.0})
    return pd.DataFrame(out, columns=[*TRIP_METRICS, "longest_gap_seconds"], dtype=float)


def sampled_trips(trips: DataFrame, keys: list[str]) -> DataFrame:
    """At most SAMPLED trips a bus and day (keys), spread over the day by start."""
    return R.evenly_spaced(trips, keys, ["opened", "trip_id"], SAMPLED)


def direction_metrics(trips: DataFrame, points: DataFrame, routes: DataFrame, fares: DataFrame | None = None) -> DataFrame:
    """Per trip, device and direction of the trip's route: TRIP_METRICS, longest_gap_seconds, points_per_minute.

    trips: device, trip_id, route, opened, closed, stated (0, 1 or null). points: device, at, x, y, speed, heading, route.
    routes: route, direction, line, stops, first_stops, last_stops (arrays of points). fares: trip_id, at. A trip whose route has
    no line gives no row; one without points gives rows with n_points 0.
    """
    inside = R.contained(points.withColumnRenamed("route", "reported"), trips.select("device", "trip_id", "opened", "closed"), ["device"], "at", "opened", "closed", 86400.0)
    own = inside.groupBy("device", "trip_id").agg(F.array_sort(F.collect_list(F.struct("at", "x", "y", "speed", "heading", F.col("reported").cast("string").alias("route")))).alias("points"))
    rows = trips.join(own, ["device", "trip_id"], "left").join(routes, "route")
    if fares is None:
        rows = rows.withColumn("fares", F.lit(None).cast("array<double>"))
    else:
        rows = rows.join(fares.groupBy("trip_id").agg(F.collect_list(F.col("at").cast("double")).alias("fares")), "trip_id", "left")
    number = F.when(F.col("direction") == "I", DIRECTION_NUMBER["I"]).when(F.col("direction") == "V", DIRECTION_NUMBER["V"])
    rows = rows.withColumn("m", _metrics("points", "line", "stops", "first_stops", "last_stops", F.col("route").cast("string"), F.col("stated") == number, "fares"))
    minutes = (F.col("closed") - F.col("opened")) / 60.0
    rate = F.when(minutes > 0, F.col("m.n_points") / minutes).otherwise(0.0)
    return rows.select("device", "trip_id", "direction", *[F.when(F.isnan(f"m.{c}"), None).otherwise(F.col(f"m.{c}")).alias(c) for c in (*TRIP_METRICS, "longest_gap_seconds")], rate.alias("points_per_minute"))


def day_continuity(trips: DataFrame, points: DataFrame, keys: list[str]) -> DataFrame:
    """Per day of a pair (keys): shares of the device's points, and of its moving ones, inside any of the bus's trip windows, and how
    far its first and last movement lie from the first window's start and the last one's end.

    trips: keys, trip_id, opened, closed (all of the day); points: keys, point_id, at, speed. Overlapping windows count once.
    """
    hit = R.contained(points, trips.select(*keys, "opened", "closed"), keys, "at", "opened", "closed", 86400.0).select(*keys, "point_id").distinct().withColumn("inside", F.lit(1.0))
    moving = F.col("speed") > SLOW_KMH
    seen = points.join(hit, [*keys, "point_id"], "left").withColumn("inside", F.coalesce("inside", F.lit(0.0)))
    per = seen.groupBy(*keys).agg(F.avg("inside").alias("frac_device_points_in_windows"), F.avg(F.when(moving, F.col("inside"))).alias("frac_device_moving_points_in_windows"), F.min(F.when(moving, F.col("at"))).alias("a"), F.max(F.when(moving, F.col("at"))).alias("z"))
    day = trips.groupBy(*keys).agg(F.min("opened").alias("first"), F.max(F.struct("opened", "closed"))["closed"].alias("last"))
    out = day.join(per, keys, "left").withColumns({"first_activity_gap_seconds": F.abs(F.col("a") - F.col("first")), "last_activity_gap_seconds": F.abs(F.col("z") - F.col("last"))})
    return out.drop("a", "z", "first", "last")


def pair_days(trips: DataFrame, metrics: DataFrame, continuity: DataFrame, keys: list[str]) -> DataFrame:
    """DAY_FEATURES per day of a pair. trips: keys, device, trip_id, route_known (the sampled ones); metrics: direction_metrics().

    The direction of the larger correlation counts for a trip ("I" of equal ones); the margin is what lies between both, or the
    correlation itself where there is one direction.
    """
    by = W.partitionBy("device", "trip_id")
    r = F.col("direction_correlation")
    both = metrics.withColumns({"margin": F.when(F.count(F.lit(1)).over(by) == 2, F.max(r).over(by) - F.min(r).over(by)).otherwise(F.abs(r)), "rn": F.row_number().over(by.orderBy(F.desc("direction_correlation"), "direction"))})
    best = both.where("rn = 1").drop("rn", "direction")
    rows = trips.join(best, ["device", "trip_id"], "left")
    seen = F.coalesce(F.col("n_points") > 0, F.lit(False))

    def median(name: str) -> Column:
        return F.median(F.when(seen, F.col(name)))

    good = (F.col("buffer_coverage_50") >= GOOD_COVER) & (F.col("margin") >= GOOD_MARGIN)
    medians = {
        "median_heading_consistency": "heading_consistency", "median_direction_agreement": "direction_agreement", "median_fare_stationary_fraction": "fare_stationary_fraction", "median_fare_near_stop_m": "fare_near_stop_m",
        "median_buffer_coverage_50": "buffer_coverage_50", "median_shape_coverage": "shape_coverage", "median_direction_margin": "margin", "median_distance_ratio": "distance_ratio", "median_mean_speed": "mean_speed_kmh",
        "median_stop_coincidence_fraction": "stop_coincidence_fraction", "median_route_id_agreement": "route_id_agreement", "median_offset_m": "median_offset_m", "p90_offset_m": "p90_offset_m",
        "median_start_dist_route_endpoint_m": "start_dist_route_endpoint_m", "median_end_dist_route_endpoint_m": "end_dist_route_endpoint_m", "median_start_dist_stop_m": "start_dist_stop_m",
        "median_end_dist_stop_m": "end_dist_stop_m", "avl_points_per_minute": "points_per_minute",
    }
    out = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_trips_sampled"), F.count_if(seen).alias("n_trips_with_data"), F.count_if(F.col("route_known") & ~seen).alias("n_trips_no_avl"), F.count_if(~F.col("route_known")).alias("n_trips_no_gtfs"),
        F.avg(F.when(seen, good.cast("double"))).alias("frac_good_trips"), F.count_if(seen & (F.col("contradiction_fraction") >= BAD_SHARE)).alias("n_clearly_bad_trips"),
        *[median(c).alias(name) for name, c in medians.items()],
        F.max(F.when(seen, F.col("contradiction_fraction"))).alias("worst_contradiction_fraction"), F.max(F.when(seen, F.col("max_excursion_m"))).alias("max_excursion_m"), F.max(F.when(seen, F.col("longest_gap_seconds"))).alias("longest_gap_seconds"),
    )
    with_data = F.col("n_trips_with_data") > 0
    out = out.join(continuity, keys, "left")
    day = [c for c in continuity.columns if c not in keys]
    return out.withColumns({c: F.when(with_data, F.col(c)) for c in day}).select(*keys, *DAY_FEATURES)
