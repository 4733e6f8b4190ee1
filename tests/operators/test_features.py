import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from farelane.operators import features as E

LINE = np.array([(0, 0), (1000, 0)], float)
STOPS = np.array([(0.0, 0.0), (500.0, 0.0), (1000.0, 0.0)])


def track(n=11, off=10.0):
    xy = np.stack([np.linspace(0, 1000, n), np.full(n, off)], axis=1)
    return np.arange(float(n)), xy, np.full(n, 30.0), np.full(n, 90.0), np.full(n, "7", object)


def test_a_track_along_the_line_fits_its_direction():
    at, xy, speed, heading, route = track()
    speed[5] = 0.0
    f = E.trip_metrics(at, xy, speed, heading, route, LINE, STOPS, (STOPS[:1], STOPS[-1:]), "7", True, np.array([4.5, 99.0]))
    assert set(f) == set(E.TRIP_METRICS) and len(E.TRIP_METRICS) == 25 and len(E.DAY_FEATURES) == 31
    want = {"n_points": 11, "direction_correlation": 1, "monotonicity_fraction": 1, "heading_consistency": 1, "direction_agreement": 1, "fare_stationary_fraction": 0.5, "fare_near_stop_m": 10, "buffer_coverage_30": 1, "shape_coverage": 1.2,
            "median_offset_m": 10, "p90_offset_m": 10, "distance_ratio": 1, "max_speed_kmh": 30, "stationary_fraction": 1 / 11, "stop_coincidence_fraction": 1, "contradiction_fraction": 0, "max_excursion_m": 10, "route_id_agreement": 1,
            "start_dist_route_endpoint_m": 10, "end_dist_stop_m": 10, "mean_speed_kmh": 300 / 11}
    assert {k: f[k] for k in want} == pytest.approx(want)
    back = E.trip_metrics(at, xy, speed, heading, route, LINE[::-1], STOPS[:0], (STOPS[:0], STOPS[:0]), "8", None, np.zeros(0))
    assert back["direction_correlation"] == pytest.approx(-1) and back["heading_consistency"] == 0 and back["stop_coincidence_fraction"] == 0 and back["route_id_agreement"] == 0
    assert back["direction_agreement"] is None and back["fare_near_stop_m"] is None and back["start_dist_stop_m"] is None and back["start_dist_route_endpoint_m"] > 1000


def test_no_points_fit_nothing():
    f = E.trip_metrics(np.zeros(0), np.zeros((0, 2)), np.zeros(0), np.zeros(0), np.zeros(0, object), LINE, STOPS, (STOPS[:1], STOPS[-1:]), "7", False, np.array([1.0]))
    assert (f["n_points"], f["direction_correlation"], f["contradiction_fraction"], f["buffer_coverage_50"], f["direction_agreement"]) == (0, 0, 1, 0, 0)
    assert all(f[k] is None for k in ("heading_consistency", "median_offset_m", "mean_speed_kmh", "fare_stationary_fraction", "start_dist_stop_m"))


def test_pair_days_by_hand(spark):
    """Three trips of one day: one along its route, one without pings, one without a line."""
    point = lambda a: [{"x": float(x), "y": float(y)} for x, y in a]
    routes = spark.createDataFrame([("7", d, point(line), point(STOPS), point(STOPS[:1]), point(STOPS[-1:])) for d, line in (("I", LINE), ("V", LINE[::-1]))], "route string, direction string, line array<struct<x:double,y:double>>, stops array<struct<x:double,y:double>>, first_stops array<struct<x:double,y:double>>, last_stops array<struct<x:double,y:double>>")
    trips = spark.createDataFrame([("d", 1, 0.0, 10.0, "7", 0, 0), ("d", 2, 100.0, 110.0, "7", 1, 0), ("d", 3, 5.0, 12.0, "9", None, 0)], "device string, trip_id long, opened double, closed double, route string, stated int, day long")
    at, xy, speed, heading, _ = track()
    rows = [("d", 0, i, float(t), *map(float, p), float(s), float(h), "7") for i, (t, p, s, h) in enumerate(zip(at, xy, speed, heading, strict=True))] + [("d", 0, 50, 50.0, 0.0, 0.0, 9.0, 0.0, "7"), ("d", 0, 51, 60.0, 0.0, 0.0, 0.0, 0.0, "7")]
    points = spark.createDataFrame(rows, "device string, day long, point_id long, at double, x double, y double, speed double, heading double, route string")
    metrics = E.direction_metrics(trips, points, routes)
    got = {(r["trip_id"], r["direction"]): r for r in metrics.collect()}
    assert set(got) == {(1, "I"), (1, "V"), (2, "I"), (2, "V")} and got[1, "I"]["direction_correlation"] == pytest.approx(1) and got[2, "I"]["n_points"] == 0 and got[1, "I"]["points_per_minute"] == pytest.approx(66)
    keys = ["device", "day"]
    day = E.pair_days(trips.withColumn("route_known", F.col("route") == "7"), metrics, E.day_continuity(trips, points, keys), keys).first().asDict()
    want = {"n_trips_sampled": 3, "n_trips_with_data": 1, "n_trips_no_avl": 1, "n_trips_no_gtfs": 1, "frac_good_trips": 1.0, "n_clearly_bad_trips": 0, "median_direction_margin": 2.0, "median_direction_agreement": 1.0, "longest_gap_seconds": 1.0,
            "frac_device_points_in_windows": 11 / 13, "frac_device_moving_points_in_windows": 11 / 12, "first_activity_gap_seconds": 0.0, "last_activity_gap_seconds": 60.0}
    assert {k: day[k] for k in want} == pytest.approx(want) and day["median_fare_near_stop_m"] is None
    assert set(day) == {*keys, *E.DAY_FEATURES}


def test_rank_correlation_needs_three_points_and_spread():
    assert E.rank_correlation(np.arange(2.0), np.arange(2.0)) == 0 and E.rank_correlation(np.arange(5.0), np.zeros(5)) == 0
    rng = np.random.default_rng(0)
    a, b = rng.random(50), rng.random(50)
    assert E.rank_correlation(a, b) == pytest.approx(pd.Series(a).rank().corr(pd.Series(b).rank()))
