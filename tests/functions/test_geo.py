import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from farelane.functions import geo as G
from farelane.functions import scalars as S

points = st.lists(st.tuples(st.floats(-10, 10), st.floats(-10, 10)), min_size=1, max_size=7).map(lambda x: np.array(x, float))


def frechet_by_recursion(a, b):
    d = G.distances(a, b)

    def c(i, j):
        if i == 0 and j == 0:
            return d[0, 0]
        before = [c(x, y) for x, y in ((i - 1, j), (i - 1, j - 1), (i, j - 1)) if x >= 0 and y >= 0]
        return max(min(before), d[i, j])

    return c(len(a) - 1, len(b) - 1)


@settings(max_examples=60, deadline=None)
@given(points, points)
def test_trajectory_distances(a, b):
    assert G.frechet(a, b) == pytest.approx(frechet_by_recursion(a[:5], b[:5]) if len(a) <= 5 and len(b) <= 5 else G.frechet(b, a))
    assert G.hausdorff(a, b) <= G.frechet(a, b) + 1e-9
    assert G.hausdorff(a, b) == pytest.approx(max(G.nearest(a, b).max(), G.nearest(b, a).max()))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.floats(-5, 5), min_size=1, max_size=12))
def test_isotonic_is_monotone_and_keeps_the_mean(y):
    fit = G.isotonic(np.array(y))
    assert (np.diff(fit) >= -1e-9).all() and fit.mean() == pytest.approx(np.mean(y), abs=1e-9)
    assert np.allclose(G.isotonic(fit), fit)


def test_projection_and_polygon():
    line = np.array([(0, 0), (10, 0), (10, 10)], float)
    along, off, seg = G.project(line, np.array([(5, 1), (11, 5), (-3, 0)], float))
    assert along.tolist() == [5, 15, 0] and off.tolist() == [1, 1, 3] and seg.tolist() == [0, 1, 0]
    box = np.array([(0, 0), (4, 0), (4, 4), (0, 4)], float)
    assert G.in_polygon(box, np.array([(1, 1), (5, 1), (3.9, 3.9)])).tolist() == [True, False, True]
    assert G.forward_stops(line, np.array([(9, 1), (10, 2), (9.5, 0)], float)).tolist() == [9, 12, 12]


def test_viterbi_prefers_staying():
    stay = np.log(np.array([[0.9, 0.1], [0.1, 0.9]]))
    emit = np.log(np.array([[0.9, 0.1], [0.4, 0.6], [0.9, 0.1]]))
    assert G.viterbi(np.log([0.5, 0.5]), stay, emit).tolist() == [0, 0, 0]


def test_utm_of_known_points(spark):
    # the central meridian at the equator is the false origin; one degree of latitude there is 110,574 m times the scale
    df = spark.createDataFrame([(-39.0, 0.0), (-39.0, -1.0), (-38.5, -3.7)], "lon double, lat double")
    e, n = G.utm24s(F.col("lon"), F.col("lat"))
    got = [tuple(r) for r in df.select(e, n).collect()]
    assert got[0] == pytest.approx((500000, 10000000), abs=1e-3)
    assert 10000000 - got[1][1] == pytest.approx(110574.389 * 0.9996, abs=0.2)
    assert 500000 < got[2][0] < 600000


def test_null_safe_scalars(spark):
    row = spark.range(1).select(
        S.at_least_zero(F.lit(None).cast("double")).alias("a"), S.pad_short(F.lit("1074"), 3).alias("b"), S.pad_short(F.lit("42"), 3).alias("c"), S.heading(F.lit(9360)).alias("d"),
        S.gtfs_seconds(F.lit("25:10:00")).alias("e"), S.gtfs_seconds(F.lit(None).cast("string")).alias("f"), S.direction(F.lit(0), F.lit("614")).alias("g"), S.ratio(F.lit(1), F.lit(0)).alias("h"),
        S.confidence(F.lit(60)).alias("i"), S.confidence(F.lit(61)).alias("j"), S.confidence(F.lit(181)).alias("k"), S.digits(F.lit("none")).alias("l"), S.plain_upper(F.lit("03 - março")).alias("m"),
    ).first()
    assert tuple(row) == (None, "1074", "042", 0, 90600, None, "V", None, "high", "medium", "low", None, "MARCO")
