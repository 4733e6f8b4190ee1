import datetime as dt
import itertools
import time

import numpy as np
import pandas as pd
import pytest

from farelane.operators import matching as M


def test_assignment_and_margins_are_optimal():
    rng, seen = np.random.default_rng(0), 0
    for _ in range(300):
        n = int(rng.integers(1, 5))
        m = n + int(rng.integers(0, 3))
        cost = rng.random((n, m)).round(2)
        cost[rng.random((n, m)) < 0.2] = np.inf

        def best(c, n=n, m=m):
            return min(sum(c[i, p[i]] for i in range(n)) for p in itertools.permutations(range(m), n))

        edges = [[(j, float(c)) for j, c in enumerate(row) if np.isfinite(c)] for row in cost]
        if not np.isfinite(best(cost)):
            with pytest.raises(ValueError):
                M.solve(edges, m)
            continue
        seen += 1
        col, u, v = M.solve(edges, m)
        assert cost[np.arange(n), col].sum() == pytest.approx(best(cost))
        for i, spare in enumerate(M.margins(edges, col, u, v)):
            other = cost.copy()
            other[i, col[i]] = np.inf
            assert spare == pytest.approx(best(other) - best(cost))
    assert seen > 100


def test_a_whole_fleet_is_assigned_in_seconds():
    """1,600 buses, 1,400 devices, 0.7 % of pairs, with margins."""
    rng = np.random.default_rng(3)
    rows = [("d", f"b{i}", None, float(rng.uniform(0.02, 0.3))) for i in range(1600)]
    for i in range(1600):
        rows += [("d", f"b{i}", f"x{j}", float(rng.uniform(0.01, 0.99))) for j in rng.choice(1400, 10, replace=False)]
    belief = pd.DataFrame(rows, columns=["date", "bus_id", "device_id", "p"])
    began = time.process_time()
    got = M.assign_date(belief)
    took = time.process_time() - began
    assert len(got) == 1600 and not got.device_id.dropna().duplicated().any() and np.isfinite(got.margin).all()
    assert took < 20, took


def test_none_costs_what_the_bus_believes():
    d = "2023-11-01"
    belief = pd.DataFrame([(d, "a", "x", 0.4), (d, "a", None, 0.6), (d, "b", "x", 0.3), (d, "b", None, 0.05)], columns=["date", "bus_id", "device_id", "p"])
    got = M.assign_date(belief).set_index("bus_id")
    assert got.device_id["a"] is None and got.device_id["b"] == "x"
    assert got.cost["a"] == pytest.approx(-np.log(0.6)) and got.margin["b"] == pytest.approx(np.log(0.3 / 0.05)) and got.margin["a"] == pytest.approx(np.log(0.6 / 0.4) + np.log(0.3 / 0.05))


DAY = [dt.date(2023, 11, d) for d in range(1, 31)]


def smoothed(spark, rows):
    """rows: (bus, day number, device)."""
    a = spark.createDataFrame([(b, DAY[d - 1], x) for b, d, x in rows], "bus_id string, date date, device_id string")
    return a, *M.smooth_devices(a)


def spans(df):
    return sorted((r["device_id"], r["bus_id"], r["from_date"].day, r["to_date"].day, r["n_days"], r["n_corrected"]) for r in df.collect())


def test_smoothing_corrects_single_days_and_bridges_gaps(spark):
    rows = [(b, d, "x") for d, b in ((1, "A"), (2, "A"), (3, "B"), (4, "A"), (8, "A"))]
    _, intervals, corrections = smoothed(spark, rows)
    assert spans(intervals) == [("x", "A", 1, 8, 5, 1)] and [(r["date"].day, r["from_bus"], r["to_bus"]) for r in corrections.collect()] == [(3, "B", "A")]
    # another device has A on the odd day, and in the gap
    _, intervals, corrections = smoothed(spark, [*rows, ("A", 3, "y"), ("A", 6, "y")])
    assert [s for s in spans(intervals) if s[0] == "x"] == [("x", "A", 1, 2, 2, 0), ("x", "A", 4, 4, 1, 0), ("x", "A", 8, 8, 1, 0), ("x", "B", 3, 3, 1, 0)]
    assert corrections.count() == 0
    # a single day across gaps is a run too; the ends are not
    _, intervals, corrections = smoothed(spark, [("B", 1, "x"), ("A", 3, "x"), ("C", 6, "x"), ("A", 9, "x"), ("D", 10, "x")])
    assert [(r["date"].day, r["to_bus"]) for r in corrections.collect()] == [(6, "A")]
    # raw runs are judged, so alternating days are all corrected towards their neighbours at once
    _, intervals, corrections = smoothed(spark, [(b, d, "x") for d, b in enumerate("ABABA", 1)])
    assert sorted((r["date"].day, r["to_bus"]) for r in corrections.collect()) == [(2, "A"), (3, "B"), (4, "A")]


def test_extension_heeds_where_the_device_is(spark):
    a, intervals, corrections = smoothed(spark, [("A", 5, "x"), ("A", 6, "x"), ("Z", 12, "x"), ("Z", 13, "x"), ("M", 1, "p"), ("M", 9, "q")])
    running = spark.createDataFrame([("A", DAY[d - 1]) for d in (2, 5, 6, 8, 12, 20)] + [("M", DAY[3])], "bus_id string, date date")
    got = M.extend_single(intervals, running, M.corrected_owners(a, corrections))
    rows = sorted((r["bus_id"], r["device_id"], r["from_date"].day, r["to_date"].day, r["n_days"], r["n_extended"]) for r in got.collect())
    # day 12 is Z's; day 20 lies behind it; Z has no running days and M two devices
    assert rows == [("A", "x", 2, 8, 2, 2), ("A", "x", 20, 20, 0, 1), ("M", "p", 1, 1, 1, 0), ("M", "q", 9, 9, 1, 0), ("Z", "x", 12, 13, 2, 0)]


CANDIDATE = "bus_id string, date date, device_id string, score double, is_model_score boolean, temporal boolean, n_dictionary int, dictionary_conflict boolean"
VOTE = "bus_id string, date date, device_id string, decision string"


def odds(spark, candidates, votes=(), weight=0.6):
    c = spark.createDataFrame([("b", DAY[0], *x) for x in candidates], CANDIDATE)
    out = M.beliefs(c, spark.createDataFrame([("b", DAY[0], *v) for v in votes], VOTE), weight).collect()
    return {r["device_id"]: r["log_odds"] for r in out}, {r["device_id"]: r["p"] for r in out}


def test_beliefs_by_hand(spark):
    ln = np.log
    got, p = odds(spark, [("x", 0.9, True, False, 0, False), ("y", 0.9, False, True, 1, False), ("z", 0.999, False, False, 2, True), ("w", None, True, False, 2, False), ("v", 0.6, False, False, 1, False)], [("x", "match"), (None, "none_of_these"), ("q", "match"), ("x", "unsure")], 0.4)
    against = ln(1.3)
    assert got["x"] == pytest.approx(0.4 * ln(9) + ln(9) - 2 * against)
    assert got["y"] == pytest.approx(0.15 * ln(9) + 0.5 * ln(5) + 0.6 * ln(4) - 3 * against)
    assert got["z"] == pytest.approx(0.15 * ln(49) + 0.6 * 0.5 * ln(12) - 3 * against)
    assert got["w"] == pytest.approx(-3 * against)  # unscored: even odds, and too far from the best for the dictionary
    assert got["v"] == pytest.approx(0.15 * ln(1.5) - 3 * against)
    assert got[None] == pytest.approx(0.15 * ln(0.3) + ln(9) - 2 * against)
    assert sum(p.values()) == pytest.approx(1)


def test_support_comes_from_other_dates_only(spark):
    c = spark.createDataFrame([("b", DAY[d], x, 0.5, False, False, 0, False) for d in (0, 1) for x in ("x", "y")], CANDIDATE)
    confirmed = spark.createDataFrame([("b", DAY[0], "x")], "bus_id string, date date, device_id string")
    got = {(r["date"].day, r["device_id"]): r["temporal"] for r in M.with_temporal(c, confirmed).collect()}
    assert got == {(1, "x"): False, (1, "y"): False, (2, "x"): True, (2, "y"): False}


def test_none_of_these_can_be_resolved(spark):
    c = spark.createDataFrame([("b", DAY[0], "x", 0.02, True, False, 0, False)], CANDIDATE)
    votes = spark.createDataFrame([("b", DAY[0], None, "none_of_these")] * 2, VOTE)
    r = M.summary(M.beliefs(c, votes)).first()
    assert r["resolved"] and r["decision"] == "none_of_these" and r["top_device"] is None and r["n_votes"] == 2


def test_one_vote_moves_log_odds(spark):
    c = spark.createDataFrame([("b", dt.date(2023, 11, 1), d, 0.5, False, 0) for d in ("x", "y")], "bus_id string, date date, device_id string, score double, temporal boolean, n_dictionary int")
    none = spark.createDataFrame([], "bus_id string, date date, device_id string, decision string")
    one = spark.createDataFrame([("b", dt.date(2023, 11, 1), "x", "match")], none.schema)
    before = {r["device_id"]: r["log_odds"] for r in M.beliefs(c, none).collect()}
    after = {r["device_id"]: r["log_odds"] for r in M.beliefs(c, one).collect()}
    assert after["x"] - before["x"] == pytest.approx(np.log(9)) and after["y"] - before["y"] == pytest.approx(-np.log(1.3))
    assert sum(r["p"] for r in M.beliefs(c, one).collect()) == pytest.approx(1)


def test_model_weight_limits():
    assert M.model_weight(0.05, 15) == pytest.approx(0.6) and M.model_weight(0.3, 15) == 0 and M.model_weight(0.0, 14) == 0 and M.model_weight(0.175, 99) == pytest.approx(0.3)
