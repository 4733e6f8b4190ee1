import random

from farelane.operators import relational as R


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_space_time_neighbours_are_not_broadcast(spark):
    rng = random.Random(1)
    rows = [(i, rng.random() / 20, rng.random() / 20, rng.random() * 9000) for i in range(300)]
    a, b = (spark.createDataFrame(rows, ", ".join(f"{c}{s} {t}" for c, t in (("id", "int"), ("x", "double"), ("y", "double"), ("t", "double")))) for s in "ab")
    got = R.near(a, b, "xa", "ya", "ta", "xb", "yb", "tb", 0.005, 1800.0)
    assert "BroadcastHashJoin" not in plan_of(got)
    want = {(p[0], q[0]) for p in rows for q in rows if (p[1] - q[1]) ** 2 + (p[2] - q[2]) ** 2 <= 0.005**2 and abs(p[3] - q[3]) <= 1800}
    assert sorted((r["ida"], r["idb"]) for r in got.collect()) == sorted(want) and len(want) > 300


def test_overlaps_without_buckets_copy_no_rows(spark):
    rng = random.Random(2)
    rows = [(i, rng.randrange(3), float(a := rng.randrange(50)), float(a + rng.randrange(-2, 30))) for i in range(200)]
    a, b = (spark.createDataFrame(rows, f"{s} int, k int, s{s} double, e{s} double") for s in "ab")
    got = R.overlapping(a, b, ["k"], "sa", "ea", "sb", "eb")
    assert "Generate" not in plan_of(got)
    want = sorted((p[0], q[0]) for p in rows for q in rows if p[1] == q[1] and q[2] < p[3] and q[3] > p[2])
    assert sorted((r["a"], r["b"]) for r in got.collect()) == want
