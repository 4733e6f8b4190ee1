import numpy as np
import pytest
from pyspark.sql import functions as F

from farelane.operators import training as T


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(0)
    data = []
    for i in range(1200):
        a, b, c = rng.random(3)
        label = int(a + 0.15 * rng.standard_normal() > 0.5)
        data.append((i, f"bus{i % 60}", float(a), None if i % 7 == 0 else float(b), float(c), label))
    return spark.createDataFrame(data, "id int, bus string, a double, b double, c double, label int").repartition(2)


def test_fit_calibrate_and_evaluate(rows):
    test = T.held_out("bus")
    train = rows.where(~test)
    assert not {r["bus"] for r in train.select("bus").collect()} & {r["bus"] for r in rows.where(test).select("bus").collect()}
    scorer = T.calibrate(T.fit(train, ["a", "b", "c"], params={"maxIter": 5}), rows.where(test))
    assert T.importance(scorer)[0][0] == "a" and scorer.slope != 1.0
    m = T.evaluate(scorer.score(rows.where(test))).first()
    assert m["auc"] > 0.85 and m["ece"] < 0.15
    share = {r["limit"]: r["share"] for r in T.confident(scorer.score(rows)).collect()}
    assert share[0.7] >= share[0.95] and 0 < share[0.7] <= 1
    one = T.calibrate(T.Scorer(scorer.model, scorer.features), rows.where("label = 1"))
    assert (one.slope, one.offset) == (1.0, 0.0)  # nothing to calibrate on


def test_best_threshold_by_brute_force(spark):
    rng = np.random.default_rng(1)
    p, y = rng.random(300).round(3), rng.random(300) < 0.4
    got = T.best_threshold(spark.createDataFrame(list(zip(p.tolist(), y.astype(int).tolist(), strict=True)), "score double, label int")).first()
    f1 = {t: 2 * (y & (p >= t)).sum() / ((p >= t).sum() + y.sum()) for t in set(p)}
    best = max(f1.values())
    assert got["f1"] == pytest.approx(best) and got["threshold"] == max(t for t, v in f1.items() if abs(v - best) < 1e-9)


def test_search_keeps_the_feature_that_tells(rows):
    out = T.search(rows, ["a", "b", "c"], "bus", {"maxDepth": [2], "maxIter": [3]}, [1, 3], n_folds=2).collect()
    assert len(out) == 2 and {r["n_features"] for r in out} == {1, 3} and all(r["features"][0] == "a" for r in out) and out[0]["log_loss"] <= out[1]["log_loss"]


def test_cycle_keeps_model_and_figures(spark, rows, tmp_path):
    figures = T.cycle(rows.where("id % 4 > 0"), rows.where("id % 4 = 0"), ["a", "c"], "bus", str(tmp_path), "day")
    scorer, kept = T.load(spark, str(tmp_path), "day")
    assert kept["auc"] == figures["auc"] > 0.8 and scorer.features == ["a", "c"] and 0 <= figures["trust"] <= 0.6 and 0 < figures["confident_0.7"] <= 1
    assert scorer.score(rows.limit(3)).where(F.col("score").between(0, 1)).count() == 3
    with pytest.raises(LookupError):
        T.load(spark, str(tmp_path), "month")


def test_search_reads_its_rows_few_times(spark, rows):
    n = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(x):
        n.add(1)
        return x

    seen = rows.withColumn("a", counted("a"))
    T.search(seen, ["a", "c"], "bus", {"maxDepth": [1], "maxIter": [1]}, [1, 2], n_folds=2).collect()
    assert 1200 <= n.value <= 3 * 1200
