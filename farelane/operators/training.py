"""Training of scorers: fit, calibrate, evaluate, search, and a cycle that keeps what it fitted.

All fitting is Spark's own (boosted trees, logistic regression) on DataFrames; what the driver holds is one number a candidate
of a search. Rows of a group (a bus) always stay on one side of a split.
"""

from __future__ import annotations

import itertools
import json
import uuid
from dataclasses import dataclass, field

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from farelane.functions import scalars as S
from farelane.operators import matching as M
from farelane.operators import pairs as P
from farelane.session import scratch

#: Stands for a missing feature: trees split it off from all measured ones.
MISSING = -1e6
PARAMS = {"maxIter": 20, "maxDepth": 4, "stepSize": 0.1, "seed": 42}
HELD_OUT, SEED, CONFIDENT = 0.3, 42, (0.7, 0.8, 0.9, 0.95)


@dataclass
class Scorer:
    """A fitted model, its features in order, and the calibration of its scores: sigmoid(slope * logit(p) + offset)."""

    model: PipelineModel
    features: list[str]
    slope: float = 1.0
    offset: float = 0.0
    notes: dict = field(default_factory=dict)

    def raw(self, rows: DataFrame, name: str = "score") -> DataFrame:
        """rows with the model's own probability."""
        out = self.model.transform(_vector(rows, self.features))
        return out.withColumn(name, vector_to_array("probability")[1]).drop("_features", "rawPrediction", "probability", "prediction")

    def score(self, rows: DataFrame, name: str = "score") -> DataFrame:
        """rows with the calibrated probability."""
        z = self.slope * S.logit(S.clip(F.col(name), 1e-6, 1 - 1e-6)) + self.offset
        return self.raw(rows, name).withColumn(name, 1.0 / (1.0 + F.exp(-z)))


def _vector(rows: DataFrame, features: list[str]) -> DataFrame:
    cols = [F.coalesce(F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")), F.lit(MISSING)).alias(f"_f{i}") for i, c in enumerate(features)]
    names = [f"_f{i}" for i in range(len(features))]
    return VectorAssembler(inputCols=names, outputCol="_features").transform(rows.select("*", *cols)).drop(*names)


def fit(rows: DataFrame, features: list[str], label: str = "label", params: dict | None = None) -> Scorer:
    """Boosted trees with fixed parameters, so equal rows give equal models."""
    model = GBTClassifier(featuresCol="_features", labelCol="_label", **(PARAMS | (params or {}))).fit(_vector(rows, features).withColumn("_label", F.col(label).cast("double")))
    return Scorer(PipelineModel([model]), list(features))


def calibrate(scorer: Scorer, rows: DataFrame, label: str = "label") -> Scorer:
    """Platt's logistic curve over the log odds of scores of rows that the fit hasn't seen; as it is without both classes."""
    scored = scorer.raw(rows, "_p").select(F.col(label).cast("double").alias("label"), S.logit(S.clip(F.col("_p"), 1e-6, 1 - 1e-6)).alias("z"))
    if scored.select("label").distinct().count() < 2:
        return scorer
    curve = LogisticRegression(maxIter=50).fit(VectorAssembler(inputCols=["z"], outputCol="features").transform(scored))
    return Scorer(scorer.model, scorer.features, float(curve.coefficients[0]), float(curve.intercept), scorer.notes)


def evaluate(scored: DataFrame, label: str = "label", p: str = "score") -> DataFrame:
    """One row: n, auc, brier, log_loss, ece."""
    return M.calibration_metrics(scored.withColumn(label, F.col(label).cast("int")), label, p)


def confident(scored: DataFrame, p: str = "score", limits: tuple[float, ...] = CONFIDENT) -> DataFrame:
    """(limit, n, share): how many scores are at or beyond a limit on either side."""
    cols = [F.struct(F.lit(x).alias("limit"), F.count_if((F.col(p) >= x) | (F.col(p) <= 1 - x)).alias("n"), F.avg(((F.col(p) >= x) | (F.col(p) <= 1 - x)).cast("double")).alias("share")) for x in limits]
    return scored.agg(F.array(*cols).alias("a")).select(F.explode("a").alias("s")).select("s.*")


def best_threshold(scored: DataFrame, label: str = "label", p: str = "score") -> DataFrame:
    """(threshold, f1) of the largest F1; of equal ones the largest threshold. Scores are cumulated in blocks, so no task sorts all."""
    y = F.col(label).cast("long")
    g = scored.groupBy(F.col(p).alias("p")).agg(F.sum(y).alias("y"), F.count(F.lit(1)).alias("n")).withColumn("block", F.floor(F.col("p") * 1000))
    above = W.orderBy(F.desc("block")).rowsBetween(W.unboundedPreceding, -1)
    sums = g.groupBy("block").agg(F.sum("y").alias("by"), F.sum("n").alias("bn"))
    sums = sums.select("block", F.coalesce(F.sum("by").over(above), F.lit(0)).alias("ay"), F.coalesce(F.sum("bn").over(above), F.lit(0)).alias("an"))
    w = W.partitionBy("block").orderBy(F.desc("p"))
    c = g.join(sums, "block").select("p", (F.sum("y").over(w) + F.col("ay")).alias("tp"), (F.sum("n").over(w) + F.col("an")).alias("pred")).crossJoin(g.agg(F.sum("y").alias("pos")))
    return c.select(F.col("p").alias("threshold"), F.round(2.0 * F.col("tp") / (F.col("pred") + F.col("pos")), 9).alias("f1")).orderBy(F.desc("f1"), F.desc("threshold")).limit(1)


def held_out(group: str, share: float = HELD_OUT, seed: int = SEED) -> Column:
    """Whether a group belongs to the held-out share."""
    return F.pmod(F.xxhash64(group, F.lit(seed)), F.lit(10_000)) < int(share * 10_000)


def importance(scorer: Scorer) -> list[tuple[str, float]]:
    """Features by what the trees gain from them, the most first; ties by name."""
    return sorted(zip(scorer.features, map(float, scorer.model.stages[-1].featureImportances.toArray()), strict=True), key=lambda x: (-x[1], x[0]))


def _written(df: DataFrame, name: str) -> DataFrame:
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def search(rows: DataFrame, features: list[str], group: str, grid: dict[str, list], keep: list[int], label: str = "label", n_folds: int = 5) -> DataFrame:
    """(params, n_features, features, auc, log_loss, brier) of every point of the grid with the `keep` most important features, by
    cross-validation over group folds, the least log loss first. Importance comes from one fit on all features. Rows and each
    candidate's scores are written once, as fits and measures read them many times."""
    spark = rows.sparkSession
    folded = _written(P.folds(rows, group, n_folds).select("fold", label, *features), "folds")
    order = [f for f, _ in importance(fit(folded, features, label))]
    out = []
    for values in itertools.product(*grid.values()):
        params = dict(zip(grid, values, strict=True))
        for k in keep:
            own, parts = order[:k], None
            for f in range(n_folds):
                part = fit(folded.where(F.col("fold") != f), own, label, params).raw(folded.where(F.col("fold") == f)).select(label, "score")
                parts = part if parts is None else parts.unionByName(part)
            m = evaluate(_written(parts, "scores"), label).first()
            out.append((json.dumps(params, sort_keys=True), k, own, m["auc"], m["log_loss"], m["brier"]))
    schema = "params string, n_features int, features array<string>, auc double, log_loss double, brier double"
    return spark.createDataFrame(out, schema).orderBy("log_loss", "n_features", "params")


def forward_selection(rows: DataFrame, features: list[str], group: str, most: int, label: str = "label", n_folds: int = 3) -> list[str]:
    """Features added one at a time, each the one of least cross-validated log loss, until none helps or there are `most`."""
    folded, chosen, best = P.folds(rows, group, n_folds), [], float("inf")
    while len(chosen) < most:
        tried = []
        for c in (f for f in features if f not in chosen):
            parts = None
            for f in range(n_folds):
                part = fit(folded.where(F.col("fold") != f), [*chosen, c], label).raw(folded.where(F.col("fold") == f)).select(label, "score")
                parts = part if parts is None else parts.unionByName(part)
            tried.append((float(evaluate(parts, label).first()["log_loss"]), c))
        if not tried or min(tried)[0] >= best:
            break
        best, pick = min(tried)
        chosen.append(pick)
    return chosen


# ---- keeping -----------------------------------------------------------------------------------------------------------
def save(spark: SparkSession, root: str, kind: str, scorer: Scorer, metrics: dict) -> str:
    """Write the model into a folder of its own, then its registry row; the run's id. A run without its row doesn't count."""
    run = uuid.uuid4().hex
    scorer.model.write().save(f"{root}/{kind}/{run}")
    row = (kind, run, json.dumps({"features": scorer.features, "slope": scorer.slope, "offset": scorer.offset, "notes": scorer.notes}), json.dumps(metrics))
    made = spark.createDataFrame([row], "kind string, run string, scorer string, metrics string").withColumn("saved_at", F.current_timestamp())
    made.coalesce(1).write.mode("append").parquet(f"{root}/registry")
    return run


def load(spark: SparkSession, root: str, kind: str, run: str | None = None) -> tuple[Scorer, dict]:
    """(scorer, metrics) of a run, or of the kind's latest."""
    rows = spark.read.parquet(f"{root}/registry").where(F.col("kind") == kind)
    row = rows.where(F.col("run") == run).first() if run else rows.orderBy(F.desc("saved_at"), "run").first()
    if row is None:
        raise LookupError(f"no run of {kind} in {root}")
    told = json.loads(row["scorer"])
    model = PipelineModel.load(f"{root}/{kind}/{row['run']}")
    return Scorer(model, told["features"], told["slope"], told["offset"], told["notes"]), json.loads(row["metrics"])


def cycle(labelled: DataFrame, rest: DataFrame, features: list[str], group: str, root: str, kind: str, label: str = "label", calibrated: bool = True, n_resolved: int | None = None) -> dict:
    """One training cycle: split by group, fit, calibrate (or not), evaluate on the held-out groups, measure how many of `rest` are
    decided, keep model and figures. Returns the figures, with the run's id and the trust that the model has earned."""
    spark = labelled.sparkSession
    test = labelled.where(held_out(group))
    train = labelled.where(~held_out(group))
    part = held_out(group, 0.25, SEED + 1)
    scorer = fit(train.where(~part) if calibrated else train, features, label)
    if calibrated:
        scorer = calibrate(scorer, train.where(part), label)
    m = evaluate(scorer.score(test), label).first().asDict()
    cover = {f"confident_{r['limit']}": r["share"] for r in confident(scorer.score(rest)).collect()}
    n = n_resolved if n_resolved is not None else labelled.count()
    figures = {k: None if v is None else float(v) for k, v in m.items()} | cover | {"n_train": float(train.count())}
    figures["trust"] = M.model_weight(figures["ece"], n)
    return figures | {"run": save(spark, root, kind, scorer, figures)}
