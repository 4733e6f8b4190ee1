"""Track evidence and model keeping over the bridge views: features by direction and day, stop events, saved models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from farelane.functions import geo as G
from farelane.operators import features as E
from farelane.operators import pairs as P
from farelane.operators import training as T
from farelane.plans.arrivals import BRIDGE, stop_arrivals
from farelane.plans.catalog import query
from farelane.plans.expressions import route_lines
from farelane.session import scratch

KEYS = ["device", "day"]


def _metres(lon: str, lat: str) -> list:
    east, north = G.utm24s(F.col(lon), F.col(lat))
    return [east.alias("x"), north.alias("y")]


def routes(spark: SparkSession) -> DataFrame:
    """Both directions of each route, in metres: the second runs the line and its stops backwards."""
    line = spark.table("lines").select("route", "k", *_metres("lon", "lat")).groupBy("route").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "x", "y"))), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("line"))
    stops = spark.table("route_stops").select("route", "seq", *_metres("lon", "lat")).groupBy("route").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "x", "y"))), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("stops"))
    both = line.join(stops, "route").withColumn("direction", F.explode(F.array(F.lit("I"), F.lit("V"))))
    turned = both.withColumns({c: F.when(F.col("direction") == "V", F.reverse(c)).otherwise(F.col(c)) for c in ("line", "stops")})
    return turned.withColumns({"first_stops": F.slice("stops", 1, 1), "last_stops": F.slice("stops", -1, 1)})


def points(spark: SparkSession) -> DataFrame:
    p = spark.table("pings").where("lat < 0")
    return p.select("device", F.floor(F.col("ep") / 86400).alias("day"), F.col("event_id").alias("point_id"), F.col("ep").alias("at"), *_metres("lon", "lat"), (F.col("event_id") % 40).cast("double").alias("speed"), (F.col("heading") % 360).cast("double").alias("heading"), "route")


def trips(spark: SparkSession) -> DataFrame:
    """Windows as trips; one in six is of a route without a line."""
    w = spark.table("windows")
    return w.select("device", F.col("window_id").alias("trip_id"), "opened", "closed", F.floor(F.col("opened") / 86400).alias("day"), F.when(F.col("window_id") % 6 == 5, 99).otherwise(F.col("window_id") % 5).cast("int").alias("route"), (F.col("window_id") % 2).cast("int").alias("stated"))


def fares(spark: SparkSession) -> DataFrame:
    return spark.table("windows").where("closed > opened").select(F.col("window_id").alias("trip_id"), F.explode(F.array(F.col("opened") + 3600, F.col("opened") + 7200)).alias("at"))


def metrics(spark: SparkSession) -> DataFrame:
    return E.direction_metrics(E.sampled_trips(trips(spark), KEYS), points(spark), routes(spark), fares(spark))


@query("m01_direction_features")
def _(spark: SparkSession) -> DataFrame:
    return metrics(spark)


_CONTINUITY = """WITH p AS (SELECT device, CAST(floor(ep / 86400) AS BIGINT) AS day, event_id, ep, event_id % 40 > 3 AS moving FROM pings WHERE lat < 0),
w AS (SELECT device, CAST(floor(opened / 86400) AS BIGINT) AS day, opened, closed FROM windows),
d AS (SELECT device, day, min(opened) AS first, arg_max(closed, (opened, closed)) AS last FROM w GROUP BY device, day),
i AS (SELECT p.*, CASE WHEN EXISTS (SELECT 1 FROM w WHERE w.device = p.device AND w.day = p.day AND p.ep BETWEEN w.opened AND w.closed) THEN 1e0 ELSE 0e0 END AS inside FROM p),
s AS (SELECT device, day, avg(inside) AS one, avg(inside) FILTER (WHERE moving) AS two, min(ep) FILTER (WHERE moving) AS a, max(ep) FILTER (WHERE moving) AS z FROM i GROUP BY device, day)
SELECT d.device, d.day, round(one, 9) AS frac_device_points_in_windows, round(two, 9) AS frac_device_moving_points_in_windows, round(abs(a - first), 3) AS first_activity_gap_seconds, round(abs(z - last), 3) AS last_activity_gap_seconds FROM d LEFT JOIN s ON s.device = d.device AND s.day = d.day"""


@query("m03_day_continuity", _CONTINUITY)
def _(spark: SparkSession) -> DataFrame:
    out = E.day_continuity(trips(spark), points(spark), KEYS)
    return out.select(*KEYS, *[F.round(c, 9 if "frac" in c else 3).alias(c) for c in out.columns if c not in KEYS])


def pair_days(spark: SparkSession) -> DataFrame:
    own = E.sampled_trips(trips(spark), KEYS).withColumn("route_known", F.col("route") < 99)
    return E.pair_days(own, metrics(spark), E.day_continuity(trips(spark), points(spark), KEYS), KEYS)


@query("m02_pair_day_features")
def _(spark: SparkSession) -> DataFrame:
    return pair_days(spark)


@query("m32_stop_events")
def _(spark: SparkSession) -> DataFrame:
    """Every stop of the route of every tracked trip: observed (dwell), passed, extrapolated, not_reached or unobserved."""
    p, lines, stops = spark.table("pings").where("not (lat = 0 and lon = 0)"), route_lines(spark), spark.table("route_stops")
    return P.stop_events(p.withColumn("speed", F.col("event_id") % 40), lines, stops, stop_arrivals(p, lines, stops, BRIDGE), dwell_m=300.0)


FEATURES = ["n", "mean_fare", "first_tap", "last_tap", "price", "direction", "weekday"]


def labelled_trips(spark: SparkSession) -> DataFrame:
    """Trips with what their fares and times tell, and a label that depends on some of it; one mean in nine is missing."""
    x = spark.table("taps").groupBy("trip_id").agg(F.count(F.lit(1)).alias("n"), F.avg("fare_cents").alias("mean_fare"), F.min("tapped").alias("a"), F.max("tapped").alias("z"))
    t = spark.table("trips").join(x, "trip_id")
    noise = F.pmod(F.xxhash64("trip_id"), F.lit(100)) / 100.0
    return t.select(
        "trip_id", "bus_id", "n", F.when(F.col("trip_id") % 9 > 0, F.col("mean_fare")).alias("mean_fare"), (F.col("a") - F.col("opened")).alias("first_tap"), (F.col("closed") - F.col("z")).alias("last_tap"), "price", "direction", F.dayofweek("trip_date").alias("weekday"),
        ((F.col("n") / 7.0 + F.col("price") / 3e5 + noise) > 1.4).cast("int").alias("label"),
    )


@query("m16_boosted_trees")
def _(spark: SparkSession) -> DataFrame:
    rows = labelled_trips(spark)
    test = T.held_out("bus_id")
    return T.fit(rows.where(~test), FEATURES, params={"maxIter": 10}).raw(rows.where(test)).select("trip_id", "label", F.col("score").alias("p"))


@query("m20_feature_search")
def _(spark: SparkSession) -> DataFrame:
    return T.search(labelled_trips(spark), FEATURES, "bus_id", {"maxDepth": [2, 3], "maxIter": [5]}, [2, 7], n_folds=2)


@query("m37_training_cycle")
def _(spark: SparkSession) -> DataFrame:
    """Train on trips of whole buses, keep the model, and tell what it measured."""
    rows = labelled_trips(spark)
    judged = F.col("trip_id") % 5 > 0  # the others have no verdict yet
    figures = T.cycle(rows.where(judged), rows.where(~judged), FEATURES, "bus_id", scratch(spark, "models"), "trips")
    return spark.createDataFrame([(k, float(v)) for k, v in sorted(figures.items()) if k != "run"], "figure string, value double")


@query("m36_model_registry", "SELECT CAST(2 AS BIGINT) AS runs, 2 AS latest, count(*) AS scored, count(*) AS agree FROM trips JOIN (SELECT DISTINCT trip_id AS id FROM taps) x ON id = trip_id")
def _(spark: SparkSession) -> DataFrame:
    """Save two runs with their registry rows, load the latest, and score with it as before it was saved."""
    rows, root = labelled_trips(spark), scratch(spark, "models")
    for run in (1, 2):
        own = T.fit(rows, FEATURES[: 2 * run], params={"maxIter": 2, "maxDepth": run})
        T.save(spark, root, "trips", own, {"number": run})
    again, metrics = T.load(spark, root, "trips")
    both = again.score(rows).select("trip_id", "score").join(own.score(rows).select("trip_id", F.col("score").alias("before")), "trip_id")
    runs = spark.read.parquet(f"{root}/registry").agg(F.count(F.lit(1)).alias("runs"))
    out = both.agg(F.count(F.lit(1)).alias("scored"), F.count_if(F.abs(F.col("score") - F.col("before")) < 1e-12).alias("agree"))
    return out.crossJoin(runs).select("runs", F.lit(int(metrics["number"])).alias("latest"), "scored", "agree")
